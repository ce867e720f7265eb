"""Names, mappings and thresholds that the operators take as arguments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# --- Fixed values -----------------------------------------------------------------------
# Column names and labels of the public ledger; results depend on them exactly.

DEPARTMENT_MODES = {
    "raw": "samtala2_raw",
    "canonical": "samtala2_canonical",
    "family": "samtala2_family",
}

SERIES_KEYS = (
    "samtala0", "samtala1", "samtala2", "samtala3",
    "tegund0", "tegund1", "tegund2", "tegund3",
    "vm_nafn", "vm_numer",
)

CANONICAL_DEPARTMENTS = {
    "Frístund": "Frístundastarf",
    "Búsetuúrræði": "Búsetuþjónusta",
    "Heimaþjónusta - Heimahjúkrun": "Heimaþjónusta og Heimahjúkrun",
    "Heimastuðningur": "Heimaþjónusta og Heimahjúkrun",
    "Heimahjúkrun": "Heimaþjónusta og Heimahjúkrun",
}

DEPARTMENT_FAMILIES = {
    "Frístund": "Frístund / Frístundastarf",
    "Frístundastarf": "Frístund / Frístundastarf",
    "Búsetuúrræði": "Búsetuúrræði / Búsetuþjónusta",
    "Búsetuþjónusta": "Búsetuúrræði / Búsetuþjónusta",
    "Heimaþjónusta - Heimahjúkrun": "Heimaþjónusta / Heimastuðningur",
    "Heimaþjónusta og Heimahjúkrun": "Heimaþjónusta / Heimastuðningur",
    "Heimastuðningur": "Heimaþjónusta / Heimastuðningur",
    "Heimahjúkrun": "Heimaþjónusta / Heimastuðningur",
}

EXCLUDED_DEPARTMENTS = (
    "Fasteignatekjur",
    "Fasteignir í umsjón Eignaskrifstofu",
    "Jöfnunarsjóðstekjur",
    "Fasteignir",
    "Útsvarstekjur",
    "Áhöld, tæki og stofnbúnaður",
    "Lóðir og lönd",
    "Götur, göngul. og opin svæði",
)

WAGE_GROUP = "Laun"

# Texts that a source file uses for "no value".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# --- End of fixed values ----------------------------------------------------------------


@dataclass(frozen=True)
class LedgerProfile:
    """How a ledger is laid out. The defaults describe the public ledger."""

    department_source: str = "samtala2"
    institution: str = "samtala0"
    account_group: str = "tegund0"
    measure: str = "raun"
    year: str = "year"
    month: str = "period_month"
    # Digits of amounts in all and after the comma; further decimals are rounded half up.
    precision: int = 28
    scale: int = 2
    wage_group: str = WAGE_GROUP
    canonical: Mapping[str, str] = field(default_factory=lambda: dict(CANONICAL_DEPARTMENTS))
    family: Mapping[str, str] = field(default_factory=lambda: dict(DEPARTMENT_FAMILIES))
    excluded: Sequence[str] = EXCLUDED_DEPARTMENTS
    department_mode: str = "canonical"
    # Cells in which wages and other costs are netted before they are clamped at zero.
    detail: Sequence[str] = ("samtala1", "samtala3", "tegund1", "tegund2", "tegund3", "vm_numer")

    @property
    def department(self) -> str:
        """The department column in use; an unknown mode means canonical."""
        mode = self.department_mode.strip().lower()
        return DEPARTMENT_MODES.get(mode, DEPARTMENT_MODES["canonical"])

    @property
    def filter_columns(self) -> list[str]:
        return [
            "fyrirtaeki", self.institution, "samtala1", self.department, "samtala3",
            self.account_group, "tegund1", "tegund2", "tegund3", "vm_numer", "vm_nafn",
        ]

    @property
    def category_columns(self) -> list[str]:
        return [
            "fyrirtaeki", self.institution, "samtala1", self.department, "samtala3",
            self.account_group, "tegund1", "tegund2", "tegund3",
        ]

    @property
    def anomaly_parents(self) -> list[str]:
        return [
            self.institution, "samtala1", self.department, "samtala3",
            self.account_group, "tegund1", "tegund2", "tegund3", "vm_nafn", "vm_numer",
        ]

    @property
    def scope_columns(self) -> list[str]:
        return [
            self.year, self.institution, "samtala1", self.department, "samtala3",
            self.account_group, "tegund1", "tegund2", "tegund3", "vm_nafn", "vm_numer", self.measure,
        ]


@dataclass(frozen=True)
class AnomalyConfig:
    z_threshold: float = 3.5
    pct_threshold: float = 0.25
    min_abs_real_change: float = 5_000_000
    min_prior_real_abs: float = 2_000_000
    min_years: int = 4
