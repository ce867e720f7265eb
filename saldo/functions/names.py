"""Column names of source files (schema names only, so this runs on the driver)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence


def reader_names(header: Sequence[str]) -> list[str]:
    """Names as a CSV reader gives them: blanks are numbered, repeated names get ``.1``, ``.2``."""
    out: list[str] = []
    taken: set[str] = set()
    for position, name in enumerate(header):
        base = name if name else f"Unnamed: {position}"
        candidate, n = base, 0
        while candidate in taken:
            n += 1
            candidate = f"{base}.{n}"
        taken.add(candidate)
        out.append(candidate)
    return out


def plain_name(name: str) -> str:
    """Lower-case ASCII name: accents folded, other letters dropped, the rest joined by ``_``."""
    folded = "".join(ch for ch in unicodedata.normalize("NFKD", name) if ch.isascii())
    words = re.findall(r"[A-Za-z0-9]+", folded)
    return "_".join(words).lower() or "col"


def unique_names(names: Iterable[str]) -> list[str]:
    """Number repeated names from 2 on, skipping numbers that another column already has."""
    wanted = list(names)
    reserved = set(wanted)
    used: set[str] = set()
    out = []
    for name in wanted:
        candidate, n = name, 1
        while candidate in used or (n > 1 and candidate in reserved):
            n += 1
            candidate = f"{name}_{n}"
        used.add(candidate)
        out.append(candidate)
    return out


def normalize_columns(names: Iterable[str]) -> list[str]:
    return unique_names(plain_name(n) for n in names)
