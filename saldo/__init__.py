"""Public-accounting analytics as ordinary Spark DataFrame operators."""

from saldo.settings import AnomalyConfig, LedgerProfile

__all__ = ["AnomalyConfig", "LedgerProfile"]
