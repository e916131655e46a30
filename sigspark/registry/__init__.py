"""Named queries over the driver's tables."""

from sigspark.registry import files, ordered, scalars, spectra  # noqa: F401
from sigspark.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
