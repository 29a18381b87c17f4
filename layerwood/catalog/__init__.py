from . import cascades, encoding, metrics, models, sampling, splits, vectors  # noqa: F401  (they register)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
