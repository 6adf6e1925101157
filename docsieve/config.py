"""Settings shared by the prepare, tuning and scoring jobs."""

from __future__ import annotations

from dataclasses import dataclass

# Class order (position = class index) and the class scored as positive.
CLASS_NAMES = ("no", "yes")
POSITIVE_INDEX = 1


@dataclass(frozen=True)
class Settings:
    """Knobs of the jobs; every one can be overridden per run. The defaults are fixed values."""

    reject_prefix: str = "ENCSR"
    keep_rejected: bool = False
    preprocessor: str | None = None
    grid_beta: float = 4.0
    compare_beta: float = 4.0
    test_fraction: float = 0.20
    folds: int = 5
    index_table: str = "run_index"
    prediction_prefix: str = "predictions"
