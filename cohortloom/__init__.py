"""Longitudinal cohort, treatment-cycle and weighted-survival operators on Spark DataFrames."""

from .config import StudyConfig
from .session import materialize, tune

__all__ = ["StudyConfig", "materialize", "tune"]
