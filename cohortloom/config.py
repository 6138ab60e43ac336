"""Study parameters. Operators take a StudyConfig; nothing is kept in session globals."""

from __future__ import annotations

from dataclasses import dataclass, field
from statistics import NormalDist

# ---- Fixed values -----------------------------------------------------------
# Names, order, ids and lengths the study is defined by. The order of
# TREATMENT_SETS also settles ties: on one day ART comes before IUI.
TREATMENT_SETS = ("ART", "IUI")
OUTCOME_SETS = ("pregnant", "abortion", "stillbirth", "labor")
COVARIATE_SETS = ("alcohol", "tobacco", "obesity", "PCOS", "f_infert", "m_infert")

CONCEPT_SET_IDS = {
    "ART": 1125,
    "IUI": 1124,
    "tobacco": 1157,
    "PCOS": 1982,
    "alcohol": 1190,
    "obesity": 1126,
    "f_infert": 2279,
    "m_infert": 2312,
    "pregnant": 332,
    "stillbirth": 398,
    "abortion": 399,
    "labor": 365,
}

PREGNANCY_LOSS = "pregnancy loss"
LIVE_BIRTH = "live_birth"
CENSORED = "censored"
PREGNANCY = "pregnancy"
NO_PREGNANCY = "no pregnancy"

COVARIATE_MONTHS = 12
TREATMENT_MONTHS = 4
CYCLE_DAYS = 14
MAX_CYCLES = 4
QUICK_RESTART_DAYS = 21
PREGNANCY_DAYS = 45 * 7
LOSS_DAYS = 20 * 7
HORIZON_DAYS = 424
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class PullSpec:
    """One concept-set pull: the set, its inclusive date window and its shape.

    ``keep_all`` true gives one row per event, false a 0/1 person indicator.
    """

    concept_set: str
    start_col: str
    end_col: str
    keep_all: bool


@dataclass(frozen=True)
class StudyConfig:
    treatment_sets: tuple[str, ...] = TREATMENT_SETS
    outcome_sets: tuple[str, ...] = OUTCOME_SETS
    covariate_sets: tuple[str, ...] = COVARIATE_SETS
    covariate_months: int = COVARIATE_MONTHS
    treatment_months: int = TREATMENT_MONTHS
    cycle_days: int = CYCLE_DAYS
    max_cycles: int = MAX_CYCLES
    quick_restart_days: int = QUICK_RESTART_DAYS
    pregnancy_days: int = PREGNANCY_DAYS
    loss_days: int = LOSS_DAYS
    horizon_days: int = HORIZON_DAYS
    late_events: str = "keep"
    conf_level: float = 0.95
    source_schema: str | None = None
    write_schema: str | None = None
    cohort_definition_id: int | None = None
    id_by_set: dict[str, int] = field(default_factory=lambda: dict(CONCEPT_SET_IDS))

    def __post_init__(self):
        if self.late_events not in ("keep", "censor"):
            raise ValueError("late_events must be 'keep' or 'censor'")

    @property
    def covariates(self) -> tuple[str, ...]:
        """Indicator column names: the set names in lower case."""
        return tuple(name.lower() for name in self.covariate_sets)

    @property
    def z(self) -> float:
        """Two-sided normal quantile of the confidence level."""
        return NormalDist().inv_cdf(0.5 + self.conf_level / 2)

    def pulls(self) -> tuple[PullSpec, ...]:
        """All pulls of the study: treatments, outcomes, then indicators."""
        return (
            *(PullSpec(s, "cohort_start_date", "txt_end_date", True) for s in self.treatment_sets),
            *(PullSpec(s, "cohort_start_date", "cohort_end_date", True) for s in self.outcome_sets),
            *(PullSpec(s, "covariate_start_date", "cohort_start_date", False) for s in self.covariate_sets),
        )
