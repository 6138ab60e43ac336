"""Cohort windows, cohort generation from a definition, attrition counts and era collapse."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import StudyConfig
from ..session import materialize

DAYS_TO_A_TASK = 200_000

WINDOW_COLUMNS = (
    "person_id",
    "cohort_start_date",
    "cohort_end_date",
    "covariate_start_date",
    "txt_end_date",
)


def one_row_per_person(cohort: DataFrame) -> DataFrame:
    """Fail the query if a person has two cohort rows.

    Checked inside the plan: the aggregate leaves rows hashed by person, which
    the joins that follow need anyway.
    """
    counted = cohort.groupBy("subject_id").agg(
        F.min("cohort_start_date").alias("cohort_start_date"),
        F.min("cohort_end_date").alias("cohort_end_date"),
        F.count("*").alias("n_rows"),
    )
    message = F.concat(F.lit("more than one cohort row for person "), F.col("subject_id").cast("string"))
    single = F.when(F.col("n_rows") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return counted.where(single).drop("n_rows")


def cohort_windows(cohort: DataFrame, config: StudyConfig = StudyConfig()) -> DataFrame:
    """Cohort rows with the start of the covariate window and the end of the treatment window."""
    start = F.col("cohort_start_date")
    return one_row_per_person(cohort).select(
        F.col("subject_id").alias("person_id"),
        start,
        F.col("cohort_end_date"),
        F.add_months(start, -config.covariate_months).alias("covariate_start_date"),
        F.add_months(start, config.treatment_months).alias("txt_end_date"),
    )


@dataclass(frozen=True)
class Criterion:
    """Number of events of some sets in [entry + first_day, entry + last_day] lies in a range.

    A day of None leaves that side open. ``distinct_days`` counts days with an event instead of events.
    """

    concept_sets: tuple[str, ...]
    first_day: int | None
    last_day: int | None
    at_least: int = 0
    at_most: int | None = None
    distinct_days: bool = False


@dataclass(frozen=True)
class Group:
    """Between ``at_least`` and ``at_most`` of the members hold; without bounds all of them. Members may be groups."""

    members: tuple["Criterion | Group", ...]
    at_least: int | None = None
    at_most: int | None = None


def all_of(*members: Criterion | Group) -> Group:
    return Group(members)


def any_of(*members: Criterion | Group) -> Group:
    return Group(members, at_least=1)


def none_of(*members: Criterion | Group) -> Group:
    return Group(members, at_most=0)


def at_least(n: int, *members: Criterion | Group) -> Group:
    return Group(members, at_least=n)


@dataclass(frozen=True)
class InclusionRule:
    """A rule of one criterion: number of events of some sets in [entry + first_day, entry + last_day] in a range."""

    name: str
    concept_sets: tuple[str, ...]
    first_day: int
    last_day: int
    at_least: int = 0
    at_most: int | None = None

    @property
    def condition(self) -> Criterion:
        return Criterion(self.concept_sets, self.first_day, self.last_day, self.at_least, self.at_most)


@dataclass(frozen=True)
class Rule:
    """A named rule of nested groups."""

    name: str
    condition: Criterion | Group


@dataclass(frozen=True)
class CohortSpec:
    """Entry: an event of ``entry_sets`` with enough observation before it.

    ``entries``: a person's ``first`` such event only, or ``all`` of them. ``entry_if`` must hold for an
    event to count as an entry at all; it takes no part in the statistics.
    ``rows``: of the entries that pass every rule the ``first`` makes a cohort row, or ``all`` do,
    overlapping ones as one. Exit: end of observation, ``max_follow_up`` days after entry or
    the first event of ``censor_sets`` after the entry's day, whichever is first.
    """

    cohort_definition_id: int
    entry_sets: tuple[str, ...]
    entry_from: str
    prior_days: int
    max_follow_up: int
    rules: tuple[InclusionRule | Rule, ...] = ()
    entries: str = "first"
    entry_if: Criterion | Group | None = None
    censor_sets: tuple[str, ...] = ()
    rows: str = "first"

    def __post_init__(self):
        if not {self.entries, self.rows} <= {"first", "all"}:
            raise ValueError("entries and rows are 'first' or 'all'")


WORD_BITS = 62  # rules to a word: the words stay positive numbers


def _words(bits: Sequence[int]) -> list[int]:
    """Bits by number as words; at least one word."""
    count = max(1, -(-len(bits) // WORD_BITS))
    return [sum(bit << place for place, bit in enumerate(bits[n * WORD_BITS : (n + 1) * WORD_BITS])) for n in range(count)]


def _full(spec: CohortSpec) -> list[int]:
    return _words([1] * len(spec.rules))


def _long_array(words: Sequence[int]) -> Column:
    return F.array(*[F.lit(word).cast("long") for word in words])


def _criteria(condition: Criterion | Group) -> list[Criterion]:
    return [condition] if isinstance(condition, Criterion) else [c for member in condition.members for c in _criteria(member)]


class _Counts:
    """The counts that criteria ask for, each one column; equal ones are one. Frames over days, so all take one sort of a person."""

    def __init__(self):
        self.names: dict[tuple, str] = {}

    def name(self, c: Criterion) -> str:
        key = (c.concept_sets, c.first_day, c.last_day, c.distinct_days)
        return self.names.setdefault(key, f"count_{len(self.names)}")

    def columns(self) -> dict[str, Column]:
        found = {}
        for (sets, first, last, distinct_days), name in self.names.items():
            frame = _days_from_entry(first, last)
            inside = F.col("concept_set").isin(*sets)
            if distinct_days:
                found[name] = F.size(F.collect_set(F.when(inside, F.col("day"))).over(frame))
            else:
                found[name] = F.coalesce(F.sum(F.when(inside, F.col("n_events"))).over(frame), F.lit(0))
        return found

    def holds(self, condition: Criterion | Group) -> Column:
        if isinstance(condition, Criterion):
            count = F.col(self.name(condition))
            held = count >= condition.at_least
            return held if condition.at_most is None else held & (count <= condition.at_most)
        held = [self.holds(member) for member in condition.members]
        if condition.at_least is None and condition.at_most is None:
            return reduce(lambda a, b: a & b, held, F.lit(True))
        if condition.at_least == 1 and condition.at_most is None:
            return reduce(lambda a, b: a | b, held, F.lit(False))
        total = reduce(lambda a, b: a + b, [h.cast("int") for h in held], F.lit(0))
        return (total >= (condition.at_least or 0)) & (total <= (len(held) if condition.at_most is None else condition.at_most))


def _days_from_entry(first: int | None, last: int | None) -> W:
    start = W.unboundedPreceding if first is None else first
    return W.partitionBy("person_id").orderBy("day").rangeBetween(start, W.unboundedFollowing if last is None else last)


def evaluate_rules(days: DataFrame, observation: DataFrame, specs: Sequence[CohortSpec], parts: int | None = None) -> DataFrame:
    """Entries of all definitions with ``inclusion_words``, a bit for every rule, 62 to a word, and ``inclusion_mask``, the first word.

    Also the end of observation and the day of the first censoring event (null: none). ``days`` are
    distinct person-set-days (see ``event_days``), so a person is bounded by the calendar and
    windows over persons are safe. Entries, counts and censoring of all definitions
    come from one pass over them: frames of days around every day of a person. ``parts`` is
    into how many tasks persons are dealt; without it the session's settings decide.
    """
    conditions = [rule.condition for spec in specs for rule in spec.rules] + [spec.entry_if for spec in specs if spec.entry_if]
    used = sorted({s for spec in specs for s in (*spec.entry_sets, *spec.censor_sets)} | {
        s for condition in conditions for c in _criteria(condition) for s in c.concept_sets
    })
    days = days.where(F.col("concept_set").isin(*used))
    if parts:
        days, observation = days.repartition(parts, "person_id"), observation.repartition(parts, "person_id")
    observed = days.join(observation, "person_id")
    rows = observed.withColumn("day", F.datediff("date", F.lit("1970-01-01").cast("date")))
    person, after = W.partitionBy("person_id"), _days_from_entry(1, None)
    counts, entry_days, censor_dates = _Counts(), {}, {}
    results, opened = [], []
    for k, spec in enumerate(specs):
        opens = (
            F.col("concept_set").isin(*spec.entry_sets)
            & (F.col("date") >= F.lit(spec.entry_from).cast("date"))
            & F.col("date").between(F.date_add("observation_period_start_date", spec.prior_days), F.col("observation_period_end_date"))
        )
        if spec.entries == "first":
            entry_days[f"entry_{k}"] = F.min(F.when(opens, F.col("day"))).over(person)
            opens = opens & (F.col("day") == F.col(f"entry_{k}"))
        censored = F.lit(None).cast("date")
        if spec.censor_sets:
            censor_dates[f"censor_{k}"] = F.min(F.when(F.col("concept_set").isin(*spec.censor_sets), F.col("date"))).over(after)
            censored = F.col(f"censor_{k}")
        bits = [counts.holds(rule.condition).cast("long") for rule in spec.rules]
        words = [
            reduce(lambda a, b: a + b, [bit * F.lit(2**place).cast("long") for place, bit in enumerate(bits[at : at + WORD_BITS])], F.lit(0).cast("long"))
            for at in range(0, max(1, len(bits)), WORD_BITS)
        ]
        opened.append(opens)
        entry = F.struct(
            F.lit(spec.cohort_definition_id).alias("cohort_definition_id"),
            F.col("date").alias("entry_date"),
            censored.alias("censor_date"),
            F.array(*words).alias("inclusion_words"),
            words[0].alias("inclusion_mask"),
        )
        results.append(F.when(opens & counts.holds(spec.entry_if) if spec.entry_if else opens, entry))
    framed = rows.withColumns(entry_days).withColumns(counts.columns() | censor_dates)
    entries = framed.where(reduce(lambda a, b: a | b, opened)).select(
        "person_id", "observation_period_end_date", F.explode(F.array_compact(F.array(*results))).alias("entry")
    )
    # two sets may open an entry on one day
    return entries.select("person_id", "observation_period_end_date", "entry.*").distinct()


def stored_entries(days: DataFrame, observation: DataFrame, specs: Sequence[CohortSpec]) -> DataFrame:
    """``evaluate_rules``, written once: frames that read the entries several times would each repeat the whole pass.

    The days are counted first, so they should be stored. Persons are dealt into tasks of about
    DAYS_TO_A_TASK days, so what a task holds does not grow with the table.
    """
    parts = max(1, -(-days.count() // DAYS_TO_A_TASK))
    return materialize(evaluate_rules(days, observation, specs, parts), "entries")


def _by_definition(specs: Sequence[CohortSpec], value) -> Column:
    return F.coalesce(*[F.when(F.col("cohort_definition_id") == spec.cohort_definition_id, value(spec)) for spec in specs])


def _passing(evaluated: DataFrame, specs: Sequence[CohortSpec]) -> DataFrame:
    return evaluated.where(F.col("inclusion_words") == _by_definition(specs, lambda spec: _long_array(_full(spec))))


def cohort_exits(evaluated: DataFrame, specs: Sequence[CohortSpec]) -> DataFrame:
    """Entries that pass every rule, with the cohort's end and what ends it: ``censored``, ``follow-up`` or ``observation``.

    Of ends on one day the censoring counts first, then the follow-up. Definitions
    that make one row per person keep the person's first such entry.
    """
    follow_up = F.date_add("entry_date", _by_definition(specs, lambda spec: F.lit(spec.max_follow_up)))
    end = F.least("observation_period_end_date", follow_up, "censor_date")
    reason = F.when(F.col("censor_date") == end, "censored").when(follow_up == end, "follow-up").otherwise("observation")
    exits = _passing(evaluated, specs).select(
        "cohort_definition_id",
        F.col("person_id").alias("subject_id"),
        F.col("entry_date").alias("cohort_start_date"),
        end.alias("cohort_end_date"),
        reason.alias("exit_reason"),
    )
    many = [spec.cohort_definition_id for spec in specs if spec.entries == "all" and spec.rows == "first"]
    if not many:
        return exits
    keys = ["cohort_definition_id", "subject_id"]
    first = exits.where(F.col("cohort_definition_id").isin(many)).groupBy(*keys).agg(
        F.min(F.struct("cohort_start_date", "cohort_end_date", "exit_reason")).alias("first")
    )
    return exits.where(~F.col("cohort_definition_id").isin(many)).unionByName(first.select(*keys, "first.*"))


def cohort_rows(exits: DataFrame, specs: Sequence[CohortSpec]) -> DataFrame:
    """Cohort rows by their exits; where a definition takes all entries, overlapping rows are one."""
    rows = exits.drop("exit_reason")
    many = [spec.cohort_definition_id for spec in specs if spec.entries == spec.rows == "all"]
    if not many:
        return rows
    merged = collapse_eras(rows.where(F.col("cohort_definition_id").isin(many)))
    return rows.where(~F.col("cohort_definition_id").isin(many)).unionByName(merged)


def generate_cohorts(days: DataFrame, observation: DataFrame, specs: Sequence[CohortSpec]) -> DataFrame:
    """Cohort rows of all definitions: entries that pass every rule."""
    evaluated = stored_entries if any(spec.entries == "all" for spec in specs) else evaluate_rules
    return cohort_rows(cohort_exits(evaluated(days, observation, specs), specs), specs)


def exit_counts(exits: DataFrame) -> DataFrame:
    """Per definition and reason: entries whose time in the cohort ends by it, and persons with such an entry."""
    per_person = exits.groupBy("cohort_definition_id", "exit_reason", "subject_id").agg(F.count("*").alias("n"))
    return per_person.groupBy("cohort_definition_id", "exit_reason").agg(
        F.sum("n").alias("entry_count"), F.count("*").alias("person_count")
    )


def best_events(evaluated: DataFrame) -> DataFrame:
    """One entry per person and definition: the one that fulfils most rules, the earliest of equals."""
    fulfilled = F.aggregate("inclusion_words", F.lit(0), lambda total, word: total + F.bit_count(word))
    names = [name for name in evaluated.columns if name not in ("cohort_definition_id", "person_id")]
    rank = F.struct(fulfilled.alias("fulfilled"), (-F.datediff("entry_date", F.lit("1970-01-01").cast("date"))).alias("earliness"))
    best = evaluated.groupBy("cohort_definition_id", "person_id").agg(F.max_by(F.struct(*names), rank).alias("best"))
    return best.select("cohort_definition_id", "person_id", "best.*")


def inclusion_counts(evaluated: DataFrame) -> DataFrame:
    """Entries per definition and rule outcome (one entry per person where ``evaluated`` holds the best ones, or first ones, only)."""
    counted = evaluated.groupBy("cohort_definition_id", "inclusion_words").agg(F.count("*").alias("person_count"))
    return counted.select("cohort_definition_id", F.col("inclusion_words")[0].alias("inclusion_mask"), "inclusion_words", "person_count")


def inclusion_by_mode(evaluated: DataFrame) -> DataFrame:
    """The same counts by event (every entry counts) and by person (each person's best entry counts), told apart by ``mode``."""
    modes = {"event": evaluated, "person": best_events(evaluated)}
    frames = [inclusion_counts(frame).withColumn("mode", F.lit(mode)) for mode, frame in modes.items()]
    return frames[0].unionByName(frames[1])


def _has_all(required: Column) -> Column:
    held = F.zip_with("inclusion_words", required, lambda word, wanted: word.bitwiseAND(wanted) == wanted)
    return F.forall(held, lambda ok: ok)


def attrition(evaluated: DataFrame, specs: Sequence[CohortSpec]) -> DataFrame:
    """Entries left after each rule, rules applied in order; row 0 is all entries.

    Works on the outcome counts, so its cost does not grow with the cohort.
    """
    counts = inclusion_counts(evaluated)
    steps = []
    for spec in specs:
        names = ["all entries", *[rule.name for rule in spec.rules]]
        required = [_long_array(_words([1] * n + [0] * (len(spec.rules) - n))) for n in range(len(names))]
        for sequence, name in enumerate(names):
            steps.append(
                F.struct(
                    F.lit(spec.cohort_definition_id).alias("definition"),
                    F.lit(sequence).alias("rule_sequence"),
                    F.lit(name).alias("rule_name"),
                    required[sequence].alias("required"),
                    required[max(sequence - 1, 0)].alias("required_before"),
                )
            )
    passes, passed_before = _has_all(F.col("step.required")), _has_all(F.col("step.required_before"))
    return (
        counts.select("*", F.explode(F.array(*steps)).alias("step"))
        .where(F.col("step.definition") == F.col("cohort_definition_id"))
        .groupBy(
            "cohort_definition_id",
            F.col("step.rule_sequence").alias("rule_sequence"),
            F.col("step.rule_name").alias("rule_name"),
        )
        .agg(
            F.sum(F.when(passes, F.col("person_count")).otherwise(0)).alias("person_count"),
            F.sum(F.when(passed_before & ~passes, F.col("person_count")).otherwise(0)).alias("drop_count"),
        )
    )


def rule_gain(evaluated: DataFrame, specs: Sequence[CohortSpec]) -> DataFrame:
    """Per rule: entries that fulfil it, entries that only this rule keeps out, and all entries of the definition."""
    rules = []
    for spec in specs:
        size = len(spec.rules)
        for number, rule in enumerate(spec.rules):
            own = [int(place == number) for place in range(size)]
            rules.append(
                F.struct(
                    F.lit(spec.cohort_definition_id).alias("definition"),
                    F.lit(number + 1).alias("rule_sequence"),
                    F.lit(rule.name).alias("rule_name"),
                    _long_array(_words(own)).alias("own"),
                    _long_array(_words([1 - bit for bit in own])).alias("others"),
                )
            )
    n = F.col("person_count")
    counts = inclusion_counts(evaluated).select("*", F.explode(F.array(*rules)).alias("rule"))
    return (
        counts.where(F.col("rule.definition") == F.col("cohort_definition_id"))
        .groupBy("cohort_definition_id", F.col("rule.rule_sequence").alias("rule_sequence"), F.col("rule.rule_name").alias("rule_name"))
        .agg(
            F.sum(F.when(_has_all(F.col("rule.own")), n).otherwise(0)).alias("person_count"),
            F.sum(F.when(F.col("inclusion_words") == F.col("rule.others"), n).otherwise(0)).alias("gain_count"),
            F.sum(n).alias("person_total"),
        )
    )


def summary_counts(evaluated: DataFrame, specs: Sequence[CohortSpec]) -> DataFrame:
    """Per definition: entries, and entries that pass every rule."""
    full = _by_definition(specs, lambda spec: _long_array(_full(spec)))
    return inclusion_counts(evaluated).groupBy("cohort_definition_id").agg(
        F.sum("person_count").alias("base_count"),
        F.sum(F.when(F.col("inclusion_words") == full, F.col("person_count")).otherwise(0)).alias("final_count"),
    )


def cohort_results(days: DataFrame, observation: DataFrame, specs: Sequence[CohortSpec]) -> dict[str, DataFrame]:
    """The cohort rows of all definitions and every statistics table, by table name.

    Statistics count persons: of a person's entries the best one. All tables read the
    same written entries.
    """
    evaluated = stored_entries(days, observation, specs)
    exits = cohort_exits(evaluated, specs)
    persons = best_events(evaluated) if any(spec.entries == "all" for spec in specs) else evaluated
    return {
        "cohort": cohort_rows(exits, specs),
        "cohort_attrition": attrition(persons, specs),
        "cohort_censoring": exit_counts(exits),
        "cohort_inclusion": inclusion_counts(persons),
        "cohort_rule_gain": rule_gain(persons, specs),
        "cohort_summary": summary_counts(persons, specs),
    }


OPEN_END = "9999-12-31"


def collapse_eras(cohort: DataFrame, gap_days: int = 0) -> DataFrame:
    """Merge a person's overlapping cohort rows (or rows at most ``gap_days`` apart).

    A null end is later than any date: an open row takes in all later ones and its
    era stays open. Rows are first reduced to one per person and start day, which
    bounds what one person brings into the window by the calendar.
    """
    latest = F.lit(OPEN_END).cast("date")
    per_day = cohort.groupBy("cohort_definition_id", "subject_id", "cohort_start_date").agg(
        F.max(F.coalesce("cohort_end_date", latest)).alias("cohort_end_date")
    )
    in_order = W.partitionBy("cohort_definition_id", "subject_id").orderBy("cohort_start_date")
    reached = F.max("cohort_end_date").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    joins_era = (reached == latest) | (F.col("cohort_start_date") <= F.date_add(reached, gap_days))
    ends = F.max("cohort_end_date")
    return (
        per_day.withColumn("starts_era", F.when(joins_era, 0).otherwise(1))
        .withColumn("era", F.sum("starts_era").over(in_order))
        .groupBy("cohort_definition_id", "subject_id", "era")
        .agg(
            F.min("cohort_start_date").alias("cohort_start_date"),
            F.when(ends < latest, ends).alias("cohort_end_date"),
        )
        .drop("era")
    )
