"""Static schemas of the stored tables."""

from pyspark.sql import types as T


def _fields(*specs):
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in specs])


COHORT = _fields(
    ("cohort_definition_id", T.IntegerType(), False),
    ("subject_id", T.LongType(), False),
    ("cohort_start_date", T.DateType(), False),
    ("cohort_end_date", T.DateType(), True),
)

COHORT_ATTRITION = _fields(
    ("cohort_definition_id", T.IntegerType(), False),
    ("rule_sequence", T.IntegerType(), False),
    ("rule_name", T.StringType(), False),
    ("person_count", T.LongType(), False),
    ("drop_count", T.LongType(), False),
)

COHORT_INCLUSION = _fields(
    ("cohort_definition_id", T.IntegerType(), False),
    ("inclusion_mask", T.LongType(), False),
    ("inclusion_words", T.ArrayType(T.LongType()), False),
    ("person_count", T.LongType(), False),
)

COHORT_CENSORING = _fields(
    ("cohort_definition_id", T.IntegerType(), False),
    ("exit_reason", T.StringType(), False),
    ("entry_count", T.LongType(), False),
    ("person_count", T.LongType(), False),
)

# What the stored rows of a definition were made of
COHORT_MANIFEST = _fields(
    ("cohort_definition_id", T.IntegerType(), False),
    ("checksum", T.StringType(), False),
    ("row_count", T.LongType(), False),
    ("row_hash", T.LongType(), False),
)

COHORT_RULE_GAIN = _fields(
    ("cohort_definition_id", T.IntegerType(), False),
    ("rule_sequence", T.IntegerType(), False),
    ("rule_name", T.StringType(), False),
    ("person_count", T.LongType(), False),
    ("gain_count", T.LongType(), False),
    ("person_total", T.LongType(), False),
)

COHORT_SUMMARY = _fields(
    ("cohort_definition_id", T.IntegerType(), False),
    ("base_count", T.LongType(), False),
    ("final_count", T.LongType(), False),
)

EVENTS = _fields(
    ("person_id", T.LongType(), False),
    ("date", T.DateType(), False),
    ("concept_id", T.LongType(), True),
)

EVENTS_LONG = T.StructType(
    EVENTS.fields + [T.StructField("concept_set", T.StringType(), False)]
)

STORED_EVENTS = T.StructType(EVENTS.fields + [T.StructField("month", T.DateType(), False)])
