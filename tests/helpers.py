"""Small frames for unit tests."""

from datetime import date, timedelta

PERSON = 1


def day(text):
    return date.fromisoformat(text)


def plus(start, days):
    return start + timedelta(days=days)


def events(spark, rows):
    """rows: (person_id, date, concept_id, concept_set)"""
    return spark.createDataFrame(rows, "person_id long, date date, concept_id long, concept_set string")


def cohort(spark, rows):
    """rows: (subject_id, start, end)"""
    return spark.createDataFrame(rows, "subject_id long, cohort_start_date date, cohort_end_date date")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())
