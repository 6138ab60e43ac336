"""Small document tables, and the cases every operator has to survive."""

from pathlib import Path

import pyarrow.parquet as pq

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "thirty words that make a passage long enough to be found again in another document of the very same small table where it " * 3

ODD_TEXTS = (None, "", " ", "\n\n \t", "a", "A b", "a B", "x y z w", "é" * 40, "a" * 3000, "ab " * 900, LONG, LONG + "end", "日本 " * 50, "\x00 \x1c b")


def documents():
    table = pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()
    return [tuple(row[name] for name in ("doc_id", "text", "lang", "source", "n_chars")) for row in table]


def odd_documents():
    """Null in every column, empty and long texts, repeated ids and rows."""
    rows = [(1000 + n, text, None if n % 3 else "en", None if n % 2 else "s", None) for n, text in enumerate(ODD_TEXTS)]
    rows += [(None, "no id but words", "en", "s", 1), (None, LONG + " second", None, None, None)]
    rows += [(2000, LONG + " twice", "en", "t", 5)] * 2 + [(2001, "one id", "en", "t", 5), (2001, "two texts", "en", "t", 5)]
    return rows


def frame(spark, rows, clash=False):
    """``clash`` adds columns whose names the operators use inside."""
    made = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clash:
        from pyspark.sql import functions as F

        names = ("key", "pos", "doc", "tie", "fp", "size", "copies", "kind", "list", "root", "words", "route", "target")
        made = made.withColumns({name: F.lit("x") for name in names})
    return made


def rows_of(df, *names):
    none_first = lambda row: tuple((v is not None, v if not isinstance(v, dict) else str(v)) for v in row)
    picked = df.select(*names) if names else df
    return sorted((tuple(r) for r in picked.collect()), key=none_first)


def table_path(name):
    return str(Path(SF_DIR) / f"{name}.parquet")
