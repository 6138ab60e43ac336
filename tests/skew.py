"""Copy of the small tables in which one person and one concept hold a third of all rows each."""

import shutil
from pathlib import Path

import duckdb

SOURCE = Path("/root/testdata/sf0.001")
HOT_PERSON = 14


def write_skewed_tables(folder):
    folder = Path(folder)
    for path in SOURCE.glob("*.parquet"):
        if path.stem not in ("orders", "lineitem"):
            shutil.copyfile(path, folder / path.name)
    connection = duckdb.connect()
    connection.execute(
        f"""COPY (SELECT * REPLACE (CAST(CASE WHEN o_orderkey % 3 = 0 THEN {HOT_PERSON} ELSE o_custkey END AS BIGINT)
                                    AS o_custkey) FROM '{SOURCE}/orders.parquet')
            TO '{folder}/orders.parquet' (FORMAT parquet)"""
    )
    # the hot concept is an ART one and most of the hot person's lines fall into two months,
    # so that one treatment window holds a large part of all rows
    connection.execute(
        f"""COPY (SELECT * REPLACE (CAST(CASE WHEN hash(l_orderkey, l_linenumber) % 3 = 0
                      THEN (SELECT min(p_partkey) FROM '{SOURCE}/part.parquet' WHERE p_size BETWEEN 13 AND 20)
                      ELSE l_partkey END AS BIGINT) AS l_partkey,
                      CASE WHEN l_orderkey % 3 = 0 AND hash(l_linenumber, l_orderkey) % 5 > 0
                      THEN TIMESTAMP '1996-02-01' + to_days(CAST(hash(l_orderkey) % 60 AS INTEGER))
                      ELSE l_shipdate END AS l_shipdate) FROM '{SOURCE}/lineitem.parquet')
            TO '{folder}/lineitem.parquet' (FORMAT parquet)"""
    )
    return str(folder)
