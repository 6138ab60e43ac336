"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken ``target / source size`` times. The
whole part of that is certain; the fraction is rounded. Two documents with
open fractions meet, one passes words of expected mass to the other until one
of them is whole, and the direction is drawn so that every document's expected
copies stay what they were. A source's words therefore change by nothing in a
meeting, and only the last open document of a source moves its total.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scan import PART, ranged, running_sums
from ..session import materialize
from .common import WORD

CAP = 3.0
FAN_IN = 64
LEAF_ROWS = 20_000
_EDGE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """source, source_size, target: one row per source.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the words
    of all sources; a source stops at ``cap`` times its size and the rest goes
    to the others by weight. Filled from the source that stops first: the level
    ``words left / weight left`` rises from one that stops to the next and falls from
    the first that does not, whose level is therefore the largest of those.
    Sources may be as many as hosts: their numbers and the sums before each come from ranges of
    the order (``running_sums``), so no task holds all of them.
    """
    by_name = ranged(sizes.withColumn("at", F.struct(F.col("source").isNull(), "source")), "at", label="sources")
    number = running_sums(by_name, (), "at", {"number": F.lit(1)}).drop("at", PART)
    weighted = number.withColumn("weight", (F.col("number") - 1) % 3 + 1)
    stop = F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    by_stop = ranged(weighted.withColumn("at", stop), "at", label="stops")
    total, weights = by_stop.agg(F.sum("source_size"), F.sum("weight")).first()
    # both sums hold the source itself
    up_to = running_sums(by_stop, (), "at", {"sizes": F.col("source_size"), "weights": F.col("weight")})
    left = F.lit(total) - cap * (F.col("sizes") - F.col("source_size"))
    level = left / (F.lit(weights) - (F.col("weights") - F.col("weight")))
    stops = up_to.withColumn("level", level).withColumn("stops", F.col("level") * F.col("weight") >= cap * F.col("source_size"))
    open_level = stops.agg(F.max(F.when(~F.col("stops"), F.col("level")))).first()[0]
    target = F.when(F.col("stops"), cap * F.col("source_size")).otherwise(F.lit(open_level) * F.col("weight"))
    return stops.select("source", "source_size", target.cast("double").alias("target"))


def _draw(seed: int, *keys: object) -> float:
    """A number in [0, 1) that depends on its arguments only, so reruns and retries agree."""
    digest = hashlib.blake2b(repr((seed, *keys)).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little") / 2.0**64


def pivot(items: Iterable[tuple], seed: int) -> Iterator[tuple]:
    """(key, size, fraction) in; (key, fraction) out, all whole but at most one.

    ``size * fraction`` summed over the items stays the same; the open one comes last.
    """
    holder = None
    for key, size, fraction in items:
        if fraction <= _EDGE or fraction >= 1 - _EDGE:
            yield key, float(round(fraction))
            continue
        if holder is None:
            holder = (key, size, fraction)
            continue
        other, other_size, other_fraction = holder
        # words that can go from the holder to the newcomer, and the other way
        up = min(other_size * other_fraction, size * (1 - fraction))
        down = min(other_size * (1 - other_fraction), size * fraction)
        moved = up if _draw(seed, other, key) * (up + down) < down else -down
        fraction, other_fraction = fraction + moved / size, other_fraction - moved / other_size
        open_items = []
        for name, words, share in ((other, other_size, other_fraction), (key, size, fraction)):
            if share <= _EDGE or share >= 1 - _EDGE:
                yield name, float(round(share))
            else:
                open_items.append((name, words, share))
        holder = open_items[0] if open_items else None
    if holder is not None:
        yield holder[0], holder[2]


def _pivot_groups(items: DataFrame, seed: int) -> DataFrame:
    """Run ``pivot`` over each (source, node), in the order of tie and id."""
    names = ("source", "node", "doc_id", "tie", "size", "fraction")

    def rounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*(batch[name].to_pylist() for name in names)))
        for _, members in groupby(stream, key=lambda row: row[:2]):
            done = pivot(((row[2:4], row[4], row[5]) for row in members), seed)
            while part := list(islice(done, 10_000)):
                keys, fractions = zip(*part)
                ids, ties = zip(*keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(ties, pa.int64()), pa.array(fractions, pa.float64())],
                    ["doc_id", "tie", "rounded"],
                )

    spread = items.select(*names).repartition("source", "node").sortWithinPartitions("source", "node", "tie", "doc_id")
    return spread.mapInArrow(rounds, "doc_id long, tie long, rounded double")


def _same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["tie"] == right["tie"])


def rounded_copies(items: DataFrame, seed: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """doc_id, tie, copies for items (doc_id, tie, source, size, ratio), one row per (doc_id, tie).

    The tree: leaves of about ``leaf_rows`` rows per source, numbered by a hash, so
    a hot source has many leaves; what a leaf leaves open (one row at most) meets
    that of ``FAN_IN`` others a level up, until one row per source is left.
    ``items`` is read several times: materialise it first.
    """
    base = F.floor(F.col("ratio") + _EDGE)
    fraction = F.when(F.col("size") > 0, F.greatest(F.col("ratio") - base, F.lit(0.0))).otherwise(0.0)
    whole = items.select("doc_id", "tie", "source", "size", base.alias("base"), fraction.alias("fraction"))
    nodes = max(1, -(-items.count() // leaf_rows))
    level = whole.where("fraction > 0").withColumn("node", F.pmod(F.xxhash64("tie", F.lit(seed)), F.lit(nodes)))
    is_open = (F.col("rounded") > 0) & (F.col("rounded") < 1)
    settled = []
    while True:
        done = materialize(_pivot_groups(level, seed), "pivot")
        if nodes == 1:
            settled.append(done)
            break
        settled.append(done.where(~is_open))
        nodes = -(-nodes // FAN_IN)
        left = done.where(is_open)
        level = level.drop("fraction").join(left, _same_document(level, left)).select(
            level["doc_id"], level["tie"], "source", "size", F.floor(F.col("node") / FAN_IN).alias("node"),
            F.col("rounded").alias("fraction"),
        )
    # a source's last open row goes up with exactly its fraction as probability
    luck = F.pmod(F.xxhash64(F.lit("last"), F.lit(seed), "tie"), F.lit(1 << 53)) / float(1 << 53)
    final = reduce(DataFrame.unionByName, settled).select(
        "doc_id", "tie", F.when(luck < F.col("rounded"), 1).otherwise(0).alias("up")
    )
    copies = (F.col("base") + F.coalesce("up", F.lit(0))).cast("long").alias("copies")
    return whole.join(final, _same_document(whole, final), "left").select(whole["doc_id"], whole["tie"], copies)


def _tie() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def _planned(docs: DataFrame, seed: int, cap: float, leaf_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their size and target, and the copies of each (doc_id, tie)."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _tie().alias("tie"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
    )
    sized = materialize(sized, "sizes")
    targets = materialize(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cap), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = sized.join(targets.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    items = aimed.groupBy("doc_id", "tie", "source").agg(F.sum("size").alias("size"), F.first(ratio).alias("ratio"))
    return aimed, rounded_copies(materialize(items, "items"), seed, leaf_rows)


def mix_sources(docs: DataFrame, seed: int = 7, cap: float = CAP, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of (doc_id, text, source).

    ``size`` counts words (a null or empty text has none and is not taken), ``taken``
    is ``copies * size``. Rows that repeat id, source and text are one document that
    occurs several times: they get the same copies and weigh in together. A null
    source is a source of its own. No document is taken more than ``cap`` times,
    rounded up; texts of any length are counted whole; an empty table gives an empty result; other columns are not read.
    """
    aimed, copies = _planned(docs, seed, cap, leaf_rows)
    return aimed.join(copies, _same_document(aimed, copies)).select(
        aimed["doc_id"], "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def take_mix(docs: DataFrame, seed: int = 7, cap: float = CAP, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with its own columns.

    Null and empty texts have no words and are not taken; null ids and sources, repeated rows and texts of
    any length are treated as by ``mix_sources``; an empty table stays empty. A row's columns
    travel as one struct, so their names cannot clash.
    """
    _, copies = _planned(docs, seed, cap, leaf_rows)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _tie().alias("tie"))
    taken = rows.join(copies.where("copies > 0"), _same_document(rows, copies))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
