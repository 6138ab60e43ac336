"""SimHash near-duplicates with deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits agree in one half or
differ by one bit in each. So two segments are enough, fewer than the three
that exact segments would need: fingerprints meet by equality on an exact
half, or on the first half with one bit deleted (32 variants, of which one side
of the join has the bit set and the other has not). Meetings are verified.

Rows are distinct fingerprints, so copies never multiply. Where very many of them
share one half, that half's pairs meet on finer keys instead: parts of the other
half join the key, which leaves at most 2^17 fingerprints to a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize
from .common import utf8
from .components import components

SEED = 42
HALF = 32
LOW = (1 << HALF) - 1
HOT_SEGMENT = 4096
_BLOCK = 1 << 17


def fingerprint(text: bytes, ngram: int = 3) -> int:
    """Unsigned 64-bit SimHash of the ``ngram``-word shingles of the lower-cased words."""
    words = text.lower().split()
    if not words:
        return 0
    ngram = min(ngram, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - ngram + 1].tolist()
    ends = ends[ngram - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _BLOCK):
        spans = zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * ones > len(starts)))


def fingerprints(docs: DataFrame, ngram: int = 3) -> DataFrame:
    """doc_id, tie, fp for every row of (doc_id, text): a hash of the text and the fingerprint as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text, ngram) for text in batch["text"].to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["tie"], pa.array(found.view(np.int64))], ["doc_id", "tie", "fp"]
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), utf8().alias("text"))
    return source.mapInArrow(hashed, "doc_id long, tie long, fp long")


def _segment(number: int) -> Column:
    return F.shiftrightunsigned("fp", HALF) if number == 0 else F.col("fp").bitwiseAND(F.lit(LOW))


def _exploded(rows: DataFrame, keys: list[Column]) -> DataFrame:
    return rows.select("fp", F.explode(F.array(*keys)).alias("key"))


def _met(left: DataFrame, right: DataFrame, ordered: bool) -> DataFrame:
    """Verified links (u, v) of rows that share a key."""
    a, b = left.select("key", F.col("fp").alias("u")), right.select("key", F.col("fp").alias("v"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2
    condition = near & (F.col("u") < F.col("v")) if ordered else near
    return a.join(b, "key").where(condition).select("u", "v")


def _without(value: Column, bit: int) -> Column:
    return value.bitwiseAND(F.lit(~(1 << bit)))


def _has_bit(value: Column, bit: int) -> Column:
    return F.shiftright(value, bit).bitwiseAND(F.lit(1)) == 1


def _variants(rows: DataFrame, bit_set: bool, finer: list[Column] | None = None) -> DataFrame:
    """Keys of the first half with one bit deleted, for the bits that are set (or not set).

    ``finer`` columns are part of the key by hash.
    """
    first = _segment(0)
    keys = []
    for bit in range(HALF):
        masked = F.lit(bit << HALF).bitwiseOR(_without(first, bit))
        side = _has_bit(first, bit) if bit_set else ~_has_bit(first, bit)
        keys += [F.when(side, masked if part is None else F.xxhash64(masked, part)) for part in (finer or [None])]
    return _exploded(rows, keys).where("key IS NOT NULL")


def _quarters(segment: Column) -> list[Column]:
    """The two 16-bit parts of a segment, told apart by the bits above."""
    upper, lower = F.shiftright(segment, 16), segment.bitwiseAND(F.lit(0xFFFF))
    return [upper, lower.bitwiseOR(F.lit(1 << 20))]


def links(nodes: DataFrame, hot_segment: int = HOT_SEGMENT) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that differ in one or two bits; all of them, some repeated.

    ``nodes`` is read several times: materialise it first. A half shared by more
    than ``hot_segment`` fingerprints is hot. Pairs of two hot ones meet on finer
    keys, by which no bucket exceeds 2^17 fingerprints; other pairs meet as usual.
    """
    found = []
    hot = []
    for number in (0, 1):
        other = _segment(1 - number)
        keyed = nodes.select("fp", _segment(number).alias("key"))
        crowded = materialize(keyed.groupBy("key").count().where(F.col("count") > hot_segment).select("key"), "hot")
        if crowded.isEmpty():
            found.append(_met(keyed, keyed, ordered=True))
            continue
        calm, busy = keyed.join(crowded, "key", "left_anti"), keyed.join(crowded, "key", "left_semi")
        found.append(_met(calm, calm, ordered=True))
        # both bits lie in the other half: one of its quarters differs by one bit at most
        keys = [
            F.xxhash64("key", F.lit(16 * n + bit), _without(part, bit))
            for n, part in enumerate(_quarters(other)) for bit in range(16)
        ]
        finer = busy.select("fp", F.explode(F.array(*keys)).alias("key"))
        found.append(_met(finer, finer, ordered=True))
        if number == 0:
            hot = [calm.select("fp"), busy.select("fp")]
    # one bit in each half
    calm, busy = hot or (nodes, None)
    found.append(_met(_variants(calm, False), _variants(calm, True), ordered=False))
    if busy is not None:
        found.append(_met(_variants(busy, False), _variants(calm, True), ordered=False))
        found.append(_met(_variants(calm, False), _variants(busy, True), ordered=False))
        parts = _quarters(_segment(1))
        found.append(_met(_variants(busy, False, parts), _variants(busy, True, parts), ordered=False))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def named_groups(nodes: DataFrame, found: DataFrame | None) -> DataFrame:
    """fp, root, component_id for every node (fp, first): its group by the links, and the group's least id."""
    if found is None:
        rooted = nodes.withColumn("root", F.col("fp"))
    else:
        roots = components(found).withColumnRenamed("u", "fp")
        rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return materialize(rooted.join(least, "root").select("fp", "root", "component_id"), "components")


def _grouped(docs: DataFrame, ngram: int, hot_segment: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their fingerprints, and for each distinct fingerprint its group (a fingerprint) and the group's least id."""
    prints = materialize(fingerprints(docs, ngram), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    return prints, named_groups(nodes, links(nodes.select("fp"), hot_segment))


def near_duplicates(docs: DataFrame, ngram: int = 3, hot_segment: int = HOT_SEGMENT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of (doc_id, text).

    ``component_id`` is the least doc_id that links reach, the row's own included.
    A null or empty text has no shingle and fingerprint zero, linked like any
    other; a text of fewer words than a shingle has one of all its words. Rows
    that repeat an id each get their row; a null id never becomes a component's
    id unless all its ids are null. An empty table gives an empty result; other
    columns are not read.
    """
    prints, named = _grouped(docs, ngram, hot_segment)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, ngram: int = 3, hot_segment: int = HOT_SEGMENT) -> DataFrame:
    """One row of each group of near-duplicates, with all columns of ``docs``: the least id's, then by a hash of the text.

    A null id only stays for a group without any other. Of rows that repeat id and text
    the least by all columns stays. Empty and null texts are one group; texts of any
    length count whole; an empty table gives an empty result; clashing names do no harm.
    """
    return keep_first(docs, *_grouped(docs, ngram, hot_segment))


def keep_first(docs: DataFrame, prints: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, by rows (doc_id, tie, fp) and groups (fp, root)."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("tie"))
    first = prints.join(named, "fp").groupBy("root").agg(F.min(order).alias("first"))
    kept = first.select(F.col("first")["doc_id"].alias("id"), F.col("first")["tie"].alias("tie"))
    # a document's columns travel as one struct, so no name of theirs can meet ours
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("tie"))
    same = rows["id"].eqNullSafe(kept["id"]) & (rows["tie"] == kept["tie"])
    whole = F.xxhash64(F.to_json("row", {"ignoreNullFields": "false"}))
    repeated = W.partitionBy(rows["id"], rows["tie"]).orderBy(whole)
    joined = rows.join(kept, same).withColumn("nth", F.row_number().over(repeated))
    return joined.where("nth = 1").select("row.*")
