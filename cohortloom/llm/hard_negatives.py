"""Hard-negative mining with rotated one-bit codes and deterministic score intervals.

Vectors become integers, are rotated at random and stored as one-bit codes: the
signs of the rotated vector, then the signs of what that code leaves, rotated again,
and so on. With each code goes its alignment, the exact inner product of code and vector.
An anchor is rotated likewise and cut into bit planes, so its inner product with
a code is a few popcounts. The alignments turn these into an estimate of the score,
and the Cauchy-Schwarz inequality bounds what the codes leave out: every score lies
in a known interval. Rows whose interval cannot reach an anchor's result are dropped,
the others are scored in integers, so the result is exact.

Anchors and rows are dealt in blocks, every block of anchors meets every block of
rows, and each meeting returns a few rows per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
LONG = np.iinfo(np.int64)


@dataclass(frozen=True)
class Settings:
    """levels: one-bit codes per vector. planes: bits per component of an anchor. row_block, anchor_block:
    rows to a block. The result does not depend on any of them."""

    levels: int = 8
    planes: int = 8
    row_block: int = 4096
    anchor_block: int = 1024
    seed: int = 5


@dataclass(frozen=True)
class Wanted:
    """positives and negatives per anchor and positive; a negative's score lies between these percentages of the positive's."""

    positives: int = 5
    negatives: int = 3
    least_percent: int = 50
    most_percent: int = 95


def padded(vectors: np.ndarray) -> np.ndarray:
    """Rows with zeros behind, up to a power of two, 64 at least."""
    size = max(64, 1 << max(0, vectors.shape[1] - 1).bit_length())
    out = np.zeros((len(vectors), size))
    out[:, : vectors.shape[1]] = vectors
    return out


def rotated(vectors: np.ndarray, seed: int) -> np.ndarray:
    """Padded rows turned by a random orthogonal map: signs and Hadamard steps, twice."""
    out, size = vectors.copy(), vectors.shape[1]
    draw = np.random.default_rng(seed)
    for _ in range(2):
        out *= draw.integers(0, 2, size) * 2 - 1
        step = 1
        while step < size:
            pairs = out.reshape(len(out), -1, 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), size)
            step *= 2
        out /= np.sqrt(size)
    return out


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    return np.ascontiguousarray(np.packbits(flags, axis=-1, bitorder="little")).view("<u8")


@dataclass
class Codes:
    """Per row: one-bit codes (row, level, word), their ones, their alignments, and the norms of the row and of what the codes leave."""

    words: np.ndarray
    ones: np.ndarray
    alignment: np.ndarray
    norm: np.ndarray
    rest: np.ndarray

    def take(self, rows: np.ndarray) -> "Codes":
        return Codes(self.words[rows], self.ones[rows], self.alignment[rows], self.norm[rows], self.rest[rows])


def encoded(vectors: np.ndarray, levels: int, seed: int) -> Codes:
    """The first code is the signs of the rotated row, each further one those of what is left, rotated again."""
    left = padded(vectors)
    norm, scale = np.sqrt((left**2).sum(axis=1)), 1 / np.sqrt(left.shape[1])
    words, alignment = [], []
    for level in range(levels):
        left = rotated(left, seed + level)
        flags = left >= 0
        code = np.where(flags, scale, -scale)
        aligned = (left * code).sum(axis=1)
        left = left - aligned[:, None] * code
        words.append(_bits(flags))
        alignment.append(aligned)
    words = np.stack(words, axis=1)
    ones = np.bitwise_count(words).sum(axis=2, dtype=np.int64)
    return Codes(words, ones, np.stack(alignment, axis=1), norm, np.sqrt((left**2).sum(axis=1)))


@dataclass
class Planes:
    """Per anchor and level, turned as far as that level's codes: bit planes (anchor, level, plane, word) of its
    components ``low + step * number``, the sum of the numbers, and the norm of what they leave."""

    words: np.ndarray
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray
    rest: np.ndarray
    norm: np.ndarray
    size: int

    def take(self, rows: np.ndarray) -> "Planes":
        return Planes(*(getattr(self, n)[rows] for n in ("words", "low", "step", "total", "rest", "norm")), self.size)


def cut(vectors: np.ndarray, levels: int, planes: int, seed: int) -> Planes:
    turned = padded(vectors)
    norm = np.sqrt((turned**2).sum(axis=1))
    parts = []
    for level in range(levels):
        turned = rotated(turned, seed + level)
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / ((1 << planes) - 1), 1e-300)
        number = np.rint((turned - low[:, None]) / step[:, None])
        left = turned - (low[:, None] + step[:, None] * number)
        whole = number.astype(np.int64)
        words = np.stack([_bits((whole >> plane & 1).astype(bool)) for plane in range(planes)], axis=1)
        parts.append((words, low, step, number.sum(axis=1), np.sqrt((left**2).sum(axis=1))))
    return Planes(*(np.stack(part, axis=1) for part in zip(*parts)), norm, turned.shape[1])


def intervals(anchors: Planes, rows: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) possible score of every anchor with every row."""
    shape = (len(anchors.norm), len(rows.norm))
    estimate = np.zeros(shape)
    levels, planes, words = anchors.words.shape[1:]
    for level in range(levels):
        counted = np.zeros(shape, dtype=np.int32)
        for plane in range(planes):
            for word in range(words):
                shared = anchors.words[:, level, plane, word][:, None] & rows.words[:, level, word]
                counted += np.bitwise_count(shared).astype(np.int32) << plane
        signs = anchors.low[:, level][:, None] * (2 * rows.ones[:, level] - anchors.size)
        product = signs + anchors.step[:, level][:, None] * (2.0 * counted - anchors.total[:, level][:, None])
        estimate += rows.alignment[:, level] * (product / np.sqrt(anchors.size))
    # Cauchy-Schwarz: what the codes leave of the row with the whole anchor, what the planes leave of the anchor with every code
    reach = anchors.norm[:, None] * rows.rest + anchors.rest @ np.abs(rows.alignment).T
    reach = reach * (1 + 1e-9) + 1e-9 * anchors.norm[:, None] * rows.norm + 1e-6
    # scores beyond a long are its ends, and ties there
    return tuple(np.clip(end, -(2.0**63), 2.0**63) for end in (estimate - reach, estimate + reach))


def integer_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products row by row; beyond a long they count as its ends."""
    if not len(left):
        return np.zeros(0, dtype=np.int64)
    most = (float(np.abs(left.astype(float)).max()) + 1) * (float(np.abs(right.astype(float)).max()) + 1) * left.shape[1]
    if most < 2.0**62:
        return np.einsum("ij,ij->i", left, right)
    exact = (left.astype(object) * right.astype(object)).sum(axis=1)
    return np.array([min(max(int(value), LONG.min), LONG.max) for value in exact], dtype=np.int64)


def _scored(pairs: tuple[np.ndarray, np.ndarray], anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    a, r = pairs
    found = [integer_scores(anchors[a[at : at + 65536]], rows[r[at : at + 65536]]) for at in range(0, len(a), 65536)]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def _best(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's ``k`` highest scores, ties by the smaller id. Equal places keep their order."""
    order = np.lexsort((ident, ~score, group))
    ranked = group[order]
    return order[np.arange(len(order)) - np.searchsorted(ranked, ranked) < k]


def _kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """Per row; minus infinity where fewer are finite."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


@dataclass
class Block:
    """Rows of one table as arrays, sorted by label."""

    ident: np.ndarray
    label: np.ndarray
    vectors: np.ndarray

    def take(self, rows: np.ndarray) -> "Block":
        return Block(self.ident[rows], self.label[rows], self.vectors[rows])


SLICE = 32  # anchors looked at together: a block of rows then takes a few megabytes


def positives_of(anchors: Block, planes: Planes, rows: Block, codes: Codes, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, row, score): the ``k`` best rows of the anchor's label with another id."""
    found = [(np.zeros(0, dtype=np.int64),) * 3]
    for label in np.unique(anchors.label):
        asking, offered = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label == label)
        for at in range(0, len(asking) if len(offered) else 0, SLICE):
            some = asking[at : at + SLICE]
            low, high = intervals(planes.take(some), codes.take(offered))
            other = anchors.ident[some][:, None] != rows.ident[offered]
            bound = _kth_largest(np.where(other & ~np.isnan(low), low, -np.inf), k)
            a, r = np.nonzero(other & ~(high < bound[:, None]))
            a, r = some[a], offered[r]
            score = _scored((a, r), anchors.vectors, rows.vectors)
            best = _best(a, score, rows.ident[r], k)
            found.append((a[best], r[best], score[best]))
    return tuple(np.concatenate(part) for part in zip(*found))


def negatives_of(
    anchors: Block, planes: Planes, bounds: list[list[tuple[int, int]]], rows: Block, codes: Codes, k: int
) -> tuple[np.ndarray, ...]:
    """(anchor, bound, row, score): the ``k`` best rows of other labels with a score in each of an anchor's bounds."""
    found = [(np.zeros(0, dtype=np.int64),) * 4]
    slots = max(map(len, bounds), default=0)
    # an empty range holds no score
    ranges = np.array([[*pairs, *[(1, 0)] * (slots - len(pairs))] for pairs in bounds], dtype=np.int64).reshape(len(bounds), slots, 2)
    for at in range(0, len(anchors.ident), SLICE):
        some = np.arange(at, min(at + SLICE, len(anchors.ident)))
        low, high = intervals(planes.take(some), codes)
        other = anchors.label[some][:, None] != rows.label
        candidate = np.zeros(low.shape, dtype=bool)
        for slot in range(slots):
            least, most = (ranges[some, slot, n].astype(float)[:, None] for n in (0, 1))
            least, most = least - np.abs(least) * 1e-12, most + np.abs(most) * 1e-12  # a long may be no double
            sure = other & (low >= least) & (high <= most)
            bound = _kth_largest(np.where(sure, low, -np.inf), k)[:, None]
            candidate |= other & ~(high < np.maximum(bound, least)) & ~(low > most) & (least <= most)
        a, r = np.nonzero(candidate)
        a = some[a]
        score = _scored((a, r), anchors.vectors, rows.vectors)
        for slot in range(slots):
            inside = np.flatnonzero((score >= ranges[a, slot, 0]) & (score <= ranges[a, slot, 1]))
            best = inside[_best(a[inside], score[inside], rows.ident[r[inside]], k)]
            found.append((a[best], np.full(len(best), slot), r[best], score[best]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _packed(vectors: np.ndarray) -> list[bytes]:
    """Each row in the least of 2, 4 or 8 bytes a component that holds it."""
    most = np.maximum(vectors.max(axis=1, initial=0), -(vectors.min(axis=1, initial=0) + 1))
    out: list[bytes] = [b""] * len(vectors)
    for width, fits in ((2, most < 1 << 15), (4, (most >= 1 << 15) & (most < 1 << 31)), (8, most >= 1 << 31)):
        rows = np.flatnonzero(fits)
        data, size = vectors[rows].astype(f"<i{width}").tobytes(), width * vectors.shape[1]
        for n, row in enumerate(rows.tolist()):
            out[row] = data[n * size : (n + 1) * size]
    return out


def _unpacked(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = column.to_pylist()
    if not dim or not values:
        return np.zeros((len(values), max(dim, 1)), dtype=np.int64)
    width = np.array([len(value) // dim for value in values])
    out = np.empty((len(values), dim), dtype=np.int64)
    for size in (2, 4, 8):
        rows = np.flatnonzero(width == size)
        if len(rows):
            out[rows] = np.frombuffer(b"".join([values[n] for n in rows.tolist()]), f"<i{size}").reshape(len(rows), dim)
    return out


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column | None = None, wanted: Wanted = Wanted(), scale: float = 256.0,
    settings: Settings = Settings(), key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become ``floor(scale * x)``; a score is the integer inner product with
    the anchor (rows that fit ``anchor``). An anchor's positives are its first rows of
    the same label, and for each of them the first rows of other labels whose score lies
    in its range are returned, higher scores and then smaller ids first.

    Rows with a null key, label or vector, or a null or non-finite component take no
    part. A shorter vector counts as ending in zeros. Rows of the anchor's own id are
    none of its partners; rows that repeat an id are partners of their own, equal anchors
    are one, and anchors of one id that differ in label or vector each get their rows.
    Components and scores beyond a long count as its ends. An empty table, or one
    without anchors, gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    double = F.col(vector).cast("array<double>")
    finite = F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    source = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(key).cast("long").alias("id"),
        (F.col("label") if label is None else label).cast("string").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
        F.transform(double, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("vec"),
    ).where("label IS NOT NULL")
    rows, asking, dim = source.agg(F.count("id"), F.count_if("is_anchor"), F.max(F.size("vec"))).first()
    if not rows or not asking:
        return spark.createDataFrame([], RESULT)

    levels, seed = settings.levels, settings.seed
    floats = levels + 2

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their codes, and a seat: a number by which they are dealt, whatever they hold."""
        seat = TaskContext.get().partitionId() << 40
        for batch in batches:
            lists = batch["vec"]
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            whole = np.zeros((len(lists), max(dim, 1)), dtype=np.int64)
            whole[np.arange(whole.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            codes = encoded(whole.astype(float), levels, seed)
            words = [row.tobytes() for row in codes.words]
            numbers = np.concatenate([codes.alignment, codes.norm[:, None], codes.rest[:, None]], axis=1).astype("<f8")
            seats = np.arange(seat, seat + len(lists))
            seat += len(lists)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["label"], batch["is_anchor"], pa.array(_packed(whole), pa.binary()), pa.array(words, pa.binary()),
                 pa.array([row.tobytes() for row in numbers], pa.binary()), pa.array(seats)],
                ["id", "label", "is_anchor", "vec", "codes", "numbers", "seat"],
            )

    coded = materialize(source.mapInArrow(encode, "id long, label string, is_anchor boolean, vec binary, codes binary, numbers binary, seat long"), "codes")
    tie = F.xxhash64("label", "vec").alias("tie")
    anchors = materialize(coded.where("is_anchor").select("id", tie, "label", "vec").distinct(), "anchors")
    row_blocks, anchor_blocks = -(-rows // settings.row_block), -(-asking // settings.anchor_block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt_rows = coded.select(
        F.pmod(F.xxhash64("seat"), F.lit(row_blocks)).cast("int").alias("p"), every(anchor_blocks).alias("q"), "id", "label", "vec", "codes", "numbers"
    )

    def dealt(asked: DataFrame) -> DataFrame:
        own = F.pmod(F.xxhash64("tie", "id"), F.lit(anchor_blocks)).cast("int").alias("q")
        return asked.select(every(row_blocks).alias("p"), own, *asked.columns)

    def block(table: pa.Table) -> Block:
        return Block(table["id"].to_numpy(), np.array(table["label"].to_pylist(), dtype=object), _unpacked(table["vec"], dim))

    def opened(asked: pa.Table, listed: pa.Table) -> tuple[Block, Planes, Block, Codes]:
        """Both blocks, labels as numbers that both share."""
        questions, offers = block(asked), block(listed)
        _, numbers = np.unique(np.concatenate([questions.label, offers.label]).astype(str), return_inverse=True)
        questions.label, offers.label = numbers[: len(questions.label)], numbers[len(questions.label) :]
        words = np.frombuffer(b"".join(listed["codes"].to_pylist()), "<u8").reshape(len(offers.ident), levels, -1)
        held = np.frombuffer(b"".join(listed["numbers"].to_pylist()), "<f8").reshape(len(offers.ident), floats)
        ones = np.bitwise_count(words).sum(axis=2, dtype=np.int64)
        codes = Codes(words, ones, held[:, :levels], held[:, levels], held[:, levels + 1])
        return questions, cut(questions.vectors.astype(float), levels, settings.planes, seed), offers, codes

    def meet_positives(asked: pa.Table, listed: pa.Table) -> pa.Table:
        names = ("id", "tie", "positive_id", "positive_score")
        if not asked.num_rows or not listed.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names)
        with np.errstate(all="ignore"):
            questions, planes, offers, codes = opened(asked, listed)
            a, r, score = positives_of(questions, planes, offers, codes, wanted.positives)
        return pa.table([questions.ident[a], asked["tie"].to_numpy()[a], offers.ident[r], score], names)

    def meet_negatives(asked: pa.Table, listed: pa.Table) -> pa.Table:
        names = ("id", "tie", "slot", "negative_id", "negative_score")
        if not asked.num_rows or not listed.num_rows:
            return pa.table([pa.array([], pa.int64())] * 5, names)
        bounds = [
            [(-(-wanted.least_percent * score // 100), wanted.most_percent * score // 100) for score in scores]
            for scores in asked["scores"].to_pylist()
        ]
        with np.errstate(all="ignore"):
            questions, planes, offers, codes = opened(asked, listed)
            a, slot, r, score = negatives_of(questions, planes, bounds, offers, codes, wanted.negatives)
        return pa.table([questions.ident[a], asked["tie"].to_numpy()[a], slot, offers.ident[r], score], names)

    met = dealt(anchors).groupBy("p", "q").cogroup(dealt_rows.groupBy("p", "q")).applyInArrow(
        meet_positives, "id long, tie long, positive_id long, positive_score long"
    )
    by_score = W.partitionBy("id", "tie").orderBy(F.desc("positive_score"), "positive_id")
    first = met.withColumn("slot", (F.row_number().over(by_score) - 1).cast("long")).where(F.col("slot") < wanted.positives)
    first = materialize(first, "positives")
    listed = first.groupBy("id", "tie").agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("found"))
    asked = anchors.join(listed.select("id", "tie", F.col("found.positive_score").alias("scores")), ["id", "tie"])
    met = dealt(asked).groupBy("p", "q").cogroup(dealt_rows.groupBy("p", "q")).applyInArrow(
        meet_negatives, "id long, tie long, slot long, negative_id long, negative_score long"
    )
    by_score = W.partitionBy("id", "tie", "slot").orderBy(F.desc("negative_score"), "negative_id")
    best = met.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= wanted.negatives)
    return best.join(first, ["id", "tie", "slot"]).select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
