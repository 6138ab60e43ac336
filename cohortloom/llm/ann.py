"""Approximate nearest neighbours by balanced posting lists.

Largest inner product becomes least Euclidean distance by one more coordinate,
``sqrt(M^2 - |x|^2)`` with the largest norm M. A bounded sample is halved again
and again at the median between two means, so all lists are of one size; the
means of the parts are the centroids, which are sent to the tasks (``MAX_LISTS``
bounds them). Every vector is indexed in the list of its nearest centroid and,
near a border, in further ones. A query reads all lists whose centroids are at
most a ratio farther than its nearest, however many these are, and scores are
exact inner products of the original vectors.

Both ratios are read off the sample: the border's from the copies that are to be
kept on average, the queries' from where the neighbours of some of the sample's
vectors, found by brute force in it, are listed. Neighbours in all rows are closer
than those in a sample, so the ratio errs to reading more.

Equal vectors are one entry of the index, with the least ``k + 1`` of their
ids: no more can be among ``k`` neighbours. An entry is kept once, with the numbers
of its lists, in the section of its nearest one: a section is a run of lists, which
lie side by side in the order of the halving. A query is sent once, with its
greatest distance, to each section that may hold an entry of a list it reads, and
reads the lists there: neither vectors nor rows are made for each list. Where the
lists that are read hold an entry several times over, all of the section are scored
instead. Queries go round by round, as many at a time as a section has entries, so
what is shuffled at a time is some times the entries, whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize

SAMPLE_ROWS = 1 << 16  # the index is fitted on at most about so many vectors,
SAMPLE_VALUES = 1 << 22  # and so many components
MAX_LISTS = 1 << 14  # centroids that are sent to the tasks, within SAMPLE_VALUES components as well
LIVE_DISTANCES = 1 << 22  # distances or scores a task holds at a time: 16 to 32 MB
SECTION_VALUES = 1 << 22  # components of a section's entries on average, at most
SECTION_ROWS = 2048  # and entries at least, where a few queries would allow for more sections
MAX_SECTIONS = 1024  # unless SECTION_VALUES asks for more


@dataclass(frozen=True)
class Settings:
    """list_rows: vectors to a list before borders are replicated. copies: lists that hold a vector, on average.
    sought: share of the sample queries' neighbours that must lie in the lists read. section_values: components
    of the entries that one task holds, on average."""

    list_rows: int = 256
    copies: float = 3.0
    sought: float = 0.95
    seed: int = 11
    section_values: int = SECTION_VALUES


SAMPLE_QUERIES = 400


class CentroidGraph:
    """Centroids, and the distances of points to all of them: one product of matrices, where a best-first
    search over neighbouring centroids looked at all distances again in every step. So degree and beam,
    the search's, no longer matter."""

    def __init__(self, centroids: np.ndarray, degree: int = 0, beam: int = 0):
        self.centroids = np.asarray(centroids, dtype=float)
        self.square = (self.centroids**2).sum(axis=1)
        self.slack = 1e-6 * max(1.0, float(np.sqrt(self.square.max())))  # far above the rounding of a distance

    def every_distance(self, points: np.ndarray, only: np.ndarray | slice = slice(None)) -> np.ndarray:
        points = np.asarray(points, dtype=float)
        far = points @ self.centroids[only].T
        far *= -2
        far += self.square[only]
        far += (points**2).sum(axis=1)[:, None]
        return np.sqrt(np.maximum(far, 0, out=far), out=far)

    def steps(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(start, distances) of so many points at a time as LIVE_DISTANCES allows."""
        step = max(1, LIVE_DISTANCES // len(self.centroids))
        for start in range(0, len(points), step):
            yield start, self.every_distance(points[start : start + step])

    def limits(self, far: np.ndarray, ratio: float) -> np.ndarray:
        return (1 + ratio) * far.min(axis=1) + self.slack

    def near_limits(self, far: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Of n lists of a point the nearest are the square root of n: the distance of the last of these."""
        count = np.maximum((far <= limit[:, None]).sum(axis=1), 1)
        last = np.ceil(np.sqrt(count)).astype(np.int64) - 1
        return np.sort(far, axis=1)[np.arange(len(far)), last] + self.slack

    def lists(self, points: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, whether it is among the nearest): all lists that are at most ``1 + ratio`` times as far as the nearest, which comes first."""
        found: list[list[np.ndarray]] = [[], [], []]
        for start, far in self.steps(points):
            limit = self.limits(far, ratio)
            row, at = np.divmod(np.flatnonzero(far <= limit[:, None]), far.shape[1])
            order = np.lexsort((far[row, at], row))
            row, at = row[order], at[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            near = place < np.ceil(np.sqrt(np.bincount(row, minlength=len(far))))[row]
            for part, values in zip(found, (row + start, at, near)):
                part.append(values)
        return tuple(np.concatenate(part) if part else np.zeros(0, dtype=np.int64) for part in found)


def border_ratio(graph: CentroidGraph, points: np.ndarray, copies: float) -> float:
    """How much farther than its nearest a list may be to hold a vector, for ``copies`` lists on average."""
    far = graph.every_distance(points)
    farther = np.sort((far / np.maximum(far.min(axis=1, keepdims=True), 1e-9)).ravel())
    return float(farther[min(len(farther), max(1, int(copies * len(points)))) - 1] - 1)


def search_ratio(graph: CentroidGraph, sample: np.ndarray, largest: float, border: float, k: int, sought: float, seed: int) -> float:
    """How much farther a list may be to be read, so that the lists hold ``sought`` of the sample queries' ``k`` neighbours."""
    rng = np.random.default_rng(seed)
    usable = np.flatnonzero((sample**2).sum(axis=1) > 0)
    chosen = rng.choice(usable, min(SAMPLE_QUERIES, len(usable)), replace=False)
    take = min(k, len(sample) - 1)
    if take < 1:
        return 0.0
    near = []
    for at in chosen:  # one at a time: the driver holds one row of scores
        score = sample @ sample[at]
        score[at] = -np.inf
        near.append(np.argpartition(-score, take - 1)[:take])
    asked = graph.every_distance(_lengthened(sample[chosen], largest))
    farther = asked / np.maximum(asked.min(axis=1, keepdims=True), 1e-9)
    needed = []
    for row in range(len(chosen)):
        held = graph.every_distance(_augmented(sample[near[row]], largest))
        listed = held <= (1 + border) * held.min(axis=1, keepdims=True) + 1e-6
        needed.append(np.where(listed, farther[row], np.inf).min(axis=1))
    return float(np.quantile(np.concatenate(needed), sought) - 1)


def balanced_centroids(sample: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Halve the sample at the median between two means until there are ``lists`` parts; their means."""
    rng = np.random.default_rng(seed)
    parts = [(sample, lists)]
    centroids = []
    while parts:
        points, share = parts.pop()
        if share <= 1 or len(points) < 2:
            centroids.append(points.mean(axis=0))
            continue
        ends = points[rng.choice(len(points), 2, replace=False)]
        left = share // 2
        cut = max(1, min(len(points) - 1, round(len(points) * left / share)))
        for _ in range(6):
            lean = points @ (ends[1] - ends[0])
            order = np.argsort(lean, kind="stable")
            ends = np.stack([points[order[:cut]].mean(axis=0), points[order[cut:]].mean(axis=0)])
        parts.append((points[order[cut:]], share - left))
        parts.append((points[order[:cut]], left))
    return np.array(centroids)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1)


def _augmented(vectors: np.ndarray, largest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(largest**2 - (vectors**2).sum(axis=1), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def _lengthened(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Queries at the largest norm: only their direction matters for the order of inner products."""
    norm = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    return np.concatenate([vectors * (largest / norm), np.zeros((len(vectors), 1))], axis=1)


class Block:
    """Entries of a section and what its queries find among them.

    Products of single-precision unit vectors rule out what is more than their rounding below the last of the
    ``take`` best, or below a score that is known to be reached; the rest is scored in doubles.
    """

    def __init__(self, entries: pa.Table, graph: CentroidGraph, largest: float, take: int):
        self.points, self.first = _matrix(entries["vec"].combine_chunks()), entries["first"].to_numpy()
        self.graph, self.largest, self.take = graph, largest, take
        self.scaled = (self.points / largest).astype(np.float32)
        self.rounding = (self.points.shape[1] + 8) * 2.0**-22
        lists = entries["lists"].combine_chunks()
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        values = lists.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(values, kind="stable")
        self.present, self.start = np.unique(values[order], return_index=True)
        self.members, self.count = owner[order], np.diff(self.start, append=len(order))

    def found(self, asks: np.ndarray, limit: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of a query, entry, score) of the best in the lists within the queries' limits that reach their bounds, queries in order."""
        step = max(1, LIVE_DISTANCES // len(self.present))
        for start in range(0, len(asks), step):
            some = slice(start, start + step)
            row, at, score = self._found(asks[some], limit[some], bound[some])
            yield row + start, at, score

    def _found(self, asks: np.ndarray, limit: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        reads = self.graph.every_distance(_lengthened(asks, self.largest), self.present) <= limit[:, None]
        norm = np.sqrt((asks**2).sum(axis=1))
        unit = (asks / norm[:, None]).astype(np.float32)
        scale = norm * self.largest
        low = bound / scale - self.rounding
        if (reads.sum(axis=0) * self.count).sum() >= len(asks) * len(self.points):
            pairs = iter([(np.flatnonzero(reads.any(axis=1)), np.arange(len(self.points)))])
        else:
            read = np.flatnonzero(reads.any(axis=0))
            pairs = ((np.flatnonzero(reads[:, n]), self.members[self.start[n] : self.start[n] + self.count[n]]) for n in read)
        best: tuple[np.ndarray, ...] = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        codes: list[np.ndarray] = []
        waiting = 0

        def settle() -> None:
            """Score what waits and keep the best of every query, of equal ones the smaller ids."""
            nonlocal best, waiting
            row, at = np.divmod(np.unique(np.concatenate([best[0] * len(self.points) + best[1], *codes])), len(self.points))
            score = np.empty(len(row))
            slices = max(1, LIVE_DISTANCES // asks.shape[1])
            for start in range(0, len(row), slices):
                some = slice(start, start + slices)
                score[some] = np.einsum("ij,ij->i", asks[row[some]], self.points[at[some]])
            order = np.lexsort((self.first[at], -score, row))
            row, at, score = row[order], at[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            last = place == self.take - 1
            low[row[last]] = np.maximum(low[row[last]], score[last] / scale[row[last]] - self.rounding)
            keep = place < self.take
            best = (row[keep], at[keep], score[keep])
            codes.clear()
            waiting = 0

        for rows, entries in pairs:
            width = max(1, LIVE_DISTANCES // max(1, len(rows)))
            for start in range(0, len(entries), width):
                some = entries[start : start + width]
                part = unit[rows] @ self.scaled[some].T
                least = low[rows]
                blind = np.flatnonzero(np.isinf(least))
                if len(blind):
                    last = max(0, len(some) - self.take)
                    least[blind] = np.partition(part[blind], last, axis=1)[:, last] - 2 * self.rounding
                    if len(some) >= self.take:
                        low[rows[blind]] = least[blind]
                row, at = np.divmod(np.flatnonzero(part >= least.astype(np.float32)[:, None]), len(some))
                codes.append(rows[row] * len(self.points) + some[at])
                waiting += len(row)
                if waiting >= LIVE_DISTANCES // 4:
                    settle()
        settle()
        return best


def nearest_neighbours(
    vectors: DataFrame, query: Column, k: int = 20, settings: Settings = Settings(), key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for every row that fits ``query``.

    Candidates are all rows but those of the query's own id. Vectors that are null,
    zero, hold a null or non-finite component or have another length than most
    take no part; neither do null ids. Rows that repeat id and vector are one; an id with several vectors
    is searched with each, and none of them is its neighbour. Ties go to the
    smaller id. An empty table gives an empty result; other columns are not read.
    """
    single = vectors.select(F.col(vector).alias("v")).dtypes[0][1] == "array<float>"  # half the bytes, with the same values
    kind = "array<float>" if single else "array<double>"
    rows = vectors.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("vec"), query.alias("is_query")
    ).where(_usable(F.col("vec")))
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = lengths[0]["n"] if lengths else 0
    rows = rows.where(F.size("vec") == dim)
    ranked = rows.withColumn("at", F.dense_rank().over(W.partitionBy("vec").orderBy("id"))).where(F.col("at") <= k + 1)
    entries = ranked.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    asked = rows.where("is_query").select("id", "vec").distinct()
    # an entry is named by its hash and its first id
    name = (F.xxhash64("vec").alias("h"), F.col("ids")[0].alias("first"))
    entries = materialize(entries.select(*name, "vec", "ids"), "entries")
    queries = materialize(
        asked.select("id", F.xxhash64("vec").alias("h"), "vec").join(entries.select("h", "first", F.col("vec").alias("same")), "h")
        .where(F.col("vec") == F.col("same")).select("id", "h", "first", "vec"), "queries",
    )

    count, largest = entries.agg(F.count("h"), F.max(F.sqrt(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not count:
        return vectors.sparkSession.createDataFrame([], schema)
    most = max(1, SAMPLE_VALUES // dim)
    share = min(1.0, min(SAMPLE_ROWS, most) / count)
    chosen = F.pmod(F.xxhash64("vec", F.lit(settings.seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    taken = entries.where(chosen).select("vec").orderBy("vec").toArrow()["vec"].combine_chunks()
    sample = _matrix(taken) if len(taken) else np.array([entries.select("vec").first()["vec"]], dtype=float)
    lists = max(1, min(MAX_LISTS, most, count // settings.list_rows, len(sample)))
    graph = CentroidGraph(balanced_centroids(_augmented(sample, largest), lists, settings.seed))
    border = border_ratio(graph, _augmented(sample[: 4 * SAMPLE_QUERIES], largest), settings.copies)
    ratio = search_ratio(graph, sample, largest, border, k, settings.sought, settings.seed)
    shared = vectors.sparkSession.sparkContext.broadcast(graph)

    # sections: so few that sending the queries to all of them takes no more than the entries, so many that a task can hold one
    rows_held = max(1, settings.section_values // dim)
    asked_for = queries.select("h", "first", "vec").distinct()
    asking = asked_for.count()
    sections = max(-(-count // rows_held), min(count // max(1, asking), -(-count // SECTION_ROWS), MAX_SECTIONS))
    sections = max(1, min(lists, sections))
    section_of = np.arange(lists) * sections // lists
    begin = np.searchsorted(section_of, np.arange(sections))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, _ = shared.value.lists(_augmented(_matrix(batch["vec"]), largest), border)
            ends = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))
            home = pa.array(section_of[at[ends[:-1]]].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, home, listed], [*batch.schema.names, "section", "lists"])

    held = f"h long, first long, vec {kind}"
    postings = materialize(
        entries.select("h", "first", "vec").mapInArrow(place, f"{held}, section int, lists array<int>"), "postings"
    )
    sizes = postings.groupBy("section").agg(F.ceil(F.count("h") / (2 * rows_held)).cast("int").alias("blocks"))
    blocks = materialize(sizes, "blocks")
    # whether entries of a section are in lists of another one
    beside = np.zeros((sections, sections), dtype=np.float32)
    listed = postings.select("section", F.explode("lists").alias("list")).select(
        "section", F.floor(F.col("list") * F.lit(sections) / F.lit(lists)).cast("int").alias("of")
    ).distinct().toArrow()
    beside[listed["of"].to_numpy(), listed["section"].to_numpy()] = 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, far in shared.value.steps(_lengthened(_matrix(batch["vec"]), largest)):
                limit = shared.value.limits(far, ratio)
                near = shared.value.near_limits(far, limit)
                columns = []
                for bound, joined in ((near, None), (limit, beside)):
                    met = np.logical_or.reduceat(far <= bound[:, None], begin, axis=1)
                    met = met if joined is None else met.astype(np.float32) @ joined > 0
                    row, at = np.nonzero(met)
                    ends = np.searchsorted(row, np.arange(len(far) + 1)).astype(np.int32)
                    columns += [pa.array(bound), pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32)))]
                part = batch.slice(start, len(far))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*batch.schema.names, "near", "near_sections", "limit", "sections"])

    reading = "near double, near_sections array<int>, limit double, sections array<int>"
    probes = materialize(asked_for.mapInArrow(ask, f"{held}, {reading}"), "probes")

    # a section of more entries than usual is parted, and its queries go to every part
    p_own = F.pmod(F.xxhash64("h", "first"), F.col("blocks")).cast("int").alias("p")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p")

    def met(listed: Column, probing: DataFrame, found, schema: str) -> DataFrame:
        """What ``found`` gives for the entries of a section, in the lists that count, and its queries."""
        left = postings.join(blocks, "section").select("section", p_own, "h", "first", "vec", listed.alias("lists"))
        right = probing.join(blocks, "section").select("section", every, "h", "first", "vec", "limit", "bound")
        return left.groupBy("section", "p").cogroup(right.groupBy("section", "p")).applyInArrow(found, schema)

    def searched(listed: pa.Table, probing: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        asks = _matrix(probing["vec"].combine_chunks())
        block = Block(listed, shared.value, largest, k + 1)
        return block.found(asks, probing["limit"].to_numpy(), probing["bound"].to_numpy())

    def best_scores(listed: pa.Table, probing: pa.Table) -> pa.Table:
        """One row for each query: its best scores."""
        row, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        if listed.num_rows and probing.num_rows:
            parts = [(row, score) for row, _, score in searched(listed, probing)]
            row, scores = (np.concatenate(x) for x in zip(*parts))
        some, starts = np.unique(row, return_index=True)
        ends = np.append(starts, len(row)).astype(np.int32)
        ids = [pa.array(probing[name].to_numpy()[some], pa.int64()) for name in ("h", "first")]
        return pa.table([*ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(scores, pa.float64()))], ("qh", "qfirst", "scores"))

    def best_entries(listed: pa.Table, probing: pa.Table) -> pa.Table:
        names = ("qh", "qfirst", "h", "first", "score")
        if not listed.num_rows or not probing.num_rows:
            return pa.table([pa.array([], t) for t in [pa.int64()] * 4 + [pa.float64()]], names)
        row, at, scores = (np.concatenate(x) for x in zip(*searched(listed, probing)))
        columns = [probing["h"].to_numpy()[row], probing["first"].to_numpy()[row], listed["h"].to_numpy()[at], listed["first"].to_numpy()[at]]
        return pa.table([*map(pa.array, columns), pa.array(scores)], names)

    def search(some: DataFrame) -> DataFrame:
        """The nearest lists first: in all lists only what reaches the last of the best found there is worth a row."""
        none, near = F.lit(float("-inf")).alias("bound"), F.col("near").alias("limit")
        to_near = some.select("h", "first", "vec", near, none, F.explode("near_sections").alias("section"))
        early = met(F.slice("lists", 1, 1), to_near, best_scores, "qh long, qfirst long, scores array<double>")
        best = F.sort_array(F.flatten(F.collect_list("scores")), asc=False)
        least = F.get(best, F.lit(k)).alias("least")
        bounds = materialize(
            early.groupBy("qh", "qfirst").agg(least).select("qh", "qfirst", (F.col("least") - F.abs("least") * 1e-9).alias("least")), "bounds"
        )
        known = some.join(bounds, (F.col("h") == F.col("qh")) & (F.col("first") == F.col("qfirst")), "left")
        bound = F.coalesce("least", F.lit(float("-inf"))).alias("bound")
        to_all = known.select("h", "first", "vec", "limit", bound, F.explode("sections").alias("section"))
        return met(F.col("lists"), to_all, best_entries, "qh long, qfirst long, h long, first long, score double")

    rounds = max(1, -(-asking // min(rows_held, count // sections)))
    if rounds == 1:
        nearest = search(probes)
    else:
        turn = F.pmod(F.xxhash64("first", "h"), F.lit(rounds))
        parts = [materialize(search(probes.where(turn == n)), "nearest") for n in range(rounds)]
        nearest = reduce(DataFrame.unionByName, parts)
    by_entry = W.partitionBy("qh", "qfirst").orderBy(F.desc("score"), "first", "h")
    nearest = nearest.withColumn("at", F.row_number().over(by_entry)).where(F.col("at") <= k + 1)
    named = nearest.join(entries.select("h", "first", "ids"), ["h", "first"]).select(
        "qh", "qfirst", "score", F.explode("ids").alias("vec_id")
    )
    by_id = W.partitionBy("qh", "qfirst").orderBy(F.desc("score"), "vec_id")
    best = named.withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= k + 1)
    top = best.groupBy("qh", "qfirst").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("top"))
    answered = queries.select("id", "h", "first").join(
        top, (F.col("h") == F.col("qh")) & (F.col("first") == F.col("qfirst"))
    )
    others = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return answered.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit")["vec_id"].alias("vec_id"), F.col("hit")["score"].alias("score")
    )
