"""Repeated windows of all documents: the flow that substring dedup by suffix arrays and by word windows share.

1. Each task cuts its texts into pieces (see ``pieces``). Pieces of one content
   inside a group of texts are one row from here on, so a hot passage costs each
   group one row; so does each anchor, for the question whether it occurs twice.
2. Pieces whose anchor occurs once in the corpus hold no repeat and go.
3. Of pieces of one content the earliest is the *first*; the others are repeats
   as a whole.
4. Firsts that share an anchor with other firsts are *contested*: their windows
   are compared one by one, by suffix arrays or by counted window hashes.
5. The repeats of a document are gathered and cut out of its text.

A window's place is (doc, pos): the document's id, and one long of the start,
20 bits of the text's hash (which keep rows of one id but different texts
apart) and the number of windows less one. Places order as their windows do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import materialize
from .common import utf8
from .pieces import Hashes, Pieces, Shape, find_pieces
from .suffix_array import permuted_common_prefixes, suffix_array

TIE_BITS, COUNT_BITS = 20, 7
OPEN, KNOWN, REPEAT, MARK = 0, 1, 2, 3
GROUP_ELEMENTS = 2 << 20
BLOCK_BYTES = 2 << 20
PLACE = "doc long, pos long"


@dataclass(frozen=True)
class Method:
    """How texts become elements and how contested pieces are settled.

    ``values`` turns a text into one 64-bit value per element. ``by_suffixes``
    settles by suffix arrays of the pieces' bytes (elements must be bytes then);
    otherwise, and for anchors with more than ``hot_key`` contested pieces, the
    windows' hashes are counted.
    """

    shape: Shape
    values: Callable[[bytes], np.ndarray]
    by_suffixes: bool
    hot_key: int = 50_000

    def __post_init__(self):
        if self.shape.spread > 1 << COUNT_BITS:
            raise ValueError(f"a window has at most {1 << COUNT_BITS} grams: take a longer gram")


def _pos(start: np.ndarray, tie: np.ndarray | int, count: np.ndarray | int) -> np.ndarray:
    return (start.astype(np.int64) << (TIE_BITS + COUNT_BITS)) | (np.asarray(tie, dtype=np.int64) << COUNT_BITS) | (np.asarray(count) - 1)


def _start(pos: np.ndarray) -> np.ndarray:
    return pos >> (TIE_BITS + COUNT_BITS)


def _tie(pos: np.ndarray) -> np.ndarray:
    return (pos >> COUNT_BITS) & ((1 << TIE_BITS) - 1)


def _count(pos: np.ndarray) -> np.ndarray:
    return (pos & ((1 << COUNT_BITS) - 1)) + 1


def sources(docs: DataFrame) -> DataFrame:
    """doc (a null id as the least long), tie, text (bytes)."""
    lowest = F.lit(-(1 << 63)).cast("long")
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), lowest).alias("doc"),
        F.xxhash64("text").bitwiseAND(F.lit((1 << TIE_BITS) - 1)).cast("int").alias("tie"),
        utf8().alias("text"),
    )


def _gathered(doc: np.ndarray, pos: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, ...]:
    """kind, key, content, doc, pos of a group of texts, equal pieces as one, and a mark for each anchor known to repeat."""
    order = np.lexsort((pos, doc, pieces.content, pieces.key))
    key, content, doc, pos = (x[order] for x in (pieces.key, pieces.content, doc, pos))
    new_key = np.append(True, key[1:] != key[:-1])
    new_piece = new_key | np.append(True, content[1:] != content[:-1])
    key_number = np.cumsum(new_key) - 1
    repeats = np.bincount(key_number) > 1
    kind = np.where(new_piece, np.where(repeats[key_number], KNOWN, OPEN), REPEAT)
    # rows that repeat id and text have the same places: those are no repeats of themselves
    first = np.maximum.accumulate(np.where(new_piece, np.arange(len(pos)), 0))
    fresh = (kind != REPEAT) | (doc != doc[first]) | (pos != pos[first])
    marks = np.flatnonzero(new_key & repeats[key_number])
    columns = (kind, key.view(np.int64), content.view(np.int64), doc, pos)
    with_marks = (np.full(len(marks), MARK), *(c[marks] for c in columns[1:]))
    return tuple(np.concatenate([c[fresh], m]) for c, m in zip(columns, with_marks))


def _pieces_of(batches: Iterator[pa.RecordBatch], method: Method) -> Iterator[pa.RecordBatch]:
    """Texts in groups of about ``GROUP_ELEMENTS``; a longer text in parts that overlap by a window."""
    shape, group, size = method.shape, [], 0

    def flush() -> pa.RecordBatch:
        lengths = np.array([len(values) for *_, values in group])
        pieces = find_pieces(Hashes(np.concatenate([values for *_, values in group])), lengths, shape)
        begins = np.cumsum(lengths) - lengths
        owner = np.searchsorted(begins, pieces.start, side="right") - 1
        doc, tie, offset = (np.array([row[n] for row in group], dtype=np.int64)[owner] for n in range(3))
        pos = _pos(pieces.start - begins[owner] + offset, tie, pieces.count)
        arrays = _gathered(doc, pos, pieces) if len(pos) else (np.zeros(0, dtype=np.int64),) * 5
        kinds = [pa.int8(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, kinds)], ["kind", "key", "content", "doc", "pos"])

    for batch in batches:
        for doc, tie, text in zip(batch["doc"].to_pylist(), batch["tie"].to_pylist(), batch["text"].to_pylist()):
            values = method.values(text)
            for offset in range(0, len(values) - shape.window + 1, GROUP_ELEMENTS):
                part = values[offset : offset + GROUP_ELEMENTS + shape.window - 1]
                group.append((doc, tie, offset, part))
                size += len(part)
                if size >= GROUP_ELEMENTS:
                    yield flush()
                    group, size = [], 0
    if group:
        yield flush()


def _contested_of(batches: Iterator[pa.RecordBatch], method: Method) -> Iterator[pa.RecordBatch]:
    """For contested pieces their bytes, or the hashes of their windows."""
    shape = method.shape
    names = ["key", "doc", "pos", "data"]

    def rows(key, doc, pos, data) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(doc, pa.int64()), pa.array(pos, pa.int64()), pa.array(data, pa.binary())], names)

    for batch in batches:
        columns = [batch[name].to_pylist() for name in ("doc", "tie", "text")]
        asked = batch["asked"]
        for number, (doc, tie, text) in enumerate(zip(*columns)):
            entries = asked[number].values
            key, pos, hot = (entries.field(n).to_numpy(zero_copy_only=False) for n in ("key", "pos", "hot"))
            own = _tie(pos) == tie
            key, pos, hot = key[own], pos[own], hot[own].astype(bool) | (not method.by_suffixes)
            if (~hot).any():
                ends = _start(pos) + _count(pos) + shape.window - 1
                data = [text[a:b] for a, b in zip(_start(pos)[~hot].tolist(), ends[~hot].tolist())]
                yield rows(key[~hot], np.full(len(data), doc), pos[~hot], data)
            if hot.any():
                counts = _count(pos[hot])
                first = np.cumsum(counts) - counts
                start = np.repeat(_start(pos[hot]) - first, counts) + np.arange(counts.sum())
                hashes = Hashes(method.values(text)).of(start, start + shape.window)
                yield rows(hashes.view(np.int64), np.full(len(start), doc), _pos(start, tie, 1), [None] * len(start))


def repeats_in_block(data: list[bytes], doc: np.ndarray, pos: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, pos) of runs of windows that start earlier in another or the same piece, by one suffix array of all pieces."""
    sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data)) + 1
    text = np.frombuffer(b"\xff".join(data) + b"\xff", dtype=np.uint8)
    begins = np.cumsum(sizes) - sizes
    order = suffix_array(text)
    shared = permuted_common_prefixes(text, order, begins, int(sizes.max()))
    group = np.empty(len(text), dtype=np.int64)
    group[order] = np.cumsum(shared[order] < window)
    counts = _count(pos)
    first = np.cumsum(counts) - counts
    piece = np.repeat(np.arange(len(data)), counts)
    step = np.arange(counts.sum()) - first[piece]
    place, start = begins[piece] + step, _start(pos)[piece] + step
    ranked = np.lexsort((_tie(pos)[piece], start, doc[piece], group[place]))
    leads = np.append(True, np.diff(group[place][ranked]) > 0)
    lead = ranked[np.maximum.accumulate(np.where(leads, np.arange(len(ranked)), 0))]
    # the same place twice (a row that repeats id and text) is no repeat
    repeat = np.zeros(len(ranked), dtype=bool)
    repeat[ranked] = (doc[piece][ranked] != doc[piece][lead]) | (start[ranked] != start[lead]) | (_tie(pos)[piece][ranked] != _tie(pos)[piece][lead])
    opens = repeat & np.append(True, ~repeat[:-1] | (piece[1:] != piece[:-1]))
    closes = repeat & np.append(~repeat[1:] | (piece[1:] != piece[:-1]), True)
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    return doc[piece[a]], _pos(start[a], _tie(pos)[piece[a]], b - a + 1)


def _settled(batches: Iterator[pa.RecordBatch], method: Method) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and place. Blocks end where a key ends, so equal windows are in one block."""
    names = ["doc", "pos"]
    held: list[pa.RecordBatch] = []
    last_key, lead = None, None

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        doc, pos = (table[n].to_numpy() for n in names)
        found = repeats_in_block(table["data"].to_pylist(), doc, pos, method.shape.window)
        return pa.RecordBatch.from_arrays([*map(pa.array, found)], names)

    size = 0
    for batch in batches:
        counted = batch.filter(pc.is_null(batch["data"]))
        if counted.num_rows:  # hashes of windows: the first of a hash is the earliest
            key, doc, pos = (counted[n].to_numpy() for n in ("key", "doc", "pos"))
            new = np.append(lead is None or key[0] != lead[0], key[1:] != key[:-1])
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            first_doc = np.where(at >= 0, doc[at], lead[1] if lead else 0)
            first_pos = np.where(at >= 0, pos[at], lead[2] if lead else 0)
            later = (doc != first_doc) | (pos != first_pos)
            lead = (key[-1], first_doc[-1], first_pos[-1])
            yield pa.RecordBatch.from_arrays([pa.array(doc[later]), pa.array(pos[later])], names)
        pieces = batch.filter(pc.is_valid(batch["data"]))
        if pieces.num_rows:
            key = pieces["key"].to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if held and size >= BLOCK_BYTES and key[a] != last_key:
                    yield block(held)
                    held, size = [], 0
                part = pieces.slice(a, b - a)
                held.append(part)
                size += part["data"].nbytes
                last_key = key[a]
    if held:
        yield block(held)


def repeated_windows(source: DataFrame, method: Method) -> DataFrame:
    """doc, pos of runs of windows whose content also starts earlier in ``source`` (see ``sources``)."""
    def gather(batches):
        return _pieces_of(batches, method)

    def fetch(batches):
        return _contested_of(batches, method)

    def settle(batches):
        return _settled(batches, method)

    found = source.mapInArrow(gather, f"kind byte, key long, content long, {PLACE}")
    # single pieces and marks of an anchor meet; rows that need no meeting are spread by their place
    route = F.when(F.col("kind").isin(OPEN, MARK), F.lit(0)).otherwise(F.xxhash64("doc", "pos"))
    times = F.count("*").over(W.partitionBy("key", "route"))
    met = found.withColumn("route", route).withColumn("times", times)
    alive = met.where((F.col("kind") != MARK) & ((F.col("kind") != OPEN) | (F.col("times") > 1)))
    alive = materialize(alive.select("kind", "key", "content", "doc", "pos"), "alive")

    place = F.struct("doc", "pos")
    first = F.min(place).over(W.partitionBy("key", "content"))
    ranked = alive.where(F.col("kind") != REPEAT).withColumn("is_first", place == first)
    ranked = materialize(ranked.select("key", "content", "doc", "pos", "is_first"), "ranked")
    firsts = ranked.where("is_first")
    keys = firsts.groupBy("key").agg(F.min("content").alias("least"), F.max("content").alias("most"), F.count("*").alias("n"))
    contested = keys.where("least != most").select("key", (F.col("n") > method.hot_key).alias("hot"))
    asked = of_texts(firsts.join(contested, "key"), F.struct("key", "pos", "hot"), "asked")

    data = source.join(asked, ["doc", "tie"]).mapInArrow(fetch, f"key long, {PLACE}, data binary")
    kinds = F.col("data").isNull()
    dealt = data.repartition("key", kinds).sortWithinPartitions(kinds, "key", "doc", "pos")
    settled = dealt.mapInArrow(settle, PLACE)
    whole = alive.where(F.col("kind") == REPEAT).select("doc", "pos").unionByName(ranked.where("NOT is_first").select("doc", "pos"))
    return whole.unionByName(settled)


def of_texts(places: DataFrame, value: Column, name: str) -> DataFrame:
    """doc, tie and the list of a text's values: texts that share an id (or have none) get lists of their own."""
    tie = F.shiftright("pos", COUNT_BITS).bitwiseAND(F.lit((1 << TIE_BITS) - 1)).cast("int")
    return places.groupBy("doc", tie.alias("tie")).agg(F.collect_list(value).alias(name))


def with_repeats(source: DataFrame, method: Method) -> DataFrame:
    """``source`` with ``runs``: the places of a document's repeated windows (those of other texts of its id too)."""
    runs = of_texts(materialize(repeated_windows(source, method), "repeats"), F.col("pos"), "runs")
    return source.join(runs, ["doc", "tie"], "left")


def covered(runs: pa.ListScalar, tie: int, window: int, size: int) -> np.ndarray:
    """Boolean mask of a document's elements that its repeated windows cover."""
    change = np.zeros(size + 1, dtype=np.int64)
    if runs.is_valid:
        pos = runs.values.to_numpy()
        pos = pos[_tie(pos) == tie]
        np.add.at(change, _start(pos), 1)
        np.add.at(change, _start(pos) + _count(pos) + window - 1, -1)
    return np.cumsum(change)[:size] > 0
