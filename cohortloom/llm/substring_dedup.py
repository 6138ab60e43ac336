"""Removal of repeated substrings: bytes by suffix arrays, words by counted window hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .pieces import Shape, mixed
from .repeats import Method, covered, sources, with_repeats

_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
BYTE_GRAM, WORD_GRAM = 32, 5


def byte_values(text: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(text, dtype=np.uint8)]


def word_values(text: bytes) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(word) for word in text.split()], dtype=np.uint64)


def _with_ids(frame: DataFrame) -> DataFrame:
    lowest = F.lit(-(1 << 63)).cast("long")
    return frame.withColumn("doc_id", F.when(F.col("doc_id") != lowest, F.col("doc_id")))


def remove_repeated_bytes(docs: DataFrame, window: int = 100, gram: int = BYTE_GRAM, hot_key: int = 50_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) for every row of (doc_id, text).

    Removed is each byte that a string of ``window`` bytes covers which also starts
    earlier: in a smaller doc_id, or earlier in the document. Strings do not cross
    documents and are judged on the input. A null text counts as empty and a null
    id as the smallest. Rows that repeat an id are one document for the order;
    where their texts differ and a string starts at the same place in both, the
    texts' hashes decide; where they do not, the rows get the same result and are
    no repeats of each other. Texts under ``window`` bytes lose nothing; an empty
    table gives an empty result; other columns are not read.
    """
    method = Method(Shape(window, gram), byte_values, True, hot_key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, (doc, tie, text) in enumerate(zip(*(batch[n].to_pylist() for n in ("doc", "tie", "text")))):
                gone = covered(batch["runs"][number], tie, window, len(text))
                kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rows.append((doc, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    cut_rows = with_repeats(sources(docs), method).mapInArrow(
        cut,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
    )
    return _with_ids(cut_rows)


def remove_repeated_words(docs: DataFrame, window: int = 20, gram: int = WORD_GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept, spans for every row of (doc_id, text).

    Removed is each word that a run of ``window`` words covers which also starts
    earlier, as for bytes above; ``kept`` joins the other words by one space,
    ``spans`` are the maximal intervals that were removed (first word, words). Null
    and short texts, null and repeated ids, empty tables and other columns are
    treated as by ``remove_repeated_bytes``.
    """
    method = Method(Shape(window, gram), word_values, False)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, (doc, tie, text) in enumerate(zip(*(batch[n].to_pylist() for n in ("doc", "tie", "text")))):
                words = text.split()
                gone = covered(batch["runs"][number], tie, window, len(words))
                kept = b" ".join([word for word, g in zip(words, gone.tolist()) if not g])
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans = [{"first": int(a), "words": int(b - a)} for a, b in zip(edges[::2], edges[1::2])]
                rows.append((doc, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"), spans))
            span = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), span]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"]
    cut_rows = with_repeats(sources(docs), method).mapInArrow(
        cut,
        "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<first: long, words: long>>",
    )
    return _with_ids(cut_rows)
