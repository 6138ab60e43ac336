"""Token files: independent zstandard frames, a document index and a trailing seek table.

One file is

    frame*  |  skippable frame: document index  |  skippable frame: seek table

Frames hold token ids as little-endian unsigned integers of 2 or 4 bytes, one
document or a part of a long one each, with a content checksum of their own.
The seek table is the public seekable format (sizes and the low 32 bits of the
XXH64 of every frame), so common tools can open the file. The index gives for
every document its id, its tokens and its first frame: a reader fetches the
tail of a file and then the frames of the documents it wants.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tokenizers
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialize, new_path
from .bpe import ChunkEncoder

# ---- Fixed values of the seekable zstandard format
SKIPPABLE_INDEX, SKIPPABLE_SEEK_TABLE = 0x184D2A50, 0x184D2A5E
SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x8F92EAB1, 0x80
FOOTER = struct.Struct("<IBI")
SEEK_ENTRY = np.dtype([("stored", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
# ----
SKIPPABLE_HEAD = struct.Struct("<II")
INDEX_HEAD = struct.Struct("<4sBxxxQ")
INDEX_MARK = b"TOK1"
INDEX_ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("n_tokens", "<u8"), ("first_frame", "<u4")])
FRAME_TOKENS = 1 << 20
READ_BYTES = 8 << 20
LINES = 500
SHARD = "shard long, path string, n_docs long, n_tokens long, n_bytes long"


class TokenFileWriter:
    """Writes documents in the order they come; memory holds one frame and the index."""

    def __init__(self, sink, width: int = 4, level: int = 1, frame_tokens: int = FRAME_TOKENS):
        self.sink, self.width, self.frame_tokens = sink, width, frame_tokens
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.n_tokens = self.n_bytes = 0

    def _put(self, data: bytes, size: int, checksum: int) -> None:
        self.sink.write(data)
        self.n_bytes += len(data)
        self.frames.append((len(data), size, checksum))

    def add(self, doc_id: int | None, parts: Iterable[bytes]) -> None:
        """One document: its ids as little-endian unsigned 32-bit integers, in parts of any size."""
        first, count, held, size = len(self.frames), 0, [], 0
        for part in parts:
            held.append(part)
            size += len(part)
            count += len(part) // 4
            if size >= 4 * self.frame_tokens:
                ids = b"".join(held)
                whole = size - size % (4 * self.frame_tokens)
                for at in range(0, whole, 4 * self.frame_tokens):
                    self._frame(ids[at : at + 4 * self.frame_tokens])
                held, size = [ids[whole:]], size - whole
        if size or len(self.frames) == first:
            self._frame(b"".join(held))
        self.index.append((doc_id or 0, doc_id is not None, count, first))
        self.n_tokens += count

    def _frame(self, ids: bytes) -> None:
        data = ids if self.width == 4 else np.frombuffer(ids, "<u4").astype(f"<u{self.width}").tobytes()
        self._put(self.compressor.compress(data), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF)

    def close(self) -> None:
        index = INDEX_HEAD.pack(INDEX_MARK, self.width, len(self.index)) + np.array(self.index, INDEX_ENTRY).tobytes()
        self._put(SKIPPABLE_HEAD.pack(SKIPPABLE_INDEX, len(index)) + index, 0, 0)
        table = np.array(self.frames, SEEK_ENTRY).tobytes() + FOOTER.pack(len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        tail = SKIPPABLE_HEAD.pack(SKIPPABLE_SEEK_TABLE, len(table)) + table
        self.sink.write(tail)
        self.n_bytes += len(tail)


class TokenFileReader:
    """Opens the tail of a token file and decompresses only the frames that are asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        count, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("not a token file")
        table_bytes = count * SEEK_ENTRY.itemsize
        table = self._at(size - FOOTER.size - table_bytes, table_bytes)
        self.table = np.frombuffer(table, SEEK_ENTRY)
        stored = self.table["stored"].astype(np.int64)
        self.offset = np.cumsum(stored) - stored
        index = self._at(int(self.offset[-1]), int(stored[-1]))
        mark, self.width, docs = INDEX_HEAD.unpack_from(index, SKIPPABLE_HEAD.size)
        if mark != INDEX_MARK:
            raise ValueError("no document index")
        self.index = np.frombuffer(index, INDEX_ENTRY, docs, SKIPPABLE_HEAD.size + INDEX_HEAD.size)
        self.decompressor = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def __len__(self) -> int:
        return len(self.index)

    def doc_ids(self) -> list[int | None]:
        return [int(e["doc_id"]) if e["has_id"] else None for e in self.index]

    def _frames_of(self, place: int) -> range:
        last = int(self.index["first_frame"][place + 1]) if place + 1 < len(self.index) else len(self.table) - 1
        return range(int(self.index["first_frame"][place]), last)

    def read(self, places: Sequence[int]) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
        """(place, frames as arrays of ids) for documents by their places in the file, in ascending order.

        Neighbouring frames are fetched together, up to ``READ_BYTES``; nothing else is read.
        """
        wanted = [frame for place in places for frame in self._frames_of(place)]
        fetched = self._fetch(wanted)
        for place in places:
            frames = self._frames_of(place)
            yield place, [next(fetched) for _ in frames] if len(frames) == 1 else (next(fetched) for _ in frames)

    def _fetch(self, frames: list[int]) -> Iterator[np.ndarray]:
        start = 0
        while start < len(frames):
            end, size = start, 0
            while end < len(frames) and frames[end] == frames[start] + end - start and (end == start or size < READ_BYTES):
                size += int(self.table["stored"][frames[end]])
                end += 1
            data, at = self._at(int(self.offset[frames[start]]), size), 0
            for frame in frames[start:end]:
                stored = int(self.table["stored"][frame])
                ids = self.decompressor.decompress(data[at : at + stored])
                if xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.table["checksum"][frame]:
                    raise ValueError(f"frame {frame} is damaged")
                at += stored
                yield np.frombuffer(ids, f"<u{self.width}")
            start = end


@lru_cache(maxsize=1)
def library_encoder(content: str) -> ChunkEncoder:
    """Encodes with the tokenizers library; a chunk goes through it once per worker, as long as it is remembered.

    Chunks end where the tokenizer's own pattern ends words, so their ids put
    together are those of the whole text. New chunks go to the library as lines of
    a few longer texts: a line end is a token of its own there.
    """
    tokenizer = tokenizers.Tokenizer.from_str(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = {token.content: number for number, token in tokenizer.get_added_tokens_decoder().items()}
    (line_end,) = tokenizer.encode("\n", add_special_tokens=False).ids

    def alone(chunks: Sequence[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(list(chunks), add_special_tokens=False)
        return [np.array(one.ids, dtype="<u4").tobytes() for one in found]

    def encode(chunks: Sequence[str]) -> list[bytes]:
        known: dict[str, bytes] = {}
        blank = [chunk for chunk in chunks if chunk.isspace() or "\n" in chunk]
        known.update(zip(blank, alone(blank)))
        words = [chunk for chunk in chunks if chunk not in known]
        for start in range(0, len(words), LINES):
            lines = words[start : start + LINES]
            ids = np.array(tokenizer.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == line_end)
            if len(ends) != len(lines) - 1:
                raise ValueError("this tokenizer does not keep line ends apart")
            data, starts = ids.tobytes(), [0, *(4 * ends + 4).tolist()]
            known.update(zip(lines, [data[a:b] for a, b in zip(starts, [*(4 * ends).tolist(), len(data)])]))
        return [known[chunk] for chunk in chunks]

    return ChunkEncoder(encode, special)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, width: int = 4) -> DataFrame:
    """Encode (doc_id, text) and write token files; returns the shards (shard, path, n_docs, n_tokens, n_bytes).

    Shards follow each other in ascending doc_id order (null first, then by a hash
    of the text, so rows of one id can be dealt over shards). A task writes under a
    name of its own attempt; only the shards returned here count, so a lost or
    repeated attempt does no harm. The folder must be one that pyarrow can open
    on the executors. A null text counts as empty and gets the end id alone.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer)
    folder = new_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        path = f"{base}/{context.partitionId():06d}-{context.taskAttemptId()}.tok"
        encoder, writer, end = None, None, end_id.to_bytes(4, "little")
        for batch in batches:
            if writer is None:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(path)
                encoder, writer = library_encoder(shared.value), TokenFileWriter(sink, width)
            texts = [text or "" for text in batch["text"].to_pylist()]
            for doc_id, parts in zip(batch["doc_id"].to_pylist(), encoder.encode(texts)):
                writer.add(doc_id, [*parts, end])
        if writer is not None:
            writer.close()
            sink.close()
            row = {
                "shard": [context.partitionId()], "path": [path], "n_docs": [len(writer.index)],
                "n_tokens": [writer.n_tokens], "n_bytes": [writer.n_bytes],
            }
            yield pa.RecordBatch.from_pydict(row)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = source.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    shards = materialize(ordered.mapInArrow(write, SHARD), "shards")
    store = folder.split(":", 1)[0] + "://" if ":" in folder.split("/", 1)[0] else ""
    return shards.withColumn("path", F.concat(F.lit(store), "path"))


@dataclass(frozen=True)
class _Digest:
    count: int = 0
    crc: int = 0

    def add(self, ids: np.ndarray) -> _Digest:
        return _Digest(self.count + len(ids), zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"), self.crc))


def read_token_files(shards: DataFrame) -> DataFrame:
    """doc_id, shard, start, n_tokens, ids_crc32 for every document, from the files.

    ``start`` is the number of ids in all documents before it. The running sum is
    over one row per file; the files themselves are read by as many tasks.
    """
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    placed = shards.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, at in zip(*(batch[name].to_pylist() for name in ("shard", "path", "first"))):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    reader = TokenFileReader(source)
                    ids = reader.doc_ids()
                    rows: list[tuple] = []
                    for place, frames in reader.read(range(len(reader))):
                        one = _Digest()
                        for frame in frames:
                            one = one.add(frame)
                        rows.append((ids[place], shard, at, one.count, one.crc))
                        at += one.count
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        names = ("doc_id", "shard", "start", "n_tokens", "ids_crc32")
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    files = max(1, shards.count())
    dealt = placed.select("shard", "path", "first").repartition(files)
    return dealt.mapInArrow(digest, "doc_id long, shard long, start long, n_tokens long, ids_crc32 long")


def lookup_tokens(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, ids of the documents named in ``wanted`` (doc_id): only their frames are decompressed.

    Every shard's index is read; the wanted ids reach the shards by a join on
    the range of ids each shard holds.
    """

    def indexes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    ids = TokenFileReader(source).doc_ids()
                yield pa.RecordBatch.from_pydict(
                    {"path": [path] * len(ids), "place": pa.array(range(len(ids)), pa.int64()), "doc_id": pa.array(ids, pa.int64())}
                )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, places in zip(batch["path"].to_pylist(), batch["places"].to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    reader = TokenFileReader(source)
                    ids = reader.doc_ids()
                    for place, frames in reader.read(sorted(places)):
                        tokens = np.concatenate([*frames]).astype(np.int64)
                        yield pa.RecordBatch.from_pydict(
                            {"doc_id": pa.array([ids[place]], pa.int64()), "ids": pa.array([tokens], pa.list_(pa.int64()))}
                        )

    files = max(1, shards.count())
    places = shards.select("path").repartition(files).mapInArrow(indexes, "path string, place long, doc_id long")
    hits = places.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return hits.groupBy("path").agg(F.collect_list("place").alias("places")).mapInArrow(fetch, "doc_id long, ids array<long>")
