"""Cross-tokenizer alignment: which tokens of one tokenizer cover the bytes of which tokens of another.

Both tokenizers' tokens of a text are byte ranges of the same bytes. Places where a
token of either ends cut the text into groups; two tokens are linked if they lie in one
group. The work inside a task is Arrow's: distinct words are looked up once for both
tokenizers, lists of ids are flattened with their parent indices, cumulative sums give
the ends, a hash join on (document, end) finds the shared ones, and grouped tables count
links. Spark merges the partial counts of
all tasks and brings them back to the documents, chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

try:
    from sentencepiece import sentencepiece_model_pb2 as piece_model
except ImportError:  # it needs protobuf, which the library itself does not
    piece_model = None

from ..session import materialize
from .bpe import ChunkEncoder, Memory, byte_characters, flat_ids, gather, is_plain

CHUNK_BYTES = 1 << 20
SLICE_CHARS = 1 << 19  # a chunk is aligned in slices of whole texts; a longer text is a slice alone
ROOM = 1_000_000  # words whose ids, of both tokenizers, a worker remembers
LONG = 1000  # bytes of a word; longer ones are not remembered
LINES = 500
SPACE = "▁"
SECOND = np.uint32(1 << 31)  # marks the second tokenizer's ids among those of a word


@dataclass(frozen=True)
class Side:
    """One tokenizer: ids of many texts that each stand after a space, and the bytes of every id.

    ``words`` gives the ids of words that each start with a space or a line end, as they
    have them inside a text, one after the other, and how many each word has. It is None
    for a tokenizer whose tokens may cross words.
    """

    encode: Callable[[Sequence[str]], list[np.ndarray]]
    words: Callable[[Sequence[str]], tuple[np.ndarray, np.ndarray]] | None
    token_bytes: pa.Array
    digits: pa.Array


def _side(encode: Callable, words: Callable | None, token_bytes: list[bytes]) -> Side:
    digits = [str(number) for number in range(len(token_bytes))]
    return Side(encode, words, pa.array(token_bytes, pa.large_binary()), pa.array(digits, pa.string()))


def _word_by_word(texts: list[np.ndarray], starts: Callable[[np.ndarray], np.ndarray], keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts of words, without what stands before a text's first one, and how many each word has."""
    begins = [starts(ids) for ids in texts]
    counts = np.concatenate([np.diff(begin, append=len(ids)) for ids, begin in zip(texts, begins)])
    if len(counts) != len(keys):
        raise ValueError("this tokenizer does not keep words apart")
    return np.concatenate([ids[begin[0] :] for ids, begin in zip(texts, begins)]), counts


def byte_level_side(content: str) -> Side:
    """A byte-level tokenizer file; the strings of special tokens are plain text."""
    tokenizer = tokenizers.Tokenizer.from_str(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    plain = {char: byte for byte, char in enumerate(byte_characters())}
    count = tokenizer.get_vocab_size()
    names = [tokenizer.id_to_token(number) or "" for number in range(count)]
    token_bytes = [bytes(plain[c] for c in name) if all(c in plain for c in name) else name.encode() for name in names]
    (line_end,) = tokenizer.encode("\n", add_special_tokens=False).ids

    def ids(texts: list[str]) -> list[np.ndarray]:
        return [np.array(one.ids, dtype="<u4") for one in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def chunks(wanted: Sequence[str]) -> list[bytes]:
        """A line end is a token of its own between words, so many words go to the library as the lines of one text."""
        apart = [chunk for chunk in wanted if chunk.isspace() or "\n" in chunk]
        known = {chunk: found.tobytes() for chunk, found in zip(apart, ids(apart))}
        words = [chunk for chunk in wanted if chunk not in known]
        for at in range(0, len(words), LINES):
            lines = words[at : at + LINES]
            (joined,) = ids(["\n".join(lines)])
            ends = 4 * np.flatnonzero(joined == line_end)
            if len(ends) != len(lines) - 1:
                raise ValueError("this tokenizer does not keep line ends apart")
            data = joined.tobytes()
            known.update(zip(lines, [data[a:b] for a, b in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(data)])]))
        return [known[chunk] for chunk in wanted]

    encoder = ChunkEncoder(chunks, {}, ROOM)

    def encode(texts: Sequence[str]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(parts), dtype="<u4") for parts in encoder.encode([" " + text for text in texts])]

    def words(keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """A line end is put before the words that have none, and its token taken off again."""
        added = np.array([key[0] != "\n" for key in keys])
        lines = ["\n" + key if more else key for key, more in zip(keys, added)]
        texts = ids(["".join(lines[at : at + LINES]) for at in range(0, len(lines), LINES)])
        flat, counts = _word_by_word(texts, lambda found: np.flatnonzero(found == line_end), keys)
        return np.delete(flat, (np.cumsum(counts) - counts)[added]), counts - added

    return _side(encode, words, token_bytes)


def _cuts_words(model: bytes) -> bool:
    """Whether a word's pieces are the same in any text: merges that never cross a space or line end, characters left as they are."""
    if piece_model is None:
        return False
    parsed = piece_model.ModelProto.FromString(model)
    trainer, normalizer = parsed.trainer_spec, parsed.normalizer_spec
    kept = normalizer.add_dummy_prefix and normalizer.escape_whitespaces and not normalizer.precompiled_charsmap
    merges = trainer.model_type == trainer.BPE and trainer.byte_fallback and not trainer.treat_whitespace_as_suffix
    return kept and merges and not any(SPACE in one.piece.lstrip(SPACE) or "\n" in one.piece[1:] for one in parsed.pieces)


def piece_side(model: bytes) -> Side:
    """A sentencepiece model that puts a space before the text; the library encodes whole texts, or many words as one text."""
    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    count = processor.get_piece_size()
    names = [processor.id_to_piece(number) for number in range(count)]
    byte_of = {number: bytes([int(names[number][3:5], 16)]) for number in range(count) if processor.is_byte(number)}
    token_bytes = [byte_of.get(n, name.replace(SPACE, " ").encode()) for n, name in enumerate(names)]
    starts_word = np.array([one[:1] in (b" ", b"\n") for one in token_bytes])

    def encode(texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(found, dtype="<u4") for found in processor.encode(list(texts), num_threads=1)]

    def words(keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The space before a text goes to a word that is left out again."""
        texts = encode(["x" + "".join(keys[at : at + LINES]) for at in range(0, len(keys), LINES)])
        return _word_by_word(texts, lambda found: np.flatnonzero(starts_word[found])[1:], keys)

    return _side(encode, words if _cuts_words(model) else None, token_bytes)


class Pair:
    """Both tokenizers, and the words they met last: each with the first one's ids and, marked, the second one's.

    Texts whose only white space is single spaces and line ends between words are
    cut by these in Arrow; each distinct word of all of them is looked up once, and
    encoded by both libraries if it is new. Other texts go to the tokenizers whole.
    """

    def __init__(self, sides: Sequence[Side]):
        self.sides = tuple(sides)
        self.words = Memory(self._both, None, ROOM) if all(side.words for side in sides) else None

    def _both(self, keys: Sequence[str]) -> list[bytes]:
        (a, n_a), (b, n_b) = (side.words(keys) for side in self.sides)
        place = np.arange(2 * len(keys)).reshape(2, -1).T.ravel()
        flat, _ = gather(np.concatenate([a, b | SECOND]), np.concatenate([n_a, n_b]), place)
        data, ends = flat.tobytes(), (4 * np.cumsum(n_a + n_b)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: Sequence[str]) -> list[list[np.ndarray]]:
        """For each tokenizer the ids of every text."""
        plain = [self.words is not None and is_plain(text) and SPACE not in text for text in texts]
        cut = self._by_words([text for text, simple in zip(texts, plain) if simple])
        whole = [side.encode([text for text, simple in zip(texts, plain) if not simple]) for side in self.sides]
        return [[next(one if simple else other) for simple in plain] for one, other in zip(map(iter, cut), map(iter, whole))]

    def _by_words(self, texts: Sequence[str]) -> list[list[np.ndarray]]:
        if not texts:
            return [[], []]
        spaced = pa.array([" " + text for text in texts], pa.large_string())
        marked = pc.replace_substring(pc.replace_substring(spaced, " ", "\t "), "\n", "\t\n")  # plain texts have no tabs
        lists = pc.split_pattern(marked, "\t")  # the first word of each is empty
        words = lists.flatten().dictionary_encode()
        keys, long = words.dictionary, pc.greater(pc.binary_length(words.dictionary), LONG)
        (ids,) = self.words.fill([pc.if_else(long, "", keys).to_numpy(zero_copy_only=False).tolist()])
        for at in np.flatnonzero(long).tolist():
            (ids[at],) = self._both([keys[at].as_py()])
        flat, counts = gather(*flat_ids(ids), words.indices.to_numpy())
        bounds = np.concatenate([[0], np.cumsum(counts)])[lists.offsets.to_numpy()]
        second = flat >= SECOND
        before = np.concatenate([[0], np.cumsum(second)])[bounds]
        parts = [(flat[~second], (bounds - before).tolist()), (flat[second] ^ SECOND, before.tolist())]
        return [[found[a:b] for a, b in zip(cuts, cuts[1:])] for found, cuts in parts]


@lru_cache(maxsize=1)
def _sides(byte_level: str, pieces: bytes) -> Pair:
    return Pair((byte_level_side(byte_level), piece_side(pieces)))


@dataclass(frozen=True)
class Tokens:
    """The flat tokens of many documents: id, document, end byte inside the document."""

    ids: pa.Array
    doc: pa.Array
    end: pa.Array
    joined: bytes

    @classmethod
    def of(cls, side: Side, lists: list[np.ndarray]) -> "Tokens":
        sizes = np.cumsum([0, *map(len, lists)])
        listed = pa.LargeListArray.from_arrays(sizes, np.concatenate([*lists, np.zeros(0, "<u4")]).astype(np.int64))
        ids, doc = pc.list_flatten(listed), pc.list_parent_indices(listed).cast(pa.int64())
        spelt = side.token_bytes.take(ids)
        ends = pc.cumulative_sum(pc.binary_length(spelt).cast(pa.int64())).to_numpy(zero_copy_only=False)
        # segmented: what stands before a document is taken off
        before = np.concatenate([[0], ends])[sizes[:-1]]
        own = ends - before[doc.to_numpy()]
        data = spelt.buffers()[2]
        return cls(ids, doc, pa.array(own), data.to_pybytes()[: int(ends[-1])] if len(ends) else b"")


def _agreeing(texts: list[bytes], tokens: Sequence[Tokens]) -> np.ndarray:
    """Which texts both tokenizers spell byte by byte."""
    good = np.array([len(text) > 1 for text in texts], dtype=bool)
    for part in tokens:
        sizes = np.zeros(len(texts), dtype=np.int64)
        np.maximum.at(sizes, part.doc.to_numpy(), part.end.to_numpy())
        starts = (np.cumsum(sizes) - sizes).tolist()
        good &= [part.joined[at : at + size] == text for at, size, text in zip(starts, sizes.tolist(), texts)]
    return good


def _counted(group: pa.Array, token: pa.Array, name: str) -> pa.Table:
    counted = pa.table({"group": group, name: token}).group_by(["group", name]).aggregate([([], "count_all")])
    return counted.select(["group", name, "count_all"]).rename_columns(["group", name, f"n_{name}"])


def _joined(texts: pa.Array, sizes: np.ndarray, separator: str) -> pa.Array:
    """Neighbouring texts joined, ``sizes`` of them at a time."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(ends, texts), separator)


@dataclass(frozen=True)
class Aligned:
    """Per document: tokens, groups, links, hash of the groups. ``pairs``: document, pair (A id * 2^32 + B id), links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    hashes: list[str]
    pairs: pa.Table


def align(texts: Sequence[str], pair: Pair) -> Aligned:
    """Groups and links of texts, all at once."""
    count, sides = len(texts), pair.sides
    encoded = pair.encode(texts)
    spelt = [(" " + text).encode() if text else b"" for text in texts]
    a, b = (Tokens.of(side, lists) for side, lists in zip(sides, encoded))
    good = _agreeing(spelt, (a, b))
    if not good.all():
        none = np.zeros(0, "<u4")
        a, b = (Tokens.of(side, [ids if ok else none for ids, ok in zip(lists, good)]) for side, lists in zip(sides, encoded))
    numbers = [np.arange(len(part.ids)) for part in (a, b)]
    tables = [pa.table({"doc": part.doc, "end": part.end, name: at}) for part, name, at in zip((a, b), ("i", "j"), numbers)]
    shared = tables[0].join(tables[1], keys=["doc", "end"], join_type="inner", use_threads=False)
    group, size = [], []
    for part, name in ((a, "i"), (b, "j")):
        last = np.zeros(len(part.ids), dtype=np.int64)
        last[shared[name].to_numpy()] = 1  # a document's last tokens end together, so groups number on across documents
        group.append(np.cumsum(last) - last)
        size.append(np.bincount(group[-1], minlength=len(shared)))
    doc_of_group = np.zeros(len(shared), dtype=np.int64)
    doc_of_group[group[0]] = a.doc.to_numpy()
    n_groups = np.bincount(doc_of_group, minlength=count)
    n_links = np.zeros(count, dtype=np.int64)
    np.add.at(n_links, doc_of_group, size[0] * size[1])

    # groups of one token each are pairs as they are; the others' distinct tokens are joined by group
    single = [(size[0] == 1)[g] & (size[1] == 1)[g] for g in group]
    ids = [part.ids.to_numpy() for part in (a, b)]
    one = pa.table({"doc": a.doc.to_numpy()[single[0]], "pair": (ids[0][single[0]] << 32) | ids[1][single[1]], "links": np.ones(int(single[0].sum()), dtype=np.int64)})
    many = [_counted(pa.array(g[~s]), pa.array(i[~s]), name) for g, s, i, name in zip(group, single, ids, ("a", "b"))]
    met = many[0].join(many[1], keys="group", join_type="inner", use_threads=False)
    more = pa.table({
        "doc": doc_of_group[met["group"].to_numpy()], "pair": (met["a"].to_numpy() << 32) | met["b"].to_numpy(),
        "links": met["n_a"].to_numpy() * met["n_b"].to_numpy(),
    })
    summed = pa.concat_tables([one, more]).group_by(["doc", "pair"]).aggregate([("links", "sum")])
    pairs = summed.select(["doc", "pair", "links_sum"]).rename_columns(["doc", "pair", "links"])

    sides_text = []
    for part, side, sizes in zip((a, b), sides, size):
        sides_text.append(_joined(side.digits.take(part.ids), sizes, ","))
    lines = _joined(pc.binary_join_element_wise(*sides_text, "|"), n_groups, ";")
    hashes = [hashlib.sha256(line.as_buffer()).hexdigest() if ok else "" for line, ok in zip(lines, good)]
    n_a, n_b = (np.bincount(part.doc.to_numpy(), minlength=count) for part in (a, b))
    return Aligned(n_a, n_b, n_groups, n_links, hashes, pairs)


def align_slices(texts: Sequence[str], pair: Pair, slice_chars: int = SLICE_CHARS) -> Aligned:
    """The same as ``align`` for texts of a chunk, slice by slice, so that the flat tables of tokens are those of one slice."""
    slices, size = [[]], 0
    for text in texts:
        if slices[-1] and size + len(text) > slice_chars:
            slices.append([])
            size = 0
        slices[-1].append(text)
        size += len(text)
    found, pairs, before = [], [], 0
    for part in slices:
        found.append(align(part, pair))
        held = found[-1].pairs
        pairs.append(held.set_column(0, "doc", pc.add(held["doc"], before)))
        before += len(part)
    counts = [np.concatenate([getattr(one, name) for one in found]) for name in ("n_a", "n_b", "n_groups", "n_links")]
    return Aligned(*counts, [line for one in found for line in one.hashes], pa.concat_tables(pairs))


DOC_FIELDS = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
ALIGNED = "is_doc boolean, chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<long>, links array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _chunk_rows(chunk: int, ids: list[int | None], found: Aligned) -> pa.RecordBatch:
    """A row for every document with its pairs, and one for the chunk with its partial counts: pair, documents that hold it."""
    order = pc.sort_indices(found.pairs, [("doc", "ascending"), ("pair", "ascending")])
    pairs = found.pairs.take(order)
    counted = pairs.group_by("pair").aggregate([([], "count_all")])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(pairs["doc"].to_numpy(), minlength=len(ids)))])
    ends = np.concatenate([offsets, [offsets[-1] + len(counted)]]).astype(np.int32)
    values = [
        np.concatenate([pairs["pair"].to_numpy(), counted["pair"].to_numpy()]),
        np.concatenate([pairs["links"].to_numpy(), counted["count_all"].to_numpy()]),
    ]
    lists = [pa.ListArray.from_arrays(ends, pa.array(part, pa.int64())) for part in values]
    size = len(ids) + 1
    docs = [ids, found.n_a.tolist(), found.n_b.tolist(), found.n_groups.tolist(), found.n_links.tolist(), found.hashes]
    columns = [pa.array([*part, None], kind) for part, (_, kind) in zip(docs, DOC_FIELDS)]
    head = [pa.array([True] * len(ids) + [False]), pa.array([chunk] * size, pa.int64())]
    return pa.RecordBatch.from_arrays([*head, *columns, *lists], ["is_doc", "chunk", *[n for n, _ in DOC_FIELDS], "pair", "links"])


def _summed(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """A chunk's documents with the corpus-wide counts of their pairs summed up."""
    docs = docs.combine_chunks()
    zeros = pa.array(np.zeros(docs.num_rows, dtype=np.int64))
    n_best = count_sum = zeros
    if docs.num_rows and counts.num_rows:
        lists = docs["pair"].combine_chunks()
        flat = pa.table({"doc": pc.list_parent_indices(lists).cast(pa.int64()), "pair": pc.list_flatten(lists), "links": pc.list_flatten(docs["links"].combine_chunks())})
        met = flat.join(counts.select(["pair", "n_docs", "is_best"]), keys="pair", join_type="inner", use_threads=False)
        met = met.append_column("sum", pc.multiply(met["links"], met["n_docs"]))
        met = met.append_column("best", pc.multiply(met["links"], met["is_best"].cast(pa.int64())))
        sums = met.group_by("doc").aggregate([("sum", "sum"), ("best", "sum")])
        at = sums["doc"].to_numpy()
        found = [np.zeros(docs.num_rows, dtype=np.int64) for _ in range(2)]
        found[0][at], found[1][at] = sums["best_sum"].to_numpy(), sums["sum_sum"].to_numpy()
        n_best, count_sum = map(pa.array, found)
    names = [n for n, _ in DOC_FIELDS]
    columns = {name: docs[name] for name in names} | {"n_best": n_best, "count_sum": count_sum}
    return pa.table({name: columns[name] for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")})


def aligned_chunks(docs: DataFrame, byte_level: str, pieces: bytes, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of every document and of every chunk of documents (see ``_chunk_rows``); a longer text is a chunk alone."""
    shared = docs.sparkSession.sparkContext.broadcast((byte_level, pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _sides(*shared.value)
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                text = text or ""
                if texts and size + len(text) > chunk_bytes:
                    yield _chunk_rows(number, ids, align_slices(texts, pair))
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield _chunk_rows(number, ids, align_slices(texts, pair))

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, ALIGNED)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair, n_docs, is_best for every linked pair of ids: documents that hold it, and whether no pair of its A id has more."""
    partial = chunks.where("NOT is_doc").select(F.explode(F.arrays_zip("pair", "links")).alias("one"))
    totals = materialize(partial.groupBy(F.col("one.pair").alias("pair")).agg(F.sum("one.links").alias("n_docs")), "pair-counts")
    most = totals.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n_docs").alias("most"))
    return totals.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("is_best"))


def align_tokenizers(docs: DataFrame, byte_level: str, pieces: bytes, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of (doc_id, text).

    ``byte_level`` is the content of a byte-level tokenizer file (A), ``pieces`` that of
    a sentencepiece model (B); both travel with the tasks. Each encodes the text after
    a space. Null and empty texts, and those that A or B does not spell byte by byte,
    have no tokens: zeros and an empty hash. Texts of any length are whole; links inside
    a group are counted, not listed. Rows that repeat an id, or a whole row, are
    documents of their own, also for the counts. An empty table gives an empty
    result; other columns are not read.
    """
    chunks = materialize(aligned_chunks(docs, byte_level, pieces, chunk_bytes), "aligned")
    counts = materialize(pair_counts(chunks), "pair-ranks")
    held = chunks.where("NOT is_doc").select(F.col("chunk").alias("of_chunk"), F.explode("pair").alias("pair"))
    known = held.join(counts, "pair").select("of_chunk", "pair", "n_docs", "is_best")
    own = chunks.where("is_doc").drop("is_doc")
    return own.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(_summed, RESULT)
