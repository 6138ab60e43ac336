"""Byte-level BPE by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round finds the lowest-ranked
pair of every word (ranks by binary search over the sorted pair keys, least per
word by one segmented minimum), merges all its places at once, closes the gaps
and looks up only the pairs beside the merges. Words with no pair left leave the
array. A word's rounds are those of the usual one-by-one merging, because a pair
that a merge creates never ranks before it; ``MergeTable`` checks that.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

# ---- Fixed values: white space, and the pattern byte-level tokenizers cut words by
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
# ----
# Coarser pieces whose borders are always word borders too; the plain re module is the faster one for them
CHUNKS = re.compile(rf" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
_SAFE_CUT = regex.compile(rf"(?<=[^{SPACES}]) (?=[^{SPACES}])")
SLICE_CHARS = 1 << 20
GROUP_CHARS = 1 << 20
CACHE_CHUNKS = 2_000_000
_NONE = np.int64(1 << 62)


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut before a single space between words.

    A part runs on where no such place follows.
    """
    start = 0
    while len(text) - start > size:
        cut = _SAFE_CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves,
    the others in order from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(byte if byte in plain else next(others)) for byte in range(256)]


class MergeTable:
    """Vocabulary and merges of a byte-level BPE tokenizer file, as sorted arrays."""

    def __init__(self, content: str):
        model = json.loads(content)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in merges]
        self.special = {token["content"]: token["id"] for token in model["added_tokens"]}
        chars = byte_characters()
        self.of_byte = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        born = np.full(self.width, -1, dtype=np.int64)
        born[made] = np.arange(len(made))
        if len(np.unique(made)) < len(made) or (np.maximum(born[left], born[right]) >= np.arange(len(made))).any():
            raise ValueError("merges must be in the order in which they create tokens")
        keys = left * self.width + right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.made, self.twin = made, left == right
        to_byte = {char: byte for byte, char in enumerate(chars)}
        self.bytes_of: list[bytes] = [b""] * int(max([self.width - 1, *self.special.values()]) + 1)
        for token, number in vocab.items():
            known = all(c in to_byte for c in token)
            self.bytes_of[number] = bytes(to_byte[c] for c in token) if known else token.encode()
        for token, number in self.special.items():
            self.bytes_of[number] = token.encode()
        self.digits = [str(number) for number in range(len(self.bytes_of))]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], _NONE)

    def encode_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each word has."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_owner, done_symbols = [], []
        rank = np.full(len(symbols), _NONE)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(symbols)])
            best = np.repeat(least, length)
            ready = best == _NONE
            if ready.any():
                done_owner.append(owner[ready])
                done_symbols.append(symbols[ready])
                symbols, owner, rank, best = symbols[~ready], owner[~ready], rank[~ready], best[~ready]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == best)
            # a pair of equal symbols may follow itself (aaa): of such a run every second place merges
            run = np.r_[True, np.diff(hit) > 1] | ~self.twin[rank[hit]]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))  # the places of the merged symbols once the gaps are closed
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            beside = np.zeros(len(symbols) + 1, dtype=bool)
            beside[moved] = beside[moved - 1] = True  # place -1 is the spare one at the end
            touched = np.flatnonzero(beside[:-1])
            rank[touched] = _NONE
            touched = touched[touched + 1 < len(symbols)]
            touched = touched[owner[touched] == owner[touched + 1]]
            rank[touched] = self.ranks(symbols[touched], symbols[touched + 1])
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, dtype=np.int64)
        flat = np.concatenate(done_symbols) if done_symbols else np.zeros(0, dtype=np.int64)
        flat = flat[np.argsort(owner, kind="stable")]
        return flat, np.bincount(owner, minlength=len(words))

    def encode_chunks(self, chunks: Sequence[str]) -> list[bytes]:
        """Each chunk's ids as little-endian unsigned 32-bit integers."""
        number_of: dict[str, int] = {}
        in_chunk = [[number_of.setdefault(word, len(number_of)) for word in WORDS.findall(chunk)] for chunk in chunks]
        flat, counts = self.encode_words([word.encode() for word in number_of])
        data = flat.astype("<u4").tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        starts = [0, *ends[:-1]]
        return [b"".join([data[starts[n] : ends[n]] for n in numbers]) for numbers in in_chunk]


class Memory:
    """The ids of the keys met last, half of ``room`` of them at least and ``room`` at most.

    ``spell`` gives a key's text in up to three parts that are words of their own:
    an optional line end, the stem, and the full stops and commas behind it. Without it keys are encoded as they are.
    """

    def __init__(self, encode_chunks: Callable[[Sequence[str]], list[bytes]], spell: Callable[[str], tuple[str, str, str]] | None, room: int):
        self.encode_chunks, self.spell, self.room = encode_chunks, spell, room
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def fill(self, lists: list[list[str]]) -> list[list[bytes]]:
        """The ids of every key, list by list; new keys of all lists are encoded together."""
        found = [list(map(self.known.get, keys)) for keys in lists]
        gaps = [[at for at, one in enumerate(ids) if one is None] for ids in found]
        fresh = self._learn({keys[at] for keys, places in zip(lists, gaps) for at in places})
        for keys, ids, places in zip(lists, found, gaps):
            for at in places:
                ids[at] = fresh[keys[at]]
        return found

    def _learn(self, keys: set[str]) -> dict[str, bytes]:
        if len(self.known) > self.room // 2:
            self.older, self.known = self.known, {}
        fresh = {key: self.older[key] for key in keys if key in self.older}
        new = [key for key in keys if key not in fresh]
        if self.spell is None:
            new = [key for key in new if key]
            fresh[""] = b""
            for at in range(0, len(new), 50_000):
                fresh.update(zip(new[at : at + 50_000], self.encode_chunks(new[at : at + 50_000])))
            self.known.update(fresh)
            return fresh
        spelt, bases = [], []
        for key in new:
            start, stem, end = self.spell(key)
            base = "" if start or not end else key[: -len(end)]  # the key without its stops, perhaps known
            ids = (self.known.get(base) or self.older.get(base)) if base else None
            spelt.append((start, stem if ids is None else "", end))
            bases.append((base, ids))
        parts = {part: b"" for spelling in spelt for part in spelling if part}
        asked = list(parts)
        for at in range(0, len(asked), 50_000):
            parts.update(zip(asked[at : at + 50_000], self.encode_chunks(asked[at : at + 50_000])))
        parts[""] = b""
        for key, (start, stem, end), (base, ids) in zip(new, spelt, bases):
            ids = parts[stem] if ids is None else ids
            fresh[key] = parts[start] + ids + parts[end]
            if base:
                self.known[base] = ids
        self.known.update(fresh)
        return fresh


def _ended(chunk: str) -> tuple[str, str]:
    """Stem and trailing stops and commas, if a letter or digit before them makes these a word of their own."""
    stem = chunk.rstrip(".,")
    return (stem, chunk[len(stem) :]) if stem[-1:].isascii() and stem[-1:].isalnum() else (chunk, "")


def _spell_chunk(chunk: str) -> tuple[str, str, str]:
    return "", *_ended(chunk)


def _stems_and_ends(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Like ``_ended``, for many words at once."""
    stems = pc.utf8_rtrim(words, ".,")
    ended = pc.and_(pc.less(pc.binary_length(stems), pc.binary_length(words)), pc.match_substring_regex(stems, "[A-Za-z0-9]$"))
    ends = pc.replace_substring_regex(words.filter(ended), r"(?s)^.*[^.,]([.,]+)$", r"\1")
    return pc.if_else(ended, stems, words), pc.replace_with_mask(pa.repeat(pa.scalar("", pa.string()), len(words)), ended, ends)


def flat_ids(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(ids), dtype="<u4"), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4


def gather(flat: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat``, whose lengths are ``sizes``, in the order of ``place``, and their lengths."""
    counts, begin = sizes[place], (np.cumsum(sizes) - sizes)[place]
    ends = np.cumsum(counts)
    return flat[np.arange(ends[-1]) + np.repeat(begin - ends + counts, counts)], counts


class ChunkEncoder:
    """Encodes texts chunk by chunk and remembers the ids of the chunks it met last, a fixed number at most.

    Texts whose only white space is single spaces and line ends between words are
    cut by these, which is faster than the pattern and gives the same words.
    """

    def __init__(self, encode_chunks: Callable[[Sequence[str]], list[bytes]], special: dict[str, int], room: int = CACHE_CHUNKS):
        self.special = special
        names = map(regex.escape, sorted(special, key=len, reverse=True))
        self.cut = re.compile("(" + "|".join(names) + ")") if special else None
        self.chunks = Memory(encode_chunks, _spell_chunk, room // 4)
        self.stems = Memory(encode_chunks, None, room)

    def _parts(self, text: str) -> Iterator[str | bytes]:
        """The ids of special tokens, and the stretches between them."""
        for number, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if number % 2:
                yield self.special[part].to_bytes(4, "little")
            elif part:
                yield part

    def encode(self, texts: Sequence[str]) -> Iterator[Iterable[bytes]]:
        """For each text its ids (little-endian unsigned 32-bit) in parts. Take a text's parts before the next text."""
        group, size = [], 0
        for text in texts:
            if len(text) > SLICE_CHARS:
                yield from self._together(group)
                group, size = [], 0
                yield self._long(text)
                continue
            group.append(text)
            size += len(text)
            if size > GROUP_CHARS:
                yield from self._together(group)
                group, size = [], 0
        yield from self._together(group)

    def _together(self, texts: list[str]) -> Iterator[list[bytes]]:
        plain = [is_plain(text) and not (self.cut and self.cut.search(text)) for text in texts]
        found = iter(self._plain([text for text, simple in zip(texts, plain) if simple]))
        for text, simple in zip(texts, plain):
            yield [next(found)] if simple else list(self._long(text))

    def _plain(self, texts: list[str]) -> list[bytes]:
        """The ids of plain texts. Distinct words are parted from the full stops and commas behind them, each distinct stem
        is looked up once for all texts, and the texts' ids are gathered from these."""
        if not texts:
            return []
        marked = pc.replace_substring(pc.replace_substring(pa.array(texts, pa.string()), " ", "\t "), "\n", "\t\n\t")  # plain texts have no tabs
        lists = pc.split_pattern(marked, "\t")
        bounds, words = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        stems, ends = _stems_and_ends(words.dictionary)
        parts = stems.dictionary_encode(), ends.dictionary_encode()
        ids = self.stems.fill([part.dictionary.to_numpy(zero_copy_only=False).tolist() for part in parts])
        flat, sizes = gather(*flat_ids(ids[0] + ids[1]), np.stack([parts[0].indices.to_numpy(), parts[1].indices.to_numpy() + len(ids[0])], axis=1).ravel())
        sizes, place = sizes.reshape(-1, 2).sum(axis=1), words.indices.to_numpy()
        flat, counts = gather(flat, sizes, place)
        data, cuts = flat.tobytes(), (4 * np.r_[0, np.cumsum(counts)][bounds]).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _long(self, text: str) -> Iterator[bytes]:
        for part in self._parts(text):
            if isinstance(part, bytes):
                yield part
            else:
                for piece in slices(part):
                    yield b"".join(self.chunks.fill([CHUNKS.findall(piece)])[0])


_OTHER_SPACES = [c for c in regex.findall(rf"[{SPACES}]", "".join(map(chr, range(0x3001)))) if c not in " \n"]


def is_plain(text: str) -> bool:
    """Words with one space or one line end between them, and nothing else that is white space."""
    if not text or text[0] in " \n" or text[-1] in " \n":
        return False
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in _OTHER_SPACES))


@lru_cache(maxsize=1)
def own_encoder(content: str) -> tuple[MergeTable, ChunkEncoder]:
    """One per Python worker, so that what a task has learnt serves the worker's next ones."""
    table = MergeTable(content)
    return table, ChunkEncoder(table.encode_chunks, table.special)


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of (doc_id, text).

    ``tokenizer`` is the content of a byte-level BPE tokenizer file; it travels with
    the tasks (a file of a megabyte or two). A null text counts as empty: no ids,
    hashes of the empty string. Row by row, so no key can be hot; texts of any
    length are cut at word borders; repeated rows get one row each; an empty table
    gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, encoder = own_encoder(shared.value)
        for batch in batches:
            texts = [text or "" for text in batch["text"].to_pylist()]
            counts, id_hashes, text_hashes = [], [], []
            for parts in encoder.encode(texts):
                count, id_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
                held = b""
                for part in parts:
                    ids = np.frombuffer(part, dtype="<u4").tolist()
                    if ids:
                        id_hash.update((("," if count else "") + ",".join(map(table.digits.__getitem__, ids))).encode())
                    count += len(ids)
                    data = held + b"".join(map(table.bytes_of.__getitem__, ids))
                    cut = _whole_characters(data)
                    text_hash.update(data[:cut].decode("utf-8", "replace").encode())
                    held = data[cut:]
                text_hash.update(held.decode("utf-8", "replace").encode())
                counts.append(count)
                id_hashes.append(id_hash.hexdigest())
                text_hashes.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(both, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _whole_characters(data: bytes) -> int:
    """Where the last, perhaps unfinished, UTF-8 character of ``data`` starts, if it is unfinished."""
    for back in range(1, min(3, len(data)) + 1):
        byte = data[-back]
        if byte >= 0xC0:
            need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
            return len(data) - back if need > back else len(data)
        if byte < 0x80:
            break
    return len(data)
