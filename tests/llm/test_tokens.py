"""BPE and token files against the tokenizers library."""

import hashlib
import io
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
import xxhash
import zstandard

from cohortloom.llm import bpe, queries, token_files
from cohortloom.llm.common import tokenizer_file

from .helpers import SF_DIR, documents, frame, odd_documents, rows_of

PARTS = [
    " ", "  ", "\n", "\t", "\r", "a", "b", "'s", "'ll", "1", "9", "é", "ß", "日本", "<|endoftext|>", ".", ",", "!?", "　",
    "\x1c", "\x85", "​", "the", "aaaa", "😀", "\x00", "᠎", " ", "ſ", "ᾳ", "٣", "½", "Don't",
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def random_texts(count, seed=3):
    chosen = random.Random(seed)
    return ["".join(chosen.choice(PARTS) for _ in range(chosen.randint(0, 30))) for _ in range(count)]


@pytest.mark.parametrize("make", [lambda c: bpe.own_encoder(c)[1], token_files.library_encoder])
def test_encoders_equal_the_library(library, make):
    encoder, texts = make(tokenizer_file()), random_texts(3000) + [row[1] for row in documents()]
    for text, parts in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_character(library):
    encoder = bpe.own_encoder(tokenizer_file())[1]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1" for c in points[s : s + 4000]) for s in range(0, len(points), 40_000)]
    for text, parts in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_texts_are_cut_at_word_borders(library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_CHARS", 50)
    encoder = bpe.ChunkEncoder(bpe.own_encoder(tokenizer_file())[0].encode_chunks, {"<|endoftext|>": 50256}, room=40)
    texts = ["".join(random_texts(40, seed)) for seed in range(20)] + ["a" * 500, " ".join(["word."] * 200)]
    for text in texts:
        assert "".join(bpe.slices(text, 50)) == text
        (parts,) = [list(parts) for parts in encoder.encode([text])]
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_plain_texts_ask_for_each_stem_once():
    """Words with stops, after line ends and at the start used to be looked up, and kept, one by one and apart from their stems."""
    texts = ["one two. two, two\none., é. é 1. one.a. ... .", "one.", "two two.\ntwo", ".", "a.\n.", "one two. two, two\none., é. é 1. one.a. ... ."]
    table, asked = bpe.MergeTable(tokenizer_file()), []
    encoder = bpe.ChunkEncoder(lambda chunks: asked.extend(chunks) or table.encode_chunks(chunks), {})
    found = [b"".join(parts) for parts in encoder.encode(texts)]
    assert found == [b"".join(table.encode_chunks([text])) for text in texts]
    assert len(asked) == len(set(asked)) and not {" two.", " two,", "\none", "one."} & {*asked}
    assert len(encoder.stems.known) <= len(asked) + 1


def test_merge_order_is_checked():
    vocab = {c: n for n, c in enumerate(bpe.byte_characters())} | {"aa": 256, "aab": 257}
    with pytest.raises(ValueError):
        bpe.MergeTable(json.dumps({"added_tokens": [], "model": {"vocab": vocab, "merges": ["aa b", "a a"]}}))


def test_op9_equals_the_library(corpus_spark, library):
    found = {r.doc_id: r for r in queries.op9_bpe(corpus_spark, SF_DIR).collect()}
    for doc_id, text, *_ in documents():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert tuple(found[doc_id]) == (
            doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest(),
        )


def test_op9_on_odd_rows(corpus_spark, library):
    rows = odd_documents()
    found = rows_of(bpe.encode_decode(frame(corpus_spark, rows, clash=True), tokenizer_file()))
    expected = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(expected, key=lambda row: tuple((v is not None, v) for v in row))
    assert bpe.encode_decode(frame(corpus_spark, []), tokenizer_file()).collect() == []


def expected_starts(rows, library):
    at, out = 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_op1_round_trip(corpus_spark, library):
    found = rows_of(queries.op1_token_files(corpus_spark, SF_DIR), "doc_id", "start", "n_tokens", "ids_crc32")
    assert found == expected_starts(documents(), library)


def test_op1_on_odd_rows(corpus_spark, library):
    rows = [row for row in odd_documents() if row[0] not in (None, 2001)]
    shards = token_files.write_token_files(frame(corpus_spark, rows, clash=True), tokenizer_file())
    found = rows_of(token_files.read_token_files(shards), "doc_id", "start", "n_tokens", "ids_crc32")
    assert found == expected_starts(rows, library)
    both = token_files.write_token_files(frame(corpus_spark, odd_documents()), tokenizer_file())
    assert sorted(r.doc_id or -1 for r in token_files.read_token_files(both).collect())[:2] == [-1, -1]
    empty = token_files.write_token_files(frame(corpus_spark, []), tokenizer_file())
    assert token_files.read_token_files(empty).collect() == []


def test_lookup_reads_the_wanted_documents(corpus_spark, library):
    shards = token_files.write_token_files(frame(corpus_spark, documents()), tokenizer_file())
    wanted = corpus_spark.createDataFrame([(3,), (77,), (10**9,)], "doc_id long")
    found = {r.doc_id: r.ids for r in token_files.lookup_tokens(shards, wanted).collect()}
    texts = {row[0]: row[1] for row in documents()}
    assert found == {n: [*library.encode(texts[n], add_special_tokens=False).ids, 0] for n in (3, 77)}


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def written(docs, frame_tokens=4, width=4):
    sink = io.BytesIO()
    writer = token_files.TokenFileWriter(sink, width, frame_tokens=frame_tokens)
    for doc_id, ids in docs:
        writer.add(doc_id, [np.array(ids, "<u4").tobytes()])
    writer.close()
    assert writer.n_bytes == len(sink.getvalue())
    return sink.getvalue()


@pytest.mark.parametrize("width", [2, 4])
def test_file_format(width):
    docs = [(5, [1, 2, 3]), (None, []), (7, list(range(11))), (9, [65535])]
    data = written(docs, width=width)
    reader = token_files.TokenFileReader(Source(data))
    assert reader.doc_ids() == [5, None, 7, 9]
    assert {place: np.concatenate([*frames]).tolist() for place, frames in reader.read(range(4))} == dict(enumerate(i for _, i in docs))
    assert [np.concatenate([*f]).tolist() for _, f in reader.read([2])] == [list(range(11))]
    # every frame is a zstandard frame of its own, and common tools can read the whole file
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(plain, f"<u{width}").tolist() == [i for _, ids in docs for i in ids]
    first = zstandard.ZstdDecompressor().decompress(data[: int(reader.table["stored"][0])])
    assert reader.table["checksum"][0] == xxhash.xxh64_intdigest(first) & 0xFFFFFFFF
    assert zstandard.get_frame_parameters(data).has_checksum


def test_only_wanted_frames_are_read():
    docs = [(n, [n] * 50) for n in range(200)]
    source = Source(written(docs, frame_tokens=1000))
    reader = token_files.TokenFileReader(source)
    touched = []
    plain = source.read
    source.read = lambda size: touched.append((source.tell(), size)) or plain(size)
    assert [np.concatenate([*f]).tolist() for _, f in reader.read([17])] == [[17] * 50]
    assert touched == [(int(reader.offset[17]), int(reader.table["stored"][17]))]


def test_damage_is_found():
    data = bytearray(written([(1, list(range(100)))], frame_tokens=1000))
    reader = token_files.TokenFileReader(Source(bytes(data)))
    data[int(reader.table["stored"][0]) - 2] ^= 1  # inside the frame's own checksum
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.TokenFileReader(Source(bytes(data))).read([0]))
    with pytest.raises(ValueError):
        token_files.TokenFileReader(Source(b"x" * 100))
