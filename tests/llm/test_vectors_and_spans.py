"""Hard negatives, personal data and token alignment against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cohortloom.llm import hard_negatives as hard, personal_data as personal, queries, token_alignment as alignment
from cohortloom.llm.common import model_file, tokenizer_file

from .helpers import SF_DIR, documents, frame, odd_documents, rows_of

NULLS_FIRST = lambda row: tuple((v is not None, v) for v in row)


# ---- hard negatives


def plain_negatives(rows, is_anchor, wanted=hard.Wanted()):
    """rows: (id, label, vector)."""
    usable = [
        (i, str(label), [math.floor(256 * float(x)) for x in v]) for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)
    out = []
    for i, label, v in {(i, label, tuple(v)) for i, label, v in usable if is_anchor(i)}:
        others = sorted(((-score(v, w), j, other) for j, other, w in usable if j != i))
        for found, j, _ in [o for o in others if o[2] == label][: wanted.positives]:
            inside = [o for o in others if o[2] != label and 50 * -found <= 100 * -o[0] <= 95 * -found][: wanted.negatives]
            out += [(i, j, n, k, -found, -s) for n, (s, k, _) in enumerate(inside, 1)]
    return sorted(out)


def vector_frame(spark, rows, clash=True):
    made = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    return made.withColumns({name: F.lit("x") for name in ("id", "tie", "seat", "codes", "p", "q", "slot")}) if clash else made


def random_rows(seed, n=260, dim=20):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dim))
    label = rng.integers(0, 4, n)
    return [(k, int(label[k]), (0.5 * centre[label[k]] + rng.normal(size=dim)).astype(np.float32).tolist()) for k in range(n)]


@pytest.mark.parametrize("shape", [hard.Settings(), hard.Settings(levels=1, planes=2, row_block=40, anchor_block=3)])
def test_negatives_equal_brute_force(corpus_spark, shape):
    rows = random_rows(3)
    found = hard.mine_hard_negatives(vector_frame(corpus_spark, rows), F.col("vec_id") % 9 == 0, settings=shape)
    expected = plain_negatives(rows, lambda i: i % 9 == 0)
    assert rows_of(found) == expected and len(expected) > 100


def test_negatives_on_odd_rows(corpus_spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(4, 60, 5)
    rows += [(100, None, [1.0] * 5), (102, 1, None), (104, 1, [1.0, None, 1.0, 1.0, 1.0]), (106, 1, [nan] * 5), (108, 1, [inf] * 5), (None, 1, [1.0] * 5)]
    rows += [(110, 2, [0.0] * 5), (112, 2, []), (114, 3, [1.0, 2.0]), (2, 1, [1.0] * 5), (2, 1, [1.0] * 5), (4, *rows[4][1:]), (116, 0, rows[8][2]), (118, 3, rows[8][2])]
    found = hard.mine_hard_negatives(vector_frame(corpus_spark, rows), F.col("vec_id") % 2 == 0)
    assert rows_of(found) == plain_negatives(rows, lambda i: i % 2 == 0)
    for none in (vector_frame(corpus_spark, rows).limit(0), vector_frame(corpus_spark, rows).where("vec_id % 2 = 1")):
        assert hard.mine_hard_negatives(none, F.col("vec_id") % 2 == 0).collect() == []


def test_one_vector_many_times(corpus_spark):
    """Equal vectors of many ids: ties go to the smaller ids, and no block holds them all."""
    rows = [(k, 1, [1.0, 0.0]) for k in range(300)] + [(1000 + k, 2, [0.9 if k % 2 else 0.7, 0.0]) for k in range(40)]
    shape = hard.Settings(row_block=30, anchor_block=8)
    found = hard.mine_hard_negatives(vector_frame(corpus_spark, rows), F.col("vec_id") % 20 == 0, settings=shape)
    assert rows_of(found) == plain_negatives(rows, lambda i: i % 20 == 0)


def test_very_large_components(corpus_spark):
    """Beyond 16 and 32 bits a component, and scores near the ends of a long."""
    rows = [(k, k % 2, [float(x) * 10.0 ** (k % 7) for x in (1, -2, 3 + k)]) for k in range(40)]
    found = hard.mine_hard_negatives(vector_frame(corpus_spark, rows), F.col("vec_id") % 5 == 0)
    assert rows_of(found) == plain_negatives(rows, lambda i: i % 5 == 0)
    big = np.array([[2**62, 2**62], [-(2**62), 2**62]])
    assert hard.integer_scores(big, big).tolist() == [2**63 - 1] * 2


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 130), st.integers(1, 7), st.integers(1, 9))
def test_scores_lie_in_their_intervals(seed, dim, levels, planes):
    rng = np.random.default_rng(seed)
    vectors = np.floor(256 * rng.normal(size=(30, dim)) * rng.choice([0, 0.01, 1, 300], size=(30, 1)))
    low, high = hard.intervals(hard.cut(vectors[:8], levels, planes, 5), hard.encoded(vectors, levels, 5))
    scores = vectors[:8] @ vectors.T
    assert (low <= scores).all() and (scores <= high).all()


def test_codes_narrow_the_intervals():
    rng = np.random.default_rng(1)
    vectors = np.floor(256 * rng.normal(size=(200, 64)) / 8)
    width = []
    for levels in (1, 4, 8):
        low, high = hard.intervals(hard.cut(vectors[:4], levels, 8, 5), hard.encoded(vectors, levels, 5))
        width.append((high - low).mean())
    assert width[0] > 3 * width[1] > 9 * width[2]


# ---- personal data

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_luhn(digits):
    total = 0
    for n, d in enumerate(reversed(digits)):
        worth = int(d) * (1 + n % 2)
        total += worth - 9 * (worth > 9)
    return total % 10 == 0


def plain_good(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and plain_luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def plain_private(text):
    spans = []
    for rank, (kind, pattern) in enumerate(BASE):
        spans += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if plain_good(kind, m[0])]
    return sorted(spans)


def plain_private_rows(rows):
    out = []
    for doc_id, text, *_ in rows:
        spans = plain_private(text)
        counts = Counter(kind for *_, kind in spans)
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        out.append((doc_id, *[counts[kind] for kind, _ in BASE], hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=NULLS_FIRST)


PRIVATE = (
    "a@b.c_d@e.f, x.y+z@mail-1.example.com. a@b. @c.d me@x..y é@é.é é1@a.b", "1.2.3.4.5.6.7.8 1.2.3.256 001.002.003.255 9.9.9.999999 1..2.3.4 01.1.1.00000000000000255",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 5500000000000004 3782 822463 10005 4111  1111 1111 1111", "+1 (555) 010-9999 +49.30.1234567 +1 +1234567890123456 +1        2 ++12 3456 7890 1",
    "é 日本 a@b.cd 10.0.0.1 \U0001f600 x@y.zz\n+44 20 7946 0958", "@" * 50 + "a" * 3000 + "@", "1" * 4000, "1.1." * 900, "a@" + "b." * 3000 + "c", "- " * 2000 + "4111111111111111",
    "mail " + "u@h.de " * 700,
)


def private_rows():
    return documents() + odd_documents() + [(7000 + n, text, None, None, None) for n, text in enumerate(PRIVATE)]


def test_base_spans(corpus_spark):
    found = personal.private_report(frame(corpus_spark, private_rows(), clash=True))
    names = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert rows_of(found, *names) == plain_private_rows(private_rows())
    assert sum(r.n_email for r in found.collect()) > 700
    assert personal.private_report(frame(corpus_spark, [])).collect() == []


def test_base_spans_are_among_all(corpus_spark):
    texts = {row[0]: row[1] for row in private_rows()}
    for row in personal.private_report(frame(corpus_spark, [(i, text, None, None, None) for i, text in texts.items()])).collect():
        spans = row.spans.split(",") if row.spans else []
        assert {f"{kind}:{a}:{b}" for a, _, b, kind in plain_private(texts[row.doc_id])} <= set(spans)
        starts = [int(span.split(":")[1]) for span in spans]
        assert starts == sorted(starts)


ADDED = (
    ("IBAN DE89 3704 0044 0532 0130 00, thanks", "iban:5:32"), ("konto GB82WEST12345698765432.", "iban:6:28"), ("GB82WEST12345698765433", ""),
    ("my SSN is 123-45-6789", "ssn:10:21"), ("code 123-45-6789 here", ""), ("SSN 000-45-6789", ""), ("ssn 1123-45-6789", ""),
    ("call me: (212) 555-0100 now", "local:9:23"), ("(212) 555-0100 parts", ""), ("cell 112-555-0100", ""),
    ("born 1980-02-29 in", "birth:5:15"), ("born 1980-13-29", ""), ("date of birth: 31.12.1999", "birth:15:25"), ("released 1980-02-29", ""),
)


def test_added_spans(corpus_spark):
    """Checks confirm, and words nearby lift the score over the limit."""
    rows = [(n, text, None, None, None) for n, (text, _) in enumerate(ADDED)]
    found = {r.doc_id: r.spans for r in personal.private_report(frame(corpus_spark, rows)).collect()}
    assert [found[n] for n in range(len(ADDED))] == [spans for _, spans in ADDED]
    scores = personal.private_spans(frame(corpus_spark, [(1, "mail a@b.cd " + "x" * 60 + " e@f.gh", None, None, None)])).collect()
    assert [(r.kind, r.start, r.end, round(r.score, 3)) for r in scores] == [("email", 5, 11, 1.0), ("email", 73, 79, 0.9)]


def test_private_data_needs_no_python(corpus_spark):
    plan = personal.private_report(frame(corpus_spark, documents()))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_running_sums_over_blocks(corpus_spark):
    values = list(range(1, 1500))
    found = corpus_spark.createDataFrame([(values,), ([],), ([5],)], "v array<long>").select(personal.running_sums(F.col("v"))).collect()
    assert [r[0] for r in found] == [np.cumsum(values).tolist(), [], [5]]


# ---- token alignment


def plain_sides():
    a = tokenizers.Tokenizer.from_str(tokenizer_file())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = {c: n for n, c in enumerate(alignment.byte_characters())}

    def side_a(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids]

    def side_b(text):
        ids = b.encode(text)
        piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        return ids, [piece(i) for i in ids]

    return side_a, side_b


def plain_alignment(rows):
    side_a, side_b = plain_sides()
    docs, times = [], Counter()
    for doc_id, text, *_ in rows:
        groups, links = [], Counter()
        if text:
            (a, a_bytes), (b, b_bytes) = side_a(text), side_b(text)
            whole = (" " + text).encode()
            if b"".join(a_bytes) == b"".join(b_bytes) == whole:
                ends = [np.cumsum([len(x) for x in part]).tolist() for part in (a_bytes, b_bytes)]
                at = [0, 0]
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    to = [ends[0].index(cut, at[0]) + 1, ends[1].index(cut, at[1]) + 1]
                    mine = a[at[0] : to[0]], b[at[1] : to[1]]
                    groups.append(mine)
                    links.update((x, y) for x in mine[0] for y in mine[1])
                    at = to
        times.update(set(links))
        docs.append((doc_id, groups, links))
    highest = defaultdict(int)
    for (x, _), n in times.items():
        highest[x] = max(highest[x], n)
    out = []
    for doc_id, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
            sum(n for pair, n in links.items() if times[pair] == highest[pair[0]]), sum(n * times[pair] for pair, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=NULLS_FIRST)


ALIGN = (
    "<|endoftext|> and <s></s><unk> are plain", "two  spaces", " leading", "trailing ", "tab\tline\nend\n\n", "▁ a real mark", "日本語 the emoji \U0001f600\U0001f3fd", "é́ combining", "\x00 \x1c  wide",
    "a" * 2500, "ab" * 1500, "it's  we'll 12345 3.14!!!...", "​zero﻿", "x" * 40 + " " * 30 + "y", "fi ligature ﬁ Ａ full", " ", "\n", "of", "def f(x):\n    return x\n",
)


def aligned(found):
    return rows_of(found, "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("chunk_bytes", [alignment.CHUNK_BYTES, 2000])
def test_alignment_equals_brute_force(corpus_spark, chunk_bytes):
    rows = documents()[:60] + odd_documents() + [(8000 + n, text, None, None, None) for n, text in enumerate(ALIGN)]
    docs = frame(corpus_spark, rows, clash=True).withColumns({"chunk": F.lit("x"), "pair": F.lit("y")})
    found = alignment.align_tokenizers(docs, tokenizer_file(), model_file(), chunk_bytes)
    assert aligned(found) == plain_alignment(rows)
    assert alignment.align_tokenizers(docs.limit(0), tokenizer_file(), model_file()).collect() == []


def test_op13_equals_brute_force(corpus_spark):
    assert aligned(queries.op13_token_alignment(corpus_spark, SF_DIR)) == plain_alignment(documents())


def test_sides_encode_like_the_libraries():
    """Word by word, from memory, and whole texts."""
    texts = [text for _, text, *_ in documents() + odd_documents() if text] + list(ALIGN)
    own = [side.encode(texts) for side in (alignment.byte_level_side(tokenizer_file()), alignment.piece_side(model_file()))]
    for side, found in zip(plain_sides(), own):
        assert [ids.tolist() for ids in found] == [side(text)[0] for text in texts]


def test_words_go_to_the_piece_model_once(monkeypatch):
    """Texts of words that were met before ask the library for nothing."""
    asked = []

    class Counting(sentencepiece.SentencePieceProcessor):
        def encode(self, texts, **options):
            asked.append(sum(map(len, texts)))
            return super().encode(texts, **options)

    monkeypatch.setattr(alignment.sentencepiece, "SentencePieceProcessor", Counting)
    sides = alignment._sides.__wrapped__(tokenizer_file(), model_file())
    texts = ["the same words\nagain and\nthe end, " * 20 + "été", "the end\nagain"]
    first = alignment.align(texts, sides)
    once = sum(asked)
    assert once < 100
    assert alignment.align(texts[::-1], sides).hashes == first.hashes[::-1]
    assert sum(asked) == once
    sides.encode(["so " + "long" * 400 + " a word"])
    assert max(map(len, [*sides.words.known, *sides.words.older])) < 100  # words of any length take no lasting memory


@pytest.mark.parametrize("room", [alignment.ROOM, 40])
def test_both_sides_by_words_encode_like_the_libraries(monkeypatch, room):
    """Words after spaces and line ends, marks that stand for spaces, words forgotten and met again, texts of all kinds together."""
    monkeypatch.setattr(alignment, "ROOM", room)
    pair = alignment._sides.__wrapped__(tokenizer_file(), model_file())
    texts = [text for _, text, *_ in documents()[:150] + odd_documents() if text] + list(ALIGN)
    texts += ["a\nb c\n日本 d", "x", "a ▁b\nc", "\x1c a\n\x1c\nb", "'s 's\n's 'll\n12 3", "<s> </s>\n<unk> <0x0A>", "é\n\U0001f600 \u0301 x\u0301"]
    for some in (texts, texts[::-1], texts[:0]):
        for side, found in zip(plain_sides(), pair.encode(some)):
            assert [ids.tolist() for ids in found] == [side(text)[0] for text in some]


@pytest.mark.parametrize("change", ["piece", "line", "rules", "unknown"])
def test_models_whose_pieces_may_cross_words_encode_whole_texts(change):
    model = alignment.piece_model.ModelProto.FromString(model_file())
    if change in ("piece", "line"):
        model.pieces.add(piece={"piece": "e▁t", "line": "e\nt"}[change], score=0, type=4)  # a string of the user's, found before any merge
    if change == "rules":
        model.normalizer_spec.precompiled_charsmap = b"\0\0\0\0"
    if change == "unknown":
        model.trainer_spec.byte_fallback = False
    assert alignment._cuts_words(model_file()) and not alignment._cuts_words(model.SerializeToString())
    if change in ("piece", "line"):
        texts = ["the tall tree the\ntall", "one two"]
        pair = alignment._sides.__wrapped__(tokenizer_file(), model.SerializeToString())
        library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        found = [ids.tolist() for ids in pair.encode(texts)[1]]
        assert found == library.encode(texts)
        assert len(model.pieces) - 1 in found[0]


def test_chunks_are_aligned_in_slices(monkeypatch):
    """The tables of one slice at a time, and rows as if the chunk were aligned whole."""
    texts = ["", "a few words", "été 1999\n  spaces", "x" * 300, "more of the same words, " * 30, "", "the end"] * 3
    sides = alignment._sides(tokenizer_file(), model_file())
    whole = alignment._chunk_rows(5, list(range(len(texts))), alignment.align(texts, sides))
    sizes, align = [], alignment.align
    monkeypatch.setattr(alignment, "align", lambda some, sides: sizes.append([len(text) for text in some]) or align(some, sides))
    cut = alignment._chunk_rows(5, list(range(len(texts))), alignment.align_slices(texts, sides, 200))
    assert cut.equals(whole)
    assert len(sizes) > 5 and all(sum(some) <= 200 or sum(size > 0 for size in some) == 1 for some in sizes)
