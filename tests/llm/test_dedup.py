"""Substring dedup and SimHash against brute force."""

import hashlib
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from cohortloom.llm import queries, repeats, simhash, substring_dedup as dedup, suffix_array as sa

from .helpers import LONG, SF_DIR, documents, frame, odd_documents, rows_of

SORTED = lambda row: (row[0] is not None, row[0] or 0)


# ---- suffix arrays


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(97, 99), max_size=60).map(bytes) | st.binary(max_size=60))
def test_suffix_array_and_common_prefixes(data):
    values = np.frombuffer(data, np.uint8)
    order = sa.suffix_array(values)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    shared = sa.permuted_common_prefixes(values, order, np.arange(0), 64)
    for a, b in zip(order, order[1:]):
        same = 0
        while a + same < len(data) and b + same < len(data) and data[a + same] == data[b + same]:
            same += 1
        assert shared[b] == same


def test_strings_of_many_names():
    """Recursion with more names than numpy buckets, so that both ways of inducing are met."""
    rng = np.random.default_rng(4)
    words = [rng.integers(97, 123, 5, dtype=np.uint8).tobytes() for _ in range(2500)]
    data = b"".join(words[i] for i in rng.integers(0, 2500, 6000))
    assert sa.suffix_array(np.frombuffer(data, np.uint8)).tolist() == sorted(range(len(data)), key=lambda i: data[i : i + 300])


# ---- repeated windows


def brute(rows, window, cut):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=SORTED):
        elements = cut((text or "").encode())
        gone = [False] * len(elements)
        for start in range(len(elements) - window + 1):
            part = elements[start : start + window]
            part = part if isinstance(part, bytes) else tuple(part)
            if part in seen:
                gone[start : start + window] = [True] * window
            seen.add(part)
        out.append((doc_id, elements, gone))
    return out


def by_bytes(rows, window=100):
    result = []
    for doc_id, data, gone in brute(rows, window, bytes):
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and (n == 0 or not gone[n - 1]) for n, g in enumerate(gone))
        result.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return result


def by_words(rows, window=20):
    result = []
    for doc_id, words, gone in brute(rows, window, bytes.split):
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        result.append((doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return result


def tricky():
    chosen = random.Random(5)
    docs = [row[:2] for row in documents()]
    n = 10**6
    extra = [
        None, "", "a" * 5000, "a" * 3000 + "b" * 200, "ab" * 1000, docs[3][1] + docs[4][1], ("xyz " * 3 + "q ") * 300,
        " ".join(chosen.choice("ab") for _ in range(2000)), docs[5][1][:150] + "ééé" + docs[6][1], docs[7][1][50:], LONG, LONG,
    ]
    return docs + [(n + i, text) for i, text in enumerate(extra)]


BYTE_COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
WORD_COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_op2_equals_brute_force(corpus_spark):
    assert rows_of(queries.op2_suffix_dedup(corpus_spark, SF_DIR), *BYTE_COLUMNS) == by_bytes([r[:2] for r in documents()])


def test_op5_equals_brute_force(corpus_spark):
    assert rows_of(queries.op5_word_windows(corpus_spark, SF_DIR), *WORD_COLUMNS) == by_words([r[:2] for r in documents()])


@pytest.mark.parametrize("hot_key", [50_000, 1])
@pytest.mark.parametrize("small", [False, True])
def test_bytes_in_any_grouping(corpus_spark, monkeypatch, hot_key, small):
    """Hot anchors counted by hash or not; texts cut into parts and blocks of a few thousand bytes, or not."""
    if small:
        monkeypatch.setattr(repeats, "GROUP_ELEMENTS", 1500)
        monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
    docs = corpus_spark.createDataFrame(tricky(), "doc_id long, text string").repartition(4)
    assert rows_of(dedup.remove_repeated_bytes(docs, hot_key=hot_key), *BYTE_COLUMNS) == by_bytes(tricky())


def test_words_and_their_spans(corpus_spark):
    docs = corpus_spark.createDataFrame(tricky(), "doc_id long, text string").repartition(4)
    found = dedup.remove_repeated_words(docs)
    assert rows_of(found, *WORD_COLUMNS) == by_words(tricky())
    for row in found.collect():
        assert sum(span.words for span in row.spans) == row.n_removed
        assert hashlib.sha256(row.kept.encode()).hexdigest() == row.kept_sha256


def test_short_windows(corpus_spark):
    docs = corpus_spark.createDataFrame(tricky()[-13:], "doc_id long, text string")
    assert rows_of(dedup.remove_repeated_bytes(docs, window=30, gram=8), *BYTE_COLUMNS) == by_bytes(tricky()[-13:], 30)
    assert rows_of(dedup.remove_repeated_words(docs, window=5, gram=2), *WORD_COLUMNS) == by_words(tricky()[-13:], 5)


def test_odd_rows(corpus_spark):
    """A null id comes first; rows that repeat id and text are no repeats of each other."""
    rows = [row for row in odd_documents() if row[0] != 2000]
    docs = frame(corpus_spark, rows, clash=True)
    assert rows_of(dedup.remove_repeated_bytes(docs), *BYTE_COLUMNS) == sorted(by_bytes([r[:2] for r in rows]), key=lambda r: tuple((v is not None, v) for v in r))
    assert rows_of(dedup.remove_repeated_words(docs), *WORD_COLUMNS) == sorted(by_words([r[:2] for r in rows]), key=lambda r: tuple((v is not None, v) for v in r))
    twice = frame(corpus_spark, [row for row in odd_documents() if row[0] == 2000])
    assert [r.n_removed for r in dedup.remove_repeated_bytes(twice).collect()] == [by_bytes([(1, LONG + " twice")])[0][2]] * 2
    for run in (dedup.remove_repeated_bytes, dedup.remove_repeated_words):
        assert run(frame(corpus_spark, [])).collect() == []


# ---- SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows):
    prints = [plain_fingerprint(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                parent[find(a)] = find(b)
    least = {}
    for n, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(n)] = min(doc_id, least.get(find(n), doc_id))
    return [(doc_id, f"{prints[n]:016x}", least.get(find(n))) for n, (doc_id, _) in enumerate(rows)]


def test_op8_equals_brute_force(corpus_spark):
    found = rows_of(queries.op8_simhash(corpus_spark, SF_DIR), "doc_id", "fingerprint", "component_id")
    assert found == sorted(plain_components([r[:2] for r in documents()]))


def test_simhash_on_odd_rows(corpus_spark):
    rows = odd_documents()
    found = rows_of(simhash.near_duplicates(frame(corpus_spark, rows, clash=True)))
    assert found == sorted(plain_components([r[:2] for r in rows]), key=lambda r: tuple((v is not None, v) for v in r))
    assert simhash.near_duplicates(frame(corpus_spark, [])).collect() == []


@pytest.mark.parametrize("hot_segment", [4096, 10])
def test_no_link_is_lost(corpus_spark, hot_segment):
    """Clusters of fingerprints a few bits apart; with a small limit all their halves are hot."""
    chosen, prints = random.Random(1), set()
    for base in [chosen.getrandbits(64) for _ in range(5)]:
        for _ in range(120):
            value = base
            for _ in range(chosen.randint(0, 4)):
                value ^= 1 << chosen.randrange(64)
            prints.add(value - (1 << 64) if value >> 63 else value)
    prints = sorted(prints)
    expected = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    nodes = corpus_spark.createDataFrame([(p,) for p in prints], "fp long")
    assert {(min(l), max(l)) for l in simhash.links(nodes, hot_segment).collect()} == expected


def test_one_row_of_each_group_stays(corpus_spark):
    rows = odd_documents() + documents()
    kept = simhash.keep_one(frame(corpus_spark, rows, clash=True))
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "tie" in kept.columns
    groups = {}
    for (doc_id, text, *_), (_, digits, component) in zip(rows, plain_components([r[:2] for r in rows])):
        # groups without any id, and different texts of one id, have no id of their own: these are single rows
        groups.setdefault(digits if component in (None, 2001) else component, set()).add((doc_id, text))
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(found) == len(groups)
    assert all(sum(row in members for row in found) == 1 for members in groups.values())
    assert {doc_id for doc_id, _ in found} == {*(group for group in groups if isinstance(group, int)), None, 2001}


def test_rows_that_differ_in_other_columns(corpus_spark):
    """Of rows with one id and text the same one stays, however the rows are dealt."""
    rows = [(1, LONG, "en", source, None) for source in ("a", "b", None, "c")]
    kept = {tuple(simhash.keep_one(frame(corpus_spark, order)).first()) for order in (rows, rows[::-1], rows[2:] + rows[:2])}
    assert len(kept) == 1


# ---- pipeline stage


def test_pipeline_stage_is_simhash(corpus_spark):
    """The stage keeps the least id of every group that the operator's fingerprints link."""
    rows = [row for row in documents() if row[0] is not None]
    kept = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](corpus_spark, frame(corpus_spark, rows), SF_DIR)
    assert {r.doc_id for r in kept.collect()} == {component for _, _, component in plain_components([r[:2] for r in rows])}
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


# ---- windows, shared ids, fresh workers


def test_window_too_long_for_its_gram():
    with pytest.raises(ValueError, match="longer gram"):
        repeats.Method(dedup.Shape(300, 32), dedup.byte_values, True)


def test_long_window(corpus_spark):
    docs = corpus_spark.createDataFrame([(1, LONG * 8), (2, "x" + LONG * 8)], "doc_id long, text string")
    found = rows_of(dedup.remove_repeated_bytes(docs, window=300, gram=200), *BYTE_COLUMNS)
    assert found == by_bytes([(1, LONG * 8), (2, "x" + LONG * 8)], 300)


def test_many_texts_without_id(corpus_spark):
    """Texts that share an id, or have none, get their own spans only."""
    rows = [(None, f"{n} {LONG}") for n in range(40)] + [(7, f"{LONG} {n}") for n in range(40)]
    docs = corpus_spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = dedup.remove_repeated_bytes(docs).collect()
    lost = sorted(r.n_removed for r in found)
    own = by_bytes([(1, LONG)])[0][2]  # what a single text loses to itself
    assert len(found) == 80 and own <= lost[0] <= own + 2 and lost[1] >= len(LONG) - 1


FRESH_WORKERS = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.python.worker.reuse", "false").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {folder!r}).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
from cohortloom.llm import queries
for name, query in sorted(queries.queries().items()):
    print(name, query(spark, {sf_dir!r}).count(), flush=True)
spark.stop()
"""


def test_every_query_on_fresh_workers(tmp_path):
    """A worker that has run nothing before must be able to run any task."""
    root = str(Path(__file__).resolve().parents[2])
    script = FRESH_WORKERS.format(root=root, folder=str(tmp_path), sf_dir=SF_DIR)
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.split()[0] in queries.queries())
    assert set(counts) == set(queries.queries()) and all(int(n) > 0 for n in counts.values())
