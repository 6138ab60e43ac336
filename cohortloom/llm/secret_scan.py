"""Secret scan: three fixed patterns, and credential values that would be hard to guess.

The fixed patterns find keys by their shape. The method adds values that stand
where a credential is expected (``pwd = ...``) and whose cheapest explanation
is expensive: dynamic programming cuts the value into words, dates, repeats,
keyboard walks, sequences, runs of one character class and brute-force characters
at minimum guess cost. Words are ranked by their count in all documents, but for
the values after credential words themselves.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize

# ---- Fixed values: patterns and least lengths of the base spans, in their order
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_KEYWORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # runs of AKIA[A-Z0-9]+ with 16 characters or more
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs: a run is maximal and matched from its start
ASSIGN_VALUE = 8
KINDS = ("assign", "access", "hex", "guess")
# ----

CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)s?"""
    r"""["']?[ \t]{0,8}(?:=>|:=|[:=])[ \t]{0,8}["']?([^\s"'<>]{6,})""",
    re.IGNORECASE | re.ASCII,
)
CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth")

# ---- Fixed values: words by falling frequency in leaked passwords and prose, keyboard rows
COMMON = (
    "password the and for you love admin welcome login master dragon monkey letmein qwerty shadow sunshine princess "
    "football baseball superman batman secret test user guest root hello freedom whatever trustno pass access default "
    "example sample your here change changeme placeholder insert none null true false value string token key api "
    "summer winter spring autumn january february march april may june july august september october november december "
    "monday tuesday wednesday thursday friday saturday sunday mein und der die das que los las les des pour"
).split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop")
# ----
SEQUENCES = ("abcdefghijklmnopqrstuvwxyz", "0123456789")
LEET = str.maketrans("430157$@!", "aeoistsai")
DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?\d{1,2}[-/.]?\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.](?:19|20)?\d\d|(?:19|20)\d\d)")
LONGEST_SEGMENT = 40  # of repeats and walks that start anywhere; whole ones have any length
CLASSES = ((10, "d"), (26, "l"), (26, "u"), (52, "lu"), (36, "dl"), (36, "du"), (62, "dlu"))
CLASS_BITS = 2.0  # to name a class
WORD = re.compile(r"[^\W\d_]{3,}")
LONGEST_WORD = 24
TOP_WORDS = 1 << 16  # ranked words sent to the tasks: at most 24 characters each, so a few MB
LEAST_COUNT = 3
_HELD_WORDS = 1 << 18
REMEMBERED = 256  # longest value whose bits a worker remembers, and places of one value whose segments it remembers


@dataclass(frozen=True)
class Settings:
    """min_bits: guesses (log 2) from which a value counts as secret.

    Set by planted values (tests): six random printable characters take 39.4, ten random digits 36.2.
    """

    min_bits: float = 38.0


class Words:
    """Ranks of words: the fixed ones, then those of the documents; a word has its better rank."""

    def __init__(self, ranked: tuple[str, ...] = ()):
        self.rank = {word: number + 1 for number, word in enumerate(ranked)}
        for number, word in enumerate(COMMON):
            self.rank[word] = min(number + 1, self.rank.get(word, number + 1))
        self.longest = max(map(len, self.rank))


FIXED_WORDS = Words()


def _steps() -> dict[str, set[str]]:
    follow: dict[str, set[str]] = {}
    for line in (*ROWS, *SEQUENCES):
        for a, b in zip(line, line[1:]):
            follow.setdefault(a, set()).add(b)
            follow.setdefault(b, set()).add(a)
    return follow


FOLLOW = _steps()


def _char_bits(char: str) -> float:
    """Of a character without any pattern: one of all printable ones."""
    return math.log2(95) if char.isascii() else math.log2(100 + 95)


def _class_of(char: str) -> str:
    if not char.isascii():
        return " "
    return "d" if char.isdigit() else "l" if char.islower() else "u" if char.isupper() else " "


def _unit_bits(piece: str) -> float:
    """Of what is repeated: by the class of each character."""
    size = {"d": 10, "l": 26, "u": 26}
    return sum(math.log2(size[kind]) if (kind := _class_of(char)) in size else _char_bits(char) for char in piece)


def _walk_bits(length: int) -> float:
    return math.log2(40) + math.log2(length) * 2


def _short_segments(value: str, lower: str, words: Words) -> list[tuple[int, float]]:
    """(length, least bits) of the words, the date, the walks and the repeats that ``value`` starts with, none longer than some dozen characters."""
    size, plain = len(value), lower.translate(LEET)
    least: dict[int, float] = {}

    def offer(length: int, bits: float) -> None:
        least[length] = min(bits, least.get(length, math.inf))

    for end in range(3, min(size, words.longest) + 1):
        for text, extra in ((lower, 0.0), (plain, 1.0)):
            if rank := words.rank.get(text[:end]):
                offer(end, math.log2(rank + 1) + extra + min(sum(c.isupper() for c in value[:end]), 2))
    if date := DATE.match(value):
        offer(len(date[0]), math.log2(365 * 120) if len(date[0]) > 4 else math.log2(120))
    end = 1
    while end < min(size, LONGEST_SEGMENT) and lower[end] in FOLLOW.get(lower[end - 1], ""):
        end += 1
        if end >= 3:
            offer(end, _walk_bits(end))
    for unit in range(1, 9):
        piece, times = value[:unit], 1
        while value.startswith(piece, times * unit) and (times + 1) * unit <= LONGEST_SEGMENT and len(piece) == unit:
            times += 1
            offer(times * unit, _unit_bits(piece) + math.log2(times))
    return list(least.items())


class _OpenRuns:
    """Walks, repeats and runs of a class of any length, followed from their first character to their last.

    A whole walk or repeat is one segment if it is longer than ``LONGEST_SEGMENT``. A run of a class
    gives the segments from its start to any place and from any place to its end.
    """

    def __init__(self, value: str, lower: str):
        self.value, self.lower = value, lower
        self.walk: tuple[int, float] | None = None
        self.repeats: dict[int, tuple[int, float]] = {}
        # of a class: its start, the bits before it, the least bits of entering it anywhere and staying
        self.classes: dict[str, tuple[int, float, float]] = {}

    def advance(self, at: int, best: float) -> Iterator[tuple[int, float]]:
        """(length after ``at``, bits in all) of the segments that end beyond ``at``, now known; ``best`` leads up to ``at``."""
        value, lower, size = self.value, self.lower, len(self.value)
        if at + 1 < size and lower[at + 1] in FOLLOW.get(lower[at], ""):
            self.walk = self.walk or (at, best)
        elif self.walk:
            (start, before), self.walk = self.walk, None
            if at + 1 - start > LONGEST_SEGMENT:
                yield 1, before + _walk_bits(at + 1 - start)
        for unit in range(1, 9):
            if at + unit < size and value[at] == value[at + unit]:
                self.repeats.setdefault(unit, (at, best))
            elif unit in self.repeats:
                start, before = self.repeats.pop(unit)
                # the last, cut unit costs nothing more than its length
                if at + unit - start > LONGEST_SEGMENT:
                    yield unit, before + _unit_bits(value[start : start + unit]) + math.log2(at + unit - start)
        kind, after = _class_of(value[at]), _class_of(value[at + 1]) if at + 1 < size else None
        for letters, names in CLASSES:
            if kind not in names:
                self.classes.pop(names, None)
                continue
            start, before, inside = self.classes.get(names, (at, best, math.inf))
            inside = min(inside, best) + math.log2(letters)
            self.classes[names] = (start, before, inside)
            yield 1, before + CLASS_BITS + math.log2(letters) * (at + 1 - start)
            if after is None or after not in names:
                yield 1, inside + CLASS_BITS

    def least(self, at: int) -> float:
        """No segment that is still open after the character at ``at`` can lead to fewer bits."""
        found = [inside + CLASS_BITS for _, _, inside in self.classes.values()]
        if self.walk:
            found.append(self.walk[1] + _walk_bits(at + 1 - self.walk[0]))
        for unit, (start, before) in self.repeats.items():
            found.append(before + _unit_bits(self.value[start : start + unit]) + math.log2(at + 1 - start))
        return min(found, default=math.inf)


def _bits(value: str, words: Words, enough: float) -> float:
    lower = value.lower() if len(value.lower()) == len(value) else value
    reach = max(words.longest, LONGEST_SEGMENT)
    ahead = deque([0.0] + [math.inf] * reach)  # least bits up to this place and the next ones
    runs = _OpenRuns(value, lower)
    met: dict[tuple[str, str], list[tuple[int, float]]] = {}  # repeats come to the same characters again and again
    for at, char in enumerate(value):
        best = ahead.popleft()
        ahead.append(math.inf)
        ahead[0] = min(ahead[0], best + _char_bits(char))
        here = value[at : at + reach], lower[at : at + reach]
        if here not in met:
            if len(met) == REMEMBERED:
                met.clear()
            met[here] = _short_segments(*here, words)
        for length, bits in met[here]:
            ahead[length - 1] = min(ahead[length - 1], best + bits + 1.0)
        for length, bits in runs.advance(at, best):
            ahead[length - 1] = min(ahead[length - 1], bits + 1.0)
        if best >= enough and (least := min(min(ahead), runs.least(at) + 1.0)) >= enough:
            return least
    return ahead[0]


_remembered_bits = lru_cache(maxsize=1024)(_bits)


def guess_bits(value: str, words: Words = FIXED_WORDS, enough: float = math.inf) -> float:
    """Log 2 of the guesses the cheapest segmentation needs; each cut costs one bit.

    The program goes from character to character and keeps the next few places and the runs that
    are open, so it needs the same memory for a value of any length. It stops where nothing
    that could still follow is cheaper than ``enough``, and returns what is needed up to there.
    """
    return (_remembered_bits if len(value) <= REMEMBERED else _bits)(value, words, enough)


def _least_count(ranked: DataFrame, top: int) -> int:
    """The count above which lie at most ``top`` words (word, n), and as many as whole counts allow."""
    left, looked, least = top, F.lit(True), 0
    for key in (F.floor(F.log2("n") * 64), F.col("n")):
        sums = ranked.where(looked).groupBy(key.alias("key")).agg(F.count("*").alias("words"), F.max("n").alias("most"))
        for row in sorted(sums.collect(), key=lambda row: -row["key"]):
            if row["words"] > left:
                least, looked = row["most"], key == row["key"]
                break
            left -= row["words"]
        else:
            return 0
    return least


def common_words(docs: DataFrame, top: int = TOP_WORDS) -> tuple[str, ...]:
    """The words of all documents by falling count, at most ``top`` of them; values after credential words do not count.

    Each task sums the words it holds. Words are counted by size class of their count first, then
    by count in the class where ``top`` is reached; words of one count are taken all or not at
    all. Only words above that count reach the driver, and some thousand sums before them.
    Longer words than ``LONGEST_WORD`` are none.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return found

        for batch in batches:
            for text in batch["text"].to_pylist():
                if not text:
                    continue
                folded = text.lower()
                if any(hint in folded for hint in CONTEXT_HINTS):
                    folded = CONTEXT.sub(" ", text).lower()
                held.update(word for word in WORD.findall(folded) if len(word) <= LONGEST_WORD)
            if len(held) > _HELD_WORDS:
                yield rows()
        yield rows()

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    ranked = materialize(counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT), "words")
    kept = ranked.where(F.col("n") > _least_count(ranked, top)).collect()
    return tuple(row["word"] for row in sorted(kept, key=lambda row: (-row["n"], row["word"])))


def find_secrets(text: str, settings: Settings = Settings(), words: Words = FIXED_WORDS) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start and then kind in the order of KINDS; ends are exclusive.

    Base spans cover the whole match. A ``guess`` span covers the value only and is
    added unless a base span covers all of it.
    """
    spans = []
    folded = text.lower()
    if any(word in folded for word in ASSIGN_KEYWORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if any(word in folded for word in CONTEXT_HINTS):
        taken, covered = deque(sorted(spans)), 0  # the furthest end of the base spans that start up to here
        for m in CONTEXT.finditer(text):
            start = m.start(1)
            value = m[1].rstrip(".,;:!?)]}")
            end = start + len(value)
            while taken and taken[0][0] <= start:
                covered = max(covered, taken.popleft()[1])
            if len(value) >= 6 and end > covered and guess_bits(value, words, settings.min_bits) >= settings.min_bits:
                spans.append((start, end, "guess"))
    return sorted(spans, key=lambda span: (span[0], KINDS.index(span[2])))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span (overlapping ones as one) replaced by a marker."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans, redacted_text for every row.

    One pass counts the words of all documents, the other goes row by row, so no key can be hot. A null text counts as empty: no spans, the
    hash of an empty list; a null id stays null; repeated rows get one row each; texts and values of any length are
    scanned whole, in memory for a few copies of them; an empty table gives an empty result; other columns are not read.
    """

    words = docs.sparkSession.sparkContext.broadcast(Words(common_words(docs)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for text in batch["text"].to_pylist():
                spans = find_secrets(text or "", settings, words.value)
                base = [span for span in spans if span[2] != "guess"]
                kinds = [kind for *_, kind in base]
                row = (
                    *(kinds.count(kind) for kind in KINDS[:3]),
                    hashlib.sha256(listed(base).encode()).hexdigest(),
                    listed(spans), len(spans), text if text is None else redact(text, spans),
                )
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64(), pa.string()]
            arrays = [batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans", "redacted_text"]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(
        scan,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long, redacted_text string",
    )


def redact_secrets(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind, and ``n_chars`` counted anew; all rows stay.

    Null and empty texts stay as they are, repeated rows are covered alike, texts of any length are scanned
    whole, an empty table stays empty, and other columns, null or not, go through as they are.
    """

    words = docs.sparkSession.sparkContext.broadcast(Words(common_words(docs)))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text and redact(text, find_secrets(text, settings, words.value)) for text in batch["text"].to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    covered = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(cover, docs.schema)
    return covered.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
