"""URL filter: glob rules in bit-parallel automata.

Every rule becomes glob patterns over ``host + path`` of the canonical URL; hits of
host rules, whose ``*`` also passes the host's end, are verified on host and path.
The patterns' characters are laid out as consecutive bits of 64-bit words; one
Shift-And step per URL character moves the states of all patterns at once, for
a whole batch of URLs (rows) and all words (columns). A ``*`` needs no bit of
its own: it lets the state before it stay alive on any character.

Lists of many rules are cut into blocks of some thousand bits, in the order of the
rules' suffixes (the last two labels of their host). A URL goes through the
blocks that hold rules of its own suffixes, and through all blocks of globs.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

ALLOW, BLOCK = "allow", "block"
BLOCK_BITS = 4096  # of one automaton, unless one rule alone needs more
HELD_BLOCKS = 512  # automata a task keeps: at most 64 words for each of 256 bytes, so 128 KB each
MOST_RULES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """Fits its host and all subdomains where the path starts with ``path``; the longest rule wins."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        return f"{self.text}*", f"*.{self.text}*"

    def fits(self, host: bytes, path: bytes) -> bool:
        """The globs see one text of host and path; this sees where the host ends."""
        name = self.host.encode()
        return (host == name or host.endswith(b"." + name)) and path.startswith(self.path.encode())


@dataclass(frozen=True)
class GlobRule:
    """Decides URLs that no host rule fits: ``*`` stands for any characters."""

    verdict: str
    glob: str


class GlobAutomaton:
    """Multiword Shift-And masks of many glob patterns over bytes.

    Bit layout: for each pattern one start bit, then one bit per literal byte.
    A start bit is set before the first byte only. ``hold`` marks the bits after
    which a ``*`` stands: once set they stay.
    """

    def __init__(self, globs: Sequence[str]):
        literals = [[part.encode() for part in glob.split("*")] for glob in globs]
        sizes = [1 + sum(map(len, parts)) for parts in literals]
        self.words = max(1, -(-sum(sizes) // 64))
        self.start, self.hold = self._mask(), self._mask()
        self.step = np.zeros((256, self.words), dtype=np.uint64)
        self.ends = self._mask()
        self.pattern = np.zeros(self.words * 64, dtype=np.int64)  # by the bit that ends it
        self.patterns = len(literals)
        bit = 0
        for number, parts in enumerate(literals):
            self._set(self.start, bit)
            for nth, part in enumerate(parts):
                if nth:
                    self._set(self.hold, bit)
                for byte in part:
                    bit += 1
                    self._set(self.step[byte], bit)
            self._set(self.ends, bit)
            self.pattern[bit] = number
            bit += 1

    def _mask(self) -> np.ndarray:
        return np.zeros(self.words, dtype=np.uint64)

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit // 64] |= np.uint64(1 << (bit % 64))

    def hits(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, pattern) numbers of all patterns that fit whole texts, read off the bits that are set."""
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        first = (np.cumsum(lengths) - lengths)[order]
        state = np.tile(self.start, (len(texts), 1))
        falling = -lengths[order]
        for position in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(falling, -position, side="left"))  # texts longer than position
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[flat[first[:live] + position]]) | (now & self.hold)
        state &= self.ends
        rows, words = np.nonzero(state)
        bits = (state[rows, words][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        found, bit = np.nonzero(bits)
        return order[rows[found]], self.pattern[words[found] * 64 + bit]

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix (texts x patterns): which pattern fits the whole text."""
        found = np.zeros((len(texts), self.patterns), dtype=bool)
        found[self.hits(texts)] = True
        return found


def suffixes(host: bytes) -> tuple[bytes, ...]:
    """The last label and the last two: what the hosts of fitting rules end with."""
    head, dot, last = host.rpartition(b".")
    return (last, head.rpartition(b".")[2] + dot + last) if dot else (last,)


class RuleBlocks:
    """All rules in blocks of patterns; automata are built where a URL needs them.

    Host rules are numbered from the longest, so the least number that fits decides.
    """

    def __init__(self, host_rules: Sequence[HostRule], glob_rules: Sequence[GlobRule]):
        self.rules = sorted(host_rules, key=lambda rule: -len(rule.text))
        self.globs = list(glob_rules)
        suffix = lambda number: suffixes(self.rules[number].host.encode())[-1]
        by_suffix = sorted(range(len(self.rules)), key=suffix)
        self.blocks = list(self._cut((n, self.rules[n].globs()) for n in by_suffix))
        self.glob_blocks = list(self._cut((n, (rule.glob,)) for n, rule in enumerate(self.globs)))
        self.of_suffix: dict[bytes, list[int]] = {}
        for at, block in enumerate(self.blocks):
            for name, _ in groupby(block, key=lambda item: suffix(item[0])):
                self.of_suffix.setdefault(name, []).append(at)

    @staticmethod
    def _cut(items: Iterable[tuple[int, tuple[str, ...]]]) -> Iterator[list[tuple[int, tuple[str, ...]]]]:
        block: list[tuple[int, tuple[str, ...]]] = []
        bits = 0
        for number, globs in items:
            size = sum(1 + len(glob.replace("*", "").encode()) for glob in globs)
            if block and bits + size > BLOCK_BITS:
                yield block
                block, bits = [], 0
            block.append((number, globs))
            bits += size
        if block:
            yield block


class Judge:
    """Applies blocks of rules to batches of (host, path); a task has one and keeps the automata it met last."""

    def __init__(self, blocks: RuleBlocks):
        self.blocks = blocks
        self.held: OrderedDict[tuple[bool, int], tuple[GlobAutomaton, np.ndarray]] = OrderedDict()

    def _automaton(self, host: bool, at: int) -> tuple[GlobAutomaton, np.ndarray]:
        if (host, at) not in self.held:
            block = (self.blocks.blocks if host else self.blocks.glob_blocks)[at]
            patterns = [(number, glob) for number, globs in block for glob in globs]
            made = GlobAutomaton([glob for _, glob in patterns]), np.array([number for number, _ in patterns])
            self.held[host, at] = made
            if len(self.held) > HELD_BLOCKS:
                self.held.popitem(last=False)
        self.held.move_to_end((host, at))
        return self.held[host, at]

    def __call__(self, parts: Sequence[tuple[bytes, bytes]]) -> list[tuple[HostRule | None, GlobRule | None]]:
        """For each URL the longest host rule that fits, and without one the first glob rule."""
        blocks, texts = self.blocks, [host + path for host, path in parts]
        wanted: dict[int, list[int]] = {}
        for row, (host, _) in enumerate(parts):
            for at in {at for name in suffixes(host) for at in blocks.of_suffix.get(name, ())}:
                wanted.setdefault(at, []).append(row)
        rule: dict[int, int] = {}
        for at, rows in sorted(wanted.items()):
            automaton, numbers = self._automaton(True, at)
            found, pattern = automaton.hits([texts[row] for row in rows])
            for row, number in zip(found.tolist(), numbers[pattern].tolist()):
                row = rows[row]
                if number < rule.get(row, len(blocks.rules)) and blocks.rules[number].fits(*parts[row]):
                    rule[row] = number
        rest = [row for row in range(len(parts)) if row not in rule]
        glob: dict[int, int] = {}
        for at in range(len(blocks.glob_blocks)):
            automaton, numbers = self._automaton(False, at)
            found, pattern = automaton.hits([texts[row] for row in rest])
            for row, number in zip(found.tolist(), numbers[pattern].tolist()):
                glob[rest[row]] = min(number, glob.get(rest[row], number))
        return [
            (blocks.rules[rule[row]] if row in rule else None, blocks.globs[glob[row]] if row in glob else None) for row in range(len(parts))
        ]


def read_rules(rules: DataFrame, most: int = MOST_RULES) -> list[HostRule]:
    """The rules of a table (verdict, host, path), which tasks get whole; a table of more than ``most`` rows is an error.

    Hosts are lower-cased (A-Z), a null path is empty, repeated rows are one rule, rows without verdict or host are none.
    """
    named = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    rows = named.dropna().distinct().orderBy("host", "path", "verdict").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return [HostRule(*row) for row in rows]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path. A null url, or one without ``://``, has both empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(
    pages: DataFrame,
    host_rules: Sequence[HostRule],
    glob_rules: Sequence[GlobRule] = (),
    default: str = ALLOW,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """key, host, path, rule, verdict for every row of ``pages``.

    The longest fitting host rule decides and is named in ``rule``. Otherwise
    ``rule`` is null and the first fitting glob rule decides, or ``default``.
    There may be some hundred thousand rules (see ``read_rules``): a batch meets only blocks
    of its hosts' suffixes, one after the other.
    Null, empty and very long urls are judged like any other (empty host and
    path, memory in proportion to the batch); repeated rows get one row each;
    an empty table gives an empty result; other columns are not carried over.
    """
    blocks = pages.sparkSession.sparkContext.broadcast(RuleBlocks(host_rules, glob_rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = Judge(blocks.value)
        for batch in batches:
            found = decide(list(zip(batch["_host"].to_pylist(), batch["_path"].to_pylist())))
            rules = [rule and rule.text for rule, _ in found]
            verdicts = [rule.verdict if rule else other.verdict if other else default for rule, other in found]
            yield pa.RecordBatch.from_arrays(
                [batch["_key"], batch["_host"].cast(pa.string()), batch["_path"].cast(pa.string()),
                 pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                names=[key, "host", "path", "rule", "verdict"],
            )

    host, path = url_parts(F.col(url).cast("string"))
    parts = pages.select(F.col(key).alias("_key"), host.cast("binary").alias("_host"), path.cast("binary").alias("_path"))
    kind = parts.schema["_key"].dataType.simpleString()
    return parts.mapInArrow(judge, f"`{key}` {kind}, host string, path string, rule string, verdict string")
