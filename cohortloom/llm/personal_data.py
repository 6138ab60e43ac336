"""Personal data: patterns propose spans, checks confirm them, words beside them move their score.

DataFrame functions only. A pattern's matches and the stretches between them come from
``regexp_extract_all`` and ``split``; their lengths, added up, are the places. Patterns
take runs of characters whole (possessively), so no text makes them slow.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 256
SPAN = "struct<start:long,rank:int,end:long,kind:string,score:double>"


@dataclass(frozen=True)
class Rule:
    """A kind of span. ``needs``: what a text must hold to be looked at. ``check``: what confirms a match.
    ``alone``: characters that may not stand beside a match. The score starts at ``score``; one of the ``words`` (in lower
    case) near the match adds ``gain``. Base kinds stay whatever their score; the others from ``LEAST_SCORE`` on."""

    kind: str
    pattern: str
    needs: Callable[[Column], Column]
    check: Callable[[Column], Column]
    score: float
    words: str
    gain: float = 0.3
    base: bool = False
    alone: str | None = None

    @property
    def beside(self) -> str:
        """Pattern of a context word of its own."""
        return f"(^|[^a-z])({self.words})([^a-z]|$)"


LEAST_SCORE = 0.6
NEAR = 40  # characters on either side that are searched for words


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits of a match pass the Luhn check."""

    def worth(digit: Column, place: Column) -> Column:
        twice = digit.cast("int") * F.when(place % 2 == 1, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.split(F.reverse(_digits(match)), ""), worth), F.lit(0), lambda total, value: total + value) % 10 == 0


def mod_97(match: Column) -> Column:
    """Whether an account number passes the mod-97 check: its first four characters go behind the others, letters count 10 to 35."""
    plain = F.regexp_replace(match, r"\x20", "")
    moved = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        letter = F.ascii(char) - 55
        return F.when(char.rlike("[0-9]"), rest * 10 + F.ascii(char) - 48).otherwise(rest * 100 + letter) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _between(least: int, most: int) -> Callable[[Column], Column]:
    return lambda match: F.length(_digits(match)).between(least, most)


def _date(match: Column) -> Column:
    """A day and a month that exist, as year-month-day, day.month.year or month/day/year."""
    iso = match.rlike("^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$")
    dotted = match.rlike(r"^(0?[1-9]|[12][0-9]|3[01])\.(0?[1-9]|1[0-2])\.(19|20)[0-9]{2}$")
    slashed = match.rlike("^(0?[1-9]|[12][0-9]|3[01])/(0?[1-9]|[12][0-9]|3[01])/(19|20)[0-9]{2}$")
    return iso | dotted | slashed


def _always(match: Column) -> Column:
    return F.lit(True)


def _has(*parts: str) -> Callable[[Column], Column]:
    def check(text: Column) -> Column:
        found = F.lit(True)
        for part in parts:
            found = found & text.contains(part)
        return found
    return check


def _has_digits(text: Column) -> Column:
    return text.rlike("[0-9][0-9]")


# ---- Fixed values: the base kinds in order, and the pattern parts they are made of
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE_KINDS = ("email", "ip", "card", "phone")
# ----
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
RULES = (
    Rule("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", _has("@"), _always, 0.9, "e-?mail|mail|contact|write", 0.1, True),
    Rule("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _has("."), lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), 0.6,
         "ip|host|server|address|login", 0.3, True),
    Rule("card", r"[0-9](?:[\x20-]?[0-9])++", _has_digits, lambda m: _between(14, 19)(m) & luhn(m), 0.7, "card|credit|visa|karte|carte|tarjeta", 0.3, True),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _has("+"), _between(10, 15), 0.7, "phone|call|tel|mobile|fax|telefon", 0.3, True),
    Rule("iban", r"[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9]){11,30}", _has_digits, mod_97, 0.7, "iban|account|bank|konto|compte|cuenta", 0.3, alone="[A-Za-z0-9]"),
    Rule("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", _has("-"), lambda m: ~m.rlike("^(000|666|9)") & ~m.rlike("-00-|-0000$"), 0.4,
         "ssn|social security|tax", alone="[0-9-]"),
    Rule("local", r"\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}", _has_digits, lambda m: _digits(m).rlike("^[2-9][0-9]{2}[2-9]"), 0.4,
         "phone|call|tel|mobile|cell|fax|telefon", alone=r"[0-9A-Za-z+.-]"),
    Rule("birth", r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}", _has_digits, _date, 0.3, "born|birth|birthday|dob|geboren|geburtsdatum|nacimiento",
         alone="[0-9./-]"),
)


def running_sums(values: Column) -> Column:
    """Sums of an array's first 1, 2, ... values. Long arrays go by blocks, so the work is far below a square of their length."""
    add = lambda total, value: total + value
    zero = F.lit(0).cast("long")

    def with_blocks(sums: Column) -> Column:
        bases = F.transform(sums, lambda _, at: F.aggregate(F.slice(sums, 1, at), zero, add))
        return _let(bases, lambda base: F.transform(
            values,
            lambda _, at: F.get(base, F.floor(at / BLOCK).cast("int"))
            + F.aggregate(F.slice(values, F.floor(at / BLOCK).cast("int") * BLOCK + 1, at % BLOCK + 1), zero, add),
        ))

    places = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / BLOCK).cast("int") - 1, F.lit(0)))
    by_block = F.transform(places, lambda block: F.aggregate(F.slice(values, block * BLOCK + 1, BLOCK), zero, add))
    return F.when(F.size(values) > 0, _let(by_block, with_blocks)).otherwise(values)


def _spans(rule: Rule, rank: int, hits: Column, parts: Column) -> Column:
    """The rule's confirmed spans, from its matches and the stretches before, between and behind them."""
    lengths = F.transform(hits, lambda hit, at: (F.length(hit) + F.length(F.get(parts, at))).cast("long"))

    def scored(ends: Column) -> Column:
        def one(hit: Column, at: Column) -> Column:
            before, after = F.get(parts, at), F.get(parts, at + 1)
            near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))))
            score = F.lit(rule.score) + F.when(near.rlike(rule.beside), F.lit(rule.gain)).otherwise(0.0)
            good = rule.check(hit)
            if rule.alone:
                good &= ~F.right(before, F.lit(1)).rlike(rule.alone) & ~F.left(after, F.lit(1)).rlike(rule.alone)
            end = F.get(ends, at)
            span = F.struct(
                (end - F.length(hit)).cast("long").alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"),
                F.least(score, F.lit(1.0)).alias("score"),
            )
            return F.when(good, span)

        kept = F.filter(F.transform(hits, one), lambda span: span.isNotNull())
        return kept if rule.base else F.filter(kept, lambda span: span["score"] >= LEAST_SCORE)

    return F.when(F.size(hits) > 0, _let(running_sums(lengths), scored)).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_spans(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with an array of spans (start, rank, end, kind, score) by start and rank beside its own columns.

    All own columns travel as one struct, so names cannot clash; ``into`` replaces a column of its name.
    """
    held = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("content"))
    content = F.col("content")
    empty = F.array().cast("array<string>")
    looked = {}
    for number, rule in enumerate(rules):
        needed = rule.needs(content)
        looked[f"hits_{number}"] = F.when(needed, F.regexp_extract_all(content, F.lit(rule.pattern), F.lit(0))).otherwise(empty)
    found = held.withColumns(looked)
    parts = {f"parts_{n}": F.when(F.size(f"hits_{n}") > 0, F.split(content, rule.pattern, -1)).otherwise(empty) for n, rule in enumerate(rules)}
    found = found.withColumns(parts)
    spans = [_spans(rule, n, F.col(f"hits_{n}"), F.col(f"parts_{n}")) for n, rule in enumerate(rules)]
    return found.select("row", F.array_sort(F.concat(*spans)).alias("found")).select(
        *[F.col("row")[name].alias(name) for name in docs.columns if name != into], F.col("found").alias(into)
    )


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def private_report(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of (doc_id, text).

    A null or empty text has no spans: counts of zero, the hash of nothing, an empty list.
    Texts are searched whole, whatever their length; repeated rows and ids get
    one row each; an empty table gives an empty result; other columns are not read.
    """
    found = with_spans(docs.select("doc_id", "text"), rules)
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def private_spans(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, kind, start, end, score: one row for every span."""
    return with_spans(docs.select("doc_id", "text"), rules).select("doc_id", F.inline("spans")).select("doc_id", "kind", "start", "end", "score")
