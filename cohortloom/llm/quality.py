"""Quality rules: fixed counts, and divergence of a document's profile from its language's.

DataFrame functions only. A document is described by the histogram of its
character classes and that of common words; the reference of a language is the
sum of these histograms over all documents of the language. Documents whose
Jensen-Shannon distance to the reference is too large are rejected, unless they
are too short to say so.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import WORD

# ---- Fixed values: frequent function words of English, German, French and Spanish
COMMON_WORDS = (
    "the of and to in that is was for are with "
    "der die und den von zu das mit ist "
    "de la le et les des pour que "
    "el los las con por para una del"
).split()
SYMBOLS = r"[#*$%&|<>]"
DIGITS, CAPITALS, PUNCTUATION = r"[0-9]", r"[A-Z]", r"[!-/:-@\[-`{-~]"
# ----
FEATURES = "_quality_features"


@dataclass(frozen=True)
class Rules:
    """Base rules, and for each histogram the largest distance and the length from which it counts."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_char_distance: float = 0.25
    min_chars: int = 400
    max_word_distance: float = 0.3
    min_words_for_distance: int = 150


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _total(values: Column, zero: Column) -> Column:
    return F.aggregate(values, zero, lambda total, value: total + value)


def repeat_words(words: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more.

    Windows are compared by a 64-bit hash of their words' hashes. Only texts with
    a repeat sort their windows: equal ones become neighbours, and the words their
    places cover are counted from the gaps between these places.
    """

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda window, at: F.struct(window.alias("w"), at.alias("at"))))

        def places(rows: Column) -> Column:
            def repeated(row: Column, at: Column) -> Column:
                before = F.when(at > 0, F.get(rows, at - 1)["w"])
                return F.coalesce(row["w"] == before, F.lit(False)) | F.coalesce(row["w"] == F.get(rows, at + 1)["w"], F.lit(False))

            return F.sort_array(F.transform(F.filter(rows, repeated), lambda row: row["at"]))

        def count(found: Column) -> Column:
            gap = lambda place, at: F.when(at == 0, 3).otherwise(F.least(F.lit(3), place - F.get(found, at - 1)))
            return _total(F.transform(found, gap), F.lit(0))

        return _let(placed, lambda rows: _let(places(rows), count))

    def windows(hashes: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(hashes) - 3)
        return F.transform(places, lambda at: F.xxhash64(F.get(hashes, at), F.get(hashes, at + 1), F.get(hashes, at + 2)))

    def counted(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) < F.size(found), covered(found)).otherwise(0)

    hashes = F.transform(words, lambda word: F.xxhash64(word))
    enough = F.size(words) > 3
    return F.when(enough, _let(hashes, lambda h: _let(windows(h), counted))).otherwise(0).cast("long")


def with_features(docs: DataFrame, text: str = "text", words: str = "_quality_words") -> DataFrame:
    """``docs`` with a struct of counts and histograms beside its own columns."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(content, "\n"), lambda line: line.rlike(WORD))
    word = F.col(words)
    word_chars = F.length(F.array_join(word, ""))
    common = F.filter(word, lambda w: w.isin(*COMMON_WORDS))
    times = lambda hits, common_word: F.size(F.filter(hits, lambda hit: hit == F.lit(common_word)))
    by_word = _let(common, lambda hits: F.array(*[times(hits, w) for w in COMMON_WORDS]))
    digits, capitals, punctuation = (F.regexp_count(content, F.lit(p)) for p in (DIGITS, CAPITALS, PUNCTUATION))

    def classes(counts: Column) -> Column:
        """Digits, capitals, punctuation, white space, further bytes of longer characters, the rest."""
        chars, solid, extra = counts[3], counts[4], counts[5] - counts[3]
        rest = solid - counts[0] - counts[1] - counts[2]
        return F.array(counts[0], counts[1], counts[2], chars - solid, extra, rest)

    by_class = _let(F.array(digits, capitals, punctuation, F.length(content), word_chars, F.octet_length(content)), classes)
    features = F.struct(
        F.size(word).cast("long").alias("n_words"),
        word_chars.cast("long").alias("word_chars"),
        F.regexp_count(content, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda found: F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        repeat_words(word).alias("n_repeat_words"),
        F.length(content).cast("long").alias("n_chars"),
        by_class.cast("array<long>").alias("by_class"),
        by_word.cast("array<long>").alias("by_word"),
    )
    listed = docs.withColumn(words, F.regexp_extract_all(content, F.lit(WORD), F.lit(0)))
    return listed.withColumn(FEATURES, features).drop(words)


def language_references(featured: DataFrame, lang: str = "lang") -> DataFrame:
    """One row per language: its histograms summed over all documents (a null language is one of its own)."""
    part = F.col(FEATURES)
    classes = [F.sum(part["by_class"][n]).alias(f"c{n}") for n in range(6)]
    words = [F.sum(part["by_word"][n]).alias(f"w{n}") for n in range(len(COMMON_WORDS))]
    sums = featured.groupBy(F.col(lang).alias("_lang")).agg(*classes, *words, F.sum(part["n_words"]).alias("n"))
    return sums.select(
        "_lang",
        F.array(*[f"c{n}" for n in range(6)]).alias("_by_class"),
        F.array(*[f"w{n}" for n in range(len(COMMON_WORDS))]).alias("_by_word"),
        F.col("n").alias("_n_words"),
    )


def js_distance(left: Column, right: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of counts; null if one has no counts."""

    def part(p: Column, q: Column) -> Column:
        half = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / half)).otherwise(0.0) / 2

    def summed(pairs: Column) -> Column:
        return F.sqrt(F.greatest(_total(F.transform(pairs, lambda x: part(x["p"], x["q"]) + part(x["q"], x["p"])), F.lit(0.0)), F.lit(0.0)))

    a, b = _total(left, F.lit(0).cast("long")), _total(right, F.lit(0).cast("long"))
    shares = _let(F.struct(a.alias("a"), b.alias("b")), lambda n: F.zip_with(left, right, lambda p, q: F.struct((p / n["a"]).alias("p"), (q / n["b"]).alias("q"))))
    return F.when((a > 0) & (b > 0), summed(shares))


def judged(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with the feature struct, ``base_failed`` and ``kept`` beside its own columns.

    The featured rows are written once: they give the references and are judged by
    them. A reference is one row per language; the join is left to Spark, which
    broadcasts it by its size or splits the hot language.
    """
    featured = materialize(with_features(docs, text), "quality")
    references = materialize(language_references(featured, lang), "references")
    part = F.col(FEATURES)
    n_words = part["n_words"]
    with_rest = lambda counts, n: F.concat(counts, F.array(n - _total(counts, F.lit(0).cast("long"))))
    far_chars = (part["n_chars"] >= rules.min_chars) & (
        js_distance(part["by_class"], F.col("_by_class")) > rules.max_char_distance
    )
    far_words = (n_words >= rules.min_words_for_distance) & (
        js_distance(with_rest(part["by_word"], n_words), with_rest(F.col("_by_word"), F.col("_n_words"))) > rules.max_word_distance
    )
    failed = (n_words < rules.min_words) | (100 * part["n_repeat_words"] > rules.max_repeat_percent * n_words)
    joined = featured.join(references, F.col(lang).eqNullSafe(F.col("_lang")), "left")
    kept = ~failed & ~F.coalesce(far_chars, F.lit(False)) & ~F.coalesce(far_words, F.lit(False))
    verdicts = joined.withColumns({"base_failed": failed, "kept": kept})
    return verdicts.drop("_lang", "_by_class", "_by_word", "_n_words")


def quality_report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row.

    A null or empty text has no words and fails the base rules. Texts under the
    guards are judged by the base rules alone. Repeated rows get one row each; an
    empty table gives an empty result; columns other than doc_id, text and lang
    are not read.
    """
    verdicts = judged(docs.select("doc_id", "text", "lang"), rules)
    counts = [F.col(FEATURES)[name].alias(name) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return verdicts.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, "base_failed", "kept")


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that are kept, with its own columns.

    Null and empty texts fail the base rules and go; a null language is one of its own;
    repeated rows are judged alike; texts of any length are judged whole; an empty table stays
    empty. Columns other than text and lang travel as one struct, so their names cannot clash.
    """
    own = ("text", "lang")
    held = docs.select(F.struct(*[name for name in docs.columns if name not in own]).alias("others"), *own)
    kept = judged(held, rules).where("kept")
    return kept.select(*[F.col(name) if name in own else F.col("others")[name].alias(name) for name in docs.columns])
