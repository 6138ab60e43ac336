"""Bloom filters as plain columns: rows whose key cannot be wanted go at the scan, before anything is shuffled.

The filter is an array of 64-bit words, made by one aggregate over the wanted keys and
put into the plan as a scalar. Its size is fixed before it is made, so it never
grows with the data; where keys outgrow it, it only lets more rows through. What
passes is still joined, so results do not depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HASHES = 3
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 26  # 8 MB at most


def filter_bits(keys: int) -> int:
    """Bits for about ten times as many as there are keys, a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (10 * max(keys, 1) - 1).bit_length()))


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key.cast("long"), F.lit(seed)), F.lit(bits)) for seed in range(HASHES)]


def _word(place: Column) -> Column:
    return F.shiftright(place, 6).cast("int")


def _mask(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def bloom_filter(keys: DataFrame, key: str, bits: int) -> Column:
    """The filter of a key column as a scalar: ``bits`` / 64 words, combined before their shuffle."""
    spark = keys.sparkSession
    places = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), bits))).alias("place"))
    words = places.groupBy(_word(F.col("place")).cast("long").alias("id")).agg(F.bit_or(_mask(F.col("place"))).alias("word"))
    every = spark.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("word", F.lit(0)).alias("word"))
    return every.agg(F.array_sort(F.collect_list(F.struct("id", "word")))["word"].alias("words")).scalar()


def may_hold(words: Column, key: Column, bits: int) -> Column:
    """False only for keys that were not put in; null keys are none."""
    held = key.isNotNull()
    for place in _places(key, bits):
        held = held & (F.get(words, _word(place)).bitwiseAND(_mask(place)) != 0)
    return held


def prune_events(events: DataFrame, persons: DataFrame, concepts: DataFrame, person: str = "person_id") -> DataFrame:
    """Events of persons and concepts that may be wanted. Two counts size the filters; give it stored frames."""
    sizes = {"persons": filter_bits(persons.count()), "concepts": filter_bits(concepts.count())}
    by_person = bloom_filter(persons, person, sizes["persons"])
    by_concept = bloom_filter(concepts, "concept_id", sizes["concepts"])
    return events.where(
        may_hold(by_concept, F.col("concept_id"), sizes["concepts"]) & may_hold(by_person, F.col("person_id"), sizes["persons"])
    )
