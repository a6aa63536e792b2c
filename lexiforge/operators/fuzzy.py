"""Fuzzy scores of pairs of names, and the pairs that can reach a score.

The score of two names is twice the length of their longest common subsequence over their lengths, in percent, rounded half to even. A common
subsequence is no longer than the letters that both names hold, counted with their repeats. Two names that reach a score share so many of these
counted letters that, put in one order for all, one is among the first few of both: only those, the rarest first, are joined, and a pair is taken at the first one
that both hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Names and pairs that a task remembers.
KEPT = 50_000


def lcs_length(a: str, b: str, masks: dict[str, int]) -> int:
    """Length of the longest common subsequence, a letter of a at a time; masks: the places of each letter in b, as bits. A bit of v is 0 where the subsequence grows."""
    full = (1 << len(b)) - 1
    v = full
    for c in a:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return len(b) - v.bit_count()


def _scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns a and b become their score too. The same two names meet in many keys, so a task remembers what it has scored."""
    masks: dict[str, dict[str, int]] = {}
    known: dict[tuple[str, str], int] = {}
    for batch in batches:
        scores = []
        for pair in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            if pair not in known:
                if len(known) >= KEPT:
                    known.clear()
                    masks.clear()
                a, b = pair
                if b not in masks:
                    places: dict[str, int] = {}
                    for k, c in enumerate(b):
                        places[c] = places.get(c, 0) | 1 << k
                    masks[b] = places
                whole = len(a) + len(b)
                known[pair] = round(Fraction(200 * lcs_length(a, b, masks[b]), whole)) if whole else 100  # half to even
            scores.append(known[pair])
        yield pa.record_batch([*batch.columns, pa.array(scores, pa.int32())], names=[*batch.schema.names, "score"])


def scored(pairs: DataFrame) -> DataFrame:
    """The rows (with names a and b; not null) and their score."""
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in pairs.schema)
    return pairs.mapInArrow(_scorer, f"{kinds}, score int")


def _letters(name: Column) -> Column:
    """Each letter of a name with how often it came before; an empty name has one of its own."""
    single = F.filter(F.split(name, ""), lambda c: c != "")
    told = F.transform(single, lambda c, i: F.concat(c, F.size(F.filter(F.slice(single, 1, i), lambda d: d == c)).cast("string")))
    return F.when(name == "", F.array(F.lit(""))).otherwise(told)


def _first_letters(names: DataFrame, frequency: DataFrame, least: float, side: str) -> DataFrame:
    """key, letter, the side's name and all its letters in order: a row for each of the first letters of a name that a name scoring `least` with it must share.

    With a score of s two names of lengths m and n share at least s (m + n) / 2 letters, and n is at least s m / (2 - s): at least m s / (2 - s), so one of them is
    among any m - m s / (2 - s) + 1 of the first name's.
    """
    s = least / 100
    each = names.select("name").distinct().select("name", F.explode(_letters(F.col("name"))).alias("letter"))
    ordered = each.join(frequency, "letter", "left").groupBy("name").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "letter")))["letter"].alias("o"))
    many = F.size("o") - F.ceil(F.size("o") * s / (2 - s) - 1e-9) + 1
    cut = ordered.select("name", F.col("o").alias(f"{side}_letters"), F.explode(F.slice("o", 1, F.greatest(F.lit(1), many).cast("int"))).alias("letter"))
    return names.join(cut, "name").select("key", "letter", F.col("name").alias(side), f"{side}_letters")


def candidates(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """key, a, b: the pairs of names of one key (left and right: key, name; distinct, not null) that may score at least `least`, 1 to 100; each once."""
    if not 0 < least <= 100:
        raise ValueError("the score must be from 1 to 100")
    reach = least - 0.5  # what rounds to it
    frequency = right.select("name").distinct().select(F.explode(_letters(F.col("name"))).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    a, b = (_first_letters(x, frequency, reach, side) for x, side in ((left, "a"), (right, "b")))
    m, n = F.length("a"), F.length("b")
    both = a.join(b, ["key", "letter"]).where(2 * F.least(m, n) * 100 >= reach * (m + n))
    shared = F.array_intersect("a_letters", "b_letters")
    return both.where((shared[0] == F.col("letter")) & (200 * F.size(shared) >= reach * (m + n))).select("key", "a", "b")


def alike(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """key, a, b, score: the candidates that score at least `least`."""
    return scored(candidates(left, right, least)).where(F.col("score") >= least)
