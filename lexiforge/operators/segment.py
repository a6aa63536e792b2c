"""Segmentation of clean texts into dictionary terms."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

#: Characters of all terms together up to which a dictionary goes to the tasks; a larger one is joined.
SHIPPED = 1_000_000
#: A word: what text.words() gives.
_WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _greedy(matches: Column) -> Column:
    """Of (pos, n, term) matches in order of pos the terms that a left-to-right scan takes: each begins at or after the end of the one before."""
    begin = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, m: Column) -> Column:
        take = m["pos"] >= state["free"]
        return F.struct(
            F.when(take, m["pos"] + m["n"]).otherwise(state["free"]).alias("free"),
            F.when(take, F.concat(state["out"], F.array(m["term"]))).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(matches, begin, step, lambda s: s["out"])


def term_lengths(dictionary: DataFrame) -> list[int]:
    """The numbers of words that the terms have, in order; a term has few words, so there are few of them."""
    n = F.size(text.words(F.col("term"))).alias("n")
    return sorted(r["n"] for r in dictionary.select(n).where("n > 0").distinct().collect())


def ngrams(words: Column, lengths: list[int]) -> Column:
    """(pos, n, term) of all runs of so many words."""
    tried = F.array(*(F.lit(n) for n in lengths)).cast("array<int>")

    def at(pos: Column) -> Column:
        fit = F.filter(tried, lambda n: n <= F.size(words) - pos)
        return F.transform(fit, lambda n: F.struct(pos.alias("pos"), n.alias("n"), F.array_join(F.slice(words, pos + 1, n), " ").alias("term")))

    places = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(places, at))


def taken(words: list[str], terms: frozenset[str], lengths: list[int]) -> list[str]:
    """The terms from left to right, the longest at each place; lengths descend."""
    out, at = [], 0
    while at < len(words):
        for n in lengths:
            term = " ".join(words[at : at + n])
            if at + n <= len(words) and term in terms:
                out.append(term)
                at += n
                break
        else:
            at += 1
    return out


def _shipped(docs: DataFrame, dictionary: DataFrame, key: str, column: str, lengths: list[int]) -> DataFrame | None:
    """key, terms of each text, if the dictionary is small enough to go to the tasks."""
    told = dictionary.select("term").where("term is not null").distinct()
    if (told.agg(F.sum(F.length("term"))).first()[0] or 0) > SHIPPED:
        return None
    held = dictionary.sparkSession.sparkContext.broadcast((frozenset(r["term"] for r in told.collect()), lengths[::-1]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [taken(_WORD.findall(t or ""), *held.value) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(terms, pa.list_(pa.string()))], names=[key, "terms"])

    return docs.select(key, column).mapInArrow(find, T.StructType([docs.schema[key], T.StructField("terms", T.ArrayType(T.StringType()))]))


def longest(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", column: str = "text", most_words: int | None = None) -> DataFrame:
    """key, seq, term: the dictionary terms of each text from left to right, whole words, the longest at each place, without overlaps.

    A dictionary of at most SHIPPED characters goes to the tasks, each of which cuts its own texts. With a larger one
    each place proposes its n-grams, an equi-join with the dictionary keeps those that are terms, and one fold
    a text takes the longest of each place from left to right. N-grams have as many words as some term has;
    most_words asks for an error if a term has more. Keys must be unique.
    """
    lengths = _lengths(dictionary, most_words)
    if found := _shipped(docs, dictionary, key, column, lengths):
        return found.select(key, F.posexplode("terms").alias("seq", "term"))
    split = docs.select(key, text.words(F.col(column)).alias("w"))
    grams = split.select(key, F.explode(ngrams(F.col("w"), lengths)).alias("g")).select(key, "g.*")
    hits = grams.join(dictionary.select("term").distinct(), "term")
    return hits.groupBy(key).agg(_found().alias("m")).select(key, F.posexplode("m").alias("seq", "term"))


def term_lists(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", column: str = "text", most_words: int | None = None) -> DataFrame:
    """key, terms: what longest() finds, as an array for each document, empty ones too. Keys must be unique.

    Where the dictionary is joined, a null n-gram keeps a document without hits in its group, so documents aren't joined again.
    """
    lengths = _lengths(dictionary, most_words)
    if found := _shipped(docs, dictionary, key, column, lengths):
        return found
    split = docs.select(key, text.words(F.col(column)).alias("w"))
    marked = F.concat(F.coalesce(ngrams(F.col("w"), lengths), F.array()), F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("term"))))
    grams = split.select(key, F.explode(marked).alias("g")).select(key, "g.*")
    known = dictionary.select("term").distinct().withColumn("known", F.lit(True))
    hits = grams.join(known, "term", "left").where("known or pos is null")
    return hits.groupBy(key).agg(_found().alias("terms"))


def _lengths(dictionary: DataFrame, most_words: int | None) -> list[int]:
    lengths = term_lengths(dictionary)
    if most_words is not None and lengths and lengths[-1] > most_words:
        raise ValueError(f"the dictionary has terms of {lengths[-1]} words, more than {most_words}")
    return lengths


def _found() -> Column:
    """The terms that a scan takes of a group's hits (pos, n, term): sorted by place, the longest first, so that shorter ones of a place overlap it."""
    hit = F.when(F.col("pos").isNotNull(), F.struct("pos", (-F.col("n")).alias("less"), "n", "term"))
    return _greedy(F.array_sort(F.collect_list(hit)))
