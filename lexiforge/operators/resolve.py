"""From tokens to ingredients and substances of concern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import dictionary as dictionaries
from . import refresh, segment, vector_join


def ordered_distinct(items: DataFrame, key: str, value: str, order: str = "seq") -> DataFrame:
    """Each value of a group once, at its first place."""
    return items.groupBy(key, value).agg(F.min(order).alias(order))


def without_redundant(items: DataFrame, key: str, value: str, order: str = "seq") -> DataFrame:
    """Items that aren't a word of the item before them. The first and the last item of a group stay, and so do all after an item of one word. Null items stand apart and stay."""
    along = Window.partitionBy(key, F.col(value).isNull()).orderBy(order)
    before = text.words(F.lag(value).over(along))
    drop = F.lead(value).over(along).isNotNull() & (F.size(before) > 1) & F.array_contains(before, F.col(value))
    return items.withColumn("drop_item", F.coalesce(drop, F.lit(False))).where("not drop_item").drop("drop_item")


def _not_redundant(values: str) -> Column:
    """What without_redundant() leaves of an array (a column's name) without nulls."""
    a = F.col(values)

    def stays(v: Column, i: Column) -> Column:
        before = F.split(text.strip(F.get(a, i - 1)), r"(?U)\s+")
        return F.coalesce((i == 0) | (i == F.size(a) - 1) | (F.size(before) < 2) | ~F.array_contains(before, v), F.lit(True))

    return F.filter(a, stays)


def canonicals(items: DataFrame, synonym_map: DataFrame, key: str, value: str, order: str = "seq") -> DataFrame:
    """key, canonical, seq: the substances that the items name, each once a group, in order of first mention."""
    known = synonym_map.select(F.col("synonym").alias("named"), "canonical")
    hits = items.join(known, text.strip(F.col(value)) == F.col("named"))
    return hits.groupBy(key, "canonical").agg(F.min(order).alias(order))


def resolved(docs: DataFrame, dictionary: DataFrame, synonym_map: DataFrame | None, key: str = "doc_id", tokens: str = "tokens", most_words: int | None = None,
             correct: bool = True, word_threshold: float = 0.8, token_threshold: float = 0.8, encoder=None, word_index: DataFrame | None = None, token_index: DataFrame | None = None) -> DataFrame:
    """key, ingredients, pollutants (arrays, in order) of each document with at least one ingredient or not: documents without get empty arrays. Keys must be unique. synonym_map None: no pollutants are looked for.

    Words are corrected by the nearest word of the dictionary before the text is segmented. Terms are then verified
    against token_index (id, features, weights; see nearest.sparse and refresh.vector_index); without one the dictionary itself would be the
    index, and each term its own nearest token, so the step is left out. word_index: vectors of the dictionary's words, if at hand.

    A document stays in its rows from the first grouping by key on, as a null term where it has none, so that documents are read once for
    the distinct words and once for all else.
    """
    clean = docs.select(key, text.clean_tokens(F.col(tokens)).alias("text"))
    if correct:
        clean = vector_join.corrected_texts(clean, dictionaries.vocabulary(dictionary), key, "text", word_threshold, encoder, word_index)
    found = segment.term_lists(clean, dictionary, key, "text", most_words)
    if token_index is not None:
        each = found.select(key, F.posexplode_outer("terms").alias("seq", "term"))
        each = vector_join.verified(each, "term", token_index, token_threshold, encoder, keep=True)
        some = F.when(F.col("term").isNotNull(), F.struct("seq", "term"))
        found = each.groupBy(key).agg(F.array_sort(F.collect_list(some)).alias("x")).select(key, F.col("x.term").alias("terms"))
    once = found.select(key, F.array_distinct("terms").alias("terms"))
    items = once.select(key, F.posexplode_outer(_not_redundant("terms")).alias("seq", "term"))
    if synonym_map is None:
        named = items.withColumn("canonical", F.lit(None).cast("string"))
    else:
        known = synonym_map.select(F.col("synonym").alias("named"), "canonical")
        named = items.join(known, text.strip(F.col("term")) == F.col("named"), "left")
    item = F.when(F.col("term").isNotNull(), F.struct("seq", "term", "canonical"))
    lists = named.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("x"))
    return lists.select(key, F.col("x.term").alias("ingredients"), F.array_distinct(F.filter(F.col("x.canonical"), lambda c: c.isNotNull())).alias("pollutants"))


def indexes(dictionary: DataFrame, folder: str, encoder=None) -> dict[str, DataFrame]:
    """word_index and token_index of a dictionary for resolved(), from the folder's versions: only what is new in the dictionary is encoded."""
    return {
        "word_index": refresh.vector_index(dictionaries.vocabulary(dictionary), "word", folder, "words", encoder),
        "token_index": refresh.vector_index(dictionary, "term", folder, "tokens", encoder),
    }


def response(resolved_docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, body: the JSON answer, whose lists are each wrapped in a list."""
    return resolved_docs.select(key, F.to_json(F.struct(F.col(key).cast("string").alias("image_name"), F.array("ingredients").alias("ingredients"), F.array("pollutants").alias("pollutants"))).alias("body"))
