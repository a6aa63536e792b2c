"""Building the dictionary, its vocabulary and the synonym tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grammar, text


def terms(raw: DataFrame, column: str = "name", keep_nulls_as_none: bool = False) -> DataFrame:
    """term: distinct stripped, lower-case names of more than two characters. Null cells go, or become the word none."""
    c = F.col(column)
    c = F.coalesce(c, F.lit("none")) if keep_nulls_as_none else c
    return raw.select(F.lower(text.strip(c)).alias("term")).where(F.length("term") > 2).distinct()


def expanded(names: DataFrame, simple: bool = True) -> DataFrame:
    """term: cleaned names (simple), or all names that each stands for. Pieces of two characters or fewer go. Not distinct."""
    if simple:
        return names.select(text.clean_entry(F.col("term")).alias("term"))
    return names.select(F.explode(grammar.expand(F.col("term"))).alias("term")).where(F.length("term") > 2)


def merged(*sources: DataFrame) -> DataFrame:
    """The set union of several columns of terms."""
    out = sources[0].select("term")
    for s in sources[1:]:
        out = out.union(s.select("term"))
    return out.distinct()


def combined(dictionary: DataFrame, synonyms: DataFrame) -> DataFrame:
    """All dictionary terms, doubles kept, and the distinct synonyms in lower case, which may repeat terms; with their source."""
    a = dictionary.select(F.lower("term").alias("term"), F.lit("dictionary").alias("source"))
    b = synonyms.select(F.lower("synonym_raw").alias("term")).distinct().select("term", F.lit("synonym").alias("source"))
    return a.unionByName(b)


def vocabulary(tokens: DataFrame) -> DataFrame:
    """word: the distinct words of all terms."""
    return tokens.select(F.explode(text.words(F.lower("term"))).alias("word")).distinct()


def exploded_synonyms(sheet: DataFrame) -> DataFrame:
    """seq, synonym_raw, canonical: a row for each line of the synonym cells; seq orders rows and lines."""
    lines = sheet.where("synonyms is not null").select("row", "canonical", F.posexplode(F.split("synonyms", "\n", -1)).alias("line", "synonym_raw"))
    return lines.select(F.struct("row", "line").alias("seq"), "synonym_raw", "canonical")


def synonym_map(synonyms: DataFrame, order: Column | str = "seq") -> DataFrame:
    """synonym, canonical: of synonyms that are equal when stripped and in lower case the last one counts."""
    key = F.lower(text.strip(F.col("synonym_raw"))).alias("synonym")
    return synonyms.groupBy(key).agg(F.max_by("canonical", order).alias("canonical"))
