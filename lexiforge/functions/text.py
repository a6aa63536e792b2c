"""String functions on columns. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What text recognition makes of the word oil.
MISSPELLINGS = ("0il", "oi", "ol", "oill", "oll", "oli")


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """The runs of non-space characters; none for a blank text."""
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != "")


def clean_entry(c: Column) -> Column:
    """A dictionary entry without unmatched kinds of parentheses and apostrophes, ampersands as slashes, in lower case."""
    opens, closes = c.contains("("), c.contains(")")
    c = F.when(opens & ~closes, F.replace(c, F.lit("("), F.lit(""))).when(closes & ~opens, F.replace(c, F.lit(")"), F.lit(""))).otherwise(c)
    return F.lower(F.replace(F.replace(c, F.lit(" &"), F.lit("/")), F.lit("'"), F.lit("")))


def clean_word(c: Column) -> Column:
    """Letters, digits, underscores, white space and ( ) : \\ / only, stripped, in lower case."""
    return F.lower(strip(F.regexp_replace(c, r"(?U)[^\w\s():\\/]", "")))


def split_colons(tokens: Column) -> Column:
    """Tokens cut after each colon, which stays with the part before it; parts are stripped."""

    def cut(token: Column) -> Column:
        parts = F.split(token, ":", -1)
        return F.transform(parts, lambda p, i: F.concat(strip(p), F.when(i < F.size(parts) - 1, ":").otherwise("")))

    return F.flatten(F.transform(tokens, cut))


def merge_pairs(tokens: Column) -> Column:
    """Tokens joined with their successor where a word is hyphenated or a parenthesis is open. A joined token isn't looked at again.

    One pass from left to right: held is the token that waits for its successor.
    """
    none = F.lit(None).cast("string")

    def step(state: Column, token: Column) -> Column:
        held, out = state["held"], state["out"]
        hyphen = held.endswith("-")
        bracket = held.contains("(") & ~held.contains(")") & token.contains(")") & ~token.contains("(")
        joined = F.when(hyphen, F.concat(F.left(held, F.length(held) - 1), token)).when(bracket, F.concat(held, F.lit(" "), token))
        return F.struct(
            F.when(held.isNull(), out).when(joined.isNotNull(), F.concat(out, F.array(joined))).otherwise(F.concat(out, F.array(held))).alias("out"),
            F.when(held.isNotNull() & joined.isNotNull(), none).otherwise(token).alias("held"),
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), none.alias("held"))
    return F.aggregate(tokens, start, step, lambda s: F.when(s["held"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(s["held"]))))


def long_words(cleaned: Column) -> Column:
    """The words of more than one character of an array of texts, joined by spaces."""
    return F.array_join(F.filter(F.flatten(F.transform(cleaned, words)), lambda w: F.length(w) > 1), " ")


def clean_tokens(tokens: Column) -> Column:
    """Recognised tokens as one text of clean words."""
    return long_words(F.transform(merge_pairs(split_colons(tokens)), clean_word))


def fix_oil(word: Column) -> Column:
    return F.when(F.lower(word).isin(*MISSPELLINGS), "oil").otherwise(word)


def to_bool(c: Column) -> Column:
    """True and false by their usual spellings; anything else is an error."""
    low = F.lower(c)
    return F.when(low.isin("yes", "true", "t", "y", "1"), True).when(low.isin("no", "false", "f", "n", "0"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), c)).cast("boolean"))


def without_stars(c: Column) -> Column:
    """A label in lower case and stripped, then without asterisks (a blank before one stays)."""
    return F.replace(strip(F.lower(c)), F.lit("*"), F.lit(""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def last_part(c: Column, separator: str) -> Column:
    return F.substring_index(c, separator, -1)
