"""Segmentation character by character, over a relation of all prefixes of the dictionary's terms.

From each place of a text the walk goes on as long as what it has read begins some term. What matters of it are how far it goes and the longest term on
the way. Both come from equi-joins of the text's substrings with the prefixes, a few lengths at a time: only places whose walk has gone
through all lengths so far are joined with the next ones, so most places are joined with the first few lengths only. One pass over a text's places
from left to right then cuts it. So the dictionary may be of any size. The prefixes of one of at most SHIPPED characters go to the tasks instead, and
only places at which a piece may begin are walked from.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters joined in the first step; each later one goes as far again as all before it.
STRIDE = 4
#: Characters of all terms together, and so at most prefixes, up to which these go to the tasks.
SHIPPED = 200_000


def prefixes(dictionary: DataFrame) -> DataFrame:
    """prefix, is_term: each beginning of a term once."""
    terms = dictionary.select("term").where(F.length("term") > 0).distinct()
    each = terms.select(F.explode(F.sequence(F.lit(1), F.length("term"))).alias("n"), "term")
    return each.groupBy(F.left("term", F.col("n")).alias("prefix")).agg(F.max(F.col("n") == F.length("term")).alias("is_term"))


_PIECES = pa.list_(pa.struct([("piece", pa.string()), ("is_term", pa.bool_())]))
_TEXT = ["h", "i"]  # 128 bits of a text's hash stand for it in the joins


def walks(texts: DataFrame, known: DataFrame, longest: int) -> DataFrame:
    """h, i, at, walked, term: of each place of each text (h, i, t) whose character begins a term, the characters walked and the length of the longest term on the way (0 if none); a row for each step of a place, the last one with the most walked."""
    size = F.length("t") - F.col("at")
    place = texts.select(*_TEXT, "t", F.explode(F.sequence(F.lit(0), F.length("t") - 1)).alias("at"))
    # what is left of the text from the place on, no longer than a term can be
    place = place.select(*_TEXT, "at", F.substr("t", F.col("at") + 1, F.least(size, F.lit(longest))).alias("rest"))
    low, step, parts = 0, STRIDE, []
    while low < longest:
        high = min(low + step, longest)
        tried = F.sequence(F.lit(low + 1), F.least(F.lit(high), F.length("rest")))
        ask = place.where(F.length("rest") > low).select(*_TEXT, "at", "rest", F.explode(tried).alias("n")).withColumn("prefix", F.left("rest", F.col("n")))
        found = ask.join(known, "prefix").groupBy(*_TEXT, "at").agg(F.max("n").alias("walked"), F.max(F.when(F.col("is_term"), F.col("n"))).alias("term"), F.first("rest").alias("rest"))
        parts.append(found.select(*_TEXT, "at", "walked", F.coalesce("term", F.lit(0)).alias("term")))
        place = found.where(F.col("walked") == high).select(*_TEXT, "at", "rest")
        low, step = high, high
    if not parts:
        return place.select(*_TEXT, "at", F.lit(0).alias("walked"), F.lit(0).alias("term")).where("false")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def cut(s: str, walk: dict[int, tuple[int, int]] | Walk) -> list[tuple[str, bool]]:
    """The pieces of s and whether each is a term. walk: characters walked and the longest term's length, by place.

    A term takes the one character after it along. A walk that meets the end of the text short of a term gives nothing and goes on at the
    next character. Text that begins no term is gathered: first its first word, then all that is walked, up to the next term.
    """
    out: list[tuple[list[str], bool]] = []
    at = 0
    while at < len(s):
        walked, term = walk.get(at, (0, 0))
        if at + walked == len(s):
            if term == walked:
                out.append(([s[at:]], True))
                break
            at += 1
        elif term:
            found = s[at : at + term].strip()
            out.append(([found], True))
            at += len(found) + 1
        else:
            seen = s[at : at + walked + 1]
            if out and not out[-1][1]:
                out[-1][0].append(seen)
                at += len(seen)
            elif seen.strip():
                first = seen.split()[0]
                out.append(([first], False))
                at += len(first)
            else:
                at += 1
    return [("".join(p).strip(), t) for p, t in out]


class Walk:
    """walks() of one text, from the places asked for. known: each prefix of a term, and whether it is one."""

    def __init__(self, s: str, known: dict[str, bool]) -> None:
        self.s, self.known = s, known

    def get(self, at: int, default: tuple[int, int]) -> tuple[int, int]:
        walked, term = default
        for end in range(at + 1, len(self.s) + 1):
            is_term = self.known.get(self.s[at:end])
            if is_term is None:
                break
            walked = end - at
            term = walked if is_term else term
        return walked, term


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, found = batch.column("t").to_pylist(), []
        for t, walk in zip(texts, batch.column("w").to_pylist(), strict=True):
            far: dict[int, tuple[int, int]] = {}
            for x in walk:
                known = far.get(x["at"], (0, 0))
                far[x["at"]] = max(known[0], x["walked"]), max(known[1], x["term"])
            found.append(cut(t, far))
        pieces = pa.array([[{"piece": p, "is_term": k} for p, k in f] for f in found], _PIECES)
        yield pa.record_batch([batch.column("h"), batch.column("i"), pieces], names=["h", "i", "p"])


def by_characters(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, seq, piece, is_term: the pieces of each text, character by character (see cut). A null or empty text has no pieces. Where the dictionary is joined, equal texts are cut once."""
    terms = dictionary.select("term").where(F.length("term") > 0).distinct()
    if (terms.agg(F.sum(F.length("term"))).first()[0] or 0) <= SHIPPED:
        held = docs.sparkSession.sparkContext.broadcast({r["prefix"]: r["is_term"] for r in prefixes(dictionary).collect()})

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [[{"piece": p, "is_term": k} for p, k in cut(t, Walk(t, held.value))] for t in (x or "" for x in batch.column(1).to_pylist())]
                yield pa.record_batch([batch.column(0), pa.array(found, _PIECES)], names=[key, "p"])

        kind = T.StructType([docs.schema[key], T.StructField("p", T.ArrayType(T.StructType([T.StructField("piece", T.StringType()), T.StructField("is_term", T.BooleanType())])))])
        cut_up = docs.select(key, column).mapInArrow(pieces, kind)
        return cut_up.select(key, F.posexplode("p").alias("seq", "p")).select(key, "seq", "p.piece", "p.is_term")
    longest = dictionary.agg(F.max(F.length("term"))).first()[0] or 0  # how many steps the plan has
    asked = docs.select(key, F.col(column).alias("t")).where(F.length("t") > 0).withColumns({"h": F.xxhash64(F.lit(1), "t"), "i": F.xxhash64(F.lit(2), "t")})
    texts = asked.groupBy(*_TEXT).agg(F.first("t").alias("t"))
    walked = walks(texts, prefixes(dictionary), longest).groupBy(*_TEXT).agg(F.collect_list(F.struct("at", "walked", "term")).alias("w"))
    none = F.array().cast("array<struct<at:int,walked:int,term:int>>")
    cut_up = texts.join(walked, _TEXT, "left").select(*_TEXT, "t", F.coalesce("w", none).alias("w")).mapInArrow(_cutter, "h long, i long, p array<struct<piece:string,is_term:boolean>>")
    return asked.join(cut_up, _TEXT).select(key, F.posexplode("p").alias("seq", "p")).select(key, "seq", "p.piece", "p.is_term")
