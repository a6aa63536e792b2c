"""Nearest-key joins on dense vectors, and typo correction with sparse ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nearest

#: Bytes of keys that go to every executor; more are dealt into blocks.
BLOCK_BYTES = 32_000_000
#: Queries, and keys, whose products are in memory at a time.
TILE = 1024
_SCHEMA = "query_id {q}, key_id {k}, score double"


def _matrix(column) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


def _best(q: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the key of the largest inner product, ties to the smaller id; ids ascend."""
    at, score = np.zeros(len(q), dtype=np.int64), np.full(len(q), -np.inf)
    for k in range(0, len(q), TILE):
        rows = np.arange(k, min(k + TILE, len(q)))
        for j in range(0, len(keys), TILE):
            s = np.round(q[k : k + TILE] @ keys[j : j + TILE].T, 11)
            best = s.argmax(axis=1)
            value = s[np.arange(len(s)), best]
            over = (value > score[rows]) | (j == 0)
            at[rows[over]], score[rows[over]] = j + best[over], value[over]
    return ids[at], score


def top1(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """query_id, key_id, score: the key with the largest inner product for each query, ties to the smaller key. queries: id, embedding; keys: id, embedding (same dimension: others are an error). Vectors that are null, empty or hold null or NaN take no part.

    Keys up to BLOCK_BYTES are broadcast. More are dealt into blocks: every query meets every block, and the best of
    the blocks' bests is taken. Equal queries should be made distinct before.
    """
    spark = queries.sparkSession
    kinds = {"q": queries.schema["id"].dataType.simpleString(), "k": keys.schema["id"].dataType.simpleString()}
    whole = lambda df: df.where(F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)) & (F.size("embedding") > 0), F.lit(False))).select("id", "embedding")
    queries, keys = whole(queries), whole(keys)
    size = keys.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"), F.min(F.size("embedding")).alias("least")).first()
    if size["n"] and size["d"] != size["least"]:
        raise ValueError(f"keys of {size['least']} and of {size['d']} dimensions")
    if not size["n"]:
        return spark.createDataFrame([], _SCHEMA.format(**kinds))
    blocks = -(-size["n"] * size["d"] * 8 // BLOCK_BYTES)
    if blocks == 1:
        table = keys.orderBy("id").toArrow()
        held = spark.sparkContext.broadcast((_matrix(table.column("embedding")), table.column("id").to_numpy()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ids, score = _best(_matrix(batch.column("embedding")), *held.value)
                    yield pa.record_batch({"query_id": batch.column("id"), "key_id": pa.array(ids), "score": pa.array(score)})

        return queries.mapInArrow(run, _SCHEMA.format(**kinds))

    def block(k: pa.Table, q: pa.Table) -> pa.Table:
        if not k.num_rows or not q.num_rows:
            return pa.table({"query_id": q.column("id").slice(0, 0), "key_id": k.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        k = k.sort_by("id")
        ids, score = _best(_matrix(q.column("embedding")), _matrix(k.column("embedding")), k.column("id").to_numpy())
        return pa.table({"query_id": q.column("id"), "key_id": pa.array(ids), "score": pa.array(score)})

    dealt = keys.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # queries are sliced as well, so that a block's queries never meet in one task
    slices = max(1, -(-queries.count() // 65_536))
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int"))
    dealt = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    each = dealt.groupBy("block", "slice").cogroup(asked.groupBy("block", "slice")).applyInArrow(block, _SCHEMA.format(**kinds))
    best = each.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("key_id").alias("k"))).alias("b"))
    return best.select("query_id", F.col("b.k").alias("key_id"), (-F.col("b.s")).alias("score"))


def above(matches: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Matches that reach the threshold."""
    return matches.where(F.col("score") >= F.lit(threshold))


class NgramEncoder:
    """Texts as unit vectors of hashed character n-grams: a local stand-in for a sentence encoder. The vectors are sparse, so the dimension may be large, and n-grams rarely meet."""

    def __init__(self, dimension: int = 1 << 20, low: int = 2, high: int = 3) -> None:
        self.dimension, self.low, self.high = dimension, low, high

    def encode_sparse(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for t in texts:
            t, held = f"^{t}$", dict[int, float]()
            for n in range(self.low, self.high + 1):
                for i in range(len(t) - n + 1):
                    h = int.from_bytes(hashlib.blake2b(t[i : i + n].encode(), digest_size=8).digest(), "little")
                    held[h % self.dimension] = held.get(h % self.dimension, 0.0) + (1.0 if h >> 63 else -1.0)
            features = np.array(sorted(f for f, w in held.items() if w), dtype=np.int64)
            weights = np.array([held[f] for f in features])
            out.append((features, weights / (np.sqrt((weights * weights).sum()) or 1.0)))
        return out

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, (features, weights) in zip(out, self.encode_sparse(texts), strict=True):
            row[features] = weights
        return out


class LetterEncoder:
    """Texts as unit vectors of how often each letter from a to z occurs."""

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.array([[t.count(chr(97 + k)) for k in range(26)] for t in texts], dtype=np.float64).reshape(-1, 26)
        return out / np.maximum(1e-300, np.sqrt((out * out).sum(axis=1, keepdims=True)))


def encoded(words: DataFrame, column: str, encoder=None) -> DataFrame:
    """id (the text) and embedding of each distinct text."""
    encoder = encoder or NgramEncoder(256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("id").to_pylist()
            vectors = encoder.encode(texts) if texts else []
            yield pa.record_batch({"id": batch.column("id"), "embedding": pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float64()))})

    return words.select(F.col(column).alias("id")).where("id is not null").distinct().mapInArrow(run, "id string, embedding array<double>")


def corrected(words: DataFrame, column: str, vocabulary: DataFrame, threshold: float = 0.8, encoder=None, index: DataFrame | None = None) -> DataFrame:
    """word, corrected for each distinct word: its nearest word of the vocabulary if that is near enough, else itself; known misreadings of oil become oil.

    A word of the vocabulary is its own nearest word, so only the others are searched for, by an inverted index. index: the vocabulary's vectors, if they are at hand (see
    nearest.sparse and refresh.vector_index).
    """
    from ..functions import text

    every = words.select(F.col(column).alias("word")).where("word is not null").distinct()
    both = every.join(replacements(every, "word", vocabulary, threshold, encoder, index), "word", "left")
    return both.select("word", text.fix_oil(F.coalesce("nearest", "word")).alias("corrected"))


def replacements(words: DataFrame, column: str, vocabulary: DataFrame, threshold: float = 0.8, encoder=None, index: DataFrame | None = None) -> DataFrame:
    """word, nearest of each distinct word that the vocabulary lacks and that has a word near enough there."""
    encoder = encoder or NgramEncoder()
    every = words.select(F.col(column).alias("word")).where("word is not null").distinct()
    unknown = every.join(vocabulary.select("word").distinct(), "word", "left_anti")
    near = nearest.nearest_above(nearest.sparse(unknown, "word", encoder), nearest.sparse(vocabulary, "word", encoder) if index is None else index, threshold)
    return near.select(F.col("query_id").alias("word"), F.col("key_id").alias("nearest"))


def corrected_texts(docs: DataFrame, vocabulary: DataFrame, key: str, column: str = "text", threshold: float = 0.8, encoder=None, index: DataFrame | None = None) -> DataFrame:
    """key, column: the texts with each word corrected, joined by single blanks; an empty text for a null one. Each distinct word is corrected once; keys must be unique.

    Texts are grouped once, by key. Where corrections are few enough for Spark to broadcast, that is the only shuffle of the texts, and
    what groups by key afterwards needs none.
    """
    from ..functions import text

    places = docs.select(key, F.posexplode_outer(text.words(F.col(column))).alias("pos", "word"))
    fixed = replacements(places, "word", vocabulary, threshold, encoder, index)
    word = text.fix_oil(F.coalesce("nearest", "word"))
    changed = places.join(fixed, "word", "left").select(key, F.when(F.col("word").isNotNull(), F.struct("pos", word.alias("w"))).alias("p"))
    return changed.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["w"]), " ").alias(column))


def verified(items: DataFrame, value: str, index: DataFrame, threshold: float = 0.8, encoder=None, keep: bool = False) -> DataFrame:
    """The items whose nearest token of the index (id, features, weights) is near enough, with that token in their place; all others go, or, with keep, stay as nulls.

    An item that is itself a token is its own nearest one, so only the others are searched for.
    """
    asked = items.select(F.col(value).alias("asked")).where("asked is not null").distinct()
    known = index.select(F.col("id").alias("known"))
    unknown = asked.join(known, F.col("asked") == F.col("known"), "left_anti")
    near = nearest.nearest_above(nearest.sparse(unknown, "asked", encoder or NgramEncoder()), index, threshold).select(F.col("query_id").alias("asked"), F.col("key_id").alias("token"))
    told = asked.join(known, F.col("asked") == F.col("known"), "left_semi").withColumn("token", F.col("asked")).unionByName(near)
    both = items.join(told, items[value] == told["asked"], "left" if keep else "inner")
    return both.select(*(told["token"].alias(value) if c == value else items[c] for c in items.columns))
