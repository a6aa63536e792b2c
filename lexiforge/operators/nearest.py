"""Nearest keys among sparse vectors by an inverted index, without comparing all pairs.

Vectors have features (ascending whole numbers) and weights, and a length of at most one. Two vectors whose inner product reaches a threshold t
share a feature early in both, if features are put in one order for all: past the place where the rest of a vector is shorter
than t, nothing can bring the product to t. So only these first features, the rarest ones first, are joined. A pair is taken at the first feature
that both hold, so that it comes once, and its product is worked out exactly. Results are those of comparing all pairs.

All of it is one lazy plan: no job runs before an action, and nothing is broadcast but what Spark finds small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What rounding may add to a product or a length.
SLACK = 1e-9
VECTORS = "id string, features array<int>, weights array<double>"


def sparse(words: DataFrame, column: str, encoder) -> DataFrame:
    """id (the text), features, weights of each distinct text. An encoder has encode_sparse(texts), (features, weights) for each, or encode(texts), a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("id").to_pylist()
            if not texts:
                continue
            if hasattr(encoder, "encode_sparse"):
                made = encoder.encode_sparse(texts)
            else:
                made = [(np.flatnonzero(v), v[np.flatnonzero(v)]) for v in encoder.encode(texts)]
            sizes = np.cumsum([0, *(len(f) for f, _ in made)])
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.asarray(x[k]) for x in made]), kind)) for k, kind in ((0, pa.int32()), (1, pa.float64()))]
            yield pa.record_batch([batch.column("id"), *lists], names=["id", "features", "weights"])

    return words.select(F.col(column).alias("id")).where("id is not null").distinct().mapInArrow(run, VECTORS)


def _first_features(ordered: Column, threshold: float) -> Column:
    """Of entries (n, f, w) in order the features up to where the rest is shorter than the threshold."""
    length = F.aggregate(ordered, F.lit(0.0), lambda s, e: s + e["w"] * e["w"])
    start = F.struct(length.alias("rest"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, e: Column) -> Column:
        more = state["rest"] >= threshold * threshold - SLACK
        return F.struct((state["rest"] - e["w"] * e["w"]).alias("rest"), F.when(more, F.concat(state["out"], F.array(e["f"]))).otherwise(state["out"]).alias("out"))

    return F.aggregate(ordered, start, step, lambda s: s["out"])


def _indexed(vectors: DataFrame, frequency: DataFrame, threshold: float, side: str) -> DataFrame:
    """f, and the side's id, features and weights in order of frequency: a row for each of a vector's first features."""
    each = vectors.select("id", F.explode(F.arrays_zip("features", "weights")).alias("e")).select("id", F.col("e.features").alias("f"), F.col("e.weights").alias("w"))
    lists = each.join(frequency, "f").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "f", "w"))).alias("o"))
    long = F.aggregate("o", F.lit(0.0), lambda s, e: s + e["w"] * e["w"]) > 1 + SLACK
    lists = lists.withColumn("o", F.when(long, F.raise_error("a vector is longer than one").cast("array<struct<n:bigint,f:int,w:double>>")).otherwise(F.col("o")))
    return lists.select(F.explode(_first_features(F.col("o"), threshold)).alias("f"), F.col("id").alias(f"{side}_id"), F.col("o.f").alias(f"{side}_f"), F.col("o.w").alias(f"{side}_w"))


def candidates(queries: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """query_id, key_id and both vectors of the pairs that must be compared; each once. queries and keys: id, features, weights."""
    if not threshold > 0:
        raise ValueError("the threshold must be above 0")
    frequency = keys.select(F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    pairs = _indexed(queries, frequency, threshold, "query").join(_indexed(keys, frequency, threshold, "key"), "f")
    return pairs.where(F.array_intersect("query_f", "key_f")[0] == F.col("f")).drop("f")


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        entries = {}
        for side in ("query", "key"):
            features, weights = batch.column(f"{side}_f"), batch.column(f"{side}_w")
            row = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(features).to_numpy())
            place = row << 32 | features.flatten().to_numpy().astype(np.int64)
            order = np.argsort(place)
            entries[side] = place[order], weights.flatten().to_numpy()[order], row
        (a, x, row), (b, y, _) = entries["query"], entries["key"]
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        score = np.bincount(row, np.where(b[at] == a, x * y[at], 0.0), batch.num_rows)  # rows stay in order under the sort
        yield pa.record_batch([batch.column("query_id"), batch.column("key_id"), pa.array(np.round(score, 11))], names=["query_id", "key_id", "score"])


def nearest_above(queries: DataFrame, keys: DataFrame, threshold: float = 0.8) -> DataFrame:
    """query_id, key_id, score of each query whose nearest key reaches the threshold: the largest inner product, ties to the smaller key. A vector without features takes no part."""
    scored = candidates(queries, keys, threshold).mapInArrow(_products, "query_id string, key_id string, score double").where(F.col("score") >= F.lit(threshold))
    best = scored.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("key_id").alias("k"))).alias("b"))
    return best.select("query_id", F.col("b.k").alias("key_id"), (-F.col("b.s")).alias("score"))
