"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent between 0 and 1 and normalised. The exponent is bisected: it is the
largest whose weights reach the target entropy, unless some source would then be repeated more often than the
limit; then it is the smallest that keeps the limit. A source's weight times the budget of tokens is realised as whole
passes over the source and the beginning of one more; each pass is a permutation of the source's blocks, and of the
documents within each block.

Only the block in which a source's budget ends is ranked document by document. Blocks are hash slices of a
source, at least BLOCKS each and more as the table grows, so that a block of any source holds about BLOCK_ROWS documents at most.

A row a source comes to the driver, for the weights depend on all of them; sources are expected to number thousands, not millions.

Defined cases: a null source is a source of its own, named "". A document without words costs nothing and comes in each
pass its block is in. Repeated rows are documents of their own; ties in order go to the smaller doc_id.
A row without doc_id is placed like any other. An empty table, or one without words, gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _io

BLOCKS, BLOCK_ROWS = 256, 65_536
#: Of the entropy of equal weights.
TARGET_ENTROPY = 0.97
#: Passes over any one source at most.
MAX_REPEATS = 4.0
#: Tokens to place, as a share of all there are.
BUDGET = 1.0
SEED = 17


def n_tokens(text: Column) -> Column:
    """Words of a text, at white space."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, "[ \\t-\\r]+"))).cast("long")


def weights(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent for s, n in tokens.items() if n}
    whole = math.fsum(raw.values())
    return {s: x / whole for s, x in raw.items()}


def _entropy(w: dict[str, float]) -> float:
    return -math.fsum(x * math.log(x) for x in w.values() if x)


def _bisect(holds_low: bool, test) -> float:
    """The edge in 0 to 1 up to which (holds_low) or from which test holds; test is monotone."""
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if test(mid) == holds_low:
            low = mid
        else:
            high = mid
    return low if holds_low else high


def exponent(tokens: dict[str, int], budget: float, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> float:
    tokens = {s: n for s, n in tokens.items() if n}
    goal = target_entropy * math.log(len(tokens)) if len(tokens) > 1 else 0.0
    even = 1.0 if _entropy(weights(tokens, 1.0)) >= goal else _bisect(True, lambda t: _entropy(weights(tokens, t)) >= goal)
    limit = lambda t: max(w * budget / tokens[s] for s, w in weights(tokens, t).items()) <= max_repeats
    calm = 0.0 if limit(0.0) else _bisect(False, limit)
    return max(even, calm)


def budgets(tokens: dict[str, int], budget: int, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> dict[str, int]:
    """Tokens to place from each source: whole numbers that sum to the budget, by largest remainders."""
    if not any(tokens.values()):
        return {}
    w = weights(tokens, exponent(tokens, budget, target_entropy, max_repeats))
    out = {s: math.floor(x * budget) for s, x in w.items()}
    for s in sorted(w, key=lambda s: (out[s] - w[s] * budget, s))[: budget - sum(out.values())]:
        out[s] += 1
    return out


def placed(docs: DataFrame, share: float = BUDGET, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """doc_id, source, n_tokens, copy (from 0), block_place (of its block in that pass) and draw (its order in the block) of each placing of a document."""
    spark = docs.sparkSession
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), n_tokens(F.col("text")).alias("n_tokens"))
    counted, _ = _io.stored(counted, "mix-tokens")
    n_blocks = max(BLOCKS, -(-counted.count() // BLOCK_ROWS))
    counted = counted.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(n_blocks)).cast("int"))
    blocks, _ = _io.stored(counted.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")), "mix-blocks")
    tokens = {r["source"]: r["n"] for r in blocks.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # a row a source
    goal = budgets(tokens, round(share * sum(tokens.values())), target_entropy, max_repeats)
    plan = spark.createDataFrame([(s, b, b // tokens[s], b % tokens[s]) for s, b in sorted(goal.items())] or [], "source string, goal long, passes long, rest long")
    # each pass is a permutation of the blocks; in the last pass they are taken until the rest of the budget is used up
    per_pass = blocks.join(plan, "source").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int"))))
    order = Window.partitionBy("source", "copy").orderBy(F.xxhash64(F.lit(SEED), "source", "copy", "block"), "block")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_pass = per_pass.withColumns({"block_place": F.row_number().over(order), "before": F.sum("n").over(upto) - F.col("n")})
    left = F.when(F.col("copy") < F.col("passes"), F.col("n")).otherwise(F.col("rest") - F.col("before"))
    chosen = per_pass.withColumn("left", left).where("copy < passes or left > 0").select("source", "block", "copy", "block_place", "n", "left")
    # a block is a small part of its source, so the join deals even one large source out evenly
    rows = counted.join(chosen, ["source", "block"]).withColumn("draw", F.xxhash64(F.lit(SEED), "copy", "doc_id"))
    whole = rows.where("left >= n")
    inner = Window.partitionBy("source", "copy", "block").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = rows.where("left < n").withColumn("upto", F.sum("n_tokens").over(inner)).where("upto <= left").drop("upto")
    return whole.union(part).select("doc_id", "source", "n_tokens", "copy", "block_place", "draw")


def mixed(docs: DataFrame, share: float = BUDGET, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """The documents as often as they are placed, with the columns of docs. Rows that share a doc_id are placed together."""
    times = placed(docs.select("doc_id", "source", "text"), share, target_entropy, max_repeats)
    times = times.groupBy("doc_id", "copy").agg(F.lit(1)).groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    # the row is one column of the join, so that its names can't clash
    rows = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    placed_rows = rows.join(times, F.col("own_id").eqNullSafe(F.col("doc_id"))).select("row", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return placed_rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))
