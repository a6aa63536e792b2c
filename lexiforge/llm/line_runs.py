"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

LineRuns holds what has been seen as runs: tables of 128-bit line hashes and the smallest document that holds
each, sorted by hash. A batch of documents merge-joins the runs; hashes without a match become a run
of their own on level 0, and FANOUT runs of a level are compacted into one of the next. Batches come in
ascending ranges of doc_id, so a hash's first owner is its smallest document.

Hot lines: a batch is reduced to one row a hash before it is shuffled. The one join that meets a hot line in
all its documents is a plain equi-join, which adaptive execution splits.

Defined cases: a null or empty text is one empty line. A line shorter than MIN_KEY after normalising is
always kept. Rows that share a doc_id are one document (each row with lines of its own). Rows without
doc_id keep all lines and own none. An empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _io

BATCHES = 4
FANOUT = 3
MIN_KEY = 10
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = "h1 long, h2 long, owner long"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Runs of line hashes on levels."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[tuple[DataFrame, str]]] = []

    def seen(self) -> DataFrame:
        """h1, h2, owner of all hashes so far."""
        out = self.spark.createDataFrame([], _RUN)
        for run, _ in (x for level in self.levels for x in level):
            out = out.union(run)
        return out

    def add(self, lines: DataFrame) -> DataFrame:
        """Takes a batch (h1, h2, doc_id), whose doc_ids are larger than those of all batches before. Returns h1, h2, owner of its hashes that two documents or more hold so far."""
        own = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        merged = own.hint("merge").join(self.seen(), ["h1", "h2"], "left") if self.levels else own.withColumn("owner", F.lit(None).cast("long"))
        merged, path = _io.stored(merged.sortWithinPartitions("h1", "h2"), "line-run")
        held, _ = _io.stored(merged.where("owner is not null or lo < hi").select("h1", "h2", F.coalesce("owner", "lo").alias("owner")), "line-owners")
        self._put(0, merged.where("owner is null").select("h1", "h2", F.col("lo").alias("owner")), path)
        return held

    def _put(self, level: int, run: DataFrame, path: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append((run, path))
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            union = runs[0][0]
            for r, _ in runs[1:]:
                union = union.union(r)
            merged = union.repartitionByRange(_io.shuffle_partitions(self.spark), "h1").sortWithinPartitions("h1", "h2")
            self._put(level + 1, *_io.stored(merged, "line-run"))
            _io.drop(self.spark, *(p for _, p in runs))


def _cuts(docs: DataFrame, batches: int) -> list[int]:
    """Upper ends of all ranges of doc_id but the last, of about as many documents each."""
    q = docs.agg(F.percentile_approx("doc_id", F.array(*(F.lit(k / batches) for k in range(1, batches))), 1000).alias("q")).first()["q"]
    return sorted(set(q or []))


def dropped_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, mark (a hash of the row's text) and the positions of the lines to drop, for each row that loses any."""
    spark = docs.sparkSession
    cuts = _cuts(docs.select("doc_id"), batches) if batches > 1 else []
    batch = F.lit(len(cuts))
    for k in reversed(range(len(cuts))):
        batch = F.when(F.col("doc_id") <= cuts[k], k).otherwise(batch)
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    lines = lines.select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= MIN_KEY)
    lines = lines.select("doc_id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"), batch.alias("batch"))
    lines, _ = _io.stored(lines, "lines", ["batch"])
    runs, held = LineRuns(spark), None
    for k in range(len(cuts) + 1):
        own = runs.add(lines.where(F.col("batch") == k).select("h1", "h2", "doc_id")).withColumn("batch", F.lit(k))
        held = own if held is None else held.union(own)
    lost = lines.join(held, ["batch", "h1", "h2"]).where("doc_id > owner")
    return lost.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("lost"))


def with_kept(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text. docs has doc_id, text and none of these names, nor mark or lost."""
    lost = dropped_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), batches)
    both = docs.withColumn("mark", F.xxhash64("text")).join(lost, ["doc_id", "mark"], "left").withColumn("split_text", split_lines(F.col("text")))
    n = F.size("split_text")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.col("split_text")[i]), "\n"))
    return both.withColumns({"n_lines": n.cast("long"), "n_dropped": F.coalesce(F.size("lost"), F.lit(0)).cast("long"), "kept_text": kept}).drop("mark", "lost", "split_text")


def digest(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of each document."""
    out = with_kept(docs.select("doc_id", "text"), batches)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def keep_first_lines(docs: DataFrame) -> DataFrame:
    """The documents with their repeated lines gone from text, and n_chars to match; all other columns as they are."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = with_kept(docs.select("doc_id", "text", F.struct(F.lit(1).alias("one"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest))).alias("rest")))
    back = {c: F.col(f"rest.c{k}") for k, c in enumerate(rest)} | {"doc_id": F.col("doc_id"), "text": F.when(F.col("text").isNotNull(), F.col("kept_text"))}
    if "n_chars" in rest:
        back["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(back["n_chars"])
    return out.select(*(back[c].alias(c) for c in docs.columns))


ORACLE = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS arr FROM documents),
lines AS (SELECT doc_id, unnest(arr) AS line, generate_subscripts(arr, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
owned AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
judged AS (SELECT k.*, coalesce(k.doc_id <> o.owner, false) AS lost FROM keyed k LEFT JOIN owned o USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
