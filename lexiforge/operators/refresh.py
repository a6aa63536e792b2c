"""Tables built once and refreshed by their content, as immutable snapshots."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nearest


def content_key(df: DataFrame) -> str:
    """A key that changes whenever the rows do, whatever their order."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
    got = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias("s"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("x")).first()
    return f"{got['n']}-{got['s']}-{got['x'] & (1 << 64) - 1:x}".replace("--", "-m")


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def ensured(source: DataFrame, build: Callable[[DataFrame], DataFrame], folder: str, *also: DataFrame) -> DataFrame:
    """build(source), from the snapshot of equal content if there is one. also: other tables that build reads. Snapshots are never overwritten, so readers keep theirs."""
    spark = source.sparkSession
    path = f"{folder.rstrip('/')}/{'_'.join(content_key(x) for x in (source, *also))}"
    if not finished(spark, path):
        build(source).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Versions that a vector index may be spread over before it is written as one.
MERGE_AFTER = 8


def encoder_key(encoder) -> str:
    """A key that changes with the encoder's kind and settings."""
    told = repr(sorted(vars(encoder).items()))
    return f"{type(encoder).__name__}-{hashlib.sha256(told.encode()).hexdigest()[:12]}"


def _versions(spark: SparkSession, place: str) -> list[str]:
    """The finished versions below a folder, the newest last."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    done = []
    for x in files.listStatus(path):
        end = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x.getPath(), "parts/_SUCCESS")
        if files.exists(end):
            done.append((files.getFileStatus(end).getModificationTime(), x.getPath().getName()))
    return [name for _, name in sorted(done)]


def _parts(spark: SparkSession, place: str, version: str) -> list[str]:
    """The versions that a version is made of, the oldest first; at most MERGE_AFTER."""
    return [r["version"] for r in spark.read.schema("seq int, version string").parquet(f"{place}/{version}/parts").orderBy("seq").collect()]


def _live(spark: SparkSession, place: str, parts: list[str]) -> DataFrame:
    """id, features, weights of the tokens that some part adds and no later one removes."""
    added = [spark.read.schema(nearest.VECTORS).parquet(f"{place}/{v}/added").withColumn("seq", F.lit(k)) for k, v in enumerate(parts)]
    removed = [spark.read.schema("id string").parquet(f"{place}/{v}/removed").withColumn("gone", F.lit(k)) for k, v in enumerate(parts)]
    union = lambda frames: functools.reduce(lambda a, b: a.unionByName(b), frames)
    if len(parts) == 1:
        return added[0].drop("seq")
    gone = union(removed).groupBy("id").agg(F.max("gone").alias("gone"))
    return union(added).join(gone, "id", "left").where("gone is null or gone <= seq").select("id", "features", "weights")


def vector_index(tokens: DataFrame, column: str, folder: str, name: str, encoder=None, merge_after: int = MERGE_AFTER) -> DataFrame:
    """id (the token), features, weights of each distinct token that isn't null, as nearest.sparse gives them; kept below the folder.

    Equal tokens and encoders share a version. Other tokens make a version that holds what it adds to the newest one, encoded, and what it removes; so a
    changed table has only its new tokens encoded. A version spread over merge_after others is written as one, without encoding anything anew.
    Versions are never overwritten once they are finished, so readers keep theirs.
    """
    from . import vector_join

    spark, encoder = tokens.sparkSession, encoder or vector_join.NgramEncoder()
    place = f"{folder.rstrip('/')}/{name}-{encoder_key(encoder)}"
    wanted = tokens.select(F.col(column).alias("id")).where("id is not null").distinct()
    version = content_key(wanted)
    known = _versions(spark, place)
    if version not in known:
        parts = _parts(spark, place, known[-1]) if known else []
        if not parts:
            added, removed = nearest.sparse(wanted, "id", encoder), wanted.where("false")
        else:
            before = _live(spark, place, parts)
            new, removed = wanted.join(before, "id", "left_anti"), before.select("id").join(wanted, "id", "left_anti")
            added = nearest.sparse(new, "id", encoder)
            if len(parts) >= merge_after:
                added, removed, parts = before.join(wanted, "id", "left_semi").unionByName(added), wanted.where("false"), []
        added.write.mode("overwrite").parquet(f"{place}/{version}/added")
        removed.write.mode("overwrite").parquet(f"{place}/{version}/removed")
        told = [(k, v) for k, v in enumerate([*parts, version])]
        spark.createDataFrame(told, "seq int, version string").coalesce(1).write.mode("overwrite").parquet(f"{place}/{version}/parts")
    return _live(spark, place, _parts(spark, place, version))
