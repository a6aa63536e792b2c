"""Writers of the engine's results."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def dictionary(terms: DataFrame, path: str) -> None:
    """Terms in order of their characters, as JSON lines."""
    terms.select("term").orderBy("term").write.mode("overwrite").json(path)


def committed(tables: dict[str, DataFrame], path: str) -> None:
    """Writes the tables as Parquet in folders of their names below `path`, all or none of them.

    They are written to a hidden folder beside it, which takes its place by a rename when the last is done, so nobody reads a part of a run, and a run that fails leaves
    nothing. What was at `path` stays until then.
    """
    _replace(next(iter(tables.values())).sparkSession, path, lambda at: [frame.write.parquet(f"{at}/{name}") for name, frame in tables.items()])


def _replace(spark: SparkSession, path: str, write, pick=lambda files, at: at) -> None:
    """Lets write(folder) fill a hidden folder, and renames what pick(files, folder) names in it to `path`."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    end = place(path)
    files = end.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = place(end.getParent(), f".{end.getName()}-{uuid.uuid4().hex}")
    try:
        write(aside.toString())
        made = pick(files, aside)
        files.delete(end, True)
        if not files.rename(made, end):
            raise OSError(f"cannot rename {made.toString()} to {path}")
    finally:
        files.delete(aside, True)


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # a line waits for the next one, which decides on its comma
    yield pa.record_batch({"value": ["["]})
    for batch in batches:
        for term in batch.column(0).drop_null().to_pylist():
            if held is not None:
                yield pa.record_batch({"value": [f"{held},"]})
            held = json.dumps(term, ensure_ascii=False)
    yield pa.record_batch({"value": ["]"] if held is None else [held, "]"]})


def json_array(terms: DataFrame, path: str) -> None:
    """Distinct terms in order of their characters as one file that holds one JSON array, the form that readers.json_list takes. The file is there whole or not at all.

    One file is written by one task, which sorts with spilling and holds a line; dictionary() writes in parallel. Null terms are left out.
    """
    none = terms.sparkSession.range(1).select(F.lit(None).cast("string").alias("term"))  # so that there is a task for an empty table too
    lines = terms.select("term").union(none).distinct().repartition(1).sortWithinPartitions("term").mapInArrow(_array_lines, "value string")
    part = lambda files, at: next(x.getPath() for x in files.listStatus(at) if x.getPath().getName().startswith("part-"))
    _replace(terms.sparkSession, path, lambda at: lines.write.text(at), part)


def synonyms(synonym_map: DataFrame, path: str, refresh: bool = False) -> None:
    """The synonym map; an existing one stays unless refresh."""
    synonym_map.write.mode("overwrite" if refresh else "ignore").parquet(path)


def ingredient_texts(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, value: a text of each document's ingredients, one a line with commas between."""
    return results.select(key, F.concat_ws(",\n", "ingredients").alias("value"))


def per_image(results: DataFrame, path: str, run_id: str, key: str = "doc_id") -> None:
    """Both lists of each document as JSON below run_id=.../."""
    results.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(path)


def run_id(spark: SparkSession) -> str:
    """run_ and the current day and time."""
    return spark.range(1).select(F.date_format(F.current_timestamp(), "'run_'dd.MM.yyyy_HH:mm:ss").alias("r")).first()["r"]


def run_info(spark: SparkSession, path: str, run: str, method: str, accuracy: float, f1_score: float, config: dict[str, str]) -> None:
    spark.createDataFrame([(run, method, accuracy, f1_score, config)], schemas.RUN_INFO).write.mode("append").json(path)


def answers(table: DataFrame, *without: str) -> DataFrame:
    """value: each row as a JSON object, without some columns."""
    return table.drop(*without).select(F.to_json(F.struct("*")).alias("value"))


def image_names(images: DataFrame, key: str, order: str, ending: str = "ending") -> DataFrame:
    """Images with a file name: the key, numbered from 0 if the key has several images."""
    n = F.count("*").over(Window.partitionBy(key))
    at = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    base = F.col(key).cast("string")
    return images.withColumn("file_name", F.concat(base, F.when(n > 1, F.concat(F.lit("_"), at.cast("string"))).otherwise(F.lit("")), F.lit("."), F.col(ending)))


def gigabytes(n_bytes: Column) -> Column:
    """Bytes as gigabytes with two digits."""
    return F.format_number(n_bytes / F.lit(1024**3), 2)


def barcodes(rows: DataFrame, column: str, path: str) -> None:
    """The values there are, one a line."""
    rows.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).write.mode("overwrite").text(path)
