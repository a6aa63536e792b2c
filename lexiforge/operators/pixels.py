"""Pixels of images too large for one task: bands of rows, histograms and area means over them.

Images are those of readers.decoded_images (image_id, height, width, channels, pixels). A band is some whole rows of the picture that comes out, so that
no area reaches over two bands and each band is finished where it is. Images that couldn't be decoded have no bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import images

BAND_PIXELS = 4_000_000


def bands(pictures: DataFrame, max_pixels: int = images.MAX_PIXELS, band_pixels: int = BAND_PIXELS) -> DataFrame:
    """image_id, height, width, channels, out_height, out_width, first and last (rows of the result, the last one excluded), pixels: bands of about band_pixels pixels, dealt out over the tasks."""
    good = pictures.where("pixels is not null and height > 0 and width > 0")
    h, w = images.target_size(F.col("height"), F.col("width"), max_pixels)
    sized = good.withColumns({"out_height": h.cast("int"), "out_width": w.cast("int")})
    step = F.col("height") / F.col("out_height")
    rows = F.greatest(F.lit(1), (F.lit(float(band_pixels)) / F.col("width") / step).cast("int"))
    cut = sized.withColumn("rows", rows).withColumn("first", F.explode(F.sequence(F.lit(0), F.col("out_height") - 1, F.col("rows"))))
    cut = cut.withColumn("last", F.least(F.col("first") + F.col("rows"), F.col("out_height")))
    edge = lambda k: F.when(F.col(k) == F.col("out_height"), F.col("height")).otherwise((F.col(k) * step).cast("int"))
    row = F.col("width") * F.col("channels")
    band = F.substring("pixels", edge("first") * row + 1, (edge("last") - edge("first")) * row)
    names = ("image_id", "height", "width", "channels", "out_height", "out_width", "first", "last")
    return cut.select(*names, band.alias("pixels")).repartition("image_id", "first")


def _shrunk(row: dict) -> np.ndarray:
    """The result's rows that a band stands for: means over areas."""
    edges = lambda n, m: np.linspace(0, n, m + 1).astype(int)
    rows = edges(row["height"], row["out_height"])[row["first"] : row["last"] + 1]
    cols = edges(row["width"], row["out_width"])
    x = np.frombuffer(row["pixels"], dtype=np.uint8).reshape(rows[-1] - rows[0], row["width"], row["channels"])
    if (row["out_height"], row["out_width"]) == (row["height"], row["width"]):
        return x
    total = np.add.reduceat(np.add.reduceat(x.astype(np.float64), rows[:-1] - rows[0], axis=0), cols[:-1], axis=1)
    return np.rint(total / (np.diff(rows)[:, None] * np.diff(cols))[..., None]).astype(np.uint8)


def downscaled(parts: DataFrame, to_gray: bool = False) -> DataFrame:
    """Bands with their pixels scaled down as images.downscale does, and to_gray: as one channel of luma. height and width are the result's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("image_id", "height", "width", "channels", "out_height", "out_width", "first", "last", "pixels")
        for batch in batches:
            for k in range(batch.num_rows):  # a band at a time, for bands are large
                row = {c: batch.column(c)[k].as_py() for c in names}
                x = _shrunk(row)
                if to_gray:
                    x = x if x.shape[2] == 1 else images.gray(x[..., :3])[..., None]
                made = {"image_id": row["image_id"], "height": row["out_height"], "width": row["out_width"], "channels": x.shape[2], "first": row["first"], "pixels": x.tobytes()}
                yield pa.RecordBatch.from_pylist([made], pa.schema([("image_id", batch.schema.field("image_id").type), *((c, pa.int32()) for c in ("height", "width", "channels", "first")), ("pixels", pa.binary())]))

    kind = parts.schema["image_id"].dataType.simpleString()
    return parts.mapInArrow(run, f"image_id {kind}, height int, width int, channels int, first int, pixels binary")


def levels(parts: DataFrame) -> DataFrame:
    """image_id, level, n: how often each gray level occurs in bands of one channel; counted in each band, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n = np.bincount(np.frombuffer(batch.column("pixels")[k].as_buffer(), dtype=np.uint8), minlength=256)
                at = np.flatnonzero(n)
                yield pa.record_batch({"image_id": batch.column("image_id").take(pa.array([k] * len(at))), "level": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    kind = parts.schema["image_id"].dataType.simpleString()
    found = parts.where("channels = 1").select("image_id", "pixels").mapInArrow(run, f"image_id {kind}, level int, n long")
    return found.groupBy("image_id", "level").agg(F.sum("n").alias("n"))


def otsu_levels(counts: DataFrame, key: str = "image_id") -> DataFrame:
    """key, threshold of histograms (key, level, n): the level that separates the two classes of gray levels best, ties to the darker one; 0 for an image of one level."""
    n, mass = F.col("n").cast("double"), F.col("n").cast("double") * F.col("level")
    every, upto = Window.partitionBy(key), Window.partitionBy(key).orderBy("level")
    sums = counts.where("n > 0").select(key, "level", F.sum(n).over(upto).alias("b"), F.sum(mass).over(upto).alias("m"), F.sum(n).over(every).alias("n"), F.sum(mass).over(every).alias("all"))
    apart = F.col("m") / F.col("b") - (F.col("all") - F.col("m")) / F.nullif(F.col("n") - F.col("b"), F.lit(0.0))
    between = F.coalesce(F.col("b") * (F.col("n") - F.col("b")) * (apart * apart), F.lit(0.0))
    best = sums.groupBy(key).agg(F.max(F.struct(between.alias("between"), (-F.col("level")).alias("level"))).alias("m"))
    return best.select(key, F.when(F.col("m.between") > 0, -F.col("m.level")).otherwise(0).cast("int").alias("threshold"))


def black_and_white(parts: DataFrame) -> DataFrame:
    """Bands of one channel, white where brighter than their image's threshold, else black."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.frombuffer(batch.column("pixels")[k].as_buffer(), dtype=np.uint8)
                made = np.where(x > batch.column("threshold")[k].as_py(), 255, 0).astype(np.uint8).tobytes()
                one = batch.slice(k, 1).drop_columns(["pixels", "threshold"])
                yield one.append_column("pixels", pa.array([made], pa.binary()))

    kind = parts.schema["image_id"].dataType.simpleString()
    judged = parts.join(otsu_levels(levels(parts)), "image_id").select("image_id", "height", "width", "channels", "first", "pixels", "threshold")
    return judged.mapInArrow(run, f"image_id {kind}, height int, width int, channels int, first int, pixels binary")


def assembled(parts: DataFrame) -> DataFrame:
    """image_id, height, width, channels, pixels: the images that scaled bands make up, whose size is bounded by then."""
    rows = parts.groupBy("image_id", "height", "width", "channels").agg(F.array_sort(F.collect_list(F.struct("first", "pixels"))).alias("b"))
    whole = F.aggregate("b", F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x["pixels"]))
    return rows.select("image_id", "height", "width", "channels", whole.alias("pixels"))
