"""Images before recognition, and the recogniser's interface. Kernels are numpy; recognition is a plug-in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PIXELS = 3_000_000


def target_size(h: Column, w: Column, max_pixels: int = MAX_PIXELS) -> tuple[Column, Column]:
    """Height and width after scaling an image down to max_pixels (0: any size)."""
    pixels = h.cast("double") * w.cast("double")
    if max_pixels <= 0:
        return h, w
    scale = F.sqrt(F.lit(float(max_pixels)) / F.greatest(pixels, F.lit(1.0)))
    small = lambda x: F.when(pixels > max_pixels, F.greatest(F.lit(1), (x * scale).cast("int"))).otherwise(x)
    return small(h), small(w)


def downscale(image: np.ndarray, max_pixels: int = MAX_PIXELS) -> np.ndarray:
    """The image as means over areas, with at most max_pixels pixels."""
    h, w = image.shape[:2]
    if max_pixels <= 0 or h * w <= max_pixels:
        return image
    s = (max_pixels / (h * w)) ** 0.5
    rows, cols = (np.linspace(0, n, max(1, int(n * s)) + 1).astype(int) for n in (h, w))
    x = image.astype(np.float64)
    x = np.add.reduceat(np.add.reduceat(x, rows[:-1], axis=0), cols[:-1], axis=1)
    area = np.diff(rows)[:, None] * np.diff(cols)
    return np.rint(x / (area[..., None] if image.ndim == 3 else area)).astype(image.dtype)


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of an image with blue, green and red channels."""
    return image if image.ndim == 2 else np.rint(image @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def median_blur(image: np.ndarray) -> np.ndarray:
    """The median of each pixel's 3 by 3 neighbourhood; edges are repeated outwards."""
    wide = np.pad(image, [(1, 1), (1, 1), *[(0, 0)] * (image.ndim - 2)], mode="edge")
    near = [wide[i : i + image.shape[0], j : j + image.shape[1]] for i in range(3) for j in range(3)]
    return np.median(near, axis=0).astype(image.dtype)


def otsu(image: np.ndarray) -> np.ndarray:
    """Black and white at the threshold that separates the two classes of gray levels best."""
    count = np.bincount(gray(image).reshape(-1), minlength=256).astype(float)
    below = np.cumsum(count)
    mass = np.cumsum(count * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.nan_to_num(below * above * (mass / below - (mass[-1] - mass) / above) ** 2)
    return np.where(gray(image) > between.argmax(), 255, 0).astype(np.uint8)


STEPS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"gray": gray, "blur": median_blur, "threshold": otsu}


def preprocess(image: np.ndarray, steps: dict[str, bool] | None = None, max_pixels: int = MAX_PIXELS) -> np.ndarray:
    """The image scaled down, then through the enabled steps in their fixed order. None is enabled by default."""
    image = downscale(image, max_pixels)
    for name, step in STEPS.items():
        if (steps or {}).get(name):
            image = step(image)
    return image


class Recogniser(Protocol):
    """What finds text in an image: (polygon of four (x, y) corners, text, level or None) for each box. image: pixels, where images come decoded, else the file's bytes."""

    def recognise(self, image: bytes | np.ndarray) -> list[tuple[list[tuple[float, float]], str, float | None]]: ...


_BOX = "box_id int, polygon array<struct<x:double,y:double>>, text string, level double"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_BOXES = pa.list_(pa.struct([("box_id", pa.int32()), ("polygon", pa.list_(_POINT)), ("text", pa.string()), ("level", pa.float64())]))


def _pixels(row: dict) -> np.ndarray:
    if row["pixels"] is None or not row["height"] or row["height"] < 0:
        raise ValueError("not an image")
    image = np.frombuffer(row["pixels"], dtype=np.uint8).reshape(row["height"], row["width"], row["channels"])
    return image[..., 0] if row["channels"] == 1 else image[..., :3]


def recognised(images: DataFrame, make: Callable[[], Recogniser], steps: dict[str, bool] | None = None, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """image_id, boxes, error: a row an image. images: image_id and content, or what readers.decoded_images gives, whose pixels are preprocessed first.

    make builds the recogniser, once in each task. An image that can't be read or recognised has null boxes and an
    error, and the others go on; one without text has an empty array.
    """
    decoded = "pixels" in images.columns
    columns = ["height", "width", "channels", "pixels"] if decoded else ["content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = make()
        for batch in batches:
            found, errors = [], []
            for k in range(batch.num_rows):  # a row at a time, for images are large
                row = {c: batch.column(c)[k].as_py() for c in columns}
                try:
                    boxes = reader.recognise(preprocess(_pixels(row), steps, max_pixels) if decoded else row["content"])
                    found.append([{"box_id": n, "polygon": [{"x": x, "y": y} for x, y in p], "text": t, "level": c} for n, (p, t, c) in enumerate(boxes)])
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - whatever a plug-in raises becomes the row's error
                    found.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.record_batch({"image_id": batch.column("image_id"), "boxes": pa.array(found, _BOXES), "error": pa.array(errors, pa.string())})

    rows = images.select(F.col("image_id").cast("string").alias("image_id"), *columns)
    return rows.mapInArrow(run, f"image_id string, boxes array<struct<{re.sub(r'(^|, )([a-z_]+) ', r'\1\2:', _BOX)}>>, error string")


def exploded(rows: DataFrame) -> DataFrame:
    """The boxes of recognised images, a row each."""
    return rows.select("image_id", F.inline("boxes"))


def boxes(images: DataFrame, make: Callable[[], Recogniser], steps: dict[str, bool] | None = None, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """The text boxes of images, a row each. An image's error fails the job; recognised() keeps it as a value."""
    rows = recognised(images, make, steps, max_pixels)
    return exploded(rows.withColumn("boxes", F.when(F.col("error").isNull(), F.col("boxes")).otherwise(F.raise_error(F.col("error")))))
