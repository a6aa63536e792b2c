"""Text boxes in reading order. Boxes: image_id, box_id, polygon (top left, top right, bottom right, bottom left), text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

FACTOR, NEAREST = 0.8, 5
_SMALL = 64  # boxes of an image up to which all its pairs are compared
_PAIRS = 1 << 19  # pairs that are compared at a time


def midpoints(boxes: DataFrame) -> DataFrame:
    """Boxes with lx, ly, rx, ry: the middles of their left and right edges in whole pixels."""
    p = lambda k, axis: F.col("polygon")[k][axis]
    mid = lambda a, b, axis: ((p(a, axis) + p(b, axis)) / 2).cast("int")
    return boxes.withColumns({"lx": mid(0, 3, "x"), "ly": mid(0, 3, "y"), "rx": mid(1, 2, "x"), "ry": mid(1, 2, "y")})


def centre(polygon: Column) -> tuple[Column, Column]:
    """The mean of a polygon's corners in whole pixels."""
    mean = lambda axis: (F.aggregate(polygon, F.lit(0.0), lambda s, c: s + c[axis]) / F.size(polygon)).cast("int")
    return mean("x"), mean("y")


def _small(at: np.ndarray, base: np.ndarray, size: np.ndarray, q: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest points of the queries `at`, of images that begin at `base`, all pairs of an image compared; a block of queries at a time."""
    d, j = np.full((len(at), k), np.inf), np.full((len(at), k), -1)
    for some in np.array_split(np.arange(len(at)), max(1, -(-int(size.sum()) // _PAIRS))):
        n = size[some]
        local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = np.repeat(some, n)
        away = np.sqrt(((q[at[row]] - p[base[row] + local]) ** 2).sum(axis=1))
        order = np.lexsort((local, away, row))
        keep = local < k  # rows are in order, so a pair's rank is where the pair in its place was
        d[row[keep], local[keep]], j[row[keep], local[keep]] = away[order][keep], local[order][keep]
    return d, j


def _gridded(q: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest points of each query of one image, by rings of cells about the query's own.

    Cells are bounded by quantiles of either axis, so that a far box doesn't gather the others in one cell. A query is done when its k-th distance is below that of the
    nearest border of the cells it has seen; what ties with it there could only lie within.
    """
    m, n = len(q), len(p)
    wanted, cuts = max(1, n // (2 * k)), [np.empty(0), np.empty(0)]
    across = int(np.argmin([len(np.unique(p[:, a])) for a in (0, 1)]))
    for a, cells in ((across, int(wanted**0.5)), (1 - across, 0)):  # an axis of few values has few cells, and the other one more
        cells = cells or wanted // (len(cuts[across]) + 1)
        cuts[a] = np.unique(np.quantile(p[:, a], np.arange(1, cells) / cells)) if cells > 1 else cuts[a]
    sides = [len(c) + 1 for c in cuts]
    cell = [np.searchsorted(c, p[:, a], side="right") for a, c in enumerate(cuts)]
    key = cell[0] * sides[1] + cell[1]
    by_cell = np.argsort(key, kind="stable")
    key = key[by_cell]
    own = [np.searchsorted(c, q[:, a], side="right") for a, c in enumerate(cuts)]
    border = [np.concatenate([[-np.inf], c, [np.inf]]) for c in cuts]
    d, j = np.full((m, k), np.inf), np.full((m, k), n)
    left, ring = np.arange(m), 0
    while len(left):
        x, y = own[0][left], own[1][left]
        for dx in range(-ring, ring + 1):
            spans = [(y - ring, y + ring)] if abs(dx) == ring else [(y - ring, y - ring), (y + ring, y + ring)]
            inside = (x + dx >= 0) & (x + dx < sides[0])
            for low, high in spans:
                good = inside & (high >= 0) & (low < sides[1])
                at = left[good]
                first = (x + dx)[good] * sides[1]
                begin = np.searchsorted(key, first + np.maximum(low[good], 0), side="left")
                count = np.searchsorted(key, first + np.minimum(high[good], sides[1] - 1), side="right") - begin
                total = np.cumsum(count)
                for some in np.split(np.arange(len(at)), np.searchsorted(total, np.arange(_PAIRS, int(total[-1]) if len(total) else 0, _PAIRS))):
                    c = count[some]
                    row = np.repeat(at[some], c)
                    to = by_cell[np.repeat(begin[some], c) + np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)]
                    away = np.sqrt(((q[row] - p[to]) ** 2).sum(axis=1))
                    mine = at[some]
                    rows, dist, num = np.concatenate([np.repeat(mine, k), row]), np.concatenate([d[mine].ravel(), away]), np.concatenate([j[mine].ravel(), to])
                    order = np.lexsort((num, dist, rows))
                    sizes = np.bincount(rows, minlength=m)[mine]  # mine is in rising order
                    keep = order[(np.cumsum(sizes) - sizes)[:, None] + np.arange(k)]
                    d[mine], j[mine] = dist[keep], num[keep]
        low, high = [np.maximum(o[left] - ring, 0) for o in own], [np.minimum(o[left] + ring, side - 1) + 1 for o, side in zip(own, sides, strict=True)]
        sure = np.min([q[left, a] - border[a][low[a]] for a in (0, 1)] + [border[a][high[a]] - q[left, a] for a in (0, 1)], axis=0)
        left = left[d[left, -1] >= sure]
        ring += 1
        left = left if ring < max(sides) else left[:0]
    j[j == n] = -1
    return d, j


def _nearest(size: np.ndarray, q: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places (within the image; -1: none) of the k nearest points p of each query q of images of the given sizes; ties to the smaller place. Memory grows with the boxes alone.

    Boxes without a place (NaN) are nobody's neighbours and have none.
    """
    there = np.isfinite(q).all(axis=1) & np.isfinite(p).all(axis=1)
    if not there.all():
        owner = np.repeat(np.arange(len(size)), size)
        place = np.flatnonzero(there)
        local = place - (np.cumsum(size) - size)[owner[place]]
        held = np.bincount(owner[place], minlength=len(size))
        near = _nearest(held, q[place], p[place], k)
        d, j = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
        first = np.repeat(np.cumsum(held) - held, held)[:, None]
        d[place] = near[0]
        if len(place):
            j[place] = np.where(near[1] >= 0, local[np.minimum(first + np.maximum(near[1], 0), len(place) - 1)], -1)
        return d, j
    base = np.cumsum(size) - size
    d, j = np.full((len(q), k), np.inf), np.full((len(q), k), -1)
    owner = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(size[owner] <= _SMALL)
    if len(at):
        few = _small(at, base[owner[at]], size[owner[at]], q, p, k)
        d[at], j[at] = few
    for i in np.flatnonzero(size > _SMALL):
        part = slice(base[i], base[i] + size[i])
        d[part], j[part] = _gridded(q[part], p[part], k)
    return d, j


def _measured(d: np.ndarray, j: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and deviation of each row's distances, and the place of the nearest box if that is near enough (-1: not)."""
    there = j >= 0
    n = np.maximum(there.sum(axis=1), 1)
    mean = np.where(there, d, 0.0).cumsum(axis=1)[:, -1] / n
    std = np.sqrt((np.where(there, d - mean[:, None], 0.0) ** 2).cumsum(axis=1)[:, -1] / n)
    return mean, std, np.where(there[:, 0] & (d[:, 0] <= (mean + std) * factor), j[:, 0], -1)


def _gathered(boxes: DataFrame) -> DataFrame:
    """A row an image: arrays of ids, corners and centres in order of box."""
    cx, cy = centre(F.col("polygon"))
    names = ("lx", "ly", "rx", "ry", "cx", "cy")
    m = midpoints(boxes).select("image_id", F.struct("box_id", "lx", "ly", "rx", "ry", cx.alias("cx"), cy.alias("cy")).alias("b"))
    rows = m.groupBy("image_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    number = lambda n: F.transform(f"b.{n}", lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))).alias(n)
    return rows.select("image_id", F.col("b.box_id").alias("ids"), *map(number, names))


def _points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.diff(batch.column("ids").offsets.to_numpy()).astype(np.int64)
    flat = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("lx", "ly", "rx", "ry")}
    return size, np.column_stack([flat["rx"], flat["ry"]]), np.column_stack([flat["lx"], flat["ly"]])


def neighbours(boxes: DataFrame, k: int = NEAREST) -> DataFrame:
    """image_id, box_id, at (from 1), other_id, distance: the k boxes whose left edges are nearest to the right edge of each box, itself included; ties to the smaller id.

    Images of many boxes are searched by cells, so neither pairs nor distances of a whole image are held. Boxes without a polygon have no distances.
    """
    kind = {c: boxes.schema[c].dataType.simpleString() for c in ("image_id", "box_id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, q, p = _points(batch)
            d, j = _nearest(size, q, p, k)
            row, at = np.nonzero(j >= 0)
            owner = np.repeat(np.arange(len(size)), size)
            base = (np.cumsum(size) - size)[owner]
            ids = batch.column("ids").flatten()
            yield pa.record_batch({
                "image_id": batch.column("image_id").take(pa.array(owner[row])), "box_id": ids.take(pa.array(row)), "at": pa.array((at + 1).astype(np.int32)),
                "other_id": ids.take(pa.array(base[row] + j[row, at])), "distance": pa.array(d[row, at]),
            })

    placed = boxes.where("polygon is not null")
    return _gathered(placed).select("image_id", "ids", "lx", "ly", "rx", "ry").mapInArrow(run, f"image_id {kind['image_id']}, box_id {kind['box_id']}, at int, other_id {kind['box_id']}, distance double")


def nearest(boxes: DataFrame) -> DataFrame:
    """image_id, box_id, other_id, distance: the nearest box to the right of each box, ties to the smaller id."""
    return neighbours(boxes, 1).drop("at")


def thresholds(boxes: DataFrame, factor: float = FACTOR, k: int = NEAREST) -> DataFrame:
    """image_id, box_id, mean, std (population), threshold over the k smallest distances of each box."""
    stats = neighbours(boxes, k).groupBy("image_id", "box_id").agg(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("std"))
    return stats.withColumn("threshold", (F.col("mean") + F.col("std")) * F.lit(factor))


def _near(batch: pa.RecordBatch, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the batch's images, the image of each box, and the place in the batch of the box that each is joined with (-1: none)."""
    size, q, p = _points(batch)
    _, _, near = _measured(*_nearest(size, q, p, NEAREST), factor)
    owner = np.repeat(np.arange(len(size)), size)
    return size, owner, np.where(near >= 0, (np.cumsum(size) - size)[owner] + near, -1)


def edges(boxes: DataFrame, factor: float = FACTOR) -> DataFrame:
    """image_id, box_id, other_id: boxes joined with their nearest one if it is near enough."""
    kind = {c: boxes.schema[c].dataType.simpleString() for c in ("image_id", "box_id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, owner, near = _near(batch, factor)
            a, ids = np.flatnonzero(near >= 0), batch.column("ids").flatten()
            yield pa.record_batch({"image_id": batch.column("image_id").take(pa.array(owner[a])), "box_id": ids.take(pa.array(a)), "other_id": ids.take(pa.array(near[a]))})

    return _gathered(boxes).mapInArrow(run, f"image_id {kind['image_id']}, box_id {kind['box_id']}, other_id {kind['box_id']}")


def _order(batches: Iterator[pa.RecordBatch], factor: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, row, near = _near(batch, factor)
        base = np.cumsum(size) - size
        flat = batch.column("ids").flatten()
        cx, cy = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in ("cx", "cy"))
        a = np.flatnonzero(near >= 0)
        b, label = near[a], np.arange(len(row))
        while True:  # the least label of each component spreads along its edges, and labels are followed to their ends
            now = label.copy()
            np.minimum.at(now, a, label[b])
            np.minimum.at(now, b, label[a])
            now = now[now]
            if (now == label).all():
                break
            label = now
        by_line = np.lexsort((np.arange(len(row)), cx, label))
        first = by_line[np.concatenate([[True], label[by_line][1:] != label[by_line][:-1]])] if len(row) else by_line
        line_y = np.zeros(len(row))
        line_y[label[first]] = cy[first]
        order = np.lexsort((np.arange(len(row)), cx, label, line_y[label], row))
        position = np.empty(len(row), dtype=np.int32)
        position[order] = np.arange(len(row)) - base[row[order]]
        yield pa.record_batch({"image_id": batch.column("image_id").take(pa.array(row)), "box_id": flat, "line_id": flat.take(pa.array(label)), "position": pa.array(position)})


def reading_order(boxes: DataFrame, factor: float = FACTOR) -> DataFrame:
    """image_id, box_id, line_id, position (from 0): lines by the height of their leftmost box, boxes within by their centre; ties to the smaller id. Boxes without a polygon are lines of their own, at the end."""
    kind = {k: boxes.schema[k].dataType.simpleString() for k in ("image_id", "box_id")}
    run = lambda batches: _order(batches, factor)
    return _gathered(boxes).mapInArrow(run, f"image_id {kind['image_id']}, box_id {kind['box_id']}, line_id {kind['box_id']}, position int")


def lines(boxes: DataFrame, factor: float = FACTOR) -> DataFrame:
    """image_id, box_id, line_id: the smallest box of the line that each box is on."""
    return reading_order(boxes, factor).drop("position")


def token_lists(boxes: DataFrame, factor: float = FACTOR) -> DataFrame:
    """image_id, tokens: the texts of each image in reading order, without blank ones and those of one character."""
    placed = boxes.select("image_id", "box_id", "text").join(reading_order(boxes, factor), ["image_id", "box_id"])
    good = placed.where(F.length(T.strip(F.col("text"))) > 0).where(F.length("text") > 1)
    found = good.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("tokens"))
    return boxes.select("image_id").distinct().join(found, "image_id", "left").select("image_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
