"""Packing along a space-filling curve, so that documents alike in words share sequences.

Texts are tokenised where they lie. A document's vector counts its tokens, hashed into BUCKETS buckets, with logarithmic
weights and length one; a fixed random matrix projects it to DIMENSIONS numbers. Over all documents each of these is brought to mean zero
and deviation one and, by the normal distribution, spread over BITS bits. The place of these coordinates on a Hilbert curve is the document's
key. Documents are sorted by key in ranges, copies next to one another, and laid end to end along the curve; sequences are cut from that line at
every CAPACITY tokens. What is left at the end is cut into sequences of powers of two, the largest first, so nothing is padded.

Tokens stay in the table that tokenising writes: only key, row and length are range-sorted, and the place on the line of each row goes back
to the tokens by one join. Sums over ranges are a number a range.

Defined cases: a null or empty text has the one id 0; its vector is zero. Repeated rows are packed each for itself. A null doc_id stays null. An empty table gives
an empty result. A document longer than a sequence goes through several. Extra columns are ignored. Equal keys are ordered by row, so a range never
holds all of one key's rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _io, _text, packing

CAPACITY = 1024
DIMENSIONS = 4
BITS = 15
BUCKETS = 1 << 16
_NAMES = [f"p{k}" for k in range(DIMENSIONS)]
_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def projection() -> np.ndarray:
    """The matrix (bucket, dimension) of fixed random numbers of mean zero."""
    n = BUCKETS * DIMENSIONS
    a = _text.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((a >> np.uint64(11)).astype(np.float64) / 2.0**52 - 1).reshape(BUCKETS, DIMENSIONS)


class Projector:
    """Hashed vectors of token ids, projected. A token's bucket and its row of the matrix are looked up in a table that grows with the ids seen."""

    def __init__(self) -> None:
        self.matrix, self.rows = projection(), np.zeros((0, DIMENSIONS))

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        seen, counts = np.unique(ids, return_counts=True)
        if len(seen) and seen[-1] >= len(self.rows):
            every = np.arange(1, max(int(seen[-1]) + 1, BUCKETS) + 1, dtype=np.uint64)
            self.rows = self.matrix[_text.mix(every) % np.uint64(BUCKETS)]
        weight = np.log1p(counts)
        length = np.sqrt((weight * weight).sum())
        return np.einsum("i,ij->j", weight, self.rows[seen]) / (length or 1.0)


def _tokeniser(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, project = packing.encoder(path), Projector()
        for batch, texts in _text.chunks(batches):
            held, points, sizes = [], [], []
            for text in texts:
                ids = encode(text.decode())
                points.append(project(ids))
                ids = np.append(ids, np.uint32(packing.END))
                held.append(ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes())  # the width shows in the length
                sizes.append(len(ids))
            points = np.array(points)
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(points[:, k]) for k in range(DIMENSIONS)), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], names=["doc_id", *_NAMES, "doc_tokens", "ids"])

    return run


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of unsigned coordinates of so many bits, at most 63 bits in all.

    From the highest bit on, a set bit of a coordinate mirrors the first one's lower bits, an unset one swaps lower bits with the first; then
    coordinates are Gray-coded, and their bits interleaved.
    """
    x = [points[:, k].astype(np.uint64) for k in range(points.shape[1])]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        low = q - one
        for k in range(len(x)):
            up = (x[k] & q) > 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[k]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros(len(points), dtype=np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b)) & one > 0, np.uint64((1 << b) - 1), np.uint64(0))
    key = np.zeros(len(points), dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = key << one | ((c ^ flip) >> np.uint64(b)) & one
    return key.astype(np.int64)


def _levels(z: np.ndarray) -> np.ndarray:
    """Deviations from the mean as unsigned numbers of BITS bits, by a close approximation of the normal distribution."""
    share = 1 / (1 + np.exp(-np.clip(1.5976 * z + 0.07056 * z**3, -40, 40)))
    return np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def _placer(mean: list[float], deviation: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.stack([(batch.column(n).to_numpy() - m) / d for n, m, d in zip(_NAMES, mean, deviation, strict=True)], axis=1)
            yield pa.record_batch([batch.column("row"), batch.column("doc_tokens"), pa.array(hilbert(_levels(z)))], names=["row", "doc_tokens", "key"])

    return run


def _adder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of the range before each row."""
    so_far = 0
    for batch in batches:
        n = batch.column("doc_tokens").to_numpy()
        before = so_far + np.cumsum(n) - n
        so_far += int(n.sum())
        yield pa.record_batch([batch.column("row"), batch.column("key"), batch.column("doc_tokens"), pa.array(before, pa.int64()), batch.column("range")], names=["row", "key", "doc_tokens", "before", "range"])


def edges(total: int, capacity: int = CAPACITY) -> np.ndarray:
    """Where the sequences of the line's end begin, those that aren't of full length, and the line's end."""
    full = total // capacity * capacity
    out = [full]
    for b in range((total - full).bit_length() - 1, -1, -1):
        if (total - full) >> b & 1:
            out.append(out[-1] + (1 << b))
    return np.array(out, dtype=np.int64)


def _cutter(total: int, capacity: int):
    tail = edges(total, capacity)
    full = int(tail[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 7
        for batch in batches:
            rows = []
            for doc_id, ids, n, place in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("doc_tokens").to_pylist(), batch.column("place").to_pylist(), strict=True):
                held = np.frombuffer(ids.as_buffer(), dtype=f"<u{len(ids.as_buffer()) // n}").astype("<u4")
                first = np.arange(place // capacity + 1, min(full, place + n - 1) // capacity + 1) * capacity
                cuts = [place, *first.tolist(), *(int(x) for x in tail if max(place, full) < x < place + n), place + n]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    k = int(np.searchsorted(tail, a, side="right")) - 1
                    sequence, begin = (full // capacity + k, int(tail[k])) if k >= 0 else (a // capacity, a // capacity * capacity)
                    rows.append((doc_id, a - place, b - a, zlib.crc32(held[a - place : b - place]), n, sequence, a - begin))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def along_curve(tokens: DataFrame) -> DataFrame:
    """row, key, doc_tokens, before, range: the documents (row, p0.., doc_tokens) sorted by their key in ranges, with the tokens of the range before them; stored."""
    told = tokens.agg(F.count("*").alias("n"), *(f(n).alias(f"{t}{n}") for n in _NAMES for t, f in (("m", F.avg), ("d", F.stddev_pop)))).first()
    mean = [told[f"m{n}"] or 0.0 for n in _NAMES]
    deviation = [told[f"d{n}"] or 1.0 for n in _NAMES]
    keyed = tokens.select("row", "doc_tokens", *_NAMES).mapInArrow(_placer(mean, deviation), "row long, doc_tokens long, key long")
    ranges = keyed.repartitionByRange(_io.shuffle_partitions(tokens.sparkSession), "key", "row").withColumn("range", F.spark_partition_id()).sortWithinPartitions("key", "row")
    return ranges.mapInArrow(_adder, "row long, key long, doc_tokens long, before long, range int")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece. path: of the vocabulary, on each executor."""
    spark = docs.sparkSession
    points = ", ".join(f"{n} double" for n in _NAMES)
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokeniser(path), f"doc_id long, {points}, doc_tokens long, ids binary")
    tokens, _ = _io.stored(made.withColumn("row", F.monotonically_increasing_id()), "curve-tokens")
    line, _ = _io.stored(along_curve(tokens), "curve-line")
    sums = {r["range"]: r["n"] for r in line.groupBy("range").agg(F.sum("doc_tokens").alias("n")).collect()}  # a number a range
    total, begin = 0, {}
    for k in sorted(sums):
        begin[k], total = total, total + sums[k]
    starts = spark.createDataFrame(list(begin.items()), "range int, begin long")
    placed = line.join(F.broadcast(starts), "range").select("row", (F.col("begin") + F.col("before")).alias("place"))
    return tokens.select("row", "doc_id", "doc_tokens", "ids").join(placed, "row").select("doc_id", "doc_tokens", "ids", "place").mapInArrow(_cutter(total, capacity), _COLUMNS)
