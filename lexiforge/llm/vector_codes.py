"""Vector code compression: product quantisation whose nearest entries are found in vantage-point trees.

A vector's components x become integers floor(256 * x), and the vector is cut into PARTS equal consecutive parts. Each part
position has a codebook of at most ENTRIES entries, first that part of the vectors of the smallest vec_ids. In each round
every part goes to its nearest entry (squared Euclidean distance in integers, ties to the lower index), then each entry becomes
the componentwise floor of its parts' mean; an entry without parts stays.

Nearest entries are found by branch and bound in a vantage-point tree over the entries of a part position. A node holds a
vantage entry and, for each of its two sides, the least and largest distance of that side's entries from it. These radii are
integers rounded outward, and so is a part's own distance from the vantage entry, so that the bound from the triangle
inequality never exceeds a true distance. A side is visited if its bound squared is at most the best squared distance so far:
non-strict, as an entry at the same distance may have a lower index. Each entry met is compared by its exact integer distance.

Spark deals the vectors; a task walks the trees for blocks of parts at once. What a round gathers is a sum and a count for each entry
of each task: PARTS * ENTRIES rows a task, however many vectors there are. The driver holds the codebooks only.

Defined cases: vectors that are null, empty or hold null or non-finite components go. The width is that of the kept vector of
the smallest vec_id; it must be a multiple of PARTS, or there is an error, and vectors of another width go. A null vec_id sorts first and is kept. Repeated rows count each for itself; rows
of one vec_id are ordered by their vector. Fewer than ENTRIES vectors give as many entries. Components so large that sums
might not fit 64 bits are worked out in unbounded integers; a result beyond a long is null. A null label is a label of its own. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _io

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Vectors that a task handles at once.
BLOCK = 8192
#: Entries in a leaf of a tree.
LEAF = 4
#: Bits of the digits in which sums travel, so that Spark adds them exactly whatever their size.
DIGIT = 40
_SUMS = "part int, entry int, place int, digit int, n long, total long"


def _integers(flat: np.ndarray, width: int) -> np.ndarray:
    """floor(256 * x) of the finite doubles of vectors of a width: 64-bit integers if squared distances must fit them, else Python's."""
    if not len(flat) or np.abs(flat).max() * 256 < math.isqrt((1 << 60) // width):
        return np.floor(flat * 256).astype(np.int64)
    return np.array([int(x) * 256 if abs(x) >= 1 << 53 else math.floor(x * 256) for x in flat.tolist()], dtype=object)


def _below(square: np.ndarray) -> np.ndarray:
    """The integer square root, rounded down."""
    if square.dtype == object:
        return np.array([math.isqrt(int(x)) for x in square], dtype=object)
    root = np.sqrt(square.astype(np.float64)).astype(np.int64)
    root -= root * root > square
    return root + ((root + 1) * (root + 1) <= square)


def _above(square: np.ndarray) -> np.ndarray:
    root = _below(square)
    return root + (root * root < square)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


class Tree:
    """A vantage-point tree over the entries of a part position.

    nodes: (entries of a leaf) or (vantage entry, inner side, outer side, then least and largest distance from the vantage entry to the inner side's
    entries and to the outer side's), children by index.
    """

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.nodes: list[tuple] = []
        self._grow(np.arange(len(entries)))

    def _grow(self, members: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(members) <= LEAF:
            self.nodes[at] = (members,)
            return at
        v, rest = members[0], members[1:]
        square = _squares(self.entries[rest], self.entries[v])
        order = np.argsort(square, kind="stable")
        rest, square = rest[order], square[order]
        half = len(rest) // 2
        ranges = tuple(int(x) for s in (square[:half], square[half:]) for x in (_below(s[:1])[0], _above(s[-1:])[0]))
        inner, outer = self._grow(rest[:half]), self._grow(rest[half:])
        self.nodes[at] = (v, inner, outer, *ranges)
        return at

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each part, ties to the lower index."""
        n = len(parts)
        self.parts, self.best = parts, np.zeros(n, dtype=np.int64)
        self.square = _squares(parts, self.entries[0])
        self.visited = 0
        # first down to one leaf each, by the nearer side, so that bounds are tight from the start
        waiting = [(0, np.arange(n))]
        while waiting:
            at, rows = waiting.pop()
            node = self.nodes[at]
            if len(node) == 1:
                self._compare(node[0], rows)
                continue
            v, inner, outer, _, inner_most, outer_least, _ = node
            square = self._compare(np.array([v]), rows)
            near = 2 * _below(square) <= inner_most + outer_least
            waiting += [(side, r) for side, r in ((inner, rows[near]), (outer, rows[~near])) if len(r)]
        waiting = [(0, np.arange(n))]
        while waiting:
            at, rows = waiting.pop()
            node = self.nodes[at]
            if len(node) == 1:
                self._compare(node[0], rows)
                continue
            v, inner, outer, *ranges = node
            square = self._compare(np.array([v]), rows)
            low, high = _below(square), _above(square)
            for side, least, most in ((outer, *ranges[2:]), (inner, *ranges[:2])):
                bound = np.maximum(np.maximum(low - most, least - high), 0)
                some = rows[(bound * bound <= self.square[rows]).astype(bool)]
                if len(some):
                    waiting.append((side, some))
        return self.best, self.square

    def _compare(self, members: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Takes the members that are nearer, by exact distances; the distances from the last member."""
        square = None
        for m in members:
            self.visited += len(rows)
            square = _squares(self.parts[rows], self.entries[m])
            known = self.square[rows]
            nearer = ((square < known) | ((square == known) & (m < self.best[rows]))).astype(bool)
            self.best[rows[nearer]] = m
            self.square[rows[nearer]] = square[nearer]
        return square


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(at, BLOCK)
            flat = piece.column("embedding").flatten().to_numpy(zero_copy_only=False)
            yield piece, _integers(flat, width).reshape(-1, PARTS, width // PARTS)


def _fitting(books: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in 64 bits, or both in Python's integers."""
    if vectors.dtype == books.dtype:
        return books, vectors
    return books.astype(object), vectors.astype(object)


def _summer(books: np.ndarray, width: int):
    """Counts and sums of the parts that each entry is nearest to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = width // PARTS
        n, total = np.zeros(books.shape[:2], dtype=np.int64), np.zeros(books.shape, dtype=object)
        trees: dict = {}
        for _, vectors in _blocks(batches, width):
            known, vectors = _fitting(books, vectors)
            trees.setdefault(known.dtype, [Tree(b) for b in known])
            for p, tree in enumerate(trees[known.dtype]):
                best, _ = tree.nearest(vectors[:, p])
                n[p] += np.bincount(best, minlength=books.shape[1])
                sums = np.zeros(books.shape[1:], dtype=vectors.dtype)  # a block's sums fit 64 bits
                np.add.at(sums, best, vectors[:, p])
                total[p] += sums
        rows = []
        for p, e in zip(*np.nonzero(n), strict=True):
            for k in range(size):
                rest, sign = abs(int(total[p, e, k])), 1 if total[p, e, k] >= 0 else -1
                for digit in range(max(1, -(-rest.bit_length() // DIGIT))):
                    rows.append((p, e, k, digit, n[p, e], sign * (rest >> DIGIT * digit & (1 << DIGIT) - 1)))
        if rows:
            kinds = [pa.int32()] * 4 + [pa.int64()] * 2
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "entry", "place", "digit", "n", "total"])

    return run


def _coder(books: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict = {}
        for piece, vectors in _blocks(batches, width):
            known, vectors = _fitting(books, vectors)
            trees.setdefault(known.dtype, [Tree(b) for b in known])
            codes, error = np.zeros((len(vectors), PARTS), dtype=np.uint8), np.zeros(len(vectors), dtype=vectors.dtype)
            for p, tree in enumerate(trees[known.dtype]):
                best, square = tree.nearest(vectors[:, p])
                codes[:, p] = best
                error = error + square
            text = codes.tobytes().hex()
            error = [int(x) if x < 1 << 63 else None for x in error.tolist()]
            code = [text[2 * PARTS * k : 2 * PARTS * (k + 1)] for k in range(len(vectors))]
            yield pa.record_batch({"vec_id": piece.column("vec_id"), "label": piece.column("label"), "code": pa.array(code, pa.string()), "error": pa.array(error, pa.int64())})

    return run


def _usable(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    return rows.where(F.coalesce(finite & (F.size("embedding") > 0), F.lit(False)))


def codebooks(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """The trained codebooks (part, entry, place) of vectors (vec_id, embedding, label), as integers; None without vectors."""
    rows = _usable(vectors)
    first = rows.orderBy(F.col("vec_id").asc_nulls_first(), "embedding").select("embedding").limit(1).collect()
    if not first:
        return None
    width = len(first[0][0])
    if width % PARTS:
        raise ValueError(f"vectors of {width} components can't be cut into {PARTS} equal parts")
    rows = rows.where(F.size("embedding") == width)
    start = rows.orderBy(F.col("vec_id").asc_nulls_first(), "embedding").select("embedding").limit(entries).collect()
    books = _integers(np.array([r[0] for r in start]).ravel(), width).reshape(len(start), PARTS, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = rows.select("embedding").mapInArrow(_summer(books, width), _SUMS)
        told = sums.groupBy("part", "entry", "place", "digit").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # a row or few for each number of the codebooks
        total, n = np.zeros(books.shape, dtype=object), np.zeros(books.shape[:2], dtype=object)
        for r in told:
            total[r["part"], r["entry"], r["place"]] += r["total"] << DIGIT * r["digit"]
            if not r["digit"] and not r["place"]:
                n[r["part"], r["entry"]] = r["n"]
        used = n > 0
        made = books.astype(object)
        made[used] = total[used] // n[used][:, None]
        small = np.abs(made).max() < math.isqrt((1 << 60) // width)
        books = made.astype(np.int64) if small else made
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def encoded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of each usable vector of the codebooks' width. code: two hex digits a part."""
    width = books.shape[0] * books.shape[2]
    label = vectors.schema["label"].dataType.simpleString()
    rows = _usable(vectors).where(F.size("embedding") == width)
    return rows.mapInArrow(_coder(books, width), f"vec_id long, label {label}, code string, error long")


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels, nulls together), codebooks_sha256."""
    books = codebooks(vectors)
    if books is None:
        none = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        return none.where("false")
    # read twice: for the sums by label, which are few numbers a task before the shuffle, and for the rows
    rows, _ = _io.stored(encoded(vectors, books), "codes")
    # nulls stand apart from labels by a second column, so that the join is one on equal keys
    keyed = rows.withColumn("labelled", F.col("label").isNotNull()).withColumn("label", F.coalesce("label", F.lit(0).cast(rows.schema["label"].dataType)))
    sums = keyed.groupBy("label", "labelled").agg(F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")).alias("label_error"))
    return keyed.join(sums, ["label", "labelled"]).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """SQL of compressed() for usable vectors whose width is a multiple of PARTS."""
    steps, book = [], "book0"
    near = """near{k} AS MATERIALIZED (SELECT q.id, q.part, q.v, arg_min(b.entry, (d, b.entry)) AS entry, min(d) AS d FROM parts q JOIN {book} b USING (part),
  LATERAL (SELECT list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d) GROUP BY ALL)"""
    for k in range(ROUNDS + 1):
        steps.append(near.format(k=k, book=book))
        if k < ROUNDS:
            steps.append(f"""mean{k} AS (SELECT part, entry, list(m ORDER BY spot) AS v FROM (SELECT part, entry, spot, floor(sum(x) / count(*))::BIGINT AS m
  FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS spot FROM near{k}) GROUP BY ALL) GROUP BY ALL)""")
            steps.append(f"book{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM {book} b LEFT JOIN mean{k} m USING (part, entry))")
            book = f"book{k + 1}"
    return f"""WITH vec AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT id, p::INT AS part, e[p * len(e) // {PARTS} + 1 : (p + 1) * len(e) // {PARTS}] AS v FROM vec, range({PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT part, id - 1 AS entry, v FROM parts WHERE id <= {ENTRIES}),
{f",{chr(10)}".join(steps)},
told AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY id),
hashed AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM {book})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM told JOIN vec USING (id), hashed"""


#: Rows whose label is null stand together in a window's partition too.
ORACLE = _oracle()
