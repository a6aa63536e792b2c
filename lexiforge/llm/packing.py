"""Best-fit packing of token sequences by the linear grouping scheme.

Texts are tokenised where they lie and cut into pieces of at most CAPACITY tokens; only the lengths go on. How
many pieces there are of each length is all that the plan needs, and that is at most CAPACITY numbers however
large the corpus is. Large lengths are dealt into groups of equal cardinality and rounded up to their group's
largest; column generation finds the configurations of these few sizes; actual pieces are substituted, each the longest
that leaves room for the slots still to come, so that what rounding leaves free in one slot goes to the next; then small
pieces, and large ones left over from rounding the configurations down, go best-fit into the gaps, longest first.
The plan is a list of rules of the form "pieces of length L and ranks r to r + n go to sequences from b on, at offset o"; a
piece finds its place by its length and its rank among pieces of that length.

Ids are those of byte_bpe_50k.json as the tokenizers library gives them with add_special_tokens=False: the string of an added
token in a text is that token. Its vocabulary is handed to tiktoken, which gives the same ids several times faster; a
text that tiktoken refuses, and a vocabulary whose added tokens swallow blanks or want whole words, goes to tokenizers itself.

Defined cases: a null or empty text has the one id 0. Repeated rows are packed each for itself. A null doc_id stays
null. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _io, _text

CAPACITY = 2048
END = 0
#: Lengths above a share of the capacity are large; they are rounded up within a number of groups. Sequences hold two large pieces, or up to three. Both are tried on the tally of lengths, and the fewer sequences win.
SETTINGS = ((1 / 3, 256), (1 / 4, 128))
#: Pieces of one length that are ranked in a task.
SLICE = 65_536
_ENCODERS: dict[str, tuple] = {}


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, others for code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def encoder(path: str | None = None):
    """A function from text to its ids as a uint32 array. path: of the vocabulary, on each executor."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        letters, added = _byte_letters(), {x["content"]: x["id"] for x in made["added_tokens"]}
        plain = not any(x.get(k) for x in made["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
        ranks = {bytes(letters[c] for c in t): i for t, i in made["model"]["vocab"].items() if t not in added}
        fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added) if plain else None
        _ENCODERS[path] = fast, Tokenizer.from_file(path)
    fast, slow = _ENCODERS[path]

    def encode(text: str) -> np.ndarray:
        if fast is not None:
            try:
                return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException:  # a panic of the library's regular expressions isn't an Exception
                pass
        return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, np.ndarray]]:
    """Start and ids of each piece: all of full capacity but the first, which takes the rest."""
    first = (len(ids) - 1) % capacity + 1
    return [(0, ids[:first]), *((at, ids[at : at + capacity]) for at in range(first, len(ids), capacity))]


def _cutter(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch, texts in _text.chunks(batches):
            doc_ids, rows = batch.column("doc_id").to_pylist(), []
            for doc_id, text in zip(doc_ids, texts, strict=True):
                ids = np.append(encode(text.decode()), np.uint32(END)).astype("<u4")
                rows += [(doc_id, k, at, len(x), zlib.crc32(x.tobytes())) for k, (at, x) in enumerate(cut(ids, capacity))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cutter(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _priciest(worth: np.ndarray, sizes: np.ndarray, room: np.ndarray, fits: np.ndarray) -> tuple[float, list[int]]:
    """The worth and the sizes (by index) of the best configuration: a knapsack, filled one slot after another. room: capacity left by each size at each capacity."""
    every, c = np.arange(len(room)), len(room) - 1
    best, picks = np.zeros(len(room)), []
    for _ in range(int(c // sizes.min()) - 1):
        value = np.where(fits, worth + best[room], -1.0)
        g = value.argmax(axis=1)
        more = value[every, g] > best
        best, pick = np.where(more, value[every, g], best), np.where(more, g, -1)
        picks.append(pick)
    value = np.where(fits[c], worth + best[room[c]], -1.0)  # the last slot is of use at full capacity only
    top, slots = int(value.argmax()), []
    if value[top] > best[c]:
        slots.append(top)
        c -= sizes[top]
    for pick in reversed(picks):
        if pick[c] >= 0:
            slots.append(int(pick[c]))
            c -= sizes[pick[c]]
    return max(float(best[-1]), float(value[top])), slots


def _times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a @ x without BLAS, whose threads may never wake in a driver that has started other processes."""
    return np.einsum("ij,j->i", a, x)


def _inverse(basis: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row pivots; without BLAS, as above."""
    k = len(basis)
    a = np.hstack([basis, np.eye(k)])
    for j in range(k):
        p = j + int(np.abs(a[j:, j]).argmax())
        if p != j:
            a[[j, p]] = a[[p, j]]
        a[j] /= a[j, j]
        rows = np.flatnonzero(a[:, j])
        rows = rows[rows != j]
        a[rows] -= a[rows, j, None] * a[j]
    return a[:, k:]


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Configurations of a few sizes, and how often to use each (not whole numbers), that cover the counts: column generation on the linear programme."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / basis.diagonal())
    use = _times(inverse, counts.astype(float))
    left = np.arange(capacity + 1)[:, None] - sizes
    fits, room = left >= 0, np.maximum(left, 0)
    for step in range(rounds):
        if step % 64 == 63:
            inverse = _inverse(basis)
            use = _times(inverse, counts.astype(float))
        worth, slots = _priciest(inverse.sum(axis=0), sizes, room, fits)
        if worth <= 1 + 1e-6:
            break
        column = np.bincount(slots, minlength=k).astype(float)
        change = _times(inverse, column)
        ratio = np.where(change > 1e-9, use / np.where(change > 1e-9, change, 1), np.inf)
        j = int(ratio.argmin())
        basis[:, j] = column
        row = inverse[j] / change[j]
        inverse -= np.outer(change, row)
        inverse[j] = row
        use = np.maximum(use - ratio[j] * change, 0)
        use[j] = ratio[j]
    use = _times(_inverse(basis), counts.astype(float))
    return [(basis[:, j].astype(int), float(use[j])) for j in range(k) if use[j] > 1e-9]


class Plan:
    """Rules that place n pieces of a length, from a rank on, into sequences from bin on, each at offset and `each` to a sequence."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY, large: float = SETTINGS[0][0], groups: int = SETTINGS[0][1]) -> None:
        """counts: of each length from 0 to capacity."""
        self.capacity, self.left = capacity, [int(x) for x in counts]
        self.next = [0] * (capacity + 1)
        self.bins, self.configured = 0, 0  # sequences, and pieces that a configuration placed
        self.rules: list[tuple[int, int, int, int, int, int]] = []  # length, rank, n, bin, offset, each
        self.gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free tokens: first bin and number of bins
        if self.left[capacity]:
            self._put(capacity, self.left[capacity], self._open(self.left[capacity]), 0, 1)
        self._group(int(capacity * large), groups)
        for length in range(capacity, 0, -1):
            self._best_fit(length)

    def _open(self, n: int) -> int:
        self.bins += n
        return self.bins - n

    def _put(self, length: int, n: int, first: int, offset: int, each: int) -> None:
        self.rules.append((length, self.next[length], n, first, offset, each))
        self.next[length] += n
        self.left[length] -= n

    def _group(self, above: int, groups: int) -> None:
        lengths = [x for x in range(self.capacity, above, -1) if self.left[x]]
        total = sum(self.left[x] for x in lengths)
        if not total:
            return
        groups, at = min(groups, total), 0
        rounded: dict[int, int] = {}  # pieces by their group's largest length; a length may straddle groups
        largest: dict[int, int] = {}
        for x in lengths:
            n = self.left[x]
            while n:
                g = at * groups // total
                take = min(n, -(-(g + 1) * total // groups) - at)
                size = largest.setdefault(g, x)
                rounded[size] = rounded.get(size, 0) + take
                at, n = at + take, n - take
        sizes, counts = np.array(list(rounded)), np.array(list(rounded.values()))
        for column, use in sorted(configurations(sizes, counts, self.capacity), key=lambda x: -x[1]):
            slots = [int(sizes[g]) for g in np.flatnonzero(column) for _ in range(column[g])]
            self._substitute(slots, int(use + 1e-6), above)

    def _substitute(self, slots: list[int], many: int, above: int) -> None:
        """Fills a configuration so many times with actual pieces, as many sequences at once as can have the same lengths."""
        while many:
            room, rest, taken = self.capacity, sum(slots), dict[int, int]()
            for size in slots:
                rest -= size
                x = room - rest  # at least the slot's size
                while x > above and self.left[x] <= taken.get(x, 0):
                    x -= 1
                if x > above:
                    taken[x] = taken.get(x, 0) + 1
                    room -= x
            if not taken:
                return
            n = min(many, *(self.left[x] // m for x, m in taken.items()))
            first, offset = self._open(n), 0
            for x, m in sorted(taken.items(), reverse=True):
                self._put(x, n * m, first, offset, m)
                offset += x * m
                self.configured += n * m
            self.gaps[room].append((first, n))
            many -= n

    def _best_fit(self, length: int) -> None:
        free = length
        while self.left[length]:
            n = self.left[length]
            while free <= self.capacity and not self.gaps[free]:
                free += 1
            if free > self.capacity:
                need = -(-n // (self.capacity // length))
                self.gaps[self.capacity].append((self._open(need), need))
                free = self.capacity
            bin_, bins = self.gaps[free].pop()
            each = free // length
            full = min(bins, n // each)
            if full:
                self._put(length, full * each, bin_, self.capacity - free, each)
                self.gaps[free - each * length].append((bin_, full))
                if free - each * length >= length:
                    free = length
            rest = self.left[length]
            if full < bins:
                if rest:  # fewer than each
                    self._put(length, rest, bin_ + full, self.capacity - free, rest)
                    self.gaps[free - rest * length].append((bin_ + full, 1))
                    full += 1
                if full < bins:
                    self.gaps[free].append((bin_ + full, bins - full))

    def arrays(self) -> dict[str, np.ndarray]:
        rules = np.array(sorted(self.rules), dtype=np.int64).reshape(-1, 6)
        return {"key": rules[:, 0] << np.int64(46) | rules[:, 1], **{k: rules[:, j] for j, k in enumerate(("length", "rank", "n", "bin", "offset", "each"))}}


def best_plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    return min((Plan(counts, capacity, *x) for x in SETTINGS), key=lambda p: p.bins)


def _placer(rules):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = rules.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            at = np.searchsorted(r["key"], length << np.int64(46) | rank, side="right") - 1
            t = rank - r["rank"][at]
            sequence, offset = r["bin"][at] + t // r["each"][at], r["offset"][at] + t % r["each"][at] * length
            yield pa.record_batch([*(batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    spark = docs.sparkSession
    cut_up, _ = _io.stored(pieces(docs, path, capacity), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most capacity rows
        counts[r["length"]] = r["n"]
    rules = spark.sparkContext.broadcast(best_plan(counts, capacity).arrays())
    # pieces of one length are ranked in slices, as many as keep a slice small
    slices = max(16, -(-int(counts.max()) // SLICE))
    cut_up = cut_up.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    tally = cut_up.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = tally.select("length", "slice", (F.sum("n").over(before) - F.col("n")).alias("base"))
    within = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut_up.withColumn("rank", F.row_number().over(within)).join(base, ["length", "slice"]).withColumn("rank", F.col("rank") - 1 + F.col("base"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(_placer(rules), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
