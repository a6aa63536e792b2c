"""Spelling variants: words one edit apart, by two-dimensional range reporting on wavelet trees, and the frequent form each belongs to.

Words of one length stand in forward order (by their code points) and in reverse order (by their code points from the end). A word
near a given one shares with it all before some place and all behind it: an interval of the forward order, and one of the reverse order. The
words in both are the points of a rectangle. A wavelet tree over the reverse ranks in forward order reports them, level by level, for all words and
places of a block at once. The intervals are narrowed a code point at a time, by binary search within the interval before.

Each near pair but those of equal length is found once, from its shorter word, at the leftmost place where a code point can be
inserted; replaced code points are found from both words.

The trees are spread over the cluster. An edit leaves a word's first or second half as it is, so a word of length L is held under (L, its first L/2 code points)
and under (L, the rest), and asked for under the halves that words at one edit must share with it: those before the place, or those behind it.
Keys are dealt to buckets by hash, and each bucket is a task's trees. A key of more than HOT words is split into several by the
words' hash, and asked in all of them. So a task's work stays near the same at any number of words; the driver holds counts of hot keys only where Spark
finds that list small.

Defined cases: a null text has no words. A null doc_id counts as an empty one when runs are changed. Repeated rows count each for itself. Words of any length are taken; equal
counts of near words go to the smaller one in code-point order. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _io

LETTERS = r"[A-Za-zÀ-ÿ]+"
SHORTEST, FEWEST = 6, 5
#: A run whose hash this divides loses a code point.
CHANGED = 199
#: A word's form has at least so many times its occurrences.
TIMES = 5
#: Words under one key that stay together, words held in a bucket on average, and numbers in the tables of a block.
HOT, BUCKET, BLOCK = 8192, 16_384, 2_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def runs(doc_id: Column, text: Column) -> Column:
    """The runs of letters of a text, A-Z in lower case, one in CHANGED without a code point; an array."""
    name = F.coalesce(doc_id.cast("string"), F.lit(""))

    def changed(run: Column) -> Column:
        h = F.crc32(F.concat(name, F.lit(":"), run))
        at = F.pmod(h, F.length(run).cast("long")).cast("int")
        return F.when(F.pmod(h, F.lit(CHANGED)) == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)

    lowered = F.translate(text, _UPPER, _UPPER.lower())
    return F.transform(F.regexp_extract_all(lowered, F.lit(f"({LETTERS})")), changed)


def counted(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """word, n of the documents' words of at least so many code points and occurrences."""
    each = docs.select(F.explode(runs(F.col("doc_id"), F.col("text"))).alias("word"))
    return each.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


class WaveletTree:
    """Which of a sequence's places hold a value within bounds. The sequence is a permutation of 0 to n - 1, a level for each bit of its values, the highest first."""

    def __init__(self, values: np.ndarray) -> None:
        self.n, self.bits = len(values), max(1, (len(values) - 1).bit_length())
        self.ones: list[np.ndarray] = []  # at each level, how many set bits stand before each place
        self.zeros: list[int] = []
        places = np.arange(self.n)
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(int(self.n - bit.sum()))
            order = np.argsort(bit, kind="stable")
            values, places = values[order], places[order]
        self.places = places  # of the sequence, by the value's place below the last level

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of all places from low to high - 1 whose value is from least to most - 1, for each query."""
        asked, node = np.flatnonzero((low < high) & (least < most)), None
        low, high = low[asked], high[asked]
        node = np.zeros(len(asked), dtype=np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            l1, h1 = ones[low], ones[high]
            down = [(asked, low - l1, high - h1, node), (asked, zeros + l1, zeros + h1, node + (1 << b))]
            asked, low, high, node = (np.concatenate(x) for x in zip(*down, strict=True))
            keep = (low < high) & (node < most[asked]) & (node + (1 << b) > least[asked])
            asked, low, high, node = asked[keep], low[keep], high[keep], node[keep]
        return asked, self.places[low]  # a value stands once, so each interval left is one place


def _codes(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), dtype=np.uint8).reshape(-1, length)


def _intervals(table: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each asked row and each k, the interval of the sorted table's rows that share its first k numbers. Rows asked may be shorter than the table's."""
    n, width = len(asked), asked.shape[1]
    low, high = np.zeros((n, width + 1), dtype=np.int64), np.full((n, width + 1), len(table), dtype=np.int64)
    for k in range(width):
        column, wanted = np.ascontiguousarray(table[:, k]), asked[:, k]
        ends = []
        for above in (False, True):  # the first row at or above the wanted number, and the first one above it
            a, b = low[:, k].copy(), high[:, k].copy()
            for _ in range(int((b - a).max(initial=0)).bit_length()):
                mid = (a + b) >> 1
                open_ = a < b
                seen = column[np.minimum(mid, len(table) - 1)]
                right = open_ & ((seen <= wanted) if above else (seen < wanted))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            ends.append(a)
        low[:, k + 1], high[:, k + 1] = ends
        if (low[:, k + 1] >= high[:, k + 1]).all():
            low[:, k + 1 :] = high[:, k + 1 :] = 0
            break
    return low, high


class _Shelf:
    """The words of one length that a bucket holds for one side, in both orders."""

    def __init__(self, words: list[bytes], length: int) -> None:
        table = _codes(words, length)
        self.order = np.lexsort(table.T[::-1])
        self.table = table[self.order]
        back = np.lexsort(self.table.T)
        self.backward = np.ascontiguousarray(self.table[back][:, ::-1])
        rank = np.empty(len(words), dtype=np.int64)
        rank[back] = np.arange(len(words))
        self.length, self.tree = length, WaveletTree(rank)

    def near(self, words: list[bytes], side: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index of the asked word, index of the held word) of near pairs whose edit lies on the side's place; asked words have the shelf's length or one less."""
        m, half = len(words[0]), self.length // 2
        inserted = m < self.length
        first, last = (half, self.length) if side == "P" else (0, half)
        step = max(1, BLOCK // (m + 1))
        for at in range(0, len(words), step):
            asked = _codes(words[at : at + step], m)
            low, high = _intervals(self.table, asked)
            least, most = _intervals(self.backward, np.ascontiguousarray(asked[:, ::-1]))
            cut = np.arange(first, last)  # the place of the edit in the held word
            behind = self.length - 1 - cut
            grid = [x[:, c].ravel() for x, c in ((low, cut), (high, cut), (least, behind), (most, behind))]
            query, place = self.tree.report(*grid)
            row, cut = query // len(cut), cut[query % len(cut)]
            if inserted:  # at the leftmost place only
                other = asked[row, np.minimum(cut, m - 1)]
                good = (cut == m) | (self.table[place, cut] != other)
            else:
                good = self.table[place, cut] != asked[row, cut]
            yield at + row[good], self.order[place[good]]


def _reporter(held: pa.Table, asked: pa.Table) -> pa.Table:
    """word, near, near_n of the near pairs in a bucket, both ways."""
    out: list[tuple[pa.Array, pa.Array, pa.Array]] = []
    shelves: dict[tuple[str, int], list[int]] = {}
    names, counts = held.column("word").to_pylist(), held.column("n").to_numpy()
    for k, (side, word) in enumerate(zip(held.column("side").to_pylist(), names, strict=True)):
        shelves.setdefault((side, len(word)), []).append(k)
    queries: dict[tuple[str, int, int], list[int]] = {}
    wanted, wanted_n, seen = asked.column("word").to_pylist(), asked.column("n").to_numpy(), set()
    for k, (side, target, word) in enumerate(zip(asked.column("side").to_pylist(), asked.column("target").to_pylist(), wanted, strict=True)):
        if (side, target) in shelves and (side, target, word) not in seen:  # two shares of a key may have met here
            seen.add((side, target, word))
            queries.setdefault((side, target, len(word)), []).append(k)
    names, wanted = (np.array(x, dtype=object) for x in (names, wanted))
    made: dict[tuple[str, int], _Shelf] = {}
    for (side, target, length), rows in queries.items():
        own = np.array(shelves[side, target])
        if (side, target) not in made:
            made[side, target] = _Shelf([x.encode("latin-1") for x in names[own]], target)
        mine = np.array(rows)
        for a, b in made[side, target].near([x.encode("latin-1") for x in wanted[mine]], side):
            a, b = mine[a], own[b]
            out.append((wanted[a], names[b], counts[b]))
            if length < target:
                out.append((names[b], wanted[a], wanted_n[a]))
    word, near, n = (np.concatenate(x) for x in zip(*out, strict=True)) if out else ([], [], [])
    return pa.table({"word": pa.array(word, pa.string()), "near": pa.array(near, pa.string()), "near_n": pa.array(n, pa.int64())})


def near_words(words: DataFrame, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """word, near, near_n: all pairs of words (word, n; distinct, code points up to 255) that differ by one inserted, deleted or replaced code point, both ways."""
    spark = words.sparkSession
    length, word = F.length("word"), F.col("word")
    half = F.floor(length / 2).cast("int")
    longer = F.floor((length + 1) / 2).cast("int")

    def under(side: str, target: Column, part: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), target.cast("int").alias("target"), part.alias("part"))

    held_under = F.array(under("P", length, F.left(word, half)), under("S", length, F.substr(word, half + 1)))
    asked_under = F.array_union(held_under, F.array(under("P", length + 1, F.left(word, longer)), under("S", length + 1, F.substr(word, longer))))
    held = words.select("word", "n", F.explode(held_under).alias("k")).select("word", "n", "k.*")
    asked = words.select("word", "n", F.explode(asked_under).alias("k")).select("word", "n", "k.*")
    many = held.groupBy("side", "target", "part").agg(F.count("*").alias("rows")).where(F.col("rows") > hot).select("side", "target", "part", F.ceil(F.col("rows") / hot).cast("int").alias("split"))
    many, path = _io.stored(many, "spelling-hot")
    n = words.count()
    buckets = max(1, -(-2 * n // bucket))
    key = ["side", "target", "part"]

    def dealt(rows: DataFrame, share: Column) -> DataFrame:
        split = rows.join(many, key, "left").withColumn("share", share)
        place = F.pmod(F.xxhash64("side", "target", "part", "share"), F.lit(buckets)).cast("int")
        return split.select(place.alias("bucket"), *(F.col(c).alias(c) for c in ("side", "target", "word", "n")))  # the same table on both sides: by names of its own

    split = F.coalesce("split", F.lit(1))
    held = dealt(held, F.pmod(F.xxhash64("word"), split).cast("int"))
    asked = dealt(asked, F.explode(F.sequence(F.lit(0), split - 1)))
    return held.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_reporter, "word string, near string, near_n long")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word, root of links (word, form): each word's last form, in as many doublings as the largest count allows."""
    spark, known = forms.sparkSession, forms.select("word", F.col("form").alias("root"))
    longest, n = 1, most
    while n >= TIMES:
        longest, n = longest + 1, n // TIMES
    known, path = _io.stored(known, "spelling-roots")
    for _ in range(longest.bit_length()):
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = known.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        before, (known, path) = path, _io.stored(step, "spelling-roots")
        _io.drop(spark, before)
    return known


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the documents."""
    words, _ = _io.stored(counted(docs), "spelling-words")
    pairs = near_words(words)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("s"), F.col("near").alias("near"))).alias("b"))
    told = words.join(best, "word", "left")
    form_n = -F.col("b.s")
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form_n >= TIMES * F.col("n"), F.struct(F.col("b.near").alias("form"), form_n.alias("n"))).alias("f"))
    told, _ = _io.stored(told.select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.n").alias("form_n")), "spelling-forms")
    most = told.agg(F.max("n")).first()[0] or 0
    last = roots(told.where("form is not null"), most)
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: SQL of variants() for documents with a doc_id. crc32 is worked out byte by byte, from a table made by its rule.
ORACLE = rf"""WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i::BIGINT) AS c FROM range(256) r(i))),
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{LETTERS}')) AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS n, hex(doc_id::VARCHAR || ':' || w) AS x FROM run GROUP BY ALL),
hashed AS (SELECT w, n, xor(4294967295::BIGINT, list_reduce(list_transform(range(len(x) // 2), lambda k: ('0x' || substr(x, 2 * k::INT + 1, 2))::BIGINT),
  lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT)) AS h FROM each, tab),
word AS MATERIALIZED (SELECT CASE WHEN h % {CHANGED} = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {SHORTEST} AND sum(n) >= {FEWEST}),
spot AS (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM word),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM spot),
shorter AS (SELECT DISTINCT l.word AS a, l.n AS na, s.word AS b, s.n AS nb FROM less l JOIN word s ON s.word = l.rest),
near AS (SELECT a AS word, b AS other, nb AS m FROM shorter UNION ALL SELECT b, a, na FROM shorter
  UNION ALL SELECT l.word, r.word, r.n FROM less l JOIN less r ON l.i = r.i AND l.rest = r.rest AND l.word <> r.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS form, max(m) AS m FROM near GROUP BY 1),
told AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * n THEN form END AS form, CASE WHEN m >= {TIMES} * n THEN m END AS form_n FROM word LEFT JOIN best USING (word)),
last AS (SELECT word, word AS root FROM told WHERE form IS NULL UNION ALL SELECT told.word, last.root FROM told JOIN last ON told.form = last.word)
SELECT told.word, form, root, n, n_near, form_n FROM told JOIN last USING (word)"""
