"""MinHash near-dedup by SuperMinHash.

Each text's set of five-word shingles gets a SuperMinHash signature: an element's ranks are a random
permutation plus a fraction, drawn step by step, and a set stops as soon as no later step can lower a slot.
Equal sets become one class at once. Bands of signature slots propose pairs of classes, every proposed pair is
confirmed on the full sets, and union-find (alternating large and small stars) groups what is linked.

No bucket is expanded into its pairs. A bucket compares its members with one pivot. Members of buckets that then still
hold several components go through an exact prefix-filter join, which proposes every similar pair among them that
is not connected yet. With BANDS x ROWS a pair at similarity 0.85 shares no bucket with a probability below 1e-6,
one at 0.8 below 3e-4.

Defined cases: null and empty texts and texts without words have an empty set, no links and are kept; with
fewer than five words the whole sequence is the one shingle. Rows that share a doc_id are one vertex. A row
without doc_id is linked with nothing. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _io, _text

WIDTH = 5
BANDS, ROWS = 36, 7
SLOTS = BANDS * ROWS
_STEP = 0x9E3779B97F4A7C15
#: Elements whose permutations are held at once.
_BLOCK = 100_000


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, and where each text's begin (one more at the end)."""
    words = _text.Words([_text.lowered(t) for t in texts])
    hashes = words.hashes()
    gram, doc = _text.shingles(words, hashes, WIDTH)
    n_words = np.diff(words.first)
    short = np.flatnonzero((n_words > 0) & (n_words < WIDTH))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for k in range(WIDTH - 1):
            has = n_words[short] > k
            whole[has] = whole[has] * np.uint64(0xA0761D6478BD642F) + hashes[words.first[short[has]] + k]
        gram, doc = np.concatenate([gram, _text.mix(whole + n_words[short].astype(np.uint64))]), np.concatenate([doc, short])
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[new], doc[new]
    return gram, np.searchsorted(doc, np.arange(len(texts) + 1))


def _draw(element: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The fraction of step j and the place from j to m - 1 to swap with."""
    one, two = (np.uint64(_STEP * x % 2**64) for x in (2 * j + 1, 2 * j + 2))
    r = (_text.mix(element + one) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    k = j + ((_text.mix(element + two) >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
    return r, k


def signatures(gram: np.ndarray, first: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, a row for each set; empty sets get rows of infinities. m is at most 256."""
    n = len(first) - 1
    h = np.full((n, m), np.inf)
    flat = h.reshape(-1)
    doc = np.repeat(np.arange(n), np.diff(first))
    r, k0 = _draw(gram, 0, m)
    np.minimum.at(flat, doc * m + k0, r)
    open_ = (h.max(axis=1) >= 1) & (np.diff(first) > 0)
    sizes = np.where(open_, np.diff(first), 0)
    block = np.cumsum(sizes) // _BLOCK
    for b in np.unique(block[open_]):
        own = np.flatnonzero(open_ & (block == b))
        at = np.concatenate([np.arange(first[d], first[d + 1]) for d in own])
        e, d, k = gram[at], doc[at], k0[at]
        p = np.tile(np.arange(m, dtype=np.uint8), (len(e), 1))
        rows = np.arange(len(e))
        p[rows, k] = 0
        p[:, 0] = k
        for j in range(1, m):
            r, k = _draw(e, j, m)
            rows = np.arange(len(e))
            slot = p[rows, k]
            p[rows, k] = p[:, j]
            p[:, j] = slot
            np.minimum.at(flat, d * m + slot, r + j)
            going = np.zeros(n, dtype=bool)
            going[own] = h[own].max(axis=1) >= j + 1
            stay = going[d]
            if not stay.all():
                own, e, d, p = own[going[own]], e[stay], d[stay], p[stay]
            if not len(e):
                break
    return h


def band_keys(h: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    v = _text.mix(h.view(np.uint64)).reshape(len(h), bands, -1)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(h), 1))
    for k in range(v.shape[2]):
        out = _text.mix(out * np.uint64(0xD6E8FEB86659FD93) + v[:, :, k])
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in _text.chunks(batches):
        gram, first = shingle_sets(texts)
        n = np.diff(first)
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(_text.mix(gram ^ np.uint64(s)))]) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
        fp = [(x[first[1:]] - x[first[:-1]]).view(np.int64) for x in sums]
        keys = band_keys(signatures(gram, first)).view(np.int64)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)), mask=pa.array(n == 0))
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(n, pa.int64()), "fp1": pa.array(fp[0]), "fp2": pa.array(fp[1]), "bands": bands})


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set, and the band keys (null for an empty set)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_describe, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>")


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.compute.binary_length(batch.column("text_a").cast(pa.large_binary())).to_numpy(zero_copy_only=False)
            cut = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), _text.CHUNK // 2))
            for at, to in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                part = batch.slice(at, to - at)
                if not part.num_rows:
                    continue
                sets = []
                for name in ("text_a", "text_b"):
                    texts = [x or b"" for x in part.column(name).cast(pa.large_binary()).to_pylist()]
                    distinct = {t: k for k, t in enumerate(dict.fromkeys(texts))}
                    gram, first = shingle_sets(list(distinct))
                    sets.append((gram, first, [distinct[t] for t in texts]))
                (ga, fa, ia), (gb, fb, ib) = sets
                keep = np.zeros(part.num_rows, dtype=bool)
                for k, (a, b) in enumerate(zip(ia, ib, strict=True)):
                    x, y = ga[fa[a] : fa[a + 1]], gb[fb[b] : fb[b + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
                yield pa.record_batch({"a": part.column("a").filter(pa.array(keep)), "b": part.column("b").filter(pa.array(keep))})

    return confirm


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union. texts: doc_id, text."""
    needed = texts.join(pairs.select(F.col("b").alias("doc_id")).union(pairs.select(F.col("a").alias("doc_id"))).distinct(), "doc_id", "left_semi")
    needed, path = _io.stored(needed, "texts")
    side = lambda x: needed.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    out, _ = _io.stored(both.mapInArrow(_confirmer(percent), "a long, b long").distinct(), "links")
    _io.drop(texts.sparkSession, path)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of the edges (a, b) can reach. Alternates large and small stars; every round is written to the shared folder."""
    spark = edges.sparkSession
    now, path = _io.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == seen:
            break
        seen = state.n, state.h
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, path_l = _io.stored(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        small, path_s = _io.stored(small, "stars")
        _io.drop(spark, path, path_l)
        now, path = small, path_s
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _spell_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in _text.chunks(batches):
        gram, first = shingle_sets(texts)
        rep = np.repeat(batch.column("doc_id").to_numpy(), np.diff(first))
        for at in range(0, len(gram), 500_000):
            yield pa.record_batch({"rep": pa.array(rep[at : at + 500_000]), "h": pa.array(gram[at : at + 500_000].view(np.int64))})


def prefix_pairs(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components among which are all that reach the similarity: prefix filtering. members: rep, n, component.

    Shingles are ordered from rare to frequent among the members. Two sets can only be similar enough if they share
    one of their first n - ceil(similarity * n) + 1 shingles, with enough behind it. Shingles of one member only
    come first and match nothing: sets that differ from all others in too many shingles drop out without a comparison.
    In each shingle's bucket those outside its most frequent component are compared with the others.
    """
    own = texts.join(members.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_spell_out, "rep long, h long")
    own, _ = _io.stored(own, "shingles")
    shared = own.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    order = Window.partitionBy("rep").orderBy("df", "h")
    ranked = own.join(shared, "h").withColumns({"at": F.row_number().over(order), "c": F.count("*").over(Window.partitionBy("rep"))})
    entries = ranked.join(members, "rep").withColumn("pos", F.col("n") - F.col("c") + F.col("at") - 1)
    entries = entries.where(f"pos <= n - cast(ceil({percent} * n / 100) as long)").select("h", "rep", "n", "component", "pos")
    entries, _ = _io.stored(entries, "prefixes")
    share = entries.groupBy("h", "component").agg(F.count("*").alias("k"))
    main = share.groupBy("h").agg(F.max(F.struct("k", "component")).alias("t"), F.count("*").alias("several")).where("several > 1").select("h", F.col("t.component").alias("main"))
    some = entries.join(main, "h")
    left = some.where("component <> main").select("h", *(F.col(c).alias(f"{c}_x") for c in ("rep", "n", "component", "pos")))
    enough = f"100 * least(n, n_x) >= {percent} * greatest(n, n_x) and {100 + percent} * least(n - pos, n_x - pos_x) >= {percent} * (n + n_x)"
    return left.join(some, on=[left["h"] == some["h"], F.expr("component <> component_x"), F.expr(enough)]).select(F.greatest("rep", "rep_x").alias("a"), F.least("rep", "rep_x").alias("b")).distinct()


def joined(classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """node, component of all classes that are linked with another. classes: rep, n (set size), bands."""
    near = f"100 * least(n, pn) >= {percent} * greatest(n, pn)"
    rows = classes.select("rep", F.explode("bands").alias("key"))
    several = rows.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("other")).where("pivot <> other").select("key", "pivot")
    rows, _ = _io.stored(rows.join(several, "key").select("key", "rep", "pivot"), "buckets")
    sizes = classes.select("rep", "n")
    pairs = rows.where("rep <> pivot").select("rep", "pivot").distinct().join(sizes, "rep").join(sizes.select(F.col("rep").alias("pivot"), F.col("n").alias("pn")), "pivot").where(near)
    pairs, _ = _io.stored(pairs.select(F.col("rep").alias("a"), F.col("pivot").alias("b")), "pairs")
    found = confirmed(pairs, texts, percent)
    comp, _ = _io.stored(components(found), "components")
    # buckets whose members aren't all of one component now
    told = rows.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    spread = told.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    members, _ = _io.stored(told.join(spread, "key", "left_semi").select("rep", "component").distinct().join(sizes, "rep"), "members")
    if members.isEmpty():
        return comp
    more, _ = _io.stored(prefix_pairs(members, texts, percent).join(pairs, ["a", "b"], "left_anti"), "pairs")
    if more.isEmpty():
        return comp
    return components(found.union(confirmed(more, texts, percent)))


def grouped(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept (it is its own component's id) of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told, _ = _io.stored(described(docs), "signatures")
    classes = told.where("n_shingles > 0 and doc_id is not null").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"))
    classes, _ = _io.stored(classes, "classes")
    reps = told.join(classes.select(F.col("rep").alias("doc_id"), "fp1", "fp2"), ["doc_id", "fp1", "fp2"], "left_semi")
    comp = joined(reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands"), docs, percent)
    owner = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("fp1", "fp2", F.coalesce("component", "rep").alias("component"))
    out = told.select("doc_id", "n_shingles", "fp1", "fp2").join(owner, ["fp1", "fp2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.least("doc_id", "component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without those that resemble one of a smaller doc_id, with all their columns; of rows that share a doc_id all stay or none."""
    groups, _ = _io.stored(grouped(docs, percent).where("not kept").select("doc_id").distinct(), "near-copies")
    return docs.join(groups, "doc_id", "left_anti")
