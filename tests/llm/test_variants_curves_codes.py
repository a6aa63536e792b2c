"""Spelling variants, packing along a curve and vector codes against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lexiforge.llm import curve_packing, packing, spelling, vector_codes

from .helpers import UPPER, corpus, frame


# --- spelling variants --------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in near.items() if x}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}

    def last(w):
        return last(form[w]) if w in form else w

    return {w: (form.get(w), last(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def edited(rnd, word, letters):
    i, c = rnd.randrange(len(word)), rnd.choice(letters)
    return rnd.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word])


def noisy(seed, letters, n=900, stems=12):
    """Rows of words, many of them one or two edits from a few stems."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(6, 11))) for _ in range(stems)] + ["aaaaaaa", "aaaaaa", "ab" * 40, "ab" * 39 + "a"]
    out = []
    for k in range(n):
        made = []
        for _ in range(40):
            w = rnd.choice(base[: rnd.choice([2, 6, len(base)])])
            for _ in range(rnd.choice([0, 0, 0, 1, 2])):
                w = edited(rnd, w, letters)
            made.append(rnd.choice([w, w, w.upper() if w.isascii() else w, w.capitalize()]))
        out.append((k, rnd.choice([" ", "\n", "-7 "]).join(made)))
    return out


@pytest.mark.parametrize(("seed", "letters"), [(0, "ab"), (1, "abcdefghij"), (2, "aéÿàz")])
def test_variants(spark, seed, letters):
    rows = [*noisy(seed, letters, 250), (None, "wortwort " * 7), (5, None), (5, ""), (6, "doppel doppel"), (6, "doppel doppel"), (6, "doppel doppel")]
    docs = frame(spark, [(k, t, None, None, None) for k, t in rows])
    got = {r["word"]: tuple(r[c] for c in ("form", "root", "n", "n_near", "form_n")) for r in spelling.variants(docs).collect()}
    expected = plain_variants(rows)
    assert got == expected
    assert any(x[0] for x in expected.values())
    con = duckdb.connect()
    con.register("documents", docs.where("doc_id is not null").select("doc_id", "text").toPandas())
    told = {w: tuple(rest) for w, *rest in con.sql(f"SELECT word, form, root, n, n_near, form_n FROM ({spelling.ORACLE})").fetchall()}
    assert told == plain_variants([r for r in rows if r[0] is not None])


def test_roots_follow_chains_to_their_end(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(9)] + [("x", "w4")]
    got = dict(spelling.roots(spark.createDataFrame(links, "word string, form string"), 5**10).collect())
    assert got == {k: "w9" for k, _ in links}


@pytest.mark.parametrize(("hot", "bucket"), [(8192, 16384), (3, 16384), (2, 7)])
def test_hot_keys_and_many_buckets_lose_no_pair(spark, hot, bucket):
    rnd = random.Random(4)
    words = sorted({"stem" + "".join(rnd.choice("abc") for _ in range(rnd.randint(2, 5))) for _ in range(200)})
    n = {w: k + 1 for k, w in enumerate(words)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = [tuple(r) for r in spelling.near_words(df, hot, bucket).collect()]
    assert sorted(got) == sorted((a, b, n[b]) for a in words for b in words if one_edit(a, b))


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 300):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        bounds = [np.sort(rng.integers(0, n + 1, (50, 2)), axis=1) for _ in range(2)]
        query, place = tree.report(bounds[0][:, 0], bounds[0][:, 1], bounds[1][:, 0], bounds[1][:, 1])
        expected = {(q, p) for q in range(50) for p in range(*bounds[0][q]) if bounds[1][q][0] <= values[p] < bounds[1][q][1]}
        assert len(query) == len(expected) and set(zip(query.tolist(), place.tolist(), strict=True)) == expected


# --- packing along a curve ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_goes_through_every_place_step_by_step(dimensions, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    key = curve_packing.hilbert(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("total", [0, 1, 63, 64, 65, 127, 640])
def test_end_of_the_line_is_cut_into_powers_of_two(total):
    sizes = np.diff(curve_packing.edges(total, 64)).tolist()
    assert sum(sizes) == total % 64 and all(x & (x - 1) == 0 for x in sizes) and sizes == sorted(sizes, reverse=True)


@pytest.mark.parametrize("capacity", [1024, 64])
def test_curve_packing_round_trip(spark, capacity):
    rows = [*corpus(n=20), (None, "no id", None, None, None), (7, "same row", None, None, None), (7, "same row", None, None, None)]
    docs = frame(spark, rows)
    encode = packing.encoder()
    ids = defaultdict(list)
    for doc_id, text, *_ in rows:
        ids[doc_id].append(np.append(encode(text or ""), np.uint32(0)).astype("<u4"))
    got = curve_packing.packed(docs, capacity=capacity).collect()
    told = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    for doc_id, held in ids.items():
        parts = sorted((start, length) for (d, start, length, _, _), n in told.items() for _ in range(n) if d == doc_id)
        assert sum(length for _, length in parts) == sum(map(len, held))
        if len(held) == 1:
            assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
    short = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        if at != capacity:
            short.append(at)
    assert all(x & (x - 1) == 0 for x in short) and len(short) <= capacity.bit_length()
    assert sum(map(len, sum(ids.values(), []))) == sum(len(s) for s in ids.values() for s in s)


def test_documents_alike_lie_together_on_the_curve(spark):
    rnd = random.Random(1)
    topics = [[f"{t}{w}" for w in ("alpha", "beta", "gamma", "delta", "omega", "sigma")] for t in ("red", "blue", "green", "white")]
    rows = [(k, " ".join(rnd.choice(topics[k % 4]) for _ in range(60)), None, None, None) for k in range(80)]
    got = curve_packing.packed(frame(spark, rows)).collect()
    topic = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        topic.setdefault(r["doc_id"], r["doc_id"] % 4)
    order = list(topic.values())
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) <= 20  # of 79; about 59 if order meant nothing


def test_no_documents(spark):
    docs = frame(spark, [])
    assert curve_packing.packed(docs).collect() == [] and spelling.variants(docs).collect() == []
    assert spelling.variants(frame(spark, [(1, None, None, None, None), (2, "tiny", None, None, None)])).collect() == []


# --- vector codes -------------------------------------------------------------------------------------------------------


def plain_codes(rows, entries=64):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    size = width // 16
    ints = [[math.floor(Fraction(x) * 256) for x in v] for _, v, _ in kept]
    parts = [[tuple(v[p * size : (p + 1) * size]) for p in range(16)] for v in ints]
    books = [[v[p] for v in parts[:entries]] for p in range(16)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        groups = defaultdict(list)
        for v in parts:
            for p in range(16):
                groups[p, nearest(p, v[p])[1]].append(v[p])
        for (p, k), g in groups.items():
            books[p][k] = tuple(sum(c) // len(g) for c in zip(*g, strict=True))
    told = [[nearest(p, v[p]) for p in range(16)] for v in parts]
    sums = Counter()
    for r, t in zip(kept, told, strict=True):
        sums[r[2]] += sum(d for d, _ in t)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fit = lambda x: x if x < 1 << 63 else None
    return sorted(((r[0] is not None, r[0], "".join(f"{k:02x}" for _, k in t), fit(sum(d for d, _ in t)), fit(sums[r[2]]), sha) for r, t in zip(kept, told, strict=True)), key=repr)


def vectors(seed, n=150, width=32, scale=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * scale
    x[n // 3 : n // 2] = np.round(x[n // 3 : n // 2] * 8) / 8  # many ties
    x[n // 2 : 2 * n // 3] = x[n // 2]  # copies
    return [(int(k) * 3 % n, [float(v) for v in r], [1, 2, None][int(k) % 3]) for k, r in enumerate(x)]


ODD = [(900, None, 1), (901, [], 1), (902, [0.1] * 31 + [None], 1), (903, [float("nan")] * 32, 2), (904, [float("inf")] * 32, 2), (905, [0.5] * 16, 2), (3, [0.25] * 32, 1), (3, [0.25] * 32, 1), (None, [0.125] * 32, None)]


@pytest.mark.parametrize("rows", [vectors(0) + ODD, vectors(1, 40), vectors(2, 120, 64, 3.0), vectors(3, 90) + [(500, [1e30] * 32, 1), (501, [-3e9] * 32, 7), (502, [2.0**60] * 32, 7)]], ids=["odd", "few", "wide", "huge"])
def test_vector_codes(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as code", "1 as part", "2L as error")
    got = sorted(((r["vec_id"] is not None, r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.compressed(df.repartition(3)).collect()), key=repr)
    assert got == plain_codes(rows)


def test_no_vectors_and_wrong_widths(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compressed(df).collect() == []
    with pytest.raises(ValueError, match="17 components"):
        vector_codes.compressed(spark.createDataFrame([(1, [0.5] * 17, 1)], "vec_id long, embedding array<double>, label int"))


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_the_nearest_and_leaves_some_out(seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-60, 60, (64, 4)) if seed else np.repeat(rng.integers(-3, 3, (16, 4)), 4, axis=0)
    parts = np.concatenate([rng.integers(-80, 80, (500, 4)), entries])
    tree = vector_codes.Tree(entries)
    best, square = tree.nearest(parts)
    every = ((parts[:, None] - entries) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (square == every.min(axis=1)).all()
    assert tree.visited < len(parts) * 64


def test_square_roots_are_rounded_outward():
    x = np.array([0, 1, 2, 3, 4, 8, 9, 10, 2**52 - 1, 2**52, 2**52 + 1, (2**30 - 1) ** 2, (2**30 - 1) ** 2 - 1, 2**61])
    assert vector_codes._below(x).tolist() == [math.isqrt(int(v)) for v in x]
    assert vector_codes._above(x).tolist() == [math.isqrt(int(v) - 1) + 1 if v else 0 for v in x]
    assert pa.array(vector_codes._below(x.astype(object))).to_pylist() == [math.isqrt(int(v)) for v in x]
