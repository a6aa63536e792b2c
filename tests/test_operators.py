"""Worked examples of the operators, and cases at their edges."""

import difflib
import random
import tracemalloc
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.operators import dictionary, evaluate, fuzzy, images, layout, nearest, pixels, refresh, resolve, scan, segment, vector_join

TERMS = ["aqua", "glycerin", "sodium", "sodium chloride"]


@pytest.mark.parametrize(
    "text, pieces",
    [
        ("aqua glycerin", [("aqua", True), ("glycerin", True)]),
        ("sodium chloride", [("sodium chloride", True)]),
        ("sodium aqua", [("sodium", True), ("aqua", True)]),
        ("sodium chlor", [("odium chlor", False)]),
        ("aquaglycerin", [("aqua", True), ("lycerin", False)]),
        ("glyaqua", [("glyaqu", False)]),
        ("", []),
    ],
)
def test_scan_by_characters(text, pieces):
    assert plain_scan(TERMS, text) == pieces


def plain_scan(names, s):
    """The scan with every walk tried anew at each place."""

    def walk(at):
        k = max(k for k in range(len(s) - at + 1) if k == 0 or any(t.startswith(s[at : at + k]) for t in names))
        return k, max((len(t) for t in names if s.startswith(t, at)), default=0)

    return scan.cut(s, {at: walk(at) for at in range(len(s))})


@pytest.mark.parametrize("seed", range(3))
def test_scan_over_prefixes_agrees_with_one_that_tries_all(spark, seed):
    rnd = random.Random(seed)
    make = lambda n: "".join(rnd.choice("ab c") for _ in range(n)).strip() or "a"
    names = sorted({make(rnd.randint(1, 12)) for _ in range(15)} | {"abcab" * 8})
    texts = [(k, make(rnd.randint(0, 30))) for k in range(40)] + [(40, "x" + "abcab" * 9), (41, None), (42, ""), (43, "abcab" * 8), (44, "abcab" * 8)]
    got = {}
    for r in scan.by_characters(spark.createDataFrame(texts, "doc_id int, text string"), terms(spark, names)).orderBy("doc_id", "seq").collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["is_term"]))
    assert got == {k: plain_scan(names, t) for k, t in texts if t and plain_scan(names, t)}
    assert scan.by_characters(spark.createDataFrame([(1, "ab")], "doc_id int, text string"), terms(spark, []).where("false")).collect() == [(1, 0, "ab", False)]


def terms(spark, names=TERMS):
    return spark.createDataFrame([(t,) for t in names], "term string")


def test_by_characters(spark):
    docs = spark.createDataFrame([(1, "aqua glycerin"), (2, None), (3, "")], "doc_id long, text string")
    rows = sorted(tuple(r) for r in scan.by_characters(docs, terms(spark)).collect())
    assert rows == [(1, 0, "aqua", True), (1, 1, "glycerin", True)]


def test_longest_takes_whole_words(spark):
    docs = spark.createDataFrame([(1, "sodium chloride sodium x aqua"), (2, "aquaglycerin"), (3, None), (4, "")], "doc_id long, text string")
    rows = sorted(tuple(r) for r in segment.longest(docs, terms(spark)).collect())
    assert rows == [(1, 0, "sodium chloride"), (1, 1, "sodium"), (1, 2, "aqua")]


def test_longest_agrees_with_a_plain_scan(spark):
    rnd = random.Random(1)
    words = ["a", "b", "c", "d"]
    names = sorted({" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3))) for _ in range(12)})
    texts = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))) for k in range(40)]
    expected = []
    for k, t in texts:
        w, at, seq = t.split(), 0, 0
        while at < len(w):
            n = next((n for n in (3, 2, 1) if at + n <= len(w) and " ".join(w[at : at + n]) in names), 0)
            if n:
                expected.append((k, seq, " ".join(w[at : at + n])))
                seq += 1
            at += n or 1
    got = segment.longest(spark.createDataFrame(texts, "doc_id int, text string"), terms(spark, names)).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)


@pytest.mark.parametrize("items, kept", [(["sodium chloride", "chloride", "aqua"], ["sodium chloride", "aqua"]), (["sodium chloride", "chloride"], ["sodium chloride", "chloride"]), (["aqua"], ["aqua"])])
def test_redundancy(spark, items, kept):
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(items)], "doc_id int, seq int, item string")
    assert [r["item"] for r in resolve.without_redundant(rows, "doc_id", "item").orderBy("seq").collect()] == kept


def test_resolve(spark):
    docs = spark.createDataFrame([("a", ["Ingredients:", "Aqua,", "Sodium chlo-", "ride,", "Nylon 6"]), ("b", []), ("c", ["..."])], "doc_id string, tokens array<string>")
    synonyms = spark.createDataFrame([(0, "Nylon 6 ", "Old"), (1, "nylon 6", "Polyamid")], "seq int, synonym_raw string, canonical string")
    known = terms(spark, [*TERMS, "sodium chloride", "nylon"])
    got = {r["doc_id"]: (r["ingredients"], r["pollutants"]) for r in resolve.resolved(docs, known, dictionary.synonym_map(synonyms).union(spark.createDataFrame([("nylon", "Polyamid")], "a string, b string"))).collect()}
    assert got == {"a": (["aqua", "sodium chloride", "nylon"], ["Polyamid"]), "b": ([], []), "c": ([], [])}
    assert dictionary.synonym_map(synonyms).collect()[0]["canonical"] == "Polyamid"


def test_terms_drop_nulls_or_name_them(spark):
    raw = spark.createDataFrame([(0, " Aqua "), (1, None), (2, "ab")], "row int, name string")
    assert {r["term"] for r in dictionary.terms(raw).collect()} == {"aqua"}
    assert {r["term"] for r in dictionary.terms(raw, keep_nulls_as_none=True).collect()} == {"aqua", "none"}


def lists(spark, predicted, truth):
    make = lambda x: spark.createDataFrame([("i", v) for v in x], "image_id string, item string")
    return make(predicted), make(truth)


def test_fuzzy_metrics(spark):
    a = evaluate.metrics(*lists(spark, ["aqua", "glycerin", "glycerine"], ["aqua", "glycerin"]), method="levenshtein").first()
    assert (a["tp"], a["fp"], a["fn"], a["tp_rate"], a["f1"]) == (3, 0, 0, 1.5, 1.0)
    b = evaluate.metrics(*lists(spark, ["glycerine"], ["glycerin"]), method="levenshtein").first()
    assert (b["tp"], b["fp"], b["fn"], b["recall"], round(b["f1"], 3), b["tp_rate"]) == (1, 0, 1, 0.5, 0.667, 1.0)
    c = evaluate.metrics(*lists(spark, [], ["glycerin"])).first()
    assert (c["tp"], c["fp"], c["fn"], c["f1"]) == (0, 0, 1, 0.0)
    with pytest.raises(ValueError, match="no such method"):
        evaluate.metrics(*lists(spark, [], []), method="other")


def test_ratio_is_twice_the_common_subsequence(spark):
    rnd = random.Random(2)
    pairs = [("".join(rnd.choice("abcä ") for _ in range(rnd.randint(0, 9))), "".join(rnd.choice("abcä ") for _ in range(rnd.randint(0, 9)))) for _ in range(60)]

    def lcs(a, b):
        t = [0] * (len(b) + 1)
        for x in a:
            t = _row(t, x, b)
        return t[-1]

    def _row(t, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(t[j] + 1 if x == y else max(t[j + 1], out[-1]))
        return out

    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    got = {r["k"]: r["score"] for r in fuzzy.scored(rows).collect()}
    assert got == {k: round(Fraction(200 * lcs(a, b), len(a) + len(b))) if a + b else 100 for k, (a, b) in enumerate(pairs)}
    assert got[0] >= round(100 * difflib.SequenceMatcher(None, *pairs[0]).ratio()) - 1


@pytest.mark.parametrize("least", [1, 60, 80, 100])
def test_no_fuzzy_match_is_lost_and_few_pairs_are_compared(spark, least):
    rnd = random.Random(least)
    word = lambda: "".join(rnd.choice("abcdefgäxyz") for _ in range(rnd.randint(4, 14)))
    base = [word() for _ in range(40)] + ["", "a", "aaaaaaaa"]
    noisy = [w[:k] + rnd.choice("abx") + w[k + rnd.randint(0, 2) :] for w in base for k in [rnd.randint(0, len(w))]]
    left = spark.createDataFrame(sorted({(k % 2, w) for k, w in enumerate(noisy + base)}), "key int, name string")
    right = spark.createDataFrame(sorted({(k % 2, w) for k, w in enumerate(base)}), "key int, name string")
    pairs = left.withColumnRenamed("name", "a").join(right.withColumnRenamed("name", "b"), "key")
    expected = {(r["key"], r["a"], r["b"], r["score"]) for r in fuzzy.scored(pairs).collect() if r["score"] >= least}
    got = [tuple(r) for r in fuzzy.alike(left, right, least).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    if least >= 80:
        assert fuzzy.candidates(left, right, least).count() < pairs.count() / 4


def box(image, k, x, y, w=30, h=10):
    corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    return (image, k, [{"x": float(a), "y": float(b)} for a, b in corners], f"w{k}", None)


def test_reading_order(spark):
    # two lines, given out of order, and an image of one box
    rows = [box("a", 0, 40, 50), box("a", 1, 0, 0), box("a", 2, 80, 0), box("a", 3, 40, 0), box("a", 4, 0, 50), box("a", 5, 80, 50), box("b", 0, 0, 0)]
    boxes = spark.createDataFrame(rows, "image_id string, box_id int, polygon array<struct<x:double,y:double>>, text string, level double")
    got = {r["image_id"]: r["tokens"] for r in layout.token_lists(boxes).collect()}
    assert got == {"a": ["w1", "w3", "w2", "w4", "w0", "w5"], "b": ["w0"]}


def _joins(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Join")


def test_small_dictionaries_are_not_joined_with_texts(spark, monkeypatch):
    rnd = random.Random(3)
    terms = spark.createDataFrame([("a b",), ("b c d",), ("d",), ("ab",), ("abc",), ("c  d",), (None,), ("",)], "term string")
    texts = [" ".join(rnd.choice(["a", "b", "c", "d", "ab", "abc", "\x1c", "x"]) for _ in range(rnd.randint(0, 9))) for _ in range(60)] + [None, "", " \u00a0a\u2003b\td "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ways = [segment.longest, segment.term_lists, scan.by_characters]
    small = [f(docs, terms) for f in ways]
    assert [_joins(x) for x in small] == [0, 0, 0]
    monkeypatch.setattr(segment, "SHIPPED", 0)
    monkeypatch.setattr(scan, "SHIPPED", 0)
    for a, f in zip(small, ways, strict=True):
        b = f(docs, terms)
        assert _joins(b) > 0 and a.dtypes == b.dtypes and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_scores_are_dealt_by_key_and_alike_for_few_and_many_labels(spark, monkeypatch):
    rnd = random.Random(5)
    name = lambda: rnd.choice(["red ring", "red rings", "rad ring", "bolt", "bolts", "", None])
    p, t = (spark.createDataFrame([(rnd.choice(["i", "j", "k", None]), name()) for _ in range(60)], "image_id string, item string") for _ in range(2))
    exact = evaluate.metrics(p, t, parts=3)
    assert _joins(exact) == 0 and sorted(map(str, exact.collect())) == sorted(map(str, evaluate.metrics(p, t).collect()))
    direct = [sorted(map(str, f.collect())) for f in (evaluate.metrics(p, t, "levenshtein", parts=3), evaluate.fuzzy_best(p, t, least=80, parts=3))]
    monkeypatch.setattr(evaluate, "DIRECT", 0)
    assert direct == [sorted(map(str, f.collect())) for f in (evaluate.metrics(p, t, "levenshtein"), evaluate.fuzzy_best(p, t, least=80))]


def test_redundant_words_in_arrays(spark):
    rnd = random.Random(4)
    lists = [[rnd.choice(["a", "b", "a b", "b c", "c", "a  b"]) for _ in range(rnd.randint(0, 7))] for _ in range(80)]
    rows = spark.createDataFrame([(k, list(dict.fromkeys(x))) for k, x in enumerate(lists)], "doc_id long, terms array<string>")
    got = {r[0]: r[1] for r in rows.select("doc_id", resolve._not_redundant("terms")).collect()}
    apart = resolve.without_redundant(rows.select("doc_id", F.posexplode("terms").alias("seq", "term")), "doc_id", "term").orderBy("doc_id", "seq").collect()
    want = {k: [] for k in range(80)}
    for r in apart:
        want[r["doc_id"]].append(r["term"])
    assert got == want


def test_top1_broadcast_and_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id int, embedding array<float>")
    queries, keys = rows.where("id < 20"), rows.where("id >= 20")
    one = sorted((r["query_id"], r["key_id"]) for r in vector_join.top1(queries, keys).collect())
    monkeypatch.setattr(vector_join, "BLOCK_BYTES", 1000)
    many = sorted((r["query_id"], r["key_id"]) for r in vector_join.top1(queries, keys).collect())
    y = x.astype(np.float32).astype(float)
    assert one == many == [(k, 20 + int((y[20:] @ y[k]).argmax())) for k in range(20)]
    assert vector_join.top1(queries, keys.where("id < 0")).count() == 0


def test_top1_holds_few_products_at_a_time():
    rng = np.random.default_rng(1)
    q, keys = rng.integers(-9, 10, (2100, 4)).astype(float), rng.integers(-9, 10, (40_000, 4)).astype(float)
    tracemalloc.start()
    ids, score = vector_join._best(q, keys, np.arange(len(keys)) * 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    for k in (0, 1023, 1024, 2099):
        s = keys @ q[k]
        assert (ids[k], score[k]) == (2 * s.argmax(), s.max())


def test_typo_correction(spark):
    words = spark.createDataFrame([("glycerin",), ("sodium",), ("aqua",), ("oil",)], "word string")
    seen = spark.createDataFrame([("glycerni",), ("0il",), ("zzzz",), (None,)], "seen string")
    got = {r["word"]: r["corrected"] for r in vector_join.corrected(seen, "seen", words, threshold=0.4).collect()}
    assert got == {"glycerni": "glycerin", "0il": "oil", "zzzz": "zzzz"}


def test_image_kernels():
    image = np.zeros((6, 8, 3), dtype=np.uint8)
    image[:, 4:] = 200
    assert images.gray(image).max() == 200
    assert set(np.unique(images.otsu(image))) == {0, 255}
    spot = np.zeros((5, 5), dtype=np.uint8)
    spot[2, 2] = 255
    assert images.median_blur(spot).max() == 0
    assert images.downscale(image, 12).shape == (3, 4, 3)
    assert images.preprocess(image).shape == image.shape
    assert images.preprocess(image, {"gray": True, "threshold": True}).shape == (6, 8)


def test_recogniser_plugs_in(spark):
    class Fake:
        def recognise(self, content):
            return [([(0, 0), (1, 0), (1, 1), (0, 1)], content.decode(), 0.5)] if content else []

    rows = spark.createDataFrame([("a", b"hi"), ("b", b"")], "image_id string, content binary")
    got = images.boxes(rows, Fake).collect()
    assert [(r["image_id"], r["text"], r["polygon"][2]["x"]) for r in got] == [("a", "hi", 1.0)]
    bad = spark.createDataFrame([("a", None)], "image_id string, content binary").withColumn("content", F.lit(b"\xff"))
    assert images.recognised(bad, Fake).first()["error"].startswith("UnicodeDecodeError")
    with pytest.raises(Exception, match="UnicodeDecodeError"):
        images.boxes(bad, Fake).collect()


def test_snapshots_follow_content(spark, tmp_path):
    built = []

    def build(df):
        built.append(1)
        return dictionary.vocabulary(df)

    a = terms(spark)
    assert refresh.ensured(a, build, str(tmp_path)).count() == refresh.ensured(terms(spark, TERMS[::-1]), build, str(tmp_path)).count() == 4
    assert len(built) == 1
    refresh.ensured(terms(spark, ["new"]), build, str(tmp_path))
    assert len(built) == 2


def test_long_terms_are_found_and_limits_are_errors(spark):
    nine = " ".join(f"w{k}" for k in range(9))
    terms = spark.createDataFrame([(nine,), ("aqua",)], "term string")
    docs = spark.createDataFrame([(1, f"x {nine} aqua")], "doc_id long, text string")
    assert [r["term"] for r in segment.longest(docs, terms).orderBy("seq").collect()] == [nine, "aqua"]
    with pytest.raises(ValueError, match="more than 8"):
        segment.longest(docs, terms, most_words=8)


def test_resolving_corrects_words(spark):
    terms = spark.createDataFrame([("glycerin",), ("sodium chloride",), ("aqua",), ("olive oil",)], "term string")
    docs = spark.createDataFrame([(1, ["Glycerim,", "sodiun", "chloride", "aqua", "olive 0il", "zzzz"]), (2, None)], "doc_id long, tokens array<string>")
    found = lambda **x: {r["doc_id"]: r["ingredients"] for r in resolve.resolved(docs, terms, None, **x).collect()}
    assert found(word_threshold=0.5) == {1: ["glycerin", "sodium chloride", "aqua", "olive oil"], 2: []}
    assert found(correct=False) == {1: ["aqua"], 2: []}


@pytest.mark.parametrize("encoder", [vector_join.NgramEncoder(), vector_join.NgramEncoder(64), vector_join.LetterEncoder()], ids=["wide", "narrow", "letters"])
@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_inverted_index_agrees_with_comparing_all(spark, encoder, threshold):
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(150)})
    asked = sorted({w[:k] + rnd.choice("abz") + w[k + 1 :] for w in words for k in [rnd.randint(0, len(w))]} | {"", "123", "ä"})
    frame = lambda x: spark.createDataFrame([(w,) for w in x], "w string")
    queries, keys = nearest.sparse(frame(asked), "w", encoder), nearest.sparse(frame([*words, "456"]), "w", encoder)
    got = {r["query_id"]: (r["key_id"], r["score"]) for r in nearest.nearest_above(queries, keys, threshold).collect()}
    every = [*asked, *words, "456"]
    if hasattr(encoder, "encode_sparse"):
        held = {t: dict(zip(f.tolist(), x.tolist(), strict=True)) for t, (f, x) in zip(every, encoder.encode_sparse(every), strict=True)}
    else:
        held = {t: dict(enumerate(v)) for t, v in zip(every, encoder.encode(every), strict=True)}
    product = lambda a, b: sum(held[a].get(f, 0.0) * x for f, x in held[b].items())
    expected = {}
    for a in asked:
        score, b = min((-round(product(a, b), 11), b) for b in [*words, "456"])
        if -score >= threshold:
            expected[a] = (b, -score)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    assert all(abs(v[1] - expected[k][1]) < 1e-9 for k, v in got.items()) and got
    if threshold == 0.8 and getattr(encoder, "dimension", 0) > 1000:
        assert nearest.candidates(queries, keys, threshold).count() < len(asked) * len(words) / 20


def test_vectors_longer_than_one_are_an_error(spark):
    long = spark.createDataFrame([("a", [1], [2.0])], nearest.VECTORS)
    with pytest.raises(Exception, match="longer than one"):
        nearest.nearest_above(long, long).collect()
    with pytest.raises(ValueError, match="above 0"):
        nearest.nearest_above(long, long, 0.0)


def test_terms_are_verified(spark):
    index = nearest.sparse(spark.createDataFrame([("glycerin",), ("glycerol",)], "t string"), "t", vector_join.NgramEncoder())
    items = spark.createDataFrame([(1, "glycerin"), (2, "glycerins"), (3, "zzz"), (4, None)], "k long, term string")
    assert sorted(map(tuple, vector_join.verified(items, "term", index, 0.5).collect())) == [(1, "glycerin"), (2, "glycerin")]
    kept = {r["k"]: r["term"] for r in vector_join.verified(items, "term", index, 0.5, keep=True).collect()}
    assert kept == {1: "glycerin", 2: "glycerin", 3: None, 4: None}


class Noting(vector_join.NgramEncoder):
    """Notes in a file what it encodes."""

    def __init__(self, path, dimension=1 << 20):
        super().__init__(dimension)
        self.path = path

    def encode_sparse(self, texts):
        with open(self.path, "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return super().encode_sparse(texts)


def test_vector_index_encodes_only_what_is_new(spark, tmp_path):
    noted = tmp_path / "noted"
    noted.touch()
    encoder = Noting(str(noted))
    have = lambda *x: {r["id"] for r in refresh.vector_index(spark.createDataFrame([(t,) for t in x], "t string"), "t", str(tmp_path / "index"), "words", encoder, merge_after=3).collect()}
    taken = lambda: sorted(noted.read_text().split())
    assert have("aqua", "aqua", None, "oil") == {"aqua", "oil"} and taken() == ["aqua", "oil"]
    assert have("oil", "aqua") == {"aqua", "oil"} and taken() == ["aqua", "oil"]
    assert have("oil", "wax") == {"oil", "wax"} and taken() == ["aqua", "oil", "wax"]
    assert have("oil", "aqua", "wax") == {"oil", "aqua", "wax"} and taken() == ["aqua", "aqua", "oil", "wax"]  # a token that was removed
    assert have("gel") == {"gel"}  # merged: one version without parts
    assert have("gel", "oil") == {"gel", "oil"}
    folder = next((tmp_path / "index").iterdir())
    assert len(list(folder.iterdir())) == 5
    other = refresh.vector_index(spark.createDataFrame([("gel",)], "t string"), "t", str(tmp_path / "index"), "words", Noting(str(noted), 64))
    assert max(other.first()["features"]) < 64 and len(list((tmp_path / "index").iterdir())) == 2


def test_a_stream_encodes_the_dictionary_once(spark, tmp_path):
    from lexiforge.streaming import streams

    noted = tmp_path / "noted"
    noted.touch()
    encoder = Noting(str(noted))
    held = {"terms": ["glycerin", "sodium chloride"]}
    synonyms = spark.createDataFrame([("glycerin", "Polyol")], "synonym string, canonical string")
    rows = "doc_id string, tokens array<string>"

    def arrive(*lists):
        spark.createDataFrame([(k, t) for k, t in lists], rows).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows).json(str(tmp_path / "in"))
        tables = lambda: (spark.createDataFrame([(t,) for t in held["terms"]], "term string"), synonyms)
        streams.resolve_stream(stream, tables, str(tmp_path / "out"), str(tmp_path / "check"), str(tmp_path / "index"), encoder).awaitTermination()
        return {r["doc_id"]: (r["ingredients"], r["pollutants"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert arrive(("a", ["Glycerin,", "sodium", "chloride"]), ("b", None)) == {"a": (["glycerin", "sodium chloride"], ["Polyol"]), "b": ([], [])}
    once = ["chloride", "glycerin", "glycerin", "sodium", "sodium chloride"]  # words and terms
    assert sorted(noted.read_text().splitlines()) == once
    assert arrive(("c", ["glycerin"]))["c"] == (["glycerin"], ["Polyol"])
    assert sorted(noted.read_text().splitlines()) == once
    held["terms"] += ["wax"]
    assert arrive(("d", ["wax"]))["d"] == (["wax"], [])
    assert sorted(noted.read_text().splitlines()) == sorted([*once, "wax", "wax"])


def _placed(spark, places):
    corner = lambda x, y: {"x": float(x), "y": float(y)}
    rows = [(i, b, None if x is None else [corner(x, y), corner(x + w, y), corner(x + w, y + 10), corner(x, y + 10)], "t", None) for i, b, x, y, w in places]
    return spark.createDataFrame(rows, "image_id string, box_id int, polygon array<struct<x:double,y:double>>, text string, level double")


def test_neighbours_equal_all_pairs(spark):
    rnd = random.Random(3)
    places = [("few", b, rnd.randint(0, 90), rnd.randint(0, 90), 20) for b in range(40)]
    places += [("many", b, rnd.randint(0, 900), rnd.randint(0, 900), rnd.randint(5, 60)) for b in range(700)]
    places += [("column", b, 30, 12 * rnd.randint(0, 60), 25) for b in range(300)]
    places += [("far", b, rnd.randint(0, 50) + (b == 7) * 10**6, rnd.randint(0, 50), 25) for b in range(200)]
    places += [("same", b, 5, 5, 25) for b in range(90)]
    places += [("none", b, None, None, 0) for b in range(3)] + [("many", 10**6, None, None, 0)]
    rnd.shuffle(places)
    got = {}
    for r in layout.neighbours(_placed(spark, places)).collect():
        got.setdefault((r["image_id"], r["box_id"]), []).append((r["at"], r["distance"], r["other_id"]))
    expected = {}
    for i, b, x, y, w in places:
        if x is not None:
            near = sorted((((x + w - u) ** 2 + (y - v) ** 2) ** 0.5, c) for j, c, u, v, _ in places if j == i and u is not None)[:5]
            expected[i, b] = [(n + 1, d, c) for n, (d, c) in enumerate(near)]
    assert {k: sorted(v) for k, v in got.items()} == expected


def test_order_and_edges_of_boxes_without_a_place(spark):
    rows = _placed(spark, [("a", 1, 40, 0, 20), ("a", 2, 0, 0, 35), ("a", 3, None, None, 0), ("b", 1, None, None, 0)])
    order = {(r["image_id"], r["position"]): (r["box_id"], r["line_id"]) for r in layout.reading_order(rows).collect()}
    assert order[("a", 2)] == (3, 3) and order[("b", 0)] == (1, 1)
    assert {(r["image_id"], r["box_id"], r["other_id"]) for r in layout.edges(rows).collect()} <= {("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("a", 2, 2)}
    assert layout.reading_order(rows.limit(0)).count() == layout.neighbours(rows.limit(0)).count() == 0


def test_bands_equal_whole_images(spark):
    rnd = np.random.default_rng(5)
    shapes = {"colour": (61, 47, 3), "gray": (40, 90, 1), "small": (5, 4, 3), "one": (30, 30, 1), "line": (1, 200, 1)}
    made = {k: (rnd.integers(0, 256, s) if k != "one" else np.full(s, 9)).astype(np.uint8) for k, s in shapes.items()}
    rows = [(k, *x.shape, bytearray(x.tobytes())) for k, x in made.items()] + [("broken", -1, -1, -1, None), ("empty", 0, 0, 1, bytearray())]
    pictures = spark.createDataFrame(rows, "image_id string, height int, width int, channels int, pixels binary")
    parts = pixels.bands(pictures, max_pixels=900, band_pixels=300)
    assert parts.where("image_id = 'colour'").count() > 3
    small = pixels.downscaled(parts, to_gray=True)
    counts = {(r["image_id"], r["level"]): r["n"] for r in pixels.levels(small).collect()}
    done = {r["image_id"]: np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"]) for r in pixels.assembled(pixels.black_and_white(small)).collect()}
    plain = {r["image_id"]: np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], -1) for r in pixels.assembled(pixels.downscaled(parts)).collect()}
    assert set(done) == set(plain) == set(made)
    for k, x in made.items():
        whole = images.downscale(x, 900)
        assert (plain[k] == whole).all()
        level = images.gray(whole if x.shape[2] == 3 else whole[..., 0])
        assert (done[k] == images.otsu(level)).all()
        assert {a: n for (i, a), n in counts.items() if i == k} == {a: n for a, n in enumerate(np.bincount(level.reshape(-1))) if n}
