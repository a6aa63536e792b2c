"""Operators over documents against plain versions."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import line_runs, mixing, packing, passages, pii_votes, ppm_lang, quality_lm, superminhash, word_pairs

from .helpers import DOCS, WORD, corpus, frame, prose, union_find, words


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


@pytest.mark.parametrize(
    "operator",
    [quality_lm.judged, quality_lm.keep_good, ppm_lang.predicted, packing.packed, line_runs.digest, line_runs.keep_first_lines, superminhash.grouped, superminhash.keep_first, mixing.placed, mixing.mixed, pii_votes.spans, passages.repeated],
)
def test_empty_table(nothing, operator):
    assert operator(nothing).count() == 0


_EMPTY, _ABC, _SAME = (hashlib.sha256(x).hexdigest() for x in (b"", b"a b c", b"same text"))


@pytest.mark.parametrize(
    ("operator", "columns", "none", "abc", "same"),
    [
        (quality_lm.judged, ["n_words", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], (0, 0, 0, 0, True, False), (3, 0, 0, 0, True, False), (2, 0, 0, 0, True, False)),
        (ppm_lang.predicted, ["held_out", "lang_pred", "score"], (False, "und", 0.0), (False, "en", 1.0), (False, "en", 1.0)),
        (packing.packed, ["piece", "start", "length"], (0, 0, 1), (0, 0, 4), (0, 0, 3)),
        (line_runs.digest, ["n_lines", "n_dropped", "kept_sha256"], (1, 0, _EMPTY), (1, 0, _ABC), (1, 0, _SAME)),
        (superminhash.grouped, ["n_shingles", "kept"], (0, True), (1, True), (1, True)),
        (pii_votes.spans, ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], (0, 0, 0, 0, _EMPTY, ""), (0, 0, 0, 0, _EMPTY, ""), (0, 0, 0, 0, _EMPTY, "")),
    ],
    ids=lambda x: getattr(x, "__name__", ""),
)
def test_nulls_and_repeated_rows(spark, operator, columns, none, abc, same):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b c", None, None, None), (None, None, "en", "s", 1), (2, "same text", "en", "s", 1), (2, "same text", "en", "s", 1)]
    got = sorted(((r["doc_id"], *(r[c] for c in columns)) for r in operator(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, *none), (1, *none), (None, *abc), (None, *none), (2, *same), (2, *same)], key=repr)


@pytest.mark.parametrize(("operator", "kept"), [(quality_lm.keep_good, 0), (line_runs.keep_first_lines, 6), (superminhash.keep_first, 6), (mixing.mixed, 6), (passages.repeated, 0)], ids=lambda x: getattr(x, "__name__", ""))
def test_stages_on_nulls_and_repeated_rows(spark, operator, kept):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b c", None, None, None), (None, None, "en", "s", 1), (2, "same text", "en", "s", 1), (2, "same text", "en", "s", 1)]
    docs = frame(spark, rows)
    got = sorted((tuple(r)[:2] for r in operator(docs).collect()), key=repr)
    assert got == (sorted((r[:2] for r in rows), key=repr) if kept else [])


def repeats(w):
    seen = defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)})


def test_quality_counts(docs, rows):
    got = {r["doc_id"]: r for r in quality_lm.judged(docs).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        w, r = WORD.findall(text or ""), got[doc_id]
        lines, seen, dup = (text or "").split("\n"), set(), 0
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        n = repeats(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, n)
        assert r["base_failed"] == (len(w) < 10 or 100 * n > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_every_language_is_learnt(spark):
    """More languages than lie side by side or than a worker holds; one has only long texts."""
    rnd = random.Random(7)
    rows, n = [], ppm_lang.BLOCK + 6
    for g in range(n):
        own = [f"{chr(97 + g % 26)}{chr(97 + g // 26)}{x}" for x in ("ka", "lo", "mi")]
        rows += [(g * 12 + k, prose(rnd, 20000 if g == 3 else 40, own), f"l{g:02d}", "s", 0) for k in range(12)]
    got = {r["doc_id"]: r for r in ppm_lang.predicted(frame(spark, rows)).collect()}
    assert [k for k in got if got[k]["lang_pred"] != f"l{k // 12:02d}"] == []
    judged = quality_lm.judged(frame(spark, [r for r in rows if r[2] != "l03"])).collect()
    assert sum(r["perplexity"] is None for r in judged) == 0


def test_clashing_names(spark):
    """Columns that carry names from inside the operators stay as they are."""
    rnd = random.Random(9)
    rows = [(k, prose(rnd, 60), "en", f"s{k % 3}", 0) for k in range(30)]
    names = ["judged_id", "judged_kept", "good", "kept", "placed_times", "n", "row", "own_id", "copy", "mark", "lost", "rest", "one", "component", "a", "b"]
    docs = frame(spark, rows).withColumns({n: F.lit(n) for n in names})
    for operator in (quality_lm.keep_good, mixing.mixed, line_runs.keep_first_lines, superminhash.keep_first):
        out = operator(docs)
        assert out.columns == docs.columns
        assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(names)}


def plain_kneser_ney(texts):
    """Interpolated modified Kneser-Ney over byte classes, from dictionaries of tuples."""
    n_grams = defaultdict(lambda: defaultdict(int))
    for t in texts:
        c = [int(quality_lm.CLASS[x]) for x in b"\n\n\n" + t]
        for i in range(3, len(c)):
            n_grams[4][tuple(c[i - 3 : i + 1])] += 1
    for n in (3, 2, 1):
        for g in n_grams[n + 1]:
            n_grams[n][g[1:]] += 1

    def cuts(n):
        k = [max(1, sum(v == x for v in n_grams[n].values())) for x in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1])
        raw = (1 - 2 * y * k[1] / k[0], 2 - 3 * y * k[2] / k[1], 3 - 4 * y * k[3] / k[2])
        return [0, *(min(max(d, 0.05), most) for d, most in zip(raw, (0.95, 1.95, 2.95), strict=True))]

    cut = {n: cuts(n) for n in (1, 2, 3, 4)}

    def p(g):
        if not g:
            return 1 / quality_lm.N_CLASSES
        same = {h: v for h, v in n_grams[len(g)].items() if h[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total, d = sum(same.values()), cut[len(g)]
        v = same.get(g, 0)
        return (v - d[min(v, 3)]) / total + sum(d[min(x, 3)] for x in same.values()) / total * p(g[1:])

    return p


def test_perplexity_against_a_plain_model():
    rnd = random.Random(2)
    texts = [prose(rnd, 12).encode() for _ in range(3)]
    model = quality_lm.fit(*quality_lm._tally(quality_lm.ngrams(texts)[0]))
    asked = [texts[0][:40], b"Zebra? 7", prose(rnd, 4).encode()]
    got = quality_lm.Scorer({"": model}).log_perplexities(asked, [""] * 3)
    p = plain_kneser_ney(texts)
    for t, x in zip(asked, got, strict=True):
        c = [int(quality_lm.CLASS[y]) for y in b"\n\n\n" + t]
        assert abs(x + sum(np.log(p(tuple(c[i - 3 : i + 1]))) for i in range(3, len(c))) / len(t)) < 1e-5


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    key, count = np.unique(rng.integers(0, quality_lm.N_CLASSES, (400, 4)) @ quality_lm.N_CLASSES ** np.arange(3, -1, -1), return_counts=True)
    model = quality_lm.fit(key, count)
    for n in (1, 2, 3, 4):
        assert np.allclose(np.exp(quality_lm.dense(model, n)).reshape(-1, quality_lm.N_CLASSES).sum(axis=1), 1)


def test_ngrams_are_those_of_each_text():
    texts = [b"abc", b"", b"Hello, world"]
    key, first = quality_lm.ngrams(texts)
    for k, t in enumerate(texts):
        padded = quality_lm.CLASS[np.frombuffer(b"\n\n\n" + t, dtype=np.uint8)]
        own = [sum(int(padded[i + j]) * quality_lm.N_CLASSES ** (3 - j) for j in range(4)) for i in range(len(t))]
        assert key[first[k] : first[k + 1]].tolist() == own


def test_junk_is_rejected_and_prose_kept(spark):
    good = [(k, t, "en", "s", 0) for k, t, *_ in corpus(3, 80)[:80] if len(t.split()) > 30]
    junk = [(1000 + k, " ".join(f"{x.upper()}!!" for x in t.split()), "en", "s", 0) for k, t, *_ in good[:6]]
    kept = {r["doc_id"] for r in quality_lm.judged(frame(spark, good + junk)).where("kept").collect()}
    failed = {r["doc_id"] for r in quality_lm.judged(frame(spark, good + junk)).where("base_failed").collect()}
    assert kept == {r[0] for r in good} - failed
    assert {r["doc_id"] for r in quality_lm.keep_good(frame(spark, good + junk)).collect()} == kept


def test_code_lengths_against_a_plain_model():
    samples = {"a": [b"abracadabra", b"abba"], "b": [b"hocus pocus"]}
    tables = ppm_lang.Tables(samples)
    tables.slots()
    counts = {g: defaultdict(lambda: defaultdict(int)) for g in samples}
    for g, texts in samples.items():
        for t in texts:
            t = b"\n" * 4 + t
            for i in range(4, len(t)):
                for n in range(5):
                    counts[g][t[i - n : i]][t[i]] += 1

    def cost(g, context, c):
        own = counts[g].get(context)
        below = np.log(256) if not context else None
        if own is None:
            return below if below is not None else cost(g, context[1:], c)
        total, distinct = sum(own.values()), len(own)
        if c in own:
            return -np.log(own[c] / (total + distinct))
        return -np.log(distinct / (total + distinct)) + (below if below is not None else cost(g, context[1:], c))

    texts = [b"abracadabra pocus", b"zzz", b"", b"\xc3\xa9"]
    expected = [[sum(cost(g, (b"\n" * 4 + t)[i : i + 4], t[i]) for i in range(len(t))) for g in ("a", "b")] for t in texts]
    assert np.allclose(tables.code_lengths(texts), expected, rtol=1e-5)


def test_language(spark):
    one, two = ("the", "and", "ing"), ("der", "ung", "sch")
    import random

    rnd = random.Random(5)
    made = [(k, " ".join("".join(rnd.choice(one if k % 2 else two) for _ in range(2)) for _ in range(30)), "en" if k % 2 else "de", "s", 0) for k in range(120)]
    extra = [(1000, None, "en", "s", 0), (1001, "123 456", "en", "s", 0), (1002, "", None, "s", 0)]
    got = {r["doc_id"]: r for r in ppm_lang.predicted(frame(spark, made + extra)).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    held = [k for k in range(120) if got[k]["held_out"]]
    assert held and all(got[k]["lang_pred"] == ("en" if k % 2 else "de") for k in held)
    assert all((got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0) for k in (1000, 1001, 1002))


@pytest.mark.parametrize("text", ["hello world", "", "a <|endoftext|> x", "<|endoftext|><|endoftext|>y<|endoftext", "  <|endoftext|>  ", " " * 5000, "a" * 3000, "naïve 東京 🎉 \u0085  it's", "\n\n\t x"])
def test_ids_are_those_of_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.encoder()(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing(docs, rows):
    got = packing.packed(docs, capacity=256).toPandas()
    encode, expected = packing.encoder(), {}
    for doc_id, text, *_ in rows:
        ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, first, *range(first + 256, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            expected[doc_id, k] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == expected
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        ends = (seq.offset + seq.length).tolist()
        assert seq.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 256


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(1, 65, 500 * (seed + 1)), minlength=65)
    best = packing.best_plan(counts, 64)
    for plan in (best, packing.Plan(counts, 64, 1 / 4, 8), packing.Plan(counts, 64, 1 / 8, 16)):
        used, placed = np.zeros(plan.bins, dtype=int), np.zeros(65, dtype=int)
        for length, _, n, first, offset, each in plan.rules:
            t = np.arange(n)
            np.add.at(used, first + t // each, length)
            assert (offset + t % each * length + length <= 64).all()
            placed[length] += n
        assert (placed == counts).all() and used.max() <= 64
    room: list[int] = []  # first-fit decreasing
    for length in np.repeat(np.arange(65), counts)[::-1]:
        k = next((k for k, r in enumerate(room) if r >= length), None)
        if k is None:
            room.append(64 - length)
        else:
            room[k] -= length
    assert best.bins <= 1.01 * len(room) + 1


def test_configurations_place_the_large_pieces():
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(1, 2049, 40_000), minlength=2049)
    plan, alone = packing.best_plan(counts), packing.Plan(counts, groups=1, large=1.0)
    large = counts[2048 // 3 + 1 : 2048].sum()
    assert plan.configured >= 0.97 * large and alone.configured == 0
    assert plan.bins <= 1.005 * alone.bins  # best-fit decreasing
    several = [r for r in plan.rules if r[4] > 0 and r[0] > 2048 // 3]  # large pieces behind a large one
    assert sum(r[2] for r in several) >= 0.2 * large


def test_no_pieces():
    assert packing.best_plan(np.zeros(65, dtype=int), 64).bins == 0


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_lines(spark, docs, batches):
    got = line_runs.digest(docs, batches).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    expected = con.sql(line_runs.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(expected[got.columns])
    assert got.n_dropped.sum() > 0


def test_kept_lines_keep_the_columns(docs):
    out = line_runs.keep_first_lines(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    assert out.where("n_chars <> length(text) and text is not null and length(text) > 0").count() == 0


def links(rows, percent):
    sets = {}
    for doc_id, text, *_ in rows:
        w = words(text)
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    found = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, union_find(ids, found)


@pytest.mark.parametrize("percent", [85, 80, 95])
def test_near_duplicates(docs, rows, percent):
    sets, group = links(rows, percent)
    got = {r["doc_id"]: r for r in superminhash.grouped(docs, percent).collect()}
    assert {k: r["component_id"] for k, r in got.items()} == group
    assert {k: r["n_shingles"] for k, r in got.items()} == {k: len(s) for k, s in sets.items()}
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_one_of_each_group_stays(docs, rows):
    _, group = links(rows, 80)
    assert sorted(r["doc_id"] for r in superminhash.keep_first(docs).collect()) == sorted(set(group.values()))


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    errors = []
    for size in (20, 200, 2000):
        for overlap in (0.2, 0.5, 0.9):
            both = int(size * overlap)
            a, b = np.unique(pool[:size]), np.unique(pool[size - both : 2 * size - both] if 2 * size - both <= 3000 else np.concatenate([pool[size - both : 3000], pool[:0]]))
            h = superminhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(abs((h[0] == h[1]).mean() - true))
            assert (np.floor(h).max(axis=1) <= superminhash.SLOTS).all()
    assert max(errors) < 0.12


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 30)] + [(100, 50), (101, 50), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in superminhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 31)}, **{k: 50 for k in (50, 100, 101, 102)}}


def test_prefix_pairs_lose_nothing(spark, rows):
    sets, _ = links(rows, 80)
    members = spark.createDataFrame([(k, len(s), k) for k, s in sets.items() if s], "rep long, n long, component long")
    texts = frame(spark, rows).select("doc_id", "text")
    got = {(r["a"], r["b"]) for r in superminhash.prefix_pairs(members, texts, 80).collect()}
    ids = [k for k in sorted(sets) if sets[k]]
    wanted = {(b, a) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert wanted <= got


def test_weights_meet_entropy_or_limit():
    tokens = {"a": 900_000, "b": 60_000, "c": 40_000}
    t = mixing.exponent(tokens, 1_000_000, 0.9, 100.0)
    w = mixing.weights(tokens, t)
    assert abs(mixing._entropy(w) - 0.9 * np.log(3)) < 1e-6
    t = mixing.exponent(tokens, 1_000_000, 0.9, 3.0)
    assert abs(max(x * 1_000_000 / tokens[s] for s, x in mixing.weights(tokens, t).items()) - 3.0) < 1e-6
    assert sum(mixing.budgets(tokens, 777_777).values()) == 777_777
    assert mixing.budgets({}, 5) == {} and mixing.exponent({"a": 5}, 5) == 1.0


def test_mix(docs, rows):
    got = mixing.placed(docs).toPandas()
    tokens = defaultdict(int)
    longest = defaultdict(int)
    for _, text, _, source, _ in rows:
        tokens[source] += len(WORD.findall(text or ""))
        longest[source] = max(longest[source], len(WORD.findall(text or "")))
    goal = mixing.budgets(dict(tokens), sum(tokens.values()))
    placed = got.groupby("source").n_tokens.sum().to_dict()
    assert all(goal[s] - longest[s] < placed.get(s, 0) <= goal[s] for s in goal)
    assert not got.duplicated(["doc_id", "copy"]).any()
    for s, b in goal.items():  # whole passes are whole
        own = got[got.source == s]
        for c in range(b // tokens[s]):
            assert own[own["copy"] == c].n_tokens.sum() == tokens[s]
    assert mixing.mixed(docs).columns == docs.columns


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    return {"email": True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def test_personal_data(spark):
    import random

    rnd = random.Random(9)
    bits = ["@", ".", "1", "2", "9", "+", "-", " ", "(", ")", "a", "B", "%", "_", "😀", "é", "\n", "00", "255", "256", "4111 1111 1111 1111", "a.b@c.de", "1.2.3.4", "+1 (269) 555-3296 4524132264652876", "password=abc12345xyz"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(50))) for _ in range(400)] + [None, "", "1 " * 3000, "1.2.3.4 " * 700, "9" * 4000 + "a." * 4000]
    got = {r["doc_id"]: r for r in pii_votes.spans(frame(spark, [(k, t, None, None, None) for k, t in enumerate(texts)])).collect()}
    for k, t in enumerate(texts):
        found = sorted((m.start(), j, m.end(), kind) for j, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "") if holds(kind, m[0]))
        spans = [f"{kind}:{a}:{b}" for a, _, b, kind in found]
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[k][f"n_{kind}"] for kind in PATTERNS] == [sum(s.startswith(kind) for s in spans) for kind in PATTERNS]
        assert set(spans) <= set(got[k]["spans"].split(","))
    more = [x for k, t in enumerate(texts) for x in got[k]["spans"].split(",") if x.startswith("phone") and (t or "")[int(x.split(":")[1]) : int(x.split(":")[2])] == "+1 (269) 555-3296"]
    assert more  # found beside a number that the base pattern swallows


def test_labelers_reliabilities():
    import random

    rnd = random.Random(4)
    tally = defaultdict(int)
    truth = []
    for _ in range(3000):
        y = rnd.random() < 0.6
        v = tuple((1 if y else -1) if rnd.random() < q else (-1 if y else 1) for q in (0.95, 0.9, 0.8, 0.6, 0.9))
        tally[v] += 1
        truth.append((v, y))
    _, chance, post = pii_votes.reliabilities(dict(tally))
    assert abs(chance[0][1, 1] - 0.95) < 0.05 and abs(chance[3][1, 1] - 0.6) < 0.08
    assert sum((post[v] > 0.5) == y for v, y in truth) / len(truth) > 0.95


def test_ngrams_take_four_bytes_each():
    key, _ = quality_lm.ngrams([b"\xff\xfe" * 50, b"abc"])
    assert key.itemsize == 4 and key.max() == sum(43 * 44**k for k in range(4))


def test_passages(docs, rows):
    got = defaultdict(set)
    for r in passages.repeated(docs).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        assert r["end_word"] - r["start_word"] >= passages.WORDS and r["other_doc"] != r["doc_id"]
    held = defaultdict(set)
    all_words = {k: words(t) for k, t, *_ in rows}
    for k, w in all_words.items():
        for i in range(len(w) - 49):
            held[tuple(w[i : i + 50])].add(k)
    for k, w in all_words.items():
        for i in range(len(w) - 49):
            if len(held[tuple(w[i : i + 50])]) > 1:
                assert set(range(i, i + 50)) <= got[k]
    # what is reported holds most of its shingles in other documents too
    grams = defaultdict(set)
    for k, w in all_words.items():
        for i in range(len(w) - 4):
            grams[tuple(w[i : i + 5])].add(k)
    for k, at in got.items():
        w = all_words[k]
        near = [i for i in sorted(at) if i + 5 <= len(w) and i + 4 in at]
        assert sum(len(grams[tuple(w[i : i + 5])]) > 1 for i in near) >= 0.75 * len(near)


def test_compact_windows_against_all_subsequences():
    rng = np.random.default_rng(2)
    gram = passages._text.mix(rng.integers(0, 40, 300).astype(np.uint64))
    first = np.array([0, 120, 130, 300])
    span = passages.SPAN
    rank = (gram >> np.uint64(1)) & ~passages._PLACE | np.arange(300, dtype=np.uint64) & passages._PLACE
    doc = np.repeat([0, 1, 2], np.diff(first))
    valid = doc[: 300 - span + 1] == doc[span - 1 :]
    row, table, _ = passages.compact_windows(rank, passages.sliding_least(rank, span), valid, first)
    for s in np.flatnonzero(valid):
        c = table[0][row[s]]
        assert c == s + rank[s : s + span].argmin()
    for c, lo, hi in table.T:
        d = doc[c]
        left, right = c, c
        while left > first[d] and rank[left - 1] > rank[c]:
            left -= 1
        while right + 1 < first[d + 1] and rank[right + 1] > rank[c]:
            right += 1
        assert (lo, hi) == (left, right)


def test_passages_far_into_a_long_text(spark):
    rnd = random.Random(12)
    shared = prose(rnd, 60)
    long = " ".join([*(f"w{k}" for k in range((1 << 20) + 500)), shared, *(f"v{k}" for k in range(100))])
    other = " ".join([*(f"u{k}" for k in range(30)), shared, *(f"t{k}" for k in range(30))])
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in passages.repeated(frame(spark, [(1, other, "en", "s", 0), (2, long, "en", "s", 0)])).collect()}
    assert got == {(1, 30, 90), (2, (1 << 20) + 500, (1 << 20) + 560)}


def test_passages_equal_to_a_near_copy_only(spark):
    rnd = random.Random(21)
    rows = []
    for k in range(0, 180, 3):
        one = prose(rnd, 100).split()
        two = [*one[:50], f"changed{k}", *one[51:]]
        rows += [(k, " ".join(one), "en", "s", 0), (k + 1, " ".join(two), "en", "s", 0)]
        rows.append((k + 2, " ".join([prose(rnd, 40), *two[22:78], prose(rnd, 40)]), "en", "s", 0))
    got = defaultdict(set)
    for r in passages.repeated(frame(spark, rows)).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert [k for k in range(2, 180, 3) if not set(range(40, 96)) <= got[k]] == []


def covered(df):
    got = defaultdict(set)
    for r in df.collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    return got


def test_near_passages_are_all_found(spark):
    rows = []
    for k in range(200):
        w = [f"p{k}x{x}" for x in range(50)]
        near = [*w[: k % 50], f"changed{k}", *w[k % 50 + 1 :]]
        for d, own in ((2 * k, w), (2 * k + 1, near)):
            rows.append((d, " ".join([*(f"a{d}x{x}" for x in range(30)), *own, *(f"z{d}x{x}" for x in range(30))]), "en", "s", 0))
    got = covered(passages.repeated(frame(spark, rows)))
    assert [d for d in range(400) if not set(range(30, 80)) <= got[d]] == []


def test_near_copies_unlike_the_first_text(spark):
    rows = []
    for k in range(0, 80, 4):
        w = [f"p{k}x{x}" for x in range(60)]
        for d, own in enumerate((w[:29], w[31:], w, [*w[:30], f"changed{k}", *w[31:]])):
            rows.append((k + d, " ".join([*(f"a{k + d}x{x}" for x in range(40)), *own, *(f"z{k + d}x{x}" for x in range(40))]), "en", "s", 0))
    got = covered(passages.repeated(frame(spark, rows)))
    assert [d for d in range(80) if set(range(40, 100)) <= got[d]] == [d for d in range(80) if d % 4 > 1]
    assert not any(got[d] for d in range(80) if d % 4 < 2)


def test_long_secrets_are_whole(spark):
    rows = [(k, f"user login: token={'aB3' * (5 + k)} end", "en", "s", 0) for k in range(60)]
    got = {r["doc_id"]: r["spans"] for r in pii_votes.spans(frame(spark, rows)).collect()}
    assert [k for k in range(60) if got[k] != f"secret:12:{18 + 3 * (5 + k)}"] == []


def test_near_passages_in_other_text(spark):
    """Recall at a similarity of 0.8 and more, with substitutions, insertions and deletions amid unlike text."""
    rnd = random.Random(4)
    own = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, want = [], []
    while len(want) < 300:
        one = own(rnd.choice([60, 75, 110, 200]))
        two = list(one)
        for _ in range(rnd.randint(1, max(1, len(one) // 50))):
            at = rnd.randrange(1, len(two) - 1)
            two[at : at + rnd.randint(0, 1)] = own(rnd.randint(0, 1))
        a, b = sets(one), sets(two)
        if one == two or len(a & b) < 0.8 * len(a | b):
            continue
        for w in (one, two):
            before = own(rnd.randint(0, 80))
            want.append((len(rows), len(before), len(before) + len(w)))
            rows.append((len(rows), " ".join([*before, *w, *own(rnd.randint(0, 80))]), "en", "s", 0))
    got = covered(passages.repeated(frame(spark, rows)))
    found = sum(len(got[d] & set(range(a, b))) >= max(50, 0.9 * (b - a)) for d, a, b in want)
    assert found >= 0.95 * len(want)


def test_passages_of_rows_that_share_a_doc_id(spark):
    w = [" ".join(f"{x}{k}" for k in range(60)) for x in "abc"]
    rows = [(1, w[0], "en", "s", 0), (1, w[1], "en", "s", 0), (1, w[1], "en", "s", 0), (1, w[1] + " more", "en", "s", 0), (2, "x y " + w[0], "en", "s", 0), (3, w[2], "en", "s", 0), (3, w[2] + " z", "en", "s", 0)]
    got = sorted((r["doc_id"], r["start_word"], r["end_word"], r["other_doc"]) for r in passages.repeated(frame(spark, rows)).collect())
    assert got == [(1, 0, 60, 2), (2, 2, 62, 1)]


def test_near_passages_among_many_unlike_texts(spark):
    """All hold one line; the first and many others are like none, the others like one other each. The members fill several blocks."""
    line, rows = [f"l{x}" for x in range(30)], []
    for d in range(3 * passages.BLOCK):
        own = [f"p{d // 2}x{x}" for x in range(20)] if d >= passages.BLOCK else [f"q{d}x{x}" for x in range(20)]
        rows.append((d, " ".join([*(f"a{d}x{x}" for x in range(30)), *own, f"u{d}", *line, *(f"z{d}x{x}" for x in range(30))]), "en", "s", 0))
    got = covered(passages.repeated(frame(spark, rows)))
    assert [d for d in range(3 * passages.BLOCK) if set(range(30, 81)) <= got[d]] == list(range(passages.BLOCK, 3 * passages.BLOCK))
    assert not any(got[d] for d in range(passages.BLOCK))


def test_repeats_within_words_said_again_and_again(spark):
    say = {1: [("of", 90)], 2: [("on", 30), ("of", 400), ("at", 200)], 3: [("at", 70), ("of", 20)], 4: [("in", 200)], 5: [("by", 49), ("to", 49)]}
    rows = [(d, " ".join(w for w, n in runs for _ in range(n)), "en", "s", 0) for d, runs in say.items()]
    got = covered(passages.repeated(frame(spark, rows)))
    assert set(range(90)) <= got[1] and set(range(30, 630)) <= got[2] and set(range(70)) <= got[3] and not got[4] and not got[5]


def test_shingles_in_common_and_in_a_row():
    rng = np.random.default_rng(8)
    around = [rng.integers(0, 9, rng.integers(1, 60)).astype(np.uint32) for _ in range(12)]
    around += [x[5:] for x in around if len(x) > 30]
    at = [int(rng.integers(0, len(x))) for x in around]
    common, (ahead, back) = passages.in_common(around), passages.in_a_row(around, at)
    for x, (a, i) in enumerate(zip(around, at, strict=True)):
        for y, (b, j) in enumerate(zip(around, at, strict=True)):
            if x != y:
                assert common[x, y] == sum(min((a == v).sum(), (b == v).sum()) for v in range(9))
                n = passages.LEAST
                assert (ahead[x, y], back[x, y]) == (passages._alike(a[i : i + n], b[j : j + n]), passages._alike(a[:i][::-1][:n], b[:j][::-1][:n]))
                ends = [np.array([i]), np.array([j])]
                assert passages.goes_on(around, ends, (np.array([x]), np.array([y])), 1)[0] == bool(set(a[i : i + 23].tolist()) & set(b[j : j + 23].tolist()))
                assert passages.goes_on(around, ends, (np.array([x]), np.array([y])), -1)[0] == bool(set(a[max(0, i - 23) : i].tolist()) & set(b[max(0, j - 23) : j].tolist()))


def test_word_scores_against_plain_counts(spark):
    """Counts of all other texts of the language, whatever tasks and groups they are dealt to."""
    rows = [(k, t, lang, "s", 0) for k, t, lang, *_ in corpus(5, 25)]
    got = {r["doc_id"]: r for r in quality_lm.judged(frame(spark, rows).repartition(5)).collect()}
    assert len(got) == len(rows)
    for doc_id, text, lang, *_ in rows:
        others = [WORD.findall(t or "") for d, t, g, *_ in rows if g == lang and d != doc_id]
        single, double = Counter(w for x in others for w in x), Counter(p for x in others for p in pairwise(x))
        own = WORD.findall(text or "")
        distinct = len(single.keys() | set(own))
        p = [(single[w] + 1) / (single.total() + distinct + 1) for w in own]
        after = [(double[v, w] + word_pairs.PRIOR * q) / (single[v] + word_pairs.PRIOR) for (v, w), q in zip(pairwise(own), p[1:], strict=True)]
        if own:
            assert abs(np.log(got[doc_id]["word_perplexity"]) + np.log(p[:1] + after).sum() / len(own)) < 1e-6
        if len(own) > 1:
            assert abs(got[doc_id]["order_gain"] - np.log(np.array(after) / p[1:]).mean()) < 1e-6
        assert (got[doc_id]["word_perplexity"] is None, got[doc_id]["order_gain"] is None) == (not own, len(own) < 2)


def test_sums_of_keys_against_plain_ones(monkeypatch):
    """Counts beyond what is sorted with the keys, none at all, and groups that are summed in several ranges."""
    rng = np.random.default_rng(6)
    keys = [np.unique(rng.integers(0, 1 << 40, 500) // 3**k).astype(np.uint64) for k in (0, 20, 22, 24)]
    counts = [rng.integers(1, 9, len(k)).astype(np.uint32) for k in keys]
    counts[1][0] = counts[2][0] = (1 << 31) + 5
    plain = Counter()
    for k, c in zip(keys, counts, strict=True):
        plain.update(dict(zip(k.tolist(), c.tolist(), strict=True)))
    key, total = word_pairs._sums(keys, counts)
    assert dict(zip(key.tolist(), total.tolist(), strict=True)) == plain and key.tolist() == sorted(plain)
    assert [len(x) for x in word_pairs._sums([], [])] == [0, 0]
    monkeypatch.setattr(word_pairs, "PART", 100)
    told = word_pairs._answer(asked(keys, counts)).to_pylist()
    assert [word_pairs._unpacked(r["others"], 5).tolist() for r in told] == [[plain[x] - n for x, n in zip(k.tolist(), c.tolist(), strict=True)] for k, c in zip(keys, counts, strict=True)]
    even = [n for x, n in plain.items() if x % 2 == 0]
    assert (sum(r["n_distinct"] for r in told), sum(r["n_words"] for r in told)) == (len(even), sum(even))


def asked(keys, counts):
    steps = [word_pairs._packed(word_pairs._steps(k), 5) for k in keys]
    packed = [word_pairs._packed(c, 4) for c in counts]
    return pa.table({"lg": [":en"] * len(keys), "shard": pa.array([0] * len(keys), pa.int32()), "chunk": list(range(len(keys))), "keys": pa.array(steps, pa.binary()), "counts": pa.array(packed, pa.binary())})


def test_a_group_of_counts_takes_little_memory():
    """Below 40 bytes a key; all arrays of a group at once took 73."""
    rng = np.random.default_rng(7)
    keys = [np.unique(rng.integers(0, 1 << 40, 1_000_000).astype(np.uint64)) for _ in range(8)]
    table = asked(keys, [np.ones(len(k), np.uint32) for k in keys])
    n = sum(map(len, keys))
    del keys
    tracemalloc.start()
    try:
        word_pairs._answer(table)
        assert tracemalloc.get_traced_memory()[1] < 40 * n
    finally:
        tracemalloc.stop()


def test_quality_deletes_what_it_has_shuffled(spark, monkeypatch):
    """The large shuffles, those of counts and texts, are deleted as their results are stored, whether or not the driver collects its garbage; the caller's setting stays."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen, stored = spark.conf.get(name), {}, word_pairs._io.stored
    monkeypatch.setattr(word_pairs._io, "stored", lambda df, to, *more: (seen.update({to: spark.conf.get(name)}), stored(df, to, *more))[1])
    rnd = random.Random(3)
    assert quality_lm.judged(frame(spark, [(k, prose(rnd, 200), "en", "s", 0) for k in range(20)])).count() == 20
    assert (seen["word-counts"], seen["quality"]) == ("true", "true")
    assert spark.conf.get(name) == before == "false"


def test_short_lived_shuffles(spark, tmp_path):
    """A query's shuffle files go with it."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles()
        return {files.apply(k).getPath() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    with word_pairs._io.short_lived_shuffles(spark):
        before = shuffled()
        spark.range(100_000).groupBy((F.col("id") % 9999).alias("k")).count().write.parquet(str(tmp_path / "counts"))
        for _ in range(20):  # a little later
            if not shuffled() - before:
                break
            time.sleep(0.2)
        assert not shuffled() - before
    assert spark.read.parquet(str(tmp_path / "counts")).count() == 9999


@pytest.mark.parametrize("letters", ["abcdefgh", "абвгдежз"])
def test_words_without_order_are_rejected(spark, letters):
    """Each word has four that may follow it; junk holds a good text's words in another order."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices(letters, k=rnd.randint(3, 7))) for _ in range(300)]
    follow = {w: rnd.sample(vocabulary, 4) for w in vocabulary}
    rows = []
    for k in range(150):
        w = [rnd.choice(vocabulary)]
        while len(w) < 150:
            w.append(rnd.choice(follow[w[-1]]))
        rows.append((k, " ".join(w), "en", "s", 0))
    junk = [(1000 + k, " ".join(rnd.sample(rows[k][1].split(), 150)), "en", "s", 0) for k in range(10)]
    got = quality_lm.judged(frame(spark, rows + junk)).where("not base_failed").collect()
    assert len([r for r in got if r["doc_id"] >= 1000]) == 10
    assert [r["doc_id"] for r in got if r["kept"] != (r["doc_id"] < 1000)] == []


def test_run_hashes_and_anchors_against_plain_ones():
    rng = np.random.default_rng(3)
    gram = rng.integers(0, 1 << 63, 90).astype(np.uint64)
    for n in (1, 2, 12, 21, 46, 90):
        plain = [sum(int(g) * pow(0xD6E8FEB86659FD93, n - 1 - k, 1 << 64) for k, g in enumerate(gram[i : i + n])) % (1 << 64) for i in range(len(gram) - n + 1)]
        assert (passages._run_hashes(gram, n) == passages._text.mix(np.array(plain, dtype=np.uint64))).all()
    values = [[{"c": 1, "pc": 2}], [], [{"c": 3, "pc": 4}, {"c": 5, "pc": 6}], [{"c": 7, "pc": 8}]]
    assert [passages._anchors(pa.array(values).slice(k)) for k in range(4)] == [values[k:] for k in range(4)]


def test_stretches_and_similarity_against_plain_ones():
    """Stretches by a search through all ends; similarity of short and long texts."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        runs, i, j = [], 0, 0
        for _ in range(int(rng.integers(2, 9))):
            i, j = i + int(rng.integers(0, 9)), j + int(rng.integers(0, 9))
            runs.append((i, j, int(rng.integers(1, 60))))
            i, j = i + runs[-1][2], j + runs[-1][2]
        a, b = np.arange(i, dtype=np.uint64) + np.uint64(1000), np.arange(j, dtype=np.uint64) + np.uint64(10**6)
        for s, t, n in runs:
            b[t : t + n] = a[s : s + n]
        for s, e, t, u in passages.stretches(a, b, runs):
            x, y = set(a[s:e].tolist()), set(b[t:u].tolist())
            assert min(e - s, u - t) >= passages.SPAN and 100 * len(x & y) >= 80 * len(x | y)
    for n in (50, 3000):
        for share, like in ((8, True), (9, False)):  # n - n / share equal ones of n + n / share in all: just below and above 0.8
            a = np.arange(n, dtype=np.uint64)
            b = a + np.uint64(n // share if like else n // share + n // 50)
            x, y = set(a.tolist()), set(b.tolist())
            assert passages._similar(a, b) == (100 * len(x & y) >= 80 * len(x | y))
