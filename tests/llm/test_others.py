"""Nearest neighbours, tool calls, the pipeline and the registration of the queries."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexiforge.llm import posting_ann, toolcalls
from lexiforge.llm.queries import ORACLE_SQL, QUERIES

from .helpers import DOCS, corpus


def exact(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def vectors(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))


def test_neighbours_recall(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 2500)] + 0.4 * rng.normal(size=(2500, 16)), rng.normal(size=(500, 16)) * 3])
    ids = np.arange(3000)
    got, true = found(posting_ann.neighbours(vectors(spark, ids, x))), exact(ids, x)
    assert got.keys() == true.keys()
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in true[q]}) for q in true)
    assert hits / sum(map(len, true.values())) >= 0.9
    for q, pairs in got.items():
        assert len(pairs) == 20 and all(abs(s - x[q] @ x[v]) < 1e-9 for v, s in pairs) and q not in dict(pairs)


def test_recall_for_queries_unlike_the_rows(spark):
    rng = np.random.default_rng(2)
    ids = np.arange(4000)
    x = rng.normal(size=(80, 32))[rng.integers(0, 80, 4000)] + 0.3 * rng.normal(size=(4000, 32))
    x[::20] = rng.normal(size=(200, 32))
    got, true = found(posting_ann.neighbours(vectors(spark, ids, x))), exact(ids, x)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in true[q]}) for q in true)
    assert hits / sum(map(len, true.values())) >= 0.9


def test_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[100:250] = x[100]  # a hot vector
    ids = np.arange(300)
    got, true = found(posting_ann.neighbours(vectors(spark, ids, x), target=1.0)), exact(ids, x)
    for q in true:
        if 100 <= q < 250:
            assert [v for v, _ in got[q]] == [v for v, _ in true[q]]


def test_few_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0, 2.0, 3.0]), (20, [1.0, 1.0]), (None, [1.0, 1.0]), (1, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(posting_ann.neighbours(df)) == {0: [(20, 1.0), (1, 0.0)], 20: [(0, 1.0), (1, 1.0)]}
    assert posting_ann.neighbours(df.limit(0)).count() == 0
    assert posting_ann.neighbours(df.where("vec_id = 0")).count() == 0


def test_graph_walk_finds_the_nearest():
    rng = np.random.default_rng(2)
    cents = posting_ann.Centroids(posting_ann.lift(rng.normal(size=(2000, 12)), 10.0), 200)
    q = posting_ann.direction(rng.normal(size=(100, 12)))
    at, d, _ = cents.walk(q, 40)
    at = at[:, :10]
    true = np.argsort(np.linalg.norm(q[:, None] - cents.c, axis=2), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(at, true, strict=True)]) > 0.9
    assert (np.diff(d, axis=1) >= 0).all()


def test_graph_walk_sees_few_of_many_centroids():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 24))[rng.integers(0, 60, 6000)] + 0.5 * rng.normal(size=(6000, 24))
    cents = posting_ann.Centroids(posting_ann.lift(x, np.linalg.norm(x, axis=1).max()), 2048)
    q = posting_ann.direction(x[:200])
    at, _, worked = cents.walk(q, 128)
    assert worked / len(q) < 0.3 * len(cents.c)
    true = np.argsort(np.linalg.norm(q[:, None] - cents.c, axis=2), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(at, true, strict=True)]) > 0.88


def turn(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": list(calls)})


def call(i, name="search", arguments=None, needs=()):
    return {"id": i, "name": name, "arguments": {"query": "x"} if arguments is None else arguments, "depends_on": list(needs)}


def result(i, content="r"):
    return json.dumps({"tool_call_id": i, "content": content})


CHAT = "conv_id long, turn int, role string, text string"


def test_tool_calls(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", turn(call("b", "fetch", {"url": "u"}, ["a"]), call("a"), call("c", "nope"), call("d", arguments={"q": 1}), call("x", needs=["y"]), call("y", needs=["x"]), content="ok")),
        (1, 2, "tool", result("b", {"z": 1.0, "a": 2})), (1, 3, "tool", result("a")), (1, 4, "tool", result("a", "again")), (1, 5, "tool", "junk"), (1, 6, None, None), (1, 7, "assistant", turn(call("a"))),
        (2, 0, "tool", result("a")), (None, None, None, None),
    ]
    got = toolcalls.linked(spark.createDataFrame(rows, CHAT).withColumn("status", F.lit("x"))).orderBy("conv_id", "anchor", "depth", "turn", "item").collect()
    one = [(r["kind"], r["call_id"], r["status"]) for r in got if r["conv_id"] == 1]
    statuses = {(k, c): s for k, c, s in one if c in ("b", "c", "d", "x", "y")}
    assert statuses == {("call", "b"): "ok", ("result", "b"): "ok", ("call", "c"): "unknown_tool", ("call", "d"): "invalid_arguments", ("call", "x"): "cycle", ("call", "y"): "cycle"}
    order = [(k, c) for k, c, s in one if s == "ok" and c]
    assert order == [("call", "a"), ("result", "a"), ("call", "b"), ("result", "b")]
    assert [s for k, c, s in one if c == "a"] == ["ok", "ok", "duplicate_result", "duplicate_call"]
    assert sum(s == "orphan_result" for _, _, s in one) == 1
    assert [(r["status"]) for r in got if r["conv_id"] == 2] == ["orphan_result"]
    assert [r["json"] for r in got if r["conv_id"] is None] == ['{"content":"","role":"unknown"}']
    assert next(r["json"] for r in got if r["call_id"] == "b" and r["kind"] == "result") == '{"content":{"a":2,"z":1},"role":"tool","tool_call_id":"b"}'


def test_long_chains_are_ordered(spark):
    calls = [call(f"c{k}", needs=[f"c{k - 1}"] if k else []) for k in range(6)]
    rows = [(1, 0, "assistant", turn(*reversed(calls))), *((1, 1 + k, "tool", result(f"c{5 - k}")) for k in range(6))]
    got = toolcalls.linked(spark.createDataFrame(rows, CHAT)).orderBy("anchor", "depth").collect()
    assert [(r["kind"], r["call_id"]) for r in got] == [x for k in range(6) for x in (("call", f"c{k}"), ("result", f"c{k}"))]
    whole = toolcalls.transcripts(spark.createDataFrame(rows, CHAT)).first()
    assert whole["n_items"] == 12 and [list(x)[-1] for x in json.loads(whole["json"])][1] == "tool_call_id"


def test_no_turns(spark):
    assert toolcalls.linked(spark.createDataFrame([], CHAT)).count() == 0


@pytest.mark.parametrize("value, text", [({"b": 1.0, "a": [True, None, 0.5]}, '{"a":[true,null,0.5],"b":1}'), ("ü\n", '"ü\\n"'), (float("nan"), "null"), ({}, "{}")])
def test_canonical_json(value, text):
    assert toolcalls.canonical(value) == text


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert QUERIES.keys() <= __spark_entry__.queries().keys() and ORACLE_SQL.keys() <= __spark_entry__.oracle_sql().keys()
    assert "pipeline" in __spark_entry__.queries()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = corpus(2, 80)
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, docs = docs, stage(spark, docs, str(tmp_path))
        assert docs.schema == before.schema, name
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select(key).collect())) == sorted(map(tuple, last.select(key).collect()))


def test_links_of_derived_calls_against_a_plain_linker(spark):
    """Every turn of a table of prose is kept, and the calls and results derived from it are linked and ordered."""
    import random

    rnd = random.Random(6)
    rows = [(c if c else None, k, ("user", "assistant")[k % 2] if rnd.random() < 0.9 else "user", f"text {c} {k}") for c in range(12) for k in range(rnd.randint(1, 30))]
    rows += [(-1, 0, "user", None), (-1, 1, "assistant", None), (3, 1, "assistant", "another"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = toolcalls.with_calls(df).collect()
    got = toolcalls.linked(toolcalls.with_calls(df)).collect()
    calls, results, expected = {}, {}, {}
    for r in sorted(made, key=lambda r: (str(r["conv_id"]), r["turn"] or 0, r["text"] or "")):
        for k, x in enumerate(toolcalls.items(r["role"], r["text"], toolcalls.SCHEMAS)):
            at = (r["conv_id"], -1 if r["turn"] is None else r["turn"], k, x["json"])
            if x["kind"] == "message":
                expected[at] = ("message", "ok")
            else:
                (calls if x["kind"] == "call" else results).setdefault((r["conv_id"], x["call_id"]), []).append((at[1], k, x["json"], x))
    depth = {}
    for key, found in calls.items():
        for nth, (turn, k, text, _) in enumerate(sorted(found, key=lambda f: f[:3])):
            expected[key[0], turn, k, text] = ("call", "duplicate_call" if nth else "ok" if key in results else "no_result")
    for key, found in results.items():
        for nth, (turn, k, text, _) in enumerate(sorted(found, key=lambda f: f[:3])):
            expected[key[0], turn, k, text] = ("result", "orphan_result" if key not in calls else "duplicate_result" if nth else "ok")

    def layers(key):
        needs = [(key[0], n) for n in sorted(calls[key], key=lambda f: f[:3])[0][3]["needs"] if (key[0], n) in calls]
        return max((layers(n) + 2 for n in needs), default=0)

    for key in calls:
        depth[key] = layers(key)
    assert {(r["conv_id"], r["turn"], r["item"], r["json"]): (r["kind"], r["status"]) for r in got} == expected and len(got) == len(expected)
    assert sum(s == ("result", "ok") for s in expected.values()) > 30
    for r in got:
        if r["kind"] == "call" and r["status"] != "duplicate_call":
            assert r["depth"] == depth[r["conv_id"], r["call_id"]]
    assert max(depth.values()) >= 4
