import struct
import zlib

import pytest
from pyspark.sql import Observation

from lexiforge.plans import runs


def test_a_whole_run(spark, tmp_path):
    (tmp_path / "d.csv").write_text("n,name\n1,Aqua\n2,Sodium Chloride\n3,Glycerin\n4,\n")
    (tmp_path / "p.csv").write_text('n,canonical,synonyms\n1,Polyamid,"Nylon 6\nNylon 12 "\n')
    truth = tmp_path / "truth"
    truth.mkdir()
    (truth / "a.yaml").write_text("id: a\nINCI_list: [AQUA, 'NYLON 12*', GLYCERIN]\n")
    (truth / "b.yaml").write_text("id: b\nINCI_list: [AQUA]\n")
    terms, synonyms = runs.tables(spark, str(tmp_path / "d.csv"), str(tmp_path / "p.csv"), str(tmp_path / "snapshots"))
    assert {r["term"] for r in terms.collect()} == {"aqua", "sodium chloride", "glycerin", "nylon 6", "nylon 12"}
    docs = spark.createDataFrame([("a", ["Ingredients:", "Aqua,", "Nylon 12,", "Sodium chlo-", "ride"])], "doc_id string, tokens array<string>")
    found = runs.results(docs, terms, synonyms)
    row = found.first()
    assert (row["ingredients"], row["pollutants"]) == (["aqua", "nylon 12", "sodium chloride"], ["Polyamid"])
    got = {r["image_id"]: (r["tp"], r["fp"], r["fn"]) for r in runs.scores(found, runs.readers.ground_truth(spark, str(truth)), runs.Settings(method="exact")).collect()}
    assert got == {"a": (2, 1, 1), "b": (0, 0, 1)}
    accuracy, f1 = runs.evaluated(spark, found, str(truth), str(tmp_path / "out"), runs.Settings(method="exact"))
    assert (accuracy, f1) == (0.33, 0.33)
    assert spark.read.json(str(tmp_path / "out/runs")).first()["method"] == "exact"
    only = runs.results(docs, *runs.tables(spark, str(tmp_path / "d.csv"), str(tmp_path / "p.csv"), str(tmp_path / "snapshots"), settings=runs.Settings("ingredients")), runs.Settings("ingredients")).first()
    assert (only["ingredients"], only["pollutants"]) == (["aqua", "sodium chloride"], [])


def test_settings_are_checked():
    with pytest.raises(ValueError, match="no such detection"):
        runs.Settings(detection="all")


def test_settings_of_a_file(tmp_path):
    (tmp_path / "a.yml").write_text("method: exact\nword_threshold: 0.7\n")
    assert runs.Settings.read(str(tmp_path / "a.yml")) == runs.Settings(method="exact", word_threshold=0.7)
    (tmp_path / "b.yml").write_text("colour: red\n")
    with pytest.raises(ValueError, match="colour"):
        runs.Settings.read(str(tmp_path / "b.yml"))


def test_tables_follow_all_that_they_are_made_of(spark, tmp_path):
    for k, names in enumerate((["Aqua", "Oil"], ["Glycerin"], ["Sodium"])):
        (tmp_path / "sheets").mkdir(exist_ok=True)
        (tmp_path / "sheets" / f"{k}.csv").write_text("n,name\n" + "".join(f"{j},{x}\n" for j, x in enumerate(names)))
    (tmp_path / "p.csv").write_text('n,canonical,synonyms\n1,Polyamid,Nylon 6\n')
    known = tmp_path / "known.json"
    terms = lambda: {r["term"] for r in runs.tables(spark, str(tmp_path / "sheets"), str(tmp_path / "p.csv"), str(tmp_path / "snapshots"), str(known))[0].collect()}
    all_ = {"aqua", "oil", "glycerin", "sodium", "nylon 6"}
    assert terms() == all_
    known.write_text('["new term"]')
    assert terms() == all_ | {"new term"}
    known.write_text('["newer term"]')
    assert terms() == all_ | {"newer term"}


def _png(path, value, size=(4, 6)):
    """An image file of one gray level."""
    h, w = size
    rows = b"".join(b"\x00" + bytes([value]) * 3 * w for _ in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + head + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b""))


def test_from_images_to_results(spark, tmp_path):
    class Levels:
        """Says what an image of each gray level shows, and shape and kind of what it was given."""

        def recognise(self, image):
            box = lambda y: [(0, y), (1, y), (1, y + 1), (0, y + 1)]
            assert image.ndim == 2 and image.size <= 8
            if image.max() == 30:
                raise RuntimeError("unreadable")
            return {10: [(box(90), "Nylon 12", None), (box(0), "Ingredients: Aqua,", 0.9)], 20: []}[image.max()]

    folder = tmp_path / "images"
    folder.mkdir()
    for name, level in (("a", 10), ("b", 20), ("c", 30)):
        _png(folder / f"{name}.png", level)
    (folder / "d.png").write_bytes(b"no image")
    (folder / "e.txt").write_bytes(b"no image either")
    terms = spark.createDataFrame([("aqua",), ("nylon 12",)], "term string")
    synonyms = spark.createDataFrame([("nylon 12", "Polyamid")], "synonym string, canonical string")
    pictures = runs.readers.decoded_images(spark, str(folder))
    found = runs.from_images(pictures, Levels, terms, synonyms, str(tmp_path / "out"), runs.Settings(steps=("gray",), max_pixels=8))
    got = {r["doc_id"]: (r["ingredients"], r["pollutants"], r["error"]) for r in found.collect()}
    assert got == {
        "a": (["aqua", "nylon 12"], ["Polyamid"], None),
        "b": ([], [], None),
        "c": (None, None, "RuntimeError: unreadable"),
        "d": (None, None, "ValueError: not an image"),
    }
    none = runs.from_images(pictures.limit(0), Levels, terms, synonyms, str(tmp_path / "none"))
    assert none.collect() == []


def test_steps_are_checked():
    with pytest.raises(ValueError, match="rotate"):
        runs.Settings(steps=("gray", "rotate"))


def test_uploads_survive_a_restart(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()
    told = str(asked)  # a recogniser in a worker leaves a file for each image that it was asked about

    class Reads:
        def recognise(self, image):
            import os
            import uuid

            text = image.decode()
            open(os.path.join(told, f"{text.replace(' ', '_')}-{uuid.uuid4().hex}"), "w").close()
            if not text.strip():
                raise RuntimeError("blank")
            return [([(0, 0), (9, 0), (9, 9), (0, 9)], text, None)]

    put = lambda name, content: ((tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / "in" / name).write_bytes(content))
    terms = spark.createDataFrame([("aqua",), ("nylon 12",)], "term string")
    synonyms = spark.createDataFrame([("nylon 12", "Polyamid")], "synonym string, canonical string")
    calls = []

    def tables():
        calls.append(1)
        return terms, (synonyms if len(calls) > 1 else synonyms.selectExpr("synonym", "raise_error('cut off') as canonical"))

    def run():
        runs.upload_stream(runs.readers.uploads(spark, str(tmp_path / "in")), Reads, tables, str(tmp_path / "out")).awaitTermination()

    got = lambda: sorted((r["doc_id"].rsplit("/in/")[-1], r["ingredients"], r["error"]) for r in runs.uploaded_results(spark, str(tmp_path / "out")).collect())
    put("x/a.png", b"Aqua")
    put("y/a.png", b"Nylon 12")
    put("b.jpg", b" ")
    put("f.png", b"")  # Spark's file sources leave out files of no bytes
    put("c.png", b"\xff\xfe")
    put("d.txt", b"Aqua")
    with pytest.raises(Exception, match="cut off"):
        run()
    run()
    first = got()
    assert [(n, i) for n, i, _ in first] == [("b.jpg", None), ("c.png", None), ("x/a.png", ["aqua"]), ("y/a.png", ["nylon 12"])]
    assert first[0][2] == "RuntimeError: blank" and first[1][2].startswith("UnicodeDecodeError")
    assert len(list(asked.iterdir())) == 3  # recognised once, though the batch ran twice
    run()
    assert got() == first
    put("e.png", b"Aqua")
    put("x/a.png", b"other")  # a path that was read
    run()
    assert got() == sorted([*first, ("e.png", ["aqua"], None)], key=lambda r: r[0])


def test_images_are_counted_as_they_are_written(spark, tmp_path):
    class Reads:
        def recognise(self, image):
            return [([(0, 0), (9, 0), (9, 9), (0, 9)], x, None) for x in image.decode().split()]

    pictures = spark.createDataFrame([("a", b"x y"), ("b", b""), ("c", b"\xff")], "image_id string, content binary")
    terms, synonyms = spark.createDataFrame([("aqua",)], "term string"), spark.createDataFrame([], "synonym string, canonical string")
    seen = Observation("images")
    runs.from_images(pictures, Reads, terms, synonyms, str(tmp_path), run="one", seen=seen)
    assert seen.get == {"images": 3, "failed": 1, "boxes": 2}


def test_scores_read_their_input_once(spark):
    predicted = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("a", None), (None, "x"), ("z", "x")], "image_id string, item string")
    truth = spark.createDataFrame([("a", "x"), ("a", "q"), ("a", "q"), ("a", None), ("b", "x"), (None, "x")], "image_id string, item string")
    found = runs.evaluate.metrics(predicted, truth)
    got = {r["image_id"]: (r["tp"], r["fp"], r["fn"], r["tp_rate"]) for r in found.collect()}
    assert got == {"a": (2, 2, 3, 0.5), "b": (0, 0, 1, 0.0), None: (0, 0, 1, 0.0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2


def test_the_layout_factor_is_a_setting(spark, tmp_path):
    class Reads:
        def recognise(self, image):
            box = lambda x, y: [(x, y), (x + 10, y), (x + 10, y + 10), (x, y + 10)]
            return [(box(0, 2), "Sodium", None), (box(12, 0), "chloride", None)]

    pictures = spark.createDataFrame([("a", b"x")], "image_id string, content binary")
    terms, synonyms = spark.createDataFrame([("sodium chloride",)], "term string"), spark.createDataFrame([], "synonym string, canonical string")
    (tmp_path / "apart.yml").write_text("layout_factor: 0.0\n")
    found = {}
    for name, settings in (("joined", None), ("apart", runs.Settings.read(str(tmp_path / "apart.yml")))):
        found[name] = runs.from_images(pictures, Reads, terms, synonyms, str(tmp_path / "out"), settings).first()["ingredients"]
    assert found == {"joined": ["sodium chloride"], "apart": []}
