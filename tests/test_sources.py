import datetime
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from lexiforge.sources import readers, sinks
from lexiforge.streaming import streams


def test_json_and_yaml(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(["B ", "a"]))
    (tmp_path / "m.yml").write_text("nylon 6: Polyamid\n'b': ' X '\n")
    assert [tuple(r) for r in readers.json_list(spark, str(tmp_path / "s.json")).orderBy("seq").collect()] == [(0, "B "), (1, "a")]
    assert readers.json_terms(spark, str(tmp_path / "none.json")).count() == 0
    assert {tuple(r) for r in readers.yaml_map(spark, str(tmp_path / "m.yml")).collect()} == {("nylon 6", "Polyamid"), ("b", " X ")}


def test_ground_truth(spark, tmp_path):
    (tmp_path / "0083.yaml").write_text("id: '0083'\nbrand: Grün\nextracted_barcode: null\nINCI_list: [AQUA, 'LIMONENE*']\n")
    row = readers.ground_truth(spark, str(tmp_path)).first()
    assert (row["id"], row["brand"], row["extracted_barcode"], row["inci_list"]) == ("0083", "Grün", None, ["AQUA", "LIMONENE*"])


def test_images_are_found_by_their_ending(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for name in ("a.jpg", "x/b.png", "c.JPG", "d.txt"):
        (tmp_path / name).write_bytes(b"1")
    assert {r["image_id"] for r in readers.images(spark, str(tmp_path)).collect()} == {"a", "b"}


def test_sheets(spark, tmp_path):
    (tmp_path / "p.csv").write_text('x,canonical,synonyms\n1,Polyamid,"nylon 6\nnylon 12"\n2,Y,\n')
    rows = readers.pollutant_sheet(spark, str(tmp_path / "p.csv")).orderBy("row").collect()
    assert [(r["canonical"], r["synonyms"]) for r in rows] == [("Polyamid", "nylon 6\nnylon 12"), ("Y", None)]


def test_sinks(spark, tmp_path):
    terms = spark.createDataFrame([("b",), ("a",)], "term string")
    sinks.dictionary(terms, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).count() == 2
    pairs = spark.createDataFrame([("a", "x")], "synonym string, canonical string")
    sinks.synonyms(pairs, str(tmp_path / "s"))
    sinks.synonyms(pairs.union(pairs), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1
    sinks.synonyms(pairs.union(pairs), str(tmp_path / "s"), refresh=True)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    results = spark.createDataFrame([("i", ["a", "b"], ["x"])], "doc_id string, ingredients array<string>, pollutants array<string>")
    sinks.per_image(results, str(tmp_path / "r"), sinks.run_id(spark))
    assert sinks.ingredient_texts(results).first()["value"] == "a,\nb"
    sinks.run_info(spark, str(tmp_path / "i"), "run", "exact", 0.5, 0.25, {"threshold": "80"})
    assert spark.read.json(str(tmp_path / "i")).first()["f1_score"] == 0.25


def test_stream_drops_repeats(spark, tmp_path):
    rows = [("k", f"2024-01-01 00:00:0{i}", v) for i, v in enumerate("aabba")]
    df = spark.createDataFrame(rows, "key string, ts string, value string").withColumn("ts", F.to_timestamp("ts"))
    assert [r["value"] for r in streams.without_repeats(df, "key", ["ts"], "value").orderBy("ts").collect()] == ["a", "b", "a"]
    df.where("ts < '2024-01-01 00:00:02'").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp, value string").parquet(str(tmp_path / "in"))

    def run():
        q = streams.stream_without_repeats(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    df.where("ts >= '2024-01-01 00:00:02'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert [r["value"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()] == ["a", "b", "a"]


@pytest.mark.parametrize("seed", [0, 1])
def test_stream_in_order_equals_the_batch_window(spark, tmp_path, seed):
    rnd = random.Random(seed)
    second = datetime.timedelta(seconds=1)
    begin = datetime.datetime(2024, 1, 1)
    rows = [(rnd.choice(["a", "b", None]), begin + second * rnd.randint(0, 600), rnd.choice(["x", "y", None])) for _ in range(300)]
    rows.sort(key=lambda r: r[1])
    held = list(rows)
    for k in range(0, len(rows) - 20, 20):  # out of order, but never by more than what a watermark of ten minutes lets in
        part = rows[k : k + 40]
        rnd.shuffle(part)
        rows[k : k + 40] = part
    end = [("z", begin + second * 5000, "end"), ("z", begin + second * 9000, "end")]
    late, none = [("a", begin - second * 9000, "late")], [("a", None, "no time")]
    schema = "key string, ts timestamp, value string"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = streams.stream_without_repeats_in_order(stream, "10 minutes")
    for batch in (rows[:100], rows[100:220] + none, rows[220:], end[:1], late + end[1:]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    expected = streams.without_repeats(spark.createDataFrame(held, schema), "key", ["ts", "value"], "value").collect()
    told = lambda frame: sorted(((r["key"], r["ts"], r["value"]) for r in frame), key=repr)
    assert told(r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["key"] != "z") == told(expected)


def test_stream_forgets_idle_keys(spark, tmp_path):
    second, begin = datetime.timedelta(seconds=1), datetime.datetime(2024, 1, 1)
    schema = "key string, ts timestamp, value string"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = streams.stream_without_repeats_in_order(stream, "1 second", forget_after_seconds=100)
    for k, batch in enumerate([[("a", 0, "x"), ("a", 3, "x")], [("z", 50, "q")], [("a", 60, "x")], [("z", 1000, "r")], [("a", 1001, "x"), ("z", 1001, "r")], [("z", 2000, "s")]]):
        spark.createDataFrame([(a, begin + second * t, v) for a, t, v in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["ts"] - begin).seconds for r in spark.read.parquet(str(tmp_path / "out")).where("key = 'a'").collect())
    assert got == [0, 1001]  # 3 and 60 repeat 0; by 1001 the key was forgotten


def test_resolve_stream(spark, tmp_path):
    spark.createDataFrame([("a", ["Aqua"])], "doc_id string, tokens array<string>").write.parquet(str(tmp_path / "in"))
    tokens = spark.readStream.schema("doc_id string, tokens array<string>").parquet(str(tmp_path / "in"))
    tables = lambda: (spark.createDataFrame([("aqua",)], "term string"), spark.createDataFrame([("aqua", "Water")], "synonym string, canonical string"))
    streams.resolve_stream(tokens, tables, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert (row["ingredients"], row["pollutants"]) == (["aqua"], ["Water"])


def test_barcodes(spark, tmp_path):
    rows = spark.createDataFrame([("4012",), (None,), ("0083",)], "code string")
    sinks.barcodes(rows, "code", str(tmp_path / "codes"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "codes")).collect()) == ["0083", "4012"]
    sinks.barcodes(rows.limit(0), "code", str(tmp_path / "codes"))
    assert spark.read.text(str(tmp_path / "codes")).count() == 0


def _workbook(path, rows):
    """A workbook of one sheet: text through the shared strings, or in place where it begins with an i; numbers and blank cells."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared, lines = [], []
    for n, row in rows.items():
        cells = ""
        for c, v in enumerate(row):
            at = f'r="{"ABCDE"[c]}{n}"'
            if isinstance(v, str) and v.startswith("i"):
                cells += f'<c {at} t="inlineStr"><is><t>{v}</t></is></c>'
            elif isinstance(v, str):
                cells += f'<c {at} t="s"><v>{len(shared)}</v></c>'
                shared.append(f"<si><r><t>{v[:1]}</t></r><r><t>{v[1:]}</t></r></si>")
            elif v is not None:
                cells += f"<c {at}><v>{v}</v></c>"
        lines.append(f'<row r="{n}">{cells}</row>')
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="x" sheetId="1" r:id="rId7"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/sheet3.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet3.xml", f"<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>")
        if shared:
            book.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(shared)}</sst>")


def test_workbooks(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx", {1: ["n", "name", "also"], 2: [1, "Aqua", "x"], 4: [2.5, None, "nylon 6\nnylon 12"], 5: [3, "in place"], 6: [4, 7]})
    _workbook(tmp_path / "b.xlsx", {1: ["n", "name"]})
    _workbook(tmp_path / "c.xlsx", {})
    _workbook(tmp_path / "d.xlsx", {1: ["n", "name"], 2: [1.5, 2.5]})
    many = readers.dictionary_sheet(spark, str(tmp_path / "*.xlsx"))
    assert [(r["row"], r["name"]) for r in many.orderBy("row").collect()] == [(0, "Aqua"), (1, None), (2, None), (3, "in place"), (4, "7"), (5, "2.5")]
    assert many.select("name").rdd.getNumPartitions() >= 1
    one = readers.pollutant_sheet(spark, str(tmp_path / "a.xlsx")).orderBy("row").collect()
    assert [(r["canonical"], r["synonyms"]) for r in one][:3] == [("Aqua", "x"), (None, None), (None, "nylon 6\nnylon 12")]
    (tmp_path / "broken.xlsx").write_bytes(b"PK no")
    with pytest.raises(Exception, match="not a workbook: .*broken.xlsx"):
        readers.dictionary_sheet(spark, str(tmp_path / "*.xlsx")).collect()


def test_yaml_maps(spark, tmp_path):
    (tmp_path / "a.yml").write_text("a: x\nb:\na: y\n")
    (tmp_path / "b.yml").write_text("# nothing\n")
    assert {tuple(r) for r in readers.yaml_map(spark, str(tmp_path)).collect()} == {("a", "y"), ("b", None)}
    for text in ("- a\n- b\n", "a: [\n"):
        (tmp_path / "c.yml").write_text(text)
        with pytest.raises(Exception, match="not a YAML mapping: .*c.yml"):
            readers.yaml_map(spark, str(tmp_path)).collect()


def test_json_array_is_one_file(spark, tmp_path):
    path = tmp_path / "terms.json"
    terms = spark.createDataFrame([("b",), ('say "ü"',), ("a",), (None,), ("a",)], "term string")
    sinks.json_array(terms, str(path))
    assert json.loads(path.read_text()) == ["a", "b", 'say "ü"']
    assert [r["term"] for r in readers.json_terms(spark, str(path)).collect()] == ["a", "b", 'say "ü"']
    sinks.json_array(terms.limit(0), str(path))
    assert json.loads(path.read_text()) == []
    with pytest.raises(Exception, match="no more"):
        sinks.json_array(terms.selectExpr("if(term = 'b', raise_error('no more'), term) as term"), str(path))
    assert json.loads(path.read_text()) == [] and [p.name for p in tmp_path.iterdir() if "terms.json-" in p.name] == []


def test_a_failed_task_leaves_no_partial_run(spark, tmp_path):
    good = spark.range(100)
    bad = spark.range(100).selectExpr("if(id = 70, raise_error('lost'), id) as id")
    at = str(tmp_path / "run")
    with pytest.raises(Exception, match="lost"):
        sinks.committed({"a": good, "b": bad}, at)
    assert list(tmp_path.iterdir()) == []
    sinks.committed({"a": good, "b": good}, at)
    with pytest.raises(Exception, match="lost"):
        sinks.committed({"a": good.limit(1), "b": bad}, at)
    assert spark.read.parquet(f"{at}/a").count() == spark.read.parquet(f"{at}/b").count() == 100
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["run"]
