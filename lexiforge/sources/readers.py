"""Readers of the engine's inputs. Schemas are explicit; files are read by Spark, so any store it knows will do."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .. import schemas

IMAGE_ENDINGS = (".jpg", ".png", ".jpeg")


def json_list(spark: SparkSession, path: str) -> DataFrame:
    """seq, synonym_raw of a file that holds one JSON array of strings."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("seq", "synonym_raw")).select(F.col("seq").cast("long"), "synonym_raw")


def json_terms(spark: SparkSession, path: str) -> DataFrame:
    """term of a JSON array; no rows if there is no such file."""
    try:
        return json_list(spark, path).select(F.col("synonym_raw").alias("term"))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schemas.TERMS)
        raise


def yaml_map(spark: SparkSession, path: str) -> DataFrame:
    """synonym, canonical of flat YAML mappings, each file read in a task; of keys that a file holds twice the last one counts, and an empty file has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for batch in batches:
            for source, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    held = yaml.safe_load(content) or {}
                    pairs = [(str(k), None if v is None else str(v)) for k, v in held.items()]
                except (yaml.YAMLError, AttributeError) as e:
                    raise ValueError(f"not a YAML mapping: {source}") from e
                yield pa.record_batch({"synonym": pa.array([k for k, _ in pairs], pa.string()), "canonical": pa.array([v for _, v in pairs], pa.string())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schemas.SYNONYM_MAP)


def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """The labelled products of a folder of YAML files, with the file's stem as id."""
    names = [f.split()[0] for f in schemas.GROUND_TRUTH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                made = yaml.safe_load(content) or {}
                row = {k: None if made.get(k) is None else str(made[k]) for k in names}
                items = made.get("INCI_list")
                rows.append(row | {"id": path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "inci_list": None if items is None else [str(x) for x in items]})
            kinds = {k: pa.list_(pa.string()) if k == "inci_list" else pa.string() for k in names}
            yield pa.record_batch({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.yaml").load(folder)
    return files.select("path", "content").mapInArrow(run, schemas.GROUND_TRUTH)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path, image_id (the file's stem) and content of the images below a folder. Endings are taken as written, in small letters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return image_files(files, "path").select("path", F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("image_id"), "content")


def uploads(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of the images that arrive in a folder: path, image_id (the whole path, so that files of one name in two folders stay apart) and content.

    Files are to be moved in whole; a path that has been read is not read again, whatever is written there later. Spark's file sources leave out files of
    no bytes, so these have no row.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    rows = files.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return image_files(rows, "path").select("path", F.col("path").alias("image_id"), "content")


def decoded_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, image_id, height, width, channels and pixels (rows of blue, green, red) of the images below a folder. A file that can't be decoded has a height of -1."""
    raw = spark.read.format("image").option("recursiveFileLookup", "true").load(folder).select("image.*")
    rows = raw.select(F.col("origin").alias("path"), F.regexp_extract("origin", r"([^/]+)\.[^.]+$", 1).alias("image_id"), "height", "width", F.col("nChannels").alias("channels"), F.col("data").alias("pixels"))
    return image_files(rows, "path")


def first_of_folder(files: DataFrame, column: str = "path") -> DataFrame:
    """folder, and the first of its paths in order of characters."""
    return files.groupBy(F.regexp_replace(column, "/[^/]*$", "").alias("folder")).agg(F.min(column).alias(column))


def image_files(files: DataFrame, column: str) -> DataFrame:
    """Rows whose path ends as an image's."""
    some = F.lit(False)
    for e in IMAGE_ENDINGS:
        some = some | F.col(column).endswith(e)
    return files.where(some)


def sheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A spreadsheet saved as CSV with a header row; all columns as declared."""
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').schema(schema).csv(path)


def dictionary_sheet(spark: SparkSession, path: str) -> DataFrame:
    """row, name of the second column of spreadsheets: CSV files, or workbooks where the path ends as xlsx (folder/*.xlsx for several)."""
    return _columns(spark, path, [(1, "name")], schemas.DICTIONARY_RAW)


def pollutant_sheet(spark: SparkSession, path: str) -> DataFrame:
    """row, canonical, synonyms of the second and third column of a spreadsheet."""
    return _columns(spark, path, [(1, "canonical"), (2, "synonyms")], schemas.POLLUTANTS_RAW)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _cells(content: bytes) -> Iterator[tuple[int, dict[int, str]]]:
    """The rows of a workbook's first sheet: number (from 1) and the text of its filled cells by column (from 0). Whole numbers come without a point, dates as the numbers that they are stored as."""
    from io import BytesIO
    from xml.etree import ElementTree
    from zipfile import ZipFile

    with ZipFile(BytesIO(content)) as book:
        first = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet")
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = links[first.get(_LINK)]
        words = lambda x: "".join(t.text or "" for t in x.iter(f"{_MAIN}t"))
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [words(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]
        number = 0
        with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag != f"{_MAIN}row":
                    continue
                number, column, cells = int(row.get("r") or number + 1), -1, {}
                for c in row.findall(f"{_MAIN}c"):
                    letters = (c.get("r") or "").rstrip("0123456789")
                    column = functools.reduce(lambda n, a: 26 * n + ord(a) - 64, letters, 0) - 1 if letters else column + 1
                    kind, v = c.get("t", "n"), c.findtext(f"{_MAIN}v")
                    if kind == "inlineStr":
                        cells[column] = words(c)
                    elif v is not None and kind == "s":
                        cells[column] = shared[int(v)]
                    elif v is not None and kind == "b":
                        cells[column] = str(v == "1")
                    elif v is not None and kind == "n":
                        cells[column] = str(int(float(v))) if float(v).is_integer() else repr(float(v))
                    elif v is not None and kind != "e":
                        cells[column] = v
                yield number, cells
                row.clear()


def _workbooks(spark: SparkSession, path: str, places: list[tuple[int, str]]) -> DataFrame:
    """file, at and the wanted columns of workbooks, each read in a task; rows after the first one, blank ones in between included, blank cells null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file = batch.column("path")[k].as_py()
                try:
                    rows = dict(_cells(batch.column("content")[k].as_py()))
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a file, its name is told
                    raise ValueError(f"not a workbook: {file}") from e
                at = range(2, max((n for n, c in rows.items() if c), default=1) + 1)
                made = {name: pa.array([rows.get(n, {}).get(p) or None for n in at], pa.string()) for p, name in places}
                yield pa.record_batch({"file": pa.array([file] * len(at), pa.string()), "at": pa.array(at, pa.int64()), **made})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"file string, at long, {', '.join(f'{n} string' for _, n in places)}")


def _columns(spark: SparkSession, path: str, places: list[tuple[int, str]], schema: str) -> DataFrame:
    if path.endswith(".xlsx"):
        kept = _workbooks(spark, path, places)
    else:
        raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
        kept = raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), *(F.col(f"`{raw.columns[p]}`").alias(n) for p, n in places))
    # rows by file and place in it, however the files were dealt out; sheets are of bounded size, so one task may number them
    return kept.withColumn("row", (F.row_number().over(Window.orderBy("file", "at")) - 1).cast("long")).select("row", *(n for _, n in places))


def with_fallback(first: DataFrame, second: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """wanted's keys with the value of the first source, or else of the second."""
    a = first.select(key, F.col(value).alias("first_value"))
    b = second.select(key, F.col(value).alias("second_value"))
    return wanted.join(a, key, "left").join(b, key, "left").select(key, F.coalesce("first_value", "second_value").alias(value))
