"""Whole runs: build or refresh the tables, resolve token lists, score them against labelled products."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators import dictionary, evaluate, images, layout, nearest, refresh, resolve, vector_join
from ..sources import readers, sinks


@dataclass(frozen=True)
class Settings:
    """What a run can be told. detection: pollutants and dictionary terms (both), or dictionary terms alone (ingredients). layout_factor: how near boxes of a line are, against the mean and deviation of a box's nearest ones. steps: of preparing images, by name."""

    detection: str = "both"
    method: str = "levenshtein"
    threshold: int = 80
    simple_grammar: bool = True
    correct_words: bool = True
    verify_terms: bool = True
    word_threshold: float = 0.8
    token_threshold: float = 0.8
    max_pixels: int = images.MAX_PIXELS
    layout_factor: float = layout.FACTOR
    steps: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.detection not in ("both", "pollutants", "ingredients"):
            raise ValueError(f"no such detection: {self.detection}")
        if not set(self.steps) <= set(images.STEPS):
            raise ValueError(f"no such steps: {', '.join(sorted(set(self.steps) - set(images.STEPS)))}")

    @classmethod
    def read(cls, path: str) -> Settings:
        """The settings of a YAML file, a flat mapping; what it doesn't name has its default, and what isn't a setting is an error."""
        import yaml

        with open(path, encoding="utf-8") as f:
            told = yaml.safe_load(f) or {}
        unknown = set(told) - {x.name for x in fields(cls)}
        if unknown:
            raise ValueError(f"no such settings: {', '.join(sorted(unknown))}")
        return cls(**told)


def tables(spark: SparkSession, dictionary_sheet: str, pollutant_sheet: str, folder: str, existing: str | None = None, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """The combined dictionary (term) and the synonym map (synonym, canonical) of the two sheets. Both are kept as snapshots by content: a changed sheet is built anew, an unchanged one isn't."""
    settings = settings or Settings()
    raw = readers.dictionary_sheet(spark, dictionary_sheet)
    sheet = readers.pollutant_sheet(spark, pollutant_sheet)

    also = [readers.json_terms(spark, existing)] if existing else []

    def build_terms(source: DataFrame) -> DataFrame:
        return dictionary.merged(dictionary.expanded(dictionary.terms(source), settings.simple_grammar), *also)

    terms = refresh.ensured(raw, build_terms, f"{folder}/dictionary-{settings.simple_grammar}", *also)
    synonyms = refresh.ensured(sheet, lambda s: dictionary.synonym_map(dictionary.exploded_synonyms(s)), f"{folder}/synonyms")
    if settings.detection == "ingredients":
        return terms, synonyms
    named = synonyms.select(F.col("synonym").alias("synonym_raw"))
    return dictionary.combined(terms, named).select("term"), synonyms


def results(docs: DataFrame, terms: DataFrame, synonyms: DataFrame, settings: Settings | None = None, indexes: str | None = None, encoder=None) -> DataFrame:
    """doc_id, ingredients, pollutants of token lists (doc_id, tokens). indexes: a folder that keeps the vectors of the terms and their words from run to run; without one they are encoded anew."""
    settings = settings or Settings()
    held = resolve.indexes(terms, indexes, encoder) if indexes else {"token_index": nearest.sparse(terms, "term", encoder or vector_join.NgramEncoder())}
    if not settings.verify_terms:
        held.pop("token_index")
    wanted = None if settings.detection == "ingredients" else synonyms
    return resolve.resolved(docs, terms, wanted, correct=settings.correct_words, word_threshold=settings.word_threshold, token_threshold=settings.token_threshold, encoder=encoder, **held)


def from_images(pictures: DataFrame, make: Callable[[], images.Recogniser], terms: DataFrame, synonyms: DataFrame, folder: str, settings: Settings | None = None, run: str | None = None, seen: Observation | None = None, encoder=None) -> DataFrame:
    """doc_id, ingredients, pollutants, error: a row for each image (readers.images or readers.decoded_images; each image_id once).

    Recognition is the costly part, so it runs once: what it finds is written to a folder of this run's own below `folder`, and layout and resolving
    read that; vectors of terms are kept there too, for all runs. An image with an error has null lists, one without text empty ones.
    run: a name for the run's folder; a run of that name that has finished recognition isn't recognised again. seen: gets the numbers of images, failed and boxes from the pass that writes them
    (with a recognised run there is no such pass, and it gets nothing).
    """
    settings = settings or Settings()
    path = f"{folder}/recognised/{run or uuid.uuid4().hex}"
    if not (run and refresh.finished(pictures.sparkSession, path)):
        rows = images.recognised(pictures, make, dict.fromkeys(settings.steps, True), settings.max_pixels)
        if seen:
            sizes = F.coalesce(F.sum(F.when(F.col("error").isNull(), F.size("boxes"))), F.lit(0))
            rows = rows.observe(seen, F.count("*").alias("images"), F.count("error").alias("failed"), sizes.alias("boxes"))
        rows.write.mode("overwrite").parquet(path)
    rows = pictures.sparkSession.read.parquet(path)
    docs = layout.token_lists(images.exploded(rows), settings.layout_factor).withColumnRenamed("image_id", "doc_id")
    found = results(docs, terms, synonyms, settings, f"{folder}/indexes", encoder)
    empty = F.array().cast("array<string>")
    lists = [F.when(F.col("error").isNull(), F.coalesce(c, empty)).alias(c) for c in ("ingredients", "pollutants")]
    return rows.select(F.col("image_id").alias("doc_id"), "error").join(found, "doc_id", "left").select("doc_id", *lists, "error")


def upload_stream(
    uploads: DataFrame, make: Callable[[], images.Recogniser], tables: Callable[[], tuple[DataFrame, DataFrame]], folder: str, settings: Settings | None = None, encoder=None
) -> StreamingQuery:
    """Recognises and resolves a stream of uploaded images (readers.uploads) batch by batch; results(doc_id, ingredients, pollutants, error, batch) are read by uploaded_results.

    A batch that is cut off runs again under its number and over the same files: its results are there whole or not at all, and it takes what it had recognised, so no image is lost or
    counted twice. An image that can't be read or recognised is a row with an error, and so doesn't stop the stream. tables: asked anew for each batch, as for resolve_stream.
    """

    def batch(rows: DataFrame, number: int) -> None:
        terms, synonyms = tables()
        found = from_images(rows, make, terms, synonyms, folder, settings, run=f"batch={number}", encoder=encoder)
        sinks.committed({f"batch={number}": found}, f"{folder}/results/part={number}")

    return uploads.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def uploaded_results(spark: SparkSession, folder: str) -> DataFrame:
    """What upload_stream has written so far."""
    kinds = "doc_id string, ingredients array<string>, pollutants array<string>, error string, batch long"
    return spark.read.schema(kinds).option("basePath", f"{folder}/results").parquet(f"{folder}/results/part=*")


def scores(found: DataFrame, truth: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Metrics of each labelled product (id, inci_list) against the results of the same name. Products without a result count as found empty; results without a product are left out."""
    settings = settings or Settings()
    tidy = lambda c: text.strip(F.lower(c))
    predicted = found.select(F.col("doc_id").cast("string").alias("image_id"), F.explode("ingredients").alias("item")).withColumn("item", tidy(F.col("item")))
    wanted = truth.select(F.col("id").alias("image_id"), F.explode("inci_list").alias("item")).withColumn("item", text.without_stars(F.col("item")))
    return evaluate.metrics(predicted, wanted, settings.method, threshold=settings.threshold)


def evaluated(spark: SparkSession, found: DataFrame, truth_folder: str, out: str, settings: Settings | None = None) -> tuple[float | None, float | None]:
    """Scores results against a folder of labels, writes the scores and the run's description below `out`, and returns accuracy and F1. Both means are observed in the pass that writes the scores."""
    settings = settings or Settings()
    run, mean = sinks.run_id(spark), Observation("macro")
    rows = scores(found, readers.ground_truth(spark, truth_folder), settings)
    means = (F.bround(F.avg("tp_rate"), 2).alias("accuracy"), F.bround(F.avg("f1"), 2).alias("f1_score"))
    rows.observe(mean, *means).write.mode("overwrite").parquet(f"{out}/scores/{run.replace(':', '-')}")
    got = mean.get
    sinks.run_info(spark, f"{out}/runs", run, settings.method, got["accuracy"], got["f1_score"], {k: str(v) for k, v in asdict(settings).items()})
    return got["accuracy"], got["f1_score"]
