"""Quality rules: n-gram perplexity under modified Kneser-Ney models, one for each language.

Spark counts the 4-grams of character classes of all texts; a modified Kneser-Ney model is estimated for each
language and stored as sorted arrays of n-gram numbers with their log probabilities; every whole text is scored under
its language's model. That model knows the junk among its texts as well, so it is estimated once more, from the texts
whose log perplexity lies within TRIM spreads of the language's median. From the scores of all texts under the second
model each language gets a lower and an upper band of perplexity, and texts outside it are rejected. Median and spread
(from the deviation that SHARE of the texts stay within) aren't moved by junk or by a third of the texts being copies.

The classes see neither the order of words nor what most letters outside ASCII are. So whole words and pairs of them are counted as well, in tables
that grow with the corpus and are joined with the texts (see word_pairs). Two more bands, each on one side, reject texts of words that other texts
don't hold and texts whose words' order gains too little.

A language's model has a proven bound: N_CLASSES ** 4 (3.7 million) entries of 8 bytes, whatever the corpus holds; real
text fills a few hundredths of it. Every language has its own; workers expand the models of TABLES languages at a time.

Defined cases: a null or empty text has no words, fails the base rule and has a null perplexity. A null lang
is a language of its own, apart from all that have a name. Repeated rows are judged alike, each for itself. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _io, _text, word_pairs

ORDER = 4
#: Models that a worker holds expanded, 15 MB each.
TABLES = 8
#: Half width of the band in spreads; of the texts that the second model is estimated from; and what share of normally distributed texts lies within how many spreads.
WIDTH, TRIM, SHARE, WITHIN = 8.0, 3.0, 0.8, 1.2816
#: Widths of the one-sided bands of words and of their order.
WORD_WIDTH, ORDER_WIDTH = 8.0, 4.0
#: A spread is at least so large. Deviations of texts of fewer than FULL_LENGTH bytes count by the root of their share of it.
LEAST_SPREAD, FULL_LENGTH = 0.01, 800.0
#: Log perplexities are tallied in steps of this size to find their median and spread.
STEP = 0.002


def _classes() -> np.ndarray:
    """The class of each byte value: small letters each alone, capitals together, kinds of signs, kinds of UTF-8 bytes."""
    out = np.zeros(256, dtype=np.int32)  # numbers of 4-grams fit as well
    for c in range(26):
        out[97 + c] = 1 + c
    out[65:91] = 27
    out[48:58] = 28
    for at, k in ((b" \t", 29), (b"\n\r\x0b\x0c", 30), (b".", 31), (b",", 32), (b"?!;:", 33), (b"'\"()[]{}-", 34), (b"#*$%&|<>@=+_~^\\/`", 35)):
        out[list(at)] = k
    out[0x80:0xC0] = 36 + np.arange(64) // 16
    out[0xC0:0xC4] = 40
    out[0xC4:0xE0] = 41
    out[0xE0:0xF0] = 42
    out[0xF0:0x100] = 43
    return out


CLASS = _classes()
N_CLASSES = 44
_BREAK = CLASS[10]


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-gram that ends at each byte of the texts, which are taken to follow line breaks; and where each text begins."""
    pad = b"\n" * (ORDER - 1)
    buf = CLASS[np.frombuffer(pad + pad.join([*texts, b""]), dtype=np.uint8)]
    key = buf[: len(buf) - ORDER + 1]
    for k in range(1, ORDER):
        key = key * N_CLASSES + buf[k : len(buf) - ORDER + 1 + k]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    first = np.concatenate([[0], np.cumsum(sizes + ORDER - 1)[:-1]]).astype(np.int64) if len(texts) else sizes
    inside = np.ones(len(key), dtype=bool)
    for k in range(ORDER - 1):
        at = first + sizes + k
        inside[at[at < len(key)]] = False
    return key[inside], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _tally(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    if n is None:
        key = np.sort(key)
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        return key[at], np.diff(np.concatenate([at, [len(key)]]))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def fit(key: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    """Modified Kneser-Ney from counts of 4-grams: sorted keys with log probabilities for orders 1 to 4, and log back-off weights of the contexts."""
    levels, model = {ORDER: _tally(key, count)}, {}
    for n in range(ORDER - 1, 0, -1):  # lower orders count the distinct continuations to the left
        levels[n] = _tally(levels[n + 1][0] % N_CLASSES**n)
    lower = np.full(1, 1.0 / N_CLASSES)
    for n in range(1, ORDER + 1):
        k, c = levels[n]
        n1, n2, n3, n4 = (max(1, int((c == x).sum())) for x in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = np.clip(np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]), 0.05, [0.05, 0.95, 1.95, 2.95])
        d[0] = 0
        context, at = np.unique(k // N_CLASSES, return_index=True)
        index = np.repeat(np.arange(len(context)), np.diff(np.concatenate([at, [len(k)]])))
        total = np.add.reduceat(c, at).astype(float)
        cut = d[np.minimum(c, 3)]
        back = np.add.reduceat(cut, at) / total
        below = lower[0] if n == 1 else lower[k % N_CLASSES ** (n - 1)]
        p = (c - cut) / total[index] + back[index] * below
        model |= {f"key{n}": k, f"logp{n}": np.log(p), f"context{n}": context, f"back{n}": np.log(back)}
        if n < ORDER:
            lower = np.exp(dense(model, n))
    return model


def dense(model: dict[str, np.ndarray], n: int, kind: type = np.float64) -> np.ndarray:
    """The log probability of every n-gram, seen or not."""
    table = np.full(1, -np.log(N_CLASSES), dtype=kind)
    for k in range(1, n + 1):
        back = np.zeros(N_CLASSES ** (k - 1), dtype=kind)
        back[model[f"context{k}"]] = model[f"back{k}"]
        if k > 1:  # a context's row is the row of the context without its first character, plus what backing off costs
            table = (back.reshape(N_CLASSES, -1, 1) + table.reshape(1, -1, N_CLASSES)).reshape(-1)
        else:
            table = np.full(N_CLASSES, back[0] + table[0], dtype=kind)
        table[model[f"key{k}"]] = model[f"logp{k}"]
    return table


def base_stats(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The contract's counts for each text."""
    words = _text.Words(texts)
    n = len(texts)
    n_words = np.diff(words.first)
    gram, doc = _text.shingles(words, words.hashes(), 5)
    repeated = np.zeros(len(words.start) + 5, dtype=np.int64)
    if len(gram):
        key = gram ^ _text.mix(doc.astype(np.uint64) + np.uint64(1))
        at = np.flatnonzero(words.doc[: len(words.doc) - 4] == words.doc[4:])  # the first word of each window
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(repeated, at[twice], 1)
        np.add.at(repeated, at[twice] + 5, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(repeated)[: len(words.start)] > 0)])
    starts = (words.buf & 0xC0) != 0x80  # a code point begins
    chars = np.concatenate([[0], np.cumsum(starts & ~_text.SPACE[words.buf])])
    dup = np.zeros(n, dtype=np.int64)
    for k, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup[k] = len(lines) - len(set(lines))
    return {
        "n_words": n_words,
        "word_chars": chars[words.offset[1:]] - chars[words.offset[:-1]],
        "n_symbols": np.array([len(t) - len(t.translate(None, b"#*$%&|<>")) for t in texts], dtype=np.int64),
        "n_dup_lines": dup,
        "n_repeat_words": covered[words.first[1:]] - covered[words.first[:-1]],
    }


def _language() -> Column:
    """The text's language, in a name that none other has: null is "", any else its name after a colon."""
    return F.coalesce(F.concat(F.lit(":"), F.col("lang")), F.lit(""))


class Scorer:
    """Scores texts under their language's model; holds TABLES expanded models at a time."""

    def __init__(self, models: dict[str, dict[str, np.ndarray]]) -> None:
        self.models, self.tables = models, dict[str, np.ndarray]()

    def _table(self, lang: str) -> np.ndarray:
        if lang not in self.tables:
            if len(self.tables) >= TABLES:
                del self.tables[next(iter(self.tables))]
            self.tables[lang] = dense(self.models[lang], ORDER, np.float32)
        return self.tables[lang]

    def log_perplexities(self, texts: list[bytes], lang: list[str]) -> np.ndarray:
        out, langs = np.full(len(texts), np.nan), np.array(lang, dtype=object)
        for g in dict.fromkeys(lang):
            if g not in self.models:
                continue
            own = np.flatnonzero(langs == g)
            key, first = ngrams([texts[k] for k in own])
            sums = np.concatenate([[0.0], np.cumsum(self._table(g)[key], dtype=np.float64)])
            n = np.diff(first)
            out[own] = np.where(n > 0, -(sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1), np.nan)
        return out


def _deviations(logppl: np.ndarray, sizes: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Distances from the centre, smaller for short texts."""
    return np.abs(logppl - centre) / np.sqrt(np.maximum(1.0, FULL_LENGTH / np.maximum(sizes, 1)))


def _counter(held):
    """Counts of 4-grams. held: None, or models and limits (centre and spread by language) that a text must lie within."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, limits = (Scorer(held.value[0]), held.value[1]) if held else (None, {})
        tally: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch, texts in _text.chunks(batches):
            lang = batch.column("lg").to_pylist()
            good = np.ones(len(texts), dtype=bool)
            if scorer:
                middle, spread = np.array([limits.get(g, (np.nan, np.nan)) for g in lang]).T
                good = _deviations(scorer.log_perplexities(texts, lang), np.array([len(t) for t in texts]), middle) <= TRIM * spread
            for g in {x for x, y in zip(lang, good, strict=True) if y}:
                key, count = _tally(ngrams([t for t, x, y in zip(texts, lang, good, strict=True) if y and x == g])[0])
                if g in tally:
                    key, count = _tally(np.concatenate([tally[g][0], key]), np.concatenate([tally[g][1], count]))
                tally[g] = key, count
            if len(tally) > TABLES:  # so that many languages don't fill the worker
                yield from _counts(tally)
                tally = {}
        yield from _counts(tally)
        del scorer, tally
        _text.release()  # the tables' memory too

    return run


def _counts(tally: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for g, (key, count) in tally.items():
        yield pa.record_batch({"lg": pa.array([g] * len(key), pa.string()), "gram": pa.array(key, pa.int64()), "n": pa.array(count, pa.int64())})


def count_ngrams(docs: DataFrame, held=None) -> DataFrame:
    """lg, gram, n: how often each language's texts, or those within limits, hold each 4-gram."""
    partial = docs.select(_language().alias("lg"), "text").mapInArrow(_counter(held), "lg string, gram long, n long")
    return partial.groupBy("lg", "gram").agg(F.sum("n").alias("n"))


_ARRAYS = [f"{k}{n}" for n in range(1, ORDER + 1) for k in ("key", "logp", "context", "back")]


def train(counts: DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """The models, estimated a language at a time on the executors; what comes to the driver has the module's bound."""

    def one(table: pa.Table) -> pa.Table:
        model = fit(table.column("gram").to_numpy(), table.column("n").to_numpy())
        packed = {k: [model[k].astype(np.float32 if k[:4] in ("logp", "back") else np.uint32).tobytes()] for k in _ARRAYS}
        del model
        _text.release()
        return pa.table({"lg": table.column("lg").slice(0, 1).cast(pa.string()), **{k: pa.array(v, pa.binary()) for k, v in packed.items()}})

    schema = "lg string, " + ", ".join(f"{k} binary" for k in _ARRAYS)
    rows = counts.groupBy("lg").applyInArrow(one, schema).collect()
    return {r["lg"]: {k: np.frombuffer(r[k], dtype=np.float32 if k[:4] in ("logp", "back") else np.uint32) for k in _ARRAYS} for r in rows}


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _described(held, counts: bool):
    """A function that tells doc_id, lg, counts of the base rule (if asked for), n_bytes and log perplexity of texts."""
    scorer = Scorer(held.value)

    def tell(batch: pa.RecordBatch, texts: list[bytes]) -> dict[str, pa.Array]:
        size = pa.array([len(t) for t in texts], pa.int64())
        logppl = pa.array(scorer.log_perplexities(texts, batch.column("lg").to_pylist()), from_pandas=True)
        stats = {k: pa.array(v, pa.int64()) for k, v in base_stats(texts).items()} if counts else {}
        return {"doc_id": batch.column("doc_id"), "lg": batch.column("lg"), **{k: stats[k] for k in _STATS if counts}, "n_bytes": size, "logppl": logppl}

    return tell


def _scored(held, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell = _described(held, counts)
        for batch, texts in _text.chunks(batches):
            yield pa.record_batch(tell(batch, texts))
        del tell
        _text.release()  # the tables' memory too

    return run


def score(docs: DataFrame, models: dict, counts: bool = True) -> DataFrame:
    """doc_id, lg, counts of the base rule (if asked for), n_bytes and log perplexity of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(models)
    ddl = "doc_id long, lg string, " + "".join(f"{k} long, " for k in _STATS if counts) + "n_bytes long, logppl double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _language().alias("lg"), "text").mapInArrow(_scored(held, counts), ddl)


def failed() -> Column:
    """The base rule."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _quantile(tally: dict[int, int], share: float) -> float:
    """The value below which a share of the tallied steps lies."""
    bins = np.array(sorted(tally))
    upto = np.cumsum([tally[b] for b in bins.tolist()])
    return float((bins[np.searchsorted(upto, share * upto[-1])] + 0.5) * STEP)


def _by_language(scored: DataFrame, name: str, value: Column) -> dict[str, dict[int, int]]:
    """How often each step of the value occurs in each language, where the named score isn't null: at most a few thousand steps each."""
    rows = scored.where(F.col(name).isNotNull()).groupBy("lg", F.floor(value / STEP).alias("bin")).agg(F.count("*").alias("n")).collect()
    out: dict[str, dict[int, int]] = {}
    for r in rows:
        out.setdefault(r["lg"], {})[r["bin"]] = r["n"]
    return out


def _nearness() -> Column:
    return F.sqrt(F.greatest(F.lit(1.0), F.lit(FULL_LENGTH) / F.greatest(F.col("n_bytes"), F.lit(1))))


def bands(scored: DataFrame, name: str = "logppl", side: int = 0) -> dict[str, tuple[float, float]]:
    """Centre and spread of each language's log perplexities, or of another score. side: 1 or -1 for the spread above or below the centre."""
    centre = {g: _quantile(t, 0.5) for g, t in _by_language(scored, name, F.col(name)).items()}
    known = F.broadcast(scored.sparkSession.createDataFrame(sorted(centre.items()), "lg string, centre double"))
    asked = scored.join(known, "lg").where(F.lit(side) * (F.col(name) - F.col("centre")) >= 0)
    away = _by_language(asked, name, F.abs(F.col(name) - F.col("centre")) / _nearness())
    return {g: (c, max(LEAST_SPREAD, _quantile(away.get(g, {0: 1}), SHARE) / WITHIN)) for g, c in centre.items()}


def models_of(docs: DataFrame) -> tuple[dict[str, dict[str, np.ndarray]], dict[str, int]]:
    """Each language's model, estimated from all its texts and then again from those near the middle; and the bytes of its texts."""
    with _io.short_lived_shuffles(docs.sparkSession):
        first = train(count_ngrams(docs))
    scored, path = _io.stored(score(docs, first, counts=False), "perplexities")
    limits = bands(scored)
    sizes = {r["lg"]: r["n"] for r in scored.groupBy("lg").agg(F.sum("n_bytes").alias("n")).collect()}
    _io.drop(docs.sparkSession, path)
    with _io.short_lived_shuffles(docs.sparkSession):
        return first | train(count_ngrams(docs, docs.sparkSession.sparkContext.broadcast((first, limits)))), sizes


#: The side on which a score tells of junk, or 0 for both, and the width of its band: copies of a text have words and an order that are known, which is no fault of theirs.
_SCORES = {"logppl": (0, WIDTH), "word_logppl": (1, WORD_WIDTH), "gain": (-1, ORDER_WIDTH)}


def judged(docs: DataFrame) -> DataFrame:
    """One row for each document: the counts, base_failed, perplexity, its language's lower and upper limits, and kept; then the perplexity of its words and what their order gains."""
    spark = docs.sparkSession
    models, sizes = models_of(docs)
    held = spark.sparkContext.broadcast(models)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _language().alias("lg"), "text")
    ddl = "doc_id long, lg string, " + "".join(f"{k} long, " for k in _STATS) + "n_bytes long, logppl double"
    scored, _ = word_pairs.scored(texts, sizes, lambda: _described(held, True), ["doc_id", "lg", *_STATS, "n_bytes", "logppl"], ddl)
    good = scored.where(~failed())
    inside = F.lit(True)
    for name, (side, most) in _SCORES.items():
        rows = [(g, *x) for g, x in sorted(bands(good, name, side).items())]  # a row a language
        limits = spark.createDataFrame(rows, f"lg string, {name}_centre double, {name}_spread double")
        scored = scored.join(F.broadcast(limits), "lg", "left")
        # no band: no text of the language passes the base rule
        away = F.col(name) - F.col(f"{name}_centre")
        away = F.lit(side) * away if side else F.abs(away)
        inside &= F.coalesce(away <= most * F.col(f"{name}_spread") * _nearness(), F.lit(True))
    centre, width = F.col("logppl_centre"), WIDTH * F.col("logppl_spread") * _nearness()
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed().alias("base_failed"), F.exp("logppl").alias("perplexity"),
        F.exp(centre - width).alias("low_limit"), F.exp(centre + width).alias("high_limit"), (~failed() & inside).alias("kept"),
        F.exp("word_logppl").alias("word_perplexity"), F.col("gain").alias("order_gain"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. Rows that share a doc_id stay if each of them passes."""
    verdict = judged(docs).groupBy(F.col("doc_id").alias("judged_id")).agg(F.min("kept").alias("good")).where("good").select("judged_id")
    return docs.join(verdict, docs["doc_id"].eqNullSafe(verdict["judged_id"]), "left_semi")
