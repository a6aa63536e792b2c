"""Language ID by prediction by partial matching.

For each language a tree of byte contexts up to ORDER bytes deep is counted on a sample of labelled texts and
then frozen. A byte's code length is that of method C without exclusions: in its longest known context it costs
-ln(n / (total + distinct)) if it followed there, else the context's escape -ln(distinct / (total +
distinct)) and the code length in the next shorter context; below the empty context bytes are equally likely. The code
lengths of all languages are resolved when the model is built and kept side by side, so scoring is a lookup
of the context with its byte, and of shorter ones only where no language knows it. The language with the shortest
code for the whole text wins; the score is its posterior under equal priors.

The sample is bounded: the first SAMPLE_CHARS code points of at most SAMPLE_DOCS texts a language, chosen by a hash of doc_id.
Every language with a labelled text is learnt; languages are held in blocks of BLOCK, which are fitted one after the
other. Every whole text is scored under all of them.

Defined cases: a null text, and one without a letter, is `und` with score 0. Ties go to the smaller name. Texts without
lang are predicted but not learnt from. With nothing to learn from all texts are `und`. Rows that share a doc_id
are judged each for itself. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _io, _text

ORDER = 4
SAMPLE_DOCS, SAMPLE_CHARS = 400, 8192
#: Languages whose code lengths lie side by side.
BLOCK = 64
#: Bytes scored at once.
_PART = 1_000_000
_UNIFORM = np.log(256.0)


def grams(buf: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each byte of buf from the n-th on, as one number."""
    out = np.zeros(max(0, len(buf) - n + 1), dtype=np.uint64)
    for k in range(n):
        out = out << np.uint64(8) | buf[k : k + len(out)]
    return out


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each after ORDER line breaks, as one array of bytes; and where each text begins."""
    pad = b"\n" * ORDER
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return np.frombuffer(pad + pad.join([*texts, b""]), dtype=np.uint8), np.cumsum(sizes + ORDER) - sizes


def _own(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with their paddings, and the places of bytes that belong to a text."""
    buf, first = padded(texts)
    inside = np.zeros(len(buf), dtype=bool)
    for a, t in zip(first, texts, strict=True):
        inside[a : a + len(t)] = True
    return buf, np.flatnonzero(inside)


class Tables:
    """Resolved code lengths. For n from 1 to ORDER + 1: key[n], the sorted contexts with their byte that any language knows, and cost[n], a row of code lengths (one for each language). For n up to ORDER: context[n] and escape[n]."""

    def __init__(self, samples: dict[str, list[bytes]]) -> None:
        self.languages = sorted(samples)
        k = len(self.languages)
        counts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n in range(1, ORDER + 2):
            counts[n] = []
            for g in self.languages:
                buf, at = _own(samples[g])
                counts[n].append(np.unique(grams(buf, n)[at - n + 1], return_counts=True))
        self.key: dict[int, np.ndarray] = {}
        self.cost: dict[int, np.ndarray] = {}
        self.context: dict[int, np.ndarray] = {}
        self.escape: dict[int, np.ndarray] = {}
        for n in range(1, ORDER + 2):
            self.context[n - 1] = np.unique(np.concatenate([x >> np.uint64(8) for x, _ in counts[n]]))
            self.key[n] = np.unique(np.concatenate([x for x, _ in counts[n]]))
            self.escape[n - 1] = np.zeros((len(self.context[n - 1]), k))
            holds = np.searchsorted(self.context[n - 1], self.key[n] >> np.uint64(8))
            below = np.full((len(self.key[n]), k), _UNIFORM) if n == 1 else self.cost[n - 1][np.searchsorted(self.key[n - 1], self.key[n] & np.uint64((1 << 8 * (n - 1)) - 1))]
            cost = np.empty((len(self.key[n]), k))
            for j, (x, c) in enumerate(counts[n]):
                if not len(x):
                    cost[:, j] = below[:, j]
                    continue
                own, at = np.unique(x >> np.uint64(8), return_index=True)
                total, distinct = np.add.reduceat(c, at), np.diff(np.concatenate([at, [len(x)]]))
                self.escape[n - 1][np.searchsorted(self.context[n - 1], own), j] = -np.log(distinct / (total + distinct))
                cost[:, j] = self.escape[n - 1][holds, j] + below[:, j]
                cost[np.searchsorted(self.key[n], x), j] = -np.log(c / np.repeat(total + distinct, distinct))
            self.cost[n] = cost

    def slots(self) -> None:
        """Hash slots for the longest contexts: a lookup takes about one step. Made on each executor."""
        key = self.key[ORDER + 1]
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(key)) * 4))))
        self.slot_key = np.full((1 << self.bits) + 64, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.slot_row = np.full(len(self.slot_key), len(key), dtype=np.int32)
        home = self._home(key)
        todo, step = np.arange(len(key)), 0
        while len(todo):
            place = home[todo] + step
            if step == 64:  # the few that find no slot are looked for among the rare ones, which gives the same code lengths
                break
            free = self.slot_row[place] == len(key)
            self.slot_row[place[free]] = todo[free]  # of several for one slot the last stays
            won = self.slot_row[place] == todo
            self.slot_key[place[won]] = key[todo[won]]
            todo, step = todo[~won], step + 1
        self.steps = step
        self.rows = np.vstack([self.cost[ORDER + 1], np.zeros(len(self.languages))]).astype(np.float32)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The row of each key, or the number of rows."""
        place = self._home(key)
        found = np.where(self.slot_key[place] == key, self.slot_row[place], -1)
        todo = np.flatnonzero(found < 0)
        for step in range(1, self.steps):
            at = place[todo] + step
            hit = self.slot_key[at] == key[todo]
            found[todo[hit]] = self.slot_row[at[hit]]
            todo = todo[~hit]
        found[todo] = len(self.key[ORDER + 1])
        return found

    def rare(self, key: np.ndarray) -> np.ndarray:
        """Code lengths of contexts with their byte that no language knows in full, by ever shorter contexts."""
        out, todo = np.zeros((len(key), len(self.languages))), np.arange(len(key))
        for n in range(ORDER + 1, 0, -1):
            k = key[todo] & np.uint64((1 << 8 * n) - 1)
            at = np.minimum(np.searchsorted(self.key[n], k), len(self.key[n]) - 1)
            hit = self.key[n][at] == k
            out[todo[hit]] += self.cost[n][at[hit]]
            todo, k = todo[~hit], k[~hit] >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.context[n - 1], k), len(self.context[n - 1]) - 1)
            known = self.context[n - 1][at] == k
            out[todo[known]] += self.escape[n - 1][at[known]]
        out[todo] += _UNIFORM
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """For each text a row with its code length in each language."""
        buf, first = padded(texts)
        out = np.zeros((len(texts), len(self.languages)))
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        stop = first + sizes
        for a in range(ORDER, len(buf), _PART):
            b = min(a + _PART, len(buf))
            key = grams(buf[a - ORDER : b], ORDER + 1)
            row = self.find(key)
            cost = self.rows[row].astype(np.float64)
            miss = np.flatnonzero(row == len(self.rows) - 1)
            if len(miss):
                cost[miss] = self.rare(key[miss])
            total = np.vstack([np.zeros(len(self.languages)), np.cumsum(cost, axis=0)])
            own = np.flatnonzero((first < b) & (stop > a))
            out[own] += total[np.minimum(stop[own], b) - a] - total[np.maximum(first[own], a) - a]
        return out


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> list[Tables]:
    """Learns from the rows with a lang that aren't held out, a block of languages after the other. What comes to the driver at once is bounded by the module's parameters."""
    good = docs.where(F.col("lang").isNotNull() & ~held_out() & F.col("doc_id").isNotNull() & (F.octet_length("text") > 0)).select("doc_id", "lang")
    # Spark limits each task to the first SAMPLE_DOCS of a language before it shuffles
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = good.withColumn("at", rank).where(F.col("at") <= SAMPLE_DOCS).select("doc_id", "lang").distinct()
    chosen, _ = _io.stored(docs.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("doc_id", "lang", F.left("text", F.lit(SAMPLE_CHARS)).alias("text")).where("octet_length(text) > 0"), "language-sample")
    known = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())  # a row a language
    out = []
    for k in range(0, len(known), BLOCK):
        samples: dict[str, list[bytes]] = {}
        for r in sorted(chosen.where(F.col("lang").isin(known[k : k + BLOCK])).collect(), key=lambda r: (r["lang"], r["doc_id"], r["text"])):
            samples.setdefault(r["lang"], []).append(r["text"].encode())
        out.append(Tables(samples))
    return out


def has_letter(text: bytes) -> bool:
    return any(65 <= c <= 90 or 97 <= c <= 122 for c in text[:64]) or any(c.isalpha() for c in text.decode())


def _judge(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = held.value
        languages = [g for t in blocks for g in t.languages]
        for t in blocks:
            t.slots()
        for batch, texts in _text.chunks(batches):
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            if blocks:
                lengths = np.hstack([t.code_lengths(texts) for t in blocks])
                best = lengths.argmin(axis=1)
                odds = np.exp(-(lengths - lengths.min(axis=1, keepdims=True))).sum(axis=1)
                for k, t in enumerate(texts):
                    if t and has_letter(t):
                        pred[k], score[k] = languages[best[k]], 1 / odds[k]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)})

    return run


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held = docs.sparkSession.sparkContext.broadcast(train(docs))
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(_judge(held), "doc_id long, held_out boolean, lang_pred string, score double")
