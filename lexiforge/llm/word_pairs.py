"""Perplexity of whole words and of their order.

Each language counts all its words and pairs of neighbouring words, none left out and none put in a class; the counts grow with the
corpus, so they aren't shipped to the tasks. A task sends the distinct words and pairs of some MB of text, with their counts there, to groups
that each sum a range of their hashes; the groups answer with the sums over all other tasks' texts, which are joined with the texts again. Each text
is then scored by the counts of all other texts, its own taken off: a word's probability is (its count + 1) / (all words + distinct
words + 1), that after another one (the pair's count + PRIOR * the word's probability) / (the first word's count + PRIOR), a Dirichlet
prior. The gain is how much likelier the words are in their order than each alone, in logarithms a pair.

Words and pairs are told apart by 39 bits of their hashes; what a group holds has a bound whatever the corpus holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _io, _text

#: Bytes of text whose keys are sent together, and whose words and pairs one group sums; keys that a group sums at once.
CHUNK, SHARD, PART = 16_000_000, 32_000_000, 2_000_000
#: Weight of a word's own probability, in occurrences of the word before.
PRIOR = 100.0
_BITS = 40
#: Low bits of a sorted number that hold a count; keys are above them.
_LOW = np.uint64(64 - _BITS)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words (even) and of the pairs (odd); each word's text; and which words end a pair."""
    words = _text.Words(texts)
    h = words.hashes()
    second = np.flatnonzero(words.doc[1:] == words.doc[:-1]) + 1
    one = np.uint64(1)
    pair = _text.mix(h[second - 1] * np.uint64(0xD6E8FEB86659FD93) + h[second]) >> np.uint64(64 - _BITS) | one
    return h >> np.uint64(64 - _BITS) & ~one, pair, words.doc, second


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, pa.RecordBatch, list[bytes]]]:
    """Rows of one language with about CHUNK bytes of text at most, and a name for them that depends on the rows only."""
    held: dict[str, list[tuple[pa.RecordBatch, list[bytes]]]] = {}
    size = 0
    for batch, texts in _text.chunks(batches):
        langs = np.array(batch.column("lg").to_pylist(), dtype=object)
        for lg in dict.fromkeys(langs):
            at = np.flatnonzero(langs == lg)
            held.setdefault(lg, []).append((batch.take(pa.array(at)), [texts[k] for k in at.tolist()]))
        size += sum(map(len, texts))
        if size >= CHUNK:
            yield from _named(held)
            held, size = {}, 0
    yield from _named(held)


def _named(held: dict[str, list]) -> Iterator[tuple[int, str, pa.RecordBatch, list[bytes]]]:
    for lg, parts in held.items():
        rows = pa.Table.from_batches([b for b, _ in parts]).combine_chunks().to_batches()[0]
        texts = [t for _, x in parts for t in x]
        name = hashlib.blake2b(repr((lg, rows.column("doc_id").to_pylist(), [len(t) for t in texts])).encode(), digest_size=8)
        for t in texts:
            name.update(t)
        yield int.from_bytes(name.digest(), "little", signed=True), lg, rows, texts


def _packed(x: np.ndarray, n: int) -> bytes:
    """The n low bytes of each value, all lowest ones first, which pack well if the values are small; after their number."""
    low = np.ascontiguousarray(x, dtype=np.uint64).view(np.uint8).reshape(-1, 8)[:, :n].T.tobytes()
    return len(x).to_bytes(8, "little") + pa.Codec("zstd").compress(low, asbytes=True)


def _unpacked(x: bytes, n: int) -> np.ndarray:
    size = int.from_bytes(x[:8], "little")
    low = np.frombuffer(pa.Codec("zstd").decompress(x[8:], n * size, asbytes=True), dtype=np.uint8).reshape(n, -1)
    wide = np.zeros((size, 8), dtype=np.uint8)
    wide[:, :n] = low.T
    return wide.view(np.uint64).reshape(-1)


def _steps(key: np.ndarray) -> np.ndarray:
    """Sorted keys as what each adds to the one before."""
    return np.diff(key, prepend=np.uint64(0))


def _pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in runs of about _text.CHUNK bytes, at least a text each."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > _text.CHUNK:
            yield texts[at:k]
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield texts[at:]


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of some keys in order, and the sums of their counts; key and count are sorted as one number."""
    key, count = np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.uint32)])
    large = np.flatnonzero(count >> np.uint32(_LOW))
    high, of = count[large].astype(np.uint64) >> _LOW << _LOW, key[large]
    mask = (np.uint64(1) << _LOW) - np.uint64(1)
    key <<= _LOW
    key |= count & mask
    key.sort()
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] >> _LOW != key[:-1] >> _LOW
    at = np.flatnonzero(first)
    found = key[at] >> _LOW
    key &= mask
    total = np.add.reduceat(key, at) if len(at) else key
    np.add.at(total, np.searchsorted(found, of), high)
    return found, total


def _distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of the texts in order, and how often each occurs."""
    keys, counts = [], []
    for piece in _pieces(texts):
        key, count = np.unique(np.concatenate(grams(piece)[:2]), return_counts=True)
        keys.append(key)
        counts.append(count.astype(np.uint32))
    return _sums(keys, counts)


def _ask(shards: dict[str, int]):
    """The distinct keys of each chunk with their counts, by ranges of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, lg, _, texts in chunks(batches):
            key, count = _distinct(texts)
            n = shards[lg]
            to = np.searchsorted(key * np.uint64(n) >> np.uint64(_BITS), np.arange(n + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(to))
            spans = [(int(to[s]), int(to[s + 1])) for s in some]
            yield pa.record_batch({
                "lg": pa.array([lg] * len(some), pa.string()), "shard": pa.array(some, pa.int32()), "chunk": pa.array([chunk] * len(some), pa.int64()),
                "keys": pa.array([_packed(_steps(key[a:b]), _BITS // 8) for a, b in spans], pa.binary()), "counts": pa.array([_packed(count[a:b], 4) for a, b in spans], pa.binary()),
            })
        _text.release()

    return run


def _answer(table: pa.Table) -> pa.Table:
    """How often the keys occur in other chunks, in the order of each chunk's keys; in one row the group's distinct words and all their occurrences."""
    keys = [np.cumsum(_unpacked(x.as_py(), _BITS // 8)) for x in table.column("keys")]
    counts = [_unpacked(x.as_py(), 4).astype(np.uint32) for x in table.column("counts")]
    low, high = min(int(k[0]) for k in keys), max(int(k[-1]) for k in keys)
    n = 1 + sum(map(len, keys)) // PART
    done, n_distinct, n_words = [0] * len(keys), 0, 0
    for edge in range(1, n + 1):  # ranges of the keys, one after another; each key's place then holds what is told of it
        end = np.uint64(low + (high + 1 - low) * edge // n)
        spans = [slice(at, at + int(np.searchsorted(k[at:], end))) for k, at in zip(keys, done, strict=True)]
        key, total = _sums([k[x] for k, x in zip(keys, spans, strict=True)], [c[x] for c, x in zip(counts, spans, strict=True)])
        words = key & np.uint64(1) == 0
        n_distinct, n_words = n_distinct + int(words.sum()), n_words + int(total[words].sum())
        for k, c, x in zip(keys, counts, spans, strict=True):
            k[x] = total[np.searchsorted(key, k[x])] - c[x]
        done = [x.stop for x in spans]
    others = pa.array([_packed(x, 5) for x in keys], pa.binary())
    of = [[n_distinct, n_words]] + [[0, 0]] * (len(keys) - 1)
    out = pa.table({"lg": table.column("lg"), "shard": table.column("shard"), "chunk": table.column("chunk"), "others": others, "n_distinct": pa.array([x for x, _ in of], pa.int64()), "n_words": pa.array([x for _, x in of], pa.int64())})
    del keys, counts, key, total, words, k, c
    _text.release()
    return out


def _send(describe: Callable[[], Callable[[pa.RecordBatch, list[bytes]], dict[str, pa.Array]]]):
    """Each chunk's texts beside what describe() tells of them, as one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = describe()
        for chunk, lg, rows, _ in chunks(batches):
            sink, out = pa.BufferOutputStream(), None
            for part, own in _text.chunks([rows]):
                batch = pa.record_batch({**told(part, own), "text": pa.array(own, pa.large_binary())})
                out = out or pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3)))
                out.write_batch(batch)
            out.close()
            yield pa.record_batch({"chunk": pa.array([chunk], pa.int64()), "lg": pa.array([lg], pa.string()), "body": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
        del told
        _text.release()

    return run


def _own(doc: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """How often each one's own text holds it."""
    _, at, count = np.unique(doc * n + which, return_inverse=True, return_counts=True)
    return count[at]


def scores(texts: list[bytes], key: np.ndarray, total: np.ndarray, n_distinct: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Log perplexity a word and gain a pair of each text (nan without words or pairs). total: counts in all texts of the keys, which are in order."""
    word, pair, doc, second = grams(texts)
    single, double = np.searchsorted(key, word), np.searchsorted(key, pair)
    size = np.bincount(doc, minlength=len(texts))
    count = total[single].astype(np.int64) - _own(doc, single, len(key))
    p = (count + 1) / (n_words - size[doc] + n_distinct + 1)
    both = total[double].astype(np.int64) - _own(doc[second], double, len(key))
    alone, after = np.log(p), np.log((both + PRIOR * p[second]) / (count[second - 1] + PRIOR))
    gain = np.bincount(doc[second], weights=after - alone[second], minlength=len(texts))
    every = np.bincount(doc, weights=alone, minlength=len(texts)) + gain
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(size > 0, -every / size, np.nan), np.where(size > 1, gain / (size - 1), np.nan)


def _score(known: dict[str, tuple[int, int]], names: list[str]):
    def run(sent: pa.Table, answers: pa.Table) -> pa.Table:
        told_of = dict(sorted(zip(answers.column("shard").to_pylist(), answers.column("others").to_pylist(), strict=True)))
        others = np.concatenate([_unpacked(x, 5) for x in told_of.values()]) if told_of else None
        out = []
        for lg, body in zip(sent.column("lg").to_pylist(), sent.column("body").to_pylist(), strict=True):
            rows = pa.ipc.open_stream(body).read_all()
            texts = [x or b"" for x in rows.column("text").to_pylist()]
            met = others is not None or not any(t.strip() for t in texts)
            of = [np.full(len(texts), np.nan)] * 2
            if met:
                key, count = _distinct(texts)
                if len(key) != (0 if others is None else len(others)):
                    raise ValueError("not the counts of these texts")
                total = count if others is None else count + others
                of = [np.concatenate(x) for x in zip(*(scores(piece, key, total, *known.get(lg, (0, 0))) for piece in _pieces(texts)), strict=True)]
                del key, count, total
            told = {"word_logppl": pa.array(of[0], from_pandas=True), "gain": pa.array(of[1], from_pandas=True), "met": pa.array([met] * len(texts))}
            out.append(pa.table({**{k: rows.column(k) for k in names}, **told}))
            del rows, texts, told
        _text.release()
        return pa.concat_tables(out) if out else pa.table({**{k: pa.nulls(0) for k in names}, "word_logppl": pa.nulls(0), "gain": pa.nulls(0), "met": pa.nulls(0)})

    return run


def scored(docs: DataFrame, sizes: dict[str, int], describe, names: list[str], ddl: str) -> tuple[DataFrame, str]:
    """What describe() tells of each row of docs (doc_id, lg, text), by names and their types, with word_logppl and gain; stored. sizes: bytes of text of each language."""
    spark = docs.sparkSession
    shards = {lg: 1 + n // SHARD for lg, n in sizes.items()}
    for _ in range(2):
        asked = docs.mapInArrow(_ask(shards), "lg string, shard int, chunk long, keys binary, counts binary")
        answers = asked.groupBy("lg", "shard").applyInArrow(_answer, "lg string, shard int, chunk long, others binary, n_distinct long, n_words long")
        with _io.short_lived_shuffles(spark):
            answers, path = _io.stored(answers, "word-counts")
        rows = answers.groupBy("lg").agg(F.sum("n_distinct").alias("d"), F.sum("n_words").alias("n")).collect()  # a row a language
        sent = docs.mapInArrow(_send(describe), "chunk long, lg string, body binary")
        met = sent.groupBy("chunk").cogroup(answers.select("chunk", "shard", "others").groupBy("chunk"))
        met = met.applyInArrow(_score({r["lg"]: (r["d"], r["n"]) for r in rows}, names), f"{ddl}, word_logppl double, gain double, met boolean")
        with _io.short_lived_shuffles(spark):
            out, out_path = _io.stored(met, "quality")
        _io.drop(spark, path)
        if out.where(~F.col("met")).isEmpty():
            return out.drop("met"), out_path
        _io.drop(spark, out_path)
        docs, _ = _io.stored(docs, "quality-texts")  # they came in another order when they were read again
    raise ValueError("stored texts came in another order when they were read again")
