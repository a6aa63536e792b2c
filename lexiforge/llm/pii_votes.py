"""Personal data by weak supervision, in DataFrame operations only.

Base spans come from fixed patterns and checks. Beside them, a wider pattern proposes candidates that the base
rules pass over: numbers that the base patterns swallow together with their neighbours, spelt-out addresses, and
secrets. Five labelers vote on each candidate: shape, checksum, gazetteer, context and boundary. From the tally of vote
patterns expectation-maximisation estimates how reliable each labeler is for each kind; its posteriors then train a
logistic span classifier on votes and length, which decides. The tally has at most 3 ** 5 vote patterns and LENGTHS
length classes a kind, so what comes to the driver is bounded whatever the corpus holds; the trained classifier goes
back as a column expression.

Places are counted in code points. They are found from the texts between matches: a match begins where all texts and
matches before it end.

Defined cases: a null text is empty. A candidate that overlaps a base span is dropped. Rows that share a doc_id are
judged each for itself. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _io

KINDS = ("email", "ip", "card", "phone", "secret")
#: The contract's patterns. Runs are possessive, and a match begins at its run's start or where the one before ended: what matches is the same, in linear time and without recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_SECRET = r"(?<![A-Za-z])(?:password|passwd|token|secret|api_?key)[ \t]{0,3}[=:][ \t]{0,3}\"?[A-Za-z0-9_-]{8,}+\"?|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
_PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3} ?)?\([0-9]{2,4}\) ?[0-9]{3,4}-[0-9]{3,4}(?![0-9])"
_CARD = r"(?<![0-9A-Za-z])[0-9]{12,19}(?![0-9A-Za-z])"
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63} ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z]{2,24}"
CANDIDATE = f"{_SECRET}|{_PHONE}|{_CARD}|{_EMAIL}"
#: Gazetteers: domain ends, beginnings of card numbers, calling codes, key prefixes.
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "io")
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")
CALLING_CODES = ("+1", "+33", "+34", "+44", "+49")
#: Words before a span that speak for its kind.
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "anruf", "appel"),
    "secret": ("login", "user", "key", "credential"),
}
LABELERS = ("shape", "checksum", "gazetteer", "context", "boundary")
#: Length classes of the classifier: up to 12, 16, 24, 40 code points, or longer.
LENGTHS = (12, 16, 24, 40)
#: Weight, in candidates, of the prior belief in a labeler, and its chances to vote against, not at all, and for what is true.
BELIEF, _AGREES = 20, {-1: 0.05, 0: 0.35, 1: 0.6}
_BLOCK = 256


def _located(df: DataFrame, name: str, pattern: str, needs: str | None) -> DataFrame:
    """Adds column name: an array of (start, end, text, before, after) of the pattern's matches in column text."""
    some = F.col("text").contains(needs) if needs else F.lit(True)
    found = F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("m", F.coalesce(found, F.array().cast("array<string>")))
    df = df.withColumn("s", F.when(F.size("m") > 0, F.split("text", pattern, -1)))
    df = df.withColumn("w", F.transform("m", lambda m, i: F.length(F.col("s")[i]) + F.length(m)))
    numbers = F.when(F.size("m") > 0, F.sequence(F.lit(0), F.floor((F.size("m") - 1) / _BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    df = df.withColumn("b", F.transform(numbers, lambda k: add(F.slice("w", k * _BLOCK + 1, F.lit(_BLOCK)))))
    df = df.withColumn("b", F.transform("b", lambda _, k: F.when(k > 0, add(F.slice("b", F.lit(1), k))).otherwise(0)))
    block, rest = lambda i: F.floor(i / _BLOCK).cast("int"), lambda i: F.pmod(i, F.lit(_BLOCK))
    start = lambda i: F.col("b")[block(i)] + add(F.slice("w", block(i) * _BLOCK + 1, rest(i))) + F.length(F.col("s")[i])
    span = lambda m, i: F.struct(start(i).alias("start"), m.alias("text"), F.right(F.col("s")[i], F.lit(24)).alias("before"), F.left(F.col("s")[i + 1], F.lit(1)).alias("after"))
    return df.withColumn(name, F.transform("m", span)).drop("m", "s", "w", "b")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _small(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


_HOLDS = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x, r"\."), _small),
    "card": lambda x: F.length(_digits(x)).between(12, 19) & _luhn(_digits(x)),
    "phone": lambda x: F.length(_digits(x)).between(9, 15),
}


def _holds(kind: str):
    return lambda x: _HOLDS[kind](x["text"])


def _as_span(at: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(at).alias("at"), (x["start"] + F.length(x["text"])).alias("end"))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, mark, base (array of start, at, end), n_email, n_ip, n_card, n_phone, and candidates that overlap no base span."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    for k, kind in enumerate(KINDS[:4]):
        df = _located(df, "found", BASE[kind], _NEEDS.get(kind))
        good = F.filter("found", _holds(kind))
        df = df.withColumn(kind, F.transform(good, _as_span(k))).drop("found")
    df = _located(df, "candidates", CANDIDATE, None).drop("text")
    df = df.withColumn("base", F.array_sort(F.concat(*KINDS[:4])))
    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["start"] + F.length(c["text"])) & (c["start"] < b["end"]))
    return df.select("doc_id", "mark", "base", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]), F.filter("candidates", free).alias("candidates"))


def voted(candidates: DataFrame) -> DataFrame:
    """Candidates (start, text, before, after) with their kind, length class and a vote (-1, 0 or 1) of each labeler.

    A labeler abstains on what the candidate pattern asks for anyway.
    """
    text, before, after = F.col("text"), F.lower("before"), F.col("after")
    kind = F.when(text.rlike("^[0-9]+$"), "card").when(text.rlike(r"[\[(]at[\])]"), "email").when(text.rlike("^[+(]"), "phone").otherwise("secret")
    df = candidates.withColumn("kind", kind)
    digits = _digits(text)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    by_kind = lambda **x: F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in x.items()), F.lit(0))
    mixed = text.rlike("[0-9]") & text.rlike("[A-Za-z]")
    starts = lambda words: F.lit(False) if not words else F.coalesce(*(F.when(text.startswith(w), True) for w in words), F.lit(False))
    speaks = lambda words: F.coalesce(*(F.when(before.contains(w), True) for w in words), F.lit(False))
    votes = {
        "shape": by_kind(card=vote(F.lit(False), ~F.length(digits).isin(15, 16)), phone=vote(text.startswith("+"), F.lit(False)), email=vote(~text.contains("  "), F.lit(False)), secret=vote(mixed, ~mixed)),
        "checksum": by_kind(card=vote(_luhn(digits), ~_luhn(digits)), phone=vote(F.length(digits).between(9, 15), ~F.length(digits).between(9, 15)), secret=vote(F.length(F.regexp_replace(text, "[^0-9]", "")) >= 3, F.length(digits) == 0)),
        "gazetteer": by_kind(card=vote(starts(CARD_STARTS), ~starts(CARD_STARTS)), phone=vote(starts(CALLING_CODES), F.lit(False)), email=vote(text.rlike(f"(?:{'|'.join(DOMAIN_ENDS)})$"), F.lit(False)), secret=vote(text.startswith("AKIA") | text.rlike("^(?:password|token|secret)"), F.lit(False))),
        "context": by_kind(**{k: vote(speaks(w), before.rlike("[0-9][ .-]?$") & (F.col("kind") != "secret")) for k, w in CONTEXT.items()}),
        "boundary": vote(F.lit(False), F.col("before").rlike("[A-Za-z0-9_=-]$") | after.rlike("^[A-Za-z0-9_]")),
    }
    size = F.lit(len(LENGTHS))
    for j in reversed(range(len(LENGTHS))):
        size = F.when(F.length(text) <= LENGTHS[j], j).otherwise(size)
    return df.withColumns(votes | {"size": size})


def reliabilities(tally: dict[tuple, int], rounds: int = 40) -> tuple[float, list[dict[tuple[int, int], float]], dict[tuple, float]]:
    """Expectation-maximisation over vote patterns and their counts: the prior, each labeler's chance of a vote given the truth, and each pattern's posterior."""
    post = {v: 1 / (1 + math.exp(-2 * sum(v))) for v in tally}
    prior, chance = 0.5, []
    for _ in range(rounds):
        whole = sum(tally.values())
        true = sum(n * post[v] for v, n in tally.items())
        prior = (true + 1) / (whole + 2)
        chance = []
        for j in range(len(LABELERS)):
            c = {}
            for x in (-1, 0, 1):
                yes = sum(n * post[v] for v, n in tally.items() if v[j] == x)
                no = sum(n * (1 - post[v]) for v, n in tally.items() if v[j] == x)
                # a prior belief that labelers are better than chance: it keeps the classes from changing places, and a rare class from being taken over
                c[x, 1], c[x, 0] = (yes + BELIEF * _AGREES[x]) / (true + BELIEF), (no + BELIEF * _AGREES[-x]) / (whole - true + BELIEF)
            chance.append(c)
        for v in tally:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[j][x, 1] / chance[j][x, 0]) for j, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, chance, post


def _features(votes: tuple, size: int) -> list[int]:
    """Places of the features that are on: one for each labeler's yes and no, one for the length class, one always."""
    return [2 * j + (x > 0) for j, x in enumerate(votes) if x] + [2 * len(LABELERS) + size, 2 * len(LABELERS) + len(LENGTHS) + 1]


N_FEATURES = 2 * len(LABELERS) + len(LENGTHS) + 2


def classifier(rows: dict[tuple[tuple, int], int], post: dict[tuple, float], rounds: int = 300) -> list[float]:
    """Weights of a logistic classifier trained on the posteriors as soft labels, both classes of equal weight, so that rare ones are learnt too."""
    w = [0.0] * N_FEATURES
    yes = 0.5 / (1 + sum(n * post[v] for (v, _), n in rows.items()))
    no = 0.5 / (1 + sum(n * (1 - post[v]) for (v, _), n in rows.items()))
    for _ in range(rounds):
        slope = [-0.001 * x for x in w]
        for (votes, size), n in rows.items():
            on = _features(votes, size)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[f] for f in on)))))
            for f in on:
                slope[f] += n * (yes * post[votes] * (1 - p) - no * (1 - post[votes]) * p)
        w = [x + 2.0 * s for x, s in zip(w, slope, strict=True)]
    return w


def train(votes: DataFrame) -> dict[str, list[float]]:
    """The classifier's weights for each kind of candidate."""
    tally = votes.groupBy("kind", *LABELERS, "size").agg(F.count("*").alias("n")).collect()
    out = {}
    for kind in sorted({r["kind"] for r in tally}):
        rows = {(tuple(r[j] for j in LABELERS), r["size"]): r["n"] for r in sorted(tally) if r["kind"] == kind}
        patterns: dict[tuple, int] = {}
        for (v, _), n in rows.items():
            patterns[v] = patterns.get(v, 0) + n
        out[kind] = classifier(rows, reliabilities(patterns)[2])
    return out


def accepted(votes: DataFrame, weights: dict[str, list[float]]) -> DataFrame:
    """The candidates that the classifier takes for personal data."""
    score = F.lit(None).cast("double")
    for kind, w in weights.items():
        own = F.lit(w[-1])
        for j, name in enumerate(LABELERS):
            own = own + F.when(F.col(name) > 0, w[2 * j + 1]).when(F.col(name) < 0, w[2 * j]).otherwise(0.0)
        for j in range(len(LENGTHS) + 1):
            own = own + F.when(F.col("size") == j, w[2 * len(LABELERS) + j]).otherwise(0.0)
        score = F.when(F.col("kind") == kind, own).otherwise(score)
    return votes.where(score >= 0)


def _joined(spans: Column) -> Column:
    name = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["at"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each document."""
    told, _ = _io.stored(found(docs), "pii")
    rows = told.where(F.size("candidates") > 0).select("doc_id", "mark", F.explode(F.array_distinct("candidates")).alias("c")).distinct()
    votes, _ = _io.stored(voted(rows.select("doc_id", "mark", "c.*")), "pii-votes")
    more = accepted(votes, train(votes))
    at = F.coalesce(*(F.when(F.col("kind") == k, j) for j, k in enumerate(KINDS)))
    more = more.groupBy("doc_id", "mark").agg(F.collect_list(F.struct(F.col("start"), at.alias("at"), (F.col("start") + F.length("text")).alias("end"))).alias("more"))
    more = more.select(F.col("doc_id").alias("d"), F.col("mark").alias("k"), "more")
    out = told.join(more, told["doc_id"].eqNullSafe(more["d"]) & (told["mark"] == more["k"]), "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,at:int,end:int>>"))))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS[:4]), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))
