"""Small corpora and plain reference versions, a row at a time."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def prose(rnd, n, syllables=("tion", "the", "an", "er", "ing", "and", "re", "st")):
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def corpus(seed=0, n=60):
    """Documents with copies, near copies, shared passages and lines, odd cases and a large source."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        text = "\n".join(prose(rnd, rnd.randint(5, 40)) for _ in range(rnd.randint(1, 6)))
        rows.append(text)
    shared, line = prose(rnd, 70), prose(rnd, 8)
    rows += [prose(rnd, 30) + " " + shared + " " + prose(rnd, 20) for _ in range(6)]
    rows += [prose(rnd, 30) + "\n" + line + "\n" + prose(rnd, 20) + "\n" + line.upper() + " " for _ in range(6)]
    base = prose(rnd, 150).split()
    for k in range(30):
        w = list(base)
        for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
            w[rnd.randrange(len(w))] = prose(rnd, 1)
        rows.append(" ".join(w))
    rows += [rows[3]] * 5 + [None, "", " \t\n", "one two", "one  two", "ONE two", "ünïcödé wörter", "x" * 3000, "a b c d e " * 800]
    out = [(k, t, rnd.choice(["en", "de"]) if k % 11 else None, "big" if k % 3 else f"s{k % 5}", len(t or "")) for k, t in enumerate(rows)]
    return out


def frame(spark, rows, schema=DOCS):
    """The rows with two more columns, one of a name that the operators use inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, schema).withColumns({"rank": F.lit("x"), "key": F.lit(1)})


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
