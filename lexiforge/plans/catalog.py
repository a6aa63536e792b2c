"""All registered queries of the engine and the SQL they are checked against.

The driver's tables stand in for the inputs: part names for dictionary terms, order items for recognised tokens,
lineitem numbers for box corners, pages for paths, embeddings for index vectors, labels and flags for truth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar, text, vectors
from ..operators import dictionary, evaluate, images, layout, nearest, pixels, resolve, scan, segment, vector_join
from ..sources import readers, sinks
from ..streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, place, item: the names of each order's parts in order of line, part and supplier."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    both = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return both.select(F.col("l_orderkey").alias("doc_id"), place.alias("place"), F.col("p_name").alias("item"), "p_brand", "l_returnflag", "l_linestatus")


def listed(spark: SparkSession, sf_dir: str, item=None) -> DataFrame:
    """doc_id, tokens: the items of each order in order."""
    rows = items(spark, sf_dir).withColumn("item", F.col("item") if item is None else item)
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("tokens"))


def sequenced(spark: SparkSession, sf_dir: str, item=None) -> DataFrame:
    """doc_id, seq (from 0), item."""
    return listed(spark, sf_dir, item).select("doc_id", F.posexplode("tokens").alias("seq", "item"))


def part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term: part names and, as shorter terms, their words."""
    names = dictionary.terms(table(spark, sf_dir, "part"), "p_name")
    return dictionary.merged(names, dictionary.vocabulary(names).select(F.col("word").alias("term")))


def part_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """synonym, canonical: the brand of each part name; of several the one of the largest part key."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("synonym_raw"), F.col("p_brand").alias("canonical"))
    return dictionary.synonym_map(rows)


_ITEMS = """items AS (
  SELECT l_orderkey AS doc_id, p_name AS item, p_brand, l_returnflag, l_linestatus,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_TERMS = """names AS (SELECT DISTINCT lower(trim(p_name)) AS term FROM part WHERE length(trim(p_name)) > 2),
terms AS (SELECT term FROM names UNION SELECT unnest(string_split(term, ' ')) FROM names)"""
_SYNONYMS = "syn AS (SELECT lower(trim(p_name)) AS synonym, arg_max(p_brand, p_partkey) AS canonical FROM part GROUP BY 1)"


# --- dictionary ---------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT lower(trim(p_name)) AS term FROM part WHERE length(trim(p_name)) > 2")
def dict_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.terms(table(spark, sf_dir, "part"), "p_name")


@query("SELECT lower(trim(p_name)) AS term FROM part WHERE length(trim(p_name)) > 2 UNION SELECT lower(trim(p_type)) FROM part WHERE length(trim(p_type)) > 2")
def dict_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return dictionary.merged(dictionary.terms(part, "p_name"), dictionary.terms(part, "p_type"))


@query("SELECT lower(p_name) AS term, 'dictionary' AS source FROM part UNION ALL SELECT DISTINCT lower(p_brand), 'synonym' FROM part")
def combined_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return dictionary.combined(part.select(F.col("p_name").alias("term")), part.select(F.col("p_brand").alias("synonym_raw")))


@query("SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents) WHERE word <> ''")
def word_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.vocabulary(table(spark, sf_dir, "documents").select(F.col("text").alias("term")))


def _dressed(name: str = "p_name"):
    """Part names with the blemishes that cleaning repairs."""
    k = F.col("p_partkey") % 5
    n = F.col(name)
    return F.when(k == 0, F.concat(n, F.lit(" (pure"))).when(k == 1, F.concat(n, F.lit(" & "), n)).when(k == 2, F.concat(n, F.lit("'s base)"))).when(k == 3, F.concat(F.lit("("), n, F.lit(") & 'X'"))).otherwise(n)


_DRESSED = """CASE p_partkey % 5 WHEN 0 THEN p_name || ' (pure' WHEN 1 THEN p_name || ' & ' || p_name WHEN 2 THEN p_name || '''s base)'
  WHEN 3 THEN '(' || p_name || ') & ''X''' ELSE p_name END"""


@query(f"""SELECT p_partkey, lower(replace(replace(CASE WHEN contains(e, '(') AND NOT contains(e, ')') THEN replace(e, '(', '')
  WHEN contains(e, ')') AND NOT contains(e, '(') THEN replace(e, ')', '') ELSE e END, ' &', '/'), '''', '')) AS entry
FROM (SELECT p_partkey, {_DRESSED} AS e FROM part)""")
def clean_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.clean_entry(_dressed()).alias("entry"))


_ENDED = ("", " extract", " ferment filtrate", " meristem cell culture", " water", " Extract Ferment Lysate", " extracts")
_ENDED_SQL = "p_name || CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(_ENDED)) + " END"


def _ended():
    out = F.lit(_ENDED[0])
    for k, e in enumerate(_ENDED):
        out = F.when(F.col("p_partkey") % 7 == k, F.lit(e)).otherwise(out)
    return F.concat("p_name", out)


_ENDINGS_SQL = "|".join(sorted(grammar.ENDINGS, key=lambda e: -len(e)))


@query(f"""SELECT p_partkey, CASE WHEN e = '' THEN n ELSE trim(left(n, length(n) - length(e))) END AS base, e AS ending
FROM (SELECT p_partkey, n, regexp_extract(n, '(?i)\\b({_ENDINGS_SQL})\\b$', 1) AS e FROM (SELECT p_partkey, {_ENDED_SQL} AS n FROM part))""")
def entry_ending(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, end = grammar.ending(F.col("n"))
    return table(spark, sf_dir, "part").select("p_partkey", _ended().alias("n")).select("p_partkey", base.alias("base"), end.alias("ending"))


@query("""SELECT p_partkey, CASE WHEN p[1] IN ('va', 'vp') THEN 'vp ' || p[1]
  ELSE array_to_string(list_filter(['vp ' || p[1], array_to_string(p[2:], '/')], lambda x: x <> ''), '|') END AS parts
FROM (SELECT p_partkey, string_split(CASE p_partkey % 3 WHEN 0 THEN 'va/' || p_name WHEN 1 THEN p_name || '/' || p_brand ELSE p_name END, '/') AS p FROM part)""")
def entry_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    rest = F.when(k == 0, F.concat(F.lit("va/"), "p_name")).when(k == 1, F.concat_ws("/", "p_name", "p_brand")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(grammar.split_prefix(F.concat(F.lit("vp/"), rest)), "|").alias("parts"))


@query("""SELECT p_partkey, w[1] || ' ' || unnest([lower(p_brand), lower(p_type)]) || ' ' || w[2] AS name
FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)""")
def split_paren_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("p_name", " ")
    entry = F.concat(w[0], F.lit(" ("), F.lower("p_brand"), F.lit("/ "), F.lower("p_type"), F.lit(") "), w[1])
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(grammar.parentheses(entry)).alias("name"))


@query("""SELECT p_partkey, array_to_string([p_name || ' (' || lower(p_brand) || '/' || lower(p_type) || ')', lower(p_brand), p_name], '|') AS parts FROM part""")
def split_outside_paren(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat("p_name", F.lit(" ("), F.lower("p_brand"), F.lit("/"), F.lower("p_type"), F.lit(")/"), F.lower("p_brand"), F.lit("/"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(grammar.outside_parentheses(entry), "|").alias("parts"))


@query("SELECT p_partkey, p_name AS base, 'stem/leaf oil' AS parts FROM part")
def entry_substance(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, parts = grammar.substance(F.concat("p_name", F.lit(" stem/leaf oil")))
    return table(spark, sf_dir, "part").select("p_partkey", base.alias("base"), F.array_join(parts, "/").alias("parts"))


@query("""SELECT p_partkey, s || ' ' || b AS ingredient FROM (SELECT p_partkey, s, unnest(['flower', 'leaf']) AS b
FROM (SELECT p_partkey, unnest([p_name, lower(p_brand)]) AS s FROM part))""")
def substance_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = grammar.cross(F.concat_ws("/", "p_name", F.lower("p_brand")), F.array(F.lit("flower"), F.lit("leaf")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(made).alias("ingredient"))


@query("SELECT p_partkey, p_name || ' extract|' || p_name || ' ferment filtrate|' || lower(p_brand) AS pieces FROM part")
def split_after_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat("p_name", F.lit(" extract "), F.col("p_name"), F.lit(" ferment filtrate "), F.lower("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(grammar.after_endings(entry), "|").alias("pieces"))


@query("""SELECT p_partkey, p_name || ' ' || unnest(['flower', 'leaf']) || ' extract' AS term FROM part""")
def entry_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.initcap("p_name"), F.lit(" Flower/Leaf Extract"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(grammar.expand(entry)).alias("term"))


_SHEET = "SELECT p_brand AS canonical, string_agg(p_name || CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE '' END, chr(10) ORDER BY p_partkey) AS synonyms FROM part GROUP BY p_brand"


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("s", F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, " ").otherwise("")))
    cells = part.groupBy(F.col("p_brand").alias("canonical")).agg(F.min("p_partkey").alias("row"), F.array_sort(F.collect_list(F.struct("p_partkey", "s"))).alias("x"))
    return cells.select("row", "canonical", F.array_join(F.transform("x", lambda x: x["s"]), "\n").alias("synonyms"))


@query(f"SELECT canonical, s AS synonym_raw, row_number() OVER (PARTITION BY canonical ORDER BY k) - 1 AS line FROM (SELECT canonical, unnest(a) AS s, generate_subscripts(a, 1) AS k FROM (SELECT canonical, string_split(synonyms, chr(10)) AS a FROM ({_SHEET})))")
def synonym_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.exploded_synonyms(_sheet(spark, sf_dir)).select("canonical", "synonym_raw", F.col("seq.line").cast("long").alias("line"))


@query(f"WITH {_SYNONYMS} SELECT * FROM syn")
def synonym_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_synonyms(spark, sf_dir)


@query(f"WITH {_ITEMS}, {_SYNONYMS} SELECT doc_id, canonical, min(seq)::INT AS seq FROM items JOIN syn ON trim(item) = synonym GROUP BY 1, 2")
def synonym_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.canonicals(sequenced(spark, sf_dir), part_synonyms(spark, sf_dir), "doc_id", "item")


# --- tokens -------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\\p{L}\\p{M}\\p{N}_\\s():\\\\/]', '', 'g')), '\\s+'),
  lambda w: length(w) > 1), ' ') AS cleaned FROM documents""")
def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.long_words(F.array(text.clean_word(F.col("text")))).alias("cleaned"))


@query("""SELECT event_id, seq, part FROM (SELECT event_id, unnest([event_type || ':', user_id::VARCHAR || ':', '']) AS part, unnest([0, 1, 2])::INT AS seq FROM events)""")
def colon_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.concat("event_type", F.lit(" : "), F.col("user_id").cast("string"), F.lit(":"))
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(text.split_colons(F.array(token))).alias("seq", "part"))


def _broken():
    """Items of which some end in a hyphen or leave a parenthesis open."""
    k = F.col("place.l_partkey") % 7
    return F.when(k < 2, F.concat("item", F.lit("-"))).when(k == 2, F.concat(F.lit("("), "item")).when(k == 3, F.concat("item", F.lit(")"))).otherwise(F.col("item"))


@query("""WITH RECURSIVE t AS (
  SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k,
         CASE WHEN l_partkey % 7 < 2 THEN p_name || '-' WHEN l_partkey % 7 = 2 THEN '(' || p_name WHEN l_partkey % 7 = 3 THEN p_name || ')' ELSE p_name END AS x
  FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT *, lead(x) OVER (PARTITION BY doc_id ORDER BY k) AS y FROM t),
j AS (SELECT *, CASE WHEN y IS NULL THEN NULL WHEN right(x, 1) = '-' THEN left(x, length(x) - 1) || y
  WHEN contains(x, '(') AND NOT contains(x, ')') AND contains(y, ')') AND NOT contains(y, '(') THEN x || ' ' || y END AS z FROM n),
s AS (SELECT doc_id, k, coalesce(z, x) AS tok, z IS NOT NULL AS skip FROM j WHERE k = 1
  UNION ALL SELECT j.doc_id, j.k, CASE WHEN s.skip THEN NULL ELSE coalesce(j.z, j.x) END, NOT s.skip AND j.z IS NOT NULL FROM s JOIN j ON j.doc_id = s.doc_id AND j.k = s.k + 1)
SELECT doc_id, string_agg(tok, '|' ORDER BY k) AS merged FROM s WHERE tok IS NOT NULL GROUP BY doc_id""")
def pair_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir, _broken()).select("doc_id", F.array_join(text.merge_pairs(F.col("tokens")), "|").alias("merged"))


@query("""SELECT p_partkey, CASE WHEN lower(w) IN ('0il', 'oi', 'ol', 'oill', 'oll', 'oli') THEN 'oil' ELSE w END AS word
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '0il' WHEN 1 THEN 'OLI' WHEN 2 THEN 'oil' ELSE p_name END AS w FROM part)""")
def typo_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    w = F.when(k == 0, "0il").when(k == 1, "OLI").when(k == 2, "oil").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.fix_oil(w).alias("word"))


@query("SELECT event_id, event_id % 2 = 0 AS flag FROM events")
def str2bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelt = F.when(F.col("event_id") % 4 == 0, "Yes").when(F.col("event_id") % 4 == 1, "N").when(F.col("event_id") % 4 == 2, "1").otherwise("FALSE")
    return table(spark, sf_dir, "events").select("event_id", text.to_bool(spelt).alias("flag"))


# --- segmentation and resolving -----------------------------------------------------------------------------------------

_SCAN = """p AS (SELECT doc_id, unnest(range(len(a))) AS pos, a FROM w),
g AS (SELECT doc_id, pos, n, array_to_string(a[pos + 1 : pos + n], ' ') AS term FROM (SELECT *, unnest([1, 2]) AS n FROM p) WHERE pos + n <= len(a)),
b AS (SELECT doc_id, pos, max(n) AS n FROM g JOIN terms USING (term) GROUP BY 1, 2),
step AS (SELECT p.doc_id, p.pos, coalesce(b.n, 0) AS n FROM p LEFT JOIN b ON p.doc_id = b.doc_id AND p.pos = b.pos),
f AS (SELECT doc_id, pos, n FROM step WHERE pos = 0
  UNION ALL SELECT s.doc_id, s.pos, s.n FROM f JOIN step s ON s.doc_id = f.doc_id AND s.pos = f.pos + greatest(f.n, 1)),
found AS (SELECT f.doc_id, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.pos) - 1 AS seq, g.term FROM f JOIN g ON f.doc_id = g.doc_id AND f.pos = g.pos AND f.n = g.n WHERE f.n > 0)"""

# every third order starts with half a name, so that names don't fall on even places
_SEGMENTED = f"""{_TERMS}, {_ITEMS},
d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unknown ' ELSE '' END || string_agg(item, ' ' ORDER BY seq) AS text FROM items GROUP BY doc_id),
w AS (SELECT doc_id, string_split(text, ' ') AS a FROM d), {_SCAN}"""



def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 3 == 0, "unknown ").otherwise("")
    return listed(spark, sf_dir).select("doc_id", F.concat(head, F.array_join("tokens", " ")).alias("text"))


@query(f"WITH RECURSIVE {_SEGMENTED} SELECT doc_id, seq::INT AS seq, term FROM found")
def segment_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.longest(_texts(spark, sf_dir), part_terms(spark, sf_dir))


# how far each place of a text walks along some term, the longest term on the way, and the pieces that a scan from left to right cuts; a text's last row of a seq has the whole piece
_WALKED = """prefix AS (SELECT left(term, n) AS prefix, max(n = length(term)) AS whole FROM (SELECT term, unnest(range(1, length(term) + 1))::INT AS n FROM terms) GROUP BY 1),
txt AS (SELECT DISTINCT text AS t FROM d),
place AS (SELECT t, unnest(range(length(t)))::INT AS spot FROM txt),
sub AS (SELECT t, spot, n, substr(t, spot + 1, n) AS prefix FROM (SELECT t, spot, unnest(range(1, least(length(t) - spot, (SELECT max(length(term)) FROM terms)) + 1))::INT AS n FROM place)),
walk AS MATERIALIZED (SELECT t, spot, max(n) AS walked, coalesce(max(n) FILTER (whole), 0) AS term FROM sub JOIN prefix USING (prefix) GROUP BY 1, 2),
cut(t, step, spot, seq, piece, is_term) AS (SELECT t, 0, 0, -1, '', true FROM txt
  UNION ALL SELECT t, step + 1,
    CASE WHEN done AND term = walked THEN length(t) WHEN done THEN spot + 1 WHEN term > 0 THEN spot + length(name) + 1 WHEN NOT is_term THEN spot + length(seen) WHEN head <> '' THEN spot + length(head) ELSE spot + 1 END,
    CASE WHEN done AND term = walked OR NOT done AND (term > 0 OR is_term AND head <> '') THEN seq + 1 ELSE seq END,
    CASE WHEN done AND term = walked THEN substr(t, spot + 1) WHEN done THEN piece WHEN term > 0 THEN name WHEN NOT is_term THEN piece || seen WHEN head <> '' THEN head ELSE piece END,
    CASE WHEN done AND term = walked OR NOT done AND term > 0 THEN true WHEN done OR NOT is_term OR head = '' THEN is_term ELSE false END
  FROM (SELECT cut.*, coalesce(walked, 0) AS walked, coalesce(term, 0) AS term, cut.spot + coalesce(walked, 0) = length(cut.t) AS done, trim(substr(cut.t, cut.spot + 1, coalesce(term, 0))) AS name,
      substr(cut.t, cut.spot + 1, coalesce(walked, 0) + 1) AS seen, split_part(trim(substr(cut.t, cut.spot + 1, coalesce(walked, 0) + 1)), ' ', 1) AS head
    FROM cut LEFT JOIN walk ON walk.t = cut.t AND walk.spot = cut.spot WHERE cut.spot < length(cut.t))),
pieces AS (SELECT t, seq, arg_max(trim(piece), step) AS piece, arg_max(is_term, step) AS is_term FROM cut WHERE seq >= 0 GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_SEGMENTED.split('w AS (')[0].rstrip().rstrip(',')}, {_WALKED} SELECT doc_id, seq::INT AS seq, piece, is_term FROM d JOIN pieces ON t = text")
def segment_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.by_characters(_texts(spark, sf_dir), part_terms(spark, sf_dir))


@query(f"WITH {_ITEMS} SELECT doc_id, item, min(seq)::INT AS seq FROM items GROUP BY 1, 2")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.ordered_distinct(sequenced(spark, sf_dir), "doc_id", "item")


_SHORTENED = "CASE WHEN l_partkey % 3 = 0 THEN split_part(p_name, ' ', 2) ELSE p_name END"
_REDUNDANT = """lagged AS (SELECT *, lag(item) OVER (PARTITION BY doc_id ORDER BY seq) AS b, lead(item) OVER (PARTITION BY doc_id ORDER BY seq) AS a FROM {0}),
slim AS (SELECT * FROM lagged WHERE NOT coalesce(a IS NOT NULL AND len(string_split(b, ' ')) > 1 AND list_contains(string_split(b, ' '), item), false))"""


@query(f"WITH {_ITEMS.replace('p_name AS item', _SHORTENED + ' AS item')}, {_REDUNDANT.format('items')} SELECT doc_id, seq::INT AS seq, item FROM slim")
def redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.when(F.col("place.l_partkey") % 3 == 0, F.element_at(F.split("item", " "), 2)).otherwise(F.col("item"))
    return resolve.without_redundant(sequenced(spark, sf_dir, short), "doc_id", "item").select("doc_id", "seq", "item")


@query(f"""WITH RECURSIVE {_SEGMENTED}, {_SYNONYMS},
once AS (SELECT doc_id, term AS item, min(seq) AS seq FROM found GROUP BY 1, 2), {_REDUNDANT.format("once")},
bad AS (SELECT doc_id, canonical, min(seq) AS seq FROM slim JOIN syn ON item = synonym GROUP BY 1, 2)
SELECT w.doc_id, coalesce((SELECT string_agg(item, '|' ORDER BY seq) FROM slim s WHERE s.doc_id = w.doc_id), '') AS ingredients,
  coalesce((SELECT string_agg(canonical, '|' ORDER BY seq) FROM bad b WHERE b.doc_id = w.doc_id), '') AS pollutants FROM w""")
def resolve_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir).select("doc_id", F.split("text", " ").alias("tokens"))
    found = resolve.resolved(docs, part_terms(spark, sf_dir), part_synonyms(spark, sf_dir))
    return found.select("doc_id", F.array_join("ingredients", "|").alias("ingredients"), F.array_join("pollutants", "|").alias("pollutants"))


# how often each letter occurs in a word, and the nearest known word of each unknown one
_LETTERS = "[(length(word) - length(replace(word, c, '')))::DOUBLE FOR c IN string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ')]"
_NEAREST = """near AS (SELECT u.word, k.word AS fix, round(list_inner_product(u.v, k.v) / sqrt(list_inner_product(u.v, u.v)) / sqrt(list_inner_product(k.v, k.v)), 11) AS s FROM vec u JOIN vec k ON k.known AND NOT u.known),
fixed AS (SELECT word, fix FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY s DESC, fix) AS nth FROM near) WHERE nth = 1 AND s >= {threshold})"""

# the fourth character of every third item is lost
_LOSSY = "CASE WHEN l_partkey % 3 = 0 THEN left(p_name, 3) || substr(p_name, 5) ELSE p_name END"


@query(f"""WITH RECURSIVE {_TERMS}, {_ITEMS.replace("p_name AS item", _LOSSY + " AS item")},
d AS (SELECT doc_id, string_split(string_agg(item, ' ' ORDER BY seq), ' ') AS a FROM items GROUP BY doc_id),
seen AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS pos FROM d),
vocab AS (SELECT DISTINCT unnest(string_split(term, ' ')) AS word FROM terms),
vec AS (SELECT word, known, {_LETTERS} AS v
  FROM (SELECT word, true AS known FROM vocab UNION SELECT word, false FROM seen WHERE word NOT IN (SELECT word FROM vocab))),
{_NEAREST.format(threshold=0.8)},
w AS (SELECT doc_id, list(coalesce(fix, word) ORDER BY pos) AS a FROM seen LEFT JOIN fixed USING (word) WHERE length(word) > 1 GROUP BY doc_id), {_SCAN}
SELECT w.doc_id, coalesce((SELECT string_agg(term, '|' ORDER BY seq) FROM (SELECT doc_id, term, min(seq) AS seq FROM found GROUP BY 1, 2) f WHERE f.doc_id = w.doc_id), '') AS terms FROM w""")
def resolve_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    lossy = F.when(F.col("place.l_partkey") % 3 == 0, F.concat(F.left("item", F.lit(3)), F.substr("item", F.lit(5)))).otherwise(F.col("item"))
    terms = part_terms(spark, sf_dir)
    clean = listed(spark, sf_dir, lossy).select("doc_id", text.clean_tokens(F.col("tokens")).alias("text"))
    fixed = vector_join.corrected_texts(clean, dictionary.vocabulary(terms), "doc_id", encoder=vector_join.LetterEncoder())
    return segment.term_lists(fixed, terms).select("doc_id", F.array_join(F.array_distinct("terms"), "|").alias("terms"))


# every third item is one word; the index of tokens has whole names only
@query(f"""WITH RECURSIVE {_TERMS}, {_ITEMS.replace("p_name AS item", _SHORTENED + " AS item")}, {_SYNONYMS},
w AS (SELECT doc_id, string_split(string_agg(item, ' ' ORDER BY seq), ' ') AS a FROM items GROUP BY doc_id), {_SCAN},
vec AS (SELECT word, known, {_LETTERS} AS v FROM (SELECT term AS word, true AS known FROM names UNION SELECT term, false FROM found WHERE term NOT IN (SELECT term FROM names))),
{_NEAREST.format(threshold=0.6)},
told AS (SELECT doc_id, seq, coalesce(names.term, fix) AS item FROM found LEFT JOIN names ON names.term = found.term LEFT JOIN fixed ON word = found.term),
once AS (SELECT doc_id, item, min(seq) AS seq FROM told WHERE item IS NOT NULL GROUP BY 1, 2), {_REDUNDANT.format("once")},
bad AS (SELECT doc_id, canonical, min(seq) AS seq FROM slim JOIN syn ON item = synonym GROUP BY 1, 2)
SELECT w.doc_id, coalesce((SELECT string_agg(item, '|' ORDER BY seq) FROM slim s WHERE s.doc_id = w.doc_id), '') AS ingredients,
  coalesce((SELECT string_agg(canonical, '|' ORDER BY seq) FROM bad b WHERE b.doc_id = w.doc_id), '') AS pollutants FROM w""")
def resolve_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.when(F.col("place.l_partkey") % 3 == 0, F.element_at(F.split("item", " "), 2)).otherwise(F.col("item"))
    letters = vector_join.LetterEncoder()
    index = nearest.sparse(dictionary.terms(table(spark, sf_dir, "part"), "p_name"), "term", letters)
    found = resolve.resolved(listed(spark, sf_dir, short), part_terms(spark, sf_dir), part_synonyms(spark, sf_dir), correct=False, encoder=letters, token_index=index, token_threshold=0.6)
    return found.select("doc_id", F.array_join("ingredients", "|").alias("ingredients"), F.array_join("pollutants", "|").alias("pollutants"))


@query(f"""WITH {_ITEMS} SELECT doc_id, doc_id::VARCHAR AS image_name, string_agg(item, '|' ORDER BY seq) AS ingredients, 1::INT AS n_lists FROM items GROUP BY doc_id""")
def response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = listed(spark, sf_dir).select("doc_id", F.col("tokens").alias("ingredients"), F.array().cast("array<string>").alias("pollutants"))
    kind = "image_name string, ingredients array<array<string>>, pollutants array<array<string>>"
    back = resolve.response(docs).withColumn("b", F.from_json("body", kind))
    return back.select("doc_id", "b.image_name", F.array_join(F.col("b.ingredients")[0], "|").alias("ingredients"), F.size("b.pollutants").alias("n_lists"))


@query(f"WITH {_ITEMS} SELECT doc_id, string_agg(item, ',' || chr(10) ORDER BY seq) AS value FROM items GROUP BY doc_id")
def ingredient_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.ingredient_texts(listed(spark, sf_dir).withColumnRenamed("tokens", "ingredients"))


# --- vectors ------------------------------------------------------------------------------------------------------------


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return v.where("id % 2 = 0"), v.where("id % 2 = 1")


_PAIRS = """pairs AS (SELECT q.vec_id AS query_id, k.vec_id AS key_id, list_inner_product(q.embedding::DOUBLE[], k.embedding::DOUBLE[]) AS s
  FROM embeddings q JOIN embeddings k ON q.vec_id % 2 = 0 AND k.vec_id % 2 = 1),
best AS (SELECT query_id, key_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 11) DESC, key_id) AS nth FROM pairs)"""


@query(f"WITH {_PAIRS} SELECT query_id, key_id, score FROM best WHERE nth = 1")
def knn_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.top1(*_sides(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {_PAIRS} SELECT query_id, key_id, score FROM best WHERE nth = 1 AND score >= 0.3")
def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.above(vector_join.top1(*_sides(spark, sf_dir)).withColumn("score", F.round("score", 6)), 0.3)


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length, 1.0::DOUBLE AS unit FROM embeddings")
def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("length"), F.round(vectors.norm(vectors.normalised(F.col("embedding"))), 6).alias("unit"))


@query("SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS product FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    return v.join(after, "vec_id").select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("after")), 6).alias("product"))


@query(f"""WITH {_TERMS.split("terms AS")[0].rstrip().rstrip(",")},
vocab AS (SELECT DISTINCT unnest(string_split(term, ' ')) AS word FROM names),
seen AS (SELECT DISTINCT left(word, 2) || substr(word, 4) AS word FROM vocab),
vec AS (SELECT word, known, {_LETTERS} AS v FROM (SELECT word, true AS known FROM vocab UNION SELECT word, false FROM seen WHERE word NOT IN (SELECT word FROM vocab))),
{_NEAREST.format(threshold=0.5)},
told AS (SELECT word, coalesce(fix, word) AS corrected FROM seen LEFT JOIN fixed USING (word))
SELECT word, CASE WHEN lower(corrected) IN ('0il', 'oi', 'ol', 'oill', 'oll', 'oli') THEN 'oil' ELSE corrected END AS corrected FROM told""")
def typo_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = dictionary.vocabulary(dictionary.terms(table(spark, sf_dir, "part"), "p_name"))
    noisy = words.select(F.concat(F.left("word", F.lit(2)), F.substr("word", F.lit(4))).alias("seen"))
    return vector_join.corrected(noisy, "seen", words, threshold=0.5, encoder=vector_join.LetterEncoder())


# --- evaluation ---------------------------------------------------------------------------------------------------------


#: Order lines of a task.
_LINES_A_TASK = 250_000


def _parts(spark: SparkSession, sf_dir: str) -> int:
    """Into how many parts order lines are dealt: their number is known from the files' ends."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // _LINES_A_TASK))


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items returned against items filled, as predictions and truth of the order."""
    rows = items(spark, sf_dir).select(F.col("doc_id").alias("image_id"), "item", "l_returnflag", "l_linestatus")
    return rows.where("l_returnflag <> 'N'").select("image_id", "item"), rows.where("l_linestatus = 'F'").select("image_id", "item")


_LISTS = f"""{_ITEMS}, pred AS (SELECT doc_id AS image_id, item FROM items WHERE l_returnflag <> 'N'), truth AS (SELECT doc_id AS image_id, item FROM items WHERE l_linestatus = 'F')"""
_COUNTED = """hit AS (SELECT p.image_id, count(t.item) AS tp, count(*) - count(t.item) AS fp FROM pred p LEFT JOIN (SELECT DISTINCT * FROM truth) t USING (image_id, item) GROUP BY 1),
mis AS (SELECT t.image_id, count(*) FILTER (p.item IS NULL) AS fn, count(*) AS wanted FROM truth t LEFT JOIN (SELECT DISTINCT * FROM pred) p USING (image_id, item) GROUP BY 1),
cnt AS (SELECT mis.image_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, fn, wanted FROM mis LEFT JOIN hit USING (image_id)),
rates AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re, tp / wanted AS tp_rate FROM cnt),
m AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM rates)"""
_METRICS = f"{_LISTS},\n{_COUNTED}"


@query(f"WITH {_LISTS} SELECT image_id, item FROM pred SEMI JOIN truth USING (image_id, item)")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.exact(*_lists(spark, sf_dir))


@query(f"WITH {_METRICS} SELECT image_id, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn FROM m")
def fp_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(*_lists(spark, sf_dir), parts=_parts(spark, sf_dir)).select("image_id", "tp", "fp", "fn")


@query(f"WITH {_METRICS} SELECT image_id, round(pr, 6) AS \"precision\", round(re, 6) AS recall, round(f1, 6) AS f1, round(tp_rate, 6) AS tp_rate FROM m")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(*_lists(spark, sf_dir), parts=_parts(spark, sf_dir)).select("image_id", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "tp_rate")))


@query(f"WITH {_METRICS} SELECT round_even(avg(tp_rate), 2) AS accuracy, round_even(avg(f1), 2) AS f1_score FROM m")
def eval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro(evaluate.metrics(*_lists(spark, sf_dir), parts=_parts(spark, sf_dir)))


_EDIT_SQL = "round_even(100 * (1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}), 1)), 0)::INT"


def _edit_score(a, b):
    return F.bround(100 * (1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))), 0).cast("int")


@query(f"""WITH {_LISTS}, s AS (SELECT DISTINCT p.image_id, p.item, t.item AS best, {_EDIT_SQL.format("p.item", "t.item")} AS score FROM pred p JOIN truth t USING (image_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, item ORDER BY score DESC, best) AS nth FROM s) SELECT image_id, item, best, score FROM r WHERE nth = 1""")
def fuzzy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.fuzzy_best(*_lists(spark, sf_dir), score=_edit_score, parts=_parts(spark, sf_dir))


# longest common subsequences of pairs (item, best), a character of item at a time: a bit of v is 0 where the subsequence grows
_LCS = """bits AS (SELECT best, substr(best, p, 1) AS c, sum(1::BIGINT << (p - 1)::INT)::BIGINT AS mask
  FROM (SELECT best, unnest(range(1, length(best) + 1)) AS p FROM (SELECT DISTINCT best FROM pairs)) GROUP BY 1, 2),
lcs(item, best, i, v) AS (SELECT item, best, 0::BIGINT, (1::BIGINT << length(best)::INT) - 1 FROM pairs
  UNION ALL SELECT l.item, l.best, i + 1, ((v + (v & coalesce(mask, 0))) | (v - (v & coalesce(mask, 0)))) & ((1::BIGINT << length(l.best)::INT) - 1)
  FROM lcs l LEFT JOIN bits b ON b.best = l.best AND b.c = substr(l.item, i + 1, 1) WHERE i < length(l.item)),
alike AS (SELECT item, best, round_even(200.0 * (length(best) - bit_count(v)) / (length(item) + length(best)), 0)::INT AS score FROM lcs WHERE i = length(item))"""


@query(f"""WITH RECURSIVE {_TERMS}, p AS (SELECT DISTINCT left(term, 1) AS image_id, left(term, 4) || substr(term, 6) AS item FROM names),
every AS (SELECT image_id, item, term AS best FROM p JOIN names ON left(term, 1) = image_id), pairs AS (SELECT DISTINCT item, best FROM every), {_LCS}
SELECT image_id, item, best, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id, item ORDER BY score DESC, best) AS nth FROM every JOIN alike USING (item, best)) WHERE nth = 1""")
def fuzzy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = dictionary.terms(table(spark, sf_dir, "part"), "p_name").select(F.left("term", F.lit(1)).alias("image_id"), F.col("term").alias("item"))
    noisy = names.select("image_id", F.concat(F.left("item", F.lit(4)), F.substr("item", F.lit(6))).alias("item"))
    return evaluate.fuzzy_best(noisy, names)


@query(f"""WITH RECURSIVE {_LISTS}, every AS (SELECT DISTINCT p.image_id, p.item, t.item AS best FROM pred p JOIN truth t USING (image_id)),
pairs AS (SELECT DISTINCT item, best FROM every), {_LCS}, good AS (SELECT DISTINCT image_id, item FROM every JOIN alike USING (item, best) WHERE score >= 80),
{_COUNTED.replace("SELECT DISTINCT * FROM truth", "SELECT * FROM good")}
SELECT image_id, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f1, 6) AS f1, round(tp_rate, 6) AS tp_rate FROM m""")
def eval_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = evaluate.metrics(*_lists(spark, sf_dir), method="levenshtein", parts=_parts(spark, sf_dir))
    return told.select("image_id", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "tp_rate")))


@query("SELECT count(*) FILTER (toxic = 1)::BIGINT AS n_found, count(*) FILTER (toxic = 0)::BIGINT AS n_missing FROM labels")
def found_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").agg(F.count_if(F.col("toxic") == 1).alias("n_found"), F.count_if(F.col("toxic") == 0).alias("n_missing"))


# --- layout -------------------------------------------------------------------------------------------------------------


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each order line: its place from the line's number, part and quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    at = F.row_number().over(layout.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    b = lines.select(F.col("l_orderkey").alias("image_id"), at.alias("box_id"), "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    b = b.withColumns({"x0": (F.col("l_partkey") % 40 * 10).cast("double"), "y0": (F.col("l_partkey") % 7 * 30 + F.col("q") % 3).cast("double"), "w": (F.lit(20) + F.col("q") % 17).cast("double")})
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, w = F.col("x0"), F.col("y0"), F.col("w")
    polygon = F.array(corner(x0, y0), corner(x0 + w, y0 + 1), corner(x0 + w, y0 + 12), corner(x0, y0 + 11))
    return b.select("image_id", "box_id", polygon.alias("polygon"), F.concat(F.lit("t"), F.col("l_partkey").cast("string")).alias("text"), F.lit(None).cast("double").alias("level"))


_BOXES = """raw AS (SELECT l_orderkey AS image_id, l_partkey, l_quantity::INT AS q,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS box_id FROM lineitem),
box AS (SELECT image_id, box_id, (l_partkey % 40 * 10)::DOUBLE AS x0, (l_partkey % 7 * 30 + q % 3)::DOUBLE AS y0, (20 + q % 17)::DOUBLE AS w FROM raw),
mid AS (SELECT *, trunc(x0)::INT AS lx, trunc(y0 + 5.5)::INT AS ly, trunc(x0 + w)::INT AS rx, trunc(y0 + 6.5)::INT AS ry,
    trunc(x0 + w / 2)::INT AS cx, trunc(y0 + 6)::INT AS cy FROM box),
dist AS (SELECT a.image_id, a.box_id, b.box_id AS other_id, sqrt(pow(a.rx - b.lx, 2) + pow(a.ry - b.ly, 2)) AS d FROM mid a JOIN mid b USING (image_id)),
rnk AS (SELECT *, row_number() OVER (PARTITION BY image_id, box_id ORDER BY d, other_id) AS nth FROM dist),
near AS (SELECT image_id, box_id, other_id, d FROM rnk WHERE nth = 1),
thr AS (SELECT image_id, box_id, avg(d) AS mean, stddev_pop(d) AS std, (avg(d) + stddev_pop(d)) * 0.8 AS threshold FROM rnk WHERE nth <= 5 GROUP BY 1, 2)"""
_LINES = f"""{_BOXES},
e AS (SELECT near.image_id, near.box_id, near.other_id FROM near JOIN thr USING (image_id, box_id) WHERE d <= threshold),
both_ways AS (SELECT * FROM e UNION SELECT image_id, other_id, box_id FROM e),
reach(image_id, box_id, seen) AS (SELECT image_id, box_id, box_id FROM box UNION SELECT r.image_id, r.box_id, b.other_id FROM reach r JOIN both_ways b ON b.image_id = r.image_id AND b.box_id = r.seen),
line AS (SELECT image_id, box_id, min(seen) AS line_id FROM reach GROUP BY 1, 2)"""


@query(f"WITH {_BOXES} SELECT image_id, box_id, lx, ly, rx, ry FROM mid")
def box_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.midpoints(boxes(spark, sf_dir)).select("image_id", "box_id", "lx", "ly", "rx", "ry")


@query(f"WITH {_BOXES} SELECT image_id, box_id, cx, cy FROM mid")
def box_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    cx, cy = layout.centre(F.col("polygon"))
    return boxes(spark, sf_dir).select("image_id", "box_id", cx.alias("cx"), cy.alias("cy"))


@query(f"WITH {_BOXES} SELECT image_id, box_id, other_id, round(d, 6) AS distance FROM near")
def box_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.nearest(boxes(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_BOXES} SELECT image_id, box_id, round(mean, 6) AS mean, round(std, 6) AS std, round(threshold, 6) AS threshold FROM thr")
def box_adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.thresholds(boxes(spark, sf_dir)).select("image_id", "box_id", *(F.round(c, 6).alias(c) for c in ("mean", "std", "threshold")))


@query(f"WITH RECURSIVE {_LINES} SELECT image_id, box_id, line_id FROM line")
def box_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines(boxes(spark, sf_dir))


@query(f"""WITH RECURSIVE {_LINES}, top AS (SELECT mid.image_id, mid.box_id, line_id, cx, first(cy) OVER (PARTITION BY mid.image_id, line_id ORDER BY cx, mid.box_id) AS line_y FROM mid JOIN line USING (image_id, box_id))
SELECT image_id, box_id, line_id, (row_number() OVER (PARTITION BY image_id ORDER BY line_y, line_id, cx, box_id) - 1)::INT AS position FROM top""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(boxes(spark, sf_dir))


@query("""SELECT l_orderkey, l_linenumber, h::INT AS h, w::INT AS w, count(*)::BIGINT AS n FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN a * b > 3000000 THEN greatest(1, trunc(a * sqrt(3000000.0::DOUBLE / (a * b)))) ELSE a END AS h,
    CASE WHEN a * b > 3000000 THEN greatest(1, trunc(b * sqrt(3000000.0::DOUBLE / (a * b)))) ELSE b END AS w
  FROM (SELECT l_orderkey, l_linenumber, l_quantity::INT::DOUBLE * 97 AS a, (l_partkey % 50 + 1)::DOUBLE * 89 AS b FROM lineitem)) GROUP BY ALL""")
def downscale_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_quantity").cast("int") * 97, ((F.col("l_partkey") % 50 + 1) * 89).cast("int")
    h, w = images.target_size(a, b)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", h.alias("h"), w.alias("w")).agg(F.count("*").alias("n"))


@query(f"WITH {_BOXES} SELECT image_id, box_id, nth::INT AS at, other_id, round(d, 6) AS distance FROM rnk WHERE nth <= 5")
def box_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.neighbours(boxes(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


_LEVELS = "levels AS (SELECT l_partkey AS image_id, ((l_orderkey * 7 + l_quantity::INT * 3) % 256)::INT AS level, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_LEVELS}, sums AS (SELECT image_id, level, sum(n) OVER upto AS b, sum(n * level) OVER upto AS m, sum(n) OVER every AS n, sum(n * level) OVER every AS a
  FROM levels WINDOW upto AS (PARTITION BY image_id ORDER BY level), every AS (PARTITION BY image_id)),
parted AS (SELECT image_id, level, CASE WHEN n > b THEN b * (n - b) * ((m / b - (a - m) / (n - b)) * (m / b - (a - m) / (n - b))) ELSE 0 END AS v FROM sums),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, level) AS nth FROM parted)
SELECT image_id, CASE WHEN v > 0 THEN level ELSE 0 END::INT AS threshold FROM ranked WHERE nth = 1""")
def pixel_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = ((F.col("l_orderkey") * 7 + F.col("l_quantity").cast("int") * 3) % 256).cast("int")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("image_id"), level.alias("level")).agg(F.count("*").alias("n"))
    return pixels.otsu_levels(counts)


@query("""SELECT p_partkey, w || ' ' || a || ' x, ' || w || ' ' || b || ' x' AS names
FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS w, split_part(p_name, ' ', 2) AS a, lower(p_brand) AS b FROM part)""")
def entry_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split("p_name", " ")
    name = F.concat(w[0], F.lit(" ("), w[1], F.lit(" / "), F.lower("p_brand"), F.lit(") x"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(grammar.inside_parentheses(F.array(name)), ", ").alias("names"))


# --- paths, rows and streams --------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.without_repeats(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("""SELECT c.c_custkey AS custkey, coalesce(a.v, b.v) AS v FROM customer c LEFT JOIN (SELECT c_custkey, c_name AS v FROM customer WHERE c_custkey % 3 = 0) a USING (c_custkey)
LEFT JOIN (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 0) b USING (c_custkey)""")
def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "custkey")
    return readers.with_fallback(c.where("custkey % 3 = 0").withColumnRenamed("c_name", "v"), c.where("custkey % 2 = 0").withColumnRenamed("c_mktsegment", "v"), c, "custkey", "v")


@query("""SELECT page_id, regexp_replace(f, '(.)\\.[^.]*$', '\\1') AS stem, list_extract(string_split(f, '.'), -1) AS ending
FROM (SELECT page_id, list_extract(string_split(url, '/'), -1) || '.v1.jpg' AS f FROM pages)""")
def stem_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("url", F.lit(".v1.jpg"))
    return table(spark, sf_dir, "pages").select("page_id", text.stem(path).alias("stem"), text.last_part(text.file_name(path), ".").alias("ending"))


@query("SELECT page_id, list_extract(string_split(url, '='), -1) AS last FROM pages")
def url_last_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.last_part(F.col("url"), "=").alias("last"))


@query("SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.JPG' ELSE '.jpeg' END AS path FROM pages WHERE page_id % 4 <> 2")
def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.when(F.col("page_id") % 4 == 0, ".jpg").when(F.col("page_id") % 4 == 1, ".png").when(F.col("page_id") % 4 == 2, ".JPG").otherwise(".jpeg")
    return readers.image_files(table(spark, sf_dir, "pages").select("page_id", F.concat("url", ends).alias("path")), "path")


@query("SELECT regexp_replace(url, '/[^/]*$', '') AS folder, min(url) AS url FROM pages GROUP BY 1")
def first_of_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.first_of_folder(table(spark, sf_dir, "pages").select("url"), "url")


@query("""SELECT o_custkey, o_orderkey, o_custkey::VARCHAR || CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1
  THEN '_' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::VARCHAR ELSE '' END || '.jpg' AS file_name FROM orders""")
def image_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lit("jpg").alias("ending"))
    return sinks.image_names(o, "o_custkey", "o_orderkey").drop("ending")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier ORDER BY s_suppkey LIMIT 2")
def header_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.drop(*(c for c in s.columns if c not in ("s_suppkey", "s_name", "s_nationkey"))).orderBy("s_suppkey").limit(2)


@query("SELECT n_nationkey AS k, n_name AS name, n_regionkey AS region FROM nation")
def answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return sinks.answers(n).select(F.from_json("value", "k long, name string, region long").alias("r")).select("r.*").select("k", "name", F.col("region").cast(n.schema["region"].dataType).alias("region"))


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'http')")
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url").where(F.col("url").startswith("http"))


@query("SELECT p_partkey, replace(lower(trim(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' *' ELSE '*' END)), '*', '') AS label FROM part")
def truth_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    star = F.when(F.col("p_partkey") % 3 == 0, " *").otherwise("*")
    return table(spark, sf_dir, "part").select("p_partkey", text.without_stars(F.concat("p_name", star)).alias("label"))
