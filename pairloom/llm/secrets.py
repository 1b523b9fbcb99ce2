"""Secrets in texts: fixed patterns, and strings that a character Markov model holds to be random.

Everything is built-in column expressions; training is one aggregation over labelled samples, whose
result is at most len(ALPHABET)^2 numbers.

Base kinds: assign, access, hex, as the query's contract has them. The method adds kind markov: a
run of MIN_LENGTH or more characters of ALPHABET whose log-likelihood ratio
between two first-order character models (random strings against ordinary identifiers) reaches
MIN_LLR in total and MIN_RATE for each step, and that overlaps no base span. The ratio alone decides: no
digit or capital is asked for. The samples are numbered; those from TRAIN_SAMPLES on are never trained on and measure the errors.

Defined results. Null text is empty: no spans. Extra columns are ignored; repeated rows give repeated results.
No text makes the patterns backtrack without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, spans

ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
#: Maximal runs of 24 and more: a shorter run can't begin a match, so no look-behind is needed.
HEX = r"[0-9a-f]{24,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
MIN_LENGTH, MIN_LLR, MIN_RATE, SMOOTH = 16, 14.0, 0.4, 0.5
TRAIN_SAMPLES = 4_000
RUN = rf"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}"
KINDS = ("assign", "access", "hex", "markov")
#: Parts of ordinary identifiers, from which the labelled samples are made.
PARTS = (
    "get set make read write open close load store send fetch parse build find list add remove update create delete start stop "
    "user name index value count total file path line table column row key node tree graph list queue stack buffer cache page "
    "request response server client session config option default handler manager factory service worker thread process event "
    "message error warning status result query filter select group order join window stream source target input output format "
    "string number integer double boolean object array map vector matrix image text document record field type class method "
    "first last next previous current max min size length width height left right top bottom begin end time date day month year "
    "version release update backup archive report summary detail header footer content title label color style layout print test"
).split()


def _number(key: str, modulus: int) -> Column:
    """A number below modulus that follows from key and id by a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(key), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long") % modulus


def samples(spark: SparkSession, first: int = 0, end: int = TRAIN_SAMPLES) -> DataFrame:
    """Labelled samples (text, random) of the numbers first to end: for each a random string in one of four alphabets, and
    an identifier of two to five PARTS in one of four styles; for every fourth a run of one character, as rules and fillers are.

    All of them follow from their number by digests, so every run trains on the same ones.
    """
    ids = spark.range(first, end)
    h = F.sha2(F.concat(F.lit("r"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(h))
    bare = F.regexp_replace(b64, "[+/=]", "")
    rand = F.element_at(F.array(h, b64, F.substring(bare, 1, 32), F.upper(bare)), (F.col("id") % 4 + 1).cast("int"))
    words = F.split(F.lit(" ".join(PARTS)), " ")
    chosen = F.slice(F.array(*[F.element_at(words, (_number(str(k), len(PARTS)) + 1).cast("int")) for k in range(5)]), F.lit(1), (F.col("id") % 4 + 2).cast("int"))
    digits = F.when(F.col("id") % 3 == 0, _number("digits", 2_000).cast("string")).otherwise("")
    ident = F.element_at(F.array(F.array_join(chosen, "_"), F.array_join(F.transform(chosen, F.initcap), ""), F.array_join(chosen, "-"), F.upper(F.array_join(chosen, "_"))), (F.col("id") % 7 % 4 + 1).cast("int"))
    char = F.substring(F.lit(ALPHABET), (F.col("id") % len(ALPHABET) + 1).cast("int"), F.lit(1))
    rule = F.repeat(char, (MIN_LENGTH + F.col("id") % 24).cast("int"))
    plain = ids.select(F.concat(ident, digits).alias("text")).unionByName(ids.where("id % 4 = 0").select(rule.alias("text")))
    return ids.select(rand.alias("text"), F.lit(True).alias("random")).unionByName(plain.withColumn("random", F.lit(False)))


def _steps(text: Column) -> Column:
    """Numbers of the pairs of neighbouring characters, from 1."""
    places = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pairs = lambda p: F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p)), lambda a, b: a * len(ALPHABET) + b + 1)
    return spans.let(places, pairs)


def train(labelled: DataFrame) -> list[float]:
    """Log ratios of the two models' transition probabilities, by pair of characters; add-SMOOTH estimates."""
    n = len(ALPHABET)
    steps = labelled.where(F.length("text") > 1).select("random", F.explode(_steps(F.col("text"))).alias("step"))
    counts = {(r.random, r.step): r["count"] for r in steps.groupBy("random", "step").count().collect()}

    def log_p(kind: bool) -> list[float]:
        import math

        c = [counts.get((kind, k + 1), 0) + SMOOTH for k in range(n * n)]
        rows = [sum(c[a * n : a * n + n]) for a in range(n)]
        return [math.log(c[k] / rows[k // n]) for k in range(n * n)]

    return [round(r - o, 4) for r, o in zip(log_p(True), log_p(False))]


def llr(text: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string over ALPHABET: positive where it is likelier random."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    return F.aggregate(_steps(text), F.lit(0.0), lambda acc, k: acc + F.element_at(table, k))


def is_random(text: Column, model: list[float]) -> Column:
    """The decision on one run."""
    return llr(text, model) >= F.greatest(F.lit(MIN_LLR), MIN_RATE * (F.length(text) - 1))


def find_secrets(docs: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """docs with secrets: array of (s, o, e, k) sorted by start, then kind."""
    whole = common.whole_text(text)
    none = F.array().cast(spans.SPAN)
    assign = F.filter(F.when(whole.rlike("[:=]"), spans.find(whole, ASSIGN)).otherwise(none), lambda x: F.length(F.regexp_extract(x["v"], ASSIGN, 2)) >= 6)
    access = F.filter(F.when(F.contains(whole, F.lit("AKIA")), spans.find(whole, ACCESS)).otherwise(none), lambda x: F.length(x["v"]) >= 20)
    hexes = F.when(whole.rlike(HEX), spans.find(whole, HEX)).otherwise(none)
    base = F.concat(*[spans.labelled(x, k, o) for o, (k, x) in enumerate(zip(KINDS, (assign, access, hexes)))])
    got = docs.withColumn("__pairloom_base", base)
    runs = F.filter(F.when(whole.rlike(RUN), spans.find(whole, RUN)).otherwise(none), lambda x: is_random(x["v"], model))
    random = spans.labelled(spans.let(runs, lambda r: spans.apart(r, F.col("__pairloom_base"))), "markov", 3)
    return got.withColumn("secrets", F.array_sort(F.concat("__pairloom_base", random))).drop("__pairloom_base")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: secrets of all documents."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    got = find_secrets(docs, train(samples(spark)))
    count = lambda k: F.size(F.filter("secrets", lambda x: x["k"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("secrets", lambda x: x["o"] < 3)
    return got.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(spans.joined(base), 256).alias("base_sha256"), spans.joined(F.col("secrets")).alias("spans"))


_A = ALPHABET
_SAMPLES = f"""SELECT id, [h, b, substr(regexp_replace(b, '[+/=]', '', 'g'), 1, 32), upper(regexp_replace(b, '[+/=]', '', 'g'))][id % 4 + 1] AS text, TRUE AS random
  FROM (SELECT id, h, base64(unhex(h)) AS b FROM (SELECT id, sha256('r' || id) AS h FROM range({TRAIN_SAMPLES}) r(id)))
UNION ALL SELECT id, [array_to_string(c, '_'), array_to_string(list_transform(c, lambda x: upper(x[1]) || x[2:]), ''), array_to_string(c, '-'), upper(array_to_string(c, '_'))][id % 7 % 4 + 1] || CASE WHEN id % 3 = 0 THEN CAST(CAST('0x' || substr(md5('digits|' || id), 1, 8) AS BIGINT) % 2000 AS VARCHAR) ELSE '' END, FALSE
  FROM (SELECT id, list_transform(range(0, CAST(id % 4 + 2 AS BIGINT)), lambda k: string_split('{" ".join(PARTS)}', ' ')[CAST('0x' || substr(md5(k || '|' || id), 1, 8) AS BIGINT) % {len(PARTS)} + 1]) AS c FROM range({TRAIN_SAMPLES}) r(id))
UNION ALL SELECT id, repeat(substr('{_A}', id % {len(_A)} + 1, 1), CAST({MIN_LENGTH} + id % 24 AS BIGINT)), FALSE FROM range({TRAIN_SAMPLES}) r(id) WHERE id % 4 = 0"""
OP5_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT text, random, unnest(range(1, length(text))) AS i FROM ({_SAMPLES})),
n AS (SELECT random, substr(text, i, 1) AS a, substr(text, i + 1, 1) AS b, count(*) AS c FROM x GROUP BY ALL),
l AS (SELECT unnest(string_split('{_A}', '')) AS z),
m AS MATERIALIZED (
  SELECT p.z AS a, q.z AS b, round(ln((coalesce(y.c, 0) + {SMOOTH}) / (coalesce(ys.c, 0) + {SMOOTH} * {len(_A)})::DOUBLE) - ln((coalesce(o.c, 0) + {SMOOTH}) / (coalesce(os.c, 0) + {SMOOTH} * {len(_A)})::DOUBLE), 4) AS r
  FROM l p CROSS JOIN l q LEFT JOIN n y ON y.random AND y.a = p.z AND y.b = q.z LEFT JOIN n o ON NOT o.random AND o.a = p.z AND o.b = q.z
  LEFT JOIN (SELECT a, sum(c) AS c FROM n WHERE random GROUP BY a) ys ON ys.a = p.z LEFT JOIN (SELECT a, sum(c) AS c FROM n WHERE NOT random GROUP BY a) os ON os.a = p.z),
base AS MATERIALIZED (
  SELECT doc_id, s, e, 0 AS o, 'assign' AS k FROM ({spans.find_sql("d", "(?:(?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?(?:[A-Za-z0-9+/_.=-]+)")}) WHERE length(regexp_extract(v, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 6
  UNION ALL SELECT doc_id, s, e, 1, 'access' FROM ({spans.find_sql("d", ACCESS)}) WHERE length(v) >= 20
  UNION ALL SELECT doc_id, s, e, 2, 'hex' FROM ({spans.find_sql("d", "[0-9a-f]+")}) WHERE length(v) >= 24),
run AS MATERIALIZED (SELECT doc_id, s, e, v FROM ({spans.find_sql("d", "[A-Za-z0-9+/_=-]+")}) WHERE length(v) >= {MIN_LENGTH}),
score AS (SELECT doc_id, s, e, sum(r) AS llr FROM (SELECT doc_id, s, e, v, unnest(range(1, length(v))) AS i FROM run) JOIN m ON m.a = substr(v, i, 1) AND m.b = substr(v, i + 1, 1) GROUP BY doc_id, s, e),
every AS (
  SELECT * FROM base
  UNION ALL SELECT doc_id, s, e, 3, 'markov' FROM score WHERE llr >= greatest({MIN_LLR}, {MIN_RATE} * (e - s - 1)) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = score.doc_id AND b.s < score.e AND score.s < b.e)),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex,
         string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (WHERE o < 3) AS base, string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans
  FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
