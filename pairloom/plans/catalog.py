"""The registered queries of the linkage operators, each with its DuckDB counterpart where SQL can express it.

The tables hold no business records, so fixtures stand in: orders are the query records (s1), parts the
candidates (cand), scores and labels follow from the keys by integer arithmetic (the same numbers in
every engine), benchmark items and documents give texts, customers and suppliers names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import similarity as S
from ..functions import text as T
from ..operators import audit as A
from ..operators import blocking as B
from ..operators import candidates
from ..operators import context as C
from ..operators import decision as D
from ..operators import evaluate as E
from ..operators import features as X
from ..operators import learn, models, rules, stages
from ..sources import io, shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """s1, cand, p, y: one row for each order and part."""
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("s1"), F.col("l_partkey").alias("cand")).distinct()
    df = keys.withColumn("p", F.round((F.col("s1") * 7919 + F.col("cand") * 104729) % 1000003 / 1000003.0, 6))
    return df.withColumn("y", ((F.col("s1") * 271 + F.col("cand") * 433) % 1000 < 1000 * F.col("p")).cast("int"))


def ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("s1"), F.col("o_orderstatus").alias("grp"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).where("y = 1").select("s1", "cand")


def predicted(spark: SparkSession, d: str, t: float = 0.6) -> DataFrame:
    return D.select_threshold(D.one_to_one(pairs(spark, d)), t).select("s1", "cand")


PAIRS = """keys AS (SELECT DISTINCT l_orderkey AS s1, l_partkey AS cand FROM lineitem),
pp AS (SELECT s1, cand, round(((s1 * 7919 + cand * 104729) % 1000003)::DOUBLE / 1000003.0::DOUBLE, 6) AS p FROM keys),
pairs AS (SELECT *, CASE WHEN (s1 * 271 + cand * 433) % 1000 < 1000 * p THEN 1 ELSE 0 END AS y FROM pp),
truth AS (SELECT s1, cand FROM pairs WHERE y = 1),
ids AS (SELECT o_orderkey AS s1, o_orderstatus AS grp FROM orders),
owned AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS r FROM pairs) WHERE r = 1),
pred AS (SELECT s1, cand FROM owned WHERE p >= 0.6),
counts AS (
  SELECT i.s1, i.grp, coalesce(n.tp, 0) AS tp, coalesce(n.nt, 0) AS nt, coalesce(n.np, 0) AS np,
         CASE WHEN coalesce(n.nt, 0) = 0 AND coalesce(n.np, 0) = 0 THEN 1.0::DOUBLE ELSE 1.25::DOUBLE * coalesce(n.tp, 0) / (0.25::DOUBLE * coalesce(n.nt, 0) + coalesce(n.np, 0)) END AS f
  FROM ids i LEFT JOIN (
    SELECT s1, count(*) FILTER (WHERE it AND ip) AS tp, count(*) FILTER (WHERE it) AS nt, count(*) FILTER (WHERE ip) AS np
    FROM (SELECT coalesce(a.s1, b.s1) AS s1, a.s1 IS NOT NULL AS ip, b.s1 IS NOT NULL AS it FROM pred a FULL JOIN truth b ON a.s1 = b.s1 AND a.cand = b.cand) GROUP BY s1) n ON i.s1 = n.s1)"""


def grams_sql(source: str, name: str) -> str:
    """CTEs for the trigram counts of a (id, part, text) relation."""
    return f"""{name}_w AS (SELECT id, part, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM {source}),
{name}_g AS (SELECT id, part, unnest(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))) AS gram FROM {name}_w WHERE w <> ''),
{name} AS (SELECT id, part, gram, count(*) AS tf FROM {name}_g GROUP BY ALL)"""


LEG = """n AS (SELECT (SELECT count(*) FROM qs) + (SELECT count(*) FROM cs) AS n),
df AS (SELECT gram, count(*) AS df FROM (SELECT gram FROM qc UNION ALL SELECT gram FROM cc) GROUP BY gram),
idf AS (SELECT gram, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM df, n WHERE df >= 2 AND df <= 0.5::DOUBLE * n),
qr AS (SELECT id, part, gram, (1 + ln(tf)) * idf AS w FROM qc JOIN idf USING (gram)),
cr AS (SELECT id, part, gram, (1 + ln(tf)) * idf AS w FROM cc JOIN idf USING (gram)),
qn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM qr GROUP BY id), cn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM cr GROUP BY id),
sims AS (SELECT a.id AS q, b.id AS c, round(sum(a.w / qn.norm * b.w / cn.norm), 6) AS sim FROM qr a JOIN cr b ON a.gram = b.gram AND a.part = b.part JOIN qn ON qn.id = a.id JOIN cn ON cn.id = b.id GROUP BY ALL)"""
BENCH = "qs AS (SELECT item_id AS id, 'all' AS part, coalesce(text, '') AS text FROM benchmark)"
DOCS = "cs AS (SELECT doc_id AS id, 'all' AS part, coalesce(text, '') AS text FROM documents)"


def bench_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("all").alias("part"), F.coalesce("text", F.lit("")).alias("text"))


def doc_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("all").alias("part"), F.coalesce("text", F.lit("")).alias("text"))


def leg_sql(side: str, k: int) -> str:
    key = "q" if side == "q" else "c"
    return f"""WITH {BENCH}, {DOCS}, {grams_sql("qs", "qc")}, {grams_sql("cs", "cc")}, {LEG}
SELECT q, c, sim, CAST(rk AS BIGINT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY sim DESC, q, c) AS rk FROM sims WHERE sim >= 0.05) WHERE rk <= {k}"""


@query()
def linkage_flagship(spark, d):
    """Which documents hold which benchmark item: sparse leg, one owner for each document, best first."""
    leg = B.sparse_leg(bench_rows(spark, d), doc_rows(spark, d), "q", 10, max_df=0.5).select(F.col("q").alias("s1"), F.col("c").alias("cand"), F.col("sim").alias("p"))
    return D.one_to_one(leg)


ORACLE["linkage_flagship"] = f"""SELECT s1, cand, p FROM (SELECT q AS s1, c AS cand, sim AS p, row_number() OVER (PARTITION BY c ORDER BY sim DESC, q) AS r FROM ({leg_sql("q", 10)})) WHERE r = 1"""


@query(leg_sql("q", 10))
def tfidf_topk_forward(spark, d):
    return _long(B.sparse_leg(bench_rows(spark, d), doc_rows(spark, d), "q", 10, max_df=0.5))


@query(leg_sql("c", 3))
def tfidf_topk_reverse(spark, d):
    return _long(B.sparse_leg(bench_rows(spark, d), doc_rows(spark, d), "c", 3, max_df=0.5))


def _long(df: DataFrame, *names: str) -> DataFrame:
    """Ranks and counts as longs."""
    return df.withColumns({c: F.col(c).cast("long") for c in (names or ("rk",))})


@query(f"WITH {BENCH}, {grams_sql('qs', 'qc')} SELECT id, part, gram, tf FROM qc")
def trigram_counts(spark, d):
    return B.term_counts(bench_rows(spark, d))


@query(f"""WITH {BENCH}, {DOCS}, {grams_sql("qs", "qc")}, {grams_sql("cs", "cc")}, {LEG}
SELECT qr.id, part, gram, round(w / norm, 6) AS w FROM qr JOIN qn USING (id)""")
def tfidf_postings(spark, d):
    a, b = B.term_counts(bench_rows(spark, d)), B.term_counts(doc_rows(spark, d))
    n = bench_rows(spark, d).select("id").unionByName(doc_rows(spark, d).select("id")).agg(F.count("*").alias("n"))
    idf = B.fit_idf(a.select("gram").unionByName(b.select("gram")), n, 2, 0.5)
    return B.postings(a, idf).withColumn("w", F.round("w", 6))


@query(f"""WITH f AS ({leg_sql("q", 10)}), r AS ({leg_sql("c", 3)})
SELECT coalesce(f.q, r.q) AS s1, coalesce(f.c, r.c) AS cand, f.sim AS sim_f, f.rk AS rk_f, r.sim AS sim_r, r.rk AS rk_r FROM f FULL JOIN r ON f.q = r.q AND f.c = r.c""")
def merge_legs(spark, d):
    legs = B.sparse_legs(bench_rows(spark, d), doc_rows(spark, d), {"f": ("q", 10), "r": ("c", 3)}, max_df=0.5)
    return B.merge_legs({name: _long(leg) for name, leg in legs.items()})


@query(f"""WITH f AS ({leg_sql("q", 10)}), r AS ({leg_sql("c", 3)}), m AS (SELECT coalesce(f.q, r.q) AS s1, coalesce(f.c, r.c) AS cand, f.sim AS sim_f, r.sim AS sim_r FROM f FULL JOIN r ON f.q = r.q AND f.c = r.c),
bw AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark), dw AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents),
t AS (SELECT DISTINCT item_id AS s1, doc_id AS cand FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i+9], ' '))) AS g FROM bw)
JOIN (SELECT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i+9], ' '))) AS g FROM dw) USING (g)),
x AS (SELECT t.*, m.s1 IS NOT NULL AS u, sim_f IS NOT NULL AS f, sim_r IS NOT NULL AS r FROM t LEFT JOIN m ON t.s1 = m.s1 AND t.cand = m.cand)
SELECT leg, found, total, round(found::DOUBLE / total, 6) AS recall FROM (
SELECT 'union' AS leg, count(*) FILTER (WHERE u) AS found, count(*) AS total FROM x UNION ALL SELECT 'sim_f', count(*) FILTER (WHERE f), count(*) FROM x UNION ALL SELECT 'sim_r', count(*) FILTER (WHERE r), count(*) FROM x)""")
def blocking_recall(spark, d):
    """True pairs share ten words in a row."""

    def runs(name, key):
        w = table(spark, d, name).select(key, F.split(F.lower("text"), " ").alias("w")).where(F.size("w") >= 10)
        return w.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 9), lambda i: F.array_join(F.slice("w", i, 10), " "))).alias("g"))

    true = runs("benchmark", "item_id").join(runs("documents", "doc_id"), "g").select(F.col("item_id").alias("s1"), F.col("doc_id").alias("cand"))
    return E.blocking_recall(true, merge_legs(spark, d), ["sim_f", "sim_r"])


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
s AS (SELECT a.id AS q, b.id AS c, round(list_inner_product(a.vec, b.vec), 6) AS sim FROM v a, v b)
SELECT q, c, sim, rk FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, q, c) AS rk FROM s) WHERE rk <= 10""")
def dense_topk_forward(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return _long(B.dense_topk(v, v, 10))


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
s AS (SELECT a.id AS q, b.id AS c, round(list_inner_product(a.vec, b.vec), 6) AS sim FROM v a, v b WHERE a.label < 5 AND b.label >= 5),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, q, c) AS rk FROM s) WHERE rk <= 10),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY sim DESC, c, q) AS rk FROM s) WHERE rk <= 3)
SELECT coalesce(f.q, r.q) AS s1, coalesce(f.c, r.c) AS cand, coalesce(f.sim, r.sim) AS sim_dense, f.rk AS rk_dense_f, r.rk AS rk_dense_r FROM f FULL JOIN r ON f.q = r.q AND f.c = r.c""")
def dense_merge_full_outer(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    a, b = v.where("label < 5").drop("label"), v.where("label >= 5").drop("label")
    return _long(B.dense_pairs(B.dense_topk(a, b, 10), B.dense_topk(b, a, 3)), "rk_dense_f", "rk_dense_r")


@query("""WITH r AS (SELECT source AS city, lang AS state FROM documents), n AS (SELECT city, state, count(*) AS n FROM r WHERE city <> '' AND state <> '' GROUP BY ALL),
v AS (SELECT *, sum(n) OVER (PARTITION BY city) AS total FROM n), g AS (SELECT city, state AS guess FROM v WHERE n >= 0.5::DOUBLE * total AND total >= 3)
SELECT d.doc_id AS id, coalesce(g.guess, '?') AS key FROM documents d LEFT JOIN g ON g.city = d.source""")
def state_infer(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("city"), F.col("lang").alias("state"))
    return B.partition_keys(docs, docs.withColumn("state", F.lit("")), share=0.5).select("id", "key")


@query("""SELECT l_orderkey AS s1, CAST(x AS VARCHAR) AS match FROM (SELECT o_orderkey AS l_orderkey, unnest(CASE WHEN m IS NULL THEN [NULL] ELSE m END) AS x FROM orders LEFT JOIN
(SELECT l_orderkey, list(DISTINCT l_partkey) AS m FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON o_orderkey = l_orderkey)""")
def truth_long(spark, d):
    some = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("s1"), F.col("l_partkey").alias("cand"))
    wide = D.match_lists(table(spark, d, "orders").select(F.col("o_orderkey").alias("s1")), some)
    return io.load_truth(wide, "s1", "matched")


@query("SELECT s_suppkey AS id, s_name AS name, 2::TINYINT AS src FROM supplier UNION ALL SELECT c_custkey, c_name, 3::TINYINT FROM customer")
def union_sources(spark, d):
    return io.union_sources({2: table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), 3: table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))})


@query(f"""WITH {PAIRS} SELECT i.s1, coalesce(m.matched, '') AS matched FROM ids i LEFT JOIN
(SELECT s1, array_to_string(list_sort(list(DISTINCT CAST(cand AS VARCHAR))), ',') AS matched FROM pred GROUP BY s1) m ON i.s1 = m.s1""")
def match_lists(spark, d):
    return D.match_lists(ids(spark, d), predicted(spark, d))


@query(f"""WITH {PAIRS} SELECT s1, cand, p, row_number() OVER a AS c_rank_s1, max(p) OVER (PARTITION BY s1) AS c_pmax_s1, round(sum(p) OVER (PARTITION BY s1), 6) AS c_psum_s1,
count(*) FILTER (WHERE p >= 0.5) OVER (PARTITION BY s1) AS c_n05_s1, count(*) FILTER (WHERE p >= 0.2) OVER (PARTITION BY s1) AS c_n02_s1, count(*) OVER (PARTITION BY s1) AS c_ncand_s1,
row_number() OVER b AS c_rank_cand, count(*) OVER (PARTITION BY cand) AS c_nclaim, max(p) OVER (PARTITION BY cand) AS c_pmax_cand, round(sum(p) OVER (PARTITION BY cand) - p, 6) AS c_pother_cand
FROM pairs WINDOW a AS (PARTITION BY s1 ORDER BY p DESC, s1, cand), b AS (PARTITION BY cand ORDER BY p DESC, s1, cand)""")
def ctx_window_features(spark, d):
    df = C.context_features(pairs(spark, d)).drop("y", "c_gap_s1", "c_margin_cand")
    return _long(df, "c_rank_s1", "c_rank_cand").withColumns({c: F.round(c, 6) for c in ("c_psum_s1", "c_pother_cand")})


@query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS r, max(p) OVER (PARTITION BY s1) AS ms, max(p) OVER (PARTITION BY cand) AS mc FROM pairs)
SELECT s1, cand, round(ms - p, 6) AS gap, round(CASE WHEN r = 1 THEN p - coalesce(max(CASE WHEN r = 2 THEN p END) OVER (PARTITION BY cand), 0) ELSE p - mc END, 6) AS margin FROM r""")
def ctx_margin(spark, d):
    return C.context_features(pairs(spark, d)).select("s1", "cand", F.round("c_gap_s1", 6).alias("gap"), F.round("c_margin_cand", 6).alias("margin"))


@query(f"""WITH {PAIRS}, x AS (SELECT s1, cand, CASE WHEN (s1 + cand) % 3 > 0 THEN p END AS m FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY m DESC NULLS LAST, s1, cand) AS rs, row_number() OVER (PARTITION BY cand ORDER BY m DESC NULLS LAST, s1, cand) AS rc FROM x)
SELECT s1, cand, m, CASE WHEN m IS NOT NULL THEN rs END AS m_rank_s1, round(max(m) OVER (PARTITION BY s1) - m, 6) AS m_gap_s1, CASE WHEN m IS NOT NULL THEN rc END AS m_rank_cand,
round(CASE WHEN m IS NULL THEN NULL WHEN rc = 1 THEN m - max(CASE WHEN rc = 2 THEN m END) OVER (PARTITION BY cand) ELSE m - max(m) OVER (PARTITION BY cand) END, 6) AS m_margin_cand FROM r""")
def score_channel(spark, d):
    x = pairs(spark, d).select("s1", "cand", F.when((F.col("s1") + F.col("cand")) % 3 > 0, F.col("p")).alias("m"))
    return _long(C.score_context(x, "m", "m"), "m_rank_s1", "m_rank_cand").withColumns({c: F.round(c, 6) for c in ("m_gap_s1", "m_margin_cand")})


ATTRS = "attrs AS (SELECT p_partkey AS cand, p_name AS name, p_type AS addr, CAST(p_size AS VARCHAR) AS house, (p_partkey % 2 + 2)::INT AS src FROM part)"
JACC = "coalesce(len(list_intersect(list_distinct(string_split({a}, ' ')), list_distinct(string_split({b}, ' '))))::DOUBLE / nullif(len(list_distinct(list_concat(string_split({a}, ' '), string_split({b}, ' ')))), 0), 0)"


def attrs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("cand"), F.col("p_name").alias("name"), F.col("p_type").alias("addr"), F.col("p_size").cast("string").alias("house"), (F.col("p_partkey") % 2 + 2).cast("int").alias("src"))


@query(f"""WITH {PAIRS}, {ATTRS}, r AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, s1, cand) AS rk FROM pairs),
b AS (SELECT m.s1, m.cand, o.p AS po, {JACC.format(a="x.name", b="z.name")} AS ns, {JACC.format(a="x.addr", b="z.addr")} AS asim, CASE WHEN x.house = z.house THEN 1.0 ELSE 0.0 END AS h
FROM pairs m JOIN attrs x ON x.cand = m.cand JOIN r o ON o.s1 = m.s1 AND o.rk <= 4 AND o.cand <> m.cand JOIN attrs z ON z.cand = o.cand)
SELECT m.s1, m.cand, round(max(ns), 6) AS t_name_max, round(sum(ns * po) / greatest(sum(po), 1e-6), 6) AS t_name_mean, round(max(asim), 6) AS t_addr_max,
round(sum(CASE WHEN b.s1 IS NULL THEN NULL WHEN ns >= 0.8 AND asim >= 0.8 THEN po ELSE 0 END), 6) AS t_support, max(h)::DOUBLE AS t_house_agree, CASE WHEN count(b.s1) > 0 THEN count(b.s1) END AS t_n_others
FROM pairs m LEFT JOIN b ON b.s1 = m.s1 AND b.cand = m.cand GROUP BY m.s1, m.cand""")
def group_support(spark, d):
    got = C.group_support(pairs(spark, d), attrs(spark, d).drop("src"), S.jaccard)
    return got.select("s1", "cand", *[F.round(c, 6).alias(c) for c in ("t_name_max", "t_name_mean", "t_addr_max", "t_support")], "t_house_agree", "t_n_others")


@query(f"""WITH {PAIRS}, {ATTRS}, named AS (SELECT m.s1, m.cand, m.p, x.name, x.src, row_number() OVER (PARTITION BY m.s1, x.name ORDER BY m.p DESC, m.cand) AS k FROM pairs m JOIN attrs x ON x.cand = m.cand WHERE x.name <> ''),
firsts AS (SELECT s1, name FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS rank FROM named WHERE k = 1) WHERE rank <= 4),
peers AS (SELECT n.* FROM named n JOIN firsts f ON f.s1 = n.s1 AND f.name = n.name WHERE k <= 2),
one AS (SELECT * FROM (SELECT m.s1, m.cand, o.p AS po, o.src, {JACC.format(a="x.name", b="o.name")} AS sim, row_number() OVER (PARTITION BY m.s1, m.cand, o.name ORDER BY o.k) AS r FROM pairs m JOIN attrs x ON x.cand = m.cand JOIN peers o ON o.s1 = m.s1 AND o.cand <> m.cand) WHERE r = 1)
SELECT m.s1, m.cand, round(max(sim), 6) AS peer_max, round(sum(sim * po), 6) AS peer_support, CASE WHEN count(o.s1) > 0 THEN count(DISTINCT CASE WHEN po >= 0.9 AND sim >= 0.8 THEN src END) END AS peer_sources
FROM pairs m LEFT JOIN one o ON o.s1 = m.s1 AND o.cand = m.cand GROUP BY m.s1, m.cand""")
def peer_support(spark, d):
    got = C.peer_support(pairs(spark, d), attrs(spark, d).select("cand", "name", "src"), S.jaccard)
    return got.select("s1", "cand", F.round("peer_max", 6).alias("peer_max"), F.round("peer_support", 6).alias("peer_support"), "peer_sources")


@query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS r, count(*) OVER (PARTITION BY cand) - 1 AS n_rivals FROM pairs)
SELECT s1, cand, n_rivals, round(CASE WHEN n_rivals = 0 THEN 1.0::DOUBLE WHEN r = 1 THEN p - max(CASE WHEN r = 2 THEN p END) OVER (PARTITION BY cand) ELSE p - max(p) OVER (PARTITION BY cand) END, 6) AS name_margin FROM r""")
def name_margin(spark, d):
    return C.name_margin(pairs(spark, d), "p").select("s1", "cand", "n_rivals", F.round("name_margin", 6).alias("name_margin"))


@query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, s1, cand) AS r FROM pairs),
t AS (SELECT *, max(p) OVER (PARTITION BY s1) AS top, max(CASE WHEN r = 2 THEN p END) OVER (PARTITION BY s1) AS second FROM r)
SELECT s1, cand, (p BETWEEN 0.05 AND 0.95) OR cand % 10 = 0 OR coalesce(top - second <= 0.15::DOUBLE AND top - p <= 0.15::DOUBLE, FALSE) AS repair FROM t""")
def repair_scope(spark, d):
    return C.repair_scope(pairs(spark, d), F.col("cand") % 10 == 0).select("s1", "cand", "repair")


@query(f"WITH {PAIRS} SELECT s1, cand, p FROM pairs WHERE CAST(('0x' || substr(md5('drop' || CAST(s1 AS VARCHAR)), 1, 8)) AS BIGINT) % 100 >= 20")
def owner_dropout(spark, d):
    return C.owner_dropout(pairs(spark, d), 20).select("s1", "cand", "p")


@query(f"WITH {PAIRS} SELECT s1, cand, p FROM owned")
def one_to_one(spark, d):
    return D.one_to_one(pairs(spark, d)).select("s1", "cand", "p")


GRID = [k / 20 for k in range(4, 20)]


@query(f"""WITH {PAIRS}, g AS (SELECT unnest({GRID})::DOUBLE AS t), nt AS (SELECT s1, count(*) AS nt FROM truth GROUP BY s1),
x AS (SELECT g.t, o.s1, count(*) AS np, count(*) FILTER (WHERE o.y = 1) AS tp FROM owned o JOIN g ON o.p >= g.t GROUP BY ALL)
SELECT g.t, round(avg(CASE WHEN coalesce(nt, 0) = 0 AND coalesce(np, 0) = 0 THEN 1.0::DOUBLE ELSE 1.25::DOUBLE * coalesce(tp, 0) / (0.25::DOUBLE * coalesce(nt, 0) + coalesce(np, 0)) END), 6) AS macro_f05
FROM ids i CROSS JOIN g LEFT JOIN nt ON nt.s1 = i.s1 LEFT JOIN x ON x.s1 = i.s1 AND x.t = g.t GROUP BY g.t""")
def threshold_sweep(spark, d):
    return E.threshold_sweep(ids(spark, d), D.one_to_one(pairs(spark, d)), truth(spark, d), GRID)


@query(f"WITH {PAIRS} SELECT s1, cand, p FROM pairs WHERE s1 IN (SELECT s1 FROM (SELECT s1, max(p) AS gate FROM pairs GROUP BY s1) WHERE gate >= 0.9)")
def gated(spark, d):
    x = pairs(spark, d)
    return D.gated(x, x.groupBy("s1").agg(F.max("p").alias("gate")), 0.9).select("s1", "cand", "p")


@query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS r, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS o FROM pairs)
SELECT s1, max(CASE WHEN r = 1 THEN p END) AS g_p1, max(CASE WHEN r = 2 THEN p END) AS g_p2, max(CASE WHEN r = 3 THEN p END) AS g_p3, round(sum(p), 6) AS g_sum, count(*) FILTER (WHERE p >= 0.5) AS g_n05,
count(*) FILTER (WHERE p >= 0.2) AS g_n02, count(*) AS g_n, count(*) FILTER (WHERE o > 1) AS g_lost, max(CASE WHEN r = 1 THEN y END) AS g_top_y, max(CASE WHEN r = 1 THEN cand END) AS g_top_cand FROM r GROUP BY s1""")
def s1_gate_table(spark, d):
    return D.s1_table(pairs(spark, d), ("y", "cand"))


@query(f"""WITH {PAIRS}, x AS (SELECT *, row_number() OVER w AS k, sum(p) OVER (PARTITION BY s1 ORDER BY p DESC, cand ROWS UNBOUNDED PRECEDING) AS run, sum(p) OVER (PARTITION BY s1) AS total,
CASE WHEN max(p) OVER (PARTITION BY s1) >= 1 THEN 0 ELSE exp(sum(ln(1 - least(p, 1 - 1e-12::DOUBLE))) OVER (PARTITION BY s1)) END AS none FROM pairs WHERE p >= 0.05 WINDOW w AS (PARTITION BY s1 ORDER BY p DESC, cand)),
v AS (SELECT *, round(1.25::DOUBLE * run / (0.25::DOUBLE * total + k), 9) AS value FROM x), b AS (SELECT *, max(value) OVER (PARTITION BY s1) AS top FROM v),
c AS (SELECT *, min(CASE WHEN value = top THEN k END) OVER (PARTITION BY s1) AS best_k FROM b) SELECT s1, cand, p, best_k FROM c WHERE k <= best_k AND top > none""")
def expected_f_approx(spark, d):
    return D.expected_f_approx(pairs(spark, d))


def _hits_sql(x: str) -> str:
    """The Poisson-binomial distribution of a list of chances."""
    return f"list_reduce(list_transform({x}, lambda q: [q]), lambda h, q: list_transform(range(1, len(h) + 2), lambda i: coalesce(h[i], 0) * (1 - q[1]) + coalesce(CASE WHEN i > 1 THEN h[i - 1] END, 0) * q[1]), [1.0::DOUBLE])"


@query(f"""WITH {PAIRS}, l AS (SELECT s1, list(p ORDER BY r) AS ps, list(cand ORDER BY r) AS cs FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS r FROM pairs WHERE p >= 0.01) WHERE r <= 20 GROUP BY s1),
h AS (SELECT s1, ps, cs, k, {_hits_sql("ps[1:k]")} AS h, {_hits_sql("ps[k + 1:]")} AS t FROM (SELECT *, unnest(range(0, len(ps) + 1)) AS k FROM l)),
v AS (SELECT s1, ps, cs, k, round(CASE WHEN k = 0 THEN t[1] ELSE list_sum(list_transform(range(1, len(h) + 1), lambda i: list_sum(list_transform(range(1, len(t) + 1), lambda j: h[i] * t[j] * 1.25::DOUBLE * (i - 1) / (0.25::DOUBLE * (i + j - 2) + k))))) END, 9) AS v FROM h),
b AS (SELECT s1, any_value(ps) AS ps, any_value(cs) AS cs, max(v) AS expected, min(k) FILTER (WHERE v = top) AS best_k FROM (SELECT *, max(v) OVER (PARTITION BY s1) AS top FROM v) GROUP BY s1)
SELECT s1, cs[i] AS cand, ps[i] AS p, best_k, round(expected, 6) AS expected FROM (SELECT *, unnest(range(1, best_k + 1)) AS i FROM b)""")
def expected_f_exact(spark, d):
    return _long(D.expected_f_exact(pairs(spark, d)).withColumn("expected", F.round("expected", 6)), "best_k")


@query(f"WITH {PAIRS} SELECT s1, cand, round(p / greatest(1.0::DOUBLE, sum(p) OVER (PARTITION BY cand)), 6) AS q FROM pairs")
def ownership_normalised(spark, d):
    return D.normalised_by_owner(pairs(spark, d)).select("s1", "cand", F.round("q", 6).alias("q"))


@query(f"WITH {PAIRS} SELECT count(*) AS n, round(avg(f), 6) AS macro_f05 FROM counts")
def macro_f05(spark, d):
    return E.macro_f05(ids(spark, d), predicted(spark, d), truth(spark, d))


@query(f"""WITH {PAIRS} SELECT grp, count(*) AS n, round(avg(f), 6) AS f05, round(sum(1 - f) / nullif((SELECT sum(1 - f) FROM counts), 0), 6) AS loss_share FROM counts GROUP BY grp""")
def f05_by_group(spark, d):
    return E.by_group(ids(spark, d), predicted(spark, d), truth(spark, d), "grp")


F_SQL = "CASE WHEN {t} = 0 AND {p} = 0 THEN 1.0::DOUBLE ELSE 1.25::DOUBLE * {tp} / (0.25::DOUBLE * {t} + {p}) END"


def _f(tp: str, t: str, p: str, name: str) -> str:
    return f"round(avg({F_SQL.format(tp=tp, t=t, p=p)}), 6) AS {name}"


@query(f"""WITH {PAIRS}, k AS (SELECT s1, cand FROM pairs WHERE p >= 0.2),
x AS (SELECT coalesce(a.s1, b.s1) AS s1, coalesce(a.cand, b.cand) AS cand, a.s1 IS NOT NULL AS ip, b.s1 IS NOT NULL AS it FROM pred a FULL JOIN truth b ON a.s1 = b.s1 AND a.cand = b.cand),
z AS (SELECT x.*, k.s1 IS NOT NULL AS ic FROM x LEFT JOIN k ON k.s1 = x.s1 AND k.cand = x.cand),
m AS (SELECT s1, count(*) FILTER (WHERE ip AND it) AS tp, count(*) FILTER (WHERE it) AS nt, count(*) FILTER (WHERE ip) AS np, count(*) FILTER (WHERE it AND ic AND NOT ip) AS missed, count(*) FILTER (WHERE it AND NOT ic AND NOT ip) AS unseen FROM z GROUP BY s1),
n AS (SELECT coalesce(tp, 0) AS tp, coalesce(nt, 0) AS nt, coalesce(np, 0) AS np, coalesce(missed, 0) AS missed, coalesce(unseen, 0) AS unseen FROM ids LEFT JOIN m ON m.s1 = ids.s1)
SELECT {_f("tp", "nt", "np", "f_now")}, {_f("tp", "nt", "tp", "f_without_fp")}, {_f("(tp + missed + unseen)", "nt", "(np + missed + unseen)", "f_without_fn")},
{_f("(tp + unseen)", "nt", "(np + unseen)", "f_without_blocking_miss")}, {_f("(tp + missed)", "nt", "(tp + missed)", "f_ceiling")} FROM n""")
def error_decomposition(spark, d):
    return E.decomposition(ids(spark, d), predicted(spark, d), truth(spark, d), pairs(spark, d).where("p >= 0.2"))


@query(f"""WITH {PAIRS} SELECT CASE WHEN nt = 0 AND np = 0 THEN 'singleton_ok' WHEN nt = 0 THEN 'singleton_fp' WHEN np = 0 THEN 'matched_empty' WHEN tp = nt AND tp = np THEN 'exact' WHEN tp < np THEN 'has_fp' ELSE 'only_fn' END AS bucket,
count(*) AS n, round(sum(1 - f), 6) AS loss FROM counts GROUP BY 1""")
def loss_buckets(spark, d):
    return E.entity_buckets(ids(spark, d), predicted(spark, d), truth(spark, d))


@query(f"""WITH {PAIRS}, t AS (SELECT t.*, p.p, o.s1 IS NOT NULL AS own, q.s1 IS NOT NULL AS pred FROM truth t JOIN pairs p ON p.s1 = t.s1 AND p.cand = t.cand LEFT JOIN owned o ON o.s1 = t.s1 AND o.cand = t.cand LEFT JOIN pred q ON q.s1 = t.s1 AND q.cand = t.cand)
SELECT 'retrieval' AS stage, count(*) FILTER (WHERE p < 0.05) AS n FROM t UNION ALL SELECT 'prefilter', count(*) FILTER (WHERE p >= 0.05 AND p < 0.2) FROM t UNION ALL SELECT 'ownership', count(*) FILTER (WHERE p >= 0.2 AND NOT own) FROM t
UNION ALL SELECT 'decision', count(*) FILTER (WHERE p >= 0.2 AND own AND NOT pred) FROM t UNION ALL SELECT 'false_positive', count(*) FROM pred q WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.s1 = q.s1 AND t.cand = q.cand)""")
def error_funnel(spark, d):
    x = pairs(spark, d)
    return E.error_funnel(truth(spark, d), x.where("p >= 0.05"), x.where("p >= 0.2"), D.one_to_one(x), predicted(spark, d))


def _macro(case: str) -> str:
    return f"""(SELECT round(avg({F_SQL.format(tp="coalesce(tp, 0)", t="coalesce(nt, 0)", p="coalesce(np, 0)")}), 6) FROM ids LEFT JOIN (SELECT s1, count(*) AS nt FROM truth GROUP BY s1) a ON a.s1 = ids.s1
LEFT JOIN (SELECT c.s1, count(*) AS np, count(t.s1) AS tp FROM ({case}) c LEFT JOIN truth t ON t.s1 = c.s1 AND t.cand = c.cand GROUP BY c.s1) b ON b.s1 = ids.s1)"""


@query(f"""WITH {PAIRS} SELECT 'none' AS intervention, {_macro("SELECT * FROM pred")} AS macro_f05 UNION ALL SELECT 'drop_false_positives', {_macro("SELECT * FROM pred INTERSECT SELECT * FROM truth")}
UNION ALL SELECT 'add_seen_misses', {_macro("SELECT * FROM pred UNION SELECT s1, cand FROM pairs WHERE y = 1 AND p >= 0.2")} UNION ALL SELECT 'add_all_misses', {_macro("SELECT * FROM pred UNION SELECT * FROM truth")}""")
def oracle_interventions(spark, d):
    return E.interventions(ids(spark, d), predicted(spark, d), truth(spark, d), pairs(spark, d).where("p >= 0.2"))


@query(f"""WITH {PAIRS} SELECT (p >= 0.01)::BIGINT + (p >= 0.05)::BIGINT + (p >= 0.2)::BIGINT + (p >= 0.5)::BIGINT + (p >= 0.9)::BIGINT AS bin, cand % 10 = 0 AS blank, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS match_rate FROM pairs GROUP BY 1, 2""")
def score_bins(spark, d):
    return E.score_bins(pairs(spark, d).withColumn("blank", F.col("cand") % 10 == 0), by=("blank",))


@query(f"""WITH {PAIRS}, c AS (SELECT y, p, greatest(least(p, 1 - 1e-7::DOUBLE), 1e-7::DOUBLE) AS q FROM pairs)
SELECT count(*) AS n, round(avg(CASE WHEN y = 1 THEN -ln(q) ELSE -ln(1 - q) END), 6) AS log_loss, round(avg(CASE WHEN (p >= 0.5)::INT = y THEN 1 ELSE 0 END), 6) AS accuracy FROM c""")
def log_loss(spark, d):
    return E.log_loss(pairs(spark, d))


@query(f"""WITH {PAIRS}, a AS (SELECT i.s1, coalesce(list(cand) FILTER (WHERE cand IS NOT NULL), []) AS o FROM ids i LEFT JOIN pred q ON q.s1 = i.s1 GROUP BY i.s1),
b AS (SELECT i.s1, coalesce(list(cand) FILTER (WHERE cand IS NOT NULL), []) AS n FROM ids i LEFT JOIN (SELECT * FROM owned WHERE p >= 0.8) q ON q.s1 = i.s1 GROUP BY i.s1),
x AS (SELECT grp AS country, len(list_filter(n, lambda v: NOT list_contains(o, v))) AS plus, len(list_filter(o, lambda v: NOT list_contains(n, v))) AS minus, len(o) AS lo, len(n) AS ln FROM a JOIN b USING (s1) JOIN ids USING (s1))
SELECT country, count(*) FILTER (WHERE plus > 0 OR minus > 0) AS changed, sum(plus)::BIGINT AS added, sum(minus)::BIGINT AS removed, count(*) FILTER (WHERE lo > 0 AND ln = 0) AS emptied, count(*) FILTER (WHERE lo = 0 AND ln > 0) AS filled FROM x GROUP BY country""")
def submission_diff(spark, d):
    return E.submission_diff(D.match_lists(ids(spark, d), predicted(spark, d)), D.match_lists(ids(spark, d), predicted(spark, d, 0.8)), ids(spark, d).withColumnRenamed("grp", "country"))


@query("""SELECT lower(split_part(d.text, ' ', 1)) AS key, count(*) AS n, CAST(sum(quality) AS BIGINT) AS n_positive FROM documents d JOIN labels USING (doc_id) GROUP BY 1 HAVING sum(quality) > 0 AND sum(quality) < count(*)""")
def text_conflicts(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("key"), F.col("quality").alias("label"))
    return E.text_conflicts(rows)


@query(f"""WITH {PAIRS} SELECT t.s1, t.cand, o.s1 AS winner FROM truth t JOIN owned o ON o.cand = t.cand AND o.s1 <> t.s1 WHERE o.p < 0.98""")
def stranded_owners(spark, d):
    return E.stranded_owners(truth(spark, d), pairs(spark, d), predicted(spark, d, 0.98))


@query(f"WITH {PAIRS} SELECT count(*) AS n, 0::BIGINT AS null_keys, 0::BIGINT AS bad_labels, 0::BIGINT AS bad_scores, 0::BIGINT AS duplicates FROM pairs")
def verify_pairs(spark, d):
    return E.verify_pairs(pairs(spark, d))


@query(f"""WITH {PAIRS}, p2 AS (SELECT s1, cand FROM owned WHERE p >= 0.5),
g AS (SELECT i.s1, CASE WHEN coalesce(nt, 0) = 0 AND coalesce(np, 0) = 0 THEN 1.0::DOUBLE ELSE 1.25::DOUBLE * coalesce(tp, 0) / (0.25::DOUBLE * coalesce(nt, 0) + coalesce(np, 0)) END AS g FROM ids i LEFT JOIN (SELECT s1, count(*) AS nt FROM truth GROUP BY s1) t ON t.s1 = i.s1
  LEFT JOIN (SELECT q.s1, count(*) AS np, count(t.s1) AS tp FROM p2 q LEFT JOIN truth t ON t.s1 = q.s1 AND t.cand = q.cand GROUP BY q.s1) q ON q.s1 = i.s1),
d AS (SELECT c.grp AS stratum, c.s1 % 97 AS grp, count(*) AS n, round(sum(g.g - c.f), 9) AS diff FROM counts c JOIN g ON g.s1 = c.s1 GROUP BY ALL),
i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY grp) - 1 AS i, count(*) OVER (PARTITION BY stratum) AS m FROM d),
k AS (SELECT draw, stratum, CAST('0x' || substr(md5('boot|' || stratum || '|' || i || '|' || draw), 1, 13) AS BIGINT) % m AS pick FROM i CROSS JOIN range(1, 201) r(draw)),
m AS (SELECT draw, sum(diff) / sum(n) AS m FROM k JOIN i ON i.stratum = k.stratum AND i.i = k.pick GROUP BY draw)
SELECT (SELECT round(sum(diff) / sum(n), 8) FROM d) AS mean, round(quantile_cont(m, 0.025), 8) AS low, round(quantile_cont(m, 0.975), 8) AS high FROM m""")
def grouped_bootstrap(spark, d):
    a = E.entity_counts(ids(spark, d), predicted(spark, d), truth(spark, d)).select("s1", "f")
    b = E.entity_counts(ids(spark, d), predicted(spark, d, 0.5), truth(spark, d)).select("s1", F.col("f").alias("g"))
    diffs = a.join(b, "s1").join(ids(spark, d), "s1").groupBy(F.col("grp").alias("stratum"), (F.col("s1") % 97).alias("grp")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("g") - F.col("f")), 9).alias("diff"))
    return E.paired_bootstrap(diffs)


@query("""WITH s AS (SELECT 'all' AS country, CAST(c_nationkey AS VARCHAR) AS state, count(*) AS n FROM customer GROUP BY 2),
h AS (SELECT *, md5('sample|' || country || '|' || state) AS h FROM s WHERE n <= 1000000), r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY country ORDER BY h, state ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT country, state, n FROM r WHERE before < 500""")
def holdout_partition(spark, d):
    s = table(spark, d, "customer").groupBy(F.lit("all").alias("country"), F.col("c_nationkey").cast("string").alias("state")).agg(F.count("*").alias("n"))
    return E.whole_state_sample(s, 500, 1_000_000)


@query("""WITH t AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS token FROM part) SELECT token, round(ln(((SELECT count(*) FROM part) + 1)::DOUBLE / (count(*) + 1)) + 1, 6) AS idf FROM t GROUP BY token""")
def token_idf(spark, d):
    return X.token_idf(table(spark, d, "part"), "p_name").withColumn("idf", F.round("idf", 6))


NAMES = "x AS (SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size)"


def name_pairs(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_name", "p_brand", "p_size")
    return part.select(F.col("p_name").alias("a"), "p_brand", "p_size").join(part.select(F.col("p_name").alias("b"), "p_brand", "p_size"), ["p_brand", "p_size"]).select("a", "b").distinct()


@query(f"""WITH {NAMES}, t AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS token FROM part),
i AS (SELECT token, ln(((SELECT count(*) FROM part) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM t GROUP BY token),
u AS (SELECT a, b, unnest(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' ')))) AS token FROM x),
w AS (SELECT u.a, u.b, idf, list_contains(string_split(a, ' '), u.token) AS ia, list_contains(string_split(b, ' '), u.token) AS ib FROM u JOIN i USING (token))
SELECT a || '|' || b AS key, round(coalesce(sum(idf) FILTER (WHERE ia AND ib), 0) / sum(idf), 6) AS w_jacc, round(coalesce(sum(idf) FILTER (WHERE ia AND ib), 0) / sum(idf) FILTER (WHERE ia), 6) AS w_cover_a,
round(coalesce(sum(idf) FILTER (WHERE ia AND ib), 0) / sum(idf) FILTER (WHERE ib), 6) AS w_cover_b, round(max(idf) FILTER (WHERE ia AND ib), 6) AS w_rarest FROM w GROUP BY a, b""")
def weighted_jaccard(spark, d):
    return X.weighted_name_compare(name_pairs(spark, d).select(F.concat_ws("|", "a", "b").alias("key"), "a", "b"), X.token_idf(table(spark, d, "part"), "p_name"), 20.0)


@query(f"""WITH {NAMES}, y AS (SELECT a, b, list_distinct(string_split(a, ' ')) AS ta, list_distinct(string_split(b, ' ')) AS tb FROM x)
SELECT a, b, round(len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(list_concat(ta, tb))), 6) AS jacc, round(len(list_intersect(ta, tb))::DOUBLE / len(ta), 6) AS cont_ab, round(len(list_intersect(ta, tb))::DOUBLE / len(tb), 6) AS cont_ba,
(len(ta) - len(tb))::BIGINT AS ntok_diff, CASE WHEN split_part(a, ' ', 1) = split_part(b, ' ', 1) THEN 1 ELSE 0 END::BIGINT AS first_eq FROM y""")
def set_similarities(spark, d):
    a, b = F.col("a"), F.col("b")
    return name_pairs(spark, d).select("a", "b", F.round(S.jaccard(a, b), 6).alias("jacc"), F.round(S.containment(a, b), 6).alias("cont_ab"), F.round(S.containment(b, a), 6).alias("cont_ba"), S.token_count_difference(a, b).cast("long").alias("ntok_diff"), S.first_equal(a, b).cast("long").alias("first_eq"))


@query(f"WITH {NAMES} SELECT a, b, round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 6) AS lev FROM x")
def edit_similarity(spark, d):
    return name_pairs(spark, d).select("a", "b", F.round(S.levenshtein_similarity(F.col("a"), F.col("b")), 6).alias("lev"))


#: Suppliers and customers that a task may combine (a nation's alone meet), and suppliers that are broadcast.
COMBINATIONS_A_TASK, BROADCAST_SUPPLIERS = 100_000_000, 200_000


@query("""WITH x AS (SELECT s_suppkey, c_custkey, CAST(s_suppkey AS VARCHAR) AS a, CAST(c_custkey AS VARCHAR) AS b FROM supplier JOIN customer ON s_nationkey = c_nationkey)
SELECT s_suppkey, c_custkey, (a = b)::BIGINT AS h_eq, (a <> b AND (starts_with(a, b) OR starts_with(b, a) OR ends_with(a, b) OR ends_with(b, a)))::BIGINT AS h_pref, abs(s_suppkey - c_custkey) AS h_diff, CASE WHEN a = b THEN 1 ELSE 2 END::BIGINT AS state FROM x""")
def number_agreement(spark, d):
    """Strings and numbers are made once for each row of a side. Few suppliers go to the customers, who are dealt to tasks by how many pairs there may be; many are joined in parts."""
    side = lambda t, key, n, x: table(spark, d, t).select(key, F.col(n).alias("n"), F.col(key).cast("string").alias(x)).withColumn(f"{x}_number", S.short_number(F.col(x)))
    s, c = side("supplier", "s_suppkey", "s_nationkey", "a"), side("customer", "c_custkey", "c_nationkey", "b")
    few, many = s.count(), c.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), few * many // COMBINATIONS_A_TASK)
    c = c.repartition(min(tasks, max(1, many)))
    x = c.join(F.broadcast(s), "n") if few <= BROADCAST_SUPPLIERS else shared.hot_join(shared.written(c, "customers"), s, ["n"], "c_custkey", total=many)
    a, b = F.col("a"), F.col("b")
    h = S.house_features(a, b, b, (F.col("a_number"), F.col("b_number")))
    return x.select("s_suppkey", "c_custkey", h["h_eq"].cast("long").alias("h_eq"), h["h_pref"].cast("long").alias("h_pref"), h["h_diff"].alias("h_diff"), S.presence_state(a, b).cast("long").alias("state"))


@query(f"WITH {NAMES} SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS jw FROM x")
def jaro_winkler(spark, d):
    return name_pairs(spark, d).select("a", "b", F.round(S.scored("jaro_winkler", F.col("a"), F.col("b")), 6).alias("jw"))


def lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence: one bit for each character of a (at most 120), one step for each of b."""
    mask = f"CAST(list_sum(list_transform(range(0, length({a})), lambda k: CASE WHEN substr({a}, k + 1, 1) = c THEN (1::HUGEINT << k) ELSE 0::HUGEINT END)) AS HUGEINT)"
    full = f"((1::HUGEINT << length({a})) - 1)"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count(list_reduce(string_split({b}, ''), lambda v, c: (((v + (v & {mask})) | (v - (v & {mask}))) & {full}), {full})) END"


def ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * ({lcs_sql(a, b)}) / (length({a}) + length({b})) END"


def partial_sql(a: str, b: str) -> str:
    """Every window of the longer string."""
    windows = f"list_max(list_transform(list_distinct(list_transform(range(1 - length({{0}}), length({{1}})), lambda s: substr({{1}}, CAST(greatest(s, 0) + 1 AS BIGINT), CAST(s + length({{0}}) - greatest(s, 0) AS BIGINT)))), lambda w: {ratio_sql('{0}', 'w')}))"
    best = lambda x, y: f"CASE WHEN {x} = '' THEN CASE WHEN {y} = '' THEN 100.0 ELSE 0.0 END ELSE {windows.format(x, y)} END"
    return f"CASE WHEN length({a}) <= length({b}) THEN {best(a, b)} ELSE {best(b, a)} END"


def _toks(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def edits_sql(source: str, key: str, columns: dict[str, tuple[str, str, str]]) -> str:
    """A SELECT of key and rounded scores: name -> (scorer, column of a, column of b) of a relation."""
    inner, outer = [], []
    for n, (kind, a, b) in columns.items():
        u, v = f"coalesce({a}, '')", f"coalesce({b}, '')"
        inner += [f"{u} AS {n}_a, {v} AS {n}_b, array_to_string(list_sort({_toks(u)}), ' ') AS {n}_sa, array_to_string(list_sort({_toks(v)}), ' ') AS {n}_sb",
                  f"list_sort(list_distinct({_toks(u)})) AS {n}_ua, list_sort(list_distinct({_toks(v)})) AS {n}_ub"]
    mid = ["*"]
    for n in columns:
        both = f"list_sort(list_intersect({n}_ua, {n}_ub))"
        rest = lambda x, y: f"list_filter({n}_u{x}, lambda t: NOT list_contains({n}_u{y}, t))"  # noqa: E731, B023
        mid += [f"array_to_string({both}, ' ') AS {n}_c, trim(array_to_string({both}, ' ') || ' ' || array_to_string({rest('a', 'b')}, ' ')) AS {n}_l, trim(array_to_string({both}, ' ') || ' ' || array_to_string({rest('b', 'a')}, ' ')) AS {n}_r"]
    for n, (kind, _, _) in columns.items():
        tset = f"CASE WHEN len({n}_ua) = 0 OR len({n}_ub) = 0 THEN 0.0 WHEN {n}_c <> '' AND ({n}_c = {n}_l OR {n}_c = {n}_r) THEN 100.0 ELSE greatest({ratio_sql(n + '_l', n + '_r')}, CASE WHEN {n}_c <> '' THEN greatest({ratio_sql(n + '_c', n + '_l')}, {ratio_sql(n + '_c', n + '_r')}) ELSE 0 END) END"
        tsort, whole, part = ratio_sql(n + "_sa", n + "_sb"), ratio_sql(n + "_a", n + "_b"), partial_sql(n + "_a", n + "_b")
        shape = f"(greatest(length({n}_a), length({n}_b))::DOUBLE / nullif(least(length({n}_a), length({n}_b)), 0))"
        scale = f"(CASE WHEN {shape} <= 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END)"
        psort = partial_sql(n + "_sa", n + "_sb")
        wide = f"greatest({whole}, {scale} * ({part}), 0.95::DOUBLE * {scale} * CASE WHEN {n}_c <> '' THEN 100.0 ELSE ({psort}) END)"
        jw = f"CASE WHEN {n}_a = '' AND {n}_b = '' THEN 1.0 WHEN {n}_a = '' OR {n}_b = '' THEN 0.0 ELSE jaro_winkler_similarity({n}_a, {n}_b) END"
        outer.append({"ratio": whole, "partial_ratio": part, "token_sort_ratio": tsort, "token_set_ratio": tset, "jaro_winkler": jw,
                      "weighted_ratio": f"CASE WHEN {n}_a = '' OR {n}_b = '' THEN 0.0 WHEN {shape} < 1.5 THEN greatest({whole}, 0.95::DOUBLE * greatest({tsort}, {tset})) ELSE {wide} END"}[kind])
    return f"SELECT {key}, {', '.join(f'round(({o})::DOUBLE, 6) AS {n}' for n, o in zip(columns, outer))} FROM (SELECT {', '.join(mid)} FROM (SELECT {key}, {', '.join(inner)} FROM {source}))"


RATIOS = ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "weighted_ratio")


@query(f"WITH {NAMES}, y AS (SELECT a, b FROM x UNION SELECT a, substr(b, 1, 4) FROM x UNION SELECT split_part(a, ' ', 2), b || ' ' || a FROM x) {edits_sql('y', 'a, b', {k: (k, 'a', 'b') for k in RATIOS})}")
def string_ratios(spark, d):
    """Indel ratios over names, names with beginnings of names, and words with longer texts."""
    x = name_pairs(spark, d)
    x = x.union(x.select("a", F.substring("b", 1, 4))).union(x.select(F.split_part("a", F.lit(" "), F.lit(2)), F.concat_ws(" ", "b", "a"))).distinct()
    got = x.withColumn("s", S.scored_all({k: (k, F.col("a"), F.col("b")) for k in RATIOS}))
    return got.select("a", "b", *[F.round(f"s.{k}", 6).alias(k) for k in RATIOS])


def _map_sql(table: dict[str, str]) -> str:
    return f"MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in table.items())}}}"


def _list_sql(words) -> str:
    return f"[{', '.join(repr(w) for w in words)}]"


CLEAN_SQL = "lower(strip_accents(coalesce({raw}, '')))"
JUNK_SQL = "'[<>#*~^|=_+\"`]+'"


def names_sql(source: str, raw: str, keep: str) -> str:
    """CTEs of nested steps: keep and the six name columns of a relation."""
    domain = f"regexp_extract(s, '^(?:www\\.)?([a-z0-9\\-]+)\\.({'|'.join(L.DOMAINS)})\\b', 1)"
    return f"""SELECT {keep}, array_to_string(clean, ' ') AS name_clean, array_to_string(core, ' ') AS name_core, array_to_string(list_sort(list_distinct(core)), ' ') AS name_sorted,
  array_to_string(core, '') AS name_concat, array_to_string(legal, ' ') AS legal, is_domain
FROM (SELECT *, CASE WHEN len(rest) > 0 THEN rest ELSE clean END AS core
FROM (SELECT *, list_transform(toks, lambda t: coalesce({_map_sql(L.LEGAL)}[t], t)) AS clean, list_sort(list_distinct(list_filter(list_transform(toks, lambda t: {_map_sql(L.LEGAL)}[t]), lambda t: t IS NOT NULL))) AS legal,
  list_filter(toks, lambda t: NOT list_contains({_list_sql([*L.LEGAL, *L.FILLER])}, t)) AS rest
FROM (SELECT *, list_transform(list_filter(string_split(regexp_replace(translate(replace(s3, '&', ' and '), '.''', ''), '[^0-9a-z ]+', ' ', 'g'), ' '), lambda t: t <> ''),
  lambda t: CASE WHEN regexp_matches(t, '[0-9]') AND regexp_matches(t, '[a-z].*[a-z]') THEN translate(t, '{L.LEET_FROM}', '{L.LEET_TO}') ELSE t END) AS toks
FROM (SELECT *, CASE WHEN strpos(' ' || s2 || ' ', ' dba ') = 0 THEN s2 WHEN trim(substr(' ' || s2 || ' ', strpos(' ' || s2 || ' ', ' dba ') + 5)) <> '' THEN trim(substr(' ' || s2 || ' ', strpos(' ' || s2 || ' ', ' dba ') + 5))
  WHEN trim(substr(' ' || s2 || ' ', 1, strpos(' ' || s2 || ' ', ' dba ') - 1)) <> '' THEN trim(substr(' ' || s2 || ' ', 1, strpos(' ' || s2 || ' ', ' dba ') - 1)) ELSE s2 END AS s3
FROM (SELECT *, CASE WHEN dom <> '' AND NOT contains(s, ' ') THEN 1 ELSE 0 END::TINYINT AS is_domain, CASE WHEN dom <> '' AND NOT contains(s, ' ') THEN replace(dom, '-', '') ELSE s END AS s2
FROM (SELECT *, {domain} AS dom FROM (SELECT *, trim(regexp_replace(trim({CLEAN_SQL.format(raw=raw)}), {JUNK_SQL}, ' ', 'g'), ' -.,') AS s FROM {source})))))))"""


def addresses_sql(source: str, raw: str, country: str, keep: str) -> str:
    """The same of the seven address columns."""
    known = lambda land, table: f"WHEN land = '{land}' THEN coalesce({_map_sql(table)}[c], CASE WHEN length(c) = 2 AND list_contains({_list_sql(sorted(set(table.values())))}, c) THEN c END)"
    merged = {**L.STATES["france"], **L.STATES["india"], **L.STATES["us"]}
    state = f"CASE {' '.join(known(k, t) for k, t in L.STATES.items())} ELSE CASE WHEN length(c) > 3 THEN {_map_sql(merged)}[c] END END"
    number = "regexp_extract(t, '^([0-9]+)(?:st|nd|rd|th)?$', 1)"
    token = f"CASE WHEN {number} <> '' THEN CASE WHEN ltrim({number}, '0') = '' THEN '0' ELSE ltrim({number}, '0') END ELSE coalesce({_map_sql(L.STREET)}[t], t) END"
    isnum, types = "regexp_full_match(t, '[0-9]+')", _list_sql(L.STREET_TYPES)
    flag = f"len(list_filter(x, lambda t: {isnum} OR list_contains({types}, t))) > 0"
    return f"""SELECT {keep}, array_to_string(every, ' ') AS addr_clean, array_to_string(list_filter(nums, lambda n, i: list_position(nums, n) = i), ' ') AS addr_nums,
  coalesce(list_filter(sc, lambda t: {isnum})[1], nums[1], '') AS house, array_to_string(list_filter(sc, lambda t: NOT {isnum} AND NOT list_contains({_list_sql([*L.STREET_TYPES, *L.STREET_EXTRAS])}, t)), ' ') AS street,
  array_to_string(list_filter(city, lambda n, i: list_position(city, n) = i), ' ') AS city, coalesce(list_filter(states, lambda x: x IS NOT NULL)[1], '') AS state, coalesce(list_filter(nums, lambda n: length(n) = 6)[1], '') AS postcode
FROM (SELECT *, list_filter(every, lambda t: {isnum}) AS nums, coalesce(kept[hit], []) AS sc,
  list_filter(flatten(list_filter(kept, lambda x, i: i <> hit AND len(list_filter(x, lambda t: {isnum})) = 0)), lambda t: NOT list_contains({_list_sql([*L.CITY_NOISE, *L.STREET_TYPES])}, t)) AS city
FROM (SELECT *, coalesce(list_position(list_transform(kept, lambda x: {flag}), TRUE), 0) AS hit, flatten(kept) AS every
FROM (SELECT *, list_transform(list_filter(comps, lambda c: ({state}) IS NULL), lambda c: list_transform(list_filter(string_split(c, ' '), lambda t: t <> ''), lambda t: {token})) AS kept, list_transform(comps, lambda c: {state}) AS states
FROM (SELECT *, lower(coalesce({country}, '')) AS land, list_filter(list_transform(string_split(replace(replace(regexp_replace(regexp_replace({CLEAN_SQL.format(raw=raw)}, '\\bnull\\b', ' ', 'g'), {JUNK_SQL}, ' ', 'g'), '&', ' and '), '''', ''), ','),
  lambda c: array_to_string(list_filter(string_split(regexp_replace(c, '[^0-9a-z ]+', ' ', 'g'), ' '), lambda t: t <> ''), ' ')), lambda c: c <> '') AS comps FROM {source}))))"""


#: Given inputs (FIXTURES, section D): names, and addresses with their countries.
RAW_NAMES = (
    "Raab Modern Treasury, LLC", "Llc Raab Modern Treoasubr,y", "raabmoderntreasury.com", "Reliable Digital Collective P.L.L.C.", "-- Holloway Peak Inc Seafood", "Indo 5ky Energy",
    "Tavozephdelta dba Perfect Technology Pvt Ltd", "<< Team Ecole", "ELDER & (PUCKETT)", "Payne Énterprises", "SCI Ptit Àmicale", "Marina Ecole France Sarl", "The Company of Ltd", "dba", "x dba ", "www.a-b.co.in", "", "S.A.S. l'Été",
)
RAW_ADDRESSES = (
    ("2670- DUMBLE SAINT, TX, ALVIN", "US"), ("PITTSFIEDL, ME, 01466 MAIN ST", "us"), ("##1138 Jamison Ave, Roanoke City, Virginia", "us"), ("32623 224st Pl, Black Diamond, Washington", "us"),
    ("Gujarat, Adarsh Society, Near Gokulam Dairy, Athwalines, Surat, Plot No. 569/A", "India"), ("3315 FREMONT ST, null, PEORIA, IL", "us"), ("29 Bd. De La Libération, Saint-nazaire", "France"),
    ("12 All. Jean-jacques Rousseau, Saint-nazaire, Pays de la Loire", "france"), ("", "us"), ("10, New Delhi, DL", "india"), ("Main Road 00, 0012th Cross, 395007, or", "india"), ("7 Quai, or, Texas, OR", "spain"), ("5 Main St, OR", None),
)


def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(lit(v) for v in (r if isinstance(r, tuple) else (r,)))})" for r in rows)


@query(f"""WITH r AS (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS raw FROM pages UNION SELECT s_name FROM supplier UNION SELECT p_name || ' Pvt. Ltd.' FROM part UNION SELECT * FROM (VALUES {_values(RAW_NAMES)}))
{names_sql('r', 'raw', 'raw')}""")
def normalised_names(spark, d):
    """Name normalisation over suppliers, parts, the hosts of pages and given names."""
    hosts = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("raw"))
    given = spark.createDataFrame([(x,) for x in RAW_NAMES], "raw string")
    raw = hosts.unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("raw"))).unionByName(table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.lit("Pvt. Ltd.")).alias("raw"))).unionByName(given).distinct()
    return raw.select("raw", T.norm_name(F.col("raw")).alias("n")).select("raw", "n.*")


@query(f"""WITH r AS (SELECT c_custkey || ' Main Street, ' || n_name || ' City, Texas' AS raw, CASE c_custkey % 4 WHEN 0 THEN 'us' WHEN 1 THEN 'India' WHEN 2 THEN 'france' END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION SELECT * FROM (VALUES {_values(RAW_ADDRESSES)})) {addresses_sql('r', 'raw', 'country', 'raw, country')}""")
def normalised_addresses(spark, d):
    """Address normalisation over composed addresses of customers and given addresses, in known and unknown countries."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 4
    rows = c.select(F.concat(F.col("c_custkey"), F.lit(" Main Street, "), F.col("n_name"), F.lit(" City, Texas")).alias("raw"), F.when(k == 0, "us").when(k == 1, "India").when(k == 2, "france").alias("country"))
    rows = rows.unionByName(spark.createDataFrame(list(RAW_ADDRESSES), "raw string, country string")).distinct()
    return rows.select("raw", "country", T.norm_address(F.col("raw"), F.col("country")).alias("a")).select("raw", "country", "a.*")


PART_RECORDS = f"""rn AS (SELECT p_partkey, p_brand, p_size, p_size || ' ' || p_type || ' Road, ' || p_brand AS addr, p_name AS nm FROM part),
flat AS MATERIALIZED (SELECT * FROM ({names_sql('rn', 'nm', 'p_partkey, p_brand, p_size, addr')}) n JOIN ({addresses_sql('rn', 'addr', "'us'", 'p_partkey AS k')}) a ON a.k = n.p_partkey),
pr AS MATERIALIZED (SELECT x.p_partkey AS s1, y.p_partkey AS cand, {", ".join(f"{t}.{c} AS {u}_{c}" for t, u in (("x", "a"), ("y", "b")) for c in ("name_clean", "name_core", "name_sorted", "name_concat", "legal", "is_domain", "addr_clean", "addr_nums", "house", "street", "city", "state", "postcode"))}
  FROM flat x JOIN flat y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey)"""


def _sets_sql(kind: str, a: str, b: str) -> str:
    both = f"len(list_intersect(list_distinct({_toks(a)}), list_distinct({_toks(b)})))"
    under = f"len(list_distinct(list_concat({_toks(a)}, {_toks(b)})))" if kind == "jacc" else f"len(list_distinct({_toks(a)}))"
    return f"round({both}::DOUBLE / nullif({under}, 0), 6)"


def _both_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {a} = {b} THEN 1 ELSE 2 END"


_EDITS = {n: (k, f"a_{c}", f"b_{c}") for n, (k, c) in X.EDITS.items()} | {"x_name_in_addr": ("partial_ratio", "b_name_core", "a_addr_clean")}
_PLAIN = {
    "n_concat_lev": "CASE WHEN a_name_concat = '' AND b_name_concat = '' THEN 1.0 ELSE round(1 - levenshtein(a_name_concat, b_name_concat)::DOUBLE / greatest(length(a_name_concat), length(b_name_concat)), 6) END::DOUBLE",
    "n_jacc": _sets_sql("jacc", "a_name_core", "b_name_core"), "n_cont_ab": _sets_sql("in", "a_name_core", "b_name_core"), "n_cont_ba": _sets_sql("in", "b_name_core", "a_name_core"),
    "n_len_a": "length(a_name_core)", "n_len_b": "length(b_name_core)", "n_ntok_diff": f"len(list_distinct({_toks('a_name_core')})) - len(list_distinct({_toks('b_name_core')}))",
    "n_first_eq": "CASE WHEN split_part(a_name_core, ' ', 1) = split_part(b_name_core, ' ', 1) THEN 1 ELSE 0 END", "n_sorted_eq": "CASE WHEN a_name_sorted = b_name_sorted THEN 1 ELSE 0 END",
    "legal_state": f"CASE WHEN a_legal = '' AND b_legal = '' THEN 0 WHEN a_legal = '' OR b_legal = '' THEN 1 WHEN a_legal = b_legal THEN 2 WHEN len(list_intersect({_toks('a_legal')}, {_toks('b_legal')})) > 0 THEN 3 ELSE 4 END",
    "a_jacc": _sets_sql("jacc", "a_addr_clean", "b_addr_clean"), "a_cont_ba": _sets_sql("in", "b_addr_clean", "a_addr_clean"), "a_len_b": "length(b_addr_clean)",
    "num_jacc": _sets_sql("jacc", "a_addr_nums", "b_addr_nums"), "num_cont_ba": _sets_sql("in", "b_addr_nums", "a_addr_nums"),
    "h_eq": "CASE WHEN a_house <> '' AND a_house = b_house THEN 1 ELSE 0 END", "h_absent": "(a_house = '')::INT + (b_house = '')::INT",
    "h_pref": "CASE WHEN a_house <> '' AND b_house <> '' AND a_house <> b_house AND (starts_with(a_house, b_house) OR starts_with(b_house, a_house) OR ends_with(a_house, b_house) OR ends_with(b_house, a_house)) THEN 1 ELSE 0 END",
    "h_diff": "abs(TRY_CAST(nullif(a_house, '') AS BIGINT) - TRY_CAST(nullif(b_house, '') AS BIGINT))", "h_in_nums": f"CASE WHEN a_house <> '' AND list_contains({_toks('b_addr_nums')}, a_house) THEN 1 ELSE 0 END",
    "st_empty": "(a_street = '')::INT + 2 * (b_street = '')::INT", "state_state": _both_sql("a_state", "b_state"), "pin_state": _both_sql("a_postcode", "b_postcode"), "is_domain_b": "b_is_domain",
}
KEYS_A_RUN = 512
FEATURE_LONGS = ("n_len_a", "n_len_b", "n_ntok_diff", "n_first_eq", "n_sorted_eq", "legal_state", "a_len_b", "h_eq", "h_absent", "h_pref", "h_diff", "h_in_nums", "st_empty", "state_state", "pin_state", "is_domain_b")


@query(f"""WITH {PART_RECORDS}, e AS ({edits_sql('pr', 's1, cand', _EDITS)}), f AS (SELECT s1, cand, {", ".join(f"({v}){'::BIGINT' if c in FEATURE_LONGS else ''} AS {c}" for c, v in _PLAIN.items())} FROM pr)
SELECT * FROM e JOIN f USING (s1, cand)""")
def pair_features(spark, d):
    """The forty features over parts of one brand and size as records.

    Parts of equal texts are one record. Two records are compared once, and the features hold for every two of their parts;
    keys stand with a record in runs of KEYS_A_RUN. Pairs of small records are many: tasks are as many as shuffle partitions, however few bytes meet.
    """
    tasks, like = int(spark.conf.get("spark.sql.shuffle.partitions")), ("p_brand", "p_size", "p_name", "p_type")
    part = table(spark, d, "part").repartition(tasks, *like).groupBy(*like).agg(F.sort_array(F.collect_list("p_partkey")).alias("keys"))
    part = part.select("p_brand", "p_size", T.norm_name(F.col("p_name")).alias("n"), T.norm_address(F.concat(F.col("p_size"), F.lit(" "), F.col("p_type"), F.lit(" Road, "), F.col("p_brand")), F.lit("us")).alias("a"), "keys")
    flat = part.select("p_brand", "p_size", "n.*", "a.*", "keys")
    texts = flat.columns[2:-1]
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("keys") - 1) / KEYS_A_RUN).cast("int")), lambda k: F.slice("keys", k * KEYS_A_RUN + 1, F.lit(KEYS_A_RUN)))
    records = shared.written(flat.where(F.size("keys") > 0).withColumn("keys", F.explode(runs)), "records")
    side = lambda x: records.select("p_brand", "p_size", F.col("keys").alias(f"{x}_keys"), *[F.col(c).alias(f"{x}_{c}") for c in texts]).repartition(tasks, "p_brand", "p_size")
    both = side("a").join(side("b"), ["p_brand", "p_size"]).where(F.array_min("a_keys") < F.array_max("b_keys"))
    got = X.pair_features(both, ("a_keys", "b_keys"))
    names = got.columns[2:]
    got = got.select("a_keys", "b_keys", *[F.col(c).cast("long").alias(c) if c in FEATURE_LONGS else F.round(c, 6).alias(c) for c in names])
    got = got.select(F.explode("a_keys").alias("s1"), "b_keys", *names)
    return got.select("s1", F.explode("b_keys").alias("cand"), *names).where("s1 < cand")


LATIN, OTHER = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстуввхыз"


@query(f"""WITH b AS (SELECT p.p_name AS a, p.p_type || ', ' || p.p_brand || ' ' || p.p_size AS aa, translate(q.p_name, '{LATIN}', '{OTHER}') AS b, translate(lower(q.p_type), '{LATIN}', '{OTHER}') || ', ' || q.p_size || '/café' AS bb
  FROM part p JOIN part q ON q.p_partkey = p.p_partkey + CASE WHEN p.p_partkey % 5 = 0 THEN 1 ELSE 0 END),
t AS (SELECT list_filter(regexp_split_to_array(lower(a), '\\s+'), lambda t: t <> '') AS a, list_filter(regexp_split_to_array(b, '\\s+'), lambda t: t <> '') AS b FROM b),
nm AS (SELECT source, target, count(*) AS n FROM (SELECT unnest(b) AS source, unnest(a) AS target FROM t WHERE len(a) = len(b)) WHERE regexp_matches(source, '[^\\x{{0}}-\\x{{24F}}]') AND NOT regexp_matches(target, '[^\\x{{0}}-\\x{{24F}}]') GROUP BY ALL),
na AS (SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS r FROM nm) WHERE r = 1 AND n >= 2),
u AS (SELECT list_distinct(list_filter(regexp_split_to_array(lower(aa), '[\\s,.;:()\\-/]+'), lambda t: t <> '' AND NOT regexp_full_match(t, '[0-9]+'))) AS a,
  list_distinct(list_filter(regexp_split_to_array(bb, '[\\s,.;:()\\-/]+'), lambda t: regexp_matches(t, '[^\\x{{0}}-\\x{{24F}}]'))) AS b FROM b),
fr AS (SELECT target, count(*) AS f FROM (SELECT unnest(a) AS target FROM u WHERE len(b) > 0) GROUP BY target),
co AS (SELECT source, target, count(*) AS n FROM (SELECT source, unnest(a) AS target FROM (SELECT a, unnest(b) AS source FROM u)) GROUP BY ALL HAVING count(*) >= 2),
ca AS (SELECT source, target FROM (SELECT source, co.target, row_number() OVER (PARTITION BY source ORDER BY round(n / sqrt(f), 6) DESC, co.target) AS r FROM co JOIN fr ON fr.target = co.target) WHERE r = 1)
SELECT * FROM na UNION ALL SELECT * FROM ca WHERE source NOT IN (SELECT source FROM na)""")
def dictionary_learned(spark, d):
    """Names and types of parts, and the same in other letters; every fifth is paired with the next part's."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    other = lambda c: F.translate(c, LATIN, OTHER)
    right = part.select(F.col("p_partkey").alias("k"), other("p_name").alias("b"), F.concat(other(F.lower("p_type")), F.lit(", "), "p_size", F.lit("/café")).alias("bb"))
    both = part.withColumn("k", F.col("p_partkey") + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0)).join(right, "k")
    return learn.dictionary(both.select(F.col("p_name").alias("a"), "b"), both.select(F.concat(F.col("p_type"), F.lit(", "), "p_brand", F.lit(" "), "p_size").alias("a"), F.col("bb").alias("b")))


@query()
def isotonic_calibration(spark, d):
    x = pairs(spark, d)
    return models.calibrate(models.fit_isotonic(x), x).select("s1", "cand", "p", F.round("q", 6).alias("q"))


def _feature_rows(spark: SparkSession, d: str) -> DataFrame:
    df = C.context_features(pairs(spark, d))
    return df.withColumn("fold", models.group_fold(F.col("s1")))


FEATURES = ("p", "c_rank_s1", "c_gap_s1", "c_ncand_s1", "c_margin_cand")


@query()
def gbt_stage1(spark, d):
    rows = shared.written(_feature_rows(spark, d), "rows")
    model = models.fit_gbt(rows.where("fold = 0"), FEATURES, rounds=8, depth=4)
    return models.score_gbt([model], rows.where("fold = 1"), FEATURES, "score").select("s1", "cand", "y", F.round("score", 6).alias("score"))


@query()
def oof_scores(spark, d):
    rows = shared.written(_feature_rows(spark, d).withColumnRenamed("p", "p1"), "rows")
    return models.out_of_fold(rows, ("p1", *FEATURES[1:]), rounds=5, depth=3).select("s1", "cand", "fold", F.round("p", 6).alias("p"))


@query()
def gate_model(spark, d):
    x = pairs(spark, d)
    gate = D.s1_table(x).join(x.groupBy("s1").agg(F.max("y").alias("y")), "s1")
    feats = ("g_p1", "g_p2", "g_p3", "g_sum", "g_n05", "g_n")
    model = models.fit_gbt(gate, feats, rounds=5, depth=3)
    return models.score_gbt([model], gate, feats, "gate").select("s1", "y", F.round("gate", 6).alias("gate"))


@query("""SELECT lang, count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(text), '\\b(apt|apartment|suite|ste|unit|floor|room)\\b')) AS unit_marker,
count(*) FILTER (WHERE regexp_matches(lower(text), '\\b[0-9]+\\s*[-/]\\s*[0-9a-z]+\\b')) AS compound_number, count(*) FILTER (WHERE regexp_matches(lower(text), '\\b[0-9]{5}(-[0-9]{4})?\\b')) AS us_zip,
count(*) FILTER (WHERE NOT regexp_matches(text, '[0-9]')) AS no_number, count(*) FILTER (WHERE trim(text) = '') AS blank FROM documents GROUP BY lang""")
def pattern_audit(spark, d):
    return A.pattern_audit(table(spark, d, "documents"), "lang", "text")


@query("SELECT p_partkey, CAST(('0x' || substr(sha256(p_name), 1, 12)) AS BIGINT) % 100 AS bucket FROM part")
def hash_bucket(spark, d):
    return table(spark, d, "part").select("p_partkey", A.hash_bucket(F.col("p_name")).alias("bucket"))


ALPHAS, STEPS = [0.0, 0.25, 0.5, 1.0], [0.3, 0.5, 0.7, 0.9]


@query(f"""WITH {PAIRS}, b AS (SELECT a.alpha, s1, cand, y, round((1 - a.alpha) * round(p * p, 6) + a.alpha * p, 9) AS b FROM pairs, (SELECT unnest({ALPHAS})::DOUBLE AS alpha) a),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alpha, cand ORDER BY b DESC, s1) AS r FROM b) WHERE r = 1), g AS (SELECT a.alpha, t.t FROM (SELECT unnest({ALPHAS})::DOUBLE AS alpha) a, (SELECT unnest({STEPS})::DOUBLE AS t) t),
nt AS (SELECT s1, count(*) AS nt FROM truth GROUP BY s1), x AS (SELECT g.alpha, g.t, o.s1, count(*) AS np, sum(y) AS tp FROM o JOIN g ON g.alpha = o.alpha AND o.b >= g.t GROUP BY ALL)
SELECT g.alpha, g.t, round(avg({F_SQL.format(tp="coalesce(tp, 0)", t="coalesce(nt, 0)", p="coalesce(np, 0)")}), 6) AS macro_f05 FROM ids i CROSS JOIN g LEFT JOIN nt ON nt.s1 = i.s1 LEFT JOIN x ON x.s1 = i.s1 AND x.alpha = g.alpha AND x.t = g.t GROUP BY ALL""")
def blend_sweep(spark, d):
    x = pairs(spark, d).withColumn("p2", F.round(F.col("p") * F.col("p"), 6))
    return A.blend_sweep(ids(spark, d), x, truth(spark, d), ALPHAS, STEPS)


POINTS = ((0.1, 0.0), (0.4, 0.25), (0.9, 0.95))


@query(f"""WITH {PAIRS} SELECT s1, cand, round(CASE WHEN p <= 0.1 THEN 0.0::DOUBLE WHEN p <= 0.4 THEN 0.0 + (p - 0.1::DOUBLE) * (0.25::DOUBLE / 0.3::DOUBLE) WHEN p <= 0.9 THEN 0.25 + (p - 0.4::DOUBLE) * (0.7::DOUBLE / 0.5::DOUBLE) ELSE 0.95::DOUBLE END, 9) AS q FROM pairs""")
def calibration_interpolated(spark, d):
    return A.interpolated(pairs(spark, d), "p", POINTS).select("s1", "cand", F.round("q", 9).alias("q"))


@query(f"""WITH {PAIRS}, l AS (SELECT s1, cand, s1 % 3 AS fold, ln(greatest(least(p, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) / (1 - greatest(least(p, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE))) AS lo FROM pairs),
f AS (SELECT s1, cand, unnest([0, 1]) AS k, lo FROM l)
SELECT l.s1, l.cand, round(CASE WHEN fold = 2 THEN lo + 0.5 ELSE lo + fold END, 5) AS logit FROM l""")
def fold_routing(spark, d):
    base = pairs(spark, d).select("s1", "cand", models.logit(F.col("p")).alias("lo"), F.when(F.col("s1") % 3 < 2, (F.col("s1") % 3).cast("int")).alias("fold"))
    by_fold = base.select("s1", "cand", F.explode(F.array(F.lit(0), F.lit(1))).alias("fold"), "lo").withColumn("logit", F.col("lo") + F.col("fold"))
    return A.routed(base.select("s1", "cand", "fold"), by_fold.drop("lo")).select("s1", "cand", F.round("logit", 5).alias("logit"))


@query("SELECT unnest(['repeated', 'missing', 'unknown', 'shared']) AS \"check\", 0::BIGINT AS n")
def submission_invariants(spark, d):
    return A.invariants(ids(spark, d).select("s1"), D.match_lists(ids(spark, d), predicted(spark, d)))


@query()
def orphan_reassign(spark, d):
    """A sequence of decisions that SQL does not express; tests compare with a plain loop over exact enumerations."""
    x = pairs(spark, d).select("s1", "cand", F.round(F.col("p") * F.col("p"), 6).alias("q"))
    x = D.normalised_by_owner(x.withColumnRenamed("q", "p")).select("s1", "cand", F.round("q", 6).alias("q"))
    losers = pairs(spark, d).join(D.one_to_one(pairs(spark, d)).select("s1", "cand"), ["s1", "cand"], "left_anti")
    return A.orphan_reassign(x, predicted(spark, d, 0.98), losers, 0.002).withColumn("gain", F.round("gain", 6))


def _deficit(part: int, share: float) -> str:
    return f"({share}::DOUBLE * o.total - h{part}) / ({share}::DOUBLE * o.total)"


_TO_PART = f"CASE WHEN {_deficit(0, 0.2)} >= {_deficit(1, 0.3)} AND {_deficit(0, 0.2)} >= {_deficit(2, 0.5)} THEN 0 WHEN {_deficit(1, 0.3)} >= {_deficit(2, 0.5)} THEN 1 ELSE 2 END"
_ENUM = " + ".join(f"CASE WHEN p{k} = {{0}} THEN n{k} ELSE 0 END" for k in range(1, 6))
_COUNT = " + ".join(f"(p{k} = {{0}})::INT" for k in range(1, 6))


@query(f"""WITH RECURSIVE g AS MATERIALIZED (SELECT 'nation ' || c_mktsegment AS country, CAST(c_nationkey AS VARCHAR) AS grp, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'region ' || c_mktsegment, CAST(n_regionkey AS VARCHAR), count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
w AS MATERIALIZED (SELECT country, sum(n) AS total, count(*) AS k, list(n ORDER BY grp) AS ns, list(grp ORDER BY grp) AS gs FROM g GROUP BY country),
r AS (SELECT unnest([0, 1, 2]) AS p),
e AS (SELECT w.country, total, gs, [p1, p2, p3, p4, p5] AS ps, {", ".join(f"{_ENUM.format(k)} AS s{k}" for k in range(3))}, {", ".join(f"{_COUNT.format(k)} AS c{k}" for k in range(3))}
  FROM (SELECT *, {", ".join(f"ns[{k}] AS n{k}" for k in range(1, 6))} FROM w WHERE k = 5) w, (SELECT a.p AS p1, b.p AS p2, c.p AS p3, d.p AS p4, f.p AS p5 FROM r a, r b, r c, r d, r f) t),
f AS (SELECT country, gs, ps FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY (s0::DOUBLE / total - 0.2) * (s0::DOUBLE / total - 0.2) + (s1::DOUBLE / total - 0.3) * (s1::DOUBLE / total - 0.3) + (s2::DOUBLE / total - 0.5) * (s2::DOUBLE / total - 0.5), ps) AS r
  FROM e WHERE c0 >= 1 AND c1 >= 2 AND c2 >= 2 AND s0 >= 0.1::DOUBLE * total AND s1 >= 0.1::DOUBLE * total AND s2 >= 0.25::DOUBLE * total) WHERE r = 1),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY country ORDER BY n DESC, sha256(grp)) AS i, sum(n) OVER (PARTITION BY country) AS total FROM g WHERE country NOT IN (SELECT country FROM f)),
s(country, grp, n, part, i, h0, h1, h2) AS (
  SELECT DISTINCT country, '', 0::BIGINT, -1, 0::BIGINT, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT FROM o
  UNION ALL SELECT country, grp, n, part, i, h0 + CASE WHEN part = 0 THEN n ELSE 0 END, h1 + CASE WHEN part = 1 THEN n ELSE 0 END, h2 + CASE WHEN part = 2 THEN n ELSE 0 END
  FROM (SELECT o.country, o.grp, o.n, {_TO_PART} AS part, o.i, h0, h1, h2 FROM s JOIN o ON o.country = s.country AND o.i = s.i + 1))
SELECT country, grp, n, part FROM s WHERE i > 0 UNION ALL SELECT g.country, g.grp, g.n, CAST(f.ps[list_position(f.gs, g.grp)] AS INT) FROM g JOIN f ON f.country = g.country""")
def holdout_greedy(spark, d):
    """Segments as countries: their nations (25, dealt by size) and their regions (5, all assignments tried)."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    level = lambda name, key: c.groupBy(F.concat(F.lit(f"{name} "), "c_mktsegment").alias("country"), F.col(key).cast("string").alias("grp")).agg(F.count("*").alias("n"))
    return A.greedy_partition(level("nation", "c_nationkey").unionByName(level("region", "n_regionkey")))


@query(f"""WITH {PAIRS}, r AS (SELECT *, CASE WHEN y = 1 THEN 'positive' WHEN p >= 0.3 THEN 'hard' ELSE 'easy' END AS st, md5('strata|' || s1 || '|' || cand) AS h FROM pairs),
k AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY h, s1, cand) AS n FROM r) SELECT s1, cand, st FROM k WHERE n <= CASE st WHEN 'positive' THEN 500 WHEN 'hard' THEN 350 ELSE 150 END""")
def stratified_sample(spark, d):
    st = F.when(F.col("y") == 1, "positive").when(F.col("p") >= 0.3, "hard").otherwise("easy")
    return models.stratified_sample(pairs(spark, d).withColumn("st", st), F.col("st"), {"positive": 500, "hard": 350, "easy": 150}).select("s1", "cand", "st")


@query(f"""WITH {PAIRS}, {ATTRS}, r AS (SELECT s1, cand FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, s1, cand) AS rk FROM pairs) WHERE rk = 1)
SELECT m.s1, m.cand, CASE WHEN r.cand <> m.cand THEN round({JACC.format(a="x.name", b="z.name")}, 6) END AS c_top_name, CASE WHEN r.cand <> m.cand THEN round({JACC.format(a="x.addr", b="z.addr")}, 6) END AS c_top_addr,
CASE WHEN r.cand = m.cand THEN -2 WHEN x.house = z.house THEN 1 ELSE 0 END AS c_top_house FROM pairs m JOIN r ON r.s1 = m.s1 JOIN attrs x ON x.cand = m.cand JOIN attrs z ON z.cand = r.cand""")
def top_agreement(spark, d):
    got = C.top_agreement(pairs(spark, d), attrs(spark, d).drop("src"), S.jaccard)
    return got.select("s1", "cand", F.round("c_top_name", 6).alias("c_top_name"), F.round("c_top_addr", 6).alias("c_top_addr"), "c_top_house")


_KEPT = PAIRS + ", kept AS (SELECT * FROM pairs WHERE p >= 0.01)"
_RANKED = "row_number() OVER (PARTITION BY {0} ORDER BY {1} DESC NULLS LAST, s1, cand)"


@query(f"""WITH {_KEPT}, {ATTRS}, w AS (SELECT *, {_RANKED.format("s1", "p")} AS c_rank_s1, {_RANKED.format("cand", "p")} AS c_rank_cand FROM kept),
c AS (SELECT s1, cand, p, y, c_rank_s1, max(p) OVER a AS c_pmax_s1, round(sum(p) OVER a, 6) AS c_psum_s1, count(*) FILTER (WHERE p >= 0.5) OVER a AS c_n05_s1, count(*) FILTER (WHERE p >= 0.2) OVER a AS c_n02_s1, count(*) OVER a AS c_ncand_s1,
  c_rank_cand, count(*) OVER b AS c_nclaim, max(p) OVER b AS c_pmax_cand, round(sum(p) OVER b - p, 6) AS c_pother_cand, round(max(p) OVER a - p, 6) AS c_gap_s1,
  round(CASE WHEN c_rank_cand = 1 THEN p - coalesce(max(CASE WHEN c_rank_cand = 2 THEN p END) OVER b, 0) ELSE p - max(p) OVER b END, 6) AS c_margin_cand FROM w WINDOW a AS (PARTITION BY s1), b AS (PARTITION BY cand)),
t AS (SELECT m.s1, m.cand, CASE WHEN r.cand <> m.cand THEN round({JACC.format(a="x.name", b="z.name")}, 6) END AS c_top_name, CASE WHEN r.cand <> m.cand THEN round({JACC.format(a="x.addr", b="z.addr")}, 6) END AS c_top_addr,
  CASE WHEN r.cand = m.cand THEN -2 WHEN x.house = z.house THEN 1 ELSE 0 END AS c_top_house FROM kept m JOIN (SELECT s1, cand FROM w WHERE c_rank_s1 = 1) r ON r.s1 = m.s1 JOIN attrs x ON x.cand = m.cand JOIN attrs z ON z.cand = r.cand),
o AS (SELECT m.s1, m.cand, o.p AS po, {JACC.format(a="x.name", b="z.name")} AS ns, {JACC.format(a="x.addr", b="z.addr")} AS asim, CASE WHEN x.house = z.house THEN 1.0 ELSE 0.0 END AS h
  FROM kept m JOIN attrs x ON x.cand = m.cand JOIN w o ON o.s1 = m.s1 AND o.c_rank_s1 <= 4 AND o.cand <> m.cand JOIN attrs z ON z.cand = o.cand),
g AS (SELECT s1, cand, round(max(ns), 6) AS t_name_max, round(max(asim), 6) AS t_addr_max, round(sum(ns * po) / greatest(sum(po), 1e-6), 6) AS t_name_mean, round(sum(asim * po) / greatest(sum(po), 1e-6), 6) AS t_addr_mean,
  round(sum(CASE WHEN ns >= 0.8 AND asim >= 0.8 THEN po ELSE 0 END), 6) AS t_support, max(h)::DOUBLE AS t_house_agree, count(*) AS t_n_others FROM o GROUP BY s1, cand),
h AS (SELECT s1, cand, CASE WHEN (s1 + cand) % 3 > 0 THEN 1 - p END AS xenc FROM kept),
k AS (SELECT s1, cand, xenc, {_RANKED.format("s1", "xenc")} AS rs, {_RANKED.format("cand", "xenc")} AS rc FROM h),
x AS (SELECT s1, cand, round(xenc, 6) AS xenc, CASE WHEN xenc IS NOT NULL THEN rs END AS x_rank_s1, round(max(xenc) OVER (PARTITION BY s1) - xenc, 6) AS x_gap_s1, CASE WHEN xenc IS NOT NULL THEN rc END AS x_rank_cand,
  round(CASE WHEN xenc IS NULL THEN NULL WHEN rc = 1 THEN xenc - max(CASE WHEN rc = 2 THEN xenc END) OVER (PARTITION BY cand) ELSE xenc - max(xenc) OVER (PARTITION BY cand) END, 6) AS x_margin_cand FROM k)
SELECT * FROM c JOIN t USING (s1, cand) LEFT JOIN g USING (s1, cand) JOIN x USING (s1, cand)""")
def context_composed(spark, d):
    """All context columns at once, with one model score."""
    channel = pairs(spark, d).where("(s1 + cand) % 3 > 0").select("s1", "cand", (1 - F.col("p")).alias("xenc"))
    got = C.build_context(pairs(spark, d), attrs(spark, d).drop("src"), S.jaccard, channel)
    return got.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if "rank" in c else F.col(c) for c, t in got.dtypes])


def _places(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Suppliers or customers as records: nations are states of their regions; every third customer lacks its state, every sixth its city too."""
    k = name[0]
    nation = table(spark, d, "nation").selectExpr("n_nationkey AS nk", "lower(n_name) AS state", "n_regionkey AS country")
    rows = table(spark, d, name).select(F.col(f"{k}_{'cust' if k == 'c' else 'supp'}key").alias("id"), F.col(f"{k}_name").alias("name_core"), F.col(f"{k}_nationkey").alias("nk"), F.round(f"{k}_acctbal").cast("long").cast("string").alias("house")).join(nation, "nk")
    rows = rows.withColumns({"city": F.concat(F.lit("city"), "nk"), "addr_clean": F.concat_ws(" ", "house", "state"), "street": F.lit("")})
    if k == "c":
        rows = rows.withColumn("city", F.when(F.col("id") % 6 == 0, "").otherwise(F.col("city"))).withColumn("state", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("state")))
    return rows.drop("nk")


def _view_sql(view: str, text: str, max_df: float) -> str:
    """CTEs <view>_s (q, c, sim within country and state) and <view>_o (with rows of unknown state)."""
    v = view
    return f"""{v}_q AS (SELECT id, country || '|' || state AS part, {text} AS text FROM s), {v}_c AS (SELECT id, country || '|' || key AS part, {text} AS text FROM pk),
{grams_sql(v + "_q", v + "_qt")}, {grams_sql(v + "_c", v + "_ct")}, {v}_n AS (SELECT split_part(part, '|', 1) AS country, count(*) AS n FROM {v}_c GROUP BY 1),
{v}_df AS (SELECT split_part(part, '|', 1) AS country, gram, count(*) AS df FROM {v}_ct GROUP BY ALL),
{v}_idf AS (SELECT country, gram, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM {v}_df JOIN {v}_n USING (country) WHERE df >= 2 AND df <= {max_df}::DOUBLE * n),
{v}_qr AS (SELECT id, part, country, gram, (1 + ln(tf)) * idf AS w FROM {v}_qt t JOIN {v}_idf i USING (gram) WHERE i.country = split_part(t.part, '|', 1)),
{v}_cr AS (SELECT id, part, country, gram, (1 + ln(tf)) * idf AS w FROM {v}_ct t JOIN {v}_idf i USING (gram) WHERE i.country = split_part(t.part, '|', 1)),
{v}_qw AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS u FROM {v}_qr), {v}_cw AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS u FROM {v}_cr),
{v}_s AS (SELECT a.id AS q, b.id AS c, round(sum(a.u * b.u), 6) AS sim FROM {v}_qw a JOIN {v}_cw b ON a.part = b.part AND a.gram = b.gram GROUP BY ALL HAVING sim >= 0.05),
{v}_o AS (SELECT a.id AS q, b.id AS c, round(sum(a.u * b.u), 6) AS sim FROM {v}_qw a JOIN {v}_cw b ON a.country = b.country AND a.gram = b.gram AND b.part LIKE '%|?' GROUP BY ALL HAVING sim >= 0.05)"""


def _rank_sql(leg: str, source: str, side: str, k: int) -> str:
    return f"SELECT q AS s1, c AS cand, sim AS sim_{leg}, rk AS rk_{leg} FROM (SELECT *, row_number() OVER (PARTITION BY {side} ORDER BY sim DESC, q, c) AS rk FROM {source}) WHERE rk <= {k}"


_LEGS = {"f_name": ("name_s", "q", 10), "f_addr": ("addr_s", "q", 15), "f_name_addr": ("name_addr_s", "q", 20), "r_name_addr": ("name_addr_s", "c", 3), "o_name": ("name_o", "c", 5)}


@query(f"""WITH nat AS (SELECT n_nationkey AS nk, lower(n_name) AS state, CAST(n_regionkey AS VARCHAR) AS country FROM nation),
s AS (SELECT s_suppkey AS id, s_name AS name, CAST(CAST(round(s_acctbal) AS BIGINT) AS VARCHAR) AS house, state, country, 'city' || nk AS city, state AS addr FROM supplier JOIN nat ON nk = s_nationkey),
p AS (SELECT c_custkey AS id, c_name AS name, CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR) AS house, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE state END AS state, country, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'city' || nk END AS city, state AS addr FROM customer JOIN nat ON nk = c_nationkey),
votes AS (SELECT country, city, any_value(state) AS guess FROM (SELECT country, city, state FROM s UNION ALL SELECT country, city, state FROM p) WHERE city <> '' AND state <> '' GROUP BY ALL HAVING count(*) >= 3),
pk AS (SELECT p.*, CASE WHEN state <> '' THEN state ELSE coalesce(guess, '?') END AS key FROM p LEFT JOIN votes ON votes.country = p.country AND votes.city = p.city),
{_view_sql("name", "name", 0.05)}, {_view_sql("addr", "house || ' ' || addr", 0.01)}, {_view_sql("name_addr", "name || ' ' || house || ' ' || city", 0.01)}
SELECT s1, cand, {", ".join(f"max({c}_{leg}) AS {c}_{leg}" for leg in _LEGS for c in ("sim", "rk"))} FROM ({" UNION ALL BY NAME ".join("(" + _rank_sql(leg, *o) + ")" for leg, o in _LEGS.items())}) GROUP BY s1, cand""")
def build_candidates(spark, d):
    """All legs over all countries; a city has one state here, so that one vote decides."""
    return _long(candidates.build_candidates(_places(spark, d, "supplier"), _places(spark, d, "customer")), *[f"rk_{leg}" for leg in _LEGS])


@query()
def rule_tuned(spark, d):
    """What the best of four rules chooses."""
    x = shared.written(pairs(spark, d), "pairs")
    fold = ids(spark, d).select("s1", models.group_fold(F.col("grp")).alias("fold"))
    return rules.apply(rules.tune(x, ids(spark, d), truth(spark, d), fold, rounds=4, depth=3), x)


@query()
def grouped_calibration(spark, d):
    x = pairs(spark, d).withColumn("blank", F.col("cand") % 5 == 0)
    return models.calibrate_by_group(x.where("s1 % 2 = 0"), x, "blank").select("s1", "cand", "blank", F.round("q", 6).alias("q"))


@query("""WITH s AS (SELECT c_mktsegment AS country, CAST(c_nationkey AS VARCHAR) AS state, count(*) AS n FROM customer GROUP BY ALL),
e AS (SELECT *, sum(n) OVER (PARTITION BY country)::DOUBLE / sum(n) OVER () AS share, md5('subset|' || country || '|' || state) AS h FROM s),
k AS (SELECT * FROM e WHERE n <= 400 * share * 1.5),
v AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY country ORDER BY h, state ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 400 * share AS val FROM k),
t AS (SELECT *, coalesce(sum(CASE WHEN val THEN 0 ELSE n END) OVER (PARTITION BY country ORDER BY h, state ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 700 * share AS train FROM v)
SELECT country, state, n, CASE WHEN val THEN 'val' ELSE 'train' END AS subset FROM t WHERE val OR train""")
def state_subsets(spark, d):
    """Whole nations of each segment for validation, then for training."""
    s = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("country"), F.col("c_nationkey").cast("string").alias("state")).agg(F.count("*").alias("n"))
    return E.state_subsets(s, {"val": 400, "train": 700})


@query(f"""WITH {PAIRS} SELECT i.grp AS country, count(*) AS n_s1, round(avg(coalesce(k, 0)), 6) AS mean_matches, round(avg(CASE WHEN k IS NULL THEN 1 ELSE 0 END), 6) AS empty_rate FROM ids i LEFT JOIN (SELECT s1, count(*) AS k FROM pred GROUP BY s1) n ON n.s1 = i.s1 GROUP BY 1""")
def country_report(spark, d):
    return stages.country_report(ids(spark, d).withColumnRenamed("grp", "country"), predicted(spark, d))


@query(f"""WITH {PAIRS} SELECT p.s1, p.cand, p.p, p.y, 'order ' || p.s1 || ' ' || o_orderpriority AS a, p_name || ' | ' || p_type AS b FROM pairs p JOIN orders ON o_orderkey = p.s1 JOIN part ON p_partkey = p.cand WHERE p >= 0.02 AND p < 0.98""")
def pair_band(spark, d):
    left = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", F.lit("order"), "o_orderkey", "o_orderpriority").alias("text"))
    right = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" | ", "p_name", "p_type").alias("text"))
    return models.pair_band(pairs(spark, d), left, right, 0.02, 0.98)


_LOGIT = "ln(greatest(least({0}, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE) / (1 - greatest(least({0}, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE)))"


@query(f"""WITH {PAIRS}, x AS (SELECT s1, cand, p, CASE WHEN cand % 5 > 0 THEN round(p * p, 6) END AS p2, cand % 7 = 0 AS blank, (s1 % 90 - 45)::DOUBLE - p AS ml FROM pairs)
SELECT s1, cand, round({_LOGIT.format("p")}, 9) AS lf_logit, CASE WHEN blank THEN 1.0 ELSE 0.0 END::DOUBLE AS lf_blank, round(greatest(least(ml, 20), -20) / 4, 9) AS lf_model, round(CASE WHEN blank THEN greatest(least(ml, 20), -20) / 4 ELSE 0 END, 9) AS lf_both,
round(CASE WHEN p2 IS NULL THEN p ELSE 0.75::DOUBLE * p2 + 0.25::DOUBLE * p END, 9) AS blended, CASE WHEN blank THEN p ELSE p2 END AS switched FROM x""")
def fusion_features(spark, d):
    """What logistic fusion sees, a blend and a switch of two scores; the model's logit is the difference of two outputs."""
    x = pairs(spark, d).select("s1", "cand", "p", F.when(F.col("cand") % 5 > 0, F.round(F.col("p") * F.col("p"), 6)).alias("p2"), (F.col("cand") % 7 == 0).alias("blank"))
    yes = models.match_logit(F.col("p"), (F.col("s1") % 90 - 45).cast("double"))
    got = models.logit_features(F.col("p"), F.col("blank"), yes)
    return x.select("s1", "cand", *[F.round(c, 9).alias(k) for k, c in got.items()], F.round(models.blended(F.col("p2"), F.col("p")), 9).alias("blended"), models.switched(F.col("blank"), F.col("p"), F.col("p2")).alias("switched"))


@query("""SELECT doc_id, coalesce(trim(text), '') = '' AS blank_a, coalesce(trim(source), '') = '' AS blank_b, coalesce(regexp_extract(text, '([0-9]+)', 1), '') <> '' AND regexp_extract(source || n_chars, '([0-9]+)', 1) <> '' AND regexp_extract(text, '([0-9]+)', 1) <> regexp_extract(source || n_chars, '([0-9]+)', 1) AS conflict,
trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key, doc_id || ' | ' || lang || ' | ' || source AS text FROM documents""")
def address_flags(spark, d):
    """Blank sides, numbers that differ, text signatures and model texts."""
    x = table(spark, d, "documents").withColumn("other", F.concat("source", "n_chars"))
    texts = io.records_text(x.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("name"), F.col("lang").alias("addr"), F.col("source").alias("state")))
    flags = x.select("doc_id", *[c.alias(f"blank_{k}") for k, c in A.blank_flags(F.col("text"), F.col("source")).items()], A.first_number_conflict(F.col("text"), F.col("other")).alias("conflict"), T.text_key(F.col("text")).alias("key"))
    return flags.join(texts.withColumnRenamed("id", "doc_id"), "doc_id")


@query(f"""WITH {PAIRS}, n AS (SELECT p_name AS name_sorted, count(*) AS n_s1_same_name FROM part GROUP BY 1)
SELECT q.s1, q.cand, CASE WHEN t.s1 IS NULL THEN 0 ELSE 1 END AS y, n_s1_same_name FROM pairs q JOIN part ON p_partkey = q.cand JOIN n ON n.name_sorted = p_name LEFT JOIN truth t ON t.s1 = q.s1 AND t.cand = q.cand""")
def labelled_pairs(spark, d):
    """Pairs with labels from the truth, and how many records share the candidate's name."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("cand"), F.col("p_name").alias("name_sorted"))
    rows = X.with_labels(pairs(spark, d).select("s1", "cand"), truth(spark, d).withColumnRenamed("cand", "match"))
    return rows.join(part, "cand").join(X.same_name_counts(part), "name_sorted").select("s1", "cand", "y", "n_s1_same_name")


@query(f"""WITH {PAIRS}, m AS (SELECT coalesce(i.s1, q.s1) AS s1, string_agg(CAST(cand AS VARCHAR), ',' ORDER BY CAST(cand AS VARCHAR)) AS matched FROM ids i LEFT JOIN pred q ON q.s1 = i.s1 GROUP BY 1) SELECT CAST(s1 AS VARCHAR) AS s1, coalesce(matched, '') AS matched FROM m""")
def list_files(spark, d):
    """Match lists written as a file, read again, as long rows and as sets."""
    path = shared.table_path(spark, "lists")
    io.write_lists(D.match_lists(ids(spark, d), predicted(spark, d)), path)
    read = io.read_lists(spark, path)
    long = io.load_truth(read.select("s1", F.array_join("matched", ",").alias("m")), "s1", "m")
    return io.truth_sets(long).select("s1", F.array_join("matches", ",").alias("matched"))


@query("SELECT doc_id, lang FROM documents WHERE source = (SELECT min(source) FROM documents) AND doc_id IN (SELECT item_id FROM benchmark)")
def pushed_scan(spark, d):
    """Two columns of one source's records, for ids of a list."""
    least = table(spark, d, "documents").agg(F.min("source").alias("s")).first().s
    rows = io.scan_records(spark, f"{d}/documents.parquet", ["doc_id", "lang"], least, "source")
    return io.restricted(rows, table(spark, d, "benchmark").select("item_id"), "doc_id")


@query(f"""WITH {PAIRS}, a AS (SELECT s1, cand, p AS sim_name, 0.5::DOUBLE AS sim_dense FROM pairs WHERE cand % 3 > 0), b AS (SELECT s1, cand, round(1 - p, 6) AS sim_dense, s1 % 10 AS rk_dense_f FROM pairs WHERE cand % 2 = 0)
SELECT coalesce(a.s1, b.s1) AS s1, coalesce(a.cand, b.cand) AS cand, a.sim_name, b.sim_dense, b.rk_dense_f FROM a FULL JOIN b ON a.s1 = b.s1 AND a.cand = b.cand""")
def merge_dense(spark, d):
    x = pairs(spark, d)
    cands = x.where("cand % 3 > 0").select("s1", "cand", F.col("p").alias("sim_name"), F.lit(0.5).alias("sim_dense"))
    return B.merge_dense(cands, x.where("cand % 2 = 0").select("s1", "cand", F.round(1 - F.col("p"), 6).alias("sim_dense"), (F.col("s1") % 10).alias("rk_dense_f")))


@query()
def stage2_flow(spark, d):
    """Both model stages from end to end over one third of the orders for each of training, tuning and prediction."""
    with shared.Scratch(spark) as tmp:
        x = tmp.written(pairs(spark, d).withColumns({"f1": F.round((F.col("s1") * 31 + F.col("cand") * 17) % 101 / 101.0, 6), "f2": F.col("p") * F.col("p")}), "pairs")
        rows = [x.where(F.col("s1") % 3 == k) for k in range(3)]
        own = ids(spark, d).where("s1 % 3 = 1").select("s1")
        true = truth(spark, d).where("s1 % 3 = 1")
        one = stages.fit_stage1(rows[0].withColumnRenamed("p", "p0"), rows[1].withColumnRenamed("p", "p0"), ("p0", "f1"), own, true, rounds=6, depth=3)
        scored = [tmp.written(stages.score_stage1(one, r.withColumnRenamed("p", "p0")), "scored") for r in rows]
        names = attrs(spark, d).drop("src")
        fold = own.withColumn("fold", models.group_fold(F.col("s1")))
        two = stages.fit_stage2(scored[0], scored[1], ("p0", "f1"), names, S.jaccard, own, true, fold, seeds=(1, 2, 3), rounds=4, depth=3)
        return shared.written(stages.predict_stage2(two, scored[2], names, S.jaccard), "chosen")


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
s AS (SELECT a.id AS q, b.id AS c, round(list_inner_product(a.vec, b.vec), 6) AS sim FROM v a, v b WHERE a.label < 5 AND b.label >= 5),
f AS (SELECT q, c FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, q, c) AS rk FROM s) WHERE rk <= 10),
r AS (SELECT q, c FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY sim DESC, c, q) AS rk FROM s) WHERE rk <= 3),
t AS (SELECT q, c FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, q, c) AS rk FROM s) WHERE rk <= 25 AND sim >= 0.2), x AS (SELECT f.q IS NOT NULL AS f, r.q IS NOT NULL AS r FROM t LEFT JOIN f ON f.q = t.q AND f.c = t.c LEFT JOIN r ON r.q = t.q AND r.c = t.c)
SELECT leg, found, total, round(found::DOUBLE / total, 6) AS recall FROM (SELECT 'union' AS leg, count(*) FILTER (WHERE f OR r) AS found, count(*) AS total FROM x
UNION ALL SELECT 'rk_dense_f', count(*) FILTER (WHERE f), count(*) FROM x UNION ALL SELECT 'rk_dense_r', count(*) FILTER (WHERE r), count(*) FROM x)""")
def dense_recall(spark, d):
    """How many of the best 25 of each query, at a similarity of 0.2 or more, the dense legs find."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    a, b = v.where("label < 5").drop("label"), v.where("label >= 5").drop("label")
    true = B.dense_topk(a, b, 25).where("sim >= 0.2").select(F.col("q").alias("s1"), F.col("c").alias("cand"))
    return E.blocking_recall(true, B.dense_pairs(B.dense_topk(a, b, 10), B.dense_topk(b, a, 3)), ["rk_dense_f", "rk_dense_r"])
