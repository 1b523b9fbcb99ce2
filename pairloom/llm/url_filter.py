"""URL filters: fixed rules, and trust and distrust propagated over the graph of hosts.

Method. Hosts are the vertices; edges are the absolute links of pages, and both directions between a host and
the nearest domain above it that is a host of the graph too. Personalised PageRank spreads trust from trusted seeds along edges, and distrust
from blocked seeds against them (who links to bad hosts is suspect). A host is blocked if its
distrust exceeds RATIO times its trust. Seeds are the hosts of pages that an allow or block rule decides.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's path; of several
the longest wins, then the first in order. What no rule decides, the host's verdict does; hosts that
neither score reaches are allowed.

Every round joins one written table of scores to the normalised edges and adds up partial sums by
destination. The mass that hosts without onward edges hold returns to the seeds, so that trust and distrust both
sum to one and can be compared. Rounds end when neither score moves by more than TOLERANCE in all (its sum of
changes), at the latest after ROUNDS; only these sums reach the driver. Rules are met per distinct host, whose suffixes are at
most its labels. A domain above any share of the hosts, and a host with any share of the links, are dealt into
parts (common.hot_join). All tables of a run but its result are deleted at its end.

Defined results. Null urls and urls without :// have empty host and path, and are allowed. Null or empty html has no links.
Repeated pages give repeated rows. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, RATIO, TOLERANCE, ROUNDS = 0.85, 1.0, 1e-3, 60
#: Rule tables of up to so many rows are broadcast.
BROADCAST_RULES = 100_000
#: An edge to or from the parent domain counts this much beside an edge by links.
PARENT_WEIGHT = 0.5
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_rules(hosts: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Of distinct hosts the rules that fit them: host, rules (array of path, rule, verdict; longest first)."""
    spark = hosts.sparkSession
    table = spark.createDataFrame([(h, p, h + p, v, k) for k, (h, p, v) in enumerate(rules)], "suffix string, path string, rule string, verdict string, k int")
    suffixes = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("suffix"))
    fit = suffixes.join(F.broadcast(table), "suffix") if len(rules) <= BROADCAST_RULES else common.hot_join(suffixes, table, ["suffix"], "host")
    order = F.array_sort(F.collect_list(F.struct((-F.length("rule")).alias("o"), "k", "path", "rule", "verdict")))
    return fit.groupBy("host").agg(order.alias("rules"))


def host_edges(pages: DataFrame, tmp: common.Scratch) -> DataFrame:
    """Edges (src, dst, w) between different hosts of pages (host, html): one for each pair, links and parents added up."""
    to = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, string.ascii_uppercase, string.ascii_lowercase))))
    links = pages.where("host <> ''").select(F.col("host").alias("src"), to.alias("dst")).where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    links = tmp.written(links, "links")
    hosts = tmp.written(pages.where("host <> ''").select("host").union(links.select("dst")).distinct(), "hosts")
    above = tmp.written(hosts.select("host", F.posexplode(_suffixes(F.col("host"))).alias("k", "parent")).where("k > 0"), "above")
    within = common.hot_join(above, hosts.select(F.col("host").alias("parent")), ["parent"], "host")
    parents = tmp.written(within.groupBy("host").agg(F.min_by("parent", "k").alias("parent")), "parents")
    both = parents.select(F.col("host").alias("src"), F.col("parent").alias("dst")).unionByName(parents.select(F.col("parent").alias("src"), F.col("host").alias("dst")))
    every = links.unionByName(both.withColumn("w", F.lit(PARENT_WEIGHT)))
    return every.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, tmp: common.Scratch, rounds: int = ROUNDS, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """Scores: host, trust, distrust. edges (src, dst, w), a written table; seeds (host, kind) with kind trust or distrust.

    trust follows edges, distrust goes against them; both start at their seeds, in equal shares, and
    return there with probability 1 - damping, or where a host has no onward edge.
    """
    forth = edges.select("src", "dst", "w", F.lit("trust").alias("kind"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", F.lit("distrust").alias("kind"))
    flow, key = forth.unionByName(back), ["src", "kind"]
    out = tmp.written(flow.groupBy(*key).agg(F.sum("w").alias("total"), F.count("*").alias("__n")), "out")
    counts, n = out.select(*key, "__n"), flow.count()
    flow = common.hot_join(flow, out.drop("__n"), key, "dst", counts=counts, total=n)
    hot = common.hot_keys(counts, key, n)
    parts = F.coalesce("__parts", F.lit(1))
    flow = flow if hot is None else flow.join(F.broadcast(hot), key, "left")
    part = F.lit(0) if hot is None else F.pmod(F.xxhash64("dst"), parts).cast("int")
    flow = tmp.written(flow.select("src", "dst", "kind", (F.col("w") / F.col("total") * damping).alias("share"), part.alias("part")), "flow")
    seeds = seeds.distinct()
    start = seeds.join(seeds.groupBy("kind").agg(F.count("*").alias("m")), "kind").select("host", "kind", (1 / F.col("m")).alias("s"))
    start = tmp.written(start, "seeds")
    none = start.select("host", "kind", F.lit(0.0).alias("r")).limit(0)

    def ranks(moved: DataFrame, mass: dict[str, float]) -> DataFrame:
        """What was moved, and at the seeds what was not."""
        left = F.create_map(*[F.lit(x) for k in ("trust", "distrust") for x in (k, 1.0 - mass.get(k, 0.0))])
        return moved.unionByName(start.select("host", "kind", (F.col("s") * left[F.col("kind")]).alias("r")))

    moved, mass = none, {}
    for k in range(rounds):
        at = ranks(moved, mass).withColumnRenamed("host", "src")
        at = at.withColumn("part", F.lit(0)) if hot is None else at.join(F.broadcast(hot), key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
        next_ = flow.join(at, [*key, "part"]).groupBy(F.col("dst").alias("host"), "kind").agg(F.sum(F.col("share") * F.col("r")).alias("r"))
        next_ = tmp.written(next_, f"ranks{k}")
        both = next_.select("host", "kind", "r", F.lit(0.0).alias("old")).unionByName(moved.select("host", "kind", F.lit(0.0).alias("r"), F.col("r").alias("old")))
        sums = both.groupBy("host", "kind").agg(F.sum("r").alias("r"), F.sum("old").alias("old")).groupBy("kind").agg(F.sum("r").alias("mass"), F.sum(F.abs(F.col("r") - F.col("old"))).alias("change")).collect()
        moved, mass = next_, {r.kind: r.mass for r in sums}
        tmp.drop(f"ranks{k - 1}")
        if all(r.change <= tolerance for r in sums):
            break
    sides = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("r"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")]
    return ranks(moved, mass).groupBy("host").agg(*sides)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust."""
    with common.Scratch(pages.sparkSession) as tmp:
        rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
        pairs = tmp.written(rows.select("page_id", "host", "path"), "pages")
        counts = tmp.written(pairs.groupBy("host").agg(F.count("*").alias("__n")), "counts")
        ruled = tmp.written(host_rules(counts.select("host"), rules), "rules")
        with_rules = common.hot_join(pairs, ruled, ["host"], "page_id", "left", counts=counts, total=pairs.count())
        best = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
        judged = tmp.written(with_rules.select("page_id", "host", "path", best["rule"].alias("rule"), best["verdict"].alias("by_rule")), "judged")
        kind = F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust").alias("kind")
        seeds = judged.where("by_rule is not null").select("host", kind)
        edges = tmp.written(host_edges(rows, tmp), "edges")
        scores = tmp.written(propagate(edges, seeds, tmp), "scores")
        got = common.hot_join(judged, scores, ["host"], "page_id", "left", counts=counts, total=pairs.count())
        got = got.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
        method = F.when(F.col("distrust") > RATIO * F.col("trust"), "block").otherwise("allow")
        return common.written(got.select("page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "trust", "distrust"), "verdicts")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: verdicts on the urls of all pages."""
    return judge(common.read_table(spark, sf_dir, "pages")).drop("trust", "distrust")


def _sql(rounds: int = 40) -> str:
    """DuckDB: the same verdicts, by a fixed number of rounds that leaves less than a part in a thousand of the start."""
    lower = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    rules = ", ".join(f"({k}, '{h}', '{p}', '{v}')" for k, (h, p, v) in enumerate(RULES))
    link, steps = LINK.replace("'", "''"), ["r0 AS MATERIALIZED (SELECT host, kind, s AS r FROM start)"]
    for k in range(1, rounds):
        moved = f"SELECT f.dst AS host, f.kind, sum({DAMPING}::DOUBLE * f.w / o.total * r.r) AS r FROM flow f JOIN o ON o.src = f.src AND o.kind = f.kind JOIN r{k - 1} r ON r.host = f.src AND r.kind = f.kind GROUP BY ALL"
        steps.append(f"m{k} AS MATERIALIZED ({moved}), r{k} AS MATERIALIZED (SELECT host, kind, sum(r) AS r FROM (SELECT * FROM m{k} UNION ALL SELECT host, s.kind, s * (1 - coalesce(t.t, 0)) FROM start s LEFT JOIN (SELECT kind, sum(r) AS t FROM m{k} GROUP BY kind) t ON t.kind = s.kind) GROUP BY ALL)")
    return f"""WITH p AS MATERIALIZED (
  SELECT page_id, {lower.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages),
rules(k, h, p, v) AS (VALUES {rules}),
j AS MATERIALIZED (
  SELECT page_id, host, path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS v
  FROM p LEFT JOIN rules r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY ALL),
l AS MATERIALIZED (
  SELECT src, dst, count(*)::DOUBLE AS w FROM (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda h: {lower.format("h")}))) AS dst FROM p WHERE host <> '') WHERE src <> dst AND dst <> '' GROUP BY ALL),
hosts AS MATERIALIZED (SELECT DISTINCT host FROM p WHERE host <> '' UNION SELECT dst FROM l),
up AS MATERIALIZED (SELECT a.host, arg_max(b.host, length(b.host)) AS parent FROM hosts a JOIN hosts b ON ends_with(a.host, '.' || b.host) GROUP BY a.host),
e AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM l UNION ALL SELECT host, parent, {PARENT_WEIGHT} FROM up UNION ALL SELECT parent, host, {PARENT_WEIGHT} FROM up) GROUP BY ALL),
flow AS MATERIALIZED (SELECT src, dst, w, 'trust' AS kind FROM e UNION ALL SELECT dst, src, w, 'distrust' FROM e),
o AS MATERIALIZED (SELECT src, kind, sum(w) AS total FROM flow GROUP BY ALL),
start AS MATERIALIZED (SELECT host, kind, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS s FROM (SELECT DISTINCT host, CASE v WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind FROM j WHERE v IS NOT NULL)),
{", ".join(steps)},
x AS (SELECT host, coalesce(sum(r) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(r) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM r{rounds - 1} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(v, CASE WHEN coalesce(distrust, 0) > {RATIO} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN x ON x.host = j.host
"""


OP8_SQL = _sql()
