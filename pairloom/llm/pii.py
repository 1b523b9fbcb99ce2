"""Personal data in texts: patterns propose spans, check sums confirm them, context words score them.

Everything is built-in column expressions over one row: no shuffle, no Python.

Base kinds: email, ip, card, phone, as the query's contract has them. The method adds

* iban: two capital letters, two digits, 11 to 30 capitals or digits, valid modulo 97;
* ssn: ddd-dd-dddd, kept only where its score reaches KEEP (a context word stands near);
* phone_ctx: a run of digits, marks and spaces that is nine to fifteen digits in three to five groups, likewise.

Score of a span: BASE of its kind, and CONTEXT more if a word of the kind's list stands within WINDOW
characters before it, or within AFTER after it; at most 1.

Defined results. Null text is empty: no spans. Overlapping spans of different kinds are all reported.
Patterns are written so that no text makes them backtrack without bound: runs are taken whole
(possessively), and may begin only where a run begins or a match ended; positions, context and order take
time in proportion to text and matches (spans). Extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, spans

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: A whole run of what numbers are written with; its last digit or bracket ends the span, which must have the form GROUPS.
LOCAL_PHONE = r"[0-9+(][0-9+().\x20-]*+"
GROUPS = r"^\(?[0-9]{2,4}\)?([\x20.-][0-9]{2,4}){2,4}$"
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "phone_ctx")
#: Score of a confirmed span without context, by kind; what a context word adds; what kinds without a check sum need.
BASE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "phone_ctx": 0.3}
CONTEXT, KEEP, WINDOW, AFTER = 0.3, 0.6, 40, 20
WORDS = {
    "email": "e-?mail|contact|write|address",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|master|amex|credit|payment|pay",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|bank|account|transfer",
    "ssn": "ssn|social security|tax id|taxpayer",
    "phone_ctx": "phone|call|tel|mobile|fax",
}


def luhn(digits: Column) -> Column:
    """Of a string of digits whether its Luhn sum is a multiple of ten."""
    last = F.reverse(F.split(digits, ""))
    total = F.aggregate(
        F.transform(last, lambda d, i: F.when(i % 2 == 1, F.try_element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)).otherwise(d.cast("int"))),
        F.lit(0), lambda a, x: a + x,
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the number of an IBAN leaves 1 modulo 97."""
    chars = F.split(F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4)), "")
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(c.cast("int"))
    rest = F.aggregate(chars, F.lit(0), lambda a, c: F.when(c >= "A", a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97)
    return rest == 1


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _part_ok(v: Column) -> Column:
    """An address part of at most 255, leading zeros allowed."""
    bare = F.regexp_replace(v, "^0+(?=[0-9])", "")
    return F.when(F.length(bare) > 3, F.lit(False)).otherwise(bare.cast("int") <= 255)


def _within(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


CONFIRM = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _part_ok),
    "card": lambda v: F.when(_within(F.length(_digits(v)), 14, 19), luhn(_digits(v))).otherwise(F.lit(False)),
    "phone": lambda v: _within(F.length(_digits(v)), 10, 15),
    "iban": mod97,
    "ssn": lambda v: ~v.rlike("^(000|666|9)|-00-|-0000$"),
    "phone_ctx": lambda v: v.rlike(GROUPS) & _within(F.length(_digits(v)), 9, 15),
}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN, "phone_ctx": LOCAL_PHONE}
#: What a text must hold for a pattern to be tried at all.
HINT = {"email": "@", "ip": None, "card": None, "phone": "+", "iban": None, "ssn": "-", "phone_ctx": None}


def near(kind: str) -> str:
    """The pattern of a kind's context words, for text in lower case."""
    return rf"(?:^|[^a-z0-9_])(?:{WORDS[kind]})(?:$|[^a-z0-9_])"


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _score(paged: Column, span: Column, kind: str) -> Column:
    """Base and context; the windows lie in the whole text around the span."""
    around = (spans.window(paged, span["s"] - WINDOW, WINDOW), spans.window(paged, span["e"], AFTER))
    hit = functools.reduce(Column.__or__, [_lower(w).rlike(near(kind)) for w in around])
    return F.least(F.lit(1.0), F.lit(BASE[kind]) + F.when(hit, CONTEXT).otherwise(0.0))


def _trimmed(span: Column) -> Column:
    """A run without what follows its last digit or bracket."""
    v = F.regexp_extract(span["v"], r"^(.*[0-9)])", 1)
    return F.struct(span["s"].alias("s"), (span["s"] + F.length(v)).alias("e"), v.alias("v"))


def _of_kind(whole: Column, digits: Column, order: int, kind: str) -> Column:
    """The confirmed spans of one kind."""
    hint = F.contains(whole, F.lit(HINT[kind])) if HINT[kind] else F.lit(True)
    may = hint if kind == "email" else hint & digits
    hits = F.when(may, spans.find(whole, PATTERNS[kind])).otherwise(F.array().cast(spans.SPAN))
    hits = F.transform(hits, _trimmed) if kind == "phone_ctx" else hits
    return spans.labelled(F.filter(hits, lambda x: CONFIRM[kind](x["v"])), kind, order)


def _scored(whole: Column, found: Column) -> Column:
    """Confirmed spans of all kinds with their scores; kinds without a check sum only from KEEP on."""

    def all_of(paged: Column) -> Column:
        score = lambda x: functools.reduce(lambda c, k: c.when(x["k"] == k, _score(paged, x, k)), KINDS, F)
        each = F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["e"].alias("e"), x["k"].alias("k"), F.round(score(x), 2).alias("score")))
        return F.filter(each, lambda x: (x["score"] >= KEEP) | ~x["k"].isin("ssn", "phone_ctx"))

    none = F.array().cast("array<struct<s:bigint,o:int,e:bigint,k:string,score:double>>")
    return F.when(F.size(found) > 0, spans.let(spans.pages(whole), all_of)).otherwise(none)


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with pii: array of (s, o, e, k, score) sorted by start, then kind."""
    whole = common.whole_text(text)
    digits = whole.rlike("[0-9]")
    found = F.concat(*[_of_kind(whole, digits, o, k) for o, k in enumerate(KINDS)])
    return docs.withColumn("pii", spans.let(found, lambda f: F.array_sort(_scored(whole, f))))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: personal data of all documents."""
    got = find_pii(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii", lambda x: x["k"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda x: x["o"] < 4)
    scores = F.array_join(F.transform("pii", lambda x: x["score"].cast("string")), ",")
    return got.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(spans.joined(base), 256).alias("base_sha256"), spans.joined(F.col("pii")).alias("spans"), scores.alias("scores"))


def _score_sql(kind: str) -> str:
    near_sql = near(kind)
    lower = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    ahead = lower.format(f"substring(t, CAST(greatest(s - {WINDOW}, 0) AS BIGINT) + 1, CAST(s - greatest(s - {WINDOW}, 0) AS BIGINT))")
    behind = lower.format(f"substring(t, e + 1, {AFTER})")
    return f"least(1.0::DOUBLE, round({BASE[kind]}::DOUBLE + CASE WHEN regexp_matches({ahead}, '{near_sql}') OR regexp_matches({behind}, '{near_sql}') THEN {CONTEXT}::DOUBLE ELSE 0 END, 2))"


def _kind_sql(kind: str, order: int, pattern: str, confirm: str, cut: str = "") -> str:
    found = f"({spans.find_sql('d', pattern)})"
    if cut:
        found = f"(SELECT doc_id, t, s, s + length(w) AS e, w AS v FROM (SELECT *, regexp_extract(v, '{cut}', 1) AS w FROM {found}))"
    return f"SELECT doc_id, s, e, {order} AS o, '{kind}' AS k, {_score_sql(kind)} AS score FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS g FROM {found}) WHERE {confirm}"


_LUHN = "list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN (length(g) - i) % 2 = 0 THEN CAST(g[i] AS INT) ELSE CAST(g[i] AS INT) * 2 - CASE WHEN CAST(g[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_MOD97 = "list_reduce(list_transform(string_split(v[5:] || v[1:4], ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE CAST(c AS INT) END), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97, 0) = 1"
OP2_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (
{_kind_sql("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE")}
UNION ALL {_kind_sql("ip", 1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(nullif(ltrim(x, '0'), '') AS INT), 0) > 255)) = 0")}
UNION ALL {_kind_sql("card", 2, r"[0-9](?:[\x20-]?[0-9])+", f"length(g) BETWEEN 14 AND 19 AND {_LUHN}")}
UNION ALL {_kind_sql("phone", 3, PHONE, "length(g) BETWEEN 10 AND 15")}
UNION ALL {_kind_sql("iban", 4, "[A-Za-z0-9]+", f"regexp_full_match(v, '[A-Z][A-Z][0-9][0-9][A-Z0-9]{{{{11,30}}}}') AND {_MOD97}").replace("{{", "{").replace("}}", "}")}
UNION ALL {_kind_sql("ssn", 5, "[0-9-]+", "regexp_full_match(v, '[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]') AND NOT regexp_matches(v, '^(000|666|9)|-00-|-0000$')")}
UNION ALL {_kind_sql("phone_ctx", 6, r"[0-9+(][0-9+().\x20-]*", f"regexp_matches(v, '{GROUPS}') AND length(g) BETWEEN 9 AND 15", r"^(.*[0-9)])")}),
b AS (SELECT * FROM a WHERE k NOT IN ('ssn', 'phone_ctx') OR score >= {KEEP}),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE o = 0) AS n_email, count(*) FILTER (WHERE o = 1) AS n_ip, count(*) FILTER (WHERE o = 2) AS n_card, count(*) FILTER (WHERE o = 3) AS n_phone,
         string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (WHERE o < 4) AS base, string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, o) AS scores
  FROM b GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN g USING (doc_id)
"""
