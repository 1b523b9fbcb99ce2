"""Spans of a pattern in a text by built-in functions only: Spark has matches or pieces, but no positions.

All of it is linear in the text and all but linear in the matches: an array that grows inside an
aggregation is copied at each step, so running values are taken in chunks of CHUNK, by three levels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let

SPAN = "array<struct<s:bigint,e:bigint,v:string>>"
CHUNK = 64
#: Characters of a text that windows are cut from together.
PAGE = 256


def _longs(*values: Column) -> Column:
    return F.array(*values).cast("array<bigint>")


def _short_scan(values: Column, op: Callable[[Column, Column], Column], first: Column) -> Column:
    """For each value of a short array what op makes of first and the values before it."""
    start = F.struct(first.cast("long").alias("at"), _longs().alias("out"))
    return F.aggregate(values, start, lambda a, v: F.struct(op(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def scan(values: Column, op: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """For each value of an array of longs what op (associative, 0 as neutral value) makes of all values before it."""
    zero = F.lit(0).cast("long")
    if levels == 0:
        return _short_scan(values, op, zero)

    def chunked(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(CHUNK))
        return let(F.transform(starts, lambda k: F.slice(v, k, F.lit(CHUNK))), lambda chunks: F.flatten(F.zip_with(chunks, scan(F.transform(chunks, lambda c: F.aggregate(c, zero, op)), op, levels - 1), lambda c, base: _short_scan(c, op, base))))

    return let(values, chunked)


def before(values: Column) -> Column:
    """Sums of the values before each value."""
    return scan(values, lambda a, x: a + x)


def greatest_before(values: Column) -> Column:
    """The greatest of the values before each value, 0 at least."""
    return scan(values, lambda a, x: F.greatest(a, x))


def find(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array of (s, e, v), code points, end exclusive.

    The pieces that split() leaves and the matches alternate, so running sums of their lengths are
    the positions. The pattern must not match the empty string.
    """
    none = F.array().cast(SPAN)

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, F.lit(pattern), -1), F.lit(1), F.size(hits)), lambda p: F.length(p).cast("long"))
        pairs = F.zip_with(gaps, hits, lambda p, v: F.struct(p.alias("p"), F.length(v).cast("long").alias("n"), v.alias("v")))
        spans = lambda z: F.zip_with(before(F.transform(z, lambda x: x["p"] + x["n"])), z, lambda at, x: F.struct((at + x["p"]).alias("s"), (at + x["p"] + x["n"]).alias("e"), x["v"].alias("v")))
        return F.when(F.size(hits) > 0, let(pairs, spans)).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def pages(text: Column) -> Column:
    """The text in pages of PAGE characters, from which window() cuts without walking through the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PAGE}}}"), F.lit(0))


def window(paged: Column, begin: Column, size: int) -> Column:
    """Up to size (at most PAGE) characters of a paged text from begin on; begin may be negative, what lies before the text is left out."""
    first = F.greatest(begin, F.lit(0))
    at = F.floor(first / PAGE).cast("int")
    two = F.concat(F.coalesce(F.get(paged, at), F.lit("")), F.coalesce(F.get(paged, at + 1), F.lit("")))
    return F.substring(two, (first - at * PAGE + 1).cast("int"), F.greatest(F.lit(0), size + F.least(begin, F.lit(0))).cast("int"))


def apart(spans: Column, base: Column) -> Column:
    """Those of spans that overlap none of base; both are arrays of structs with s and e. One sort and one scan."""
    # a base span stands at its start, another at its end: what precedes it there starts before its end
    marks = F.concat(F.transform(base, lambda b: F.struct(b["s"].alias("at"), F.lit(1).alias("o"), b["e"].alias("e"), F.lit(None).cast(SPAN[6:-1]).alias("x"))),
                     F.transform(spans, lambda x: F.struct(x["e"].alias("at"), F.lit(0).alias("o"), F.lit(0).cast("long").alias("e"), x.alias("x"))))
    kept = lambda m: F.transform(F.filter(F.zip_with(m, greatest_before(F.transform(m, lambda y: y["e"])), lambda y, far: F.struct(y["x"].alias("x"), far.alias("far"))), lambda z: z["x"].isNotNull() & (z["far"] <= z["x"]["s"])), lambda z: z["x"])
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), let(F.array_sort(marks), kept)).otherwise(spans)


def labelled(spans: Column, kind: str, order: int) -> Column:
    """Spans as structs that sort by start, then by the kinds' order."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("k")))


def joined(spans: Column) -> Column:
    """kind:start:end of sorted labelled spans, comma-joined."""
    text = F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string")))
    return F.array_join(text, ",")


def find_sql(source: str, pattern: str) -> str:
    """DuckDB: rows (doc_id, t, s, e, v) of all matches in a relation (doc_id, t)."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, t, s, s + length(v) AS e, v FROM (
  SELECT doc_id, t, h[i] AS v, CAST(list_sum(list_transform(p[1:i], lambda q: length(q))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda q: length(q))), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS h, string_split_regex(t, '{p}') AS p FROM {source} WHERE regexp_matches(t, '{p}'))))"""
