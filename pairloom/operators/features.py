"""The pair features: one select over rows that hold both sides (a_ and b_ prefixed normalised columns).

A feature is null where a side is null or its ratio is undefined; empty strings have empty token sets. Rows stay as they are: repeated
pairs give repeated rows, an empty table no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S


#: Scores of edit distances: scorer and column of both sides. They are computed together, in one pass to Python.
EDITS = {
    "n_ratio": ("ratio", "name_core"),
    "n_partial": ("partial_ratio", "name_core"),
    "n_tsort": ("token_sort_ratio", "name_core"),
    "n_tset": ("token_set_ratio", "name_core"),
    "n_wratio": ("weighted_ratio", "name_clean"),
    "n_concat_jw": ("jaro_winkler", "name_concat"),
    "n_concat_partial": ("partial_ratio", "name_concat"),
    "a_ratio": ("ratio", "addr_clean"),
    "a_tset": ("token_set_ratio", "addr_clean"),
    "a_tsort": ("token_sort_ratio", "addr_clean"),
    "a_partial": ("partial_ratio", "addr_clean"),
    "st_jw": ("jaro_winkler", "street"),
    "st_tset": ("token_set_ratio", "street"),
    "city_tset": ("token_set_ratio", "city"),
    "city_partial": ("partial_ratio", "city"),
}


def pair_features(rows: DataFrame, keys: tuple[str, ...] = ("s1", "cand")) -> DataFrame:
    """The forty pair features. rows: keys, and for each side name_clean, name_core, name_sorted, name_concat,
    legal, is_domain, addr_clean, addr_nums, house, street, city, state, postcode."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    edits = S.scored_all({name: (kind, a(x), b(x)) for name, (kind, x) in EDITS.items()} | {"x_name_in_addr": ("partial_ratio", b("name_core"), a("addr_clean"))})
    rows = rows.withColumn("__edits", edits)
    on = lambda name: F.col(f"__edits.{name}")
    out = {
        "n_ratio": on("n_ratio"), "n_partial": on("n_partial"), "n_tsort": on("n_tsort"),
        "n_tset": on("n_tset"), "n_wratio": on("n_wratio"), "n_concat_jw": on("n_concat_jw"),
        "n_concat_lev": S.levenshtein_similarity(a("name_concat"), b("name_concat")), "n_concat_partial": on("n_concat_partial"),
        "n_jacc": S.jaccard(a("name_core"), b("name_core")), "n_cont_ab": S.containment(a("name_core"), b("name_core")), "n_cont_ba": S.containment(b("name_core"), a("name_core")),
        "n_len_a": F.length(a("name_core")), "n_len_b": F.length(b("name_core")), "n_ntok_diff": S.token_count_difference(a("name_core"), b("name_core")),
        "n_first_eq": S.first_equal(a("name_core"), b("name_core")), "n_sorted_eq": (a("name_sorted") == b("name_sorted")).cast("int"), "legal_state": S.legal_state(a("legal"), b("legal")),
        "a_ratio": on("a_ratio"), "a_tset": on("a_tset"), "a_tsort": on("a_tsort"), "a_partial": on("a_partial"),
        "a_jacc": S.jaccard(a("addr_clean"), b("addr_clean")), "a_cont_ba": S.containment(b("addr_clean"), a("addr_clean")), "a_len_b": F.length(b("addr_clean")),
        "num_jacc": S.jaccard(a("addr_nums"), b("addr_nums")), "num_cont_ba": S.containment(b("addr_nums"), a("addr_nums")),
        **S.house_features(a("house"), b("house"), b("addr_nums")),
        "st_jw": on("st_jw"), "st_tset": on("st_tset"), "st_empty": S.empty_state(a("street"), b("street")),
        "city_tset": on("city_tset"), "city_partial": on("city_partial"), "state_state": S.presence_state(a("state"), b("state")),
        "pin_state": S.presence_state(a("postcode"), b("postcode")), "x_name_in_addr": on("x_name_in_addr"), "is_domain_b": b("is_domain"),
    }
    return rows.select(*keys, *[c.alias(n) for n, c in out.items()])


def same_name_counts(names: DataFrame) -> DataFrame:
    """name_sorted, n_s1_same_name: how many query records have the name."""
    return names.groupBy("name_sorted").agg(F.count("*").alias("n_s1_same_name"))


def with_labels(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with y: 1 where truth (s1, match) has the pair, else 0."""
    true = truth.where("match is not null").select("s1", F.col("match").alias("cand"), F.lit(1).alias("y")).distinct()
    return pairs.join(true, ["s1", "cand"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def token_idf(names: DataFrame, column: str) -> DataFrame:
    """token, idf = ln((n + 1) / (df + 1)) + 1 over the distinct words of each row."""
    n = names.select(F.count("*").alias("n"))
    tokens = names.select(F.explode(S.token_set(F.col(column))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return tokens.join(F.broadcast(n)).select("token", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weighted_name_compare(pairs: DataFrame, idf: DataFrame, unseen: float) -> DataFrame:
    """pairs (key, a, b): key, weighted Jaccard, cover of a, cover of b, rarest shared weight (null if nothing is shared)."""
    sides = F.explode(F.array_union(S.token_set(F.col("a")), S.token_set(F.col("b")))).alias("token")
    t = pairs.select("key", "a", "b", sides).join(idf, "token", "left")
    w = F.coalesce("idf", F.lit(unseen))
    in_a, in_b = F.array_contains(S.token_set(F.col("a")), F.col("token")), F.array_contains(S.token_set(F.col("b")), F.col("token"))
    total = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    return t.groupBy("key").agg(
        F.round(total(in_a & in_b) / F.sum(w), 6).alias("w_jacc"), F.round(total(in_a & in_b) / F.nullif(total(in_a), F.lit(0.0)), 6).alias("w_cover_a"),
        F.round(total(in_a & in_b) / F.nullif(total(in_b), F.lit(0.0)), 6).alias("w_cover_b"), F.round(F.max(F.when(in_a & in_b, w)), 6).alias("w_rarest"),
    )
