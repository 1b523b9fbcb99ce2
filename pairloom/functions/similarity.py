"""Similarity scalars: sets, numbers and states as column expressions, the Indel and Jaro family as Arrow UDFs.

An undefined similarity (a ratio over an empty set) is null, never NaN. Token sets of '' are empty.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def token_set(s: Column) -> Column:
    """Distinct words of a string."""
    return F.array_distinct(F.filter(F.split(F.coalesce(s, F.lit("")), " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    x, y = token_set(a), token_set(b)
    return F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0))


def containment(a: Column, b: Column) -> Column:
    """Share of a's words that b has."""
    x, y = token_set(a), token_set(b)
    return F.size(F.array_intersect(x, y)) / F.nullif(F.size(x), F.lit(0))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance over the longer length; two empty strings are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def token_count_difference(a: Column, b: Column) -> Column:
    return F.size(token_set(a)) - F.size(token_set(b))


def first_equal(a: Column, b: Column) -> Column:
    return (F.split_part(a, F.lit(" "), F.lit(1)) == F.split_part(b, F.lit(" "), F.lit(1))).cast("int")


def legal_state(a: Column, b: Column) -> Column:
    """0 both empty, 1 one empty, 2 equal, 3 overlap, 4 disjoint."""
    return F.when((a == "") & (b == ""), 0).when((a == "") | (b == ""), 1).when(a == b, 2).when(F.arrays_overlap(token_set(a), token_set(b)), 3).otherwise(4)


def presence_state(a: Column, b: Column) -> Column:
    """0 one is missing, 1 equal, 2 different."""
    return F.when((a == "") | (b == ""), 0).when(a == b, 1).otherwise(2)


def empty_state(a: Column, b: Column) -> Column:
    return (a == "").cast("int") + 2 * (b == "").cast("int")


def short_number(x: Column) -> Column:
    """The number of a string of up to nine digits, else null."""
    return F.when(x.rlike("^[0-9]{1,9}$"), x.cast("long"))


def house_features(a: Column, b: Column, b_nums: Column, numbers: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """Equality, absence, prefix or suffix, difference (both under ten digits), and whether b's numbers hold a's.

    numbers: short_number() of a and b, where the caller has them already; else they are read from the strings, for every pair anew.
    """
    both = (a != "") & (b != "")
    na, nb = numbers or (short_number(a), short_number(b))
    part = F.startswith(a, b) | F.startswith(b, a) | F.endswith(a, b) | F.endswith(b, a)
    return {
        "h_eq": (both & (a == b)).cast("int"),
        "h_absent": (a == "").cast("int") + (b == "").cast("int"),
        "h_pref": (both & (a != b) & part).cast("int"),
        "h_diff": F.abs(na - nb),
        "h_in_nums": ((a != "") & F.array_contains(token_set(b_nums), a)).cast("int"),
    }


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit for each character of a."""
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _codes(texts: list[str], width: int, pad: int) -> np.ndarray:
    """Code points of texts of at most width characters, one column for each place, filled up with pad."""
    raw = "".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le")
    out = np.frombuffer(raw, np.uint32).reshape(len(texts), width).copy()
    out[np.arange(width) >= np.array([len(t) for t in texts])[:, None]] = pad
    return out.T


def _lcs_batch(xs: list[str], ys: list[str]) -> np.ndarray:
    """_lcs of many pairs at once: the same bits, of all pairs whose shorter text has up to 63 characters, in one column."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(xs, ys)]
    out = np.zeros(len(pairs), np.int64)
    order = sorted((len(x), len(y), k) for k, (x, y) in enumerate(pairs) if x)
    for lx, _, k in order:
        if lx > 63:
            out[k] = _lcs(*pairs[k])
    short = [k for lx, _, k in order if lx <= 63]
    for s in range(0, len(short), 2_048):  # pairs of like lengths
        part = short[s : s + 2_048]
        a, b = [pairs[k][0] for k in part], [pairs[k][1] for k in part]
        ca, cb = _codes(a, max(map(len, a)), 0xFFFFFFFF), _codes(b, max(map(len, b)), 0xFFFFFFFE)
        bits, row = np.uint64(1) << np.arange(len(ca), dtype=np.uint64), np.full(len(part), 0xFFFFFFFFFFFFFFFF, np.uint64)
        for c in cb:
            hit = row & ((ca == c) * bits[:, None]).sum(axis=0, dtype=np.uint64)
            row = (row + hit) | (row - hit)
        size = np.array([len(x) for x in a])
        out[part] = size - np.bitwise_count(row & ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)))
    return out


def _ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * _lcs(a, b) / total


def _ratios(xs: list[str], ys: list[str]) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(xs, ys)], np.int64)
    return np.where(total == 0, 100.0, 200.0 * _lcs_batch(xs, ys) / np.maximum(total, 1))


def _partial(a: str, b: str) -> float:
    """Best ratio of the shorter string with any window of its length, or shorter ones at the ends.

    Windows are tried by the characters that they share with the string at all, and only while those allow a better ratio.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    n, need, held, shared, bounds = len(a), Counter(a), Counter(), 0, []
    for s in range(1 - n, len(b)):
        if s + n <= len(b):  # a character enters
            c = b[s + n - 1]
            held[c] += 1
            shared += held[c] <= need[c]
        if s > 0:  # and one leaves
            c = b[s - 1]
            shared -= held[c] <= need[c]
            held[c] -= 1
        bounds.append((-200.0 * shared / (n + min(len(b), s + n) - max(0, s)), s))
    best = 0.0
    for bound, s in sorted(bounds):
        if -bound <= best:
            break
        best = max(best, _ratio(a, b[max(0, s) : s + n]))
    return best


def _each(one):
    return lambda xs, ys: np.array([one(x, y) for x, y in zip(xs, ys)], np.float64)


def _token_sorts(xs: list[str], ys: list[str]) -> np.ndarray:
    return _ratios(*([" ".join(sorted(t.split())) for t in side] for side in (xs, ys)))


def _token_sets(xs: list[str], ys: list[str]) -> np.ndarray:
    """Of the shared words, and of each side's words after them, the best ratio; a side without words gives 0."""
    sets = [(set(x.split()), set(y.split())) for x, y in zip(xs, ys)]
    both = [" ".join(sorted(x & y)) for x, y in sets]
    left = [f"{c} {' '.join(sorted(x - y))}".strip() for c, (x, y) in zip(both, sets)]
    right = [f"{c} {' '.join(sorted(y - x))}".strip() for c, (x, y) in zip(both, sets)]
    common = np.array([bool(c) for c in both], bool)
    best = np.maximum(_ratios(left, right), np.where(common, np.maximum(_ratios(both, left), _ratios(both, right)), 0.0))
    within = np.array([bool(x & y) and (x <= y or y <= x) for x, y in sets], bool)
    empty = np.array([not x or not y for x, y in sets], bool)
    return np.where(empty, 0.0, np.where(within, 100.0, best))


def _weighted(xs: list[str], ys: list[str]) -> np.ndarray:
    """Ratio or discounted token ratio; where one string is much longer, discounted partial ratios instead."""
    whole, best = _ratios(xs, ys), 0.95 * np.maximum(_token_sorts(xs, ys), _token_sets(xs, ys))
    out = np.maximum(whole, best)
    for k, (a, b) in enumerate(zip(xs, ys)):
        if not a or not b:
            out[k] = 0.0
            continue
        shape = max(len(a), len(b)) / min(len(a), len(b))
        if shape >= 1.5:
            scale = 0.9 if shape <= 8 else 0.6
            sorted_a, sorted_b = (" ".join(sorted(t.split())) for t in (a, b))
            tokens = _partial(sorted_a, sorted_b)
            shared = 100.0 if set(a.split()) & set(b.split()) else tokens
            out[k] = max(whole[k], scale * _partial(a, b), 0.95 * scale * max(tokens, shared))
    return out


def _jaro_winkler(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for k, c in enumerate(a):
        for j in range(max(0, k - reach), min(len(b), k + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, (c for c, u in zip(b, used) if u))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


#: Scorers of many pairs at once: lists of strings to an array.
SCORERS = {"ratio": _ratios, "partial_ratio": _each(_partial), "token_sort_ratio": _token_sorts, "token_set_ratio": _token_sets, "weighted_ratio": _weighted, "jaro_winkler": _each(_jaro_winkler)}


#: Scores that a Python worker remembers, of each scorer: so many pairs, then it forgets them all.
MEMO_PAIRS = 50_000
_memo: dict[str, dict] = {}


def _batch(kind: str, x: pa.Array, y: pa.Array) -> pa.Array:
    """Scores of two string arrays: different pairs are computed once, and not again while the worker remembers them."""
    a, b = x.dictionary_encode(), y.dictionary_encode()
    left, right = (c.indices.fill_null(-1).to_numpy().astype(np.int64) for c in (a, b))
    wide = max(1, len(b.dictionary))
    null = (left < 0) | (right < 0)
    codes, at = np.unique(np.where(null, -1, left * wide + right), return_inverse=True)
    names, others = a.dictionary.to_pylist(), b.dictionary.to_pylist()
    pairs = [(names[c // wide], others[c % wide]) if c >= 0 else None for c in codes.tolist()]
    held = _memo.setdefault(kind, {})
    if len(held) > MEMO_PAIRS:
        held.clear()
    new = [p for p in pairs if p is not None and p not in held]
    got = dict(zip(new, SCORERS[kind]([p for p, _ in new], [p for _, p in new]).tolist())) if new else {}
    out = np.array([0.0 if p is None else got[p] if p in got else held[p] for p in pairs], np.float64)
    held.update(got)
    return pa.array(out[at], pa.float64(), mask=null)


def scored_all(scores: dict[str, tuple[str, Column, Column]]) -> Column:
    """A struct of several of SCORERS, each over its own two string columns, by one pass of Arrow batches to Python.

    A score is null where either string is.
    """
    names, kinds = list(scores), [kind for kind, _, _ in scores.values()]

    @F.arrow_udf(", ".join(f"`{name}` double" for name in names))
    def of(*columns: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([_batch(kind, columns[2 * k], columns[2 * k + 1]) for k, kind in enumerate(kinds)], names=names)

    return of(*(c for _, a, b in scores.values() for c in (a, b)))


def scored(kind: str, a: Column, b: Column) -> Column:
    """One of SCORERS."""
    return scored_all({"score": (kind, a, b)})["score"]
