"""Exact and near duplicates against brute force."""

import collections
import hashlib
import pathlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.llm import common, exact_dedup, minhash

SPACE = r"[\x20\x09-\x0D]+"


def exact_rows(df):
    return [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()]


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for doc, text in rows:
        groups[re.sub(SPACE, " ", text or "")].append(doc)
    out = []
    for text, docs in groups.items():
        keep = min((d for d in docs if d is not None), default=None)
        out += [(d, keep, len(docs), hashlib.sha256(text.encode()).hexdigest()) for d in docs]
    return out


@pytest.mark.parametrize("bound", [exact_dedup.MAX_GROUP_BYTES, 1])
def test_exact_equals_brute_force(spark, data, bound):
    docs = common.read_table(spark, data, "documents")
    got = exact_rows(exact_dedup.exact_duplicates(docs, bound))
    want = brute_exact([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(x[:3] + x[4:] for x in got) == sorted(want)
    assert all(kept == (doc == keep) for doc, keep, _, kept, _ in got)


@pytest.mark.parametrize("bound", [exact_dedup.MAX_GROUP_BYTES, 1])
def test_exact_odd_rows(odd, bound):
    got = exact_rows(exact_dedup.exact_duplicates(odd, bound))
    want = brute_exact([(r.doc_id, r.text) for r in odd.collect()])
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((x[:3] + x[4:] for x in got), key=key) == sorted(want, key=key)
    assert sum(x[3] for x in got) == len({x[4] for x in got})  # one row of each class stays


def test_one_text_in_every_block(spark):
    """A third of all rows, in 40 partitions, is one text; its class has ended and is dealt into parts."""
    rows = [(k, "the common text" if k % 3 == 0 else f"text {k % 70}") for k in range(360)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    folder = pathlib.Path(common.shared_dir(spark).removeprefix("file:"))
    old = set(folder.iterdir())
    got = exact_rows(exact_dedup.exact_duplicates(docs, 1))
    assert sorted(x[:3] + x[4:] for x in got) == sorted(brute_exact(rows))
    assert [x.name.split("-")[1] for x in set(folder.iterdir()) - old] == ["classes"]


def test_radix_classes_random():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 24))) for _ in range(400)]
    col = pa.array(texts, pa.binary())
    rep = exact_dedup.radix_classes(*common.column_bytes(col))
    first = {}
    for k, t in enumerate(texts):
        first.setdefault(t, k)
    assert rep.tolist() == [first[t] for t in texts]


def sets_of(text, k):
    w = [x for x in re.split(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_components(rows, k):
    sets = [sets_of(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    return sorted(((d, len(sets[i]), min((x for x in low[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("words", [4, 5])
def test_near_equals_brute_force(spark, data, words):
    docs = common.read_table(spark, data, "documents")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, words).collect()), key=str)
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], words)


def test_near_copies_with_small_tiles(spark):
    """A group whose members are at the threshold: links across tiles and chains must be found."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for tile in (8, 1_024):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 4, tile).collect()), key=str)
        assert got == brute_components(rows, 4)


def test_near_odd_rows(odd):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(odd, 4).collect()), key=str)
    assert got == brute_components([(r.doc_id, r.text) for r in odd.collect()], 4)


def test_one_of_each(odd):
    kept = minhash.one_of_each(odd, 5)
    assert kept.columns == odd.columns
    rows = kept.collect()
    # the fox texts, the long texts, the nameless pair, two singles, and each of the three empty texts
    assert sorted(str(r.doc_id) for r in rows) == ["1", "3", "4", "5", "6", "8", "9", "None"]
    assert all(r.score == 0.5 and r.tag == "t" and r.k == 1 for r in rows)


def test_empty_tables(none):
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert minhash.one_of_each(none).count() == 0


def test_sketch_estimates():
    """Coordinates agree as often as the sets are similar, for sets smaller and larger than the sketch."""
    rng = np.random.default_rng(0)
    for size in (10, 100, 2_000):
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        b = a.copy()
        b[: size // 5] = rng.integers(0, 2**63, size // 5).astype(np.uint64)
        s = minhash.sketches(np.concatenate([a, b]), np.array([0, size, 2 * size]))
        assert (s != np.uint64(2**64 - 1)).all()
        assert abs((s[0] == s[1]).mean() - 4 / 6) < 0.17


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    with common.Scratch(spark) as tmp:
        got = {r.v: r.root for r in minhash.components(links, tmp).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_components_of_a_star(spark):
    """One vertex holds all links, and one component all vertices."""
    links = spark.createDataFrame([(0, k) for k in range(1, 300)] + [(k, 1_000 + k) for k in range(1, 300)], "a long, b long")
    with common.Scratch(spark) as tmp:
        got = {r.v: r.root for r in minhash.components(links, tmp).collect()}
    assert got == {k: 0 for k in range(300)} | {1_000 + k: 0 for k in range(1, 300)}


def test_one_giant_group_leaves_no_tables(spark):
    """A third of all rows are near copies in one bucket, most of them unlike its first; what a run writes but its result is deleted."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(240):
        w = list(base) if k % 3 else [f"u{k}x{j}" for j in range(50)]
        for _ in range(rng.randint(0, 4) if k % 3 else 0):
            w[rng.randrange(100)] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = pathlib.Path(common.shared_dir(spark).removeprefix("file:"))
    old = set(folder.iterdir())
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 4).collect()), key=str)
    assert got == brute_components(rows, 4)
    assert [x.name.split("-")[1] for x in set(folder.iterdir()) - old] == ["groups"]


def test_hot_join_equals_join(spark):
    big = spark.createDataFrame([(7 if k % 3 else k, k) for k in range(900)] + [(None, -1)], "key long, rid long")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(0, 900, 2)] + [(7, "seven"), (7, "again")], "key long, v string")
    for how in ("inner", "left"):
        assert sorted(common.hot_join(big, small, ["key"], "rid", how).collect(), key=str) == sorted(big.join(small, ["key"], how).collect(), key=str)
    counts = big.groupBy("key").agg(F.count("*").alias("__n"))
    assert [r.key for r in common.hot_keys(counts, ["key"], big.count()).collect()] == [7]


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
