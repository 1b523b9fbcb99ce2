"""Token output, mixing, quality, url verdicts and the pipeline."""

import math
import pathlib
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pairloom.llm import common, minhash, mixing, quality, registry, token_output, url_filter

PATH = public_tokenizers.path(token_output.TOKENIZER)


def round_trip(spark, docs):
    path = common.table_path(spark, "test")
    token_output.write_tokens(docs, path, PATH)
    return path, token_output.read_tokens(spark, path)


def expected_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [token_output.END_ID]


def test_tokens_round_trip(spark, data):
    docs = common.read_table(spark, data, "documents")
    path, got = round_trip(spark, docs)
    rows, start = {r.doc_id: r for r in got.collect()}, 0
    for r in docs.orderBy("doc_id").collect():
        ids = expected_ids(r.text)
        x = rows[r.doc_id]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4")))
        start += len(ids)
    some = {r.doc_id: r.ids for r in token_output.fetch(spark, path, [0, 3]).collect()}
    assert some[3] == expected_ids(docs.where("doc_id = 3").first().text) and set(some) == {0, 3}


TRICKY = ["don't.'s 'S ''re", "a'b.'c", "<|endoftext|> x <|ENDOFTEXT|>", "1st2nd 3.4,5", "=\u0338 a\u0301b e\u0301.", "ÀÉ.à É!", "a\u00a0b\u2003c\u0085d", "x\x1cy", "😀. 漢字。かな kana\u3099", "İI ß ΑΣ ΑΣ.", "!!??..", "\n\n", "`a^b~c", "A-B_C/D\\E", "é1é2", "ab\u0338=c<\u0338"]


def test_tokens_of_tricky_texts(spark):
    """Pieces that are remembered give the same ids as whole texts."""
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string").repartition(2)
    rows = {r.doc_id: r for r in round_trip(spark, docs)[1].collect()}
    for k, t in enumerate(TRICKY):
        assert rows[k].ids_crc32 == zlib.crc32(np.array(expected_ids(t), "<u4")), repr(t)


def test_tokens_of_odd_rows(spark, odd, none):
    rows = round_trip(spark, odd)[1].orderBy("start").collect()
    assert len(rows) == 12 and [r.doc_id for r in rows][:2] == [None, None]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert sorted(r.n_tokens for r in rows)[:3] == [1, 1, 1]  # null, empty and blank texts are the end id alone
    assert round_trip(spark, none)[1].count() == 0


def test_many_shards(spark, data, monkeypatch):
    monkeypatch.setattr(token_output, "DOCS_PER_SHARD", 20)
    monkeypatch.setattr(token_output, "BLOCK_DOCS", 7)
    docs = common.read_table(spark, data, "documents")
    rows = round_trip(spark, docs)[1].orderBy("doc_id").collect()
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]


def test_fetch_reads_only_the_shards_of_its_documents(spark, odd, monkeypatch):
    """All other shards are destroyed on disk; absent, repeated and null ids are defined."""
    monkeypatch.setattr(token_output, "DOCS_PER_SHARD", 20)
    monkeypatch.setattr(token_output, "BLOCK_DOCS", 7)
    docs = spark.createDataFrame([(k, f"text number {k} " * (k % 9)) for k in range(400)] + [(None, "nameless"), (17, "another seventeen")], "doc_id long, text string")
    path, got = round_trip(spark, docs)
    assert got.count() == 402
    folder = pathlib.Path(path.removeprefix("file:"))
    shards = sorted(x for x in (folder / "blocks").iterdir() if x.is_dir())
    assert len(shards) > 10
    own = {r.shard for r in spark.read.parquet(path + "/starts").where("17 between min_doc and max_doc or 350 between min_doc and max_doc or shard = 0").collect()}
    for x in shards:
        if int(x.name.split("=")[1]) not in own:
            for f in x.glob("*.parquet"):
                f.write_bytes(b"destroyed")
    rows = token_output.fetch(spark, path, [350, 17, 17, None, 10**9]).collect()
    assert sorted((str(r.doc_id), r.ids) for r in rows) == sorted([("350", expected_ids("text number 350 " * 8)), ("17", expected_ids("text number 17 " * 8)), ("17", expected_ids("another seventeen")), ("None", expected_ids("nameless"))])
    assert token_output.fetch(spark, path, []).count() == 0


def test_ids_must_fit(spark):
    docs = spark.createDataFrame([(1, "some words of text")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit"):
        token_output.write_tokens(docs, common.table_path(spark, "test"), PATH, id_width=1)


def brute_targets(sizes, weights, share=1.5, limit=2):
    out, open_, left = {}, set(range(len(sizes))), share * sum(sizes)
    while True:
        total = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / total > limit * sizes[k] + 1e-9]
        if not over:
            return [out.get(k, left * weights[k] / total if k in open_ else None) for k in range(len(sizes))]
        for k in over:
            out[k] = float(limit * sizes[k])
        open_ -= set(over)
        left = share * sum(sizes) - sum(out.values())


def test_targets():
    rng = np.random.default_rng(5)
    for _ in range(200):
        sizes = rng.integers(1, 10_000, rng.integers(1, 12)).tolist()
        weights = [(3.0, 1.0, 2.0)[k % 3] for k in range(len(sizes))]
        assert mixing.targets(sizes, weights) == pytest.approx(brute_targets(sizes, weights))


def test_mixing_query(spark, data):
    rows = registry.QUERIES["op6_mixing"](spark, data).collect()
    again = registry.QUERIES["op6_mixing"](spark, data).collect()
    assert sorted(rows) == sorted(again)
    docs = {r.doc_id: r for r in common.read_table(spark, data, "documents").collect()}
    taken, size, largest, target = {}, {}, {}, {}
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == len([x for x in re.split(r"[\x20\x09-\x0D]+", docs[r.doc_id].text or "") if x]) and r.taken <= 2 * r.size
        taken[s], size[s], largest[s], target[s] = taken.get(s, 0) + r.taken, size.get(s, 0) + r.size, max(largest.get(s, 0), r.size), r.target
    names = sorted(size)
    assert [target[n] for n in names] == pytest.approx(brute_targets([size[n] for n in names], [(3.0, 1.0, 2.0)[k % 3] for k in range(len(names))]))
    assert all(abs(taken[n] - target[n]) <= largest[n] / 2 + 1e-6 for n in names)


def test_mix_follows_key_order(spark):
    """Selected documents are a prefix by key within each source; copies are whole epochs first."""
    docs = spark.createDataFrame([(k, "w " * (1 + k % 7), "ab"[k % 5 == 0]) for k in range(400)], "doc_id long, text string, source string")
    keyed = mixing.keyed(docs)
    with common.Scratch(spark) as tmp:
        got = mixing.apply_plan(keyed, mixing.plan(keyed, tmp)).orderBy("source", "__mix_key").collect()
    for s in "ab":
        copies = [r["__mix_copies"] for r in got if r.source == s]
        assert copies == sorted(copies, reverse=True) and max(copies) - min(copies) <= 1
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r["__mix_copies"] for r in got)


def test_mixing_odd_rows(odd, none):
    out = mixing.mix(odd)
    assert out.columns == odd.columns and {r.target for r in out.collect()} == {2.0}
    assert mixing.mix(none).count() == 0


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = registry.QUERIES["op7_quality_nbsvm"](spark, d)
    rows = got.join(common.read_table(spark, d, "labels"), "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([(np.array(good) > b).mean() + 0.5 * (np.array(good) == b).mean() for b in bad])
    assert auc > 0.97 and np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.collect())


def test_dual_descent_reaches_the_optimum():
    """The dual solution's gap to the primal is small."""
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 12)) + (30 if k % 3 else 0) for k in range(90)]
    labels = np.array([1 if k % 3 else 0 for k in range(90)])
    ratio = quality.log_ratios(sets, labels)
    w, b = quality.dual_descent(sets, labels, ratio)
    margins = np.array([float(w[g] @ (ratio[g] / np.linalg.norm(ratio[g]))) + b for g in sets]) * np.where(labels == 1, 1, -1)
    assert (margins > 0.9).mean() > 0.9


def test_quality_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (8, 1), (4, None), (None, 1), (9, 7)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    rows = quality.score(odd, model, name="p").collect()
    assert len(rows) == 12 and all(0 <= r.p <= 1 and r.score == 0.5 for r in rows)
    assert quality.score(none, model).count() == 0
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert {round(r.score, 3) for r in quality.score(odd, quality.train(odd, some)).collect()} == {0.5 if some.count() == 0 else 1.0}


def brute_rank(edges, seeds, rounds=400, damping=url_filter.DAMPING):
    """Personalised PageRank by plain iteration until nothing moves; what cannot move on returns to the seeds."""
    out = {}
    for (a, _), w in edges.items():
        out[a] = out.get(a, 0) + w
    r = {s: 1 / len(seeds) for s in seeds}
    for _ in range(rounds):
        new = {}
        for (a, b), w in edges.items():
            if a in r:
                new[b] = new.get(b, 0) + damping * w / out[a] * r[a]
        back = (1 - sum(new.values())) / len(seeds)
        for s in seeds:
            new[s] = new.get(s, 0) + back
        r = new
    return r


def scores_of(spark, edges, seeds, **options):
    with common.Scratch(spark) as tmp:
        df = tmp.written(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, w double"), "edges")
        rows = url_filter.propagate(df, spark.createDataFrame(seeds, "host string, kind string"), tmp, **options).collect()
    return {r.host: (r.trust, r.distrust) for r in rows}


def test_propagation(spark):
    edges = {("a", "b"): 2.0, ("a", "c"): 1.0, ("b", "c"): 1.0, ("c", "a"): 1.0, ("d", "e"): 1.0, ("e", "d"): 3.0, ("c", "d"): 0.5, ("b", "end"): 1.0}
    got = scores_of(spark, edges, [("a", "trust"), ("b", "trust"), ("e", "distrust")], tolerance=1e-5, rounds=100)
    trust, distrust = brute_rank(edges, ["a", "b"]), brute_rank({(b, a): w for (a, b), w in edges.items()}, ["e"])
    for h in (*"abcde", "end"):
        assert got.get(h, (0, 0)) == pytest.approx((trust.get(h, 0), distrust.get(h, 0)), abs=1e-4)
    assert sum(x for x, _ in got.values()) == pytest.approx(1) and sum(x for _, x in got.values()) == pytest.approx(1)


def test_propagation_through_a_hub(spark):
    """One host has two thirds of the links, and dangling hosts hold most of the mass."""
    edges = {("hub", f"h{k}"): 1.0 + k % 3 for k in range(200)} | {(f"h{k}", "hub"): 1.0 for k in range(0, 200, 2)}
    got = scores_of(spark, edges, [("hub", "trust"), ("h7", "distrust"), ("h8", "distrust")])
    trust, distrust = brute_rank(edges, ["hub"]), brute_rank({(b, a): w for (a, b), w in edges.items()}, ["h7", "h8"])
    for h in ("hub", "h7", "h8", "h100", "h199"):
        assert got.get(h, (0, 0)) == pytest.approx((trust.get(h, 0), distrust.get(h, 0)), abs=url_filter.TOLERANCE / (1 - url_filter.DAMPING))


def brute_edges(pages):
    """Edges of (host, html): links between different hosts, and both ways to the nearest known domain above."""
    edges, hosts = {}, set()
    for host, html in pages:
        if not host:
            continue
        hosts.add(host)
        for to in {h.lower() for h in re.findall(url_filter.LINK, html or "")} - {host, ""}:
            edges[host, to] = edges.get((host, to), 0) + 1.0
    hosts |= {b for _, b in edges}
    for h in hosts:
        up = h
        while "." in up:
            up = up.split(".", 1)[1]
            if up in hosts:
                for a, b in ((h, up), (up, h)):
                    edges[a, b] = edges.get((a, b), 0) + url_filter.PARENT_WEIGHT
                break
    return edges


def test_url_verdicts_equal_brute_force(spark, data):
    """Hosts, rules, edges, scores and verdicts of all pages, with one domain above most hosts, by plain Python."""
    pages = [(r.page_id, r.url, r.html) for r in common.read_table(spark, data, "pages").collect()]
    pages += [(10_000 + k, f"http://s{k}.big.io/x", '<a href="http://big.io/">' if k % 3 else '<a href="http://evil.net/">') for k in range(60)] + [(20_000, "http://io/", ""), (20_001, "http://lone.xyz/", None)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    hosts = {p: (got[p].host, html) for p, _, html in pages}
    edges = brute_edges(hosts.values())
    seeds = {k: sorted({got[p].host for p, *_ in pages if got[p].rule and (got[p].verdict == "allow") == (k == "trust")}) for k in ("trust", "distrust")}
    trust, distrust = brute_rank(edges, seeds["trust"]) if seeds["trust"] else {}, brute_rank({(b, a): w for (a, b), w in edges.items()}, seeds["distrust"])
    for p, _, _ in pages:
        r = got[p]
        x, y = trust.get(r.host, 0), distrust.get(r.host, 0)
        assert (r.trust, r.distrust) == pytest.approx((x, y), abs=0.01)
        if r.rule is None and abs(x - y) > 0.01:
            assert r.verdict == ("block" if y > x else "allow")


PAGES = [
    (1, "http://X.Example.COM/de/1?x#y", '<a href="https://bad.org/a">'), (2, "no scheme", None), (3, None, ""), (4, "ftp://a.net", ""), (5, "ftp://a.net/", ""), (6, "http://example.net/en/q", '<a href="//friend.io/x">'),
    (7, "https://www.example.net/en", ""), (8, "http://notexample.net/en/1", ""), (9, "http://m.org/fr/1", ""), (10, "http://friend.io?/de/", ""), (11, "http://h#x", ""), (12, "a://b://c/d?e", ""), (13, "http://linker.io/", '<a HREF = "http://x.example.com/z">'), (13, "http://linker.io/", ""),
]


def test_url_rules(spark):
    rows = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()}
    for page, url, _ in PAGES:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            k = re.search("[/?#]|$", rest).start()
            host, path = rest[:k].lower(), re.split("[?#]", rest[k:])[0]
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = rows[page]
        assert (r.host, r.path, r.rule) == (host, path, max(fit)[1] if fit else None), url
        assert not fit or r.verdict == max(fit)[2]
    assert rows[13].verdict == "block" and rows[10].verdict == "allow" and rows[2].verdict == "allow"


def test_url_long_pages_and_ties(spark):
    """A page of 20,000 links, repeated pages, and a host that trust and distrust reach alike (which is allowed)."""
    html = "".join(f'<a href="http://t{k}.info/">' for k in range(20_000))
    pages = [(1, "http://example.net/en/a", html + '<a href="http://even.xyz/">'), (2, "http://even.xyz/", '<a href="http://bad.net/">'), (3, "http://bad.net/", ""), (3, "http://bad.net/", ""), (4, "http://t7.info/", None)]
    rows = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == 5 and got[1].verdict == "allow" and got[3].verdict == "block" and got[4].verdict == "allow"
    assert got[2].verdict == ("block" if got[2].distrust > got[2].trust else "allow")


def test_url_odd_tables(spark):
    schema = "page_id long, url string, html string, host string, rule string, kind string"
    assert url_filter.judge(spark.createDataFrame([], schema)).count() == 0
    assert [r.verdict for r in url_filter.judge(spark.createDataFrame([(1, None, None, "h", "r", "k")], schema)).collect()] == ["allow"]


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what the one before kept, against its operator's own definition."""
    d = "/root/testdata/sf0.001"
    docs = common.read_table(spark, d, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        got = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(got) <= ids and got
        if k < 4:
            assert out.columns == columns
        if name in ("quality", "near_duplicates", "decontamination"):
            assert len(got) == len(set(got))
        if name == "near_duplicates":
            assert minhash.near_duplicates(out, 5).where("not kept").count() == 0
            groups = {r.component_id for r in minhash.near_duplicates(docs, 5).collect()}
            assert set(got) == groups
        if name == "token_output":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert out.count() == docs.count()
            for r in out.limit(20).collect():
                assert r.ids_crc32 == zlib.crc32(np.array(expected_ids(texts[r.doc_id]), "<u4"))
        docs = out


def test_quality_trains_on_whole_gram_sets(spark, monkeypatch):
    """A text of more than 3,000 n-grams, the last of which is a run of one word."""
    kinds = np.array(list("aB7b \n!#$%&()*+,-./:;<=>?@[]^_{|}~"))
    text = "".join(kinds[np.random.default_rng(3).integers(0, len(kinds), 40_000)]) + " again again again"
    seen = []
    monkeypatch.setattr(quality, "fit", lambda sets, labels: seen.extend(sets))
    twice = spark.createDataFrame([(1, "b" * k) for k in range(50)], "doc_id long, text string")
    quality.train(twice, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert len(seen) == 1  # one row of a doc_id, however often it repeats
    seen.clear()
    quality.train(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    whole = quality.gram_sets(pa.array([text]))[0]
    assert len(whole) > 3_000 and np.array_equal(seen[0], whole)


def test_mixing_stage_prefers_quality(spark):
    """Of a source that is taken in part, what is taken scores better than what is not; whole epochs come first."""
    d = "/root/testdata/sf0.01"
    docs = common.read_table(spark, d, "documents")
    out = corpus_pipeline.mixing_stage(spark, docs, d)
    assert out.columns == docs.columns
    model = quality.train(docs, common.read_table(spark, d, "labels").where(~quality.held_out()))
    taken = out.groupBy("doc_id").agg(mixing.F.count("*").alias("copies"))
    rows = quality.score(docs, model).join(taken, "doc_id", "left").select("source", "score", mixing.F.coalesce("copies", mixing.F.lit(0)).alias("copies")).collect()
    gaps = []
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        low = min(r.copies for r in own)
        more, less = ([r.score for r in own if (r.copies > low) == x] for x in (True, False))
        if min(len(more), len(less)) >= 20:
            gaps.append(np.mean(more) - np.mean(less))
    assert gaps and np.mean(gaps) > 0.05


def test_decontamination_stage_judges_rows(spark):
    """A copy without a doc_id goes; a clean row that shares its doc_id with a copy stays."""
    d = "/root/testdata/sf0.001"
    item = common.read_table(spark, d, "benchmark").where("text is not null").orderBy("item_id").first().text
    rows = [(None, item), (5, item), (5, "a clean row of the same id"), (None, "a clean row without an id")]
    got = corpus_pipeline.decontamination_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), d)
    assert {tuple(r) for r in got.collect()} == set(rows[2:])


def test_pipeline_deals_out_a_large_row_group(spark, data, tmp_path, monkeypatch):
    """A file of one row group is read by one task, whatever its splits; the first stage deals its rows out and loses none."""
    for name in ("documents", "labels"):
        spark.read.parquet(f"{data}/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        rows = lambda df: sorted(map(repr, df.collect()))
        tasks = lambda df: df.select(mixing.F.spark_partition_id().alias("p")).distinct().count()
        assert docs.rdd.getNumPartitions() > 8 and tasks(docs) == 1
        got = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
        assert tasks(got) > 4
        assert spark.conf.get(common.VECTORED, None) is None
        assert rows(common.spread(docs)) == rows(docs)
        monkeypatch.setattr(common, "spread", lambda t: t)
        assert rows(got) == rows(corpus_pipeline.quality_stage(spark, docs, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pipeline_odd_rows(spark, odd, none, tmp_path):
    for name, rows in (("odd", odd), ("none", none)):
        docs = rows
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / f"{name}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{k}"))
            assert k == 4 or docs.columns == rows.columns


def test_logit_curve():
    m = np.linspace(-2, 2, 400)
    y = (m > 0.3).astype(float)
    a, b = quality._curve(m, y)
    assert a > 0 and abs(-b / a - 0.3) < 0.1 and math.isfinite(a)


def test_registry():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES} == set(range(1, 11))
    assert set(registry.ORACLE) <= set(registry.QUERIES)
