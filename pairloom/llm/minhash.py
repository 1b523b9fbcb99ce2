"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

Method. A document is the set of its distinct word shingles. Its sketch of T coordinates is filled
in rounds: round i < T hashes every shingle to one bin and a value in [i, i + 1); round T + b puts
every shingle into bin b. A bin keeps its least value, so values of early rounds win, and after 2 T
rounds at most no coordinate is empty. For each coordinate the chance that two sketches agree is the
Jaccard similarity, with Chernoff-like concentration. BANDS bands of ROWS coordinates give
the candidates: two sets at similarity 0.8 share no band with probability (1 - 0.8^4)^32 < 5e-8.

1. Within a block of an input partition, documents of equal sets become one representative; equal
   representatives of different blocks are linked to the first of them.
2. In every band bucket each set is paired with the bucket's first: linear in the bucket. Pairs pass
   the sketch comparison and are confirmed on their full sets (LIMIT percent of the union).
3. Connected components of the confirmed links, by contraction over written tables.
4. Buckets that still hold two components or more are compared in full: the sets outside the bucket's
   largest component with one another and with that component's, in tiles of at most TILE sets a
   side. A first pass over the tiles' sketches leaves the sets that agree enough (CLOSE of T
   coordinates, five standard deviations under 0.8) with one of another component in their tile; only these
   take their texts there, where such pairs are confirmed on their full sets, about TILE_BYTES of text at a time.
   A tile emits sets, then a forest of confirmed links, never its pairs. So no link that joins components is
   lost to the choice of a bucket's first.

A bucket, a bucket's first or a component may hold any share of all rows: what is joined on them is
dealt into parts (common.hot_join). Texts are only moved for sets whose sketches agree with another's.
All tables of a run but its result are deleted at its end.

Defined results. No words or null text: n_shingles 0, linked with nothing. Fewer words than WORDS:
the whole sequence is the only shingle. Repeated rows are members of their class; component_id is
the smallest doc_id that isn't null; kept is doc_id = component_id (true for a null doc_id in a class of
nulls only). Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

T, ROWS = 128, 4
BANDS = T // ROWS
#: Least similarity in per cent.
LIMIT = 80
#: Coordinates that must agree before full sets are compared: 128 * 0.8 less five standard deviations.
CLOSE = 79
TILE, TILE_BYTES, SLICE_BYTES = 1_024, 2 << 20, 1 << 20
LOCAL = "doc_id long, rid long, rep long, n long, k1 long, k2 long, size int, sketch binary, bands array<bigint>, body string"
PAIR = "a long, b long"

_MASK = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(padded) - 7,), np.dtype("<u8"), padded, strides=(1,))
    h = (end - start).astype(np.uint64) * _A ^ np.uint64(seed)
    live, at, left = np.arange(len(start)), start.copy(), end - start
    while len(live):
        h[live] = common.mix64(h[live] ^ (view[at] & _MASK[np.minimum(left, 8)])) * _B
        go = left > 8
        live, at, left = live[go], at[go] + 8, left[go] - 8
    return common.mix64(h)


def word_hashes(col, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text of an Arrow string array, A-Z lower-cased; n + 1 offsets of the texts into them.

    solid marks the bytes that words are made of; by default all but white space.
    """
    data, off = common.column_bytes(col)
    data = _LOWER[data]
    solid = ~_WHITE[data] if solid is None else solid[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    first[inner] = solid[inner]  # a text begins a word, and the one before it ends
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return hash_spans(data, start, end), np.searchsorted(start, off)


def shingles(col, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word shingles of each text of an Arrow string array, sorted and distinct within a text; n + 1 offsets."""
    h, w_off = word_hashes(col)
    n, count = len(w_off) - 1, np.diff(w_off)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    s = np.full(len(h), _A)
    take = np.arange(len(h))
    for j in range(words):
        s = common.mix64(s * _B ^ h[np.minimum(take + j, len(h) - 1)])
    out, sizes = [], np.zeros(n, np.int64)
    for k in range(n):
        a, m = w_off[k], count[k]
        if not m:
            continue
        if m < words:
            v = np.full(1, _A)
            for j in range(m):
                v = common.mix64(v * _B ^ h[a + j : a + j + 1])
            v = common.mix64(v + np.uint64(m))
        else:
            v = np.sort(s[a : a + m - words + 1])
            v = v[np.r_[True, v[1:] != v[:-1]]]
        out.append(v)
        sizes[k] = len(v)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.r_[0, np.cumsum(sizes)]


def sketches(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Fast similarity sketches (n x T, uint64) of n sets; an empty set's is all ones."""
    n = len(off) - 1
    empty = np.uint64(2**64 - 1)
    out = np.full(n * T, empty)
    size = np.diff(off)
    doc, el = np.repeat(np.arange(n), size), h
    for i in range(2 * T):
        g = common.mix64(el ^ common.mix64(np.uint64(i + 1) * np.ones(1, np.uint64) * _A))
        bin_ = (g & np.uint64(T - 1)).astype(np.int64) if i < T else np.int64(i - T)
        np.minimum.at(out, doc * T + bin_, (np.uint64(i) << np.uint64(56)) | (g >> np.uint64(8)))
        open_ = (out.reshape(n, T) == empty).any(axis=1)
        keep = open_[doc]
        doc, el = doc[keep], el[keep]
        if not len(doc):
            break
    return out.reshape(n, T)


def _local(words: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.blocks(batches, limit=4 << 20):
            t = pa.Table.from_batches(part).combine_chunks()
            body, rid = t["body"].chunk(0), t["rid"].to_numpy()
            h, off = shingles(body, words)
            n, size = t.num_rows, np.diff(off)
            sums = np.r_[np.uint64(0), np.cumsum(common.mix64(h ^ _A))], np.r_[np.uint64(0), np.cumsum(common.mix64(h ^ _B))]
            k1, k2 = (s[off[1:]] - s[off[:-1]] for s in sums)
            key = np.rec.fromarrays([size, k1, k2])
            _, first, back = np.unique(key, return_index=True, return_inverse=True)
            rep = np.where(size > 0, first[back.ravel()], np.arange(n))
            own = np.flatnonzero((rep == np.arange(n)) & (size > 0))
            seg = np.concatenate([np.arange(off[k], off[k + 1]) for k in own]) if len(own) else np.zeros(0, np.int64)
            sk = sketches(h[seg], np.r_[0, np.cumsum(size[own])]) if len(own) else np.zeros((0, T), np.uint64)
            band = np.full((len(own), BANDS), _A)
            for j in range(ROWS):
                band = common.mix64(band * _B ^ sk[:, j::ROWS])
            band = common.mix64(band + np.arange(BANDS, dtype=np.uint64)[None, :]).view(np.int64)
            small = (common.mix64(sk) & np.uint64(255)).astype(np.uint8)
            at = np.full(n, -1)
            at[own] = np.arange(len(own))
            pick = pa.array(at, mask=at < 0)
            yield pa.record_batch([
                t["doc_id"].chunk(0), pa.array(rid), pa.array(rid[rep]), pa.array(size), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(np.diff(common.column_bytes(body)[1]).astype(np.int32)),
                pa.array([r.tobytes() for r in small], pa.binary()).take(pick), pa.array(list(band), pa.list_(pa.int64())).take(pick), body.take(pa.array(np.where(at < 0, 0, np.arange(n)), mask=at < 0)),
            ], names=[f.split()[0] for f in LOCAL.split(", ")])

    return step


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and sketches allow LIMIT per cent."""
    for b in batches:
        x, y = (common.column_bytes(b.column(c))[0].reshape(-1, T) for c in ("sa", "sb"))
        na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
        ok = ((x == y).sum(axis=1) >= CLOSE) & (100 * np.minimum(na, nb) >= LIMIT * np.maximum(na, nb))
        yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if not len(x) or not len(y):
        return 0
    return int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y))


def _confirmed(words: int):
    """Of rows (a, part, side, b, body) that adjoin by a and part, a's own body (side 0) first, the pairs whose full sets are similar.

    Bodies are taken in slices of about SLICE_BYTES; of a only its set is kept.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            size = np.diff(common.column_bytes(batch.column("body"))[1]) + 64
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // SLICE_BYTES)) + 1 if batch.num_rows else []
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
                t = batch.slice(start, stop - start)
                h, off = shingles(t.column("body"), words)
                a, b, side, ok = *(t.column(c).to_numpy() for c in ("a", "b", "side")), np.zeros(t.num_rows, bool)
                for k in range(t.num_rows):
                    x = h[off[k] : off[k + 1]]
                    if side[k] == 0:
                        centre, own = a[k], x
                    elif a[k] == centre:
                        both = _shared(own, x)
                        ok[k] = 100 * both >= LIMIT * (len(own) + len(x) - both)
                yield pa.record_batch([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return step


def confirm(pairs: DataFrame, reps: DataFrame, words: int, tmp: common.Scratch) -> DataFrame:
    """Of distinct candidate pairs (a, b) of representatives those that are similar: by sketch, then on their full sets.

    a may stand in any number of pairs, b in BANDS at most. A hot a's pairs are dealt into parts, to each of which its text goes once.
    """
    side = lambda t, c, v: t.select(F.col("rid").alias(c), *(F.col(x).alias(y + c) for x, y in v))
    by_sketch, ends = (("sketch", "s"), ("n", "n")), lambda t: tmp.written(t.select(F.col("a").alias("rid")).union(t.select("b")).distinct(), "ids")
    sketched = common.only(reps.select("rid", "sketch", "n"), ends(pairs), "rid")
    close = common.hot_join(pairs, side(sketched, "a", by_sketch), ["a"], "b").join(side(sketched, "b", by_sketch), "b")
    close = tmp.written(close.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(_agreeing, PAIR), "close")
    hot = common.hot_keys(close.groupBy("a").agg(F.count("*").alias("__n")), ["a"], close.count())
    parts = F.coalesce("__parts", F.lit(1))
    dealt = close.withColumn("__parts", F.lit(1)) if hot is None else close.join(F.broadcast(hot), "a", "left")
    dealt = dealt.select("a", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"), "b")
    ours = dealt.select("a", "part", F.lit(0).alias("side"), F.col("a").alias("b")).distinct()
    asked = tmp.written(ours.unionByName(dealt.select("a", "part", F.lit(1).alias("side"), "b")), "asked")
    texts = common.only(reps.select(F.col("rid").alias("b"), "body"), ends(close).withColumnRenamed("rid", "b"), "b")
    rows = asked.join(texts.hint("merge"), "b").select("a", "part", "side", "b", "body")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "side").mapInArrow(_confirmed(words), PAIR)


def components(links: DataFrame, tmp: common.Scratch) -> DataFrame:
    """Connected components of links (a, b): v, root (the least of its component), for every v that has a link.

    Each round points every vertex to its least neighbour, follows the pointers to their ends, and
    contracts the links to those; only written tables of links and vertices are moved.
    """
    labels = None
    edges = tmp.written(links.where("a <> b").distinct(), "links")
    count = lambda t, c: t.groupBy(c).agg(F.count("*").alias("__n"))
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        points = tmp.written(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("root")), "points")
        while True:
            ends = points.select(F.col("v").alias("root"), F.col("root").alias("next"))
            points = tmp.written(common.hot_join(points, ends, ["root"], "v").select("v", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "points")
            moved = not points.where("moved").isEmpty()
            points = points.drop("moved")
            if not moved:
                break
        to = points.select(F.col("v").alias("root"), F.col("root").alias("next"))
        labels = points if labels is None else tmp.written(common.hot_join(labels, to, ["root"], "v", "left").select("v", F.coalesce("next", "root").alias("root")), "labels")
        a, b = (points.select(F.col("v").alias(c), F.col("root").alias("r" + c)) for c in ("a", "b"))
        moved_a = common.hot_join(edges, a, ["a"], "b")
        edges = tmp.written(common.hot_join(moved_a, b, ["b"], "a", counts=count(edges, "b"), total=edges.count()).select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("v"), F.col("b").alias("root")).limit(0)
    return labels


def _tile_pairs(t: pa.Table) -> list[tuple[int, np.ndarray]]:
    """Of one tile (side 0 is the left, 1 the right, 2 both) each left set with the right ones of other components whose sizes and sketches allow a link.

    A pair is met only in the bucket of the first band that the two share.
    """
    sk = common.column_bytes(t["sketch"].chunk(0))[0].reshape(-1, T)
    bands = t["bands"].chunk(0).flatten().to_numpy().reshape(-1, BANDS)
    rid, n, side, band, comp = (t[c].to_numpy() for c in ("rid", "n", "side", "band", "comp"))
    left, right, pairs = np.flatnonzero(side != 1), np.flatnonzero(side != 0), []
    for k in left:
        near = right[(comp[right] != comp[k]) & (100 * np.minimum(n[right], n[k]) >= LIMIT * np.maximum(n[right], n[k]))]
        near = near[rid[near] > rid[k]] if side[k] == 2 else near
        near = near[(sk[near] == sk[k]).sum(axis=1) >= CLOSE]
        near = near[(bands[near] == bands[k]).argmax(axis=1) == band[k]]
        if len(near):
            pairs.append((int(k), near))
    return pairs


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The tiles of batches in which the rows of a tile adjoin."""
    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        tile, start = b.column("tile").to_numpy(), 0
        for c in np.flatnonzero(np.r_[last is not None and tile[0] != last, tile[1:] != tile[:-1]]).tolist():
            if c > start:
                held.append(b.slice(start, c - start))
            yield pa.Table.from_batches(held).combine_chunks()
            held, start = [], c
        held.append(b.slice(start))
        last = tile[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


SPOT = "tile long, rid long, comp long, n long, band int, side int, sketch binary, bands array<bigint>, size int"


def _agreeing_in_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tile the rows that agree with one of another component."""
    for t in _runs(batches):
        pairs = _tile_pairs(t)
        if pairs:
            yield from t.take(pa.array(np.unique(np.concatenate([np.r_[k, near] for k, near in pairs])))).to_batches()


def _tile_links(t: pa.Table, words: int) -> list[tuple[int, int]]:
    """Of one tile with bodies, links between components that full sets confirm; no more than join what the tile holds (a forest).

    Left sets meet their partners in slices of about TILE_BYTES of text, so that two slices' shingles are held at once.
    """
    pairs, rid, out = _tile_pairs(t), t["rid"].to_numpy(), []
    _, comp = np.unique(t["comp"].to_numpy(), return_inverse=True)
    body, size = t["body"].chunk(0), t["size"].to_numpy().astype(np.int64)

    def slices(rows: np.ndarray) -> list[np.ndarray]:
        return [x for x in np.split(rows, np.flatnonzero(np.diff(np.cumsum(size[rows]) // TILE_BYTES)) + 1) if len(x)]

    def sets(rows: np.ndarray) -> dict[int, np.ndarray]:
        h, off = shingles(body.take(pa.array(rows)), words)
        return {int(r): h[off[k] : off[k + 1]] for k, r in enumerate(rows)}

    partners = dict(pairs)
    for some in slices(np.array(sorted(partners), np.int64)):
        own = sets(some)
        for others in slices(np.unique(np.concatenate([partners[int(k)] for k in some]))):
            right = sets(others)
            for k in some.tolist():
                for m in partners[k].tolist():
                    if m not in right or comp[m] == comp[k]:
                        continue
                    both = _shared(own[k], right[m])
                    if 100 * both >= LIMIT * (len(own[k]) + len(right[m]) - both):
                        out.append((int(rid[k]), int(rid[m])))
                        comp[comp == comp[m]] = comp[k]
    return out


def _across(words: int):
    """Of tiles with bodies their links."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            got = _tile_links(t, words)
            yield pa.record_batch([pa.array([min(x) for x in got], pa.int64()), pa.array([max(x) for x in got], pa.int64())], names=["a", "b"])

    return step


def across_components(labelled: DataFrame, reps: DataFrame, words: int, tmp: common.Scratch, tile: int = TILE) -> DataFrame | None:
    """Confirmed links (a, b) between the components of each bucket; labelled has key, band, rid, comp. None if no bucket holds two.

    The sets outside a bucket's largest component meet one another and that component's sets. Both sides are dealt
    into parts of at most `tile` sets; two parts are one tile, so a large bucket spreads over many tasks, what a task
    holds is bounded, and the largest component is only repeated for each part of the rest. What is repeated are sketches;
    texts follow for the few sets that have a partner. Only confirmed links leave a tile, fewer than it has rows.
    """
    per = labelled.groupBy("key", "comp").agg(F.count("*").alias("c"))
    parts = lambda c: F.ceil(c / tile).cast("int")
    open_ = per.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("x"), F.sum("c").alias("c")).where("x.c < c")
    open_ = tmp.written(open_.select("key", F.col("x.comp").alias("main"), parts(F.col("x.c")).alias("of_main"), parts(F.col("c") - F.col("x.c")).alias("of_rest"), F.col("c").alias("__n")), "open")
    if open_.isEmpty():
        return None
    # sets of open buckets; the rest of a hot key's rows leaves at once
    rows = tmp.written(common.hot_join(labelled, open_.drop("__n"), ["key"], "rid", counts=open_.select("key", "__n"), total=labelled.count()), "rows")
    ids = tmp.written(rows.select("rid").distinct(), "ids")
    is_main = F.col("comp") == F.col("main")
    own = F.pmod(F.xxhash64("rid"), F.when(is_main, F.col("of_main")).otherwise(F.col("of_rest"))).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    spot = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    rest = F.concat(
        F.transform(upto(F.col("of_rest")), lambda j: spot("rest", F.least(own, j), F.greatest(own, j), F.when(own == j, 2).when(own < j, 0).otherwise(1))),
        F.transform(upto(F.col("of_main")), lambda j: spot("main", own, j, F.lit(0))),
    )
    spots = F.when(is_main, F.transform(upto(F.col("of_rest")), lambda i: spot("main", i, own, F.lit(1)))).otherwise(rest)
    names = [f.split()[0] for f in SPOT.split(", ")]
    tiles = rows.select("key", "band", "rid", "comp", F.explode(spots).alias("x")).select("band", "rid", "comp", "x.side", F.xxhash64("key", "x.kind", "x.i", "x.j").alias("tile"))
    tiles = tiles.join(common.only(reps.select("rid", "n", "sketch", "bands", "size"), ids, "rid"), "rid").select(*names)
    by_tile = lambda t: t.repartition("tile").sortWithinPartitions("tile")
    near = tmp.written(by_tile(tiles).mapInArrow(_agreeing_in_tiles, SPOT), "near")
    ids = tmp.written(near.select("rid").distinct(), "ids")
    return by_tile(near.join(common.only(reps.select("rid", "body"), ids, "rid"), "rid")).mapInArrow(_across(words), PAIR)


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest doc_id; same columns. Rows are known by their number, so any may repeat.

    The numbers of the rows that go are sent to the rows if they are counted to be few (common.checked); else both sides are shuffled.
    """
    rows = common.numbered(docs)
    found = near_duplicates(rows, words, rid="__pairloom_rid")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("k")
    with common.Scratch(docs.sparkSession) as tmp:
        kept = tmp.written(found.groupBy("comp").agg(best, F.count("*").alias("__n")).where("__n > 1").select("comp", "__n", F.col("k.rid").alias("keep")), "kept")
        gone = common.hot_join(found.select("comp", "rid"), kept.drop("__n"), ["comp"], "rid", counts=kept.select("comp", "__n"), total=found.count())
        gone = common.written(gone.where("rid <> keep").select(F.col("rid").alias("__pairloom_rid")), "gone")
    return rows.join(common.checked(gone), "__pairloom_rid", "left_anti").select(*docs.columns)


def near_duplicates(docs: DataFrame, words: int = 5, tile: int = TILE, rid: str | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept; and of the row its number rid (column rid of docs if it has one), its component's number comp."""
    number = F.monotonically_increasing_id() if rid is None else F.col(rid)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("rid"), common.whole_text().alias("body"))
    with common.Scratch(docs.sparkSession) as tmp:
        sets = tmp.written(rows.mapInArrow(_local(words), LOCAL), "sets")
        reps, keys = sets.where("sketch is not null"), ["n", "k1", "k2"]
        firsts = reps.groupBy(*keys).agg(F.min("rid").alias("first"))
        same = tmp.written(common.hot_join(reps.select("rid", *keys), firsts, keys, "rid").select("rid", "first"), "same")
        again = tmp.written(same.where("rid <> first").select("rid"), "again")  # sets that another block has too
        alone = reps.select("rid", "bands").join(common.checked(again), "rid", "left_anti")
        bands = tmp.written(alone.select("rid", F.posexplode("bands").alias("band", "key")), "bands")
        buckets = tmp.written(bands.groupBy("key").agg(F.min("rid").alias("a"), F.count("*").alias("__n")).where("__n > 1"), "buckets")
        shared = common.hot_join(bands, buckets.drop("__n"), ["key"], "rid", counts=buckets.select("key", "__n"), total=bands.count())
        shared = tmp.written(shared.select("key", "band", "rid", "a"), "shared")
        tmp.drop("bands", "buckets")
        stars = tmp.written(shared.where("rid <> a").select("a", F.col("rid").alias("b")).distinct(), "pairs")
        links = tmp.written(confirm(stars, reps, words, tmp), "stars")
        comp = tmp.written(components(links, tmp), "components")
        labelled = shared.select("key", "band", "rid").join(common.checked(comp.withColumnRenamed("v", "rid")), "rid", "left").select("key", "band", "rid", F.coalesce("root", "rid").alias("comp"))
        labelled = tmp.written(labelled, "labelled")
        tmp.drop("shared", "pairs", "close", "ids")
        found = across_components(labelled, reps, words, tmp, tile)
        if found is not None:
            found = tmp.written(found, "found")
            if not found.isEmpty():
                comp = tmp.written(components(links.unionByName(found), tmp), "components")
        of_first = common.hot_join(same, comp.select(F.col("v").alias("first"), "root"), ["first"], "rid", "left").select(F.col("rid").alias("rep"), F.coalesce("root", "first").alias("comp"))
        members = sets.select("doc_id", "rid", "rep", "n").join(of_first, "rep", "left").select("doc_id", "rid", "n", F.coalesce("comp", "rid").alias("comp"))
        members = tmp.written(members, "members")
        least = tmp.written(members.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
        out = common.hot_join(members, least, ["comp"], "rid").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "rid", "comp")
        return common.written(out, "groups")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: components of all documents at four words."""
    return near_duplicates(common.read_table(spark, sf_dir, "documents"), words=4).drop("rid", "comp")


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS MATERIALIZED (
  SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM h x JOIN h y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
