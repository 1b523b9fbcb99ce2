"""Token-id output: documents as zstandard frames under one shared dictionary, with an offset index.

Method. A zstandard dictionary is trained on the id arrays of a bounded sample; every document is
then compressed on its own, so that a short document can be read without its neighbours. Frames
lie in blocks, in ascending doc_id order; each block carries the dictionary's hash, the byte offset
of every frame, and its documents' ids.

Layout under the output path (Parquet containers, so any store that Spark writes will do):

* ``dictionary``: dict_sha256, id_width (bytes of an id, little-endian), dictionary
* ``blocks/shard=k``: block, dict_sha256, n_ids, doc_ids[], offsets[], n_tokens[], payload
* ``starts``: shard, block, block_start (number of ids before the block), min_doc, max_doc (the block's first and last doc_id, null for none)

fetch() finds the blocks of a few documents in ``starts`` and reads only the folders of their shards.

Defined results. An id that id_width bytes cannot hold raises an error. Null text is empty: the document is the end id alone. Null doc_ids come first.
Rows of equal doc_id are ordered by their number of ids, then by checksum. Extra columns are ignored.
An empty table gives empty tables, with a dictionary of no bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common, minhash

END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Training sample of the dictionary: whole texts of at most SAMPLE_BYTES, the SAMPLE_DOCS of the smallest digests of their doc_id.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 2_000, 8_192, 65_536
#: A shard holds about so many documents. Shard bounds are taken from about SHARD_SAMPLE doc_ids a shard, at most
#: MAX_BOUNDS of them in all; beyond MAX_BOUNDS / SHARD_SAMPLE shards, shards grow instead, and tasks sort them with spills.
DOCS_PER_SHARD, SHARD_SAMPLE, MAX_BOUNDS = 5_000, 32, 4_000_000
#: A block is closed beyond either.
BLOCK_BYTES, BLOCK_DOCS = 4 << 20, 4_096
#: Words whose ids a Python worker remembers.
CACHE_WORDS = 1_500_000
ENCODED = "shard int, doc_id long, n_tokens int, crc long, frame binary"
BLOCKS = "shard int, block int, dict_sha256 string, n_ids long, doc_ids array<bigint>, offsets array<bigint>, n_tokens array<int>, payload binary"
STARTS = "shard int, block int, block_start long, min_doc long, max_doc long"
READ = "shard int, block int, doc_id long, n_tokens long, ids_crc32 long, in_block long"

#: Byte classes: 0 white space, 1 ASCII letters, 2 digits and punctuation that no rule of the
#: tokenizer joins to letters, 3 what must keep its neighbours (apostrophes and non-ASCII bytes).
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
for _c in b"!\"#$%&()*+,-./:;?@[\\]^_{|}~":
    _CLASS[_c] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_held: dict = {}


def _pieces(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Offsets that cut the bytes of whole texts where the tokenizer always cuts too.

    White space ends every match of its splitting rule; so does a step from an ASCII letter to a
    digit or plain punctuation mark, and back. Trailing white space stays with its piece.
    """
    k = _CLASS[data]
    now, before = k[1:], k[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[1 : len(data)] = ((before == 0) & (now != 0)) | ((before == 1) & (now == 2)) | ((before == 2) & (now == 1))
    cut[off] = True
    return np.flatnonzero(cut)


class _Encoder:
    """Whole texts to ids; ids of pieces are remembered, since words repeat."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        """Forget all words. They are kept by two hashes, ordered by the first, and not as strings: 36 bytes each."""
        self.hash, self.proof = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint16)

    def _learn(self, words: list, hashes: np.ndarray, proofs: np.ndarray) -> None:
        """Add new words, given with their hashes in ascending order."""
        got = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        size = np.array([len(g) for g in got], np.int32)
        begin = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
        ids = np.concatenate(got)
        if ids.size and ids.max() > np.iinfo(self.flat.dtype).max:
            self.flat = self.flat.astype(np.uint32)
        self.flat = np.concatenate([self.flat, ids.astype(self.flat.dtype)])
        at = np.searchsorted(self.hash, hashes)
        self.hash, self.proof, self.begin, self.size = (np.insert(x, at, y) for x, y in ((self.hash, hashes), (self.proof, proofs), (self.begin, begin), (self.size, size)))

    def _slots(self, words) -> np.ndarray | None:
        """Where the words of an Arrow array (all different) are kept; unknown ones are learned first. None if two share a hash."""
        data, off = common.column_bytes(words)
        h, proof = (minhash.hash_spans(data, off[:-1], off[1:], s) for s in (0, 0x5EED))
        if len(self.hash) + len(words) > CACHE_WORDS:
            self.clear()
        at = np.minimum(np.searchsorted(self.hash, h), max(len(self.hash) - 1, 0))
        new = self.hash[at] != h if len(self.hash) else np.ones(len(h), bool)
        if new.any():
            own = np.flatnonzero(new)
            own = own[np.argsort(h[own], kind="stable")]
            self._learn(words.take(pa.array(own)).to_pylist(), h[own], proof[own])
            at = np.searchsorted(self.hash, h)
        return None if (self.proof[at] != proof).any() else at

    def _plainly(self, col) -> tuple[np.ndarray, np.ndarray]:
        each = [self.tok.encode(t, add_special_tokens=False).ids for t in col.to_pylist()]
        lens = np.array([len(e) for e in each], np.int64)
        return np.concatenate([np.array(e, np.uint32) for e in each]), np.concatenate([[0], np.cumsum(lens)])

    def encode(self, col) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow string array, and the n + 1 offsets of the texts into them."""
        data, off = common.column_bytes(col)
        raw = data.tobytes()
        if any(s in raw for s in self.special):  # such strings are tokens of their own in a raw text: no short cut
            return self._plainly(col)
        cuts = _pieces(data, off)
        low = pa.py_buffer(_LOWER[data].tobytes())
        words = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64).tobytes()), low)
        coded = words.dictionary_encode()
        slots = self._slots(coded.dictionary)
        if slots is None:
            return self._plainly(col)
        at = slots[coded.indices.to_numpy()]
        lens, begin = self.size[at], self.begin[at]
        ends = np.cumsum(lens, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        shift = begin - (ends - lens)
        ids = self.flat[np.arange(total, dtype=np.int64) + np.repeat(shift, lens)]
        before = np.concatenate([[0], ends])
        return ids.astype(np.uint32), before[np.searchsorted(cuts, off)]


def _encoder(path: str) -> _Encoder:
    if path not in _held:
        _held[path] = _Encoder(path)
    return _held[path]


def _slices(batch: pa.RecordBatch, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about max_bytes of text each, one row at least."""
    _, off = common.column_bytes(batch.column("text"))
    start, n = 0, batch.num_rows
    while start < n:
        stop = max(start + 1, int(np.searchsorted(off, off[start] + max_bytes, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def _id_arrays(path: str, batch: pa.RecordBatch, end_id: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    for part in _slices(batch):
        ids, off = _encoder(path).encode(part.column("text"))
        end = np.array([end_id], np.uint32)
        yield part, [np.concatenate([ids[off[k] : off[k + 1]], end]) for k in range(part.num_rows)]


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, width: int) -> bytes:
    """A zstandard dictionary from the id arrays of a bounded sample; empty where there is too little to train on."""
    step = max(1, docs.count() // (4 * SAMPLE_DOCS))
    h = F.xxhash64("doc_id")
    some = docs.where((F.pmod(h, F.lit(step)) == 0) & F.octet_length("text").between(1, SAMPLE_BYTES))
    texts = [r.text for r in some.select("text").orderBy(h, "text").limit(SAMPLE_DOCS).collect()]
    if not texts:
        return b""
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    samples = [_packed(a, width) for _, arrays in _id_arrays(tokenizer_path, batch, end_id) for a in arrays]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _packed(ids: np.ndarray, width: int) -> bytes:
    """The ids in width bytes each, little-endian."""
    if len(ids) and int(ids.max()) >= 1 << (8 * width):
        raise ValueError(f"id {int(ids.max())} does not fit into {width} bytes")
    return ids.astype(f"<u{width}").tobytes()


def shard_bounds(ids: DataFrame) -> np.ndarray:
    """Ascending doc_ids that cut ids (doc_id, no nulls) into shards of about DOCS_PER_SHARD rows: quantiles of a sample by digest.

    Shards are known by ranges of doc_id, so repeated doc_ids stay together.
    """
    n = ids.count()
    shards = max(1, min(n // DOCS_PER_SHARD, MAX_BOUNDS // SHARD_SAMPLE))
    if shards == 1:
        return np.zeros(0, np.int64)
    step = max(1, n // (shards * SHARD_SAMPLE))
    held = np.sort(ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).toArrow()["doc_id"].to_numpy())
    return np.unique(held[np.arange(1, shards) * len(held) // shards]) if len(held) else np.zeros(0, np.int64)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, id_width: int = 2, level: int = 3) -> None:
    """Encode docs (doc_id, text), append end_id to each, and write the layout above under path.

    Two passes over the text: one for the dictionary's sample, one that tokenizes. Only compressed
    frames are shuffled, once, to the shard of their doc_id range.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text().alias("text"))
    dictionary = train_dictionary(docs, tokenizer_path, end_id, id_width)
    sha = hashlib.sha256(dictionary).hexdigest()
    bounds = shard_bounds(docs.select("doc_id").where("doc_id is not null"))
    shards = len(bounds) + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for part, arrays in _id_arrays(tokenizer_path, batch, end_id):
                doc = part.column("doc_id")
                at = np.searchsorted(bounds, doc.fill_null(np.iinfo(np.int64).min).to_numpy(), side="right").astype(np.int32)
                yield pa.record_batch([
                    pa.array(at), doc, pa.array([len(a) for a in arrays], pa.int32()),
                    pa.array([zlib.crc32(a.astype("<u4")) for a in arrays], pa.int64()),
                    pa.array([packer.compress(_packed(a, id_width)) for a in arrays], pa.binary()),
                ], names=["shard", "doc_id", "n_tokens", "crc", "frame"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, rows, held = None, 0, [], 0

        def close():
            ends = np.cumsum([len(r[2]) for r in rows])
            return pa.record_batch([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([sha]), pa.array([sum(r[1] for r in rows)], pa.int64()),
                pa.array([[r[0] for r in rows]], pa.list_(pa.int64())), pa.array([[0, *ends.tolist()]], pa.list_(pa.int64())),
                pa.array([[r[1] for r in rows]], pa.list_(pa.int32())), pa.array([b"".join(r[2] for r in rows)], pa.binary()),
            ], names=["shard", "block", "dict_sha256", "n_ids", "doc_ids", "offsets", "n_tokens", "payload"])

        for batch in batches:
            for s, d, n, frame in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "n_tokens", "frame"))):
                if rows and (s != shard or held >= BLOCK_BYTES or len(rows) >= BLOCK_DOCS):
                    yield close()
                    block, rows, held = (block + 1 if s == shard else 0), [], 0
                shard = s
                rows.append((d, n, frame))
                held += len(frame)
        if rows:
            yield close()

    spark.createDataFrame([(sha, id_width, bytearray(dictionary))], "dict_sha256 string, id_width int, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    encoded = docs.mapInArrow(encode, ENCODED).repartitionById(shards, F.col("shard"))
    blocks = encoded.sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "n_tokens", "crc").select("shard", "doc_id", "n_tokens", "frame").mapInArrow(pack, BLOCKS)
    blocks.write.partitionBy("shard").option("compression", "none").parquet(f"{path}/blocks")
    block_starts(_blocks(spark, path)).coalesce(1).write.parquet(f"{path}/starts")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select(*(f.split()[0] for f in BLOCKS.split(", ")))


def block_starts(blocks: DataFrame) -> DataFrame:
    """Ids before each block: a running sum within shards, and one over the sums of the shards, at most MAX_BOUNDS / SHARD_SAMPLE; and the block's first and last doc_id."""
    sizes = blocks.select("shard", "block", "n_ids", F.array_min("doc_ids").alias("min_doc"), F.array_max("doc_ids").alias("max_doc"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("own", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(base, "shard").select("shard", "block", (F.col("base") + F.col("own")).alias("block_start"), "min_doc", "max_doc")


def _opener(spark: SparkSession, path: str):
    """(dict_sha256, id_width, dictionary) of a written output."""
    r = spark.read.parquet(f"{path}/dictionary").first()
    return r.dict_sha256, r.id_width, bytes(r.dictionary)


def _unpack(row: dict, k: int, opener, unpacker) -> np.ndarray:
    sha, width, _ = opener
    if row["dict_sha256"] != sha:
        raise ValueError(f"block {row['shard']}/{row['block']} was written with another dictionary")
    a, b = row["offsets"][k], row["offsets"][k + 1]
    return np.frombuffer(unpacker.decompress(row["payload"][a:b]), dtype=f"<u{width}")


def _unpacker(opener):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(opener[2]) if opener[2] else None)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a written output, decoded from its frame: doc_id, start, n_tokens, ids_crc32."""
    opener = _opener(spark, path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = _unpacker(opener)
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["doc_ids"])
                arrays = [_unpack(row, k, opener, unpacker) for k in range(n)]
                sizes = np.array([len(a) for a in arrays], np.int64)
                if sizes.tolist() != row["n_tokens"]:
                    raise ValueError(f"block {row['shard']}/{row['block']}: frames and index differ")
                yield pa.record_batch([
                    pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(sizes),
                    pa.array([zlib.crc32(a.astype("<u4")) for a in arrays], pa.int64()), pa.array(np.cumsum(sizes) - sizes),
                ], names=["shard", "block", "doc_id", "n_tokens", "ids_crc32", "in_block"])

    starts = spark.read.schema(STARTS).parquet(f"{path}/starts")
    return _blocks(spark, path).mapInArrow(decode, READ).join(starts.select("shard", "block", "block_start"), ["shard", "block"]).select("doc_id", (F.col("block_start") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """doc_id, ids of a few documents: all rows of these doc_ids (null too), none for ids that were not written.

    The index names the blocks that may hold them; only the files of those blocks' shards are opened, and
    only the wanted frames decompressed. An id asked for twice counts once.
    """
    opener, wanted = _opener(spark, path), set(doc_ids)
    ids = sorted(d for d in wanted if d is not None)
    starts = spark.read.schema(STARTS).parquet(f"{path}/starts")
    asked = spark.createDataFrame([(int(d),) for d in ids], "doc_id long")
    may = starts.join(F.broadcast(asked), F.col("doc_id").between(F.col("min_doc"), F.col("max_doc")), "left_semi").select("shard", "block")
    if None in wanted:  # they lie in front
        may = may.unionByName(starts.where("shard = 0").select("shard", "block"))
    shards = sorted({r.shard for r in may.select("shard").distinct().collect()})

    def pick(batches):
        unpacker = _unpacker(opener)
        for batch in batches:
            for row in batch.to_pylist():
                got = [(d, _unpack(row, k, opener, unpacker).tolist()) for k, d in enumerate(row["doc_ids"]) if d in wanted]
                yield pa.record_batch([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    held = _blocks(spark, path).where(F.col("shard").isin(shards)).join(F.broadcast(may.distinct()), ["shard", "block"], "left_semi")
    return held.mapInArrow(pick, "doc_id long, ids array<bigint>")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: write all documents as token ids, then read the files back."""
    import public_tokenizers

    path = common.table_path(spark, "tokens")  # the files are the output, and the result reads them
    write_tokens(common.read_table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return read_tokens(spark, path)
