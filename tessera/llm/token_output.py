"""Token-ID output with a shared zstandard dictionary.

Every document's ids are serialised as little-endian unsigned integers and
compressed on their own, with one dictionary trained on a bounded sample of
serialised id arrays. Documents are stored in ascending id order in blocks; a
block row carries the dictionary hash, the documents' ids, token counts and
the byte offset of each frame, so one short document is read by slicing and
decompressing its frame alone.

Layout under the output folder (written and read by Spark alone, so any store
that Spark reaches will do, and a lost task only rewrites its own files):

``dictionary``  one row: dict_hash, dictionary bytes, id width, end id
``blocks``      part, block, before (ids of the part's earlier blocks),
                dict_hash, first_id, last_id, doc_ids, n_tokens, offsets
                (one more than documents), payload

Defined results: a null text is an empty text (its only id is the end id);
rows with a null doc_id come first; rows that repeat a doc_id are all kept,
next to each other; an empty table gives an empty block table.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordCodes, by_document, file_bytes, one_per_worker, slices, whole_text

#: Documents (chosen by the hash of their id) whose ids train the dictionary, the
#: bytes of each that are used, and the size of the dictionary. Only the
#: compression ratio depends on them.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 256, 16_384, 65_536
#: New chunks that are encoded together.
GROUP = 128
#: A block ends after so many documents or so many compressed bytes.
BLOCK_DOCS, BLOCK_BYTES = 1_024, 1_000_000

BLOCK_SCHEMA = ("part int, block int, before bigint, dict_hash string, first_id bigint, last_id bigint, doc_ids array<bigint>, "
                "n_tokens array<bigint>, offsets array<bigint>, payload binary")

# Chunks of a text such that no pre-token of a byte-level tokenizer spans a joint: words of
# letters and digits before white space or a mark that ends them, such a mark, other visible
# runs (each with the space before it), and white space, cut as the pre-tokenizer cuts it.
_CHUNK = re.compile(r" ?[^\W_]++(?=[\s,.]|\Z)|[,.](?=\s|\Z)| ?\S++|\s+(?!\S)|\s")
# White space for Python's patterns but not for the pre-tokenizer's.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


class KeptCodes(WordCodes):
    """A word cache that, when full, keeps the words used most often (at most half
    of its limit, and none seen only once) instead of starting again empty."""

    def __init__(self, *args, **more):
        super().__init__(*args, **more)
        self.used = np.zeros(0, np.int64)

    def lookup(self, words: list[str]) -> np.ndarray:
        if len(self.codes) > self.limit:
            self._shrink()
        codes = super().lookup(words)
        used = np.bincount(codes, minlength=len(self.codes))
        used[:len(self.used)] += self.used
        self.used = used
        return codes

    def _shrink(self) -> None:
        half = self.limit // 2
        least = max(2, int(np.partition(self.used, -half)[-half]) + 1) if len(self.used) > half else 2
        keep = self.used >= least
        words = [w for w, k in zip(self.codes, keep.tolist(), strict=True) if k]  # in the order of their codes
        values, lengths = self.flat(np.flatnonzero(keep))
        self.codes = type(self.codes)()
        self.codes.update(zip(words, range(len(words)), strict=True))
        self.values, self.starts = values, np.concatenate([self.starts[:1], np.cumsum(lengths, dtype=np.int64)])
        self.used = self.used[keep] // 2  # older use counts less


class IdEncoder:
    """Whole texts to ids, exactly as the tokenizers library gives them.

    For a byte-level tokenizer without normaliser the text is cut where its
    pre-tokenizer never crosses (``_CHUNK``); the library encodes each distinct chunk of a slice once (many chunks joined
    in a string, told apart by their byte lengths). Texts holding an added
    token, and other kinds of tokenizer, go to the library whole."""

    def __init__(self, tokenizer_json: bytes):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json.decode("utf-8"))
        self.tok.no_padding()
        self.tok.no_truncation()
        spec = json.loads(tokenizer_json)
        pre = spec.get("pre_tokenizer") or {}
        self.by_chunk = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
                         and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                         and spec["model"].get("type") == "BPE")
        self.added = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        size = max(self.tok.get_vocab().values(), default=0) + 1
        self.byte_length = np.zeros(size, np.int64)
        for piece, i in self.tok.get_vocab().items():
            self.byte_length[i] = len(piece)  # byte-level pieces have one character per byte
        self.cache = KeptCodes(self._chunks, dtype=np.int32)

    def _special(self, text: str) -> bool:
        return any(a in text for a in self.added) or any(c in text for c in _SEPARATORS)

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, np.int64)

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encode, groups = self.tok.encode, range(0, len(chunks), GROUP)
        got = [encode("".join(chunks[a:a + GROUP]), add_special_tokens=False).ids for a in groups]
        flat = np.fromiter(chain.from_iterable(got), np.int64, sum(map(len, got)))
        ends = np.cumsum(self.byte_length[flat])
        stops = np.cumsum(np.fromiter(map(len, map(str.encode, chunks)), np.int64, len(chunks)))
        at = np.searchsorted(ends, stops, side="right")  # a group's ids spell its bytes, so groups end together
        counts = np.diff(at, prepend=0)
        if len(flat) and not np.array_equal(ends[at - 1], stops):
            # some joint merged: the chunks of its group are encoded one by one
            ids, lengths, start = [], [], 0
            merged = ends[at - 1] != stops
            for a, one in zip(groups, got, strict=True):
                if merged[a:a + GROUP].any():
                    each = [self._whole(c) for c in chunks[a:a + GROUP]]
                    ids += each
                    lengths += [len(e) for e in each]
                else:
                    ids.append(flat[start:start + len(one)])
                    lengths += counts[a:a + GROUP].tolist()
                start += len(one)
            return np.concatenate(ids), np.asarray(lengths, np.int64)
        return flat, counts

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for a, b in slices(texts):
            some = texts[a:b]
            whole = [not self.by_chunk or self._special(t) for t in some]
            words, per_doc = [], []
            for t, w in zip(some, whole, strict=True):
                chunks = [] if w or not t else _CHUNK.findall(t)
                words += chunks
                per_doc.append(len(chunks))
            ids, lengths = self.cache.flat(self.cache.lookup(words))
            n = by_document(lengths, np.asarray(per_doc, np.int64))
            ends = np.cumsum(n)
            for t, w, start, end in zip(some, whole, ends - n, ends, strict=True):
                yield self._whole(t) if w else ids[start:end]


def task_encoder(tokenizer_json: bytes) -> IdEncoder:
    """One encoder, and so one bounded cache, for all tasks of a Python worker."""
    return one_per_worker("id-encoder", tokenizer_json, lambda: IdEncoder(tokenizer_json))


def _sample(docs: DataFrame, tokenizer_json: bytes, dtype: str, end_id: int) -> list[bytes]:
    """Serialised id arrays of a bounded set of documents, chosen by the hash of their id."""
    chosen = [r[0] for r in docs.select("doc_id").where("doc_id is not null")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]
    if not chosen:
        return []

    def encoded(batches):
        enc = task_encoder(tokenizer_json)
        for batch in batches:
            out = [np.append(x, end_id).astype(dtype).tobytes()[:SAMPLE_BYTES]
                   for x in enc.encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "raw"])

    # a repeated doc_id may match more rows: one of each (the smallest bytes) goes in
    rows = (docs.where(F.col("doc_id").isin(chosen)).mapInArrow(encoded, "doc_id bigint, raw binary")
            .groupBy("doc_id").agg(F.min("raw").alias("raw")).orderBy("doc_id").collect())
    return [bytes(r["raw"]) for r in rows]


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A shared dictionary; empty when the sample is too small to train one."""
    total = sum(map(len, samples))
    if len(samples) < 8 or total < 8 * 1_024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(documents: DataFrame, path: str, tokenizer_json: bytes, end_id: int = 0,
                 id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode whole texts and write the dictionary and block tables under ``path``."""
    from tokenizers import Tokenizer

    spark = documents.sparkSession
    docs = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), whole_text(text_column).alias("text"))
    top = max([end_id, *Tokenizer.from_str(tokenizer_json.decode("utf-8")).get_vocab().values()])
    dtype = "<u2" if top < 1 << 16 else "<u4"
    dictionary = train_dictionary(_sample(docs, tokenizer_json, dtype, end_id))
    dict_hash = hashlib.sha256(dictionary).hexdigest()

    def blocks(batches):
        enc = task_encoder(tokenizer_json)
        zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=zdict, write_content_size=True, write_dict_id=False)
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids, counts, frames, size = [], [], [], 0

        def row():
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
            known = [i for i in ids if i is not None]
            one = {"part": [part], "block": [block], "before": [before], "dict_hash": [dict_hash], "first_id": [min(known, default=None)],
                   "last_id": [max(known, default=None)], "doc_ids": [list(ids)], "n_tokens": [list(counts)],
                   "offsets": [offsets.tolist()], "payload": [b"".join(frames)]}
            return pa.RecordBatch.from_pydict(one, schema=arrow)

        arrow = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("dict_hash", pa.string()),
                           ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                           ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())),
                           ("payload", pa.binary())])
        for batch in batches:
            for doc_id, got in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()),
                                   strict=True):
                frame = packer.compress(np.append(got, end_id).astype(dtype).tobytes())
                ids.append(doc_id)
                counts.append(len(got) + 1)
                frames.append(frame)
                size += len(frame)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield row()
                    block, before = block + 1, before + sum(counts)
                    ids, counts, frames, size = [], [], [], 0
        if ids:
            yield row()

    (docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
     .mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(f"{path}/blocks"))
    spark.createDataFrame([(dict_hash, dictionary, int(dtype[-1]), end_id)],
                          "dict_hash string, dictionary binary, width int, end_id bigint").coalesce(1).write.parquet(f"{path}/dictionary")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes, str]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    data = bytes(row["dictionary"])
    if hashlib.sha256(data).hexdigest() != row["dict_hash"]:
        raise ValueError(f"{path}: the dictionary doesn't match its hash")
    return row["dict_hash"], data, f"<u{row['width']}"


def _reader(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``: ids of all documents before a block.

    Parts follow the ids' order; their totals are one row per range partition,
    which bounds the window over all of them and its broadcast."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    sizes = blocks.select("part", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    return blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("part_start") + F.col("before")).drop("part_start")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents read back from the files: doc_id, start, ids (array).

    With ``doc_ids`` only the blocks that can hold them are read (their id range
    is pushed to the scan) and only their frames are decompressed."""
    dict_hash, dictionary, dtype = _dictionary(spark, path)
    wanted = None if doc_ids is None else set(doc_ids)
    blocks = read_blocks(spark, path)
    if wanted is not None:
        if not wanted:
            blocks = blocks.limit(0)
        else:
            blocks = blocks.where((F.col("first_id") <= max(wanted)) & (F.col("last_id") >= min(wanted)))

    def documents(batches):
        reader = _reader(dictionary)
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if r["dict_hash"] != dict_hash:
                    raise ValueError("a block was written with another dictionary")
                starts = r["start"] + np.concatenate([[0], np.cumsum(r["n_tokens"])])
                at = [i for i, d in enumerate(r["doc_ids"]) if wanted is None or d in wanted]
                for a in range(0, len(at), 64):
                    some = at[a:a + 64]
                    ids = [np.frombuffer(reader.decompress(r["payload"][r["offsets"][i]:r["offsets"][i + 1]]),
                                         dtype).astype(np.int32) for i in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["doc_ids"][i] for i in some], pa.int64()),
                         pa.array([int(starts[i]) for i in some], pa.int64()),
                         pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return (blocks.select("dict_hash", "doc_ids", "n_tokens", "offsets", "payload", "start")
            .mapInArrow(documents, "doc_id bigint, start bigint, ids array<int>"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids as little-endian
    unsigned 32-bit integers, from the files (ids stay inside the tasks)."""
    dict_hash, dictionary, dtype = _dictionary(spark, path)

    def digests(batches):
        reader = _reader(dictionary)
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                if r["dict_hash"] != dict_hash:
                    raise ValueError("a block was written with another dictionary")
                payload, offsets = memoryview(r["payload"]), r["offsets"]
                counts, sums = [], []
                for i in range(len(r["doc_ids"])):
                    ids = np.frombuffer(reader.decompress(payload[offsets[i]:offsets[i + 1]]), dtype)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                starts = r["start"] + np.cumsum(counts) - np.asarray(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(starts.astype(np.int64)),
                     pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return (read_blocks(spark, path).select("dict_hash", "doc_ids", "offsets", "payload", "start")
            .mapInArrow(digests, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def load_tokenizer(path: str) -> bytes:
    return file_bytes(path)
