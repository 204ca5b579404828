"""Token ids in shard files of separately compressed documents that share one zstandard dictionary.

A shard file is

    magic 8 bytes "PLZD0001" | dictionary's xxh64 8 bytes | frames, one per document | index | footer

The index has per document its doc_id (int64), a null mark (uint8), the frame's offset (uint64) and the number of ids
(uint32), column by column, all little-endian; the footer has the index's offset and the number of documents (both
uint64). A frame is the zstandard compression of the ids as little-endian unsigned 32-bit integers, so that any single
document is read with one small seek. The dictionary lies in dictionary.zdict, the list of shards in manifest.json.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.llm._tokenize import word_encoder
from palisade.llm._work import lean, small_batches

MAGIC = b"PLZD0001"
_FOOT = "<QQ"
_WROTE = "shard string, task long, n_docs long, n_ids long, first_id long, n_bytes long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def train_dictionary(id_arrays: list[bytes], size: int = 65536) -> bytes:
    """A zstandard dictionary from serialized id arrays; empty where there is too little to learn from."""
    import zstandard

    samples = [x for x in id_arrays if len(x) >= 8]
    if len(samples) < 8 or sum(map(len, samples)) < 8192:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary_hash(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data)


def _codec(data: bytes, level: int = 3):
    import zstandard

    d = zstandard.ZstdCompressionDict(data) if data else None
    return zstandard.ZstdCompressor(level=level, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


class ShardReader:
    """Random access to one shard; refuses a dictionary other than the one it was written with."""

    def __init__(self, fs: pafs.FileSystem, path: str, dictionary: bytes):
        self.f = fs.open_input_file(path)
        size = self.f.size()
        head = self.f.read_at(16, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{path} is no shard")
        if int.from_bytes(head[8:16], "little") != _dictionary_hash(dictionary):
            raise ValueError(f"{path} was written with another dictionary")
        at, n = struct.unpack(_FOOT, self.f.read_at(16, size - 16))
        raw = self.f.read_at(size - 16 - at, at)
        self.ids = np.frombuffer(raw, "<i8", n, 0)
        self.null = np.frombuffer(raw, np.uint8, n, 8 * n)
        self.offset = np.frombuffer(raw, "<u8", n, 9 * n)
        self.counts = np.frombuffer(raw, "<u4", n, 17 * n)
        self.end = at
        self.out = _codec(dictionary)[1]

    def __len__(self) -> int:
        return len(self.ids)

    def tokens(self, i: int) -> np.ndarray:
        start = int(self.offset[i])
        stop = int(self.offset[i + 1]) if i + 1 < len(self) else self.end
        return np.frombuffer(self.out.decompress(self.f.read_at(stop - start, start), max_output_size=4 * int(self.counts[i])), "<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document, or None; ids in a shard ascend, nulls first."""
        lo = int(self.null.sum())
        i = lo + int(np.searchsorted(self.ids[lo:], doc_id))
        return self.tokens(i) if i < len(self) and self.ids[i] == doc_id else None


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, dictionary_docs: int = 1000, level: int = 3) -> dict:
    """Encode every text, append end_id, write shards in ascending doc_id order; return the manifest.

    docs: doc_id, text (further columns are ignored). A null text is empty: its ids are just end_id. Documents with
    a null doc_id come first; equal doc_ids stand next to each other. The dictionary is trained on at most
    dictionary_docs documents (the one bounded sample here; it shapes file size, never content). A shard is written
    under a name of its own by each task attempt, and only those whose attempt succeeded are in the manifest, so
    lost executors and repeated tasks leave no half-written or doubled documents behind.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    encoder = word_encoder(tokenizer)
    sample = [encoder.encode(r.text) for r in docs.where(F.length("text").between(1, 20000)).limit(dictionary_docs).toLocalIterator()]
    dictionary = train_dictionary(sample)
    with fs.open_output_stream(f"{root}/dictionary.zdict") as f:
        f.write(dictionary)
    tail = np.array([end_id], "<u4").tobytes()
    shared = spark.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack = word_encoder(tokenizer), _codec(shared.value, level)[0]
        fs, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get().partitionId()
        path = f"{root}/shard-{task:06d}-{uuid.uuid4().hex}.plz"
        ids, null, offsets, counts, at, out = [], [], [], [], 16, None
        try:
            for batch in batches:
                for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                    if out is None:
                        out = fs.open_output_stream(path)
                        out.write(MAGIC + _dictionary_hash(shared.value).to_bytes(8, "little"))
                    raw = enc.encode(text) + tail
                    frame = pack.compress(raw)
                    out.write(frame)
                    ids.append(doc or 0)
                    null.append(doc is None)
                    offsets.append(at)
                    counts.append(len(raw) // 4)
                    at += len(frame)
            if out is None:
                return
            index = np.array(ids, "<i8").tobytes() + np.array(null, np.uint8).tobytes() + np.array(offsets, "<u8").tobytes() + np.array(counts, "<u4").tobytes()
            out.write(index + struct.pack(_FOOT, at, len(ids)))
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_pydict(
            {"shard": [path.rsplit("/", 1)[1]], "task": [task], "n_docs": [len(ids)], "n_ids": [sum(counts)], "first_id": [None if null[0] else ids[0]], "n_bytes": [at + len(index) + 16]},
            pa.schema([("shard", pa.string()), *((k, pa.int64()) for k in ("task", "n_docs", "n_ids", "first_id", "n_bytes"))]),
        )

    sorted_docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards, start = [], 0
    for r in sorted(sorted_docs.mapInArrow(lean(write, "tokenizer"), _WROTE).collect(), key=lambda r: r.task):  # a row per shard
        shards.append({"shard": r.shard, "start": start, "n_docs": r.n_docs, "n_ids": r.n_ids, "first_id": r.first_id, "n_bytes": r.n_bytes})
        start += r.n_ids
    manifest = {"dictionary_xxh64": f"{_dictionary_hash(dictionary):016x}", "end_id": end_id, "n_ids": start, "shards": shards}
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that write_token_files left."""
    fs, root = pafs.FileSystem.from_uri(folder)
    manifest = json.loads(fs.open_input_file(f"{root}/manifest.json").read())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        dictionary = fs.open_input_file(f"{root}/dictionary.zdict").read()
        for batch in batches:
            for shard, base in zip(batch["shard"].to_pylist(), batch["start"].to_pylist()):
                r = ShardReader(fs, f"{root}/{shard}", dictionary)
                starts = base + np.cumsum(r.counts, dtype=np.int64) - r.counts
                for i in range(0, len(r), 10000):
                    part = slice(i, i + 10000)
                    crc = [zlib.crc32(r.tokens(j).tobytes()) for j in range(i, min(i + 10000, len(r)))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.ids[part], pa.int64(), mask=r.null[part].astype(bool)), pa.array(starts[part], pa.int64()), pa.array(r.counts[part].astype(np.int64)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    shards = spark.createDataFrame([(s["shard"], s["start"]) for s in manifest["shards"]], "shard string, start long")
    return shards.repartition(max(1, len(manifest["shards"]))).mapInArrow(read, _READ)
