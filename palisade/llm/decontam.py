"""Benchmark decontamination: Wu-Manber search over words for windows of benchmark items."""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palisade.llm._work import keep, lean, small_batches

#: Words of a window.
WINDOW = 13
#: Bytes of benchmark text that one pass broadcasts at most; larger benchmarks take several passes. Tables take some 70 bytes of memory a byte.
PASS_BYTES = 4 << 20
#: Keeps bytes of words, lower-cases A-Z and makes a space of any other ASCII byte.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


class WuManber:
    """Finds many word sequences. Sequences of one length form a class with a shift table and suffix-hash buckets.

    The block is two words (one in classes of single words). A block that ends nowhere in a class's sequences shifts
    by length - block + 1; one that does, by its least distance from an end; at distance 0 the bucket of the block's
    hash is compared word by word.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.items = items
        by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)  # (item, start) of each window
        for k, (_, w) in enumerate(items):
            if w:
                m = min(window, len(w))
                by_length[m] += [(k, i) for i in range(len(w) - m + 1)]
        self.classes = []
        for m, windows in by_length.items():
            size = min(2, m)
            shift: dict[int, int] = {}
            bucket: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for k, start in windows:
                w = items[k][1]
                for j in range(size, m + 1):
                    block = hash(tuple(w[start + j - size : start + j]))
                    if shift.get(block, m) > m - j:
                        shift[block] = m - j
                bucket[hash(tuple(w[start + m - size : start + m]))].append((k, start))
            self.classes.append((m, size, shift, dict(bucket)))

    def find(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [from, to) of words under any occurrence, and the items that occur."""
        spans, items, n = [], set(), len(w)
        for m, size, shift, bucket in self.classes:
            far, i = m - size + 1, m
            get = shift.get
            while i <= n:
                block = hash((w[i - 2], w[i - 1])) if size == 2 else hash((w[i - 1],))
                step = get(block, far)
                if step:
                    i += step
                    continue
                here, hit = w[i - m : i], False
                for k, start in bucket[block]:
                    name, v = self.items[k]
                    if v[start : start + m] == here:
                        hit = True
                        items.add(name)
                if hit:
                    spans.append((i - m, i))
                i += 1
        return spans, items


#: Broadcast, window and finder of this worker's last task.
_LAST: list = [None, None, None]


def _finder(shared, window: int) -> WuManber:
    """Built once a worker, not once a task; a worker has one object for each broadcast."""
    if _LAST[0] is not shared or _LAST[1] != window:
        _LAST[:] = [None, None, None]
        keep("decontam", lambda: _LAST.__setitem__(slice(None), [None, None, None]))
        _LAST[:] = [shared, window, WuManber([(item, split_words(text)) for item, text in shared.value], window)]
    return _LAST[2]


def _passes(items: Iterator, window: int) -> Iterator[list[tuple[str, str]]]:
    """Items by parts of at most PASS_BYTES (and one word); a larger item is cut into pieces that share window - 1 words."""
    part: list[tuple[str, str]] = []
    size = 0
    for r in items:
        texts = [r.text]
        if len(r.text.encode("utf-8", "surrogatepass")) > PASS_BYTES:
            w = [x.decode("utf-8", "surrogatepass") for x in split_words(r.text)]
            if len(w) > window:
                texts, at = [], 0
                while at == 0 or at + window <= len(w):
                    end, room = at + window, PASS_BYTES - sum(len(x.encode("utf-8", "surrogatepass")) + 1 for x in w[at : at + window])
                    while end < len(w) and room > 0:
                        room -= len(w[end].encode("utf-8", "surrogatepass")) + 1
                        end += 1
                    texts.append(" ".join(w[at:end]))
                    at = end - window + 1
        for text in texts:
            more = len(text.encode("utf-8", "surrogatepass"))
            if part and size + more > PASS_BYTES:
                yield part
                part, size = [], 0
            part.append((r.item_id, text))
            size += more
    yield part


def _search(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared, window)
        for batch in batches:
            count, hits, names = [], [], []
            for text in batch["text"].to_pylist():
                w = split_words(text)
                spans, found = finder.find(w)
                count.append(len(w))
                mask = b""
                if spans:
                    hit = np.zeros(len(w), bool)
                    for a, b in spans:
                        hit[a:b] = True
                    mask = np.packbits(hit).tobytes()
                hits.append(mask)
                names.append(sorted(found))
            rest = [k for k in batch.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch[k] for k in rest), pa.array(count, pa.int64()), pa.array(hits, pa.binary()), pa.array(names, pa.list_(pa.string()))],
                [*rest, "n_words", "hits", "items"],
            )

    kept = ", ".join(f"`{k}` {t}" for k, t in docs.dtypes if k != "text")
    return docs.mapInArrow(lean(scan, "decontam"), f"{kept}, n_words long, hits binary, items array<string>")


def _summary(found: DataFrame, share: int = 20) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) if x else 0 for x in batch["hits"].to_pylist()]
            names = batch["items"].to_pylist()
            n = batch["n_words"].to_pylist()
            cols = {
                "n_words": pa.array(n, pa.int64()),
                "n_hit": pa.array(hit, pa.int64()),
                "n_items": pa.array([len(x) for x in names], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]),
                "contaminated": pa.array([h > 0 and share * h >= w for h, w in zip(hit, n)]),
            }
            rest = [k for k in batch.schema.names if k not in ("n_words", "hits")]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in rest), *cols.values()], [*rest, *cols])

    kept = ", ".join(f"`{k}` {t}" for k, t in found.dtypes if k not in ("n_words", "hits"))
    return found.mapInArrow(count, f"{kept}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, keep: bool = False) -> DataFrame:
    """(doc_id, items, n_words, n_hit, n_items, items_sha256, contaminated) for every row of docs.

    docs: doc_id, text; benchmark: item_id, text (further columns are ignored). With keep, the rows of docs come along whole,
    as a struct named row. Null or wordless texts have no words
    and no hits; items without words have no windows; items without an id go by the empty string. Every row of docs is
    answered, repeated ones each. A benchmark that fits PASS_BYTES is broadcast and
    searched in one pass without a shuffle; a larger one is cut into such parts, each searched in turn, and the
    word masks of a document are then united by its row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    passes = _passes(items.toLocalIterator(), window)  # the driver holds one part at a time
    one, two = next(passes), next(passes, None)
    if two is None:
        return _summary(_search(docs, one, window), share)
    rows = docs.withColumn("row_", F.monotonically_increasing_id())
    found = None
    for part in itertools.chain([one, two], passes):
        hits = _search(rows, part, window)
        found = hits if found is None else found.unionByName(hits)

    masks = F.collect_list("hits").alias("masks")
    whole = found.groupBy("row_").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), masks, F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), *([F.first("row").alias("row")] if keep else []))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for masks in batch["masks"].to_pylist():
                arrays = [np.frombuffer(x, np.uint8) for x in masks if x]
                hits.append(np.bitwise_or.reduce(arrays).tobytes() if arrays else b"")
            names = [k for k in batch.schema.names if k != "masks"]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in names), pa.array(hits, pa.binary())], [*names, "hits"])

    kept = ", ".join(f"`{k}` {t}" for k, t in whole.dtypes if k != "masks")
    return _summary(whole.mapInArrow(unite, f"{kept}, hits binary").drop("row_"), share)
