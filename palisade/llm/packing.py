"""Vector best-fit packing of token pieces into training sequences.

Every bin has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). What a piece
takes of each depends on its length alone, so pieces of one length are interchangeable and a corpus is known by its
histogram of lengths, which has at most as many entries as a sequence has tokens. The plan is made on that histogram,
for the whole corpus at once and with exact best-fit choices, and then dealt out to the pieces by their rank among
those of their length. So the packing is global, yet nothing that grows with the corpus meets in one place.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from palisade.llm._tokenize import word_encoder
from palisade.llm._work import cut, lean, small_batches


@dataclass(frozen=True)
class Capacity:
    """Of one sequence. attention None: tokens squared, which no set of pieces within tokens can exceed."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


@dataclass
class Plan:
    """Runs: pieces of a length, from a rank on, stand t to a bin in bins first_bin.. at an offset."""

    length: np.ndarray
    rank: np.ndarray
    per_bin: np.ndarray
    first_bin: np.ndarray
    offset: np.ndarray
    n_bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of the pieces with these ranks among those of their length."""
        key = (self.length.astype(np.int64) << 44) | self.rank
        at = np.searchsorted(key, (length.astype(np.int64) << 44) | rank, "right") - 1
        k = rank - self.rank[at]
        return self.first_bin[at] + k // self.per_bin[at], self.offset[at] + (k % self.per_bin[at]) * length


def best_fit(histogram: dict[int, int], capacity: Capacity, weights=(1.0, 0.25, 0.25), score: str = "norm") -> Plan:
    """Best-fit decreasing on a histogram of lengths, under every capacity.

    Open bins with equal residual vectors form a class. A piece goes to the class that fits it in all dimensions and has
    the smallest weighted norm of the residual left (score "norm") or the largest weighted dot product of what it takes
    with what the bin has taken (score "dot"), both as shares of the capacities; ties go to the class opened first. If
    none fits, a new bin opens. Equal pieces are placed together: having gone into a bin, the next one's best bin is,
    under the norm, that same bin until it is full, so a class's bins are filled with as many as fit before the next.
    """
    cap = capacity.vector()
    w = np.asarray(weights, float)
    residual = np.zeros((0, 3), np.int64)
    bins: list[list[tuple[int, int]]] = []
    index: dict[tuple[int, int, int], int] = {}
    free: list[int] = []
    runs: list[tuple[int, int, int, int, int]] = []
    n_bins = 0

    def add(left: np.ndarray, ranges: list[tuple[int, int]]) -> None:
        nonlocal residual
        if left[0] <= 0 or left[1] <= 0 or left[2] <= 0:
            return
        k = tuple(left.tolist())
        if k in index:
            bins[index[k]].extend(ranges)
            return
        if free:
            i = free.pop()
            residual[i] = left
            bins[i] = list(ranges)
        else:
            i = len(bins)
            if i >= len(residual):
                residual = np.concatenate([residual, np.zeros((max(64, len(residual)), 3), np.int64)])
            residual[i] = left
            bins.append(list(ranges))
        index[k] = i

    for length in sorted((n for n, c in histogram.items() if c and n > 0), reverse=True):
        take = np.array([length, 1, length * length], np.int64)
        if (take > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        left_over, rank = histogram[length], 0
        while left_over:
            open_ = residual[: len(bins)]
            fits = np.flatnonzero((open_ >= take).all(axis=1)) if len(bins) else np.zeros(0, int)
            if len(fits):
                rest = (open_[fits] - take) / cap
                if score == "norm":
                    best = int(fits[np.argmin((w * rest * rest).sum(axis=1))])
                else:
                    used = 1 - open_[fits] / cap
                    best = int(fits[np.argmax((w * used * (take / cap)).sum(axis=1))])
                left, ranges = residual[best].copy(), bins[best]
            else:
                per = int((cap // take).min())
                count = -(-left_over // per)
                best, left, ranges = -1, cap.copy(), [(n_bins, count)]
                n_bins += count
            per = int((left // take).min())
            if left_over < per:
                per = left_over
            want = left_over // per
            used_bins, spare = [], []
            for first, count in ranges:
                k = min(count, want)
                if k:
                    used_bins.append((first, k))
                    want -= k
                if count > k:
                    spare.append((first + k, count - k))
            at = int(cap[0] - left[0])
            for first, count in used_bins:
                runs.append((length, rank, per, first, at))
                rank += per * count
                left_over -= per * count
            if best >= 0:
                del index[tuple(left.tolist())]
                residual[best] = 0
                bins[best] = []
                free.append(best)
            if spare:
                add(left, spare)
            add(left - per * take, used_bins)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return Plan(*table.T, n_bins)


def pack_pieces(pieces: DataFrame, capacity: Capacity = Capacity(), weights=(1.0, 0.25, 0.25), score: str = "norm") -> DataFrame:
    """pieces with sequence_id and offset added. pieces: any columns, among them length (1..tokens, not null).

    Ranks within a length come from counts per input partition: each task numbers its own pieces, and a running sum of
    the counts (at most partitions x lengths rows) gives the base. The driver gets the histogram alone, at most
    capacity.tokens rows, and broadcasts the plan, a few runs for each length. No pieces give no rows.
    """
    spark = pieces.sparkSession

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = defaultdict(int)
        task = TaskContext.get().partitionId()
        for batch in batches:
            n = np.asarray(batch["length"])
            order = np.argsort(n, kind="stable")
            kinds, first, count = np.unique(n[order], return_index=True, return_counts=True)
            local = np.empty(len(n), np.int64)
            local[order] = np.arange(len(n)) - np.repeat(first, count)
            local += np.repeat([seen[k] for k in kinds.tolist()], count)[np.argsort(order, kind="stable")] if len(n) else 0
            for k, c in zip(kinds.tolist(), count.tolist()):
                seen[k] += c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), task), pa.int64()), pa.array(local)], [*batch.schema.names, "task_", "local_"])

    fields = ", ".join(f"`{k}` {t}" for k, t in pieces.dtypes)
    numbered = cut(pieces.mapInArrow(number, f"{fields}, task_ long, local_ long"))
    counts = numbered.groupBy("length", "task_").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task_").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "task_", F.coalesce(before, F.lit(0)).alias("base_"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit(histogram, capacity, weights, score))
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = np.asarray(batch["base_"]) + np.asarray(batch["local_"])
            seq, at = plan.value.place(np.asarray(batch["length"]), rank) if len(rank) else (rank, rank)
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in names), pa.array(seq, pa.int64()), pa.array(at, pa.int64())], [*names, "sequence_id", "offset"])

    return numbered.join(base, ["length", "task_"]).select(*names, "base_", "local_").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def cut_documents(docs: DataFrame, tokenizer: str, most: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document: its ids, end_id, cut every `most` ids.

    docs: doc_id, text (further columns are ignored). A null or empty text has end_id alone. Repeated rows are cut each.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tail = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                raw = enc.encode(text) + tail
                for k, at in enumerate(range(0, len(raw), 4 * most)):
                    part = raw[at : at + 4 * most]
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if keep_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32"))]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(out["ids"], pa.list_(pa.int32()))] if keep_ids else []), list(out)[: 6 if keep_ids else 5])

    return docs.mapInArrow(lean(work, "tokenizer"), "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else ""))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), end_id: int = 1, keep_ids: bool = False, **how) -> DataFrame:
    """Whole documents cut into pieces and packed: cut_documents with sequence_id and offset."""
    return pack_pieces(cut_documents(docs, tokenizer, capacity.tokens, end_id, keep_ids), capacity, **how)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) of packed pieces with ids: a row for each sequence, of at most its capacity."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
