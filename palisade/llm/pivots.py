"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), in order. Vectors that are alike see nearly the same pivots as
nearest, though not in the same order, so a vector stands in one inverted list for each unordered pair of the first NEAREST of its
permutation: two vectors meet if they share two or more of these. They are then verified by their cosine in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palisade.llm._work import cut, lean, partitions, small_batches
from palisade.llm.components import connected_components

#: Reference points, drawn from a sample of about PIVOT_SAMPLE vectors; every vector is indexed.
PIVOTS, PIVOT_SAMPLE = 256, 4096
#: Nearest pivots by whose pairs a vector is listed. Of unrelated vectors (15 of 32,640 lists each) 0.7 % of the pairs meet; of those with cosine 0.93, 0.98.
NEAREST = 6
#: Members of an inverted list that are compared at once; pairs verified at once.
BLOCK, PAIRS = 1024, 1 << 16


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """n unit vectors from a sample by farthest-first traversal, so that they spread and no two are alike."""
    if not len(sample):
        return sample
    picked = [0]
    near = sample @ sample[0]
    while len(picked) < min(n, len(sample)):
        i = int(np.argmin(near))
        if near[i] > 0.999:
            break
        picked.append(i)
        near = np.maximum(near, sample @ sample[i])
    return sample[picked]


def _matrix(col: pa.Array) -> tuple[list[int], np.ndarray]:
    """Rows with a usable vector, and these as float64; other rows are null, zero, empty, or hold null or non-finite components."""
    rows, vectors = [], []
    for i, x in enumerate(col.to_pylist()):
        if x is None or not len(x) or any(v is None for v in x):
            continue
        v = np.asarray(x, np.float64)
        if np.isfinite(v).all() and v.any():
            rows.append(i)
            vectors.append(v)
    return rows, vectors


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=-1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=-1, keepdims=True))


def _lists(near: np.ndarray) -> np.ndarray:
    """Lists of each row of ascending nearest pivots: one for each two of them, or for a single one."""
    if near.shape[1] < 2:
        return near.astype(np.int64)
    return np.stack([near[:, i].astype(np.int64) * PIVOTS + near[:, j] for i, j in combinations(range(near.shape[1]), 2)], axis=1)


def _indexed(rows: DataFrame, pivots, kind: str) -> DataFrame:
    """Every row: id, label; of usable vectors of labelled rows also raw (bytes of numbers of `kind`), digest, near (ascending nearest pivots) and lists."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: np.ndarray = pivots.value
        for batch in batches:
            at, vectors = _matrix(batch["embedding"])
            ready = [i is not None and x is not None for i, x in zip(batch["vec_id"].to_pylist(), batch["label"].to_pylist())]
            raw, digest, near, lists = ([None] * batch.num_rows for _ in range(4))
            by_size: dict[int, list[int]] = {}
            for k, (i, v) in enumerate(zip(at, vectors)):
                if ready[i]:
                    by_size.setdefault(len(v), []).append(k)
                    raw[i] = v.astype(kind).tobytes()
                    digest[i] = hashlib.blake2b(raw[i], digest_size=16).digest()
            for size, members in by_size.items():
                if p.ndim == 2 and p.shape[1] == size:
                    score = _unit(np.stack([vectors[k] for k in members])) @ p.T
                    first = np.sort(np.argsort(-score, axis=1, kind="stable")[:, :NEAREST], axis=1).astype(np.int32)
                else:  # of another length than the pivots: one list for each length
                    first = np.full((len(members), 1), -size, np.int32)
                for k, x, y in zip(members, first, _lists(first)):
                    near[at[k]], lists[at[k]] = x, y
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["label"], pa.array(raw, pa.binary()), pa.array(digest, pa.binary()), pa.array(near, pa.list_(pa.int32())), pa.array(lists, pa.list_(pa.int64()))],
                ["id", "label", "raw", "digest", "near", "lists"],
            )

    return rows.mapInArrow(lean(work), "id long, label long, raw binary, digest binary, near array<int>, lists array<long>")


def _first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest list that the vectors of each row of x and y share, from their nearest pivots."""
    both = np.where((x[:, :, None] == y[:, None, :]).any(axis=2), x.astype(np.int64), PIVOTS)
    both.sort(axis=1)
    return both[:, 0] if x.shape[1] < 2 else both[:, 0] * PIVOTS + both[:, 1]


def _all_pairs(own: np.ndarray, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group's members, one of block i and one of block j, about PAIRS at a time."""
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    if not len(left) or not len(right):
        return
    step = max(1, PAIRS // len(right))
    for k in range(0, len(left), step):
        x, y = np.repeat(left[k : k + step], len(right)), np.tile(right, len(left[k : k + step]))
        yield (x[x < y], y[x < y]) if i == j else (x, y)


def _spanning(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one reachable by the links x - y."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _found(classes: DataFrame, least: float, kind: str) -> DataFrame:
    """(id, root, far) by inverted lists and cosines, from classes (id, label, raw, near, lists, copies).

    Of each pair of blocks a row for each class with links in it: far, the rows behind the classes linked with it there, and
    root, the smallest class that these links reach. So a group of near copies gives rows in proportion to its members,
    not to its links.
    """
    n_parts = partitions(classes.sparkSession)
    lists = classes.select("label", F.explode("lists").alias("list"), "id", "raw", "near", "copies")
    sizes = lists.groupBy("label", "list").agg(F.count("*").alias("m")).where("m > 1").select("label", "list", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = lists.join(sizes, ["label", "list"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "raw", "near", "copies")
    place = ("label", "list", "i", "j")

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """All groups of a table that is sorted by group."""
        label, list_, i, j, own, ids, copies = (np.asarray(table[c]) for c in (*place, "own", "id", "copies"))
        raw, near = table["raw"].to_pylist(), table["near"].to_pylist()
        change = np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in (label, list_, i, j)])])
        at = np.flatnonzero(change).tolist() + [len(ids)]
        out: list[list[np.ndarray]] = [[], [], []]
        for p, q in zip(at, at[1:]):
            v = _unit(np.stack([np.frombuffer(x, kind).astype(np.float64) for x in raw[p:q]]))
            pivots = np.array(near[p:q], np.int32)
            linked = []
            for x, y in _all_pairs(own[p:q], int(i[p]), int(j[p])):
                if list_[p] >= 0:
                    first = _first_shared(pivots[x], pivots[y]) == list_[p]
                    x, y = x[first], y[first]
                good = np.einsum("ij,ij->i", v[x], v[y]) >= least
                linked.append((x[good], y[good]))
            if not linked:
                continue
            x, y = (np.concatenate(z) for z in zip(*linked))
            if len(x):
                kinds, flat = np.unique(np.concatenate([x, y]), return_inverse=True)
                far = np.bincount(flat, np.concatenate([copies[p:q][y], copies[p:q][x]]), len(kinds)).astype(np.int64)
                out[0].append(ids[p:q][kinds])
                out[1].append(ids[p:q][kinds][_spanning(len(kinds), flat[: len(x)], flat[len(x) :])])
                out[2].append(far)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["id", "root", "far"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            same = np.logical_and.reduce([np.asarray(batch[c]) == batch[c][-1].as_py() for c in place])
            whole = int(np.flatnonzero(same)[0])
            if whole:  # a group ends in this batch: all before its last group is whole
                yield from compare(pa.Table.from_batches([*held[:-1], batch.slice(0, whole)]))
                held = [batch.slice(whole)]
            elif len(held) > 1 and any(held[0][c][0].as_py() != batch[c][0].as_py() for c in place):
                yield from compare(pa.Table.from_batches(held[:-1]))
                held = [batch]
        if held:
            yield from compare(pa.Table.from_batches(held))

    # a fixed number of partitions: adaptive execution neither splits nor joins them, so a group stands in one
    return dealt.repartition(n_parts, *place).sortWithinPartitions(*place).mapInArrow(lean(work), "id long, root long, far long")


def near_vectors(rows: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    rows: vec_id, embedding, label (further columns are ignored). Rows are compared only where labels are equal and not
    null. Vectors that are null, empty, zero or hold null or non-finite components link with nothing; a row without a
    vec_id is kept, has no links and no component_id. Equal vectors of a label are one class, so thousands of copies cost one entry;
    n_links counts the rows behind it. Repeated rows count each; a vec_id that stands on different vectors is answered for each by its own vector.

    A pair is looked at only in the first list that it shares, so no pair is found twice. Lists are dealt into blocks of
    about BLOCK members, and each pair of blocks is a group, so no group grows with the data. The search may miss a pair that shares
    fewer than two of the NEAREST pivots; it adds no pair below `least`.
    """
    spark = rows.sparkSession
    small_batches(spark)
    kind = "<f4" if dict(rows.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    every = rows.where("embedding is not null and label is not null and vec_id is not null")
    share = max(1, every.count() // PIVOT_SAMPLE)
    chosen = every.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0).orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(2 * PIVOT_SAMPLE)
    _, usable = _matrix(pa.array([r.embedding for r in chosen.collect()], pa.list_(pa.float64())))  # at most 2 * PIVOT_SAMPLE rows
    sizes = [len(v) for v in usable]
    length = max(sorted(set(sizes)), key=sizes.count) if usable else 0
    pivots = spark.sparkContext.broadcast(choose_pivots(_unit(np.stack([v for v in usable if len(v) == length]))) if usable else np.zeros((0, 1)))
    indexed = cut(_indexed(rows, pivots, kind))
    first = [F.first(c).alias(c) for c in ("raw", "near", "lists")]  # equal in all rows of a class
    classes = cut(indexed.where("digest is not null").groupBy("label", "digest").agg(F.min("id").alias("least"), F.count("*").alias("copies"), *first).withColumn("id", F.xxhash64("label", "digest")))
    found = cut(_found(classes, least, kind))
    links = found.groupBy("id").agg(F.sum("far").alias("far"))
    comps = connected_components(found.where("id != root").select(F.col("root").alias("a"), F.col("id").alias("b")).distinct()).withColumnRenamed("node", "id")
    known = cut(classes.select("label", "digest", "id", "least", "copies").join(links, "id", "left").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id")))
    lowest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(lowest, "component").select("label", "digest", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = indexed.select("id", "label", "digest").join(known, ["label", "digest"], "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
