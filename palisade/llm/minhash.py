"""MinHash near-duplicates: universal hash minima, banding, signature and full-set verification, star components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palisade.llm._text import U64, mix, shingle_sets
from palisade.llm._work import cut, hot_join, lean, partitions, small_batches
from palisade.llm.components import connected_components

#: Bands of minima; at a similarity of 0.8 a pair shares no band with probability (1 - 0.8**5)**32 < 4e-6.
BANDS, ROWS = 32, 5
#: Minima of a signature, of which the bands use the first; pairs whose signatures agree in a smaller share than the threshold
#: less MARGIN are no candidates (4.9 standard deviations at a similarity of 0.8).
MINIMA = 320
MARGIN = 0.11
#: Members of a bucket that are compared at once; documents of a group of those whose pairs are verified together.
BLOCK, GROUP = 512, 1024


@lru_cache(maxsize=4)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(11)
    return (r.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1))[:, None], r.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]


def signature(s: np.ndarray, n: int = MINIMA) -> np.ndarray:
    """Minima of n universal hash functions x -> a x + b mod 2**32 over a set of 64-bit hashes."""
    a, b = _functions(n)
    x = (s >> U64(32)).astype(np.uint32)
    low = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(low, (a * x[None, i : i + 1024] + b).min(axis=1), out=low)
    return low


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(documents, BANDS) int64 keys; the band is part of its key."""
    s = sig[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    k = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2]).copy()
    for j in range(ROWS):
        k = mix(k * U64(0x9E3779B97F4A7C15) + s[:, :, j])
    return k.view(np.int64)


def _signed(docs: DataFrame, k: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch["text"], k)
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sig = np.stack([signature(s) for s in sets]) if sets else np.zeros((0, MINIMA), np.uint32)
            keys = band_keys(sig)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["mark"],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.array([x.tobytes() for x in (sig & 255).astype(np.uint8)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel())),
                ],
                ["doc_id", "mark", "n_shingles", "print", "sig", "keys"],
            )

    return docs.mapInArrow(lean(work), "doc_id long, mark long, n_shingles long, print binary, sig binary, keys array<long>")


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


_PAIRS = "pg long, a array<long>, b array<long>"


def _packed(a: np.ndarray, b: np.ndarray, groups: int) -> pa.RecordBatch:
    """Pairs by pair group: documents fall into `groups` groups by a hash of their id, pairs into those of both."""
    ga, gb = (mix(x.astype(np.uint64)) % U64(groups) for x in (a, b))
    pg = (np.minimum(ga, gb) * U64(groups) + np.maximum(ga, gb)).astype(np.int64)
    order = np.argsort(pg, kind="stable")
    kinds, at = np.unique(pg[order], return_index=True)
    bounds = pa.array(np.append(at, len(pg)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.ListArray.from_arrays(bounds, pa.array(x[order], pa.int64())) for x in (a, b))], ["pg", "a", "b"])


def _screen(pairs: DataFrame, sigs: DataFrame, percent: int, groups: int) -> DataFrame:
    """Packed pairs of (a, b) whose signatures agree well enough; sigs: (id, sig)."""
    least = percent / 100 - MARGIN
    both = pairs.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch["sig_a"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                y = np.frombuffer(b"".join(batch["sig_b"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                ok = _alike(x, y) >= least
                yield _packed(np.asarray(batch["a"])[ok], np.asarray(batch["b"])[ok], groups)

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(lean(work), _PAIRS)


def _confirm(packed: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that are linked by their full sets; texts: (id, text).

    A pair group's documents are fetched once, however many of its pairs they are in.
    """
    packed = cut(packed.groupBy("pg").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b")))
    members = packed.select(F.col("pg").alias("group"), F.explode(F.array_distinct(F.concat("a", "b"))).alias("id")).join(texts, "id")

    def work(pairs: pa.Table, docs: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for i, s in zip(docs["id"].to_pylist(), shingle_sets(docs["text"], k)):
            sets.setdefault(i, []).append(s)
        linked = set()
        for a, b in {*zip(*(np.concatenate([np.asarray(x, np.int64) for x in pairs[c].to_pylist()] or [np.zeros(0, np.int64)]).tolist() for c in ("a", "b")))}:
            for x in sets.get(a, ()):
                for y in sets.get(b, ()):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * common >= percent * (len(x) + len(y) - common) > 0:
                        linked.add((a, b))
        return pa.table({"a": pa.array([p[0] for p in linked], pa.int64()), "b": pa.array([p[1] for p in linked], pa.int64())})

    return packed.groupBy("pg").cogroup(members.groupBy("group")).applyInArrow(work, "a long, b long").distinct()


def _bucket_pairs(own: np.ndarray, i: int, j: int, ids, n, comp, sig, keys, key: int, percent: int, best_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs between the members of blocks i and j of a bucket; see _across."""
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    ok = comp[left][:, None] != comp[right][None]
    low, high = np.minimum(n[left][:, None], n[right][None]), np.maximum(n[left][:, None], n[right][None])
    ok &= 100 * low >= percent * high
    if i == j:
        ok &= ids[left][:, None] < ids[right][None]
    for band in range(int(np.flatnonzero(keys[left[0]] == key)[0]) if len(left) else 0):
        ok &= keys[left, band][:, None] != keys[right, band][None]
    x, y = np.nonzero(ok)
    x, y = left[x], right[y]
    like = np.concatenate([np.zeros(0), *(_alike(sig[x[k : k + 8192]], sig[y[k : k + 8192]]) for k in range(0, len(x), 8192))])
    good = like >= percent / 100 - MARGIN
    x, y, like = x[good], y[good], like[good]
    if best_only and len(x) > 1:
        order = np.lexsort((-like, comp[y], x))
        x, y = x[order], y[order]
        first = np.ones(len(x), bool)
        first[1:] = (x[1:] != x[:-1]) | (comp[y][1:] != comp[y][:-1])
        x, y = x[first], y[first]
    return ids[x], ids[y]


def _across(placed: DataFrame, few: DataFrame, percent: int, best_only: bool, groups: int) -> DataFrame:
    """Packed candidate pairs of different components within buckets.

    placed: key, id, comp; few: id, n, sig, keys. Only buckets that more than one component shares are looked at. The members of
    a bucket's largest component and all others are dealt into blocks of about BLOCK members each, and each pair of blocks is a
    group of its own, but for those of two blocks of the largest component. So a group's size is bounded however large the bucket,
    and a member of the largest component is sent once for each block of others, not for each block of the bucket. A pair
    is looked at in the first band that it shares only. best_only: from each member only its likeliest partner in each other component.
    """
    n_parts = partitions(placed.sparkSession)
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("m"), F.count("*").alias("c"))
    sizes = sizes.where("c > 1").select("key", F.col("top.comp").alias("main"), F.ceil(F.col("top.m") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("m") - F.col("top.m")) / BLOCK).cast("int").alias("others"))
    rows = placed.join(sizes, "key").join(few, "id")
    top, deal = F.col("comp") == F.col("main"), F.xxhash64("id")
    dealt = rows.withColumn("own", F.when(top, F.col("others") + F.pmod(deal, "mains")).otherwise(F.pmod(deal, "others")).cast("int"))
    dealt = dealt.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("others") - 1 + F.when(top, 0).otherwise(F.col("mains")))))
    dealt = dealt.select("key", F.least("own", "partner").alias("i"), F.greatest("own", "partner").alias("j"), "own", "id", "n", "comp", "sig", "keys")

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """All groups of a table that is sorted by group."""
        key, i, j, own, ids, n, comp = (np.asarray(table[c]) for c in ("key", "i", "j", "own", "id", "n", "comp"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(ids), -1)
        keys = np.asarray(table["keys"].combine_chunks().flatten()).reshape(len(ids), -1)
        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])).tolist() + [len(ids)]
        found = [_bucket_pairs(own[p:q], int(i[p]), int(j[p]), ids[p:q], n[p:q], comp[p:q], sig[p:q], keys[p:q], key[p], percent, best_only) for p, q in zip(at, at[1:])]
        x, y = (np.concatenate(z) for z in zip(*found))
        yield _packed(np.minimum(x, y), np.maximum(x, y), groups)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([*(held.to_batches() if held else ()), batch])
            last = held.slice(held.num_rows - 1)
            same = np.logical_and.reduce([np.asarray(held[c]) == last[c][0].as_py() for c in ("key", "i", "j")])
            whole = int(np.flatnonzero(same)[0])
            if whole:
                yield from compare(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield from compare(held)

    # a fixed number of partitions: adaptive execution neither splits nor joins them, so a group stands in one
    dealt = dealt.repartition(n_parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(lean(work), _PAIRS)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs, and mark, the xxhash64 of its text (null without one).

    docs: doc_id, text (further columns are ignored). Two documents are linked if 100 * |A and B| >= percent * |A or B|
    for their sets of k-word shingles. component_id is the smallest doc_id reachable over links, kept tells whether it is
    the row's own. Texts without words are linked with nothing, not even each other; a row without a doc_id is linked
    with nothing and has no component_id and is kept. Repeated rows are answered each; a doc_id that stands on different
    texts is one document with several versions, linked to whatever one of them is linked to.

    Equal sets are one class, known by a 128-bit digest, so exact copies cost one row each. The classes' bands meet in
    buckets; each member is first compared with its bucket's smallest and largest id only, and linked pairs make components. Only
    buckets that then still hold more than one component are looked into further, pairs of different components alone:
    first the likeliest partners, then, among what is still apart, all. Each candidate pair is verified by signatures, then by
    full sets. So a group of m alike copies takes about m comparisons, and no link between components is lost to a cap.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("mark", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    signed = cut(_signed(docs, k))
    reps = signed.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    sigs = cut(
        signed.join(reps.select("print", F.col("id").alias("doc_id")), ["print", "doc_id"]).dropDuplicates(["print"]).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sig", "keys", "print")
    )
    bands = sigs.select("id", F.explode("keys").alias("key"))
    hubs = bands.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high")
    shared = cut(bands.join(hubs, "key"))
    stars = shared.select(F.col("low").alias("a"), F.col("id").alias("b")).union(shared.select(F.col("id").alias("a"), F.col("high").alias("b"))).where("a != b").distinct()
    active = shared.select("id").distinct()
    few = cut(sigs.join(active, "id").select("id", "n", "sig", "keys"))
    groups = max(1, few.count() // GROUP)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    texts = cut(texts.join(few.select("id"), "id").dropDuplicates(["id", "text"]))
    links = cut(_confirm(_screen(stars, few.select("id", "sig"), percent, groups), texts, k, percent))
    comps = cut(connected_components(links))
    for best_only in (True, False):
        placed = shared.select("key", "id").join(comps.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
        found = cut(_confirm(_across(cut(placed), few, percent, best_only, groups), texts, k, percent))
        if found.isEmpty():
            continue
        comps = cut(connected_components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found)))
    classes = reps.join(comps.withColumnRenamed("node", "id"), "id", "left").select("print", "n", F.coalesce("component", "id").alias("component_id"))
    out = hot_join(signed.select("doc_id", "mark", "n_shingles", "print"), classes, "print", "doc_id", signed.count()).select("doc_id", "mark", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
