"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and word beginnings, hashed. The machine adds to each term's weight the inner products
of the terms' factor vectors, so that terms which are harmless alone can be toxic together and the other way round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm._text import NO_LETTER, words
from palisade.llm._work import bounded_sample, lean, small_batches

#: Buckets of the terms' hash; lengths in bytes of the word beginnings that are terms as well.
BUCKETS, BEGINNINGS = 1 << 20, (4, 5)
#: Labelled rows that are learned from at most, chosen by the hash of their id.
TRAIN_ROWS = 16_000
#: Texts of the training rows in which a term stands at least to be learned.
MIN_TEXTS = 4
FACTORS, EPOCHS, RATE, DECAY = 6, 14, 0.08, 1e-4
#: Chi-squared with the label from which a term is learned, and from which both terms of a pair are: that of the pair's texts
#: against the rest of either term's. Others would only let single texts be learned by heart (all terms: recall 0.55 instead of 0.91 at sf0.1).
ASSOCIATED, PAIRED = 12.0, 30.0
#: Share of the rows in which a term stands that is looked at in pairs though it tells nothing alone.
FREQUENT = 0.02
#: Terms and rows of a block of pair counts.
BLOCK, ROWS = 256, 1024


def terms(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text, one after the other, and their number per text."""
    h, _, counts = words(arr, NO_LETTER, BEGINNINGS)
    h = (h >> np.uint64(20)) & np.uint64(BUCKETS - 1)
    ends = np.cumsum(counts)
    sets = [np.unique(h[:, e - c : e]) for c, e in zip(counts.tolist(), ends.tolist())]
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)).astype(np.int64), np.array([len(s) for s in sets], np.int64)


@dataclass
class FactorizationMachine:
    """bias, and for each known bucket a weight and a factor vector."""

    bias: float
    known: np.ndarray
    weight: np.ndarray
    factor: np.ndarray

    def lookup(self) -> np.ndarray:
        at = np.full(BUCKETS, -1, np.int32)
        at[self.known] = np.arange(len(self.known))
        return at

    def score(self, idx: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(sizes)), sizes)
        i = at[idx]
        i, row = i[i >= 0], row[i >= 0]
        n = len(sizes)
        z = self.bias + np.bincount(row, self.weight[i], n)
        for f in range(self.factor.shape[1]):
            v = self.factor[i, f].astype(float)
            z += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _chi2(k1: np.ndarray, n1: np.ndarray, k2: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Chi-squared of two shares k/n; 0 where there is nothing to compare."""
    p = (k1 + k2) / np.maximum(n1 + n2, 1)
    gap = k1 / np.maximum(n1, 1) - k2 / np.maximum(n2, 1)
    var = p * (1 - p) * (1 / np.maximum(n1, 1) + 1 / np.maximum(n2, 1))
    return np.where((n1 > 0) & (n2 > 0) & (var > 0), gap * gap / np.where(var > 0, var, 1), 0)


def paired(docs: list[np.ndarray], y: np.ndarray, df: np.ndarray, hit: np.ndarray, tells: np.ndarray) -> np.ndarray:
    """Terms of all pairs whose texts differ in the label from the other texts of either term; a pair and the rest of either term have MIN_TEXTS texts at least.

    Pairs are looked for among the terms that tell the label alone or stand in FREQUENT of the rows, and can reach PAIRED: a fourfold
    table of n texts, k of them toxic, has a chi-squared of at most n * min(1, k / MIN_TEXTS, (n - k) / MIN_TEXTS). All of these pairs are counted, block by block.
    """
    able = np.flatnonzero((df < len(y)) & (tells | (df >= FREQUENT * len(y))) & (df * np.minimum(MIN_TEXTS, np.minimum(hit, df - hit)) >= PAIRED * MIN_TEXTS))
    at = np.full(BUCKETS, -1, np.int32)
    at[able] = np.arange(len(able))
    idx = [i[i >= 0] for i in (at[d] for d in docs)]
    n, k, out = df[able], hit[able], np.zeros(len(able), bool)
    for a in range(0, len(able), BLOCK):
        b = min(a + BLOCK, len(able))
        both, toxic = np.zeros((2, b - a, len(able) - a), np.float32)
        for r in range(0, len(idx), ROWS):
            rows = [i[np.searchsorted(i, a) :] - a for i in idx[r : r + ROWS]]
            x = np.zeros((len(rows), len(able) - a), np.float32)
            x[np.repeat(np.arange(len(rows)), [len(i) for i in rows]), np.concatenate(rows)] = 1
            both += x[:, : b - a].T @ x
            mark = y[r : r + ROWS] == 1
            toxic += x[mark, : b - a].T @ x[mark]
        ni, ki = n[a:b, None].astype(np.float32), k[a:b, None].astype(np.float32)
        gap = ni * toxic - ki * both  # a fourfold table's chi-squared against the rest of the row's term, without divisions
        i, j = np.nonzero((both >= MIN_TEXTS) & (ni - both >= MIN_TEXTS) & (gap * gap * ni >= np.float32(0.99 * PAIRED) * ki * (ni - ki) * both * (ni - both)))
        m, t, i, j = both[i, j].astype(float), toxic[i, j].astype(float), i + a, j + a
        tell = (n[j] - m >= MIN_TEXTS) & (_chi2(t, m, k[i] - t, n[i] - m) >= PAIRED) & (_chi2(t, m, k[j] - t, n[j] - m) >= PAIRED)
        out[i[tell]] = out[j[tell]] = True
    return able[out]


def fit(docs: list[np.ndarray], y: np.ndarray, seed: int = 5) -> FactorizationMachine:
    """AdaGrad on the logistic loss. Without rows of both labels the machine is its smoothed base rate."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    none = FactorizationMachine(float(np.log(rate / (1 - rate))), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    if not 0 < y.sum() < len(y):
        return none
    df = np.bincount(np.concatenate(docs), minlength=BUCKETS)
    hit = np.bincount(np.concatenate([d for d, t in zip(docs, y) if t]), minlength=BUCKETS)
    rest, p = df - hit, df / len(y)
    gap = hit / y.sum() - rest / (len(y) - y.sum())
    tells = gap * gap >= ASSOCIATED * p * (1 - p) * (1 / y.sum() + 1 / (len(y) - y.sum()))
    tells[paired(docs, y, df, hit, tells)] = True
    known = np.flatnonzero((df >= MIN_TEXTS) & tells & (p < 1))
    if not len(known):
        return none
    at = np.full(BUCKETS, -1, np.int32)
    at[known] = np.arange(len(known))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    groups = []
    for k in range(0, len(y), 128):
        rows = order[k : k + 128]
        idx = [i[i >= 0] for i in (at[docs[r]] for r in rows)]
        row = np.repeat(np.arange(len(rows)), [len(i) for i in idx])
        own, inverse = np.unique(np.concatenate(idx), return_inverse=True)
        groups.append((own, inverse, row, y[rows].astype(float)))
    w, v = np.zeros(len(known)), rng.normal(0, 0.01, (len(known), FACTORS))
    gw, gv, b, gb = np.full(len(known), 1e-6), np.full((len(known), FACTORS), 1e-6), none.bias, 1e-6
    for _ in range(EPOCHS):
        for g in rng.permutation(len(groups)):
            own, inv, row, target = groups[g]
            n = len(target)
            wo, vo = w[own], v[own]
            sums = np.stack([np.bincount(row, vo[inv, f], n) for f in range(FACTORS)], 1)
            squares = np.bincount(row, (vo[inv] ** 2).sum(axis=1), n)
            z = b + np.bincount(row, wo[inv], n) + 0.5 * ((sums**2).sum(axis=1) - squares)
            d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / 8
            dw = np.bincount(inv, d[row], len(own)) + DECAY * wo
            dv = np.stack([np.bincount(inv, d[row] * (sums[row, f] - vo[inv, f]), len(own)) for f in range(FACTORS)], 1) + DECAY * vo
            gw[own] += dw * dw
            gv[own] += dv * dv
            w[own] -= RATE * dw / np.sqrt(gw[own])
            v[own] -= RATE * 0.5 * dv / np.sqrt(gv[own])
            gb += d.sum() ** 2
            b -= RATE * d.sum() / np.sqrt(gb)
    return FactorizationMachine(float(b), known, w, v)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FactorizationMachine:
    """A machine from at most `rows` rows of docs (doc_id, text) that labels (doc_id, toxic 0/1) marks."""
    marked = bounded_sample(labels.where("toxic in (0, 1)").select("doc_id", "toxic"), "doc_id", rows)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # one row for each key of the sample
    both = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, sizes = terms(batch["text"])
            parts = np.split(idx.astype(np.int32), np.cumsum(sizes)[:-1]) if len(sizes) else []
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in parts], pa.binary()), batch["toxic"]], ["idx", "toxic"])

    got = both.mapInArrow(work, "idx binary, toxic int").collect()  # at most `rows` rows
    got.sort(key=lambda r: (r.toxic, r.idx))
    return fit([np.frombuffer(r.idx, np.int32) for r in got], np.array([r.toxic for r in got]))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is 2 modulo 4; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, threshold: float = 0.3) -> DataFrame:
    """docs' doc_id with score (0 to 1) and predicted (1 from the threshold on) for every row; no shuffle.

    docs: doc_id, text (further columns are ignored). A null, empty or wordless text scores as the bias alone does.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        at = m.lookup()
        for batch in batches:
            score = m.score(*terms(batch["text"]), at)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(lean(work), "doc_id long, score double, predicted int")
