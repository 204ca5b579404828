"""Hierarchical Pitman-Yor language model, learned and applied over whole corpora.

Restaurants. A token's context is the two words before it, named by their 64-bit hash; its restaurant's parent is that of the
last word alone, whose parent is the root, whose base gives each of the V known words and the class of all unknown ones
1 / (V + 1). Restaurants grow with the corpus as dishes (words) do, so everything but sums over hot restaurants is distributed.

Seating. It starts with one table per dish. In each turn the number of tables of every dish is drawn by Gibbs from its conditional given the
seating that the turn before left, over all t = 1 .. c, with generalised Stirling numbers (by a contour integral beyond EXACT customers).
Tables are customers of the parent. All totals are refreshed after every turn. Dishes of a turn are drawn side by side, and the customers
that tables bring to the parent's restaurant arrive there a turn later, as they may come from other partitions. Within each level customers,
tables and totals are of one moment, so that each draw's predictive distribution sums to one; predictive probabilities are averaged over
draws. Random numbers are hashes of the dish and the turn: the scores do not depend on partitions.

Data flow. Tokens go through one Spark shuffle, packed in arrays, a row for each flush and partition. Its files are the only place where they lie: the first and the last pass read them there.
Tokens belong to the partition of the word before them; if that is hot, to that of both words before, and if these are hot together, by their document. So a restaurant is whole in one partition unless it is hot. What several
partitions hold of a dish (of all words at the root, of hot restaurants) goes to the owner of its hash, who sums the shares and answers each; the
answers are files in the shared folder, a blob a reader. All holders of a dish draw the same number of tables, and the first of
them counts it. Turns read dishes of two customers or more alone, the others have one table whatever is drawn.
Only sums over all restaurants and those of hot restaurants (at most 16 times the partitions) go to the driver.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from numpy.polynomial.chebyshev import chebvander
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from palisade.llm._text import U64, mix, words
from palisade.llm._work import collect_garbage, lean, new_folder, partitions, small_batches

#: Tokens that a task packs at once; bytes of them that it hands to the shuffle at once.
FLUSH, SENT = 5_000_000, 1 << 22
#: Words and contexts with more than this part of a partition's fair share of the tokens are hot; a routing choice without effect on results.
HOT_PART = 1 / 8
#: What the owners' answers call dishes that one partition holds alone, that it counts, and that another counts.
ALONE, FIRST, OTHER = 0, 1, 2
#: Partitions that share an owner of dishes; owners read a blob of each partition, so their number bounds that of small reads.
PARTS_OWNED = 4
#: Most customers whose Stirling numbers are by recursion; most whose first ones are from one table; steps of a contour.
EXACT, FAR, NODES = 1024, 1 << 40, 24
#: Dishes of up to so many customers are drawn over all t at once; numbers held in one look at these and at others.
SMALL, SMALL_CHUNK, CHUNK = 24, 1 << 17, 1 << 20
BURN_IN, DRAWS = 2, 3
#: Strengths that are tried; each level takes the likeliest for what its restaurants hold.
STRENGTHS = tuple(float(x) for x in np.geomspace(0.1, 3000, 16))
SALT, END, BEGIN = U64(0x632BE59BD9B4E019), U64(0x1F3D5B79A2C4E688), U64(0x2B7E151628AED2A6)


def in_training(doc_id: Column) -> Column:
    """crc32 of the id as text is not 2 modulo 7; a null id is in training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(True))


def sequence(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts, each text's followed by one end; the places of the ends."""
    h, _, counts = words(arr)
    ends = np.cumsum(counts + 1) - 1
    w = np.full(len(h) + len(counts), END)
    w[np.delete(np.arange(len(w)), ends)] = h
    return w, ends


def before(w: np.ndarray, ends: np.ndarray, begin) -> tuple[np.ndarray, np.ndarray]:
    """The word before each of w, and that before it, within texts that end at ends; begin before their first ones."""
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    first, second = np.full(len(w), begin, w.dtype), np.full(len(w), begin, w.dtype)
    first[1:] = w[:-1]
    first[starts] = begin
    second[1:] = first[:-1]
    second[starts] = begin
    return first, second


def context(second: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hash of a context of two words."""
    return mix(mix(second) * U64(0x9E3779B97F4A7C15) + before)


@lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """The worker's own, kept for its many small blobs."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _plane(x: np.ndarray) -> bytes:
    """First bytes of all numbers, then second ones, and so on."""
    x = np.ascontiguousarray(x).view(f"<u{x.itemsize}")
    used = int(x.max(initial=0)).bit_length()
    return b"".join((x >> x.dtype.type(8 * k)).astype(np.uint8).tobytes() if 8 * k < used else bytes(len(x)) for k in range(x.itemsize))


def _unplane(raw: bytes, kind: str) -> np.ndarray:
    unsigned = np.dtype(f"<u{np.dtype(kind).itemsize}")
    n = len(raw) // unsigned.itemsize
    out = np.zeros(n, unsigned)
    for k in range(unsigned.itemsize):
        plane = np.frombuffer(raw, np.uint8, n, k * n)
        if plane.any():
            out |= plane.astype(unsigned) << unsigned.type(8 * k)
    return out.view(kind)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers, ascending."""
    x = np.sort(x)
    return x[np.flatnonzero(np.diff(x, prepend=x[:1] ^ x.dtype.type(1)))]


def _hot(docs: DataFrame, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of hot words and of hot contexts of two words, at most n_parts / HOT_PART of each, from a sixteenth of the documents."""
    share = HOT_PART / n_parts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = (defaultdict(int), defaultdict(int)), 0
        for batch in batches:
            last, second = before(*sequence(batch["text"]), BEGIN)
            n += len(last)
            for kind, keys in enumerate((last, context(second, last))):
                kinds, c = np.unique(keys, return_counts=True)
                often = c * 4 >= share * max(len(last), 20000)
                for k, v in zip(kinds[often].view(np.int64).tolist(), c[often].tolist()):
                    total[kind][k] += v
        rows = [(kind, k, v) for kind in (0, 1) for k, v in total[kind].items() if 2 * v >= share * n] + [(2, 0, n)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["kind", "w", "n"])

    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0).mapInArrow(lean(count), "kind int, w long, n long")
    sums = part.groupBy("kind", "w").agg(F.sum("n").alias("n"))
    most = F.max(F.when(F.col("kind") == 2, F.col("n"))).over(Window.partitionBy())
    rows = sums.withColumn("all", most).where((F.col("kind") < 2) & (F.col("n") >= share * F.col("all"))).collect()
    return tuple(np.unique(np.array([r.w for r in rows if r.kind == kind], np.int64).view(np.uint64)) for kind in (0, 1))


def _place(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Places of keys among the hot ones, -1 for others."""
    if not len(hot):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
    return np.where(hot[at] == keys, at, -1)


def _write(folder: str, name: str, blobs: list[bytes]) -> None:
    """A file of blobs in the shared folder, whole or not there whatever becomes of the task."""
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    own = f"{root}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as f:
        f.write(np.cumsum([8 * (len(blobs) + 1), *map(len, blobs)]).astype("<u8").tobytes())
        f.write(b"".join(blobs))
    fs.move(own, f"{root}/{name}")


def _blob(folder: str, name: object, k: int = 0) -> bytes:
    """The k-th blob of a file."""
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        start, stop = np.frombuffer(f.read_at(16, 8 * k), "<u8").tolist()
        return f.read_at(stop - start, start) if stop > start else b""


def _drop(*folders: str) -> None:
    for folder in folders:
        fs, root = pafs.FileSystem.from_uri(folder)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            fs.delete_dir(root)


def _deal(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], n_parts: int, tables: str) -> RDD:
    """Shuffled rows (part, name, blob): partition p has p's packed tokens, a row a flush even if it has none, and one without a name.

    Write each flush's table (ids, which are null, training marks). A flush's name tells its contents, so that a task that runs again
    gives the same names or, where documents came in another order, is found out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        squeeze = zstandard.ZstdCompressor(level=1)
        task, turn = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn, held, size
            w = np.concatenate([x[0] for x in held])
            ends = np.concatenate([x[1] for x in held]) + np.repeat(np.cumsum([0, *(len(x[0]) for x in held[:-1])]), [len(x[1]) for x in held])
            ids, train = [i for x in held for i in x[2]], np.concatenate([x[3] for x in held])
            number, held, size = (task << 20) | turn, [], 0
            row = np.repeat(np.arange(len(ends), dtype=np.uint32), np.diff(ends, prepend=-1))
            # ids of words in the order of their hashes
            coded = pa.array(w).dictionary_encode()
            kinds, inner = np.asarray(coded.dictionary), np.asarray(coded.indices)
            every = np.append(kinds, BEGIN)
            order = np.argsort(every)
            every, rank = every[order], np.empty(len(every), np.uint32)
            rank[order] = np.arange(len(every))
            w, begin = rank[inner], rank[-1]
            del coded, inner
            last, second = before(w, ends, begin)
            part = (mix(every + SALT) % U64(n_parts)).astype(np.uint16 if n_parts <= 1 << 16 else np.uint32)[last]
            at = np.flatnonzero((_place(every, hot[0]) >= 0)[last])
            ctx = context(every[second[at]], every[last[at]])
            spread = mix(row[at].astype(np.uint64) + U64(number << 32))
            part[at] = mix(np.where(_place(ctx, hot[1]) >= 0, ctx + spread, ctx) + SALT) % U64(n_parts)
            order = np.argsort(part, kind="stable")
            bounds = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=n_parts))])
            mark, place, out = np.zeros(len(every), bool), np.zeros(len(every), np.uint32), []
            for p in range(n_parts):
                take = order[bounds[p] : bounds[p + 1]]
                if not len(take):
                    out.append(b"")
                    continue
                mine = np.concatenate([w[take], last[take], second[take]])
                if len(mine) * 32 < len(every):
                    used = _distinct(mine)
                else:
                    mark[mine] = True
                    used = np.flatnonzero(mark)
                    mark[used] = False
                # often used words first, equally often used ones in the order of their hashes
                place[used] = np.arange(len(used))
                often = np.bincount(place[mine], minlength=len(used))
                used = used[np.argsort(64 - np.frexp(often)[1].astype(np.uint8), kind="stable")]
                place[used] = np.arange(len(used))
                rows = row[take]
                fields = [_plane(np.diff(every[used], prepend=U64(0))), *(_plane(x) for x in place[mine].reshape(3, -1)), _plane(np.diff(rows, prepend=np.uint32(0))), train[rows].tobytes()]
                out.append(squeeze.compress(b"".join(len(f).to_bytes(4, "little") + f for f in fields)))
            table = np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], np.uint8).tobytes() + train.tobytes()
            told = hashlib.blake2b(table, digest_size=12)
            for blob in out:
                told.update(len(blob).to_bytes(8, "little") + blob)
            name = f"{task:06d}-{turn:06d}-{told.hexdigest()}"
            turn += 1
            _write(tables, name, [squeeze.compress(table)])
            turns = np.cumsum([len(blob) for blob in out]) // SENT
            for parts in np.split(np.arange(n_parts), np.flatnonzero(np.diff(turns)) + 1):
                yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "name": [name] * len(parts), "blob": pa.array([out[p] for p in parts], pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((*sequence(batch["text"]), batch["doc_id"].to_pylist(), np.array(batch["train"].to_pylist(), np.uint8)))
            size += len(held[-1][0])
            if size >= FLUSH:
                yield from flush()
        if held:
            yield from flush()

    every = docs.sparkSession.range(0, n_parts, 1, 1).select(F.col("id").cast("int").alias("part"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("binary").alias("blob"))
    return docs.mapInArrow(lean(pack), "part int, name string, blob binary").union(every).repartitionById(n_parts, "part").rdd


def likeliest_strength(customers: np.ndarray, tables: np.ndarray, discount: float, often: np.ndarray | None = None) -> float:
    """Of STRENGTHS that with the largest likelihood of restaurants' numbers of tables, given those of customers; each pair counts `often` times."""
    at = np.flatnonzero(customers > 0)
    often = np.ones(len(customers)) if often is None else often
    pairs = [(int(c), int(t), n) for c, t, n in zip(customers[at], tables[at], often[at])]
    g = math.lgamma

    def fit(s: float) -> float:
        return sum(n * (g(s / discount + t) - g(s / discount) - g(s + c) + g(s)) for c, t, n in pairs)

    return max(STRENGTHS, key=fit) if pairs else 1.0


def log_stirling(discount: float, n: int) -> np.ndarray:
    """Logs of the generalised Stirling numbers S(c, t) of a discount, for c and t up to n."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0
    with np.errstate(divide="ignore"):
        for c in range(n):
            t = np.arange(c + 1)
            s[c + 1, : c + 1] = np.where((t > 0) & (c - discount * t > 0), s[c, : c + 1] + np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
            s[c + 1, 1 : c + 2] = np.logaddexp(s[c + 1, 1 : c + 2], s[c, : c + 1])
    return s


@lru_cache(maxsize=3)
def _stirling(discount: float) -> np.ndarray:
    return log_stirling(discount, EXACT)


def log_runs(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Logs of S(c, t) * discount**t * t! / c! for any 1 <= t < c.

    That is the c-th coefficient of (1 - (1 - x)**discount)**t, here the contour integral over x = exp(-z) on a parabola through the
    saddle point around the branch cut. Against the recursion it is right to 1e-8 up to a discount of 0.7 and to 0.002 up to 0.95 (0.004 where t > c - 4).
    """
    c, t = np.broadcast_arrays(np.asarray(c, float), np.asarray(t, float))
    log_y = lambda z: np.log(-np.expm1(-z))

    def slope(z):
        return discount * np.exp((discount - 1) * log_y(z) - z) / -np.expm1(discount * log_y(z))

    low, high = np.full(c.shape, -60.0), np.full(c.shape, 3.4)
    for _ in range(30):
        mid = (low + high) / 2
        right = t * slope(np.exp(mid)) > c
        low, high = np.where(right, mid, low), np.where(right, high, mid)
    z = np.exp(high)
    flat = z * c < 6
    z = np.where(flat, 6 / c, z)
    curve = t * slope(z) * ((1 - discount) / np.expm1(z) + 1 - slope(z))
    end = np.minimum(np.sqrt(40 / np.where(flat, c * z, np.minimum(2 * curve * z * z, c * z))), np.pi / (2 * z))
    base, total = c * z + t * np.log(-np.expm1(discount * log_y(z))), np.zeros(c.shape)
    for k in range(NODES + 1):
        u = 1 + 1j * (k / NODES) * end
        total += (np.exp(c * z * u * u + t * np.log(-np.expm1(discount * log_y(z * u * u))) - base) * u).real * (1 if k else 0.5)
    return base + np.log(total * end * 2 * z / (np.pi * NODES))


def _chebyshev(x: np.ndarray, low, high, n: int) -> np.ndarray:
    return chebvander(2 * (x - low) / (high - low) - 1, n - 1)


def _nodes(low: float, high: float, n: int) -> np.ndarray:
    return (low + high) / 2 + (high - low) / 2 * np.cos(np.pi * (np.arange(n) + 0.5) / n)


def _smooth(x: np.ndarray, low: float, high: float, f) -> np.ndarray:
    """f at x, from few of its values between low and high."""
    at = _nodes(low, high, 32)
    return _chebyshev(x, low, high, 32) @ np.linalg.solve(_chebyshev(at, low, high, 32), f(at))


@lru_cache(maxsize=16)
def _surface(discount: float, width: int) -> np.ndarray:
    """log_runs for t = 1 .. width < EXACT, by Chebyshev coefficients of the log of c, from EXACT to FAR."""
    at_c, at_t = _nodes(math.log(EXACT), math.log(FAR), 64), _nodes(0, math.log(width), 32)
    values = log_runs(np.exp(at_c)[:, None], np.exp(at_t), discount)
    over_c = np.linalg.solve(_chebyshev(at_c, math.log(EXACT), math.log(FAR), 64), values)
    over_t = np.linalg.solve(_chebyshev(at_t, 0, math.log(width), 32), over_c.T)
    return over_t.T @ _chebyshev(np.log(np.arange(1, width + 1)), 0, math.log(width), 32).T


def stirling_rows(c: np.ndarray, discount: float, width: int) -> np.ndarray:
    """Logs of S(c, t), t = 1 .. width, up to a constant for each c; -inf for t > c. By log_runs beyond EXACT customers."""
    exact, t = _stirling(discount), np.arange(1, width + 1)
    out = np.full((len(c), width), -np.inf)
    shown = min(width, EXACT)
    out[:, :shown] = exact[np.minimum(c, EXACT), 1 : shown + 1]
    far = np.flatnonzero(c > EXACT)
    if len(far):
        rest = -np.cumsum(np.log(t)) - t * math.log(discount)
        if width < EXACT and c.max() <= FAR:
            out[far] = _chebyshev(np.log(c[far]), math.log(EXACT), math.log(FAR), 64) @ _surface(discount, width) + rest
        else:
            kinds, slot = np.unique(c[far], return_inverse=True)
            for k, x in enumerate(kinds.tolist()):
                half, top, row = min(width, x // 2), min(width, x), np.full(width, -np.inf)
                row[:half] = _smooth(np.log(t[:half]), 0, math.log(half), lambda u: log_runs(x, np.exp(u), discount))
                row[half : min(top, x - 1)] = _smooth(np.log(x - t[half : min(top, x - 1)]), 0, math.log(x - half), lambda u: log_runs(x, x - np.exp(u), discount))
                if top == x:
                    row[x - 1] = x * math.log(discount)
                out[far[slot == k]] = row + rest
    return out


def _uniform(keys: np.ndarray, turn: int, step: int = 0) -> np.ndarray:
    """Numbers in (0, 1) that depend on the keys, the turn and the step alone, not on what else a partition holds."""
    salt = (turn * 0x2545F4914F6CDD1D + step * 0x632BE59BD9B4E019 + 1) & 0xFFFFFFFFFFFFFFFF
    return ((mix(mix(keys + U64(salt)) + U64(salt)) >> U64(11)).astype(float) + 0.5) / (1 << 53)


def draw_tables(c: np.ndarray, total: np.ndarray, parent: np.ndarray, discount: float, strength: float, keys: np.ndarray, turn: int) -> np.ndarray:
    """Numbers of tables drawn anew for dishes with c customers, given parent probabilities and their restaurants' tables (total, with one of this dish).

    By the conditional S(c, t) * parent**t * product of strength + discount * (others + k), k < t, over t = 1 .. c. Where
    probability is left at the end of the first t, more of them are looked at, all c if need be.
    """
    new = np.minimum(c, 1).astype(np.int64)
    others, u = np.maximum(total - new, 0.0), _uniform(keys, turn)
    group = np.minimum(c, SMALL + 1)
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(2, SMALL + 3))
    for i, size in enumerate(range(2, SMALL + 1)):
        ratio, todo = np.exp(np.diff(_stirling(discount)[size, 1 : size + 1])), order[bounds[i] : bounds[i + 1]]
        step = SMALL_CHUNK // size
        for at in np.split(todo, range(step, len(todo), step)) if len(todo) else ():
            base, each = strength + discount * others[at], parent[at]
            # weights against that of one table, a line for each t, and their sums so far
            weight, p = np.ones(len(at)), np.ones((size, len(at)))
            for t in range(1, size):
                weight = weight * (ratio[t - 1] * each * (base + discount * t))
                np.add(p[t - 1], weight, out=p[t])
            new[at] = 1 + (p < u[at] * p[-1]).sum(axis=0)
    todo, width = order[bounds[-2] : bounds[-1]], 2 * SMALL
    while len(todo):
        more = []
        step = max(CHUNK // width, 1)
        for at in np.split(todo, range(step, len(todo), step)):
            t = np.arange(width)
            weight = stirling_rows(c[at], discount, width) + np.cumsum(np.log(strength + discount * (others[at, None] + t)), axis=1) + (t + 1) * np.log(parent[at])[:, None]
            weight -= weight.max(axis=1, keepdims=True)
            p = np.exp(weight).cumsum(axis=1)
            new[at] = 1 + (p < u[at, None] * p[:, -1:]).sum(axis=1)
            more.append(at[(c[at] > width) & (weight[:, -1] > -35)])
        todo = np.concatenate(more)
        width = min(4 * width, int(c[todo].max(initial=0)))
    return new


def _freeze(arrays: list[np.ndarray]) -> bytes:
    out = []
    for a in arrays:
        raw = _plane(a)
        out.append(np.dtype(a.dtype).str.encode().ljust(4) + len(raw).to_bytes(8, "little") + raw)
    return _zstd()[0].compress(b"".join(out))


def _thaw(blob: bytes) -> list[np.ndarray]:
    raw, at, out = _zstd()[1].decompress(blob), 0, []
    while at < len(raw):
        size = int.from_bytes(raw[at + 4 : at + 12], "little")
        out.append(_unplane(raw[at + 12 : at + 12 + size], raw[at : at + 4].decode().strip()))
        at += 12 + size
    return out


def _key1(rest: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(rest) * U64(0xD6E8FEB86659FD93) + word)


def _key2(rest: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(rest * U64(0xA0761D6478BD642F) + word)


@dataclass
class Totals:
    """Customers and tables of the root, of hot words' restaurants and of hot contexts', at one moment."""

    c0: float
    t0: float
    c1: np.ndarray
    t1: np.ndarray
    c2: np.ndarray
    t2: np.ndarray


@dataclass
class Corpus:
    n: float
    v: float
    discounts: tuple[float, float, float]  # of contexts of two words, of one, of the root
    strengths: tuple[float, float, float]

    def root(self, totals: Totals, c0: np.ndarray, t0: np.ndarray) -> np.ndarray:
        d, s = self.discounts[2], self.strengths[2]
        return (c0 - d * t0 + (s + d * totals.t0) / (self.v + 1)) / (s + totals.c0)

    def one(self, c1, t1, all_c, all_t, p0) -> np.ndarray:
        d, s = self.discounts[1], self.strengths[1]
        return (c1 - d * t1 + (s + d * all_t) * p0) / (s + all_c)

    def two(self, c2, t2, all_c, all_t, p1) -> np.ndarray:
        d, s = self.discounts[0], self.strengths[0]
        return (c2 - d * t2 + (s + d * all_t) * p1) / (s + all_c)


def _sum_hot(own: np.ndarray, place: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """own, but for hot restaurants (place >= 0) what hot holds."""
    return np.where(place >= 0, hot[place], own) if len(hot) else own


def _dense(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of numbers under size, ascending, and the places of all among them."""
    kinds = np.flatnonzero(np.bincount(x, minlength=size))
    place = np.zeros(size, np.uint32)
    place[kinds] = np.arange(len(kinds))
    return kinds, place[x]


class _Part:
    """The tokens of one partition and the dishes they are, in the order of (word before, word, word before that)."""

    def __init__(self, blobs: list[bytes], hot: tuple[np.ndarray, np.ndarray], places: bool = False):
        """blobs: one a flush. places: which dish each token is (token), its row in the flush (row) and each flush's tokens (flushes) are kept."""
        open_ = zstandard.ZstdDecompressor()
        read, self.flushes, n = [], [], 0
        for blob in blobs:
            raw, fields, at = open_.decompress(blob) if blob else b"", [], 0
            for _ in range(6 if raw else 0):
                size = int.from_bytes(raw[at : at + 4], "little")
                fields.append(raw[at + 4 : at + 4 + size])
                at += 4 + size
            if raw:
                kinds = np.cumsum(_unplane(fields[0], "<u8"), dtype=np.uint64)
                read.append((kinds, *(_unplane(f, "<u4") for f in fields[1:5]), np.frombuffer(fields[5], np.uint8)))
            self.flushes.append(slice(n, n := n + len(fields[5] if raw else b"")))
        every = _distinct(np.concatenate([r[0] for r in read])) if read else np.zeros(0, U64)
        at = [np.searchsorted(every, r[0]).astype(np.uint32) for r in read]
        word, last, second = (np.concatenate([a[r[k]] for a, r in zip(at, read)]) if read else np.zeros(0, np.uint32) for k in (1, 2, 3))
        train = np.concatenate([r[5] for r in read]) if read else np.zeros(0, np.uint8)
        if places:
            self.row = np.concatenate([np.cumsum(r[4], dtype=np.int64) for r in read]) if read else np.zeros(0, np.int64)
        del read, at
        size = len(every)
        (rest1, last), (own, word) = _dense(last, size), _dense(word, size)
        # dish of two words (2), of one (1), of the root (0); each level's dishes point at their parents'
        n0, pairs = len(own), None
        key = last.astype(np.int64) * n0 + word
        if len(rest1) * n0 * size >= 1 << 62:
            pairs, key = np.unique(key, return_inverse=True)
        key = key * size + second
        del last, word, second
        if places:
            order = np.argsort(key)
            key, train = key[order], train[order]
        else:
            key = np.sort(key * 2 + train)
            key, train = key >> 1, (key & 1).astype(np.uint8)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        if places:
            self.token = np.empty(len(key), np.int64)
            self.token[order] = np.cumsum(new) - 1
        # training tokens, of this partition
        total = np.concatenate([[0], np.cumsum(train, dtype=np.int64)])
        self.c2 = np.diff(total[np.append(first, len(key))])
        pair, second = key[first] // max(size, 1), key[first] % max(size, 1)
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        first, self.up2 = np.flatnonzero(new), np.cumsum(new) - 1
        pair = pair[first] if pairs is None else pairs[pair[first]]
        self.ctx1, self.up1 = pair // max(n0, 1), pair % max(n0, 1)
        # restaurants of two words and of one
        ctx, self.ctx2 = np.unique(self.ctx1[self.up2] * size + second, return_inverse=True)
        last = ctx // max(size, 1)
        self.rest1, self.words = every[rest1], every[own]
        self.rest2 = context(every[ctx % max(size, 1)], self.rest1[last])
        self.hot1 = _place(self.rest1, hot[0])
        self.hot2 = np.where(self.hot1[last] >= 0, _place(self.rest2, hot[1]), -1)
        self.freq1 = np.bincount(self.up2, self.c2, len(self.ctx1)).astype(np.int64)
        self.freq0 = np.bincount(self.up1, self.freq1, len(self.words)).astype(np.int64)
        # dishes whose tables are drawn, or that others may hold as well
        self.in2, self.in1 = (self.c2 > 1) | (self.hot2[self.ctx2] >= 0), (self.freq1 > 1) | (self.hot1[self.ctx1] >= 0)

    def dishes(self) -> list[np.ndarray]:
        """What _Dishes is made of."""
        a2, a1 = np.flatnonzero(self.in2), np.flatnonzero(self.in1)
        place1 = np.zeros(len(self.ctx1), np.int64)
        place1[a1] = np.arange(len(a1))
        r2, x2 = np.unique(self.ctx2[a2], return_inverse=True)
        r1, x1 = np.unique(self.ctx1[a1], return_inverse=True)
        c2, f1 = np.where(self.in2, 0, self.c2), np.where(self.in1, 0, self.freq1)
        number = lambda at, x, n: np.bincount(at, x, n).astype("<u4")
        return [
            self.rest2[r2], self.hot2[r2].astype("<i4"), number(self.ctx2, c2, len(self.rest2))[r2], x2.astype("<u4"), place1[self.up2[a2]].astype("<u4"), self.c2[a2].astype("<u4"),
            self.rest1[r1], self.hot1[r1].astype("<i4"), number(self.ctx1, f1, len(self.rest1))[r1], x1.astype("<u4"), self.up1[a1].astype("<u4"), number(self.up2, c2, len(self.ctx1))[a1],
            self.freq1[a1].astype("<u4"), self.words, number(self.up1, f1, len(self.words)), self.freq0.astype("<u4"),
        ]

    def lone(self) -> list[tuple]:
        """Sums of what _Dishes leaves out: dishes of one customer, and restaurants that have no others."""
        out = [("once2", int((self.c2[~self.in2] == 1).sum())), ("once1", int((self.freq1[~self.in1] == 1).sum()))]
        items = [(k, [0], [n], [0]) for k, n in out]
        for level, at, drawn, c, n in ((2, self.ctx2, self.in2, self.c2, len(self.rest2)), (1, self.ctx1, self.in1, self.freq1, len(self.rest1))):
            has = np.zeros(n, bool)
            has[at[drawn]] = True
            size = np.bincount(at, c, n).astype(np.int64)[~has]
            items.append(_histogram(level, size, size))
        return items


def _histogram(level: int, c: np.ndarray, t: np.ndarray) -> tuple:
    """How many restaurants have so many customers and tables."""
    pairs, often = np.unique((_rounded(c) << 31 | _rounded(t))[c > 0], return_counts=True)
    return f"held{level}", pairs, often, np.zeros(len(pairs))


class _Dishes:
    """A part's dishes of two customers or more and those that other parts hold too; their seating."""

    def __init__(self, parts: list[np.ndarray], answers: dict | None = None):
        self.rest2, self.hot2, self.f2, x2, y2, c2, self.rest1, self.hot1, self.fr1, x1, y1, f1, freq1, self.words, f0, freq0 = parts
        self.x2, self.y2, self.c2, self.x1, self.y1, self.f1, self.freq1, self.f0, self.freq0 = (x.astype(np.int64) for x in (x2, y2, c2, x1, y1, f1, freq1, f0, freq0))
        self.key1, self.key2 = _key1(self.rest1[self.x1], self.words[self.y1]), _key2(self.rest2[self.x2], self.words[self.y1[self.y2]])
        self.key0 = mix(self.words + U64(0x5851F42D4C957F2D))
        self.shared1, self.shared2 = np.flatnonzero(self.hot1[self.x1] >= 0), np.flatnonzero(self.hot2[self.x2] >= 0)
        self.shared1, self.shared2 = self.shared1[np.argsort(self.key1[self.shared1])], self.shared2[np.argsort(self.key2[self.shared2])]
        if answers is not None:
            empty = (np.zeros(0, np.int64), [np.zeros(0, np.int64)] * 2)
            (_, (all2, flag2)), (slot1, (all1, flag1)), (slot0, (all0, flag0)) = (answers.get(k, empty) for k in (2, 1, 0))
            self.c2[self.shared2], self.freq1[self.shared1], self.freq0 = all2, all1, all0
            self.count2, self.count1, self.count0 = np.ones(len(self.c2), bool), np.ones(len(self.freq1), bool), flag0 != OTHER
            self.count2[self.shared2], self.count1[self.shared1] = flag2 != OTHER, flag1 != OTHER
            # places of dishes that others hold too, in the order of their hashes, and their names at the owner
            self.ask1, self.slot1 = self.shared1[flag1 != ALONE], slot1[flag1 != ALONE]
            self.ask0, self.slot0 = np.flatnonzero(flag0 != ALONE), slot0[flag0 != ALONE]

    def begin(self) -> None:
        """One table for each dish; c1 and c0 are what this part's tables give."""
        self.t2, self.t1, self.t0 = np.minimum(self.c2, 1), np.minimum(self.freq1, 1), np.minimum(self.freq0, 1)
        self.next1, self.next0 = self.customers1(), self.customers0()
        self.c1, self.c0 = self.next1.copy(), self.next0.copy()

    def customers1(self) -> np.ndarray:
        return self.f1 + np.bincount(self.y2, self.t2 * self.count2, len(self.y1)).astype(np.int64)

    def customers0(self) -> np.ndarray:
        return self.f0 + np.bincount(self.y1, self.t1 * self.count1, len(self.words)).astype(np.int64)

    def seating(self) -> list[np.ndarray]:
        return [x.astype("<u4") for x in (self.t2, self.t1, self.c1, self.next1, self.t0, self.c0, self.next0)]

    def restore(self, seating: list[np.ndarray], answers: dict) -> None:
        """The seating after a turn; next1 and next0 are then all customers that the turn's tables give."""
        self.t2, self.t1, self.c1, self.next1, self.t0, self.c0, self.next0 = (x.astype(np.int64) for x in seating)
        for level, ask, x in ((1, self.ask1, self.next1), (0, self.ask0, self.next0)):
            if len(ask):
                x[ask] = answers[level][1][0]

    def turn(self, corpus: Corpus, totals: Totals, number: int) -> None:
        (d2, d1, d0), (s2, s1, s0) = corpus.discounts, corpus.strengths
        all1 = [_sum_hot(self.fr1 + np.bincount(self.x1, x, len(self.rest1)), self.hot1, h)[self.x1] for x, h in ((self.c1, totals.c1), (self.t1, totals.t1))]
        tables2 = _sum_hot(self.f2 + np.bincount(self.x2, self.t2, len(self.rest2)), self.hot2, totals.t2)[self.x2]
        p0 = corpus.root(totals, self.c0, self.t0)
        p1 = corpus.one(self.c1, self.t1, *all1, p0[self.y1])

        def drawn(c, t, tables, parent, d, s, keys):
            new, at = np.zeros(len(c), np.int64), np.flatnonzero(c > 0)
            new[at] = draw_tables(c[at], tables[at] - t[at] + 1, parent[at], d, s, keys[at], number)
            return new

        self.t2 = drawn(self.c2, self.t2, tables2, p1[self.y2], d2, s2, self.key2)
        given1, self.c1 = self.customers1(), self.next1
        self.t1 = drawn(self.c1, self.t1, all1[1], p0[self.y1], d1, s1, self.key1)
        given0, self.c0 = self.customers0(), self.next0
        self.t0 = drawn(self.c0, self.t0, np.full(len(self.c0), totals.t0), np.full(len(self.c0), 1 / (corpus.v + 1)), d0, s0, self.key0)
        self.next1, self.next0 = given1, given0

    def sums(self, first: bool) -> list[tuple]:
        """For the driver: totals of the root and of hot restaurants. At first all parts' own customers are summed, later each dish's once."""
        one = lambda x, count: x if first else x * count
        items = [("root", [0], [int(one(self.c0, self.count0).sum())], [int((self.t0 * self.count0).sum())])]
        for level, hot, x, c, t, n in ((1, self.hot1, self.x1, one(self.c1, self.count1), self.t1 * self.count1, len(self.rest1)), (2, self.hot2, self.x2, self.c2 * self.count2, self.t2 * self.count2, len(self.rest2))):
            at = np.flatnonzero(hot >= 0)
            items.append((f"hot{level}", hot[at], np.bincount(x, c, n)[at], np.bincount(x, t, n)[at]))
        return items

    def statistics(self) -> list[tuple]:
        """For discounts and strengths, at first: numbers of dishes of one and two customers and the histogram of restaurants, but for what owners know."""
        known1, known0 = np.ones(len(self.c1), bool), np.ones(len(self.c0), bool)
        known1[self.ask1] = known0[self.ask0] = False
        items = [(f"once{k}", [0], [int((c == 1).sum())], [int((c == 2).sum())]) for k, c in ((2, self.c2[self.count2]), (1, self.c1[known1]), (0, self.c0[known0]))]
        for level, hot, f, x, c, t, n in ((1, self.hot1, self.fr1, self.x1, self.c1, self.t1, len(self.rest1)), (2, self.hot2, self.f2, self.x2, self.c2, self.t2, len(self.rest2))):
            c, t = ((f + np.bincount(x, y, n)).astype(np.int64)[hot < 0] for y in (c, t))
            items.append(_histogram(level, c, t))
        return [*items, ("size", [0], [int((self.freq0 * self.count0).sum())], [int(((self.freq0 > 0) & self.count0).sum())])]


#: Kinds of sums for the driver.
KINDS = ("root", "hot1", "hot2", "once0", "once1", "once2", "held1", "held2", "owned0", "owned1", "owned2", "size", "flushes")


def _summed(items: list[tuple]) -> list[np.ndarray]:
    """(kind's place in KINDS, number, a, b), once for each kind and number, of (kind, numbers, a, b)."""
    kind = np.repeat([KINDS.index(x[0]) for x in items], [len(x[1]) for x in items]).astype(np.int64)
    ctx, a, b = (np.concatenate([np.zeros(0, t), *(np.asarray(x[k], t) for x in items)]) for k, t in ((1, np.int64), (2, float), (3, float)))
    order = np.lexsort((ctx, kind))
    kind, ctx, a, b = kind[order], ctx[order], a[order], b[order]
    first = np.flatnonzero((np.diff(kind, prepend=-1) != 0) | (np.diff(ctx, prepend=-1) != 0))
    return [kind[first], ctx[first], *((np.add.reduceat(x, first) if len(first) else x) for x in (a, b))]


def _by_kind(sums: list[np.ndarray]) -> list[tuple]:
    kind, ctx, a, b = sums
    return [(KINDS[k], ctx[kind == k], a[kind == k], b[kind == k]) for k in np.unique(kind).tolist()]


def _pack(key: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Ascending keys and as many numbers of each column."""
    raw = len(key).to_bytes(4, "little") + _plane(np.diff(key, prepend=U64(0)).astype("<u8")) + b"".join(_plane(np.asarray(c).astype("<u8")) for c in columns)
    return _zstd()[0].compress(raw)


def _unpack(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    raw = _zstd()[1].decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    fields = [_unplane(raw[at : at + 8 * n], "<u8") for at in range(4, len(raw), 8 * n)]
    return np.cumsum(fields[0], dtype=np.uint64), [f.astype(np.int64) for f in fields[1:]]


def _by_owner(hashes: np.ndarray, key: np.ndarray, column: np.ndarray, n_owners: int) -> list[bytes]:
    """Shares for the owners of hashes (ascending), who own equal ranges of them."""
    bounds = np.searchsorted(((hashes >> U64(32)) * U64(n_owners)) >> U64(32), np.arange(n_owners + 1, dtype=np.uint64))
    return [_pack(key[x:y], [column[x:y]]) if y > x else b"" for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _join(blobs: tuple[bytes, ...]) -> bytes:
    """The blobs of levels 0, 1, 2 as one; none where all are empty."""
    return b"".join(len(b).to_bytes(4, "little") + b for b in blobs) if any(blobs) else b""


def _levels(blob: bytes) -> dict[int, bytes]:
    out, at = {}, 0
    for level in range(3 if blob else 0):
        size = int.from_bytes(blob[at : at + 4], "little")
        if size:
            out[level] = blob[at + 4 : at + 4 + size]
        at += 4 + size
    return out


def _rounded(x: np.ndarray) -> np.ndarray:
    """Whole numbers to their first eight bits, so that pairs of them stay few."""
    shift = np.maximum(np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) - 7, 0)
    return x >> shift << shift


def _answer(shares: str, answers: str, owner: int, n_parts: int) -> list[tuple]:
    """Sum the shares of each dish and answer each part's with its number at the owner, the sum, and who counts it."""
    held, items, out = defaultdict(list), [], [{} for _ in range(n_parts)]
    for p in range(n_parts):
        for level, blob in _levels(_blob(shares, p, owner)).items():
            held[level].append((p, *_unpack(blob)))
    for level, got in sorted(held.items()):
        kinds, slot = np.unique(np.concatenate([g[1] for g in got]), return_inverse=True)
        sums = np.bincount(slot, np.concatenate([g[2][0] for g in got]), len(kinds)).astype(np.int64)
        holders, first = np.bincount(slot, minlength=len(kinds)), np.zeros(len(kinds), np.int64)
        first[slot[::-1]] = np.repeat([g[0] for g in got], [len(g[1]) for g in got])[::-1]
        items.append((f"owned{level}", [0], [int((sums == 1).sum())], [int((sums == 2).sum())]))
        at = 0
        for p, key, _ in got:
            mine = slot[at : at + len(key)]
            at += len(key)
            flag = np.where(holders[mine] == 1, ALONE, np.where(first[mine] == p, FIRST, OTHER))
            out[p][level] = _pack(mine.astype(np.uint64), [sums[mine], flag])
    _write(answers, str(owner), [_join(tuple(x.get(k, b"") for k in range(3))) for x in out])
    return items


def _answers(folder: str, part: int, n_owners: int) -> dict[int, tuple]:
    """By level (number at the owner, [sums, flags]) of a part's shared dishes in the order of their hashes."""
    held = defaultdict(list)
    for owner in range(n_owners):
        for level, blob in _levels(_blob(folder, owner, part)).items():
            held[level].append(_unpack(blob))
    return {level: (np.concatenate([g[0] for g in got]), [np.concatenate([g[1][k] for g in got]) for k in (0, 1)]) for level, got in held.items()}


def _each(spark: SparkSession, n: int, work: Callable[[int], list[tuple]]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Do work for 0 .. n - 1, a task each; sums of what it returns, by kind and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for batch in batches for k in batch["id"].to_pylist()):
            yield pa.RecordBatch.from_pydict({"sums": [_freeze(_summed(work(k)))]})

    return _added(spark.range(0, n, 1, n).mapInArrow(lean(run), "sums binary"), n)


def _digest(names: list[str]) -> int:
    return zlib.crc32("".join(names).encode())


def _each_part(spark: SparkSession, tokens: RDD, n: int, work: Callable[[int, list[str], list[bytes]], list[tuple]], known: list[str] | None = None) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same, for each of n parts with the names of all flushes, ascending, and its blob of each. All must see the same flushes, the known ones."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = defaultdict(list)
        for part, name, blob in rows:
            held[part] += [(name, bytes(blob))] if name else []
        for part in sorted(held):
            flushes = sorted(held.pop(part))
            names = [name for name, _ in flushes]
            items = [("flushes", [_digest(names)], [1], [0]), *work(part, names, [blob for _, blob in flushes])]
            yield (_freeze(_summed(items)),)

    got = _added(spark.createDataFrame(tokens.mapPartitions(lean(run)), "sums binary", verifySchema=False), n)
    seen, parts, _ = got.pop("flushes")
    if parts.tolist() != [n] or known is not None and seen.tolist() != [_digest(known)]:
        raise RuntimeError("lost tokens were dealt again from documents in another order; the documents must be written first")
    return got


def _added(sums: DataFrame, n: int) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sums of n tasks' frozen ones, by kind and number."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"sums": [_freeze(_summed([x for batch in batches for blob in batch["sums"].to_pylist() for x in _by_kind(_thaw(blob))]))]})

    # a blob a task, and for the driver one of sixteen tasks
    rows = sums.repartition(-(-n // 16)).mapInArrow(lean(add), "sums binary").collect()
    return {k: v for k, *v in _by_kind(_summed([x for r in rows for x in _by_kind(_thaw(bytes(r.sums)))]))}


def _totals(got: dict, hot: tuple[np.ndarray, np.ndarray]) -> Totals:
    _, c0, t0 = got.get("root", ((), (), ()))
    out = [float(sum(c0)), float(sum(t0))]
    for level in (1, 2):
        c, t = np.zeros(len(hot[level - 1])), np.zeros(len(hot[level - 1]))
        if f"hot{level}" in got:
            at, a, b = got[f"hot{level}"]
            c[at], t[at] = a, b
        out += [c, t]
    return Totals(*out)


def _fit(got: dict, first: Totals) -> Corpus:
    """Discounts by the numbers of dishes of one and two customers, strengths by likelihood, of the first seating."""
    discounts, strengths = [], []
    for k in (2, 1, 0):
        n1, n2 = (sum(float(got[name][j].sum()) for name in (f"once{k}", *((f"owned{k}",) if k < 2 else ())) if name in got) for j in (1, 2))
        discounts.append(float(np.clip(n1 / (n1 + 2 * n2), 0.05, 0.95)) if n1 else 0.5)
    for k, d, c_hot, t_hot in ((2, discounts[0], first.c2, first.t2), (1, discounts[1], first.c1, first.t1)):
        pairs, often, _ = got.get(f"held{k}", (np.zeros(0, np.int64), np.zeros(0), None))
        c_hot, t_hot = _rounded(c_hot.astype(np.int64)), _rounded(t_hot.astype(np.int64))
        pairs, slot = np.unique(np.concatenate([pairs, c_hot << 31 | t_hot]), return_inverse=True)
        often = np.bincount(slot, np.concatenate([often, np.ones(len(c_hot))]), len(pairs))
        strengths.append(likeliest_strength(pairs >> 31, pairs & ((1 << 31) - 1), d, often))
    strengths.append(likeliest_strength(np.array([first.c0]), np.array([first.t0]), discounts[2]))
    _, n, v = got["size"]
    return Corpus(float(n.sum()), float(v.sum()), tuple(discounts), tuple(strengths))


def score_texts(docs: DataFrame, train: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    docs: doc_id, text (further columns are ignored). train: which rows to learn from, in_training(doc_id) by default. A null
    text is empty and has its end token alone. With nothing to learn from each token has probability 1. Repeated rows are
    learned from and answered each. Memory of a task follows from its partition's tokens: more shuffle partitions, less memory.
    """
    spark = docs.sparkSession
    small_batches(spark)
    train = in_training(F.col("doc_id")) if train is None else train
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    n_parts = partitions(spark)
    n_owners = -(-n_parts // PARTS_OWNED)
    hot = _hot(docs, n_parts)
    tables, dishes, known, scored = (new_folder(spark, k) for k in ("tables", "dishes", "known", "scored"))
    tokens = _deal(docs, hot, n_parts, tables)
    places = spark.sparkContext.broadcast(hot)

    def exchange(shares: str, answers: str) -> dict:
        got = _each(spark, n_owners, lambda owner: _answer(shares, answers, owner, n_parts))
        _drop(shares)
        return got

    def register(shares: str):
        def work(part: int, names: list[str], blobs: list[bytes]) -> list[tuple]:
            if part == 0:
                _write(dishes, "names", ["\n".join(names).encode()])
            p = _Part(blobs, places.value)
            parts = p.dishes()
            d = _Dishes(parts)
            _write(dishes, str(part), [_freeze(parts)])
            levels = [_by_owner(d.words, d.words, d.freq0, n_owners)]
            levels += [_by_owner(keys[at], keys[at], c[at], n_owners) for at, keys, c in ((d.shared1, d.key1, d.freq1), (d.shared2, d.key2, d.c2))]
            _write(shares, str(part), [_join(x) for x in zip(*levels)])
            return p.lone()

        return work

    def turn(number: int, past: tuple[str, str] | None, now: str, shares: str | None, corpus, totals):
        def work(part: int) -> list[tuple]:
            d = _Dishes(_thaw(_blob(dishes, part)), _answers(known, part, n_owners))
            if past is None:
                d.begin()
            else:
                d.restore(_thaw(_blob(past[0], part)), _answers(past[1], part, n_owners))
                if number == 0:  # customers of the first seating, now that all are known
                    d.c1, d.c0 = d.next1.copy(), d.next0.copy()
                d.turn(corpus.value, totals.value, number)
            _write(now, str(part), [_freeze(d.seating())])
            if shares:
                level0 = _by_owner(d.words[d.ask0], d.slot0.astype(np.uint64), d.next0[d.ask0], n_owners)
                level1 = _by_owner(d.key1[d.ask1], d.slot1.astype(np.uint64), d.next1[d.ask1], n_owners)
                _write(shares, str(part), [_join((*x, b"")) for x in zip(level0, level1)])
            return d.sums(past is None) + (d.statistics() if past is None else [])

        return work

    shares = new_folder(spark, "shares")
    lone = _each_part(spark, tokens, n_parts, register(shares))
    flushes = spark.sparkContext.broadcast(_blob(dishes, "names").decode().split())
    exchange(shares, known)
    seated, shares, answers = (new_folder(spark, k) for k in ("seating", "shares", "answers"))
    got = _each(spark, n_parts, turn(-1, None, seated, shares, None, None))
    for more in (lone, exchange(shares, answers)):
        for k, v in more.items():
            got[k] = tuple(np.concatenate([x, y]) for x, y in zip(got[k], v)) if k in got else v
    totals, draws = _totals(got, hot), []
    corpus = _fit(got, totals) if "size" in got else Corpus(0.0, 0.0, (0.5,) * 3, (1.0,) * 3)
    shared = spark.sparkContext.broadcast(corpus)
    turns = BURN_IN + DRAWS if corpus.n else 0
    for number in range(turns):
        past, seated = (seated, answers), new_folder(spark, "seating")
        shares, answers = (new_folder(spark, k) for k in ("shares", "answers")) if number < turns - 1 else (None, None)
        got = _each(spark, n_parts, turn(number, past, seated, shares, shared, spark.sparkContext.broadcast(totals)))
        _drop(past[1], *([past[0]] if number <= BURN_IN else []))
        if shares:
            exchange(shares, answers)
        totals = _totals(got, hot)
        if number >= BURN_IN:
            draws.append((seated, totals))
    kept = spark.sparkContext.broadcast(draws)

    def score(part: int, names: list[str], blobs: list[bytes]) -> list[tuple]:
        corpus, p = shared.value, _Part(blobs, places.value, True)
        d = _Dishes(_thaw(_blob(dishes, part)), _answers(known, part, n_owners))
        c2, prob = p.c2.copy(), np.zeros(len(p.c2))
        c2[p.in2] = d.c2
        for folder, totals in kept.value:
            d.t2, d.t1, d.c1, _, d.t0, d.c0, _ = _thaw(_blob(folder, part))
            t2, c1, t1 = c2.copy(), p.freq1.copy(), p.freq1.copy()
            t2[p.in2], c1[p.in1], t1[p.in1] = d.t2, d.c1, d.t1
            all2 = [_sum_hot(np.bincount(p.ctx2, x, len(p.rest2)), p.hot2, h)[p.ctx2] for x, h in ((c2, totals.c2), (t2, totals.t2))]
            all1 = [_sum_hot(np.bincount(p.ctx1, x, len(p.rest1)), p.hot1, h)[p.ctx1] for x, h in ((c1, totals.c1), (t1, totals.t1))]
            p1 = corpus.one(c1, t1, *all1, corpus.root(totals, d.c0.astype(float), d.t0)[p.up1])
            prob += corpus.two(c2, t2, *all2, p1[p.up2])
        logs = np.log10(prob / len(kept.value)) if kept.value else prob
        word = p.up1[p.up2]
        base = np.log10((d.freq0 + 1) / (corpus.n + corpus.v + 1))
        values, out = ((d.freq0 > 0)[word], base[word], logs), []
        for mine in p.flushes:
            row, token = p.row[mine], p.token[mine]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            if not len(first):
                out.append(b"")
                continue
            sums = [np.diff(np.append(first, len(row))), *(np.add.reduceat(x[token].astype(float), first) for x in values)]
            raw = b"".join(_plane(x.astype(k)) for x, k in zip((np.diff(row[first], prepend=0), *sums), ("<u4", "<u4", "<u4", "<f8", "<f8")))
            out.append(_zstd()[0].compress(raw))
        _write(scored, str(part), out)
        return []

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (k for batch in batches for k in batch["id"].to_pylist()):
            raw = _zstd()[1].decompress(_blob(tables, flushes.value[k]))
            n = len(raw) // 10
            total = [np.zeros(n) for _ in range(4)]
            # in the order of parts, so that repeated runs give the same bits
            for part in range(n_parts):
                blob = _blob(scored, part, k)
                sums = _zstd()[1].decompress(blob) if blob else b""
                size = len(sums) // 28
                row = np.cumsum(_unplane(sums[: 4 * size], "<u4"), dtype=np.int64)
                for j, (kind, at) in enumerate((("<u4", 4), ("<u4", 8), ("<f8", 12), ("<f8", 20))):
                    total[j][row] += _unplane(sums[at * size : (at + int(kind[2])) * size], kind)
            ids, null, train = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n).astype(bool), np.frombuffer(raw, np.uint8, n, 9 * n).astype(bool)
            columns = {
                "doc_id": pa.array(ids, pa.int64(), mask=null),
                "held_out": pa.array(~train),
                "n_tokens": pa.array(total[0].astype(np.int64)),
                "n_known": pa.array(total[1].astype(np.int64)),
                "train_tokens": pa.array(np.full(n, int(shared.value.n)), pa.int64()),
                "base_score": pa.array(total[2]),
                "score": pa.array(total[3]),
            }
            yield pa.RecordBatch.from_pydict(columns)

    _each_part(spark, tokens, n_parts, score, flushes.value)
    del tokens
    collect_garbage(spark)
    _drop(dishes, known, seated, *(folder for folder, _ in draws), *([answers] if answers else []))
    n = len(flushes.value)
    return spark.range(0, n, 1, max(n, 1)).mapInArrow(lean(unite), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
