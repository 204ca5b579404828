"""Suffix-array dedup: remove every byte that a long string shared with an earlier document covers.

A string of `length` bytes is a suffix cut at that depth, and equal strings are one bucket of the suffix array. The array is built by
bucket-pointer refinement: suffixes start in the buckets of their first q bytes; a bucket of more than one is refined by
sorting on the bucket identifiers of later offsets, q, then 2q, 4q bytes on, and each refinement uses what the last has left.

To build it for a corpus, suffixes must meet. The sampled q-gram of a string, the one of least hash among its q-grams
(its anchor), depends on the string alone, so equal strings have equal anchors, and suffixes are dealt to partitions by it. Consecutive strings
with one anchor are a run. A run is settled at once if an earlier document has the whole run, which a hash of it tells; a run whose anchor
no other document has is settled too, as unique. Only the rest travels as bytes and is refined.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from palisade.llm._text import U64, mix, view
from palisade.llm._work import cut, lean, partitions, small_batches

LENGTH = 50
#: Bytes of the sampled q-gram that runs go by, and of the first buckets of the refinement.
ANCHOR, Q = 16, 8
#: Window starts looked at together, and runs that a task holds before it sends them off.
CHUNK, FLUSH = 1 << 19, 1_000_000
#: Documents from which it is told which anchors are frequent, about.
SAMPLE = 4096
#: Groups into which a partition's bytes are dealt for refinement.
FINE = 8
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _codes(c: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number."""
    c = np.ascontiguousarray(c)
    return np.ndarray((max(0, len(c) - 7),), "<u8", c, 0, (1,)).astype(np.uint64)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        up, down = np.full(n, _A), np.full(n, _INV)
        up[:1] = down[:1] = 1
        _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS[0], _POWERS[1]


def _ends(low: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last strings of the runs of equal low."""
    m = len(low)
    first = valid[:m].copy()
    first[1:] &= ~valid[: m - 1] | (low[1:] != low[:-1])
    last = valid[:m].copy()
    last[:-1] &= ~valid[1:m] | (low[1:] != low[:-1])
    return np.flatnonzero(first), np.flatnonzero(last)


def runs(b: np.ndarray, offsets: np.ndarray, length: int = LENGTH, hot: np.ndarray = np.zeros(0, np.uint64)) -> tuple[np.ndarray, ...]:
    """(row, start, count, anchor, whole) of all runs: `count` strings from byte `start` of a text on share an anchor; whole is a hash of all their bytes.

    A string whose anchor is in hot (ascending) has a hash of all its bytes for an anchor instead.
    """
    out: list[tuple[np.ndarray, ...]] = []
    width = length - ANCHOR + 1
    up, down = _powers(CHUNK + 2 * length)
    for p in range(0, max(0, len(b) - length + 1), CHUNK):
        c = b[p : p + CHUNK + length - 1]
        u = _codes(c)
        n = len(c) - ANCHOR + 1
        h = mix(u[:n] * _A + (u[8 : 8 + n] ^ (u[8 : 8 + n] >> U64(31))) * _B)
        low, w = h, 1
        while 2 * w <= width:
            low = np.minimum(low[:-w], low[w:])
            w *= 2
        if w < width:
            low = np.minimum(low[: -(width - w)], low[width - w :])
        m = len(low)  # strings that fit
        valid = np.ones(m + 1, bool)
        valid[m] = False
        ends = offsets[np.searchsorted(offsets, p, "right") : np.searchsorted(offsets, p + m + length, "right") + 1]
        for e in ends.tolist():  # no string across the end of a text
            valid[max(0, e - p - length + 1) : max(0, e - p)] = False
        s, e = _ends(low, valid)
        if not len(s):
            continue
        total = np.cumsum(h * up[:n])
        often = np.isin(low[s], hot) if len(hot) else np.zeros(0, bool)
        if often.any():
            size = e[often] - s[often] + 1
            at = np.repeat(s[often] - np.cumsum(size) + size, size) + np.arange(size.sum())
            low[at] = mix((total[at + width - 1] - np.where(at > 0, total[at - 1], U64(0))) * down[at] + _B)
            s, e = _ends(low, valid)
        whole = mix((total[e + width - 1] - np.where(s > 0, total[s - 1], U64(0))) * down[s])
        row = np.searchsorted(offsets, s + p, "right") - 1
        out.append((row, s + p - offsets[row], e - s + 1, low[s], whole))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def refine(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket pointers of all positions of text at a depth of `length` bytes: equal for equal strings.

    Positions within `length` bytes of the end have pointers too, which compare as far as the text goes.
    """
    code = _codes(text).byteswap()
    m = len(code)
    sa = np.argsort(code, kind="stable")
    ordered = code[sa]
    fresh = np.ones(m, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    start = np.maximum.accumulate(np.where(fresh, np.arange(m), 0))
    pointer = np.empty(m, np.int64)
    pointer[sa] = start
    depth = Q
    while depth < length:
        step = min(depth, length - depth)
        alone = fresh & np.append(fresh[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        pos = sa[slots]
        later = np.where(pos + step < m, pointer[np.minimum(pos + step, m - 1)], -1)
        key = pointer[pos] * (m + 1) + later + 1
        order = np.argsort(key, kind="stable")
        key, pos = key[order], pos[order]
        new = np.ones(len(pos), bool)
        new[1:] = key[1:] != key[:-1]
        sa[slots] = pos
        fresh[slots] = new
        pointer[pos] = slots[np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))]
        depth += step
    return pointer


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays by planes of bytes, compressed."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
        out.append(len(raw).to_bytes(4, "little") + raw)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        size = int.from_bytes(raw[at : at + 4], "little")
        part = np.frombuffer(raw, np.uint8, size, at + 4)
        out.append(np.ascontiguousarray(part.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel() if size else np.zeros(0, kind))
        at += 4 + size
    return out


def _narrow(a: np.ndarray, size: int) -> np.ndarray:
    """The low `size` bytes of each number. Within a part, anchor and whole together still tell strings apart by 96 bits."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8)[:, :size]).view(f"V{size}").ravel() if len(a) else np.zeros(0, f"V{size}")


def _wide(a: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), 8), np.uint8)
    if len(a):
        out[:, : a.dtype.itemsize] = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1)
    return out.view(np.uint64).ravel()


_ROWS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("print", pa.int64()), ("blob", pa.binary())])
_ROWS_SQL = "part int, kind int, doc_id long, print long, blob binary"
#: Kinds of rows: runs to be settled; strings that are covered, of a bucket of documents; runs whose bytes are asked for, of a bucket.
_RUNS, _COVERED, _ASKED = 0, 1, 2


def _by_bucket(kind: int, n_buckets: int, doc: np.ndarray, mark: np.ndarray, *arrays: np.ndarray) -> list[tuple]:
    """A row for each bucket of documents (by doc_id) with the items of all its documents, packed."""
    if not len(doc):
        return []
    bucket = (mix(doc.astype(np.uint64)) % U64(n_buckets)).astype(np.int64)
    order = np.lexsort((mark, doc, bucket))
    bucket = bucket[order]
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() + [len(doc)]
    columns = [doc[order].astype("<i8"), mark[order].astype("<i8"), *(x[order].astype("<u4") for x in arrays)]
    return [(int(bucket[a]), kind, 0, 0, _pack(*(x[a:b] for x in columns))) for a, b in zip(at, at[1:])]


def _by_doc(packed: DataFrame, n_buckets: int, n_arrays: int) -> DataFrame:
    """(doc_id, print, blobs) of every document, with its items' arrays, from the rows of _by_bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpack(x, "<i8", "<i8", *["<u4"] * n_arrays) for batch in batches for x in batch["blob"].to_pylist()]
        if not held:
            return
        doc, mark, *arrays = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((mark, doc))
        doc, mark = doc[order], mark[order]
        arrays = [x[order] for x in arrays]
        at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])])).tolist() + [len(doc)]
        for k in range(0, len(at) - 1, 1000):
            rows = [(0, 0, int(doc[a]), int(mark[a]), b"".join(x[a:b].tobytes() for x in arrays)) for a, b in zip(at[k : k + 1000], at[k + 1 : k + 1001])]
            yield _batch(rows)

    return packed.repartitionById(n_buckets, "part").mapInArrow(work, _ROWS_SQL).select("doc_id", "print", F.array("blob").alias("blobs"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROWS)], schema=_ROWS)


def _settle(anchor, whole, doc, mark, start, count, final: bool):
    """(covered, rest) positions: a run is covered if a smaller document has the whole of it too.

    Of the others those remain that can still be told something by others, or tell: all of them unless final, else those of anchors that several documents share.
    """
    order = np.lexsort((doc, whole, anchor))
    a, w, d = anchor[order], whole[order], doc[order]
    head = np.concatenate([[True], (a[1:] != a[:-1]) | (w[1:] != w[:-1])])
    least = d[np.maximum.accumulate(np.where(head, np.arange(len(d)), 0))]
    covered = d > least
    rest = ~covered
    if final:
        kept = np.flatnonzero(rest)
        a, w, d = a[kept], w[kept], d[kept]
        if len(a):
            at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            size = np.diff(np.append(at, len(a)))
            several = np.repeat(np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at), size)
            return order[covered], order[kept[several]]
    return order[covered], order[rest]


def _hot_anchors(docs: DataFrame, length: int, n_parts: int) -> np.ndarray:
    """Anchors with so many different runs in a sample of about SAMPLE documents that one partition would get several others' share.

    At most 4 * n_parts of them. They only say where strings meet: any choice gives the same result.
    """
    m = max(1, docs.count() // SAMPLE)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, _, anchor, whole = runs(*view(batch["text"]), length)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (anchor, whole)], ["anchor", "whole"])

    sample = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(m)) == 0) & F.col("text").isNotNull()).select("text")
    found = sample.mapInArrow(lean(work), "anchor long, whole long").distinct().groupBy("anchor").agg(F.count("*").alias("n"))
    total = found.agg(F.sum("n")).first()[0] or 0
    rows = found.where(F.col("n") >= max(8, total / (4 * n_parts))).orderBy(F.desc("n"), "anchor").limit(4 * n_parts).collect()
    return np.sort(np.array([r.anchor for r in rows], np.int64).view(np.uint64))


def _covered(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, print, blobs) rows; the blobs have starts and counts of strings of a document that an earlier one has too."""
    spark = docs.sparkSession
    n_parts = partitions(spark)
    hot = spark.sparkContext.broadcast(_hot_anchors(docs, length, n_parts))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            doc, mark, start, count, anchor, whole = (np.concatenate(x) for x in zip(*held))
            held, size = [], 0
            covered, rest = _settle(anchor, whole, doc, mark, start, count, False)
            rows = _by_bucket(_COVERED, n_parts, doc[covered], mark[covered], start[covered], count[covered])
            part = (anchor % U64(n_parts)).astype(np.int32)
            rest = np.sort(rest)
            rest = rest[np.argsort(part[rest], kind="stable")]
            bounds = np.searchsorted(part[rest], np.arange(n_parts + 1))
            for p in range(n_parts):
                r = rest[bounds[p] : bounds[p + 1]]
                if len(r):
                    change = np.concatenate([[True], (doc[r][1:] != doc[r][:-1]) | (mark[r][1:] != mark[r][:-1])])
                    ids, marks, index = doc[r][change], mark[r][change], np.cumsum(change) - 1
                    rows.append((p, _RUNS, 0, 0, _pack(_narrow(anchor[r] // U64(n_parts), 5), _narrow(whole[r], 7), ids, marks, np.diff(index, prepend=0).astype("<u4"), start[r].astype("<u4"), count[r].astype("<u4"))))
            for k in range(0, len(rows), 4000):
                yield _batch(rows[k : k + 4000])

        for batch in batches:
            b, offsets = view(batch["text"])
            if not len(b):
                continue
            row, start, count, anchor, whole = runs(b, offsets, length, hot.value)
            doc, mark = np.asarray(batch["doc_id"]), np.asarray(batch["print"])
            held.append((doc[row], mark[row], start.astype(np.uint32), count.astype(np.uint32), anchor, whole))
            size += len(row)
            if size >= FLUSH:
                yield from flush()
        if size:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        part = -1
        for batch in batches:
            kinds = np.asarray(batch["kind"])
            ready = batch.filter(pa.array(kinds == _COVERED))
            if ready.num_rows:
                yield ready
            for p, blob in zip(*(batch.filter(pa.array(kinds == _RUNS))[k].to_pylist() for k in ("part", "blob"))):
                part = p
                anchor, whole, ids, marks, index, start, count = _unpack(blob, "V5", "V7", "<i8", "<i8", "<u4", "<u4", "<u4")
                anchor, whole = _wide(anchor), _wide(whole)
                index = np.cumsum(index)
                held.append([anchor, whole, ids[index], marks[index], start, count])
        if not held:
            return
        anchor, whole, doc, mark, start, count = (np.concatenate(x) for x in zip(*held))
        held.clear()
        covered, rest = _settle(anchor, whole, doc, mark, start, count, True)
        rows = _by_bucket(_COVERED, n_parts, doc[covered], mark[covered], start[covered], count[covered])
        group = (mix(anchor[rest]) % U64(FINE)).astype(np.uint32) + np.uint32(part * FINE)
        rows += _by_bucket(_ASKED, n_parts, doc[rest], mark[rest], start[rest], count[rest], group)
        for k in range(0, len(rows), 4000):
            yield _batch(rows[k : k + 4000])

    plain = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "print", "text")
    met = cut(plain.mapInArrow(lean(find), _ROWS_SQL).repartitionById(n_parts, "part").mapInArrow(lean(meet), _ROWS_SQL))
    asked = _by_doc(met.where(f"kind = {_ASKED}"), n_parts, 3)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            rows = []
            for group, items in held.items():
                text = np.frombuffer(b"".join(x[0] for x in items), np.uint8)
                doc, mark = (np.array([x[k] for x in items], "<i8") for k in (1, 2))
                start, count = (np.array([x[k] for x in items], "<u4") for k in (3, 4))
                rows.append((group, _ASKED, 0, 0, _pack(text, doc, mark, start, count)))
            held.clear()
            size = 0
            return _batch(rows)

        for batch in batches:
            b, offsets = view(batch["text"])
            raw = b.tobytes()
            for at, doc, mark, blobs in zip(offsets.tolist(), *(batch[k].to_pylist() for k in ("doc_id", "print", "blobs"))):
                for blob in blobs:
                    start, count, group = np.frombuffer(blob, "<u4").reshape(3, -1).tolist()
                    for s, c, g in zip(start, count, group):
                        held[g].append((raw[at + s : at + s + c + length - 1], doc, mark, s, c))
                        size += c + length + 100
                if size > 24 << 20:
                    yield flush()
        if size:
            yield flush()

    def compare(table: pa.Table) -> pa.Table:
        parts = [_unpack(x, "u1", "<i8", "<i8", "<u4", "<u4") for x in table["blob"].to_pylist()]
        text, doc, mark, start, count = (np.concatenate(x) for x in zip(*parts))
        size = count.astype(np.int64) + length - 1
        at = np.cumsum(size) - size
        pointer = refine(text, length)
        n = int(count.sum())
        run = np.repeat(np.arange(len(count)), count)
        inside = np.arange(n) - np.repeat(np.cumsum(count, dtype=np.int64) - count, count)
        p, d = pointer[at[run] + inside], doc[run]
        order = np.lexsort((d, p))
        head = np.concatenate([[True], p[order][1:] != p[order][:-1]])
        least = d[order][np.maximum.accumulate(np.where(head, np.arange(n), 0))]
        hit = np.zeros(n, bool)
        hit[order] = d[order] > least
        f = hit.copy()
        f[1:] &= ~hit[:-1] | (run[1:] != run[:-1])
        e = hit.copy()
        e[:-1] &= ~hit[1:] | (run[1:] != run[:-1])
        f, e = np.flatnonzero(f), np.flatnonzero(e)
        rows = _by_bucket(_COVERED, n_parts, d[f], mark[run[f]], start[run[f]] + inside[f], e - f + 1)
        return pa.Table.from_batches([_batch(rows)], _ROWS)

    # with all columns of docs, as in remove_repeats: so both joins have docs from one exchange, and texts are shuffled once
    fetched = asked.join(docs, ["doc_id", "print"]).select(*docs.columns, "blobs").mapInArrow(lean(fetch), _ROWS_SQL)
    refined = fetched.groupBy("part").applyInArrow(compare, _ROWS_SQL)
    return _by_doc(met.where(f"kind = {_COVERED}").union(refined), n_parts, 2)


def spans(starts: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal [from, to) that strings of `length` bytes cover."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(starts, kind="stable")
    s = starts[order].astype(np.int64)
    e = np.maximum.accumulate(s + counts[order].astype(np.int64) + length - 1)
    head = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
    return s[head], e[np.append(head[1:] - 1, len(e) - 1)]


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """All columns of docs for every row (but such as are named like those added), with n_bytes, n_removed, n_spans, kept_sha256; with keep_text the text is what is left.

    docs: doc_id, text and any others. Each byte goes that a string of `length` bytes covers which also starts in a document with a smaller
    doc_id, judged on the texts as they came in, as UTF-8 bytes. With keep_text a character goes if all its bytes do, so
    that the text stays valid; the counts are of bytes in any case. A null text is empty and stays null; a row without a doc_id
    stays whole and takes nothing from others. Rows of one doc_id do not take from each other.

    Within a task, of equal runs only the earliest document's leaves it, so a run that a third of all documents share
    is one entry a task in its partition. The texts of documents with unsettled runs are joined to what is asked
    of them, and all texts once more to their spans; nothing else of the texts moves.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"strings of fewer than {2 * ANCHOR} bytes have no anchors")
    small_batches(docs.sparkSession)
    own = ("doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    others = [c for c in docs.columns if c not in own]
    extra = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("extra")] if others else []
    named = docs.select("doc_id", F.xxhash64("text").alias("print"), "text", *extra)
    known, unknown = named.where("doc_id is not null"), named.where("doc_id is null")
    covered = _covered(known, length)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out, left = batch["text"].to_pylist(), [], []
            for text, blobs in zip(texts, batch["blobs"].to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                pairs = [np.frombuffer(x, "<u4").reshape(2, -1) for x in blobs or ()]
                s, e = spans(*np.concatenate(pairs, axis=1), length) if pairs else (np.zeros(0, np.int64),) * 2
                cuts = list(zip(s.tolist(), e.tolist()))
                if keep_text:
                    left.append(None if text is None else _without(raw, [_characters(raw, a, b) for a, b in cuts]).decode("utf-8", "replace"))
                out.append((len(raw), int((e - s).sum()), len(s), hashlib.sha256(_without(raw, cuts)).hexdigest()))
            text = pa.array(left, pa.string()) if keep_text else batch["text"]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], text, batch["extra"], *(pa.array([o[k] for o in out], pa.int64()) for k in range(3)), pa.array([o[3] for o in out], pa.string())], ["doc_id", "text", "extra", *own[2:]]
            )

    # both joins deal known out alike, so its texts are shuffled once
    joined = known.join(covered, ["doc_id", "print"], "left").select(*named.columns, "blobs").union(unknown.select(*named.columns, F.lit(None).cast("array<binary>")))
    joined = joined.select("doc_id", "text", "extra" if others else F.lit(None).cast("string").alias("extra"), "blobs")
    kinds = dict(joined.dtypes)
    out = joined.mapInArrow(lean(drop), f"doc_id {kinds['doc_id']}, text string, extra {kinds['extra']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    place = {c: F.col("extra").getField(c).alias(c) for c in others}
    return out.select(*(place.get(c, F.col(c)) for c in docs.columns if c not in own[2:]), *own[2:])


def _characters(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """[a, b) less the bytes of characters that are not wholly in it."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def _without(raw: bytes, cuts: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in cuts:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])
