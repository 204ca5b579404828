"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the text's likelihood under hashed byte 4-gram models, the language that the markup
declares, the address suffix, and a prior of the host. What a declaration or a suffix says is learned by grouped sums of
the texts' own posteriors, and so is the host's prior, which is smoothed towards its domain's and that towards the corpus'.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm._text import LOWER, NO_LETTER, SPACE, _cuts, view
from palisade.llm._work import bounded_sample, cut, hot_join, lean, small_batches

GRAM_BUCKETS = 1 << 16
#: Labelled texts that the 4-gram models are counted from at most, chosen by the hash of their id.
TRAIN_ROWS = 8000
#: Share of a text's log-likelihood that counts, for neighbouring 4-grams depend on each other.
TEMPER = 0.25
#: Strength of the priors of host and domain, in texts.
HOST_STRENGTH, DOMAIN_STRENGTH = 20.0, 50.0
#: Posterior below which a row is rejected.
LEAST = 0.5


def _grams(c: np.ndarray) -> np.ndarray:
    low = LOWER[c].astype(np.uint32)
    v = low[:-3] | low[1:-2] << np.uint32(8) | low[2:-1] << np.uint32(16) | low[3:] << np.uint32(24)
    return (v * np.uint32(0x9E3779B1)) >> np.uint32(16)


@dataclass
class GramModel:
    """Log-probabilities (languages, buckets) of 4-grams."""

    languages: list[str]
    table: np.ndarray

    def log_likelihood(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) sums, and the numbers of bytes of words and of 4-grams in each text."""
        b, offsets = view(arr)
        out, size = np.zeros((len(offsets) - 1, len(self.languages))), np.zeros(len(offsets) - 1, np.int64)
        grams = np.zeros(len(offsets) - 1, np.int64)
        for p, end in _cuts(b, offsets, SPACE):
            c = b[p:end]
            first = int(np.searchsorted(offsets, p, "right")) - 1
            rows = np.searchsorted(offsets, np.arange(p, end), "right") - 1 - first
            n = int(rows[-1]) + 1
            size[first : first + n] += np.bincount(rows[~NO_LETTER[c]], minlength=n)
            if len(c) < 4:
                continue
            g, inside = _grams(c), rows[3:] == rows[:-3]
            g, r = g[inside], rows[:-3][inside]
            grams[first : first + n] += np.bincount(r, minlength=n)
            for k, t in enumerate(self.table):
                out[first : first + n, k] += np.bincount(r, t[g], n)
        return out, size, grams


def train(texts: DataFrame, rows: int = TRAIN_ROWS) -> GramModel:
    """4-gram models from at most `rows` rows of texts (doc_id, text, lang); rows without a language are left out."""
    sample = bounded_sample(texts.where("lang is not null and text is not null").select("doc_id", "text", "lang"), "doc_id", rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for i, lang in enumerate(langs):
                c = view(batch["text"].slice(i, 1))[0]
                if len(c) >= 4:
                    seen[lang] = seen.get(lang, 0) + np.bincount(_grams(c), minlength=GRAM_BUCKETS)
        for lang, n in seen.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "n": [n.astype("<i4").tobytes()]})

    total: dict[str, np.ndarray] = {}
    for r in sample.coalesce(8).mapInArrow(lean(count), "lang string, n binary").collect():  # a row for each language and task of 8
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(r.n, "<i4").astype(np.int64)
    languages = sorted(total)
    if not languages:
        return GramModel(["und"], np.zeros((1, GRAM_BUCKETS), np.float32))
    counts = np.stack([total[k] for k in languages]) + 0.5
    return GramModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def declared_language(html: Column) -> Column:
    """The primary tag of the html element's lang attribute, lower-cased, or null."""
    tag = F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})\b""", 1)
    return F.when(tag != "", F.lower(tag))


def visible_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")


def identify(rows: DataFrame, model: GramModel, least: float = LEAST) -> DataFrame:
    """id, language, posterior, text_language, rejected for every row.

    rows: id, text, host, declared, suffix (strings; any of them may be null: it then says nothing; further columns are ignored).
    Declarations outside the model's languages count as one other value. A row is rejected, with language null, if its text
    has no letters or digits, if 4-grams drawn evenly explain it better than any language does, or if no language reaches the posterior `least`. A host's prior leaves out the row's own part.
    Ties go to the language that sorts first. Repeated rows are answered and counted each.

    Group sums are partial aggregates, so a hot host is one row per task, and the join back splits it (hot_join).
    """
    small_batches(rows.sparkSession)
    langs, size = model.languages, len(model.languages)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    known = F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared").isNotNull(), F.lit("other"))
    plain = rows.select("id", F.col("text").cast("string").alias("text"), F.col("host").cast("string").alias("host"), known.alias("declared"), F.col("suffix").cast("string").alias("suffix"))
    kind = dict(plain.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ll, letters, grams = m.log_likelihood(batch["text"])
            none = (ll.max(axis=1) < -grams * np.log(GRAM_BUCKETS)) if len(ll) else np.zeros(0, bool)
            ll = TEMPER * (ll - ll.max(axis=1, keepdims=True)) if len(ll) else ll
            p = np.exp(ll)
            p /= p.sum(axis=1, keepdims=True) if len(p) else 1
            flat = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, size), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["host"], batch["declared"], batch["suffix"], flat(ll), flat(p), pa.array(letters), pa.array(none)], ["id", "host", "declared", "suffix", "ll", "p", "letters", "none"])

    scored = cut(plain.mapInArrow(lean(work), f"id {kind}, host string, declared string, suffix string, ll array<double>, p array<double>, letters long, none boolean"))
    scored = scored.withColumn("p", F.when((F.col("letters") > 0) & ~F.col("none"), F.col("p")).otherwise(F.array(*[F.lit(0.0)] * size)))
    scored = scored.withColumn("domain", F.regexp_extract("host", r"([^.]+\.)?[^.]+$", 0))
    sums = [F.sum(F.col("p")[k]).alias(f"s{k}") for k in range(size)]
    arr = lambda name: F.array(*[F.col(f"s{k}") for k in range(size)]).alias(name)
    n = F.count("*").alias("n")
    by_host = scored.where("host is not null").groupBy("host").agg(n, *sums).select("host", "n", arr("host_sum"))
    by_domain = scored.where("host is not null").groupBy("domain").agg(n, *sums).select("domain", "n", arr("domain_sum"))
    by_declared = scored.where("declared is not null").groupBy("declared").agg(*sums).select("declared", arr("declared_sum"))
    by_suffix = scored.where("suffix is not null").groupBy("suffix").agg(n, *sums).select("suffix", "n", arr("suffix_sum"))
    whole = scored.agg(*[F.coalesce(s, F.lit(0.0)).alias(f"s{k}") for k, s in enumerate(sums)]).select(arr("whole"))
    total = scored.count()
    joined = scored.join(F.broadcast(by_declared), "declared", "left").crossJoin(F.broadcast(whole))  # declared: languages + 1 values; whole: one row
    for groups, by in ((by_host, "host"), (by_domain, "domain"), (by_suffix, "suffix")):
        joined = hot_join(joined, groups, by, "id", total)

    def cell(name: str, k: int) -> Column:
        return F.greatest(F.lit(0.0), F.coalesce(F.col(name)[k] - F.col("p")[k], F.lit(0.0)))

    def level(name: str, prior: list[Column], strength: float) -> list[Column]:
        total = sum((cell(name, k) for k in range(size)), F.lit(0.0))
        return [(cell(name, k) + strength * prior[k]) / (total + strength) for k in range(size)]

    n = sum((F.col("whole")[k] for k in range(size)), F.lit(0.0))
    root = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (F.col("whole")[i - 1] + 1) / (n + size))
    step = joined.withColumn("root", root)
    prior = level("domain_sum", [F.col("root")[k] for k in range(size)], DOMAIN_STRENGTH)
    step = step.withColumn("prior", F.array(*prior))
    prior = level("host_sum", [F.col("prior")[k] for k in range(size)], HOST_STRENGTH)
    step = step.withColumn("prior", F.array(*prior))

    def said(name: str, value: str, values: int) -> list[Column]:
        """log P(value | language), smoothed; 0 where nothing is said."""
        return [F.when(F.col(value).isNull(), F.lit(0.0)).otherwise(F.log((cell(name, k) + 1) / (F.col("whole")[k] + values))) for k in range(size)]

    a, b = said("declared_sum", "declared", size + 1), said("suffix_sum", "suffix", 50)
    text = F.when(F.col("letters") > 0, F.col("ll")).otherwise(F.array(*[F.lit(0.0)] * size))
    step = step.withColumn("text_ll", text)
    logs = F.array(*[F.col("text_ll")[k] + F.log(F.col("prior")[k]) + a[k] + b[k] for k in range(size)])
    step = step.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    total = F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    step = step.withColumn("posterior", F.round(1 / total, 6)).withColumn("at", F.array_position("logs", F.col("top")))
    names = F.array(*[F.lit(x) for x in langs])
    step = step.withColumn("rejected", (F.col("letters") == 0) | F.col("none") | F.coalesce(F.col("posterior") < least, F.lit(True)))
    return step.select(
        "id",
        F.when(~F.col("rejected"), F.element_at(names, F.col("at").cast("int"))).alias("language"),
        "posterior",
        F.when((F.col("letters") > 0) & ~F.col("none"), F.element_at(names, F.array_position("p", F.array_max("p")).cast("int"))).alias("text_language"),
        "rejected",
    )
