import zlib

import pytest

import corpus_pipeline
import numpy as np
from tests.llm import brute
from tests.llm.test_operators import corpus

from palisade.llm._tokenize import WordEncoder, tokenizer_path


def test_pipeline_against_brute_force(spark, tmp_path):
    texts = dict(corpus())
    items = {1: texts[20], 2: " ".join(texts[4].split()[:40])}
    spark.createDataFrame([(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "language_id":
            empty = {i for i, t in before.items() if not (t or "").strip()}
            assert set(after) <= set(before) - empty
        elif name == "minhash_near_dedup":
            assert set(after) == {i for i, (_, c) in brute.near_duplicates(before, 5).items() if i == c}
        elif name == "suffix_array_dedup":
            assert set(after) == set(before)
            for i, (n, gone, _, _) in brute.repeats(before).items():
                assert len(after[i].encode()) - (n - gone) in range(0, 200) and (gone or after[i] == before[i])
        else:
            assert set(after) == {i for i, v in brute.contamination(before, items).items() if not v[4]}
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    enc = WordEncoder(tokenizer_path())
    raw = {r.doc_id: enc.encode(r.text) + (1).to_bytes(4, "little") for r in docs.collect()}
    assert {r.doc_id for r in last} == set(raw) and sum(r.length for r in last) == sum(len(x) // 4 for x in raw.values())
    assert all(r.ids_crc32 == zlib.crc32(np.frombuffer(raw[r.doc_id], "<u4")[r.start : r.start + r.length].tobytes()) for r in last)
    bins = {}
    for r in last:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [0, *np.cumsum([n for _, n in sorted(b)])[:-1].tolist()] and sum(n for _, n in b) <= 4096


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, mark string, mark_ int, row_ string, gone_doc_id string, n_bytes string, blobs string, extra string, n_words string"


def _odd(spark):
    t = dict(corpus())
    rest = ("en", "s", 1, "m", 2, "r", "g", "b", "l", "e", "w")
    rows = [(0, t[0], *rest), (0, t[0], *rest), (0, t[5], *rest), (1, t[0], *rest), (1, t[6], *rest), (None, t[0], *rest), (None, t[0], *rest), (None, None, *rest), (2, None, *rest), (2, None, *rest), (3, "", None, None, *rest[2:]), (4, t[7], *rest), (5, "z" * 300_000, *rest)]
    return spark.createDataFrame(rows, CLASHING)


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:-1]], ids=lambda s: s[0])
def test_stages_on_odd_rows(spark, tmp_path, stage):
    name, work = stage
    spark.createDataFrame([(1, dict(corpus())[7]), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = _odd(spark)
    out = work(spark, docs, str(tmp_path))
    got = out.collect()
    assert out.columns == docs.columns and work(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert all(tuple(r)[5:] == ("m", 2, "r", "g", "b", "l", "e", "w") for r in got)
    rows = sorted(((r.doc_id, r.text) for r in got), key=str)
    before = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    if name == "language_id":  # by text alone: blank ones and junk go, whatever their id
        assert {(r.doc_id, r.text) for r in got} <= {x for x in before if x[1]} and len(rows) == sum(x in set(rows) for x in before)
    elif name == "minhash_near_dedup":  # 1's copy of 0 goes and its other text stays; of repeated rows one; rows without an id all
        t = dict(corpus())
        assert [x for x in rows if x[0] in (0, 1)] == sorted([(0, t[0]), (0, t[5]), (1, t[6])], key=str)
        assert [x for x in rows if x[0] is None] == [x for x in before if x[0] is None] and (2, None) in rows and len(rows) == 3 + 3 + 4
    elif name == "suffix_array_dedup":
        assert len(rows) == len(before) and (1, "") in rows and [x for x in rows if x[0] in (None, 0)] == [x for x in before if x[0] in (None, 0)]
    else:
        assert rows == [x for x in before if x[0] != 4]
