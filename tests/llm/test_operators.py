import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from palisade.llm import decontam, hpylm, langid, minhash, packing, pivots, suffix, tokenfile, toxicity, urltree
from palisade.llm._text import mix
from palisade.llm._tokenize import WordEncoder, tokenizer_path
from palisade.llm._work import new_folder
from palisade.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, print string, blobs string, n_words string, length int"


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus():
    """Copies, near copies, passages, ties, nulls, empty and long texts."""
    rng = random.Random(3)
    base = [_words(rng, 120) for _ in range(12)]
    passage = _words(rng, 30)
    texts = base + [base[0]] * 8 + [base[1] + " one more", base[1] + " one more word", base[2].upper(), _words(rng, 40) + " " + passage, passage + _words(rng, 20), "", None, "   ", "two words", "Two  Words", "aaaa" * 60, "aaaa" * 40, "x" * 49, "x" * 50, "x" * 51, _words(rng, 6000), passage]
    for k in range(12):  # a chain of edits
        w = base[3].split()
        w[k * 5] = "edit"
        texts.append(" ".join(w))
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "p", "b", "n", 1) for i, t in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *names):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *names).collect()}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100, 130)] + [(5, 5), (7, 9), (9, 7), (None, 4), (3, 2)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 131)}, 7: 7, 9: 7, 2: 2, 3: 2}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, nothing, k):
    got = rows(minhash.near_duplicates(docs, k), "n_shingles", "component_id", "kept")
    assert got == {i: (n, c, i == c) for i, (n, c) in brute.near_duplicates(dict(corpus()), k).items()}
    assert minhash.near_duplicates(nothing).count() == 0
    twice = docs.where("doc_id in (0, 1)").union(docs.where("doc_id = 1")).union(docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(minhash.near_duplicates(twice, k).select("doc_id", "component_id").collect(), key=str) == [(0, 0), (1, 1), (1, 1), (None, None)]


def test_repeats(docs, nothing):
    out = suffix.remove_repeats(docs, 50)
    assert rows(out, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(dict(corpus()))
    left = rows(suffix.remove_repeats(docs, 50, keep_text=True), "text", "n_removed", "print")
    assert left[12] == ("", left[12][1], "p") and left[0][0] == corpus()[0][1]
    assert suffix.remove_repeats(nothing).count() == 0
    same = docs.where("doc_id in (0, 1)").withColumn("doc_id", F.lit(None).cast("long"))
    assert {r.n_removed for r in suffix.remove_repeats(same.union(same)).collect()} == {0}


def test_refinement():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    pointer = suffix.refine(text, 50)
    raw = text.tobytes()
    seen = {}
    for p in range(len(text) - 50):
        assert seen.setdefault(raw[p : p + 50], pointer[p]) == pointer[p]
    assert len(set(seen.values())) == len(seen)
    order = np.argsort([pointer[p] for p in range(len(text) - 50)], kind="stable")
    keys = [raw[p : p + 50] for p in order]
    assert keys == sorted(keys)


def test_contamination(spark, docs, nothing):
    t = dict(corpus())
    items = {1: " ".join(t[4].split()[10:40]), 2: "Two, words!", 3: "", 4: None, 5: t[23], 6: "nowhere to be found " * 5, 7: "aaaa" * 60}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute.contamination(t, items)
    assert rows(decontam.find_contamination(docs, bench), *names) == want
    small, decontam.PASS_BYTES = decontam.PASS_BYTES, 10
    try:
        assert rows(decontam.find_contamination(docs, bench, keep=True), *names) == want
    finally:
        decontam.PASS_BYTES = small
    twice = decontam.find_contamination(docs.union(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))).union(docs.where("doc_id = 4")), bench)
    assert sorted((str(r.doc_id), r.n_hit) for r in twice.where("doc_id is null or doc_id = 4").collect()) == [("4", want[4][1]), ("4", want[4][1]), ("None", want[4][1])]
    assert decontam.find_contamination(nothing, bench).count() == 0
    assert not any(r.n_hit for r in decontam.find_contamination(docs, bench.limit(0)).collect())


def test_encoder_is_the_library():
    enc = WordEncoder(tokenizer_path())
    rng = random.Random(5)
    odd = ["", "a  b\n\nc\t d", "don't stop's.", "É. é, ﬁ. ½", "İstanbul. ΣΑΣ.", "<|endoftext|> x<|endoftext|>.", "\x1c \x85 　a​.", "x" * 500, "a̸. ≠"] + ["".join(rng.choice("aéÉ.,'s½1 \n\t̸́<|>$日Σ") for _ in range(40)) for _ in range(300)]
    for t in odd + [t for _, t in corpus() if t]:
        assert enc.encode(t) == np.array(enc.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def _ids(enc, t):
    return enc.encode(t) + (1).to_bytes(4, "little")


def test_token_files(spark, docs, nothing):
    folder, enc, at = new_folder(spark, "t"), WordEncoder(tokenizer_path()), 0
    manifest = tokenfile.write_token_files(docs, folder, tokenizer_path())
    got = rows(tokenfile.read_token_files(spark, folder), "start", "n_tokens", "ids_crc32")
    for i, t in corpus():
        raw = _ids(enc, t)
        assert got[i] == (at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    assert manifest["n_ids"] == at
    import pyarrow.fs as pafs

    fs, root = pafs.FileSystem.from_uri(folder)
    dictionary = fs.open_input_file(f"{root}/dictionary.zdict").read()
    found = [tokenfile.ShardReader(fs, f"{root}/{s['shard']}", dictionary).find(7) for s in manifest["shards"]]
    assert [x.tobytes() for x in found if x is not None] == [_ids(enc, dict(corpus())[7])]
    with pytest.raises(ValueError):
        tokenfile.ShardReader(fs, f"{root}/{manifest['shards'][0]['shard']}", dictionary + b"x")
    empty = new_folder(spark, "t")
    tokenfile.write_token_files(nothing, empty, tokenizer_path())
    assert tokenfile.read_token_files(spark, empty).count() == 0


def test_packing(docs, nothing):
    enc, most = WordEncoder(tokenizer_path()), 256
    out = packing.pack_documents(docs, tokenizer_path(), packing.Capacity(tokens=most), keep_ids=True)
    got = out.collect()
    for i, t in corpus():
        raw = np.frombuffer(_ids(enc, t), "<u4").tolist()
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [x for r in mine for x in r.ids] == raw and [r.start for r in mine] == list(range(0, len(raw), most))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= most
    assert len(bins) <= 1.08 * sum(r.length for r in got) / most + 1
    assert packing.sequences(out).count() == len(bins)
    assert packing.pack_documents(nothing, tokenizer_path()).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_packing_constraints(score):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 3000)
    cap = packing.Capacity(tokens=256, documents=4, attention=20000)
    histogram = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
    plan = packing.best_fit(histogram, cap, score=score)
    length = np.repeat(list(histogram), list(histogram.values()))
    rank = np.concatenate([np.arange(c) for c in histogram.values()])
    seq, offset = plan.place(length, rank)
    for b in np.unique(seq):
        n = length[seq == b][np.argsort(offset[seq == b])]
        assert n.sum() <= 256 and len(n) <= 4 and (n * n).sum() <= 20000 and sorted(offset[seq == b]) == [0, *np.cumsum(n)[:-1]]


def test_language_model(spark, nothing):
    rng = random.Random(1)
    phrases = ["the cat sat on a mat", "a dog ran to the park", "the end of a day", "on to the cat"]
    texts = [" ".join(rng.choice([*phrases, f"w{rng.randint(0, 40)}"]) for _ in range(15)) for _ in range(120)] + ["", None, "zzz unknown"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in hpylm.score_texts(d).collect()}
    train = [i for i in got if zlib.crc32(str(i).encode()) % 7 != 2]
    toks = lambda t: [*(t or "").split(), None]
    counts = {}
    for i in train:
        for w in toks(texts[i]):
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, r in got.items():
        assert r.held_out == (i not in train) and r.train_tokens == n and r.n_tokens == len(toks(texts[i])) and r.n_known == sum(w in counts for w in toks(texts[i]))
        assert abs(r.base_score - sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in toks(texts[i]))) < 1e-6
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hpylm.score_texts(nothing).count() == 0


def test_language_model_sums_to_one(spark):
    # texts of one word each, so nearly all probability is on texts of at most three tokens; every unknown word has that of the class of all
    words_, rng = ["a", "b", "c"], random.Random(4)
    train = [rng.choice(["a", "a", "a", "b", "c"]) for _ in range(300)]
    every = [()] + [(x,) for x in (*words_, "?")] + [(x, y) for x in (*words_, "?") for y in (*words_, "?")] + [(x, y, z) for x in (*words_, "?") for y in (*words_, "?") for z in (*words_, "?")]
    rows_ = [(i, t, True) for i, t in enumerate(train)] + [(1000 + i, " ".join(t), False) for i, t in enumerate(every)]
    out = hpylm.score_texts(spark.createDataFrame(rows_, "doc_id long, text string, train boolean"), F.col("train")).where("doc_id >= 1000").collect()
    p = {every[r.doc_id - 1000]: 10**r.score for r in out}
    assert 0.995 < sum(p.values()) <= 1 + 1e-9  # the rest is on longer texts
    assert abs(p[("a",)] - train.count("a") / 300) < 0.02 and p[("?",)] < p[("c",)] < p[("a",)]


def test_language_model_does_not_depend_on_partitions(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["the", "the", "of", f"w{int(rng.expovariate(0.1))}"]) for _ in range(60)) for _ in range(150)]
    d = spark.createDataFrame([(i if i else None, t) for i, t in enumerate([*texts, texts[3], ""])], "doc_id long, text string")
    extra = d.withColumn("train", F.lit("x")).withColumn("word", F.lit(1)).withColumn("part", F.lit("y"))
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, table in ((4, d), (7, extra.repartition(5)), (51, d.union(d.limit(0)).repartition(2))):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            seen.append({(r.doc_id, r.n_tokens, round(r.base_score, 6)): r.score for r in hpylm.score_texts(table).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0].keys() == seen[1].keys() == seen[2].keys() and len(seen[0]) > 140
    assert all(abs(x[k] - seen[0][k]) < 1e-9 for x in seen[1:] for k in x)


def test_seating():
    # the conditional of the number of tables, by plain sums, and no jump where more customers are looked up otherwise
    keys = mix(np.arange(1, 20001, dtype=np.uint64))
    draw = lambda c, parent=0.2: hpylm.draw_tables(np.full(len(keys), c), np.full(len(keys), 5.0), np.full(len(keys), parent), 0.5, 2.0, keys, 1)
    for c in (2, 7, 24, 25, 60):
        s = np.exp(hpylm.log_stirling(0.5, c) - hpylm.log_stirling(0.5, c)[c].max())[c, 1:]
        w = s * np.cumprod(0.2 * (2.0 + 0.5 * (4 + np.arange(c))))
        assert abs(draw(c).mean() - (w * np.arange(1, c + 1)).sum() / w.sum()) < 0.05
    means = [draw(c).mean() for c in (1000, 1024, 1056, 1200, 20000, 10**7)]
    assert all(abs(a - b) < 0.1 for a, b in zip(means, means[1:3])) and means == sorted(means)
    wide = draw(4000, 0.95)
    assert 30 < wide.max() <= 512 and len(np.unique(wide)) > 5
    assert (draw(100)[:9] == hpylm.draw_tables(np.full(9, 100), np.full(9, 5.0), np.full(9, 0.2), 0.5, 2.0, keys[:9], 1)).all()
    far = hpylm.log_stirling(0.5, 1500)[1500, 1:200]
    near = hpylm.stirling_rows(np.array([1500]), 0.5, 199)[0]
    assert np.abs((near - near[0]) - (far - far[0])).max() < 0.3  # of numbers that span hundreds


def test_seating_of_few_customers():
    # each draw is the inverse of its own conditional's sums, also where that takes none but one or all tables
    keys, rng = mix(np.arange(1, 401, dtype=np.uint64)), np.random.default_rng(2)
    c, others, parent = rng.integers(0, 25, 400), rng.integers(0, 10**5, 400) * rng.integers(0, 2, 400), 10.0 ** -rng.uniform(0, 300, 400) ** rng.uniform(0, 1, 400)
    drawn = hpylm.draw_tables(c, others + 1.0, parent, 0.6, 3.0, keys, 2)
    log_s, u = hpylm.log_stirling(0.6, 24), hpylm._uniform(keys, 2)
    for k in range(400):
        t = np.arange(c[k])
        w = log_s[c[k], 1 : c[k] + 1] + np.cumsum(np.log(3.0 + 0.6 * (others[k] + t))) + (t + 1) * np.log(parent[k])
        p = np.exp(w - w.max(initial=-np.inf)).cumsum()
        assert drawn[k] == (1 + (p < u[k] * p[-1]).sum() if c[k] else 0)
    assert (drawn == c)[c > 5].any() and (drawn == 1)[c > 5].any()


def test_seating_over_all_tables():
    # dishes that want more than 512 tables, of numbers of customers below and beyond those of the recursion
    keys = mix(np.arange(1, 2001, dtype=np.uint64))
    for c in (900, 2500):
        s = hpylm.log_stirling(0.7, c)[c, 1:]
        got = hpylm.stirling_rows(np.array([c]), 0.7, c)[0]
        assert np.abs((got - got[0]) - (s - s[0])).max() < 0.01
        t = np.arange(1, c + 1)
        w = s + np.cumsum(np.log(0.9 * (2000 + 0.7 * (t - 1))))
        p = np.exp(w - w.max())
        drawn = hpylm.draw_tables(np.full(2000, c), np.full(2000, 1.0), np.full(2000, 0.9), 0.7, 2000.0, keys, 1)
        assert abs(drawn.mean() - (p * t).sum() / p.sum()) < 2 and drawn.min() > 512
    assert hpylm.draw_tables(np.full(9, 10**6), np.full(9, 1.0), np.full(9, 0.5), 0.8, 3000.0, keys[:9], 1).min() > 512


def test_language_model_keeps_tokens_once(spark, monkeypatch, tmp_path):
    # no token and no table goes through a shuffle, files go with the score, and a task gives the driver one row
    rng = random.Random(5)
    d = spark.createDataFrame([(i, " ".join(f"w{int(rng.expovariate(0.01))}" for _ in range(50))) for i in range(200)], "doc_id long, text string")
    monkeypatch.setattr(hpylm, "new_folder", lambda _, name: f"file://{tmp_path}/{name}-{rng.random()}")
    out = hpylm.score_texts(d)
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == {"tables", "scored"}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 200
    work = lambda k: [("held1", np.arange(300), np.ones(300), np.full(300, k)), ("size", [0], [1], [k])]
    got = hpylm._each(spark, 40, work)
    assert (got["held1"][1] == 40).all() and (got["held1"][2] == 780).all() and got["size"][2][0] == 780 and len(got["held1"][0]) == 300


def test_language_model_gathers_the_whole_corpus_by_a_shuffle(spark, monkeypatch):
    # what Spark moves follows the corpus; tokens lie in the shuffle alone, and it goes with the score; the same scores from many flushes
    from palisade.llm import _work

    rng = random.Random(6)
    d = spark.createDataFrame([(i, " ".join(f"w{rng.getrandbits(40)} the" for _ in range(50))) for i in range(800)], "doc_id long, text string")
    sc, folders, cleaned = spark.sparkContext, [], []
    monkeypatch.setattr(hpylm, "new_folder", lambda s, name: folders.append(name) or _work.new_folder(s, name))
    monkeypatch.setattr(hpylm, "collect_garbage", lambda s: cleaned.append(s))

    def sent():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    moved, seen, at = [], [], sent()
    for docs in (d.where("doc_id < 200"), d):
        seen.append({r.doc_id: r.score for r in hpylm.score_texts(docs).collect()})
        moved.append(sent() - at)
        at += moved[-1]
    assert moved[1] > 3 * moved[0] and moved[1] > 800 * 50 * 8 and "dealt" not in folders and len(cleaned) == 2
    monkeypatch.setattr(hpylm, "FLUSH", 3000)
    monkeypatch.setattr(hpylm, "SENT", 1000)
    many = {r.doc_id: r.score for r in hpylm.score_texts(d).collect()}
    assert many.keys() == seen[1].keys() and len(many) == 800 and all(abs(many[k] - seen[1][k]) < 1e-9 for k in many)


def test_language_model_finds_out_tokens_dealt_anew(spark):
    # parts that saw other flushes, or others than those of the pass before, do not go together
    work = lambda part, names, blobs: [("size", [0], [len(names)], [part])]
    given = [(part, name, b"x") for part in range(4) for name in ("b", "a")] + [(9, None, None)]
    each = lambda rows_, n, known=None: hpylm._each_part(spark, spark.sparkContext.parallelize(rows_, 1), n, work, known)
    assert [x.tolist() for x in each(given[:-1], 4, ["a", "b"])["size"]] == [[0], [8], [6]]
    for rows_, n, known in ((given, 5, None), (given[:-1], 5, None), (given[:-1], 4, ["a", "c"])):
        with pytest.raises(RuntimeError, match="dealt again"):
            each(rows_, n, known)


def test_language_model_keeps_contexts_apart(spark):
    # followers that the last word alone does not tell, but the last two do; and many last words that end alike
    n = 1500
    texts = [f"p{i}k mid q{i}" for i in range(n)] * 3
    probes = [f"p{i}k mid q{j}" for i in range(0, n, 50) for j in (i, (i + 7) % n)]
    rows_ = [(i, t, True) for i, t in enumerate(texts)] + [(100000 + i, t, False) for i, t in enumerate(probes)]
    d = spark.createDataFrame(rows_, "doc_id long, text string, train boolean")
    got = {r.doc_id: r.score for r in hpylm.score_texts(d, F.col("train")).where("doc_id >= 100000").collect()}
    assert min(got[100000 + i] - got[100001 + i] for i in range(0, len(probes), 2)) > 1


def test_stirling():
    s = np.exp(hpylm.log_stirling(0.5, 4))
    assert np.allclose(s[3, 1:4], [0.75, 1.5, 1.0])  # (1-d)(2-d), 3(1-d), 1


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    vec = [v + rng.normal(size=16) * s for v in base for s in (0, 0, 0.08, 0.12, 0.2)]
    rows_ = [(i, [float(x) for x in v.astype(np.float32)], i // 150) for i, v in enumerate(vec)]
    rows_ += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [], 0), (904, [None] * 16, 0), (905, [1.0] * 16, None), (906, [1.0] * 8, 0), (907, [2.0] * 8, 0)]
    got = {r.vec_id: r for r in pivots.near_vectors(spark.createDataFrame(rows_, "vec_id long, embedding array<float>, label int")).collect()}
    good = {i: (np.array(v, float), label) for i, v, label in rows_ if v and None not in v and np.isfinite(v).all() and any(v) and label is not None}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.sqrt((good[a][0] @ good[a][0]) * (good[b][0] @ good[b][0])) >= 0.93]
    comp, n = brute.smallest_reachable([r[0] for r in rows_], links), {}
    for a, b in links:
        n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    found = sum(r.n_links for r in got.values()) / 2
    assert len(got) == len(rows_) and found <= len(links) and found >= 0.95 * len(links)
    assert all(got[i].n_links <= n.get(i, 0) for i in got) and sum(got[i].component_id == comp[i] for i in got) >= 0.95 * len(got)
    assert pivots.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_toxicity(spark, nothing):
    rng = random.Random(2)
    data = []
    for i in range(600):  # toxic only together
        insult, group = i % 2, (i // 2) % 2
        data.append((i, f"{_words(rng, 12)} {'scumword' if insult else ''} {'groupword' if group else ''}", int(insult and group)))
    d = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    m = toxicity.train(d, d.where(~toxicity.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, m).collect()}
    held = [i for i, _, _ in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == data[i][2] for i in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "scumword")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(odd, m).collect())
    assert toxicity.score_toxicity(nothing, toxicity.train(nothing, d.limit(0))).count() == 0


def test_toxicity_of_pairs():
    # the group word is as frequent in clean texts as in toxic ones, and toxic only beside the insult, which is harmless alone
    rng, docs, y, kind = np.random.default_rng(6), [], [], []
    for _ in range(6000):
        insult, slur, group = (rng.random(3) < (0.12, 0.06, 0.5)).tolist()
        group = group and not slur
        toxic = slur or (insult and group)
        insult = insult and not slur
        docs.append(np.unique(np.concatenate([rng.integers(1000, 1400, 20), np.flatnonzero([insult, slur, group])])).astype(np.int32))
        y.append(int(toxic))
        kind.append((insult, slur, group))
    y = np.array(y)
    clean, toxic = (np.mean([k[2] for k, t in zip(kind, y) if t == v]) for v in (0, 1))
    m = toxicity.fit(docs[:4000], y[:4000])
    score = m.score(np.concatenate(docs[4000:]).astype(np.int64), np.array([len(d) for d in docs[4000:]]), m.lookup())
    of = {k: score[[i for i, x in enumerate(kind[4000:]) if x == k]] for k in ((True, False, True), (True, False, False))}
    assert abs(clean - toxic) < 0.08
    assert (of[True, False, True] >= 0.3).mean() > 0.9 and (of[True, False, False] >= 0.3).mean() < 0.1


def test_language(spark, nothing):
    en, de = "the cat and the dog were with them", "der hund und die katze sind nicht hier"
    train = spark.createDataFrame([(i, (en, de)[i % 2] + f" {i}", ("en", "de")[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    m = langid.train(train)
    rows_ = [(1, en, "a.com", "en", "com"), (2, de, "b.de", None, "de"), (3, "", "b.de", "de", "de"), (4, None, None, None, None), (5, "der the", "b.de", "de", "de"), (6, "***", "a.com", "xx", None)] + [(i, de, "b.de", "de", "de") for i in range(10, 40)]
    d = spark.createDataFrame(rows_, "id long, text string, host string, declared string, suffix string")
    got = {r.id: r for r in langid.identify(d, m).collect()}
    assert (got[1].language, got[2].language, got[5].language) == ("en", "de", "de") and got[3].rejected and got[4].rejected and got[6].rejected
    assert langid.identify(d.limit(0), m).count() == 0


def test_urls(spark):
    urls = {
        1: ("http://x.Example.NET/fr/1", "net/", "block"), 2: ("https://example.net/en/2?x", "example.net/en/", "allow"), 3: ("http://a.example.com/de/3#t", "example.com/de/", "block"),
        4: ("http://b.org/fr/9", "org/fr/", "allow"), 5: ("http://notexample.com/de/x", None, None), 6: (None, None, None), 7: ("no scheme", None, None), 8: ("http://x.net", None, None), 9: ("http://x.net/", "net/", "block"), 10: ("http://q.com?a://b/c", None, None),
    }
    data = [(i, u[0]) for i, u in urls.items()] + [(100 + i, f"http://s{i % 3}.example.com/de/{i}") for i in range(60)] + [(300 + i, f"http://s{i % 3}.example.org/fr/{i}") for i in range(60)] + [(500, "http://new.example.io/de/5"), (501, "http://new.example.io/fr/5")]
    got = {r.page_id: r for r in urltree.judge_urls(spark.createDataFrame(data, "page_id long, url string")).collect()}
    assert len(got) == len(data)
    for i, (url, rule, verdict) in urls.items():
        assert got[i].rule == rule and (verdict is None or got[i].verdict == verdict) and got[i].verdict in ("allow", "block")
    assert (got[6].host, got[6].path, got[10].host, got[10].path, got[3].path) == ("", "", "q.com", "", "/de/3")
    assert got[500].verdict == "block" and got[501].verdict == "allow" and got[500].template == "/de/?number"
    assert urltree.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def _url_templates(pages, rules):
    """Plain tree: (host, path) -> template."""
    import re
    from collections import defaultdict

    def typed(x):
        for rx, mark in ((r"[0-9]+", "?number"), (r"[0-9]{4}-[0-9]{2}(-[0-9]{2})?", "?date"), (r"[0-9A-Fa-f-]{16,}", "?hash")):
            if re.fullmatch(rx, x):
                return mark
        if m := re.fullmatch(r"[0-9]+\.([A-Za-z]{2,5})", x):
            return "?number." + m[1]
        return "?slug" if re.search("[0-9]{3,}", x) or len(x) > 40 else x

    def label(host, path):
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit, key=lambda r: len(r.name)).verdict if fit else None

    count = defaultdict(lambda: [0, 0, 0])
    for host, path in pages:
        c, v = count[host, tuple(typed(x) for x in path.split("/") if x)], label(host, path)
        c[0] += 1
        c[1] += v is not None
        c[2] += v == "block"
    template = {}

    def alike(k1, n1, k2, n2):
        p = (k1 + k2) / (n1 + n2)
        return (k1 / n1 - k2 / n2) ** 2 <= 3.84 * p * (1 - p) * (1 / n1 + 1 / n2)

    def grow(host, prefix, shapes, level):
        open_ = [s for s in shapes if len(s) > level] if len(shapes) > 2 else []
        for s in shapes:
            if s not in open_:
                template[host, s] = prefix + "".join("/" + x for x in s[level:])
        kids = defaultdict(list)
        for s in open_:
            kids[s[level]].append(s)
        if not kids:
            return
        total = {x: [sum(count[host, s][k] for s in v) for k in range(3)] for x, v in kids.items()}
        pages_here = sorted(t[0] for t in total.values())
        varies = len(kids) > 12 and pages_here[(len(kids) + 1) // 2 - 1] < 3
        name, steps = {}, defaultdict(lambda: defaultdict(list))
        for x, (n, lab, b) in total.items():
            name[x] = "?any" if varies and x[0] != "?" and n * 12 <= sum(pages_here) else x
            if name[x] == x and x[0] != "?" and lab >= 5:
                goes_on = ",".join(sorted({"" if len(s) <= level + 1 else s[level + 1] if s[level + 1][0] == "?" else "word" for s in kids[x]}))
                steps[goes_on][int(64 * b / lab + 0.5)].append(x)
        for by in steps.values():
            bands, before = [], None
            for step in sorted(by):
                mine = [sum(total[x][2] for x in by[step]), sum(total[x][1] for x in by[step])]
                if before and alike(*mine, *before):
                    bands[-1].extend(by[step])
                else:
                    bands.append(list(by[step]))
                before = mine
            for band in bands:
                if len(band) > 1:
                    share = 100 * sum(total[x][2] for x in band) / sum(total[x][1] for x in band)
                    name.update({x: f"?like{int(share + 0.5)}" for x in band})
        below = defaultdict(list)
        for x, v in kids.items():
            below[prefix + "/" + name[x]] += v
        for p, v in below.items():
            grow(host, p, v, level + 1)

    for host in {h for h, _ in count}:
        grow(host, "", [s for h, s in count if h == host], 0)
    return {(host, path): template[host, tuple(typed(x) for x in path.split("/") if x)] for host, path in pages}


@pytest.mark.parametrize("names", [("de", "fr", "es", "en"), ("allem", "frank", "spani", "engli")])
def test_urls_against_a_plain_tree(spark, names):
    rng = random.Random(9)
    rules = (urltree.Rule("block", "a.com"), urltree.Rule("allow", "a.com", f"/{names[3]}/"), urltree.Rule("block", "b.com", f"/{names[0]}/x/"), urltree.Rule("allow", "b.com", "/t/"))
    paths = [(rng.choice(("a.com", "w.a.com", "b.com", "c.com")), "/" + "/".join([rng.choice((*names, "t")), *rng.choice((["x", f"{rng.randint(0, 400)}"], ["y", f"u{rng.randint(0, 90)}q"], [f"2024-0{rng.randint(1, 9)}"], ["{number}"], [])), *(["z"] * rng.randint(0, 2))])) for _ in range(3000)]
    paths += [("a.com", ""), ("c.com", "/")]
    want = _url_templates(paths, rules)
    got = urltree.judge_urls(spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(paths)], "page_id long, url string"), rules).collect()
    assert len(got) == len(paths) and {(r.host, r.path): r.template for r in got} == want
    marks = {w.strip("?0123456789") for t in want.values() for w in t.split("/") if w.startswith("?")}
    assert {"any", "like", "number", "date"} <= marks and any("/{number}" in t for t in want.values())


def test_urls_deep_paths(spark):
    rules = (urltree.Rule("block", "example.com", "/a/b/c/d/spam/"), urltree.Rule("allow", "example.com", "/a/b/c/d/news/"))
    data = [(100 * k + i, f"http://{host}/a/b/c/d/{kind}/e{i % 5}/f/g/{i}") for k, (host, kind) in enumerate((h, s) for h in ("example.com", "z.io") for s in ("spam", "news")) for i in range(60)]
    got = urltree.judge_urls(spark.createDataFrame(data, "page_id long, url string"), rules).where("host = 'z.io'").collect()
    assert len(got) == 120 and all(r.verdict == ("block" if "/spam/" in r.path else "allow") for r in got)


def test_language_of_none(spark):
    en, de = "the cat and the dog were with them in the house", "der hund und die katze sind nicht hier im haus"
    train = spark.createDataFrame([(i, (en, de)[i % 2], ("en", "de")[i % 2]) for i in range(400)], "doc_id long, text string, lang string")
    rng = random.Random(8)
    none = ["Собака и кошка живут в старом доме у реки", "Pies i kot mieszkają w starym domu nad rzeką"] + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (60, 300, 1000)]
    texts = none + ["the cat and the dog", "der hund und die katze", "in the house", "nicht hier"]
    d = spark.createDataFrame([(i, t, "a.com", None, None) for i, t in enumerate(texts)], "id long, text string, host string, declared string, suffix string")
    got = {r.id: (r.language, r.rejected) for r in langid.identify(d, langid.train(train)).collect()}
    assert [got[i] for i in range(len(texts))] == [(None, True)] * len(none) + [("en", False), ("de", False)] * 2


def test_declared_language_and_visible_text(spark):
    pages = {
        '<html lang="EN-us"><body>one <b>two</b></body></html>': ("en", ["one", "two"]), "<HTML dir=ltr lang=de>drei<script>x = '<p>'</script> vier": ("de", ["drei", "vier"]),
        "<p lang='fr'>un</p>": (None, ["un"]), "<html><style type=a>b{}</style>plain": (None, ["plain"]), "": (None, []), None: (None, None),
    }
    got = spark.createDataFrame([(k,) for k in pages], "h string").select("h", langid.declared_language(F.col("h")).alias("d"), langid.visible_text(F.col("h")).alias("v")).collect()
    assert {r.h: (r.d, None if r.v is None else r.v.split()) for r in got} == pages


def test_language_against_plain_sums(spark):
    import math

    import pyarrow as pa

    en, de = "the cat and the dog were with them in the house", "der hund und die katze sind nicht hier im haus"
    train = spark.createDataFrame([(i, (en, de)[i % 2], ("en", "de")[i % 2]) for i in range(200)], "doc_id long, text string, lang string")
    m = langid.train(train)
    rng = random.Random(12)
    rows_ = [(i, rng.choice([en, de, "the der", "in im", "", None, "cat katze"]), rng.choice(["a.x.com", "b.x.com", "c.de", None]), rng.choice(["en", "de", "fr", None]), rng.choice(["com", "de", None])) for i in range(80)]
    rows_.append(rows_[5])
    got = sorted((r.id, r.language, r.posterior, r.rejected) for r in langid.identify(spark.createDataFrame(rows_, "id long, text string, host string, declared string, suffix string"), m).collect())
    ll, letters, grams = m.log_likelihood(pa.array([r[1] for r in rows_], pa.string()))
    fits = [n > 0 and x.max() >= -g * math.log(langid.GRAM_BUCKETS) for x, n, g in zip(ll, letters, grams)]
    ll = langid.TEMPER * (ll - ll.max(axis=1, keepdims=True))
    p = np.exp(ll) / np.exp(ll).sum(axis=1, keepdims=True) * np.array(fits)[:, None]
    size = len(m.languages)
    known = [d if d is None or d in m.languages else "other" for d in (r[3] for r in rows_)]
    domain = [None if r[2] is None else ".".join(r[2].split(".")[-2:]) for r in rows_]
    others = lambda i, of: sum((p[j] for j in range(len(rows_)) if of[i] is not None and of[j] == of[i]), np.zeros(size)) - (p[i] if of[i] is not None else 0)
    want, whole = [], p.sum(axis=0)
    for i, r in enumerate(rows_):
        prior = (whole + 1) / (whole.sum() + size)
        for of, strength in ((domain, langid.DOMAIN_STRENGTH), ([x[2] for x in rows_], langid.HOST_STRENGTH)):
            s = np.maximum(others(i, of), 0)
            prior = (s + strength * prior) / (s.sum() + strength)
        logs = (ll[i] if letters[i] else np.zeros(size)) + np.log(prior)
        for of, values in ((known, size + 1), ([x[4] for x in rows_], 50)):
            if of[i] is not None:
                logs = logs + np.log((np.maximum(others(i, of), 0) + 1) / (whole + values))
        best = 1 / np.exp(logs - logs.max()).sum()
        bad = not fits[i] or best < langid.LEAST
        want.append((r[0], None if bad else m.languages[int(logs.argmax())], best, bad))
    for a, b in zip(got, sorted(want)):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5 and a[3] == b[3]


def test_vectors_with_repeated_ids(spark):
    one, two = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6
    rows_ = [(1, one, 0, "x"), (1, two, 0, "x"), (2, one, 0, "x"), (3, two, 0, "x"), (3, two, 0, "x"), (None, one, 0, "x"), (4, one, 1, "x"), (5, [2.0] + [0.0] * 7, 0, "x")]
    d = spark.createDataFrame(rows_, "vec_id long, embedding array<double>, label int, digest string").withColumn("near", F.lit(1)).withColumn("id", F.lit("i"))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivots.near_vectors(d).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (3, 2, 1, False), (None, 0, None, True), (4, 0, 4, True), (5, 2, 1, False)], key=str)


def test_toxicity_score_is_the_formula():
    rng = np.random.default_rng(3)
    known = np.array([3, 9, 20, 70])
    m = toxicity.FactorizationMachine(-0.5, known, rng.normal(size=4), rng.normal(size=(4, 3)))
    docs = [np.array([3, 9, 70, 500]), np.array([], int), np.array([20])]
    got = m.score(np.concatenate(docs).astype(np.int64), np.array([len(x) for x in docs]), m.lookup())
    for d, s in zip(docs, got):
        at = [int(np.flatnonzero(known == x)[0]) for x in d if x in known]
        z = -0.5 + sum(m.weight[i] for i in at) + sum(m.factor[i] @ m.factor[j] for a, i in enumerate(at) for j in at[a + 1 :])
        assert abs(s - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_of_exclusive_terms(spark):
    # toxic with either word, not with both: neither tells anything alone
    rng = random.Random(7)
    data = [(i, f"{_words(rng, 8)} {'firstword' if i % 2 else ''} {'otherword' if (i // 2) % 2 else ''}", (i % 2) ^ ((i // 2) % 2)) for i in range(2000)]
    d = spark.createDataFrame(data + [(0, "x y", 1)], "doc_id long, text string, toxic int").withColumn("score", F.lit("s")).withColumn("idx", F.lit(1))
    m = toxicity.train(d, d.where(~toxicity.held_out(F.col("doc_id"))))
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(d, m).where("doc_id != 0").collect()}
    held = [i for i, _, _ in data if i and zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i] == data[i][2] for i in held) >= 0.95 * len(held)
