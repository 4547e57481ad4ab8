"""Each corpus operator against a plain version that looks at everything."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from relfeat.llm import attention, common, decontaminate, graph, jaccard, line_dedup, lm_score, mixing, substring_dedup, token_files, topk, toxicity, url_filter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def same(frame, expected) -> None:
    assert sorted(map(repr, (tuple(r) for r in frame.collect()))) == sorted(map(repr, expected))


# Lines


def test_line_dedup(spark, corpus, plain, nothing):
    strip = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc, text, _ in plain:
        for line in text.split("\n"):
            if len(strip(line)) >= 20:
                holders[strip(line)].add(doc)
    least = lambda d: -math.inf if d is None else d
    keeper = {k: max(v, key=least) for k, v in holders.items() if len(v) >= 3}
    assert keeper
    expected = []
    for doc, text, _ in plain:
        lines = text.split("\n")
        kept = [x for x in lines if strip(x) not in keeper or keeper[strip(x)] == doc]
        expected.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    same(line_dedup.op1_line_dedup(spark, corpus), expected)
    assert line_dedup.op1_line_dedup(spark, nothing).count() == 0


def test_line_dedup_of_a_line_in_all_documents(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x\nthe line that is everywhere\nthe line that is everywhere").alias("text"))
    got = line_dedup.dedup_lines(docs, spark)
    assert [r["doc_id"] for r in got.where("n_dropped = 0").collect()] == [2999] and got.where("n_dropped = 2 and kept_text = 'x'").count() == 2999


def test_line_dedup_runs_no_python(spark, corpus):
    text = line_dedup.op1_line_dedup(spark, corpus)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", text)


# Mixing


def test_mix(spark, corpus, plain, nothing):
    got = [r.asDict() for r in mixing.mix_sources(corpus, spark).collect()]
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((d, len(SPACE.findall(t)), s) for d, t, s in plain)
    sizes = Counter()
    for _, t, s in plain:
        sizes[s] += len(SPACE.findall(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = dict(zip(order, mixing.targets([sizes[s] for s in order], [[3, 1, 2][i % 3] for i in range(len(order))]), strict=True))
    for s in order:
        rows = [r for r in got if r["source"] == s]
        assert {(r["source_size"], r["target"]) for r in rows} == {(sizes[s], goals[s])}
        assert sum(r["taken"] for r in rows) == pytest.approx(goals[s], rel=0.002, abs=1)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    again = mixing.mix_sources(corpus.repartition(3), spark).collect()
    assert Counter(tuple(r) for r in again) == Counter(tuple(r.values()) for r in got)
    assert mixing.op2_mixing(spark, nothing).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    same(mixing.op2_mixing(spark, blank), [(1, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)])


def test_mix_of_small_and_large_sources(spark):
    """A source of three words gives them twice beside one of a million."""
    rows = [(i, "w " * 1000, "large") for i in range(1000)] + [(2000, "x y", "tiny"), (2001, "z", "tiny"), (2002, "v " * 40, "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, spark).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert {r["source"] for r in got} == {"large", "small", "tiny"}
    for r in got:
        assert r["taken"] == pytest.approx(r["target"], rel=0.001, abs=1), r
    plan = mixing.plan_mix(docs, spark).where("slot is not null")
    assert plan.where("source = 'tiny'").agg(F.sum("words")).first()[0] == 6
    # Wherever one looks in the mix, sources stand in their proportions.
    part = plan.where("slot between 1000 and 1999").groupBy("source").count().collect()
    assert len([r for r in part if r["source"] == "large"]) == 1


def test_targets_share_what_full_sources_cannot_take():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == [200.0, 250 / 3, 500 / 3]
    got = mixing.targets([10, 1000, 10, 0], [3, 1, 2, 3])
    assert got == [20.0, 1490.0, 20.0, 0.0] and sum(got) == 1.5 * 1020
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 2]) == [0.0, 0.0]


def test_schedule_is_even_everywhere(spark):
    rows = mixing.schedule(spark, 100_000, [1.0, 4.0, 10.0]).orderBy("slot").collect()
    s = np.array([r["s"] for r in rows])
    for part in (slice(0, 1000), slice(70_123, 71_123), slice(0, 100_000)):
        n = len(s[part])
        assert np.abs(np.bincount(s[part], minlength=3) - n * np.array([0.1, 0.3, 0.6])).max() < 8
    ranks = defaultdict(list)
    for r in rows:
        ranks[r["s"]].append(r["rank"])
    assert all(v == list(range(len(v))) for v in ranks.values())


# Toxicity


@pytest.fixture(scope="session")
def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1500):
        words = [rng.choice(["calm", "tree", "river", "stone", "walk", "you", "light"]) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Scumbag!", "scumbag", "blarg" + rng.choice(["a", "o", "um"]), "M0ron"]))
        rows.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, None, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, labelled, corpus, nothing):
    docs, labels = labelled
    got = toxicity.op3_toxicity(spark, docs, labels).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.95 and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.op3_toxicity(spark, docs, flipped).toPandas().sort_values("doc_id")
    assert np.allclose(again["score"], toxicity.op3_toxicity(spark, docs, labels).toPandas().sort_values("doc_id")["score"])
    whole = toxicity.op3_toxicity(spark, corpus, labels.limit(0)).toPandas()
    assert len(whole) == corpus.count() and whole["score"].between(0, 1).all() and whole["score"].nunique() == 1
    assert toxicity.op3_toxicity(spark, nothing, labels).count() == 0


def test_features_of_texts(plain):
    """Against one text and one word at a time."""
    weights = {b"scumbag": 3.0, b"blar*": 2.6, b"moron": 1.5, b"the": 1.3}
    texts = [t.encode() for _, t, _ in plain][:40] + [b"You SCUMBAG!! aaaargh you m0ron, blarga scumbag", b"", b"!!", b"scumbag", b"x x x x x x x x scumbag the you", b"aaa", b"aAAa 1234 t@st", b"a" * 3 + b" you"]
    one = toxicity.Lexicon(weights)
    got = toxicity.Lexicon(weights).features(texts)
    for row, text in zip(got, texts, strict=True):
        words = text.split()
        one.profiles.clear()
        facts = [(max((weights.get(u, 0.0) for u in toxicity.units(w)), default=0.0), w) for w in words]
        n, size = max(1, len(words)), max(1, len(text))
        core = lambda w: w.strip(toxicity._EDGES)
        second = [i for i, w in enumerate(words) if core(w).lower() in toxicity.SECOND]
        strong = [i for i, (x, _) in enumerate(facts) if x >= toxicity.STRONG]
        kinds = {(x, core(w).lower() in toxicity.SECOND, len(core(w)) > 2 and core(w).isupper(), toxicity._obfuscated(w), any(48 <= c <= 57 for c in core(w))) for x, w in facts if x >= toxicity.STRONG}
        expected = (len(strong) / n, sum(toxicity.WEAK <= x < toxicity.STRONG for x, _ in facts) / n, sum(x for x, _ in facts) / n, max((x for x, _ in facts), default=0), len(kinds), math.log1p(len(strong)), len(second) / n, sum(any(abs(i - j) <= toxicity.NEAR for j in second) for i in strong) / n, sum(len(core(w)) > 2 and core(w).isupper() for w in words) / n, sum(65 <= c < 91 for c in text) / size, text.count(b"!") / size, sum(text.count(c) for c in (b"!", b'"', b"'", b",", b".", b":", b";", b"?")) / size, sum(map(toxicity._obfuscated, words)) / n, sum(48 <= c < 58 for c in text) / size, math.log1p(len(words)), sum(text[i] == text[i - 1] == text[i - 2] and text[i] > 64 for i in range(2, len(text))) / size)
        assert row.tolist() == pytest.approx(expected), text[:80]


def test_rows_that_repeat_a_doc_id_count_once(spark, labelled):
    docs, labels = labelled
    few = docs.limit(300)
    once = toxicity.train(few, labels, spark)
    again = toxicity.train(few.unionByName(few).unionByName(few.select("doc_id", F.lit(None).cast("string").alias("text"))), labels, spark)
    texts = [r["text"].encode() for r in docs.limit(50).collect()]
    assert np.allclose(once.score(texts), again.score(texts)) and once.lexicon.weights == again.lexicon.weights


def test_calibration_on_unseen_rows(spark, labelled):
    docs, labels = labelled
    got = toxicity.op3_toxicity(spark, docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert abs(got["score"].mean() - got["toxic"].mean()) < 0.05 and ((got["score"] - got["toxic"]) ** 2).mean() < 0.05


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(float)
    trees = toxicity.Trees(rounds=60).fit(x[:2000], y[:2000])
    assert ((trees.raw(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95
    score = rng.random(4000)
    knots = toxicity.isotonic(score, (rng.random(4000) < score**2).astype(float))
    assert (np.diff(knots[1]) >= 0).all() and np.abs(np.interp([0.2, 0.5, 0.9], *knots) - np.array([0.04, 0.25, 0.81])).max() < 0.08


def test_rejection_keeps_columns(spark, labelled, corpus):
    docs, labels = labelled
    model = toxicity.train(docs, labels, spark)
    got = toxicity.reject_toxic(corpus.unionByName(corpus.limit(1).withColumn("text", F.lit("scumbag scumbag you m0ron"))), model, spark)
    assert got.columns == corpus.columns and got.count() <= corpus.count() and got.where("text like 'scumbag%'").isEmpty()


# Near copies


def shingles_of(text: str, k: int = 5) -> frozenset:
    words = SPACE.findall(lower(text))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or (frozenset([tuple(words)]) if words else frozenset())


def alike(a: frozenset, b: frozenset) -> bool:
    return bool(a) and 100 * len(a & b) >= 75 * len(a | b)


def components_of(rows):
    sets = [shingles_of(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and alike(sets[i], sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (doc, _) in zip(group, rows, strict=True):
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    return [(doc, len(s), least.get(g) if s else doc) for (doc, _), s, g in zip(rows, sets, group, strict=True)]


def test_near_copies(spark, corpus, plain, nothing):
    expected = components_of([(d, t) for d, t, _ in plain])
    assert len({c for _, _, c in expected}) < len(plain) - 8
    same(jaccard.op4_ngram_jaccard(spark, corpus), expected)
    assert jaccard.op4_ngram_jaccard(spark, nothing).count() == 0


def test_fragments_follow_the_global_order():
    rng = np.random.default_rng(1)
    gram, count = rng.integers(0, 2**64, 4000, np.uint64), rng.integers(2, 30, 4000)
    order = np.lexsort((gram, count))
    parts = jaccard.fragment_of(gram[order], count[order])
    assert (np.diff(parts) >= 0).all() and set(parts.tolist()) == set(range(len(jaccard._CUTS) + 1))


def test_ranges_of_tables_that_no_file_holds(spark):
    made = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x" * 1000).alias("text"))
    local = spark.createDataFrame([(1, "x" * 50_000)], "doc_id long, text string")
    assert common.fragments_for(local, spark, 1000) >= 25 and common.fragments_for(made, spark, 1 << 30) == common.partitions(spark)


def test_chains_and_families_of_near_copies(spark):
    rng = random.Random(2)
    rows, words = [], [f"w{i}" for i in range(80)]
    for i in range(60):  # a chain, whose ends share little
        words = list(words)
        words[rng.randrange(80)] = f"c{i}"
        rows.append((1000 + i * 7 % 60, " ".join(words)))
    base = [f"b{i}" for i in range(60)]
    for i in range(150):  # a family with edits, some too many
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(60)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    same(jaccard.op4_ngram_jaccard(spark, docs), components_of(rows))


@pytest.mark.parametrize(("n", "few"), [(700, graph.FEW_LINKS), (50, 0)])
def test_components_of_a_long_path(spark, monkeypatch, n, few):
    monkeypatch.setattr(graph, "FEW_LINKS", few)
    links = spark.range(n - 1).select((F.col("id") * 37 % n).alias("u"), ((F.col("id") + 1) * 37 % n).alias("v")).repartition(6)
    got = graph.components(links, spark).collect()
    assert len(got) == n and {r["component"] for r in got} == {0}
    assert graph.components(links.limit(0), spark).count() == 0


# Language models


def test_lm(spark, corpus, plain, nothing):
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _, _ in plain}
    counts, after = Counter(), Counter()
    tokens = [(d, [*SPACE.findall(lower(t)), None]) for d, t, _ in plain]
    for d, w in tokens:
        if not held[d]:
            counts.update(w)
            after.update(zip([None, *w[:-1]], w, strict=True))
    total, kinds = sum(counts.values()), len(counts)
    got = sorted(lm_score.op5_lm_score(spark, corpus).collect(), key=lambda r: repr((r["doc_id"], r["n_tokens"], r["n_known"])))
    base = lambda x: (counts[x] + 1) / (total + kinds + 1)
    expected = sorted(((d, held[d], len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10(base(x)) for x in w), w) for d, w in tokens), key=lambda r: repr((r[0], r[2], r[3])))
    for g, e in zip(got, expected, strict=True):
        assert tuple(g[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")) == e[:5] and g["base_score"] == pytest.approx(e[5], rel=1e-9)
        # The attention's part of the prior is between none and all of it.
        low, high = (sum(math.log10((after[b, x] + lm_score.PRIOR * p) / (counts[b] + lm_score.PRIOR)) for b, x in zip([None, *e[6][:-1]], e[6], strict=True) for p in [lm_score.SHARE * base(x) + more]) for more in (0, 1 - lm_score.SHARE))
        assert low - 1e-6 < g["score"] < high and g["score"] < 0 and g["attention_score"] < 0
    again = sorted(lm_score.op5_lm_score(spark, corpus.repartition(2)).collect(), key=lambda r: repr((r["doc_id"], r["n_tokens"], r["n_known"])))
    assert [r["score"] for r in again] == pytest.approx([r["score"] for r in got], rel=1e-4)
    assert lm_score.op5_lm_score(spark, nothing).count() == 0


def test_lm_learns_from_the_whole_corpus(spark, monkeypatch):
    """On held-out documents the model beats the words' shares and itself untrained; its attention learns too."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    bits = lambda: lm_score.op5_lm_score(spark, docs).where("held_out").agg(*(F.sum(c) / F.sum("n_tokens") for c in ("base_score", "attention_score", "score"))).first()
    base, attention_alone, score = bits()
    monkeypatch.setattr(lm_score, "ROUNDS", 0)
    _, untrained, score_untrained = bits()
    assert attention_alone > untrained + 1 and score > score_untrained + 0.1 and score > base + 0.4


def test_lm_trains_on_every_window(spark, monkeypatch):
    """Each id of each training text is trained on once, in one shard of one round."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    path = lm_score.public_tokenizers.path("word_bpe_49k.json")
    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), common.text_bytes(), lm_score.held_out().alias("held_out"))
    chunks = common.materialize(texts.mapInArrow(lm_score._chunks(path), lm_score._CHUNK_SQL), spark)
    expected, got = Counter(), Counter()
    for row in chunks.collect():
        chunk = lm_score.Chunk(row.asDict())
        expected.update(chunk.ids(~chunk.held)[0].tolist())
    for nth in range(lm_score.ROUNDS):
        for r in chunks.mapInArrow(lm_score._windows(nth, 3, 2), "shard long, piece long, keys binary, sizes binary, firsts binary, ids binary").collect():
            assert r["shard"] == r["piece"] // 2 and r["piece"] < 6
            ids, at = np.frombuffer(r["ids"], "<u2"), 0
            for size, first in zip(r["sizes"], r["firsts"], strict=True):
                got.update(ids[at + first : at + size].tolist())
                at += size
            assert at == len(ids)
    assert got == expected and expected.total() > 100_000


def test_large_rows_are_not_held_together(spark):
    """Rows of some MB are written in small row groups and read by rows; settings come back afterwards."""
    rows = spark.range(48).repartition(1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"x": [np.random.default_rng(i).bytes(1 << 20)]}) for b in batches for i in range(b.num_rows)), "x binary")
    names = ("spark.sql.parquet.enableVectorizedReader", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(name) for name in names]
    with lm_score.large_rows(spark):
        kept = common.materialize(rows, spark, common.LARGE_ROWS)
        assert kept.count() == 48 and spark.conf.get(names[0]) == "false"
        assert "ColumnarToRow" not in kept._jdf.queryExecution().executedPlan().toString()
    assert [spark.conf.get(name) for name in names] == before
    footers = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in kept.inputFiles()]
    assert max(m.row_group(i).num_rows for m in footers for i in range(m.num_row_groups)) <= 24


def test_texts_that_occur_twice_stand_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("length(text) > 200")
    some = docs.where(~lm_score.held_out()).orderBy(F.xxhash64("doc_id")).limit(20)
    twins = some.select((F.col("doc_id") + 700_000).alias("doc_id"), "text")
    rate = lambda frame: {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm_score.op5_lm_score(spark, frame).collect()}
    once, twice = rate(docs), rate(docs.unionByName(twins.where(~lm_score.held_out())))
    doubled = {i - 700_000 for i in twice if i >= 700_000}
    gain = {i: twice[i] - once[i] for i in once}
    others = np.array([g for i, g in gain.items() if i not in doubled])
    assert len(doubled) > 10 and min(gain[i] for i in doubled) > max(0.02, np.quantile(others, 0.9))


@pytest.fixture(scope="module")
def tiny_model():
    rng = np.random.default_rng(3)
    texts = [np.append(np.cumsum(rng.integers(1, 4, n)) % 90, 100).astype(np.int64) for n in rng.integers(0, 120, 60)]
    counts = np.bincount(np.concatenate(texts), minlength=101)
    model = attention.AttentionModel.over(counts)
    windows = []
    for ids in texts:
        for low in range(0, len(ids), attention.WINDOW):
            first = min(low, 2)
            windows.append((ids[low - first : low + attention.WINDOW].astype("<u2").tobytes(), first))
    return model, texts, lm_score.examples(model, windows)


def test_attention_gradients(tiny_model):
    model, _, windows = tiny_model
    some = [x[:5] for x in windows]
    model = model.unpack(model.pack())
    model.weights = {k: v.astype(np.float64) + 0.05 * np.random.default_rng(2).standard_normal(v.shape) for k, v in model.weights.items()}
    _, grads = model.gradients(*some)
    for name, weight in model.weights.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), weight.shape)
        old = weight[at]
        ends = []
        for step in (1e-4, -1e-4):
            weight[at] = old + step
            ends.append(model.gradients(*some)[0])
        weight[at] = old
        assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(float(grads[name][at]), rel=0.02, abs=1e-6), name


def _probabilities(model, last, before, at):
    """Of each id after place `at` of one window, by the definition."""
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x = w["last"][last] + w["before"][before] + w["position"][: len(last)]
    a = np.exp((x[at] @ w["query"]) @ (x[: at + 1] @ w["key"]).T / math.sqrt(attention.WIDTH))
    y = x[at] + a / a.sum() @ (x[: at + 1] @ w["value"])
    h = np.maximum(y @ w["hidden"] + w["shift"], 0)
    soft = lambda z: np.exp(z) / np.exp(z).sum(-1, keepdims=True)
    member = soft(np.einsum("h,chm->cm", h, w["member"]) + w["member_bias"])
    place = (soft(h @ w["class"] + w["class_bias"])[:, None] * member).ravel()
    return place[model.place] * np.exp(model.share)


@pytest.mark.parametrize("n", [1 << 16, (1 << 16) + 1])
def test_rows_are_summed_by_number(n):
    """Also by numbers that 16 bits just hold, or don't."""
    at = np.array([n - 1, 0, 5, n - 1, 0, n - 2, n - 1])
    rows, wanted = np.arange(14, dtype=np.float32).reshape(7, 2), np.zeros((n, 2), np.float32)
    np.add.at(wanted, at, rows)
    assert np.array_equal(attention._sum_rows(rows, at, n), wanted)


def test_attention_learns_and_is_a_distribution(tiny_model):
    model, texts, windows = tiny_model
    sizes = np.array(list(map(len, texts)))
    whole = np.concatenate(texts)
    plain = model.scores(whole, sizes)
    trained = model.unpack(model.pack()).fit(*windows, epochs=40)
    got = trained.scores(whole, sizes)
    assert got.sum() > 0.8 * plain.sum()
    # Each id is scored once, by the window that holds it and CONTEXT ids or more before it, whatever else is in the batch.
    step, at = attention.WINDOW - attention.CONTEXT, 0
    for ids in texts[:20]:
        before = [trained.outside, trained.outside, *trained.place[ids].tolist()]
        for i in range(len(ids)):
            start = 0 if i < attention.WINDOW else (i - attention.CONTEXT) // step * step
            p = _probabilities(trained, np.array(before[start + 1 : i + 2]), np.array(before[start : i + 1]), i - start)
            assert p.sum() == pytest.approx(1, abs=1e-6) and math.log(p[ids[i]]) == pytest.approx(got[at + i], abs=1e-3)
        at += len(ids)


def test_attention_does_not_depend_on_its_blocks(tiny_model, monkeypatch):
    """Neither scores nor gradients, whether windows and classes are taken one at a time or all together."""
    model, texts, windows = tiny_model
    sizes, whole = np.array(list(map(len, texts))), np.concatenate(texts)
    trained = model.unpack(model.pack()).fit(*windows, epochs=2)
    expected = None
    for blocks in ((1, 1), (3, 40), (10**6, 10**6)):
        for name, value in zip(("_LOOKED", "_ROWS"), blocks, strict=True):
            monkeypatch.setattr(attention, name, value)
        loss, grads = trained.gradients(*windows)
        got = [np.array([loss]), trained.scores(whole, sizes), *(grads[k] for k in sorted(grads))]
        expected = expected or got
        assert all(np.allclose(g, e, rtol=1e-4, atol=1e-5) for g, e in zip(got, expected, strict=True))


def test_attention_scores_beyond_the_limit(tiny_model):
    """Exponents that would overflow count as the limit: scores and gradients stay finite."""
    model, texts, windows = tiny_model
    sizes, whole = np.array(list(map(len, texts))), np.concatenate(texts)
    for name in ("query", "class", "member"):
        large = model.unpack(model.pack())
        large.weights[name] = large.weights[name] * 1e4 + 200 * (name != "query")
        loss, grads = large.gradients(*windows)
        assert np.isfinite(loss) and np.isfinite(large.scores(whole, sizes)).all() and all(np.isfinite(g).all() for g in grads.values()), name


def test_words_are_spelled_once_while_remembered(monkeypatch):
    """Also words that came once in a chunk; those that come again and again outlive those that don't."""
    monkeypatch.setattr(lm_score, "_MEMO", 50)
    spelled, asked = lm_score._Spelled(lm_score.public_tokenizers.path("word_bpe_49k.json")), Counter()
    spell = spelled.words.spell
    monkeypatch.setattr(spelled.words, "spell", lambda word: asked.update([word]) or spell(word), raising=False)
    common_words = [b"often", b"again,", "größe".encode()]
    for i in range(40):
        words = [*common_words, *(b"rare%d" % (20 * i + j) for j in range(20)), lm_score._END]
        ids = spelled.of(words)
        assert ids == [*map(spell, words[:-1]), spelled.end]
    assert [asked[w] for w in common_words] == [1, 1, 1] and len(spelled.recent) + len(spelled.older) < 160


# Top k


@pytest.mark.parametrize("spread", [0.05, 1.0, 30.0])
def test_top_k_search(spread):
    rng = np.random.default_rng(int(spread * 100))
    centres = rng.normal(0, 1, (8, 6))
    x = np.floor(64 * (centres[rng.integers(0, 8, 900)] + spread * rng.normal(0, 1, (900, 6)))).astype(int)
    x[50:90] = x[50]
    ids = rng.permutation(900)
    ask = np.flatnonzero(ids % 7 == 0)
    data, asks = topk.Block(np.arange(900), ids, x.astype(float)), topk.Block(ask, ids[ask], x[ask].astype(float))
    best = topk.search(asks, data, np.full(len(ask), topk.NONE), 10)
    for row, scores, found in zip(best.rows, best.scores, best.ids, strict=True):
        expected = sorted((-int(x[row] @ v), i) for n, (v, i) in enumerate(zip(x, ids.tolist(), strict=True)) if n != row)[:10]
        assert [(-int(a), int(b)) for a, b in zip(scores, found, strict=True)] == expected


@pytest.mark.parametrize("scale", [1, 2**21, 2**28, 2**33, 2**70])
def test_inner_products_are_exact(scale):
    rng = np.random.default_rng(9)
    a, b = (np.floor(rng.normal(0, 1000, (20, 5))) for _ in range(2))
    a[::3] *= scale
    b[::2] *= scale
    size = lambda x: np.sqrt((x**2).sum(1))
    expected = [[max(-topk.MOST, min(topk.MOST, sum(int(p) * int(q) for p, q in zip(x, y, strict=True)))) for y in b] for x in a]
    assert topk.inner(a, b, size(a), size(b)).tolist() == expected


def test_cover_tree_invariants():
    tree = topk.CoverTree(np.random.default_rng(0).normal(0, 1, (1500, 3)))
    todo = [tree.root]
    while todo:
        node = todo.pop()
        part = tree.x[node.low : node.high]
        assert np.sqrt(((part - node.centre) ** 2).sum(1)).max() <= node.radius + 1e-9
        assert not node.children or [c.low for c in node.children[1:]] == [c.high for c in node.children[:-1]]
        todo += node.children
    assert sorted(tree.order) == list(range(1500))


@pytest.mark.parametrize("block", [topk.DATA_BLOCK, 16])
def test_top_k_rows(spark, monkeypatch, block):
    """Against brute force: rows given twice, two rows of one vec_id, large and odd components, several lengths, small blocks."""
    monkeypatch.setattr(topk, "DATA_BLOCK", block)
    monkeypatch.setattr(topk, "_TOGETHER", 2)
    rows = [(i, [math.sin(i * j) / 3 for j in range(1, 5)], i % 3) for i in range(400)]
    rows += [(500, None, 0), (600, [1.0, None, 0.0, 0.0], 0), (700, [float("nan"), 0.0, 0.0, 0.0], 0), (800, [float("inf")] * 4, 0), (900, [0.5, 0.5], 1), (1000, [0.25, 0.5], 1), (None, [0.1] * 4, 1)]
    rows += [rows[7], rows[200], (100, [0.1, 0.2, 0.3, 0.4], 0), (1100, [3e6, -3e6, 1.0, 0.5], 0), (1101, [-3e6, 3e6, 0.25, 0.1], 0), (1200, [3e6, 0.0, 1e30, -1e30], 0), (1201, [1e30, 3e6, 0.0, 1.0], 0), (1300, [], 0), (1301, [], 0), (1302, [], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({n: F.lit("x") for n in ("block", "ids", "vector", "asks", "row", "cell", "ask", "group", "score")}).repartition(3)
    got = topk.op6_topk_search(spark, frame).collect()
    vectors = [(i, tuple(math.floor(1024 * float(np.float32(c))) for c in v)) for i, v, _ in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    expected = []
    for n, (q, x) in enumerate(vectors):
        if q % 100 == 0:
            score = lambda v: max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(x, v, strict=True))))  # noqa: B023, E731
            best = sorted((-score(v), i) for m, (i, v) in enumerate(vectors) if m != n and len(v) == len(x))[:10]
            expected += [(q, place + 1, i, -s) for place, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert topk.op6_topk_search(spark, frame.limit(0)).count() == 0


def test_top_k_sends_only_blocks_that_can_win(spark, monkeypatch):
    """Of far clusters, a query block meets but its own and its neighbours."""
    monkeypatch.setattr(topk, "DATA_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    centres = 40 * np.eye(8)
    frame = spark.createDataFrame([(i, (centres[i % 8] + rng.normal(0, 0.1, 8)).tolist()) for i in range(2000)], "vec_id long, vector array<double>")
    monkeypatch.setattr(topk, "materialize", lambda df, spark, keep=topk.materialize: kept.append(keep(df, spark)) or kept[-1])
    kept = []
    assert topk.top_k(frame, F.col("vec_id") % 100 == 0, spark).count() == 200
    data, queries, pairs = (k.count() for k in kept)
    assert pairs < data * queries / 3


# Token files


def test_token_files(spark, corpus, plain, nothing):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    library = token_files.tokenizer(path)
    encoded = [(d, [*library.encode(t, add_special_tokens=False).ids, 2]) for d, t, _ in plain]
    got = token_files.op7_token_files(spark, corpus).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((-1 if d is None else d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in encoded)
    assert token_files.op7_token_files(spark, nothing).count() == 0


@pytest.mark.parametrize("text", ["it's DON'T we'll 've", "a<|endoftext|>b <|startoftext|>", "e\u0301 \u00e9 ﬁ ß ẞ İ", "x\u3000y\u2028z\x1cq", "#hash @x 1,000.50% ...!?", "\ufeff\u200b a", "Straße, GRÖßE; naïve?! :.", "日本語 テスト 🙂👍🏽"])
def test_words_encode_as_texts(text):
    import public_tokenizers

    words = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert words.encode([text.encode()])[0] == words.whole(text)


def test_addressable_codes():
    rng = np.random.default_rng(5)
    for ids in (np.zeros(0, np.uint32), np.array([0, 255, 256, 65535, 65536, 2**32 - 1], np.uint32), (2 ** (rng.random(5000) * 31)).astype(np.uint32)):
        counts = np.array([0, len(ids) // 3, len(ids) - len(ids) // 3, 0])
        shard = token_files.Shard(token_files.pack([7, None, 9, 9], counts, ids))
        assert shard.doc_ids == [7, None, 9, 9] and [shard[i] for i in range(len(ids))] == ids.tolist()
        for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (3, 3)):
            assert (shard.ids(a, max(a, b)) == ids[a : max(a, b)]).all()
    with pytest.raises(ValueError, match="not a token file"):
        token_files.Shard(b"something else" * 9)


# Repeated passages


def test_substring_dedup(spark, corpus, plain, nothing):
    words = [SPACE.findall(t) for _, t, _ in plain]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    expected = []
    for (doc, _, _), w in zip(plain, words, strict=True):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        expected.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert 0 < sum(e[2] for e in expected)
    same(substring_dedup.op8_substring_dedup(spark, corpus), expected)
    assert substring_dedup.op8_substring_dedup(spark, nothing).count() == 0


def test_removal_intervals_are_maximal(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = spark.createDataFrame([(1, f"u {a} v {b}"), (2, f"{a} {b}"), (3, c)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in substring_dedup.remove_repeats(docs, spark).collect()}
    assert got == {1: [1, 41, 42, 82], 2: [0, 80], 3: None}


def test_rabin_karp_windows():
    words = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    words[300:360] = words[100:160]
    starts, _ = common.window_starts(np.array([500]), 35)
    h = common.rabin_karp(words, starts, 35)
    assert (h[300:326] == h[100:126]).all() and len(set(h.tolist())) == len(h) - 26
    starts, owner = common.window_starts(np.array([3, 0, 5, 2]), 3)
    assert starts.tolist() == [0, 3, 4, 5] and owner.tolist() == [0, 2, 2, 2]


# URLs


def test_url_filter(spark):
    urls = [None, "", "no scheme example.org/es/", "http://example.org/es/x", "https://Sub.EXAMPLE.org/es/", "http://notexample.org/es/", "http://example.org/en/1", "http://example.org/en/2", "http://example.org/en/19?x", "http://example.org", "http://example.org?q=/es/", "http://a.com/fr/", "http://a.com/de/#x", "http://a.com/de", "http://com/fr/", "x://y.net/http://a.com/de/", "http://.org/", "http://org./", "http://a..org/z", "http://example.org:80/es/", "HTTP://É.COM/fr/"]
    pages = spark.createDataFrame([*enumerate(urls), (3, urls[3])], "page_id long, url string").withColumns({"host": F.lit("h"), "digest": F.lit("d"), "n": F.lit(9)})

    def judge(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = lower(re.match(r"[^/?#]*", rest)[0])
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fitting = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fitting, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    same(url_filter.op9_url_filter(spark, pages), [(i, *judge(u)) for i, u in [*enumerate(urls), (3, urls[3])]])
    assert url_filter.op9_url_filter(spark, pages.limit(0)).count() == 0
    none = url_filter.filter_urls(pages, url_filter.rules_frame(spark, []), default="block")
    assert {r["verdict"] for r in none.collect()} == {"block"} and none.count() == len(urls) + 1


# Benchmark passages


def test_decontaminate(spark, corpus, plain, nothing):
    texts = [t for _, t, _ in plain]
    long = max(texts, key=len).split()
    items = [(1, " ".join(long[100:130])), (2, " ".join(long[500:506])), (3, "one"), (4, None), (5, "..."), (6, " ".join(long[100:113]).upper()), (7, "nowhere to be found " * 5), (20, "same-words/HERE again"), (3, "two")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"row": F.lit("r"), "gram": F.lit(1)})
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(item)
    sizes = {len(k) for k in windows}
    expected = []
    for doc, text, _ in plain:
        w = split(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[key]
        expected.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w)))
    assert sum(e[3] for e in expected) >= 6
    same(decontaminate.op10_decontaminate(spark, corpus, bench), expected)
    assert decontaminate.op10_decontaminate(spark, nothing, bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.op10_decontaminate(spark, corpus, bench.limit(0)).collect()} == {0}


def test_decontaminate_without_the_broadcast(spark, corpus, monkeypatch):
    long = max((r["text"] for r in corpus.select("text").collect() if r["text"]), key=len).split()
    bench = spark.createDataFrame([(1, " ".join(long[40:70])), (2, "two words")], "item_id long, text string")
    wanted = sorted(map(repr, decontaminate.op10_decontaminate(spark, corpus, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_GRAMS", 3)
    assert sorted(map(repr, decontaminate.op10_decontaminate(spark, corpus, bench).collect())) == wanted


def test_winnowing_keeps_the_least_of_each_window():
    rng = np.random.default_rng(0)
    for n, w in ((40, 9), (9, 9), (30, 1), (25, 6)):
        h = rng.integers(0, 12, n).astype(np.uint64)
        starts = np.arange(n - w + 1)
        kept = decontaminate.winnow(h, w, starts)
        assert kept.tolist() == sorted({max(range(s, s + w), key=lambda i: (-int(h[i]), i)) for s in starts.tolist()})
    assert len(decontaminate.winnow(np.zeros(3, np.uint64), 9, np.zeros(0, np.int64))) == 0
