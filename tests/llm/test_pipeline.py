"""The pipeline on a small corpus: what each stage decides, against the operators' own results."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import SCHEMA, prose

import corpus_pipeline
from relfeat.llm import common, jaccard, mixing, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    items = [(i, " ".join(prose(rng, 40))) for i in range(3)]
    docs, labels = [], []
    for i in range(240):
        words = prose(rng, rng.randint(40, 90))
        toxic = i % 6 == 0
        if toxic:
            words[5:5] = ["scumbag,", "you", "scumbag"]
        if i % 40 == 1:
            words[10:10] = items[i % 3][1].split()
        docs.append((i, " ".join(words), "en", ["a", "b", None][i % 3], 0))
        labels.append((i, 1, int(toxic)))
    docs += [(300 + i, docs[7 + i][1], "en", "a", 0) for i in range(5)] + [(400, None, None, None, None), (401, "", "en", "b", 0)]
    path = tmp_path_factory.mktemp("corpus")
    for name, rows, schema in (("documents", docs, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path), docs


def test_stages(spark, folder):
    path, docs = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    kept = {d[0] for d in docs}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, path).cache()
        seen[name] = [r["doc_id"] for r in out.select("doc_id").collect()]
        if name != "token_files":
            assert out.columns == frame.columns
            assert {tuple(r) for r in out.collect()} <= set(docs)
            frame = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    assert kept - set(seen["toxicity"]) == {i for i in range(0, 240, 6)} | ({300 + i for i in range(5) if (7 + i) % 6 == 0})
    assert set(seen["toxicity"]) - set(seen["near_duplicates"]) == {300 + i for i in range(5) if (7 + i) % 6}
    assert set(seen["near_duplicates"]) - set(seen["decontamination"]) == {i for i in range(240) if i % 40 == 1}
    assert set(seen["mixing"]) <= set(seen["decontamination"]) and max(seen["mixing"].count(i) for i in set(seen["mixing"])) == 2
    assert sorted(seen["token_files"]) == sorted(seen["mixing"])
    assert {400, 401} <= set(seen["mixing"])


def test_columns_of_any_name_pass(spark, folder):
    """Names that stages use themselves stay columns of the documents, with their values."""
    path, _ = folder
    names = ("times", "m_doc", "m_row", "__doc", "__row", "__copy", "doc", "key", "row", "gone", "gone_row", "mixed", "mixed_row", "col", "g_doc", "a.b", "size", "slot")
    frame = spark.read.parquet(f"{path}/documents.parquet").limit(60)
    frame = frame.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names}).cache()
    given = {tuple(r) for r in frame.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, path)
        assert out.columns == frame.columns and (rows := out.collect()) and {tuple(r) for r in rows} <= given, name


def test_the_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (5 + i * 37 % 400), ["a", "b", "c"][i % 3 if i % 5 else 0]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    goals = {r["source"]: r["target"] for r in mixing.mix_sources(docs, spark).select("source", "target").distinct().collect()}
    got = corpus_pipeline.mix(spark, docs, "").groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()
    assert len(got) == 3 and all(r["n"] == pytest.approx(goals[r["source"]], rel=0.03) for r in got)


def test_run_is_the_stages_in_turn(spark, folder):
    path, _ = folder
    got = corpus_pipeline.run(spark, path)
    assert got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = got.orderBy("start").collect()
    assert rows[0]["start"] == 0 and rows[-1]["start"] + rows[-1]["n_tokens"] == sum(r["n_tokens"] for r in rows)


def test_python_gets_documents_some_mb_at_a_time(spark, folder, monkeypatch):
    """Whatever their size: 2,000 documents of 10 KB in one partition, in the lazy first stage and in the second."""
    path, _ = folder
    frame = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.repeat(F.concat("id", F.lit(" word ")), 1000)).alias("text")).coalesce(1)

    def watched(inner):
        def run(batches):
            def small():
                for batch in batches:
                    assert batch.nbytes < 6 << 20, batch.nbytes
                    yield batch

            return inner(small())

        return run

    blocks, nodes = jaccard._blocks, jaccard._nodes
    monkeypatch.setattr(jaccard, "_blocks", lambda *a: watched(blocks(*a)))
    monkeypatch.setattr(jaccard, "_nodes", watched(nodes))
    before = spark.conf.get(common.BATCH_SETTING)
    try:
        spark.conf.unset(common.BATCH_SETTING)
        assert jaccard.similar_documents(frame, spark).count() == 2000
        assert spark.conf.get(common.BATCH_SETTING) != str(common.BATCH_BYTES)
        out = corpus_pipeline.drop_toxic(spark, frame, path)
        sizes = frame.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
        assert out.count() == 2000 and max(r["n"] for r in sizes.collect()) < 6 << 20
    finally:
        spark.conf.set(common.BATCH_SETTING, before)


def test_an_empty_corpus_passes(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert toxicity.held_out is not None
