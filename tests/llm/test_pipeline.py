import os
import zlib

import numpy as np
import pytest
from brute import pii_base
from test_neardup import brute as classes

import corpus_pipeline
from loam.llm import decontam, packing, quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first stage and after each."""
    from loam.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test")
        out.append(docs.toPandas())
    return out


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(list(s.columns) == ["doc_id", "text", "lang", "source", "n_chars"] for s in stages[:-1])


def test_quality(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.assess(docs, quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).filter("kept").toPandas()
    assert sorted(kept.doc_id) == sorted(stages[1].doc_id) and 0 < len(kept) < len(stages[0])


def test_one_of_each_class(stages):
    before = stages[1].sort_values("doc_id")
    want = classes(before.text.tolist())
    ids = before.doc_id.tolist()
    assert sorted(stages[2].doc_id) == sorted({ids[c] for c, _ in want.values()})


def test_no_benchmark_left(spark, stages):
    items = decontam.Items(*decontam.items_of(decontam.item_chunks(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "text", 10**6)[0])[1:])
    bad = {i for i, t in zip(stages[2].doc_id, stages[2].text, strict=True) if items.matches(t, decontam.COVERAGE)}
    assert set(stages[2].doc_id) - set(stages[3].doc_id) == bad


def test_personal_data_is_replaced(stages):
    before = dict(zip(stages[3].doc_id, stages[3].text, strict=True))
    after = dict(zip(stages[4].doc_id, stages[4].text, strict=True))
    assert before.keys() == after.keys()
    for i, text in before.items():
        spans = pii_base(text)
        if not spans:
            assert after[i] == text or "<" in after[i]
        for _, a, b in spans:
            assert text[a:b] not in after[i]
    assert (stages[4].n_chars == stages[4].text.str.len()).all()


def test_packing(spark, stages):
    encoder = packing.load_encoder()
    got = stages[5].sort_values(["doc_id", "piece"])
    for i, text in zip(stages[4].doc_id, stages[4].text, strict=True):
        ids = np.array([*encoder.encode_ordinary(text), 0], "<u4")
        own = got[got.doc_id == i]
        assert own.length.sum() == len(ids)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.concatenate([[0], s.length.cumsum().to_numpy()[:-1]])).all() and s.length.sum() <= 2048


def test_run_is_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages[5])


def through(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, SF)
        yield columns, docs


def test_nulls_repeats_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(30).unionByName(docs.limit(30)).unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    odd = odd.unionByName(docs.limit(5).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(5).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")}))
    names = ["__text", "__key", "__id", "key", "id", "cell", "uid", "row", "body", "salt", "piece", "length", "a.b", "__spans"]
    odd = odd.withColumns({n: F.lit(f"own {n}") for n in names})
    last = None
    for columns, out in through(spark, odd):
        if last is not None and "sequence_id" not in out.columns:
            assert out.columns == columns
        if "__text" in out.columns:
            rows = out.collect()
            assert rows and all(r[n] == f"own {n}" for r in rows for n in names)
        last = out
    assert last.count() > 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert [out.count() for _, out in through(spark, docs)] == [0] * 5
