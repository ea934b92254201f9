"""The registered corpus queries, their SQL twins and the pipeline."""
import os
import sys

import pytest
from conftest import SF_SMALL

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

from surveykit.llm import decontam, toxicity  # noqa: E402
from surveykit.llm.queries import QUERIES, SQL  # noqa: E402


def test_one_query_for_each_operator():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_twin(spark, duck_small, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = duck_small.execute(SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(dict(zip(names, r))[c] for c in df.columns) for r in got.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_SMALL)
        out.write.parquet(str(tmp_path / str(number)))
        out = spark.read.parquet(str(tmp_path / str(number)))
        if name != "sharding":
            assert out.columns == columns
        if number < 3:
            assert out.count() <= before and out.exceptAll(docs).count() == 0
        docs, before = out, out.count()
        if name == "benchmark_decontamination":
            bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
            assert decontam.contamination(docs, bench).where("contaminated").count() == 0
    assert docs.where("shard is null").count() == 0 and before > 0


def test_pipeline_run_and_awkward_rows(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, "w " * 40_000, "en", "s", 1), (4, "same text of a few words here", "en", "s", 1),
            (5, "same text of a few words here", "en", "t", 1), (None, "no id at all, but a text of its own", "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {r.doc_id for r in docs.collect()}
    assert 5 not in ids and {3, 4} & ids
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_SMALL).count() == 0
    assert set(corpus_pipeline.run(spark, SF_SMALL).columns) >= {"doc_id", "text", "slot", "shard"}
    assert toxicity.BIAS < -10
