"""The pipeline's stages, each on what its predecessor kept."""

import collections

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from tabq.llm.toxicity import fit_chain, score

from .test_operators import plain_near


def test_stages(spark, sf_dir, tmp_path):
    docs = first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = []
    for n, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if n < len(pipeline.STAGES) - 1:
            assert out.columns == first.columns
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        held.append([tuple(r) for r in docs.collect()])
    toxic, exact, near, mixed, packed = held
    chain = fit_chain(first, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {r[0] for r in toxic} == {r.doc_id for r in score(first, chain).where("NOT rejected").collect()}
    best = {}
    for r in toxic:
        best[r[1]] = max(best.get(r[1], -1), r[0])
    assert sorted(r[0] for r in exact) == sorted(best.values())
    assert {r[0] for r in near} == {i for i, (_, root) in plain_near([r[:2] for r in exact], 5).items() if i == root}
    times = collections.Counter(r[0] for r in mixed)
    assert set(times) <= {r[0] for r in near} and max(times.values()) <= 2
    tokens = collections.Counter()
    for r in packed:
        tokens[r[0]] += r[2]
    size = {r[0]: r[4] for r in packed}
    assert tokens == {i: n * size[i] for i, n in times.items()}


def test_rows_that_cannot_be_told_apart(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "same text", "en", "a", 9), (2, "same text", "en", "a", 9), (2, "same text", "en", "a", 9), (3, "", None, None, 0)]
    docs = spark.createDataFrame(rows, schema)
    assert sorted(r[0] or 0 for r in pipeline.exact(spark, docs, sf_dir).select("doc_id").collect()) == [2, 2, 3]
    empty = docs.where(F.lit(False))
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_run(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).count() > 0
