import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tideframe.llm import decontaminate, near_dup, quality_model


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, made = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in cp.STAGES:
        after = stage(spark, docs, sf_dir).cache()
        made.append((name, docs, after))
        docs = after
    return made


def test_columns(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns and dict(after.dtypes) == dict(before.dtypes), name
    assert [n for n, *_ in stages] == [n for n, _ in cp.STAGES] and 4 <= len(cp.STAGES) <= 5


def test_each_decision_takes_effect(stages, spark, sf_dir):
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    (_, d0, d1), (_, _, d2), (_, _, d3), (_, _, d4), (_, _, d5) = stages
    assert ids(d1) == sorted(r["doc_id"] for r in quality_model.classify(d0, labels).collect() if r["predicted"] == 1)
    assert ids(d2) == ids(d1) and all(r["n_chars"] == len(r["text"]) for r in d2.collect())
    assert ids(d3) == sorted({r["class_id"] for r in near_dup.near_duplicates(d2).collect()})  # no id stands for two texts here
    leaks = {r["doc_id"] for r in decontaminate.find_leaks(d3, bench).collect()}
    texts = {r["doc_id"]: " ".join((r["text"] or "").split()) for r in d3.collect()}
    items = [" ".join(r["text"].split()) for r in bench.collect()]
    assert {d for d, t in texts.items() if any(i in t for i in items)} <= leaks and ids(d4) == [d for d in ids(d3) if d not in leaks]
    rows = d5.collect()
    assert {r["doc_id"] for r in rows} <= set(ids(d4)) and all(r["copies"] > 0 for r in rows)


def test_run_is_the_stages(stages, spark, sf_dir):
    assert sorted(map(tuple, cp.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[-1][2].collect()))


def test_odd_tables(spark, sf_dir, tmp_path):
    """Nulls in every column, rows that repeat, and a column that the operators use themselves; then an empty table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("class_id", F.lit(1)).withColumn("size", F.lit("x"))
    some = docs.limit(20)
    odd = docs.unionByName(some).unionByName(some.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(some.limit(3).withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string")))
    odd = odd.unionByName(some.limit(3).withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes}))
    for df in (odd, odd.limit(0)):
        path = str(tmp_path / f"t{df.limit(1).count()}")
        df.write.parquet(f"{path}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
        got = cp.run(spark, path)
        assert got.columns == ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
        assert (got.count() > 100) == (df is odd)
    docs = spark.read.parquet(f"{tmp_path}/t1/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path / "t1"))
        assert after.columns == docs.columns and after.count() <= docs.count(), name
