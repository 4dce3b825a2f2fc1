import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideframe.functions.safe import average_rank, corr, kurtosis_corrected, lcg, skew_corrected
from tideframe.plans import stages
from tideframe.sources import files
from tideframe.streaming import online


def test_stored_is_made_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    path = f"file://{tmp_path}/t"
    assert stages.stored(spark, path, make).count() == 3 == stages.stored(spark, path, make).count() and len(calls) == 1
    stages.stored(spark, path, make, force=True)
    assert len(calls) == 2


def test_phases_stop_at_a_failed_check(spark, tmp_path):
    phases = [
        stages.Phase("one", lambda s, made: s.range(4), lambda df: {"small": F.col("id") < 10}),
        stages.Phase("two", lambda s, made: made["one"].selectExpr("id * 2 AS id"), lambda df: {"below_five": F.col("id") < 5}),
        stages.Phase("three", lambda s, made: s.range(1)),
    ]
    made, report = stages.run_phases(spark, phases, f"file://{tmp_path}")
    assert list(made) == ["one", "two"] and report == [("one", "small", True, 0), ("two", "below_five", False, 1)]


def test_numbers_in_a_text():
    assert stages.check_numbers("tau: 0.44, n = 360", {"tau": 0.4444, "n": 361.0, "q": 1.0}) == [("tau", True, "0.44"), ("n", False, "360"), ("q", False, "missing")]


def test_files(spark, tmp_path):
    (tmp_path / "listing.txt").write_text("Symbol|Exchange|ETF|Test|Name\n BRK.B|N|N|N|B Common Stock\nX|N|Y|N|X Common Stock\n")
    assert [tuple(r) for r in files.read_universe(spark, f"file://{tmp_path}/listing.txt").collect()] == [("BRK-B", "BRK.B", "B Common Stock")]
    (tmp_path / "p.csv").write_text("date,A,B\n2000-01-03,1.5,\n2000-01-04,2.5,3.5\n")
    rows = files.read_prices(spark, f"file://{tmp_path}/p.csv", ["A", "B"])
    assert rows.count() == 3
    assert files.stack_batches([rows, rows, rows.withColumn("price", F.lit(None).cast("double"))]).count() == 3
    files.write_csv(rows.withColumn("price", F.col("price") / 3), f"file://{tmp_path}/out")
    assert {r["price"] for r in spark.read.csv(f"file://{tmp_path}/out", header=True).collect()} == {"0.500000", "0.833333", "1.16667"}
    files.write_report(rows.limit(1), f"file://{tmp_path}/r")
    assert files.read_report(spark, f"file://{tmp_path}/r").count() == 1
    assert files.markdown(rows.orderBy("date", "entity").select("entity", "price")).splitlines()[2] == "| A | 1.5 |"


def test_statistics(spark):
    df = spark.createDataFrame([(float(x), 1.0) for x in (1, 2, 4, 8, 3)], "x double, k double")
    row = df.agg(skew_corrected(F.col("x")).alias("s"), kurtosis_corrected(F.col("x")).alias("q"), corr(F.col("x"), F.col("k")).alias("c")).first()
    want = pd.Series([1, 2, 4, 8, 3])
    assert abs(row["s"] - want.skew()) < 1e-9 and abs(row["q"] - want.kurt()) < 1e-9 and row["c"] is None
    ties = spark.createDataFrame([(float(x),) for x in (5, 1, 1, 2)], "x double").withColumn("r", average_rank("x"))
    assert sorted((r["x"], r["r"]) for r in ties.collect()) == [(1, 1.5), (1, 1.5), (2, 3.0), (5, 4.0)]
    u = spark.range(2000).select(lcg(F.lit(1), F.col("id")).alias("u")).toPandas()["u"]
    assert ((u >= 0) & (u < 1)).all() and abs(u.mean() - 0.5) < 0.05 and u.nunique() > 1900


def test_stream_equals_batch(spark, tmp_path):
    import numpy as np

    from tideframe.operators.signals import trailing_z

    rng = np.random.default_rng(0)
    rows = pd.DataFrame({"key": ["a", "b"] * 60, "w": np.repeat(range(60), 2), "x": rng.normal(size=120)})
    for k in range(3):
        part = rows[(rows["w"] >= 20 * k) & (rows["w"] < 20 * k + 20)]
        spark.createDataFrame(part).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    schema = "key string, w long, x double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"file://{tmp_path}/in/*")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = online.online_z(stream, 10).writeStream.format("memory").queryName("z").option("checkpointLocation", f"file://{tmp_path}/c").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("z").toPandas().sort_values(["key", "w"])["z"].to_numpy()
    want = trailing_z(spark.createDataFrame(rows), 10, ["key"]).toPandas().sort_values(["key", "w"])["z"].to_numpy()
    assert len(got) == 120 and np.allclose(got, want, equal_nan=True)


@pytest.mark.parametrize("baseline", [1, 2, 4])
def test_stream_z_of_short_baselines_and_nulls(spark, tmp_path, baseline):
    from tideframe.operators.signals import trailing_z

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", w, None if w % 5 == 3 else float(w * w % 7)) for w in range(20)]
    spark.createDataFrame(rows, "key string, w long, x double").write.parquet(f"file://{tmp_path}/r")
    q = online.online_z(spark.readStream.schema("key string, w long, x double").parquet(f"file://{tmp_path}/r"), baseline).writeStream.format("memory").queryName(f"z{baseline}").option("checkpointLocation", f"file://{tmp_path}/c").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table(f"z{baseline}").toPandas().sort_values("w")["z"].to_numpy(float)
    want = trailing_z(spark.createDataFrame(rows, "key string, w long, x double"), baseline, ["key"]).toPandas().sort_values("w")["z"].to_numpy(float)
    assert np.allclose(got, want, equal_nan=True)
    with pytest.raises(ValueError):
        online.online_z(spark.readStream.schema("key string, w long, x double").parquet(f"file://{tmp_path}/r"), 0)


def test_verified(spark):
    from tideframe.plans.stages import verified

    made = spark.createDataFrame([(1, 0.5, None), (2, 0.7, 1.0)], "w int, a double, b double")
    assert verified(made, made.withColumn("a", F.col("a") + 1e-10), ["w"]).count() == 2
    for wrong in (made.withColumn("a", F.col("a") + 1e-3), made.withColumn("b", F.lit(1.0)), made.unionByName(spark.createDataFrame([(3, 0.1, 0.1)], made.schema))):
        with pytest.raises(ValueError):
            verified(made, wrong, ["w"])


def test_stream_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/e")
    q = online.windowed_sums(stream).writeStream.format("memory").queryName("sums").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sums").agg(F.sum("n")).first()[0] == events.count()


def test_notebook_and_coordinates(spark):
    import json

    made = json.loads(files.notebook([("markdown", "# A\nb"), ("code", "print(1)")]))
    assert [c["cell_type"] for c in made["cells"]] == ["markdown", "code"] and made["nbformat"] == 4 and made["cells"][0]["source"] == ["# A\n", "b"]
    with pytest.raises(ValueError):
        files.notebook([("raw", "")])
    df = spark.createDataFrame([(2, 0.25), (1, 1 / 3), (3, None)], "x int, y double")
    assert files.coordinates(df, "x", "y") == "\\addplot coordinates {(1,0.333333) (2,0.25)};\n"
