import numpy as np
import pytest

from tideframe.llm import mixing as m


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1}, {None: 5, "z": 100, "y": 2, "x": 40, "w": 9}, {"a": 0, "b": 7}, {"q": 3}, {"a": 0}])
def test_targets(spark, sizes):
    rows = [(i, s, n) for i, (s, n) in enumerate(sizes.items())]
    got = {r["source"]: r["target"] for r in m.targets(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 500):
        size, prob = rng.integers(1, 3000, n), np.full(n, 0.37)
        left = m.fly(prob, size, np.random.default_rng(2))
        assert len(left) <= 2 and prob.sum() == pytest.approx(0.37 * n, abs=1e-6) and (prob * size).sum() == pytest.approx(0.37 * size.sum(), rel=1e-7)


def test_flight_keeps_expectation():
    size = np.array([5, 9, 2, 7, 7, 1, 30, 4])
    total = np.zeros(len(size))
    for seed in range(3000):
        prob = np.full(len(size), 0.4)
        m.fly(prob, size, np.random.default_rng(seed))
        total += prob
    assert np.abs(total / 3000 - 0.4).max() < 0.04


def test_mix(documents, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 40)
    monkeypatch.setattr(m, "FAN", 3)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 200))), "en", ["hot", "hot", "b", None][i % 4]) for i in range(800)]
    rows += [(1, None, "en", "b"), (2, " \n", "en", "nil"), (5, "x x", "en", "b"), (5, "x x", "en", "b"), (None, "y", "en", "c"), (900, "w " * 4_000, "en", "hot")]
    got = m.mix_sources(documents(rows)).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all() and (got["taken"] == got["copies"] * got["size"]).all()
    for _, mine in got.groupby("source", dropna=False):
        assert mine["source_size"].iloc[0] == mine["size"].sum()
        assert abs(mine["taken"].sum() - mine["target"].iloc[0]) <= 0.02 * mine["target"].iloc[0] + 2
    again = m.mix_sources(documents(rows[::-1])).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert m.mix_sources(documents(rows).limit(0)).collect() == []


def test_repeated_rows_fill_no_block(documents, monkeypatch):
    """30,000 rows of one null id and size, and 5,000 of another: no flight sees more than its block, and the mix stays near its targets."""
    real = m._flight

    def flight(level, last):
        run = real(level, last)
        return lambda pdf: run(pdf) if len(pdf) <= 300 else 1 / 0

    monkeypatch.setattr(m, "_flight", flight)
    monkeypatch.setattr(m, "BLOCK", 200)
    monkeypatch.setattr(m, "FAN", 100)
    rng = np.random.default_rng(4)
    df = documents([(i, "w " * int(rng.integers(1, 60)), "en", "hot") for i in range(1000)] + [(None, "x y z", "en", "hot"), (7, "x y", "en", "b")])
    df = df.withColumn("k", m.F.explode(m.F.expr("IF(doc_id IS NULL, sequence(1, 30000), IF(doc_id = 7 AND source = 'b', sequence(1, 5000), array(1)))"))).drop("k")
    got = m.mix_sources(df).toPandas()
    assert len(got) == 36_000 and (got["taken"] <= 3 * got["size"]).all()
    for _, mine in got.groupby("source"):
        assert abs(mine["taken"].sum() - mine["target"].iloc[0]) <= 0.001 * mine["target"].iloc[0] + 2
    none = got[got["doc_id"].isna()]["copies"]
    assert len(none) == 30_000 and none.max() - none.min() <= 1


def test_too_many_sources(documents, monkeypatch):
    monkeypatch.setattr(m, "MOST_SOURCES", 2)
    with pytest.raises(ValueError):
        m.mix_sources(documents([(i, "x", "en", f"s{i}") for i in range(3)]))
