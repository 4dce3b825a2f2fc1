import zlib

import numpy as np
import pyarrow as pa

from tideframe.llm import quality_model as qm

RNG = np.random.default_rng(0)
WORDS = ["".join(RNG.choice(list("abcdefghij"), RNG.integers(2, 9))) for _ in range(400)]


def text(good):
    words = RNG.choice(WORDS, 60).tolist() if good else ["BUY!!"] * 20 + ["$$$"] * 10
    return " ".join(words) + "."


def tables(spark, documents, n=400):
    rows = [(i, text(i % 3 > 0)) for i in range(n)] + [(None, "x"), (7, None), (8, ""), (9, "BUY!! " * 50_000)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(n)] + [(None, 1, 0), (3, None, 0), (4, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    return documents(rows), labels, rows


def test_held_out_accuracy(spark, documents):
    docs, labels, rows = tables(spark, documents)
    got = qm.classify(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] not in (None, 7, 8, 9)]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0) for r in got)
    assert len(held) > 40 and np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_labels_of_the_held_out_fold_do_not_matter(spark, documents):
    docs, labels, _ = tables(spark, documents)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    a, b = (sorted((str(r["doc_id"]), r["score"]) for r in qm.classify(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_flat_trees_equal_a_walk():
    x, y = RNG.random((500, 4)), RNG.integers(0, 2, 500).astype(float)
    trees = qm.learn(np.column_stack([x, x[:, :1] + 0.2 * y[:, None]]), y, 10)
    sample = RNG.random((50, 5)) * 1.3

    def walk(row):
        total = trees.base
        for t in range(len(trees.value)):
            k = 0
            while trees.left[t, k] != k:
                k = trees.left[t, k] if row[trees.feature[t, k]] <= trees.cut[t, k] else trees.right[t, k]
            total += trees.value[t, k]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.scores(sample), [walk(r) for r in sample])


def test_features_do_not_depend_on_neighbours():
    texts = ["a b a b", None, "", "One.\nOne.\nTwo", "é é", " lead", "trail \n", "$#% 12"]
    whole = qm.features(pa.array(texts))
    assert whole.shape == (len(texts), len(qm.NAMES)) and np.isfinite(whole).all()
    for k, t in enumerate(texts):
        assert np.allclose(qm.features(pa.array([t], pa.string()))[0], whole[k])
    assert np.isclose(whole[0][qm.NAMES.index("distinct")], 0.5) and np.isclose(whole[3][qm.NAMES.index("dup_lines")], 1 / 3)


def test_keep_good_and_nothing_to_learn(spark, documents):
    docs, labels, rows = tables(spark, documents)
    kept = qm.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert 1 in ids and 2 in ids and not {6, 12, 15, 18} & ids
    none = qm.classify(docs, labels.limit(0)).collect()
    assert len({r["score"] for r in none}) == 1 and len(none) == len(rows)
    assert qm.classify(docs.limit(0), labels).collect() == []
