import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideframe.llm import common as c

TEXTS = st.lists(st.none() | st.text(alphabet="ab é\t\n\x1c漢", max_size=14), max_size=7)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(0, 3))
def test_word_hashes_are_those_of_the_words(texts, lead):
    column = pa.array(["x y"] * lead + texts, pa.string()).slice(lead)
    hashes, first = c.word_hashes(*c.text_bytes(column))
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in words]
    seen = {}
    for h, w in zip(hashes.tolist(), [w for some in words for w in some]):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_fold_tells_sequences_apart():
    texts = ["a b", "b a", "a", "a a", "", "ab", "a  b", None]
    hashes, first = c.word_hashes(*c.text_bytes(pa.array(texts)))
    made = c.fold(hashes, first, 1).tolist()
    assert made[0] == made[6] and made[4] == made[7] and len(set(made)) == 6
    assert set(made).isdisjoint(c.fold(hashes, first, 2).tolist())


def test_blocks_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * 100, "", "z"] * 3)], ["t"])
    spans = list(c.text_blocks(batch, "t", 50))
    assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])] and spans[-1][1] == 15
    assert list(c.text_blocks(batch.slice(0, 0), "t")) == []


def test_written_and_bounds(spark):
    made = c.Written(spark.range(0).selectExpr("id", "'x' AS t"), "t")
    assert made.df.count() == 0 and made.df.columns == ["id", "t"] and made.path in c._live
    made.drop()
    assert made.path not in c._live
    assert "broadcast" in c.by_size(spark.range(3), 3)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in c.by_size(spark.range(3), c.BROADCAST_ROWS + 1)._jdf.queryExecution().logical().toString().lower()


def test_shared_folder(spark):
    """The session's folder, or one of our own in local mode; an error elsewhere. Nothing is set in the session."""

    class Fake:
        def __init__(self, master, where=None):
            self.sparkContext = type("C", (), {"master": master, "applicationId": "app"})()
            self.conf = type("F", (), {"get": staticmethod(lambda name, default=None: where)})()

    assert c.shared_dir(Fake("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert c.shared_dir(Fake("local[4]")).startswith("file:/") and c.shared_dir(Fake("local")) == c.shared_dir(Fake("local[*]"))
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            c.shared_dir(Fake(master))
    before = {k: spark.conf.get(k, None) for k in ("spark.checkpoint.dir", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    c.shared_dir(spark)
    assert before == {k: spark.conf.get(k, None) for k in before}
