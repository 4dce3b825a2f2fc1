import numpy as np
import pyarrow as pa
import pytest

from tideframe.llm import decontaminate as dc
from tideframe.llm.common import text_bytes

RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdefghijklm"), 5)) for _ in range(3000)] + ["the", "of"] * 300


def prose(n):
    return RNG.choice(WORDS, n).tolist()


def edited(words, edits, kind=None):
    words = list(words)
    for _ in range(edits):
        at, what = int(RNG.integers(0, len(words))), int(RNG.integers(0, 3)) if kind is None else kind
        if what == 0:
            words[at] = str(RNG.choice(WORDS))
        elif what == 1:
            del words[at]
        else:
            words.insert(at, str(RNG.choice(WORDS)))
    return words


def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for k, a in enumerate(item, 1):
        new = [k]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_edit_distance():
    for _ in range(60):
        item, text = RNG.integers(0, 6, RNG.integers(1, 12)), RNG.integers(0, 6, RNG.integers(0, 20))
        edits, end = dc.edit_distance(item, text)
        assert edits == slow_distance(item.tolist(), text.tolist())
        assert slow_distance(item.tolist(), text[:end].tolist()) == edits


def test_recall_at_every_allowed_number_of_edits(spark, documents):
    """Every edited copy within the allowed edits, by brute force, against what is found."""
    items = [prose(int(RNG.integers(8, 60))) for _ in range(60)]
    rows, planted = [], []
    for i, item in enumerate(items * 4):
        edits = i % (dc.edits_allowed(len(item)) + 1)
        copy = " ".join(edited(item, edits))
        copy = copy.upper() if i % 5 == 0 else copy.replace(" ", ", ", 3) if i % 5 == 1 else copy
        rows.append((i, " ".join(prose(40)) + "\n" + copy + ". " + " ".join(prose(30))))
        planted.append((i, i % 60))
    rows += [(1000 + i, " ".join(prose(300))) for i in range(60)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in dc.find_leaks(documents(rows), bench).collect()}
    text = {d: t.lower().replace(",", "").replace(".", "").split() for d, t in rows}
    true = {p: d for p in planted if (d := slow_distance(items[p[1]], text[p[0]])) <= dc.edits_allowed(len(items[p[1]]))}
    assert len(true) > 220 and len(set(true) & set(got)) >= 0.99 * len(true)
    assert all(got[p] == d for p, d in true.items() if p in got)
    assert not set(got) - set(true)


def found_rows(index, texts):
    words, first = dc.words_of(*text_bytes(pa.array(texts)))
    return index.search(words, first), words, first


@pytest.mark.parametrize("kind", [0, 1, 2])
@pytest.mark.parametrize("n", [8, 12, 20, 30, 40, 50, 60, 61, 100, 150, 200, 300, 500])
def test_recall_of_each_length_number_and_kind_of_edits(n, kind):
    """0 replaces words, 1 deletes, 2 inserts; each cell is searched on its own, and the edits found are the least."""
    most, copies = dc.edits_allowed(n), 20 if n <= 100 else 10
    item = prose(n)
    index = dc.Index([" ".join(item)])
    for edits in range(most + 1) if n <= 60 else {0, most // 4, most // 2, 3 * most // 4, most}:
        rows, words, first = found_rows(index, [" ".join(prose(30) + edited(item, edits, kind) + prose(30)) for _ in range(copies)])
        assert len(rows) >= 0.9 * copies, (n, kind, edits, len(rows))
        for row, _, d, end in rows:
            least, at = dc.edit_distance(index.words[0], words[first[row] : first[row + 1]])
            assert (d, end) == (least, at + first[row])


def test_short_items_and_unspaced_scripts():
    texts = ["What is the capital of France", "yes", "今天天气很好我们去公园散步吧", "短句", "", "...", "what is THE capital, of France?", "สวัสดีชาวโลกวันนี้อากาศดี"]
    index = dc.Index([t.lower() for t in texts])
    docs = ["So what is the capital of france, they asked.", "eyes", "Yes.", "他说：今天天气很好，我们去公园散步吧。然后走了", "他说今天天气太好我们去公园散步吧", "长短句子", "what is the capital city of france", "— สวัสดีชาวโลก วันนี้อากาศดี —", None, ""]
    rows, *_ = found_rows(index, [d and d.lower() for d in docs])
    assert sorted((r, i, d) for r, i, d, _ in rows) == [(0, 0, 0), (0, 6, 0), (2, 1, 0), (3, 2, 0), (4, 2, 1), (5, 3, 0), (7, 7, 0)]


def test_words_of_many_scripts():
    texts = ["a “quoted” word… it’s", "naïve café", "हिन्दी वाक्य।", "中a文", "\U00020000x😀y", "مرحبا؟", "", None]
    _, first = dc.words_of(*text_bytes(pa.array(texts)))
    assert np.diff(first).tolist() == [5, 2, 2, 3, 3, 1, 0, 0]
    one, _ = dc.words_of(*text_bytes(pa.array(["“word” 文"])))
    two, _ = dc.words_of(*text_bytes(pa.array(["文 word"])))
    assert one.tolist() == two.tolist()[::-1]


def test_recall_of_long_items_at_the_bound():
    """500 words with an edit at 100 places."""
    item = prose(500)
    copies = [list(item) for _ in range(12)]
    for copy in copies:
        for at in RNG.choice(500, 100, replace=False):
            copy[at] = f"edit{at}"
    rows, *_ = found_rows(dc.Index([" ".join(item)]), [" ".join(prose(30) + c + prose(30)) for c in copies])
    assert len(rows) == 12


def test_edge_cases(spark, documents, monkeypatch):
    item = prose(12)
    bench = [(1, " ".join(item)), (2, " ".join(item)), (3, None), (4, ""), (5, "... !"), (None, " ".join(prose(20))), (6, " ".join(prose(130)))]
    bench = spark.createDataFrame([(*b, 0) for b in bench], "item_id long, text string, t int")
    rows = [(1, None), (2, ""), (3, " ".join(item)), (3, " ".join(item)), (None, "x " + " ".join(item)), (4, " ".join(prose(60_000)) + " " + " ".join(item)), (5, item[0]), (6, " ".join(item[:6])), (7, " ".join(item[6:]))]
    want = sorted([(str(d), k) for d in (3, 3, None, 4) for k in (1, 2)])
    docs = documents(rows)
    run = lambda: sorted((str(r["doc_id"]), r["item_id"]) for r in dc.find_leaks(docs, bench).collect())
    assert run() == want
    monkeypatch.setattr(dc, "ITEMS_A_PASS", 2)
    assert run() == want
    kept = dc.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 6, 7]
    many = spark.createDataFrame([(k, " ".join(item)) for k in range(3000)], "item_id long, text string")  # one text, many items
    assert dc.find_leaks(docs.where("doc_id = 4"), many).count() == 3000
    assert dc.find_leaks(docs.limit(0), bench).collect() == [] and dc.find_leaks(docs, bench.limit(0)).collect() == []
