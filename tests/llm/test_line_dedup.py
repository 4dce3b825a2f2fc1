from collections import defaultdict

from tideframe.llm import line_dedup as ld


def brute(rows, ratio, least):
    pages, on = defaultdict(int), defaultdict(int)
    for _, text, host in rows:
        pages[host] += 1
        for line in {x.strip(" \t\n\x0b\x0c\r") for x in (text or "").split("\n")} - {""}:
            on[host, line] += 1
    gone = {k for k, n in on.items() if n >= least and n > ratio * pages[k[0]]}
    return [(d, None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" \t\n\x0b\x0c\r")) not in gone)) for d, t, h in rows]


def test_against_brute_force(documents):
    rows = []
    for i in range(200):
        host = ["hot", "hot", None, "b"][i % 4]
        lines = [f"own line {i}", "  menu \t" if i % 3 else "menu", "rare" if i % 40 == 0 else f"other {i // 2}", "", "own" * (i % 5)]
        rows.append((i, "\n".join(lines), host))
    rows += [(7, None, "hot"), (8, "", "b"), (8, "", "b"), (None, "menu\nmenu", None), (9, "alone", "single"), (10, "long " * 50_000 + "\nmenu", "b")]
    got = ld.drop_lines(documents([(d, t, "en", h) for d, t, h in rows]), "source", "text", counts=("before", "gone"))
    assert got.columns[-2:] == ["before", "gone"] and "ks" not in got.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=key) == sorted(brute(rows, ld.MAX_RATIO, ld.MIN_PAGES), key=key)


def test_no_broadcast_is_the_same(documents, monkeypatch):
    rows = [(i, f"menu\nline {i}", "en", "h") for i in range(20)]
    monkeypatch.setattr(ld, "BROADCAST_ROWS", -1)
    assert {r["text"] for r in ld.drop_lines(documents(rows)).collect()} == {f"line {i}" for i in range(20)}


def test_empty(documents):
    assert ld.drop_lines(documents([(1, "x")]).limit(0)).collect() == []
