import re

import numpy as np
import pyarrow as pa
import pytest

from tideframe.llm import near_dup as nd
from tideframe.llm.common import text_bytes

RNG = np.random.default_rng(9)
WORDS = ["".join(RNG.choice(list("abcdefghijklm"), 4)) for _ in range(800)]


def prose(n):
    return RNG.choice(WORDS, n).tolist()


def edited(words, n):
    words = list(words)
    for at in RNG.integers(0, len(words), n):
        words[at] = str(RNG.choice(WORDS))
    return words


def weights(text, idf):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    gain = {w: g for w, g in zip(words, idf(words))}
    n = min(len(words), 5)
    out = {}
    for i in range(len(words) - n + 1 if words else 0):
        gram = tuple(words[i : i + n])
        out[gram] = out.get(gram, 0) + 1 + float(np.mean([gain[w] for w in gram]))
    return out


def jaccard(a, b):
    common = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
    return common / (sum(a.values()) + sum(b.values()) - common) if a and b else 0.0


def classes(texts, idf, similarity=nd.SIMILARITY):
    sets = [weights(t, idf) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= similarity - 1e-9:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def idf_of(table):
    from tideframe.llm.common import word_hashes

    def idf(words):
        if not words:
            return []
        hashes, _ = word_hashes(*text_bytes(pa.array([" ".join(words)])))
        return nd.word_gain(hashes, table)

    return idf


def corpus():
    texts = [" ".join(prose(80)) for _ in range(30)]
    for k in range(20):
        texts += [" ".join(edited(texts[k].split(), n)) for n in (1, 2, 4)]
    base = prose(120)  # a large group: edits of one text, itself not the first
    texts += [" ".join(edited(base, 2)) for _ in range(60)] + [" ".join(base)] + [" ".join(edited(base, 2)) for _ in range(20)]
    return texts + [texts[0]] * 15 + ["a b", "a b", "a b c", " a  b ", "", "", None, None, "x"]


def test_classes_against_brute_force(documents):
    texts = corpus()
    df = documents(list(enumerate(texts)))
    table = nd.word_idf(df, "text")
    want = classes(texts, idf_of(table))
    got = {r["rid"]: r["class_id"] for r in nd.near_duplicates(df).collect()}
    assert len(got) == len(texts)
    assert [got[i] for i in range(len(texts))] == want
    kept = nd.keep_first(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_near_pairs_in_large_buckets_only(documents, monkeypatch):
    """A template family whose texts share all bands: planted pairs, of which most have no pivot on either side."""
    monkeypatch.setattr(nd, "BLOCK_NODES", 16, raising=False)
    real = nd.sketch
    monkeypatch.setattr(nd, "sketch", lambda docs, idf: real(docs, idf).selectExpr("rid", "x", "fa", "fb", "w", "IF(bands IS NULL, NULL, sequence(1L, 12L)) AS bands"))
    passage, texts = prose(170), []
    for _ in range(30):
        text = passage + prose(40)
        texts += [" ".join(text), " ".join(text[:-1])]
    df = documents(list(enumerate(texts)))
    want = classes(texts, idf_of(nd.word_idf(df, "text")))
    got = {r["rid"]: r["class_id"] for r in nd.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) == 30


def test_block_links_against_brute_force(monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_ELEMENTS", 50)
    base = prose(60)
    texts = [" ".join(edited(base, n)) for n in (0, 0, 1, 2, 3, 4, 9)] + [" ".join(base * 2), " ".join(prose(40)), "", "w " * 9, "w " * 10]
    table = np.linspace(0, 0.1, nd.SKETCHES * nd.BUCKETS).astype(np.float32).reshape(nd.SKETCHES, -1)
    sets = [weights(t, idf_of(table)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            found = nd.block_links(pa.array([a]), pa.array([b]), np.array([1]), np.array([2]), table, 0.8)
            assert bool(found) == (jaccard(sets[i], sets[j]) >= 0.8 - 1e-9), (i, j)


def test_similarity_and_sampling():
    texts = [" ".join(prose(60))]
    texts += [" ".join(edited(texts[0].split(), n)) for n in range(1, 12)] + [texts[0] + " " + texts[0]]
    table = np.linspace(0, 0.1, nd.SKETCHES * nd.BUCKETS).astype(np.float32).reshape(nd.SKETCHES, -1)
    a, b = pa.array([texts[0]] * len(texts)), pa.array(texts)
    made = nd.similarities(a, b, table)
    sets = [weights(t, idf_of(table)) for t in texts]
    assert np.allclose(made, [jaccard(sets[0], s) for s in sets], atol=1e-6)
    # many seeds: the share of equal samples estimates the similarity
    first, hashes, weight, *_ = nd.shingles(*text_bytes(b), table)
    seeds, nd._SEEDS = nd._SEEDS, nd.mix(np.arange(1, 1500, dtype=np.uint64) * np.uint64(77777777777777777))
    try:
        samples = nd.icws(first, hashes, weight)
    finally:
        nd._SEEDS = seeds
    assert np.abs((samples == samples[0]).mean(axis=1) - made).max() < 0.05


def test_pruned_sampling_is_the_full_one(monkeypatch):
    texts = pa.array([" ".join(prose(n)) for n in (1, 3, 5, 6, 40, 700)] + [None, " ".join(["same"] * 50)])
    first, hashes, weight, *_ = nd.shingles(*text_bytes(texts), np.full((nd.SKETCHES, nd.BUCKETS), 0.05, np.float32))
    pruned = nd.icws(first, hashes, weight)
    monkeypatch.setattr(nd, "REACH", 1e6)
    assert (pruned == nd.icws(first, hashes, weight)).all() and (pruned[6] == 0).all()


def test_connected_on_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 103), (101, 103)], "a long, b long")
    got = {r["node"]: r["comp"] for r in nd.connected(links, "t").df.collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_sketch_of_words_beyond_its_columns(documents, monkeypatch):
    """With fewer columns than words, the least of three counts is nearer to the true one than a single one, and never below it."""
    monkeypatch.setattr(nd, "BUCKETS", 512)
    monkeypatch.setattr(nd, "_column", lambda words, k: (words >> np.uint64(17 * k) & np.uint64(511)).astype(np.int64))
    texts = [" ".join(set(prose(12))) for _ in range(60)]
    table = nd.word_idf(documents(list(enumerate(texts))), "text", 1.0)
    df = {w: sum(w in t.split() for t in texts) for t in texts for w in t.split()}
    words = sorted(df)
    true = np.log(61 / (1 + np.array([df[w] for w in words]))) / np.log(61)
    made = np.array(idf_of(table)(words))
    hashes, _ = nd.word_hashes(*text_bytes(pa.array([" ".join(words)])))
    assert (made <= true + 1e-6).all() and np.abs(made - true).mean() < 0.8 * np.abs(table[0][nd._column(hashes, 0)] - true).mean()


def test_a_group_of_a_thousand(documents):
    """Copies of one text with a few edits, itself not among them: near the bound on both sides; brute force by matrix."""
    base = prose(90)
    texts = [" ".join(edited(base, int(n))) for n in RNG.integers(0, 4, 1100)] + [" ".join(edited(base, 8)) for _ in range(60)]
    df = documents(list(enumerate(texts)))
    idf = idf_of(nd.word_idf(df, "text"))
    sets = [weights(t, idf) for t in texts]
    names = {g: k for k, g in enumerate(dict.fromkeys(g for s in sets for g in s))}
    gain, has = np.zeros(len(names)), np.zeros((len(texts), len(names)), np.float32)
    for k, s in enumerate(sets):
        for g, w in s.items():
            gain[names[g]], has[k, names[g]] = w, 1
    total = has @ gain
    common = (has * gain.astype(np.float32)) @ has.T
    near = common / (total[:, None] + total[None, :] - common) >= nd.SIMILARITY
    want = np.arange(len(texts))
    while True:
        new = np.where(near, want[None, :], len(texts)).min(axis=1)
        if (new == want).all():
            break
        want = new
    got = {r["rid"]: r["class_id"] for r in nd.near_duplicates(df).collect()}
    assert 1 < len(set(want.tolist())) < 1000
    assert [got[i] for i in range(len(texts))] == want.tolist()


def test_ids_null_and_shared(documents):
    text, one, two = (" ".join(prose(30)) for _ in range(3))
    rows = [(None, text), (5, text), (5, text), (6, one), (6, two), (7, "w " * 40_000), (8, "w " * 40_000)]
    df = documents(rows)
    got = sorted((r["rid"] < 0, r["class_id"] < 0, r["rid"] if r["rid"] > 0 else 0) for r in nd.near_duplicates(df).collect())
    assert len(got) == 7 and sum(c for _, c, _ in got) == 5  # the null id's class, and one for each text of id 6
    kept = sorted((str(r["doc_id"]), r["text"][:30]) for r in nd.keep_first(df).collect())
    assert kept == sorted([("6", one[:30]), ("6", two[:30]), ("7", "w " * 15), ("None", text[:30])])
    assert nd.near_duplicates(df.limit(0)).collect() == [] and nd.keep_first(df.limit(0)).collect() == []


def test_repeated_ids_keep_their_links(spark, documents):
    a, b = prose(60), prose(60)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(edited(a, 1))), (3, " ".join(edited(b, 1))), (4, ""), (4, " ".join(prose(20)))]
    df = documents(rows)
    found = {}
    for r in nd.near_duplicates(df).collect():
        found.setdefault(r["class_id"], []).append(r["rid"])
    assert sorted(map(sorted, found.values())) == [[1, 2], [1, 3], [4], [4]]
    kept = sorted((r["doc_id"], r["text"]) for r in nd.keep_first(df).collect())
    assert len(kept) == 4 and kept[2:] == sorted([(4, ""), rows[5]])
    # rows that repeat id and text, with other columns that differ: one stays, the same in each run
    more = df.where("doc_id = 3").selectExpr("doc_id", "text", "lang", "source", "explode(sequence(1L, 40L)) AS n_chars")
    runs = [[r["n_chars"] for r in nd.keep_first(more.repartition(n)).collect()] for n in (1, 7)]
    assert len(runs[0]) == 1 and runs[0] == runs[1]


@pytest.mark.parametrize("n", [0, 1])
def test_tiny(documents, n):
    assert nd.near_duplicates(documents([(1, "a b c d e f")]).limit(n)).count() == n
