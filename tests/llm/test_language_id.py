import math
import random
import zlib

import numpy as np
import pyarrow as pa

from tideframe.llm import language_id as li

EN = "the people of this town have always been kind to those who travel through the valley in winter".split()
FR = "les gens de cette ville ont toujours été aimables avec ceux qui traversent la vallée en hiver".split()


def rows(n=120):
    rng = random.Random(1)
    made = [(i, " ".join(rng.choices(FR if i % 2 else EN, k=12)), "fr" if i % 2 else "en") for i in range(n)]
    return made + [(500, None, "en"), (501, "12 34 !?", "fr"), (502, "", None), (502, "", None), (None, "the people", "en"), (503, "ville " * 30_000, None), (504, "漢字" * 100, None)]


def test_held_out(documents):
    got = li.classify(documents(rows())).collect()
    assert len(got) == len(rows())
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 1) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == ("fr" if i % 2 else "en") for i in range(120))
    assert [by[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and by[503]["lang_pred"] == "fr" and by[504]["lang_pred"] in ("en", "fr")
    assert all(0 <= r["score"] <= 1 for r in got)


PIECES = li._pieces(li.default_path())
KNOWN = {PIECES.id_to_piece(k): k for k in range(PIECES.get_piece_size()) if not (PIECES.is_control(k) or PIECES.is_unknown(k) or PIECES.is_byte(k))}


def table(rows):
    return pa.table({"lang": [r[0] for r in rows], "piece": pa.array([r[1] for r in rows], pa.int32()), "n": pa.array([r[2] for r in rows], pa.float64())})


def two_languages():
    return li.Model.of(table([("en", k, float(k % 7)) for k in range(300, 30_000, 3)] + [("fr", k, float(k % 5)) for k in range(300, 30_000, 2)]), li.default_path())


def segmentations(rest):
    """Every way to write the rest in pieces and uncovered code points."""
    if not rest:
        yield []
    for n in range(1, len(rest) + 1):
        if rest[:n] in KNOWN:
            yield from ([KNOWN[rest[:n]], *more] for more in segmentations(rest[n:]))
        if n == 1:
            yield from ([None, *more] for more in segmentations(rest[1:]))


def probability(segmentation, probs):
    return math.prod(li.UNSEEN if k is None else probs[k] for k in segmentation)


WORDS = ["the", "vallée", "a", "traversen", "ß", "漢字", "हिन्दी"]


def test_forward_sums_all_segmentations():
    model = two_languages()
    got = model.scorer().words(WORDS)
    for k, w in enumerate(WORDS):
        for lang in range(2):
            assert math.isclose(got[k, lang], math.log(sum(probability(x, model.probs[:, lang]) for x in segmentations("▁" + w))), rel_tol=1e-9)


def test_expected_counts():
    probs = two_languages().probs[:, 0]
    times = np.arange(1.0, len(WORDS) + 1)
    want = np.zeros(len(probs))
    for w, n in zip(WORDS, times):
        ways = [(x, probability(x, probs)) for x in segmentations("▁" + w)]
        total = sum(p for _, p in ways)
        for x, p in ways:
            for k in x:
                if k is not None:
                    want[k] += n * p / total
    assert np.allclose(li._vocabulary(li.default_path()).lattice(WORDS).expected(probs, times), want, rtol=1e-9, atol=1e-12)


def test_words_of_any_length(monkeypatch):
    """A word without end neither underflows nor is cut; rescaling changes nothing."""
    model = two_languages()
    words = ["漢字仮名" * 500, "abc" * 1000, "xyzzyxqqj" * 4, "traversent"]
    got = model.scorer().words(words)
    assert np.isfinite(got).all()
    twice = model.scorer().words(["漢字仮名" * 1000])
    assert np.allclose(twice[0], 2 * got[0], rtol=1e-2)
    expected = li._vocabulary(model.path).lattice(words).expected(model.probs[:, 0], np.ones(4))
    assert np.isfinite(expected).all() and expected.sum() > 500
    for stride in (1, 5):
        monkeypatch.setattr(li, "STRIDE", stride)
        assert np.allclose(model.scorer().words(words), got, rtol=1e-9)
        assert np.allclose(li._vocabulary(model.path).lattice(words).expected(model.probs[:, 0], np.ones(4)), expected, rtol=1e-6)


def test_letters():
    assert li.letters("हिन्दी में Ünïted e\u0301t 12²½_x-ray, İstanbul") == ["हिन्दी", "में", "ünïted", "e\u0301t", "x", "ray", "i\u0307stanbul"]
    assert li.letters("12 ² ½ Ⅷ _ \u0301") == [] and li.letters(None) == []
    assert li.letters("a" * 100) == ["a" * 100]


def test_quick_patterns_are_the_exact_one():
    rng = random.Random(3)
    exact = li._patterns()[0]
    for alphabet in ("aZ é1_-ÿ×÷ß²ª", "aZ é1_-²ß½Ⅷ\u0301हि\u200d中٣ ", "ab ’é\u0301x\u093f"):
        for _ in range(300):
            text = "".join(rng.choices(alphabet, k=12))
            assert li.letters(text) == exact.findall(text.lower())


def test_memo_bound_changes_nothing(monkeypatch):
    model = li.Model.of(table([("en", k, 1.0) for k in range(300, 3000)]), li.default_path())
    words = [["a", "bc", "def"], ["gh", "a"], ["x", "y" * 150, "z", "a"]]
    want = [li.Scorer(model).text(w) for w in words]
    monkeypatch.setattr(li, "MEMO_WORDS", 3)
    one = li.Scorer(model)
    for w in words:
        one.learn_block([w])
    assert np.allclose([one.text(w) for w in words], want) and model.scorer() is model.scorer()


def test_nothing_to_learn(documents):
    got = li.classify(documents([(1, "abc", None), (2, "def", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 2
    assert li.classify(documents(rows()).limit(0)).collect() == []
