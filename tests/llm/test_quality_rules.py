import re
from collections import Counter

from tideframe.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "a b c d e a b c d e a b c d e",
    "a b c d e f g h i j k l m n o.",
    " x y z w v u t s r q p.\nline two ends here.\nline two ends here.\n line two ends here.",
    "Home | About | Login | Next\nThis is a clean line with enough words to be kept whole.\n\n\x0b\x0cAll rights reserved.",
    "x x x x x x x x x x x x x x x x",
    "\n".join(f"word{i} goes{i} on{i} with more words {i * 7} and x{i} here." for i in range(3000)),
    "no end mark in this long line of words at all which goes on",
]


def test_base_counts(documents):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, ""), (None, "a b c")]
    got = q.quality_rules(documents(rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(TEXTS):
        r = by[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), i


def test_lines_then_documents(documents):
    got = {r["doc_id"]: r for r in q.quality_rules(documents([(i, t) for i, t in enumerate(TEXTS)])).collect()}
    assert got[7]["cleaned"] == "This is a clean line with enough words to be kept whole.\n"
    assert got[7]["kept"] and got[9]["kept"] and got[5]["kept"]
    assert not got[10]["kept"] and not got[10]["base_failed"]


CLEAN = {
    "hi": "यह एक साफ़ वाक्य है जिसमें पर्याप्त शब्द हैं और यह यहाँ समाप्त होता है।\nदूसरा वाक्य भी यहाँ ठीक से समाप्त होता है॥",
    "zh": "今天 天气 很好 ， 我们 一起 去 公园 散步 吧 。\n然后 我们 回家 吃饭 ！",
    "ar": "هل تعرف ما هو الجواب الصحيح لهذا السؤال الذي طرحته عليك أمس؟\nهذه جملة كاملة تنتهي هنا.",
    "th": "วันนี้ อากาศ ดี มาก เรา ไป เดิน เล่น ที่ สวน กัน ดี ไหม\nแล้ว กลับ บ้าน",
    "am": "ይህ ንጹህ ዓረፍተ ነገር ነው እና በቂ ቃላት አሉት እዚህ ያበቃል ብዬ አስባለሁ።",
    "fr": "Il a dit que la « politique de confidentialité » était longue, et puis il est parti sans un mot de plus, ce qui a surpris tout le monde dans la salle, car personne ne s'y attendait vraiment ce jour-là, ni les uns ni les autres, malgré tous les signes qui auraient dû les alerter bien avant que cela n'arrive enfin.\nElle répondit «oui»",
}
JUNK = ["Next »", "Weiter ›", "Accueil > Recherche", "Home", "1 · 2 · 3 · 4.", "© 2020 Alle Rechte vorbehalten.", "Cliquez ici.", "no mark at the end", "$$$ %%% ###."]


def test_scripts_and_phrases(documents):
    got = {r["doc_id"]: r for r in q.quality_rules(documents(list(enumerate([*CLEAN.values(), "\n".join(JUNK)])))).collect()}
    for k, lang in enumerate(CLEAN):
        assert got[k]["cleaned"] == CLEAN[lang] and got[k]["kept"], lang
    assert got[len(CLEAN)]["cleaned"] == "" and not got[len(CLEAN)]["kept"]
    other = q.QualityRules(navigation=("etusivu",), boilerplate=("kaikki oikeudet",))
    one = q.quality_rules(documents([(1, "Etusivu.\nHome.\nKaikki oikeudet pidätetään.\nClick here.")]), rules=other).first()
    assert one["cleaned"] == "Home.\nClick here."


def test_empty_table(documents, spark):
    assert q.quality_rules(documents([(1, "x")]).limit(0)).collect() == []
