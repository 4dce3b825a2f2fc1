"""Quality rules, line first: evaluate each line, remove failing lines, reject documents that lose too much.

The rules go by script-neutral signs (marks that end lines, symbols, separators,
arrows) and by lists of phrases, which are parameters. Only DataFrame functions
are used. All counting happens inside the row that holds the text: no explode,
no shuffle, whatever the table's size or skew.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CLASS

#: Characters counted as symbols; characters that part the entries of a menu; arrows.
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|·•"
ARROWS = "»›→≫"
#: Marks that end a sentence, a clause or a quotation, by script. Thai and Lao have none: there a letter ends a line.
TERMINAL = (
    ".!?:;\"')…‽"  # Latin, Greek, Cyrillic
    "”’›»“‘"  # closing quotation marks
    "։׃؛؟۔܀।॥෴๏๚๛།༎၊။"  # Armenian, Hebrew, Arabic, Syriac, Indic, Sinhala, Thai, Tibetan, Myanmar
    "።፧។៕᠃᠉᥄᥅꓿꘎꛳"  # Ethiopic, Khmer, Mongolian, Limbu, Lisu, Vai, Bamum
    "。！？．：；」』）》】〉｡"  # Chinese, Japanese, Korean
)
#: What may follow a menu word.
AFTER = r"([|>/»›-].*|[.:!…]*)"
UNMARKED = ("\u0e00", "\u0eff")
#: Openings of navigation lines, and phrases of boilerplate, in lower case; pass others for other languages.
NAVIGATION = (
    ("home", "menu", "login", "log in", "sign in", "sign up", "register", "next", "previous", "back to top", "search", "site map", "contact us", "about us")
    + ("startseite", "anmelden", "registrieren", "weiter", "zurück", "nach oben", "suche", "impressum", "kontakt", "über uns")
    + ("accueil", "connexion", "se connecter", "s'inscrire", "suivant", "précédent", "haut de page", "recherche", "plan du site", "contactez-nous", "à propos")
    + ("inicio", "iniciar sesión", "registrarse", "siguiente", "anterior", "volver arriba", "buscar", "mapa del sitio", "contacto", "acerca de")
)
BOILERPLATE = (
    ("all rights reserved", "privacy policy", "cookie policy", "use of cookies", "terms of use", "terms of service", "enable javascript", "lorem ipsum", "click here", "subscribe to our")
    + ("alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookie-richtlinie", "hier klicken")
    + ("tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "cliquez ici")
    + ("todos los derechos reservados", "política de privacidad", "términos de uso", "haga clic aquí")
)


@dataclass(frozen=True)
class QualityRules:
    """Thresholds of the verdict; the defaults are the production values."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    max_line_symbols: float = 0.10
    max_separators: int = 3
    #: A longer line that names a phrase of boilerplate is prose about it.
    max_phrase_chars: int = 300
    max_lost: float = 0.50
    navigation: tuple[str, ...] = NAVIGATION
    boilerplate: tuple[str, ...] = BOILERPLATE


def words_of(text: Column) -> Column:
    """The words of a text that is not null, in order: maximal runs without white space."""
    bare = F.trim(text, F.lit(WS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS_CLASS + "+"))


def sorted_pairs(hashes: Column) -> Column:
    """(hash, place) in order of the hash, so that equal hashes stand together."""
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def repeated_places(pairs: str) -> Column:
    """From the column of sorted pairs: the places, in order, of hashes that occur twice or more."""
    at = lambda i: F.get(F.col(pairs), i)["h"]
    twice = F.transform(pairs, lambda p, i: F.when((p["h"] == at(i - 1)) | (p["h"] == at(i + 1)), p["i"]))
    return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))


def count_of(text: Column, characters: str) -> Column:
    """How often any of the characters stands in a text (a regular expression's class; translate() is far slower)."""
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def alternatives(phrases: tuple[str, ...]) -> str:
    """A regular expression for any of the phrases."""
    return "|".join(re.sub(r"([\\.^$*+?{}\[\]|()])", r"\\\1", p) for p in phrases)


def line_verdicts(lines: Column, rules: QualityRules) -> Column:
    """For each line, whether no rule removes it; lines without a word stay.

    Punctuation: a mark of any script ends the line (a letter, in scripts without such
    marks), and symbols are few. Navigation: separators are few, no arrow ends the line but a
    quotation mark that was opened, and no menu word stands alone or before
    a separator. Boilerplate: a short line holds none of its phrases.
    """

    menu_word, phrase = f"^({alternatives(rules.navigation)})\\s*{AFTER}$", alternatives(rules.boilerplate)

    def passes(bare: Column) -> Column:
        last, low = F.right(bare, F.lit(1)), F.lower(bare)
        ended = F.contains(F.lit(TERMINAL), last) | last.between(*UNMARKED)
        arrow = F.contains(F.lit(ARROWS), last) & (F.instr(bare, "«") == 0) & (F.instr(bare, "‹") == 0)
        symbols = count_of(bare, SYMBOLS) <= rules.max_line_symbols * F.length(bare)
        menu = count_of(bare, SEPARATORS) < rules.max_separators
        said = (F.length(bare) <= rules.max_phrase_chars) & (low.rlike(menu_word) | low.rlike(phrase))
        return (bare == "") | (ended & ~arrow & symbols & menu & ~said)

    return F.transform(F.transform(lines, lambda x: F.trim(x, F.lit(WS))), passes)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """One row for each row: the base counts, base_failed, the cleaned text, what was lost, kept.

    A null text is empty: no words, hence base_failed. Rows are judged alone,
    so ties and repeated rows each get their own verdict; an empty table gives
    no rows; other columns of the table are ignored, whatever their names.
    """
    size = rules.window
    one = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    two = one.select("doc_id", "t", words_of(F.col("t")).alias("w"), F.split("t", "\n").alias("l"))
    at = lambda i: F.get(F.col("w"), i)
    windows = F.transform(F.slice("w", 1, F.greatest(F.size("w") - (size - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(at(i + k) for k in range(1, size))))
    worded = F.filter("l", lambda x: F.trim(x, F.lit(WS)) != "")
    chars = F.length(F.array_join("w", "")).cast("long")
    three = two.select("doc_id", "t", "l", F.size("w").cast("long").alias("n_words"), chars.alias("chars"), windows.alias("h"), worded.alias("lw"))
    # Each lambda below reads columns made by the select before it: an expression inside a lambda would be computed anew for each element.
    pairs = F.when(F.size("h") != F.size(F.array_distinct("h")), sorted_pairs(F.col("h")))
    three = three.select("doc_id", "t", "l", "n_words", "chars", "lw", pairs.alias("hi"))
    four = three.select("doc_id", "t", "l", "n_words", "lw", "chars", repeated_places("hi").alias("p"), line_verdicts(F.col("l"), rules).alias("v"))
    cover = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(size), F.coalesce(F.get("p", i + 1) - x, F.lit(size)))), F.lit(0).cast("long"), lambda a, x: a + x)
    kept = F.filter("l", lambda x, i: F.get(F.col("v"), i))
    gone = F.filter("l", lambda x, i: ~F.get(F.col("v"), i))
    five = four.select(
        "doc_id",
        "n_words",
        F.col("chars").alias("word_chars"),
        count_of(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lw") - F.size(F.array_distinct("lw"))).cast("long").alias("n_dup_lines"),
        F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array_join(kept, "\n").alias("cleaned"),
        F.size(gone).cast("long").alias("n_lines_removed"),
        F.length(F.regexp_replace(F.array_join(gone, ""), WS_CLASS, "")).cast("long").alias("lost_chars"),
    )
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    six = five.withColumn("base_failed", failed)
    return six.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= rules.max_lost * F.col("word_chars")))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "lost_chars"]

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT rid, i, w[i:i + 4] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
j AS (SELECT rid, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
k AS (SELECT *, right(bare, 1) AS last, lower(bare) AS low FROM j),
v AS (SELECT rid, line, bare,
        length(regexp_replace(bare, '[\x20\x09-\x0D]', '', 'g')) AS n,
        bare = '' OR ((contains({_quoted(TERMINAL)}, last) OR last BETWEEN chr(3584) AND chr(3839))
          AND NOT (contains({_quoted(ARROWS)}, last) AND NOT contains(bare, '«') AND NOT contains(bare, '‹'))
          AND length(regexp_replace(bare, '[^{SYMBOLS}]', '', 'g')) <= 0.10::DOUBLE * length(bare)
          AND length(regexp_replace(bare, '[^{SEPARATORS}]', '', 'g')) < 3
          AND NOT (length(bare) <= 300 AND (regexp_matches(low, {_quoted(f"^({alternatives(NAVIGATION)})")} || '\s*{AFTER}$') OR regexp_matches(low, {_quoted(alternatives(BOILERPLATE))})))) AS good
      FROM k),
s AS (SELECT rid, count(*) FILTER (bare <> '') - count(DISTINCT line) FILTER (bare <> '') AS n_dup_lines,
        count(*) FILTER (NOT good) AS n_lines_removed, coalesce(sum(n) FILTER (NOT good), 0)::BIGINT AS lost_chars FROM v GROUP BY rid),
b AS (SELECT doc_id, len(w.w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, n_lines_removed, lost_chars
      FROM d JOIN w USING (rid) JOIN s USING (rid) LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost_chars <= 0.5::DOUBLE * word_chars AS kept, n_lines_removed, lost_chars
FROM f
"""
