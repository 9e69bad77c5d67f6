"""Line-first cleaning and document quality rules, in DataFrame expressions only.

Each line is judged by itself: symbols among its characters, shouting,
navigation separators, the share of boilerplate phrases, and short fragments without a
sentence end. Failing lines are removed, and a document that loses too much of
its text with them is rejected, as is one that fails the base rules (too few
words, or too much of it in repeated eight-word windows).

Everything is one projection over the row: no shuffle, no Python. Repeated
windows are found by hash: only texts that hold a repeated hash are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of the line rules.
SPACES = r"[\x20\x09-\x0D]"
NO_SYMBOL = r"[^#*$%&|<>]+"
NOT_UPPER = r"[^\p{Lu}]+"
NAVIGATION = r"(^|\s)[|»›](\s|$)"
SENTENCE_END = "[.!?…:;\"'”’»)\\]。！？]\\s*$"
#: Phrases of boilerplate by language, as regular expressions that begin with an ASCII letter.
BOILERPLATE = {
    "en": (
        "all rights reserved", "privacy policy", "terms of (?:use|service)", "cookie (?:policy|settings)", "click here", "subscribe (?:now|to our)", "sign (?:in|up) to",
        "enable javascript", "skip to (?:main )?content", "powered by", "back to top", "read more",
    ),
    "fr": ("tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "gestion des cookies", "cliquez ici", "lire la suite", "retour en haut"),
    "de": ("alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookie-einstellungen", "hier klicken", "weiterlesen", "nach oben"),
    "es": ("todos los derechos reservados", "política de privacidad", "aviso legal", "condiciones de uso", "haga clic aquí", "leer más", "volver arriba"),
}


def boilerplate_pattern(phrases: dict[str, tuple[str, ...]]) -> str:
    """One pattern over lower-cased lines of all languages' phrases: a line is judged by what it says, not by the language it is marked with."""
    return rf"\b(?:{'|'.join(x for said in phrases.values() for x in said)})"


WINDOW = 8


def line_fails(
    line: Column,
    symbol_share: float = 0.05,
    upper_share: float = 0.5,
    short_words: int = 5,
    boilerplate_share: float = 0.5,
    phrases: dict[str, tuple[str, ...]] = BOILERPLATE,
) -> Column:
    """Whether a line with words breaks a line rule; a blank line never does.

    Boilerplate phrases break it where they make up ``boilerplate_share`` of
    its characters, however long it is; prose that mentions one stays.
    """
    chars = F.length(F.regexp_replace(line, SPACES + "+", ""))
    symbols = F.length(F.regexp_replace(line, NO_SYMBOL, ""))
    upper = F.length(F.regexp_replace(line, NOT_UPPER, ""))
    words = F.size(F.split(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), SPACES + "+"))
    low, pattern = F.lower(line), boilerplate_pattern(phrases)
    # Few lines hold a phrase at all; only these are measured.
    rest = F.length(F.regexp_replace(F.regexp_replace(low, pattern, ""), SPACES + "+", ""))
    boilerplate = F.when(low.rlike(pattern), chars - rest >= boilerplate_share * chars).otherwise(False)
    broken = (
        (symbols > symbol_share * chars)
        | ((upper > upper_share * chars) & (chars >= 8))
        | line.rlike(NAVIGATION)
        | boilerplate
        | (~line.rlike(SENTENCE_END) & (words < short_words))
    )
    return (chars > 0) & broken


def judge(
    docs: DataFrame,
    min_words: int = 20,
    max_repeat: int = 30,
    max_lost: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, tuple[str, ...]] = BOILERPLATE,
) -> DataFrame:
    """Per row: the id, counts, verdicts and the cleaned text.

    Columns: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``n_lines``, ``n_lines_removed`` (long),
    ``lost`` (share of the word characters in removed lines, double),
    ``base_failed``, ``kept`` (boolean), ``clean_text`` (lines that stay).

    A null or empty text has no words: it fails the base rules. Repeated rows
    and null ids come back as they are. Texts of any length are judged whole.
    An empty table gives an empty result. Other columns are not read.
    """
    some = F.filter(F.split("text", SPACES + "+"), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Each step is used several times by the next, so that no step is folded into the loops of another.
    rows = rows.select("id", "text", some.alias("words"), F.split("text", "\n", -1).alias("lines"))
    starts = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    windows = F.when(F.size("words") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    spoken = F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "id", "text", F.size("words").alias("n_words"), windows.alias("hashes"), spoken.alias("spoken"), "lines",
        F.transform("lines", lambda x: line_fails(x, phrases=phrases)).alias("fails"),
    )
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    ranked = F.when(repeats, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    plain = lambda c: F.regexp_replace(c, SPACES + "+", "")
    gone = F.filter("lines", lambda x, i: F.get("fails", i))
    rows = rows.select(
        "id", "n_words", ranked.alias("ranked"),
        F.length(plain(F.col("text"))).alias("word_chars"),
        F.length(F.regexp_replace("text", NO_SYMBOL, "")).alias("n_symbols"),
        (F.size("spoken") - F.size(F.array_distinct("spoken"))).alias("n_dup_lines"),
        F.size("lines").alias("n_lines"), F.size(F.filter("fails", lambda x: x)).alias("n_lines_removed"),
        F.length(plain(F.array_join(gone, " "))).alias("lost_chars"),
        F.array_join(F.filter("lines", lambda x, i: ~F.get("fails", i)), "\n").alias("clean_text"),
    )
    same = lambda x, i: F.coalesce(F.get("ranked", i)["h"] == x["h"], F.lit(False))
    again = F.filter("ranked", lambda x, i: same(x, i - 1) | same(x, i + 1))
    rows = rows.withColumn("at", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("ranked")
    covered = F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - p, F.lit(WINDOW))))
    rows = rows.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("at")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    lost = F.when(F.col("word_chars") > 0, F.col("lost_chars") / F.col("word_chars")).otherwise(0.0)
    rows = rows.withColumns({"base_failed": failed, "lost": lost})
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_lines_removed")
    return rows.select(F.col("id").alias(id_col), *(F.col(x).cast("long").alias(x) for x in longs), "lost", "base_failed", (~F.col("base_failed") & (F.col("lost") <= max_lost)).alias("kept"), "clean_text")
