import re
from collections import Counter

from helpers import ODD, SF, WORDS, given, table

from lodestone.llm.queries import op3_quality_rules
from lodestone.llm.quality_rules import judge


def brute(i, text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[a : a + 8]) for a in range(len(words) - 7))
    covered = {b for a in range(len(words) - 7) if windows[tuple(words[a : a + 8])] > 1 for b in range(a, a + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (str(i), len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def shown(rows):
    return sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)


def test_given_documents(spark):
    sf = SF.replace("0.001", "0.01")
    docs, quality = table("documents", sf), {r["doc_id"]: r["quality"] for r in table("labels", sf)}
    got = op3_quality_rules(spark, sf).collect()
    assert shown(got) == sorted(brute(r["doc_id"], r["text"]) for r in docs)
    assert not any(r["kept"] and r["base_failed"] for r in got)
    good = [r for r in got if quality.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r for r in got if quality.get(r["doc_id"]) == 0 and not r["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good) and sum(r["kept"] for r in bad) <= 0.15 * len(bad)


def test_odd_rows(spark):
    rows = ODD + [(20, "a b c d e f g h a b c d e f g h"), (21, "x " * 9), (22, "one\none\n \n \none two")]
    assert shown(judge(given(spark, rows)).collect()) == sorted(brute(i, t) for i, t in rows)
    assert judge(given(spark, [])).collect() == []


def test_lines(spark):
    prose = "The quick brown fox jumps over the lazy dog and goes home again."
    text = "\n".join([prose, "Home | News | Contact us", "BUY THIS NOW FRIENDS!", "*** $$$ words ###", "", "Click here for more.", "loose end", prose + " 100% true & more."])
    row = judge(given(spark, [(1, text)])).first()
    assert row["clean_text"] == "\n".join([prose, "", prose + " 100% true & more."])
    assert row["n_lines_removed"] == 5 and row["kept"] is False and 0.3 < row["lost"] < 0.7
    phrases = "All rights reserved. Privacy policy. Terms of service. Cookie settings. Back to top. "
    for line, gone in ((phrases.strip(), 1), ((phrases * 4).strip(), 1), (phrases[:20] + prose, 0), ("Tous droits réservés, mentions légales.", 1), ("DATENSCHUTZERKLÄRUNG und Nutzungsbedingungen.", 1), ("Para leer más, volver arriba.", 1)):
        assert judge(given(spark, [(1, line)])).first()["n_lines_removed"] == gone, line
    assert judge(given(spark, [(1, "mehr dazu gibt es hier zu sehen.")]), phrases={"de": ("mehr dazu gibt es hier",)}).first()["n_lines_removed"] == 1
    assert judge(given(spark, [(1, f"{prose}\nAnother line with quite a few different words stands below it here.\nthe end")])).first()["kept"] is True
