import hashlib
import random

import pytest
from helpers import ODD, SF, WORDS, given, table

from lodestone.llm.queries import op5_substring_dedup
from lodestone.llm.substring_dedup import dedup_substrings


def brute(rows, width):
    least = {}
    split = [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, words in split:
        if i is not None:
            for at in range(len(words) - width + 1):
                key = tuple(words[at : at + width])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, words in split:
        gone = set()
        for at in range(len(words) - width + 1):
            if i is not None and least[tuple(words[at : at + width])] < i:
                gone.update(range(at, at + width))
        out.append((str(i), len(words), len(gone), " ".join(w for n, w in enumerate(words) if n not in gone)))
    return sorted(out)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in table("documents", f"/root/testdata/{sf}")]
    want = sorted((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(rows, 50))
    assert sorted((str(r[0]), *r[1:]) for r in op5_substring_dedup(spark, SF.replace("sf0.001", sf)).collect()) == want


@pytest.mark.parametrize(("width", "vocabulary"), [(8, 2), (6, 3), (8, 40), (7, 12)])
def test_planted_passages(spark, width, vocabulary):
    """Few words, passages of every length around the width, copies within a document and a hot passage."""
    rng = random.Random(width * 100 + vocabulary)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passages = [[word() for _ in range(n)] for n in (width - 1, width, width + 1, 3 * width, 9 * width)]
    rows = []
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(5)):
            words += [word() for _ in range(rng.randrange(6))]
            p = rng.choice(passages)
            a = rng.randrange(3)
            words += p[a : len(p) - rng.randrange(3)]
        rows.append((rng.randrange(60), " ".join(words)))
    rows += ODD + [(rng.randrange(1000), " ".join(passages[3])) for _ in range(50)]
    got = dedup_substrings(given(spark, rows), width)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()) == brute(rows, width)


def test_spans_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = {r["doc_id"]: r for r in dedup_substrings(given(spark, [(1, text), (2, f"x {text} y")]), 10).collect()}
    assert [tuple(x) for x in got[2]["spans"]] == [(1, 31)] and got[2]["kept_text"] == "x y" and got[1]["spans"] == []
    assert dedup_substrings(given(spark, [])).collect() == []
