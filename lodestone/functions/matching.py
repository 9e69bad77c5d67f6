"""Fuzzy equality of titles and authors by words, as native higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import normalised


def word_distance(a: Column, b: Column) -> Column:
    """Insertions, deletions and substitutions of whole words between two arrays.

    Where the lengths differ by more than max(2, a third of the shorter), the
    distance is not computed and the longer length stands for it.
    """
    m, n = F.size(a), F.size(b)
    start = F.sequence(F.lit(0), n)

    def next_row(row: Column, word: Column) -> Column:
        def step(done: Column, j: Column) -> Column:
            cost = F.when(F.get(b, j) == word, 0).otherwise(1)
            best = F.least(F.element_at(done, -1) + 1, F.get(row, j + 1) + 1, F.get(row, j) + cost)
            return F.array_append(done, best)

        return F.when(n == 0, F.array(F.get(row, 0) + 1)).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.array(F.get(row, 0) + 1), step))

    full = F.element_at(F.aggregate(a, start, next_row), -1)
    return F.when(F.abs(m - n) > F.greatest(F.lit(2), F.floor(F.least(m, n) / 3)), F.greatest(m, n)).otherwise(full)


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def titles_match(a: Column, b: Column, most: int = 1) -> Column:
    """Equal or contained after normalisation, or (from three words each) at most ``most`` word edits apart."""
    x, y = normalised(a), normalised(b)
    wide = (F.size(_words(x)) >= 3) & (F.size(_words(y)) >= 3)
    return F.when((x == "") | (y == ""), False).when(x.contains(y) | y.contains(x), True).otherwise(wide & (word_distance(_words(x), _words(y)) <= most))


def authors_match(a: Column, b: Column, most: int = 1) -> Column:
    """Equal after normalisation, the same first name beside an 'et al', or at most ``most`` word edits apart."""
    x, y = normalised(a), normalised(b)
    et_al = (F.substring_index(x, " ", 1) == F.substring_index(y, " ", 1)) & (x.contains("et al") | y.contains("et al"))
    return F.when((x == "") | (y == ""), False).when((x == y) | et_al, True).otherwise(word_distance(_words(x), _words(y)) <= most)


def duplicate_kind(title_hit: Column, authors_a: Column, authors_b: Column) -> Column:
    """How strong a title match is, given both author texts."""
    both = (F.coalesce(authors_a, F.lit("")) != "") & (F.coalesce(authors_b, F.lit("")) != "")
    return F.when(~title_hit, None).when(~both, "title_fuzzy_1word").when(authors_match(authors_a, authors_b), "title_and_authors_fuzzy").otherwise("title_fuzzy_authors_differ")


#: The confidence that each kind of match carries.
CONFIDENCE = {"exact_hash": "definitive", "exact_doi": "definitive", "title_and_authors_fuzzy": "very_high", "title_fuzzy_1word": "high", "title_fuzzy_authors_differ": "medium"}


def match_confidence(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, v) for k, v in CONFIDENCE.items()))
