"""Bibliographic fields: DOIs, titles, years, abstracts, authors and citation lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import collapsed, compact

DOI = r"10\.\d{4,9}/\S+"


def clean_doi(c: Column) -> Column:
    text = F.btrim(F.coalesce(c, F.lit("")))
    return F.when(text.endswith(".json"), "").otherwise(text)


def find_doi(c: Column) -> Column:
    """The first DOI in a text, without trailing full stops; null if there is none."""
    return F.nullif(F.rtrim(F.regexp_extract(F.coalesce(c, F.lit("")), f"({DOI})", 1), F.lit(".")), F.lit(""))


def publishable_title(c: Column, rejected: tuple[str, ...] = ()) -> Column:
    """The collapsed title, or '' if a pattern rejects it, it starts with a bullet or has under three words."""
    text = collapsed(c)
    bad = text.startswith("•") | (F.size(F.split(text, " ")) < 3)
    for pattern in rejected:
        bad = bad | F.lower(text).rlike(pattern)
    return F.when(bad, "").otherwise(text)


def sane_year(c: Column, this_year: int) -> Column:
    """The year as int if it lies between 1900 and next year, else null."""
    year = c.try_cast("int")
    return F.when(year.between(1900, this_year + 1), year)


def trimmed_abstract(c: Column, markers: tuple[str, ...], after: int = 200) -> Column:
    """The abstract cut at the first listed marker that stands beyond ``after`` characters."""
    text = collapsed(c)
    out = text
    for marker in reversed(markers):
        at = F.instr(text, marker) - 1
        out = F.when(at > after, F.rtrim(F.substring(text, F.lit(1), at))).otherwise(out)
    return out


def authors(c: Column) -> Column:
    """A list of authors from one text: by ';', ' and ', ' & ', or a single comma."""
    text = collapsed(c)

    def parts(sep: str) -> Column:
        return F.filter(F.transform(F.split(text, sep), lambda x: F.btrim(x, F.lit(" ,"))), lambda x: x != "")

    halves = F.transform(F.split(text, ","), lambda x: F.btrim(x))
    one_comma = (F.size(halves) == 2) & F.forall(halves, lambda x: x != "")
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(text.contains(";"), parts(";"))
        .when(text.contains(" and "), parts(" and "))
        .when(text.contains(" & "), parts(" & "))
        .when(one_comma, halves)
        .otherwise(F.array(text))
    )


def apa(author_list: Column, year: Column, title: Column, doi: Column) -> Column:
    """'Authors (year). Title. https://doi.org/doi' with absent parts left out; '' without a title."""
    shown = F.when(publishable_title(title) != "", publishable_title(title)).otherwise(compact(title, 180))
    who = F.nullif(F.array_join(author_list, ", "), F.lit(""))
    when = F.concat(F.lit("("), year.cast("string"), F.lit(")."))
    what = F.concat(F.rtrim(shown, F.lit(".")), F.lit("."))
    where = F.when(clean_doi(doi) != "", F.concat(F.lit("https://doi.org/"), clean_doi(doi)))
    return F.when(shown == "", "").otherwise(F.concat_ws(" ", who, when, what, where))


def citation(line: Column) -> dict[str, Column]:
    """``authors``, ``year`` and ``title`` of a citation line: 'Authors (year). Title. ...', else a title alone."""
    form = r"^(.+?)\s*\(\d{4}\)\.\s*(.+)"
    is_apa = line.rlike(form)
    rest = F.regexp_extract(line, form, 2)
    sentence = F.regexp_extract(rest, r"^(.+?)\.\s+[A-Z]", 1)
    first = F.btrim(F.when(sentence != "", sentence).otherwise(F.substring_index(rest, ".", 1)))
    bare = F.regexp_replace(F.regexp_replace(line, r"\s*https?://doi\.org/\S+", ""), rf"\s*{DOI}", "")
    in_brackets = F.regexp_extract(line, r"\((\d{4})\)", 1)
    return {
        "authors": F.when(is_apa, F.rtrim(F.rtrim(F.btrim(F.regexp_extract(line, form, 1)), F.lit(",")), F.lit("."))).otherwise(""),
        "year": F.when(in_brackets != "", in_brackets).otherwise(F.regexp_extract(line, r"\b((?:19|20)\d{2})\b", 1)),
        "title": F.when(is_apa, first).otherwise(F.rtrim(F.btrim(bare), F.lit("."))),
    }


def title_status(c: Column, rejected: tuple[str, ...] = ()) -> Column:
    text = F.btrim(F.coalesce(c, F.lit("")))
    loose = text.endswith(",") | text.endswith(":") | (F.size(F.split(collapsed(c), " ")) < 5)
    return F.when(text == "", "missing").when(publishable_title(c, rejected) == "", "blocked").when(loose, "provisional").otherwise("good")


def abstract_status(c: Column, markers: tuple[str, ...] = ()) -> Column:
    size = F.length(trimmed_abstract(c, markers))
    return F.when(size == 0, "missing").when(size < 350, "provisional").otherwise("good")


def doi_status(c: Column) -> Column:
    return F.when(clean_doi(c) == "", "missing").otherwise("good")


def subject_status(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(0)) == 0, "missing").otherwise("good")


def review_state(c: Column, accepted_is_good: bool = False) -> Column:
    """A known review state in lower case, else 'missing'."""
    state = F.lower(F.btrim(F.coalesce(c, F.lit(""))))
    if accepted_is_good:
        return F.when(state == "accepted", "good").when(state.isin("good", "provisional"), state).otherwise("missing")
    return F.when(state.isin("accepted", "provisional", "review_required"), state).otherwise("missing")


def metadata_confidence(doi: Column, title: Column, who: Column) -> Column:
    """'high' with DOI, title and authors, 'medium' with the DOI or both others, else 'low'."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    named = has(title) & has(who)
    return F.when(has(doi) & named, "high").when(has(doi) | named, "medium").otherwise("low")
