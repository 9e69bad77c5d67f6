"""Text normalisation, trimming and extraction as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ELLIPSIS = "…"


def present(c: Column) -> Column:
    """The trimmed text; null where it is null or blank."""
    return F.nullif(F.btrim(c), F.lit(""))


def first_present(*cs: Column) -> Column:
    """The first of several alias columns that is neither null nor blank."""
    return F.coalesce(*map(present, cs))


def collapsed(c: Column) -> Column:
    """White space runs become one space, ends are stripped; null becomes ''."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def slugify(c: Column, limit: int = 80) -> Column:
    """Lower case, every non-alphanumeric to '_', outer '_' stripped, then cut: runs inside stay."""
    return F.substring(F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "_"), F.lit("_")), 1, limit)


@F.pandas_udf(T.StringType())
def _title(words):  # Python's title case has no JVM twin: every run of letters starts upper
    return words.map(lambda x: x.title(), na_action="ignore")


def humanize(c: Column) -> Column:
    """An id as words in title case, without a 'theory_' prefix; null becomes ''. Arrow-batched for Python's title rules."""
    plain = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("theory_"), F.lit("")), "[_.]", " ")
    return _title(F.btrim(plain))


def compact(c: Column, limit: int = 220) -> Column:
    """Collapsed text of at most ``limit`` characters; a cut ends in an ellipsis."""
    text = collapsed(c)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit(ELLIPSIS)))


def split_commas(c: Column) -> Column:
    """The non-blank parts between commas, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.btrim(x)), lambda x: x != "")


def topic_candidate(c: Column) -> Column:
    """A short topic name or '': no placeholder, at most 96 characters and 11 words unless it names a theory."""
    text = collapsed(c)
    low = F.lower(text)
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    named = low.contains("theory") | low.contains("framework") | low.contains("model")
    clean = F.when(text.contains("_"), F.btrim(F.replace(F.replace(text, F.lit("theory_"), F.lit("")), F.lit("_"), F.lit(" ")))).otherwise(text)
    return F.when(low.isin("", "unknown", "claim") | (F.length(text) > 96) | ((spaces > 10) & ~named), "").otherwise(clean)


def normalised(c: Column) -> Column:
    """Lower case, punctuation to spaces (accents and digits stay), white space collapsed."""
    return collapsed(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalised(c), " "), lambda w: w != "")


def any_marker(c: Column, markers: list[str] | tuple[str, ...]) -> Column:
    """Whether the text holds any of the literal markers."""
    return reduce(lambda a, b: a | b, (c.contains(m) for m in markers), F.lit(False))


def clean_markdown(c: Column) -> Column:
    """Front matter, bold marks, line-leading blanks and surplus blank lines removed."""
    text = F.btrim(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("\n")), F.lit(" \t\n"))
    text = F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n---\s*\n", "")
    text = F.regexp_replace(F.replace(text, F.lit("**"), F.lit("")), r"\n\s+", "\n")
    return F.btrim(F.regexp_replace(text, r"\n{3,}", "\n\n"), F.lit(" \t\n"))


def first_words(c: Column, most: int = 340) -> Column:
    """The text if it has at most ``most`` words, else that many, ended at the last whole sentence if there is one."""
    text = clean_markdown(c)
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, 1, most), " ")
    whole = F.regexp_extract(cut, r"(?s)\A(.*)\. ", 1)
    ended = F.when(whole == "", cut).when(whole.endswith("."), whole).otherwise(F.concat(whole, F.lit(".")))
    return F.when(F.size(words) <= most, text).otherwise(ended)


def front_matter(c: Column) -> Column:
    """map<string,string> of the leading '---' block's 'key: value' lines; empty without one."""
    block = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\A---\s*\n(.*?)\n---\s*\n", 1)
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.btrim(x)), lambda x: x.contains(":") & ~x.startswith("#"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.btrim(F.substring_index(x, ":", 1)).alias("key"),
            F.regexp_replace(F.btrim(F.regexp_replace(x, r"\A[^:]*:", "")), "\\A([\"'])(.*)\\1\\z", "$2").alias("value"),
        ),
    )
    # Of lines that repeat a key the last wins.
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def body(c: Column) -> Column:
    """What follows the front matter."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)\A---\s*\n(.*?)\n---\s*\n", "")


def kept_order(a: Column) -> Column:
    """An array without case-insensitive repeats and blanks: the first spelling stays, in order."""
    trimmed = F.filter(F.transform(a, lambda x: compact(x, 160)), lambda x: x != "")
    return F.aggregate(trimmed, F.array().cast("array<string>"), lambda seen, x: F.when(F.exists(seen, lambda y: F.lower(y) == F.lower(x)), seen).otherwise(F.array_append(seen, x)))


#: Parts of a page that hold no text.
_DROP = (r"(?s)<!--.*?-->", r"(?is)<(script|style|svg|noscript)\b[^>]*>.*?</\1>")


@F.pandas_udf(T.StringType())
def _unescape(text):
    import html

    return text.map(html.unescape, na_action="ignore")


def _shown(c: Column, decode: bool) -> Column:
    return collapsed(_unescape(c) if decode else c)


def html_page(c: Column, decode: bool = True, headings: int = 30, excerpt: int = 1500) -> dict[str, Column]:
    """``title``, distinct ``headings`` (h1 to h3, in order), ``excerpt`` and ``full_len`` of raw HTML.

    With ``decode`` entities are decoded by an Arrow-batched Python function
    over title, headings and body. Without it everything stays on the JVM and
    entities stay as written.
    """
    clean = F.coalesce(c, F.lit(""))
    for pattern in _DROP:
        clean = F.regexp_replace(clean, pattern, " ")
    title = F.regexp_extract(clean, r"(?is)<title[^>]*>(.*?)</title>", 1)
    raw = F.regexp_extract_all(clean, F.lit(r"(?is)(<h([1-3])[^>]*>.*?</h\2>)"), F.lit(1))
    # Headings are decoded in one call, joined by a noncharacter, which no entity decodes to (a line end would be one of "&#10;").
    bare = F.transform(raw, lambda h: F.regexp_replace(F.regexp_replace(h, r"<[^>]+>", " "), "\uffff", " "))
    joined = F.array_join(bare, "\uffff")
    plain = F.transform(F.split(_unescape(joined) if decode else joined, "\uffff"), collapsed)
    text = _shown(F.regexp_replace(clean, r"<[^>]+>", " "), decode)
    return {
        "title": _shown(title, decode),
        "headings": F.slice(F.array_distinct(F.filter(plain, lambda h: h != "")), 1, headings),
        "excerpt": F.substring(text, 1, excerpt),
        "full_len": F.length(text),
    }


def markdown_headings(c: Column, most: int = 15) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?m)^#{1,3}\s+(.+)$"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(F.transform(found, lambda x: F.btrim(x)), lambda h: h != "")), 1, most)


def science_sections(c: Column) -> Column:
    """map<string,string>: the sections of a JSON summary that have text, else prose up to its first second-level heading as 'Core Finding'.

    Null and blank summaries give an empty map.
    """
    said = F.coalesce(c, F.lit(""))
    listed = F.from_json(F.get_json_object(said, "$.sections"), "map<string,string>")
    cleaned = F.map_filter(F.transform_values(listed, lambda k, v: clean_markdown(v)), lambda k, v: v != "")
    prose = F.btrim(F.regexp_replace(clean_markdown(said), r"(?s)\n##\s+.*\z", ""), F.lit(" \t\r\n"))
    plain = F.when(clean_markdown(said) == "", F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("Core Finding"), prose))
    return F.when(F.size(listed) > 0, cleaned).otherwise(plain)


#: Where an abstract stands in a text, and how lines begin that are no title.
ABSTRACT = r"(?i)\babstract\b[:\s]*(.{50,800}?)(?:\n\n|\bintroduction\b|\bkeywords\b)"
NO_TITLE = ("http", "doi", "volume", "journal")
_BLANK = " \t\r\n\x0b\x0c"


def abstract_of(c: Column) -> Column:
    """The abstract that a text names, else its first 300 characters; '' for a blank text."""
    said = F.coalesce(c, F.lit(""))
    found = F.regexp_extract(said, ABSTRACT, 1)
    return F.btrim(F.when(found != "", found).otherwise(F.substring(said, 1, 300)), F.lit(_BLANK))


def title_of(c: Column, fallback: Column | str = "") -> Column:
    """The first line of over ten characters, cut to 200, if it has over 15 and does not begin like a reference; else the fallback."""
    other = fallback if isinstance(fallback, Column) else F.lit(fallback)
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.btrim(x, F.lit(_BLANK)))
    first = F.substring(F.get(F.filter(lines, lambda x: F.length(x) > 10), 0), 1, 200)
    bad = reduce(lambda a, b: a | b, (F.lower(first).startswith(x) for x in NO_TITLE))
    return F.when(first.isNull() | bad | (F.length(first) <= 15), other).otherwise(first)


def page_number(c: Column) -> Column:
    """The number after 'page', of any length that a long holds; null without one."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)page[_ ]?(\d+)", 1).try_cast("long")


def sequential_id(prefix: str, before: Column, number: Column, width: int = 4) -> Column:
    """prefix and a number that goes on from a count, with zeros up to ``width`` digits; longer numbers stay whole."""
    digits = (before + number).cast("string")
    return F.concat(F.lit(prefix), F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(digits), F.lit(0))), digits)


def digest_id(c: Column, length: int = 12) -> Column:
    """A shortened SHA-256 of the lower-cased, trimmed text."""
    return F.substring(F.sha2(F.lower(F.btrim(c)), 256), 1, length)
