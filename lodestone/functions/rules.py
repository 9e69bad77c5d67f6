"""Ordered rule ladders: article types, warrant types, front categories, bands, grades and patches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import any_marker, humanize

#: Article types by phrase, in order, with the confidence of each.
ARTICLE_PHRASES = (
    ("systematic_review", 0.93, "phrase:review", ("systematic review", "scoping review", "literature review", "review article")),
    ("protocol", 0.9, "phrase:protocol", ("study protocol", "trial protocol", "protocol paper", "protocol for")),
    ("case_study", 0.88, "phrase:case-study", ("case study", "case report")),
    ("mixed_methods", 0.82, "phrase:mixed-methods", ("mixed methods", "mixed-methods")),
    ("qualitative_research", 0.82, "phrase:qualitative", ("qualitative study", "thematic analysis", "focus group", "semi-structured interview", "semi structured interview", "ethnograph", "grounded theory")),
    ("commentary", 0.78, "phrase:commentary", ("editorial", "commentary", "perspective", "viewpoint", "letter to the editor")),
)
EMPIRICAL_TERMS = {"randomized": "term:randomized", "participants": "term:participants", "method": "term:method", "results": "term:results", "experiment": "term:experiment", "trial": "term:trial", "survey": "term:survey", "intervention": "term:intervention", "we examined": "phrase:we-examined", "this study": "phrase:this-study"}
THEORETICAL_TERMS = {"theoretical framework": "phrase:theoretical-framework", "conceptual framework": "phrase:conceptual-framework", "conceptual model": "phrase:conceptual-model", "theoretical model": "phrase:theoretical-model", "we propose": "phrase:we-propose", "this paper discusses": "phrase:discusses"}


def _hits(text: Column, terms: dict[str, str]) -> Column:
    return F.filter(F.array(*(F.when(text.contains(k), v) for k, v in terms.items())), lambda x: x.isNotNull())


def article_type(text: Column) -> Column:
    """struct<label, confidence, signals, next_action> of a lower-cased text: the first rule that holds decides."""

    def verdict(label: str, confidence: float, signals: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"), signals.alias("signals"), F.lit("accept" if confidence >= 0.75 else "review_if_uncertain").alias("next_action"))

    low = F.lower(F.coalesce(text, F.lit("")))
    empirical, theoretical = _hits(low, EMPIRICAL_TERMS), _hits(low, THEORETICAL_TERMS)
    out = F.when(low.rlike(r"\bmeta[\s-]?analysis\b"), verdict("meta_analysis", 0.96, F.array(F.lit("phrase:meta-analysis"))))
    for label, confidence, signal, phrases in ARTICLE_PHRASES:
        out = out.when(any_marker(low, phrases), verdict(label, confidence, F.array(F.lit(signal))))
    out = out.when(F.size(empirical) >= 2, verdict("empirical_research", 0.78, F.slice(empirical, 1, 4)))
    out = out.when((F.size(theoretical) > 0) & (F.size(empirical) == 0), verdict("theoretical", 0.72, F.slice(theoretical, 1, 4)))
    return out.otherwise(verdict("unknown", 0.35, F.array(F.lit("fallback:unknown"))))


#: Bridge types with their discounts, and markers in statements.
DISCOUNTS = {"constitutive": 1.00, "mechanism": 0.80, "empirical_association": 0.80, "functional": 0.65, "capacity": 0.55, "analogical": 0.40, "theory_derived": 0.25}
CAPACITY = ("capacity to", "capable of", "ability to", "can support", "can produce", "has the capacity")
ANALOGY = ("analog", "analogy", "analogical", "resembles", "similar to", "like a")
THEORY = ("theory", "framework", "hypothesis", "predicts", "prediction", "suggests that", "argues that")
CONSTITUTION = ("constitutive", "component of", "part of", "consists of", "is a marker of", "marker of", "index of", "indexes", "indexed by", "signature of", "reliable indicator of")
EXTRACTED = {"pathway_or_interaction_text_to_mechanism_field": "mechanism", "manipulation_or_reliability_text_to_validation_field": "capacity", "theme_or_descriptor_text_to_qualitative_field": "capacity"}
ROLES = {"mechanism_claim": "mechanism", "validation_claim": "capacity", "synthesis_claim": "functional", "construct_inference_claim": "functional"}
MEASURED = ("measured_result_to_indicator_field", "condition_or_group_contrast_to_comparative_field")


#: What a synthesis may fall back to, in this order.
FALLBACKS = ("mechanism", "functional", "theory_derived", "empirical_association")


def bridge_type(raw: Column, role: Column, statement: Column, theory_text: Column, primary: Column | None = None, likely: Column | None = None) -> Column:
    """The canonical warrant type of a claim.

    Order: analogy in the statement; the extraction's own field; indicator,
    synthesis and measurement fields with their markers; the claim's role; a
    theory marker where the article's primary type is theory; the primary type.
    A synthesis without a marker takes the first fallback among ``likely``, the
    warrant types (array<string>) that a policy table gives for the article's
    type; without the policy that is empirical association alone.
    """
    likely = F.transform(F.coalesce(likely, F.array().cast("array<string>")), lambda x: F.lower(F.btrim(x))) if likely is not None else F.array(F.lit("empirical_association"))
    first_likely = F.coalesce(F.get(F.filter(F.array(*map(F.lit, FALLBACKS)), lambda x: F.array_contains(likely, x)), 0), F.lit("functional"))
    raw, role = F.lower(F.btrim(F.coalesce(raw, F.lit("")))), F.lower(F.btrim(F.coalesce(role, F.lit(""))))
    said, theory = F.lower(F.coalesce(statement, F.lit(""))), F.lower(F.coalesce(theory_text, F.lit("")))
    base = F.lower(F.btrim(F.coalesce(primary, F.lit("")))) if primary is not None else F.lit("")
    base = F.when(base.isin(*DISCOUNTS), base).otherwise("empirical_association")
    out = F.when(any_marker(said, ANALOGY), "analogical")
    for field, kind in EXTRACTED.items():
        out = out.when(raw == field, kind)
    out = out.when(raw == "indicator_pattern_plus_author_interpretation_to_construct_field", F.when(any_marker(said, CONSTITUTION), "constitutive").when(any_marker(said, CAPACITY), "capacity").otherwise("functional"))
    out = out.when(raw == "multi_result_integration_to_synthesis_field", F.when(any_marker(said, THEORY), "theory_derived").when(any_marker(said, CAPACITY), "capacity").otherwise(first_likely))
    out = out.when(raw.isin(*MEASURED), F.when(any_marker(said, CONSTITUTION), "constitutive").otherwise("empirical_association"))
    for claim_role, kind in ROLES.items():
        out = out.when(role == claim_role, kind)
    return out.when(any_marker(F.concat_ws(" ", said, theory), THEORY) & (base == "theory_derived"), "theory_derived").otherwise(base)


def discount(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in DISCOUNTS.items()))


def warrant_chain(kind: Column, raw: Column, role: Column, statistic: Column) -> Column:
    """'X bridge (d=0.80) · extraction warrant: ... · claim role: ... · statistic: ...' with absent parts left out."""
    name = F.when(F.coalesce(F.btrim(kind), F.lit("")) == "", "Unknown").otherwise(F.replace(humanize(F.lower(F.btrim(kind))), F.lit("Theory Derived"), F.lit("Theory-Derived")))
    head = F.concat(name, F.lit(" bridge"), F.coalesce(F.concat(F.lit(" (d="), F.format_string("%.2f", discount(kind)), F.lit(")")), F.lit("")))

    def part(label: str, c: Column) -> Column:
        return F.when(F.coalesce(F.btrim(c), F.lit("")) != "", F.concat(F.lit(label), c))

    return F.concat_ws(" · ", head, part("extraction warrant: ", raw), F.when(F.coalesce(role, F.lit("")) != "", F.concat(F.lit("claim role: "), humanize(role))), part("statistic: ", F.btrim(statistic)))


#: A front's category by the first group of words that its texts hold.
FRONT_WORDS = (("Neuroscience", ("neuro", "brain", "cognitive_map", "attention", "memory", "locus", "circadian")), ("Physiological", ("stress", "arousal", "fatigue", "well_being", "sleep", "circadian", "thermal")), ("Methodology", ("theory", "replication", "method", "measurement")), ("Cognitive", ("wayfinding", "cog", "creativity", "executive", "attention")))


def front_category(label: Column, theories: Column, constructs: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", label, F.array_join(F.coalesce(theories, F.array().cast("array<string>")), " "), F.array_join(F.coalesce(constructs, F.array().cast("array<string>")), " ")))
    out = F.when(any_marker(blob, FRONT_WORDS[0][1]), FRONT_WORDS[0][0])
    for name, words in FRONT_WORDS[1:]:
        out = out.when(any_marker(blob, words), name)
    return out.otherwise("Environmental")


def is_gap(size: Column, maturity: Column, contradictions: Column) -> Column:
    return (size <= 8) | (F.coalesce(maturity, F.lit("")) != "established") | (F.coalesce(contradictions, F.lit(0)) > 0)


def gap_type(size: Column, contradictions: Column) -> Column:
    return F.when(size <= 8, "untested").when(F.coalesce(contradictions, F.lit(0)) > 0, "conflict").otherwise("credence")


def value_band(voi: Column) -> Column:
    return F.when(voi >= 0.7, "high").when(voi >= 0.45, "medium").otherwise("low")


def need_level(n: Column) -> Column:
    return F.when(n < 5, "high").when(n < 15, "medium").otherwise("low")


def letter_grade(score: Column, cutoffs: list[tuple[float, str]]) -> Column:
    """The letter of the first cut-off (from the highest) that the score reaches, else 'F'."""
    out = F.lit("F")
    for cut, letter in sorted(cutoffs):
        out = F.when(score >= cut, letter).otherwise(out)
    return out


def clamped(c: Column, most: Column | float) -> Column:
    return F.greatest(F.lit(0), F.least(c, most if isinstance(most, Column) else F.lit(most)))


def mapped(c: Column, names: dict[str, str]) -> Column:
    """An alias map over the lower-cased, trimmed text; unknown names come back as null."""
    key = F.lower(F.btrim(c))
    return F.coalesce(*(F.when(key == k.lower(), v) for k, v in names.items()))


def word_band(n: Column) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) == 0, "missing").when(n < 300, "stub").when(n < 600, "brief").otherwise("full")


def agreement_flag(known: Column, verdicts: Column, relevance: Column, has_topic: Column, has_type: Column) -> Column:
    """Services against our own classification: ``verdicts`` distinct ones (count), ``relevance`` the highest."""
    return (
        F.when(~known, "unknown_to_us").when(verdicts > 1, "service_disagreement").when(~(has_topic | has_type), "no_our_classification")
        .when((relevance >= 0.7) & has_topic, "agree").when((relevance < 0.4) & has_topic, "our_disagreement").otherwise("mixed")
    )


def patch_violations(op: Column, param: Column, value: Column, spec: Column, ops: tuple[str, ...] = ("set", "delta", "preset")) -> Column:
    """Codes of what is wrong with a patch.

    ``value`` is text; ``spec`` is struct<type, minimum, maximum, enum> of the
    parameter, null if the manifest has none. An unknown operation, parameter
    or type ends the check; range, enum and delta rules add up.
    """
    number = value.try_cast("double")
    kind = spec["type"]
    numeric = kind.isin("number", "integer")
    typed = F.when(kind == "number", number.isNotNull()).when(kind == "integer", value.rlike(r"^[+-]?\d+$")).when(kind == "boolean", value.isin("true", "false")).otherwise(value.isNotNull())
    found = F.filter(
        F.array(
            F.when(numeric & (number < spec["minimum"]), "out_of_range_low"),
            F.when(numeric & (number > spec["maximum"]), "out_of_range_high"),
            F.when(spec["enum"].isNotNull() & ~F.array_contains(spec["enum"], value), "enum_violation"),
            F.when((op == "delta") & numeric & (F.abs(number) > spec["maximum"] - spec["minimum"]), "delta_too_large"),
        ),
        lambda x: x.isNotNull(),
    )
    none = F.array().cast("array<string>")
    return (
        F.when(op.isNull() | ~op.isin(*ops), F.array(F.lit("invalid_op"))).when(op == "preset", F.when(F.coalesce(param, F.lit("")) == "", F.array(F.lit("missing_preset"))).otherwise(none))
        .when(spec.isNull(), F.array(F.lit("unknown_param"))).when(~F.coalesce(typed, F.lit(False)), F.array(F.lit("type_mismatch"))).otherwise(found)
    )


#: Patterns of a contract's sections, and of vague and specific success conditions.
SECTIONS = {
    "inputs": (r"#+\s*inputs?\b", r"\*\*inputs?\*\*", r"^inputs?\s*[:—\-]", r"reads?\s+(from|the)", r"takes?\s+(as\s+)?input"),
    "processing": (r"#+\s*processing\b", r"\*\*processing\*\*", r"^processing\s*[:—\-]", r"#+\s*steps?\b", r"#+\s*algorithm\b", r"for\s+each\s+(template|gap|paper|query)"),
    "outputs": (r"#+\s*outputs?\b", r"\*\*outputs?\*\*", r"^outputs?\s*[:—\-]", r"produces?\s+(a|the|structured)", r"returns?\s+(a|the|structured)"),
    "success": (r"#+\s*success\s+cond", r"\*\*success\s+cond", r"success\s+cond\w*\s*[:—\-]", r"#+\s*acceptance\s+cri", r"how\s+(?:do\s+)?(?:you|we)\s+know\s+it\s+worked", r"must\s+(?:produce|generate|output|return)\s+at\s+least"),
}
CHECKLIST = (r"\[\s*\]\s+", r"\[x\]\s+", r"\[/\]\s+", r"#+\s*tests?\b", r"\*\*tests?\*\*", r"test\s+checklist", r"validation\s+checklist", r"verify\s+that")
SPECIFIC = (r"at\s+least\s+\d+", r"≥\s*\d+", r">=\s*\d+", r"\d+%", r"sorted\s+by", r"each\s+\w+\s+has", r"never\s+(crash|fail|drop)", r"between\s+0\s+and\s+1", r"valid\s+(json|csv|format)")


def contract_grade(text: Column) -> Column:
    """STRONG, ADEQUATE, WEAK or MISSING: how many sections a contract has, a checklist, and specific success conditions."""
    said = F.coalesce(text, F.lit(""))
    has = lambda patterns: said.rlike("(?im)" + "|".join(f"(?:{p})" for p in patterns))
    n = sum((has(p).cast("int") for p in SECTIONS.values()), F.lit(0))
    listed, specific = has(CHECKLIST), has(SECTIONS["success"]) & has(SPECIFIC)
    return F.when((n >= 4) & listed & specific, "STRONG").when((n >= 3) & (listed | specific), "ADEQUATE").when(n >= 2, "WEAK").otherwise("MISSING")


def rice(reach: Column, impact: Column, confidence: Column, effort: Column) -> Column:
    """Reach times impact times confidence over effort; null where the effort is 0."""
    return F.when(effort != 0, reach * impact * confidence / effort)


def excluded_from_topics(missing_environment: Column, missing_outcome: Column, title: Column, article: Column, claims: Column, pattern: str) -> Column:
    """Both axes missing, and a title that the pattern matches or a thin article that does not apply."""
    thin = (F.lower(F.btrim(F.coalesce(article, F.lit("")))) == "not_applicable") & (F.coalesce(claims, F.lit(0)) <= 1)
    return missing_environment & missing_outcome & (F.coalesce(title, F.lit("")).rlike(f"(?i){pattern}") | thin)


#: Fields of a page address, by words of its name.
AREA_WORDS = (("evidence", ("evidence", "claim")), ("gaps", ("gap",)), ("topics", ("topic",)), ("articles", ("article",)), ("contribute", ("contribute",)), ("admin", ("admin", "approve")), ("site-utility", ("sitemap", "search")))


def page_area(path: Column, prefix: str, course: str) -> Column:
    """struct<area, track> of a page's path: course pages by track and kind, pages with the prefix by words of their name."""
    name = F.substring_index(path, "/", -1)
    in_course = path.startswith(f"{course}/")
    track = F.regexp_extract(name, r"^t([1-4])_(?:intro|task[1-3]|submissions)\.html$", 1)
    kind = F.regexp_extract(name, r"^t[1-4]_(intro|task|submissions)", 1)
    area = F.when(in_course & (track != ""), F.when(kind == "intro", "track-overview").when(kind == "submissions", "track-submission").otherwise("track-task"))
    loose = F.lit(None).cast("string")
    for n in ("4", "3", "2", "1"):
        hit = name.contains(f"track{n}") | name.startswith(f"t{n}_") | (name.contains("gui") if n == "4" else F.lit(False))
        loose = F.when(hit, f"track{n}").otherwise(loose)
    plain = in_course & (track == "")
    area = area.when(plain & loose.isNull() & (name.contains("schedule") | name.contains("syllabus")), f"{course}-syllabus").when(plain, f"{course}-other")
    for label, words in AREA_WORDS:
        area = area.when(name.startswith(prefix) & any_marker(name, words), label)
    area = area.when(name == f"{prefix}home.html", "home").otherwise("other")
    which = F.when(in_course & (track != ""), F.concat(F.lit("track"), track)).when(plain & loose.isNotNull(), loose).otherwise("none")
    return F.struct(area.alias("area"), which.alias("track"))


def _magic(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.to_binary(F.lit("%PDF-"), F.lit("utf-8"))


def _end_mark(content: Column, tail: int) -> Column:
    # Bytes as Latin-1 text keep their places.
    return F.decode(F.substring(content, -tail, tail), "ISO-8859-1").contains("%%EOF")


def pdf_check(content: Column, most: int = 50 * 1024 * 1024) -> Column:
    """struct<valid, problem, warning> of uploaded bytes: magic, then size; a missing end mark is a warning only."""
    problem = F.when(content.isNull() | ~_magic(content), "no_magic").when(F.length(content) > most, "too_large")
    warning = F.when(problem.isNull() & ~_end_mark(content, 1024), "no_eof")
    return F.struct(problem.isNull().alias("valid"), problem.alias("problem"), warning.alias("warning"))


def pdf_quarantine(content: Column, name: Column, most: int = 100 * 1024 * 1024) -> Column:
    """The strict verdict on a file: missing, bad_file, oversize, malformed (no end mark), encrypted or accepted.

    Encrypted is a file that names an encryption dictionary.
    """
    named = F.lower(name).endswith(".pdf")
    sealed = F.decode(content, "ISO-8859-1").rlike(r"/Encrypt\b")
    return (
        F.when(content.isNull(), "missing").when(F.length(content) == 0, "bad_file").when(F.length(content) > most, "oversize")
        .when(~F.coalesce(named, F.lit(False)) | ~_magic(content), "bad_file").when(~_end_mark(content, 2048), "malformed").when(sealed, "encrypted").otherwise("accepted")
    )


#: Priority and effort of a critique by its rating, and how its suggestion begins.
PRIORITIES = {"major": "High", "minor": "Medium", "pass": "Low"}
EFFORTS = {"major": "Half day", "minor": "30–60 min"}
OPENINGS = {"major": ("Address the '", "' violation"), "minor": ("Tighten the '", "' dimension")}
REMEDY = "Review the heuristic's standard remedies (see Nielsen/Shneiderman/Tufte source) and apply the smallest change that resolves the issue."


def _by_name(key: Column, names: dict[str, str], default: str) -> Column:
    return F.coalesce(*(F.when(key == k, v) for k, v in names.items()), F.lit(default))


def priority(rating: Column) -> Column:
    return _by_name(rating, PRIORITIES, "Low")


def critique(rating: Column, label: Column, note: Column) -> dict[str, Column]:
    """``suggestion``, ``priority`` and ``effort`` that a rating alone suggests for a heuristic."""
    opening = F.concat(F.lit("Review '"), label, F.lit("'"))
    for name, (before, after) in OPENINGS.items():
        opening = F.when(rating == name, F.concat(F.lit(before), label, F.lit(after))).otherwise(opening)
    said = F.btrim(F.coalesce(note, F.lit("")))
    seen = F.when(said != "", F.concat(F.lit(' Student observed: "'), said, F.lit('"'))).otherwise("")
    return {"suggestion": F.concat(opening, F.lit(" on this page."), seen, F.lit(" "), F.lit(REMEDY)), "priority": priority(rating), "effort": _by_name(rating, EFFORTS, "15 min")}


#: Points of an embedded picture and of a rendered page for each kind of page it stands on, and the least size of a picture.
PICTURE_POINTS = {"figure": 6, "context": 5, "results": 3}
PAGE_POINTS = {"table": 8, "results": 6, "figure": 4, "sample": 2}
PICTURE_WIDTH, PICTURE_HEIGHT = 220, 160


def picture_score(figure: Column, context: Column, results: Column) -> dict[str, Column]:
    """``score`` and ``kind`` of an embedded picture by the kinds of its page (booleans)."""
    points = lambda c, n: F.when(c, PICTURE_POINTS[n]).otherwise(0)
    kind = F.when(figure, "stimulus_or_result_figure").when(context, "experimental_context").when(results, "results_surface").otherwise("supplemental_visual")
    return {"score": F.lit(1) + points(figure, "figure") + points(context, "context") + points(results, "results"), "kind": kind}


def page_score(table: Column, results: Column, figure: Column, sample: Column) -> dict[str, Column]:
    """``score`` and ``kind`` of a rendered page; a score of 0 makes it no candidate."""
    parts = {"table": table, "results": results, "figure": figure, "sample": sample}
    score = sum((F.when(parts[n], p).otherwise(0) for n, p in PAGE_POINTS.items()), F.lit(0))
    return {"score": score, "kind": F.when(table | results, "results_surface").otherwise("experimental_context")}
