"""Dotted taxonomy ids: normalisation, prefixes, focus rules and labels."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import humanize

NO_ENVIRONMENT, NO_OUTCOME = "unspecified.environment", "unspecified.outcome"
#: Segments that end an outcome's focus, and leaves that only name a measurement.
FOCUS = ("stress", "restorativeness", "preference", "wellbeing", "comfort", "memory", "attention", "learning", "navigation", "wayfinding", "productivity", "soundscape", "cognitive_load", "perceived_control", "place_attachment", "health", "awe", "fascination", "restoration", "mood", "arousal", "pain")
MEASURES = ("hr", "hrv", "heart_rate", "cortisol", "eda", "eda_sc", "eeg", "fmri", "temperature", "humidity", "accuracy", "reaction_time", "task", "self_report", "pulseox_physio", "skin_temp", "respiration", "blood_pressure")
#: Outcomes that say little.
LOW_INFO = (NO_OUTCOME, "study_validity_or_manipulation_check")
#: Names of environment and outcome roots.
ENVIRONMENT_ROOTS = {"spatial": "Spatial Form", "sensory": "Sensory Conditions", "acoustic": "Acoustic Conditions", "luminous": "Lighting Conditions", "natural": "Natural and Biophilic Conditions", "material": "Material and Surface Conditions", "thermal": "Thermal and Air Conditions", "config": "Configuration and Wayfinding", "aesthetic": "Aesthetic Conditions", "person_state": "Participant State and Expertise", "social_spatial": "Social-Spatial Conditions", "cultural": "Cultural Framing", "olfactory": "Olfactory Conditions", "temporal_env": "Temporal Conditions", "unspecified": "Unspecified Environment"}
OUTCOME_ROOTS = {"affect": "Affect and Stress", "cog": "Cognition and Performance", "behav": "Behavior", "health": "Health and Wellbeing", "physio": "Physiology", "neural": "Neural Activity", "performance": "Performance", "person_state": "Perceived State", "spatial": "Spatial Experience", "natural": "Nature-Related Response", "thermal": "Thermal Response", "luminous": "Lighting-Related Response", "acoustic": "Acoustic Response", "social_spatial": "Social-Spatial Response", "mechanism_or_pathway": "Mechanism or Pathway", "study_validity_or_manipulation_check": "Manipulation Check", "unspecified": "Unspecified Outcome"}


def normal_id(c: Column) -> Column:
    """A dotted id of one to five clean segments of at most 32 characters, or ''."""
    raw = F.btrim(F.coalesce(c, F.lit("")))
    parts = F.transform(F.split(F.lower(raw), r"\."), lambda s: F.btrim(F.regexp_replace(s, "[^a-z0-9_]+", "_"), F.lit("_")))
    good = F.forall(parts, lambda s: (s != "") & (F.length(s) <= 32)) & (F.size(parts) <= 5)
    return F.when(F.lower(raw).isin("", "n/a", "na", "none", "unknown", "null") | ~good, "").otherwise(F.array_join(parts, "."))


def environment(c: Column) -> Column:
    return F.coalesce(F.nullif(normal_id(c), F.lit("")), F.lit(NO_ENVIRONMENT))


def outcome(c: Column) -> Column:
    return F.coalesce(F.nullif(normal_id(c), F.lit("")), F.lit(NO_OUTCOME))


def root(c: Column) -> Column:
    """The first segment; 'unspecified' for null and ''."""
    return F.coalesce(F.nullif(F.substring_index(F.btrim(c), ".", 1), F.lit("")), F.lit("unspecified"))


def environment_focus(c: Column) -> Column:
    """The first two segments of a normal environment id."""
    return F.substring_index(environment(c), ".", 2)


def outcome_focus(c: Column) -> Column:
    """Up to the first focus segment; else without a measurement leaf; else at most three segments of four or more."""
    node = outcome(c)
    parts = F.split(node, r"\.")
    at = F.array_min(F.filter(F.transform(parts, lambda s, i: F.when(s.isin(*FOCUS), i + 1)), lambda i: i.isNotNull()))
    n = F.size(parts)
    cut = F.when(at.isNotNull(), at).when(F.element_at(parts, -1).isin(*MEASURES) & (n > 1), n - 1).when(n >= 4, 3).otherwise(n)
    return F.when(node == NO_OUTCOME, node).otherwise(F.array_join(F.slice(parts, F.lit(1), cut), "."))


def _named(c: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*map(F.lit, chain.from_iterable(names.items())))
    return F.coalesce(F.try_element_at(table, c), humanize(c))


def environment_root_label(c: Column) -> Column:
    return _named(root(c), ENVIRONMENT_ROOTS)


def outcome_root_label(c: Column) -> Column:
    return _named(root(c), OUTCOME_ROOTS)


def environment_label(c: Column) -> Column:
    """A root's name, or the last segment in words."""
    node = F.btrim(F.coalesce(c, F.lit("")))
    return F.when(node.isin("", NO_ENVIRONMENT), "Unspecified Environment").when(~node.contains("."), environment_root_label(node)).otherwise(humanize(F.substring_index(node, ".", -1)))


def outcome_label(c: Column) -> Column:
    node = F.btrim(F.coalesce(c, F.lit("")))
    return F.when(node.isin("", NO_OUTCOME), "Unspecified Outcome").otherwise(humanize(F.substring_index(node, ".", -1)))


def topic_label(environment_node: Column, outcome_node: Column) -> Column:
    return F.concat(environment_label(environment_node), F.lit(" -> "), outcome_label(outcome_node))
