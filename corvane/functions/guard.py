"""Screening of questions and answers by caller-supplied term lists and patterns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.parse import contains_any

# Phrases in questions that are turned away, in the order in which the lists are tried.
QUERY_TERMS: Mapping[str, Sequence[str]] = {
    "diagnosis": (
        "do i have", "does my patient have", "diagnose me", "diagnose my patient", "am i affected", "is my patient affected", "what disease do i have",
        "what condition do i have", "confirm disease", "confirm condition", "rule out", "diagnose this", "diagnose the patient", "diagnose this patient",
        "what does my patient have", "what's wrong with my patient", "whats wrong with my patient", "should i tell my patient", "should i tell them",
        "tell my patient", "will my patient", "will they get", "will i get", "how long does he have", "how long does she have", "how long do i have",
        "interpret it and tell me", "interpret my", "confirm the diagnosis", "confirm my suspicion",
    ),
    "pathogenicity": (
        "classify this", "classify the variant", "reclassify", "in your opinion", "pathogenicity score", "apply the acmg", "acmg criteria", "predict whether",
        "predict if", "what is the real answer", "give me a final",
    ),
    "treatment": (
        "how to treat", "treatment for", "what medication", "which drug", "prescribe", "prescription", "therapy for", "cure for", "should i take", "dosage",
        "dose of", "treatment options", "clinical management", "how to manage",
    ),
}
# Patterns in answers that are held back, in lower case.
RESPONSE_PATTERNS: Mapping[str, Sequence[str]] = {
    "diagnosis": (
        r"\byou have\b(?! access| the option| provided)",
        r"\byour patient has\b",
        r"\bthis confirms\b.*\bdiagnosis\b",
        r"\bi diagnose\b",
        r"\bthe diagnosis is\b",
        r"\bbased on (?:this|these) (?:variant|result)s?,? (?:you|the patient) (?:has|have)\b",
        r"\b(?:this|the)\s+(?:\d+[\s-]?year[\s-]?old|patient|child|individual|case|boy|girl|man|woman)\b"
        r".{0,120}?\b(?:is (?:consistent with|associated with|suggestive of|diagnostic of|indicative of)|most likely has|likely has|points to)\b",
        r"\bin (?:a|this|the)\s+(?:\d+[\s-]?year[\s-]?old|patient|child|individual|case)\b.{0,120}?\bis associated with\b",
    ),
    "treatment": (r"you should take\b", r"i recommend\b.*\btreatment\b", r"prescribe\b", r"start\b.*\btherapy\b", r"the treatment is\b", r"take\b.*\bmedication\b"),
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def query_reason(text: Column | str, terms: Mapping[str, Sequence[str]] = QUERY_TERMS) -> Column:
    """Why a question is turned away: 'blank', or the first list with a term in it; null if it is let through."""
    text = _col(text)
    low = F.lower(text)
    reason = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "blank")
    for name, words in terms.items():
        reason = reason.when(contains_any(low, words), name)
    return reason


def response_reason(text: Column | str, has_evidence: Column | str, patterns: Mapping[str, Sequence[str]] = RESPONSE_PATTERNS) -> Column:
    """Why an answer is held back: a pattern group it matches, or 'uncited' if there is evidence and no [N]; else null.

    Without evidence every answer passes.
    """
    text, has = _col(text), _col(has_evidence)
    low = F.lower(text)
    reason = F.when(~has, F.lit(None).cast("string"))
    for name, group in patterns.items():
        reason = reason.when(low.rlike("|".join(group)), name)
    return reason.when(~text.rlike(r"\[\d+\]"), "uncited")


def fallback(titles: Column | str, n: int = 5, none: str = "No findings.") -> Column:
    """A list of the first findings, for an answer that was held back."""
    listed = F.array_join(F.transform(F.slice(_col(titles), 1, n), lambda t: F.concat(F.lit("- "), t)), "\n")
    return F.when(F.size(_col(titles)) > 0, F.concat(F.lit("FINDINGS:\n"), listed)).otherwise(none)
