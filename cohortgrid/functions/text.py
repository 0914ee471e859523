"""Text tests as column expressions. Patterns are literals, so each is compiled once per task."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortgrid.functions.cleaning import status_label
from cohortgrid.functions.vocabulary import BANNED_PHRASES, CONFLICTING, FREE_NUMBERS, SUPPORTING

# (?iU): ignore case, and letters of any script count as word characters on every Java version.
_FLAGS = "(?iU)"
NUMBER = r"(?<![A-Za-z0-9._-])(\d+(?:\.\d+)?)\s*%?"
GATE_CLAIM = (
    r"\b(all|every|each)\b[^.]{0,40}\bgates?\b[^.]{0,40}\b(passed|pass|succeeded)\b"
    r"|\bno\b[^.]{0,20}\bgates?\b[^.]{0,20}\b(failed|fail)\b"
    r"|\bgates?\b[^.]{0,30}\ball\b[^.]{0,20}\bpassed\b"
)
DOI = r"\b10\.\d{4,9}/[^\s\"'<>]+\b"
PMID = r"(?i)\bPMID:?\s*(\d{5,9})\b"
PMCID = r"(?i)\b(PMC\d{5,10})\b"


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(_FLAGS + pattern), F.lit(False))


def matched_patterns(text: Column, patterns: Sequence[str] = BANNED_PHRASES) -> Column:
    """The patterns found in the text, in list order."""
    return F.array_compact(F.array(*[F.when(matches(text, p), F.lit(p)) for p in patterns]))


def stance(text: Column, supporting: Sequence[str] = SUPPORTING, conflicting: Sequence[str] = CONFLICTING) -> Column:
    """supporting, conflicting, neutral (neither) or unclear (both, or no text)."""
    s = matches(text, "(?:" + "|".join(supporting) + ")")
    c = matches(text, "(?:" + "|".join(conflicting) + ")")
    empty = F.coalesce(text == "", F.lit(True))
    return F.when(empty | (s & c), "unclear").when(s, "supporting").when(c, "conflicting").otherwise("neutral")


def numbers(text: Column, free: Sequence[str] = FREE_NUMBERS) -> Column:
    """Distinct numbers written in the text, without those that need no evidence."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(1)))
    return F.filter(found, lambda x: ~x.isin(list(free)))


def named(text: Column, names: Sequence[str]) -> Column:
    """Watch-list names that occur as whole words."""

    def found(low: Column) -> Column:
        return F.array_compact(F.array(*[F.when(low.contains(n.lower()) & low.rlike(r"(?U)\b" + re.escape(n.lower()) + r"\b"), F.lit(n.lower())) for n in names]))

    # A lambda over one element, so that the text is put in lower case once.
    return F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), found)[0]


def claims_all_passed(text: Column) -> Column:
    return matches(text, GATE_CLAIM)


def citation_key(doi: Column, pmid: Column, pmcid: Column, title: Column, year: Column) -> Column:
    """DOI, then PMID, then PMCID, then normalised title with year."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))

    def have(c: Column) -> Column:
        return F.when(c != "", c)

    return F.coalesce(
        F.concat(F.lit("doi:"), F.lower(F.trim(have(doi)))), F.concat(F.lit("pmid:"), F.trim(have(pmid))), F.concat(F.lit("pmcid:"), F.trim(have(pmcid))),
        F.concat(F.lit("title:"), plain, F.lit(":"), F.coalesce(year.cast("string"), F.lit(""))))


def p_text(p: Column) -> Column:
    return F.when(p < 0.001, "<0.001").otherwise(F.format_string("%.3f", p))


def percent_text(c: Column) -> Column:
    return F.format_string("%.0f%%", c * 100)


def eligibility(text: Column, her2: Column, er: Column, pr: Column, age: Column, ecog: Column, stage: Column) -> Column:
    """Parsed criteria as (criterion, status) entries; `unknown` where the profile has no value."""

    def entry(name: str, status: Column) -> Column:
        return F.struct(F.lit(name).alias("criterion"), status.alias("status"))

    def need(state: Column, wanted: str, other: str) -> Column:
        return F.when(state == wanted, "met").when(state == other, "not_met").otherwise("unknown")

    h, e, p = status_label(her2, amplification=True), status_label(er), status_label(pr)

    def rules(t: Column, low: Column) -> list[tuple[Column, str, Column]]:
        """A pattern is only tried where a word that it can't match without is in the lower-case text."""

        def has(word: str, pattern: str) -> Column:
            return low.contains(word) & t.rlike(pattern)

        def number(word: str, pattern: str) -> Column:
            return F.when(low.contains(word), F.regexp_extract(t, pattern, 1)).otherwise("")

        years, ecog_max = number("years", r"(?i)(\d{1,3})\s*years"), number("ecog", r"(?i)ECOG.*?([0-2])")
        return [
            (has("her2", r"(?i)her2[\s-]*(negative|non-amplified|ihc\s*0|ihc\s*1\+?)"), "HER2-negative requirement", need(h, "negative", "positive")),
            (has("her2", r"(?i)her2[\s-]*(positive|amplified|ihc\s*3\+)"), "HER2-positive requirement", need(h, "positive", "negative")),
            (has("positive", r"(?i)(er|estrogen receptor)[\s-]*positive"), "ER-positive requirement", need(e, "positive", "negative")),
            (has("negative", r"(?i)(er|estrogen receptor)[\s-]*negative"), "ER-negative requirement", need(e, "negative", "positive")),
            # U also lets long s and dotless i match, so only letters without such twins are looked for.
            (low.contains("po") & has("pr", r"(?iU)\bPR[\s-]*positive|progesterone receptor[\s-]*positive"), "PR-positive requirement", need(p, "positive", "negative")),
            (years != "", "Minimum age", F.when(age.isNull(), "unknown").when(age < years.try_cast("double"), "not_met").otherwise("met")),
            (ecog_max != "", "ECOG performance status", F.when(ecog.isNull(), "unknown").when(ecog <= ecog_max.try_cast("int"), "met").otherwise("not_met")),
            (has("stage", r"(?i)stage\s+(IV|4|III|3|II|2)"), "Stage requirement", F.lit("unknown")),
        ]

    def found(x: Column) -> Column:
        return F.array_compact(F.array(*[F.when(hit, entry(name, status)) for hit, name, status in rules(x["t"], x["low"])]))

    # Lambdas over one element name what is used more than once, so that it is worked out once.
    t = F.coalesce(text, F.lit(""))
    each = F.transform(F.array(t), lambda x: F.struct(x.alias("t"), F.lower(x).alias("low")))
    return F.transform(F.transform(each, found), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(entry("General eligibility", F.lit("unknown")))))[0]


def eligibility_class(criteria: Column) -> Column:
    """Any not-met rules out; a met criterion other than age counts as eligible; else not enough is known."""
    disease = F.exists(criteria, lambda c: (c["status"] == "met") & ~c["criterion"].isin("Minimum age", "General eligibility"))
    return F.when(F.exists(criteria, lambda c: c["status"] == "not_met"), "potentially_ineligible").when(disease, "potentially_eligible").otherwise("insufficient_information")
