"""Activity codes, headcount bands, estimates, buyer roles and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.functions.rules import (
    compact,
    contains_any,
    failures,
    filled,
    first_match,
    is_filled,
    nonzero,
    text,
    yes,
)
from leadloom.plays import Play


def normalize_naf(column: Column) -> Column:
    """Activity code without dots and blanks, upper case; NULL for empty."""
    return F.when(is_filled(column), F.upper(F.translate(column, ". ", "")))


def is_field_naf(column: Column) -> Column:
    code = normalize_naf(column)
    return yes(code.isin(*fixed.FIELD_NAF_CODES) | F.substring(code, 1, 2).isin(*fixed.FIELD_NAF_PREFIXES))


def is_digital_naf(column: Column) -> Column:
    return yes(F.substring(normalize_naf(column), 1, 2).isin(*fixed.DIGITAL_NAF_PREFIXES))


def naf_sector(column: Column) -> Column:
    """Sector of an activity code; field service first, then digital, then the section prefixes."""
    prefix = F.substring(normalize_naf(column), 1, 2)
    rules = [
        (is_field_naf(column) & (prefix == "81"), "Facilities / Maintenance"),
        (is_field_naf(column), "Field Services"),
        (is_digital_naf(column), "IT / Digital"),
    ]
    rules += [(prefix.isin(*prefixes), sector) for sector, prefixes in fixed.SECTOR_PREFIXES]
    return first_match(rules, "Other")


def headcount_size(column: Column) -> Column:
    """Company size of a headcount band code."""
    band = F.upper(F.trim(column))
    bands: dict[str, list[str]] = {}
    for code, size in fixed.HEADCOUNT_SIZES.items():
        bands.setdefault(size, []).append(code)
    return first_match([(band.isin(*codes), size) for size, codes in bands.items()], "unknown")


def passes_play(naf: Column, play: Play) -> Column:
    """Is this activity code one the play looks for?"""
    code = normalize_naf(naf)
    prefix = F.substring(code, 1, 2)
    wanted = F.lit(True)
    if play.target_naf_codes or play.target_naf_prefixes:
        wanted = code.isin(*play.target_naf_codes) | prefix.isin(*play.target_naf_prefixes)
    excluded = code.isin(*play.excluded_naf_codes) | prefix.isin(*play.excluded_naf_prefixes)
    return yes(code.isNotNull() & ~is_digital_naf(naf) & ~excluded & wanted)


def estimate_technicians(band: Column, codes: Column, found: Column) -> Column:
    """struct(low, high, point): a bounded estimate from the headcount band and site evidence."""
    band = text(band)
    small = contains_any(band, ("1-10", "1-5"))
    medium = contains_any(band, ("11-50", "10-49"))
    large = contains_any(band, ("51-200", "50-199"))
    base_low = first_match([(small, 5), (medium, 12), (large, 35)], 10)
    high = first_match([(small, 12), (medium, 45), (large, 120)], 50)
    branches = yes(F.array_contains(codes, fixed.MULTI_BRANCH))
    low = F.when(branches, F.greatest(base_low, F.lit(15))).otherwise(base_low)
    midpoint = F.floor((low + high) / 2).cast("int")
    point = F.when(found > 0, F.greatest(found.cast("int"), low + 5)).otherwise(midpoint)
    assumptions = failures(
        [
            (small, "Registry workforce band indicates small team"),
            (~small & medium, "Registry workforce band indicates medium field fleet"),
            (~small & ~medium & large, "Registry workforce band indicates substantial operations"),
            (branches, "Multi-branch evidence increases minimum technician baseline"),
            (found > 0, F.format_string("Identified %d specific team/technical profiles", found)),
        ]
    )
    return F.struct(low.alias("low"), high.alias("high"), point.alias("point"), assumptions.alias("assumptions"))


def buyer_role(title: Column, jurisdiction: Column) -> Column:
    """struct(role, seniority, rank) of a job title under the British or French dictionary."""
    words = F.lower(F.trim(title))

    def entry(role: str, seniority: str, rank: int) -> Column:
        return F.struct(F.lit(role).alias("role"), F.lit(seniority).alias("seniority"), F.lit(rank).alias("rank"))

    british = jurisdiction == "GB"
    rules = [(british & words.rlike(p), entry(r, s, k)) for p, r, s, k in fixed.BUYER_ROLES_GB]
    rules += [(~british & words.rlike(p), entry(r, s, k)) for p, r, s, k in fixed.BUYER_ROLES_FR]
    return first_match(rules, entry("OTHER_EXECUTIVE", "manager", 99))


def play_role(title: Column, play: Play) -> Column:
    """struct(role, priority) of the first buyer role of the play with a label inside the title, else NULL."""
    words = F.lower(text(title))
    return first_match(
        [
            (contains_any(words, labels), F.struct(F.lit(role).alias("role"), F.lit(priority).alias("priority")))
            for role, priority, labels in play.buyer_roles
        ]
    )


def contact_status(confidence: Column, discovery: Column, email: Column, needs_review: Column) -> Column:
    conf, disc = F.lower(text(confidence)), F.lower(text(discovery))
    return first_match(
        [
            (conf.isin("confirmed_by_reply", "published_personal", "deliverable", "verified"), "Usable contact"),
            (conf.isin("catch_all", "indeterminate") | (disc == "guessed"), "Guessed / risky — review"),
            (is_filled(email) & conf.isin("likely", "published_generic", "unverified"), "Email candidate"),
            (yes(needs_review) | conf.isin("needs_review", "none"), "Needs review"),
        ],
        "No email yet",
    )


def priority_label(score: Column, version: int = 3) -> Column:
    high = 70 if version == 3 else 75
    return first_match([(score >= high, "High"), (score >= 45, "Medium")], "Low")


def badges(
    stored: Column, signal: Column, award_count: Column, size: Column, person: Column, readiness: Column
) -> Column:
    """At most eight stored badges, else badges derived from the profile."""
    derived = compact(
        [
            F.when(signal.isin(*fixed.AWARD_SIGNALS), "Public award"),
            F.when(signal == "REGISTRY_FIELD", "Field registry"),
            F.when(award_count >= 2, F.concat(award_count.cast("string"), F.lit(" awards"))),
            F.when(size.isin("11-50", "51-200"), "SME fit"),
            F.when(is_filled(person), "Person named"),
            first_match([(readiness == "contact_ready", "Meeting-ready"),
                         (readiness == "human_review_required", "Needs human OK")]),
        ]
    )
    return F.when(F.coalesce(F.size(stored), F.lit(0)) > 0, stored).otherwise(derived)


def why_this_lead(stored: Column, why_now: Column, suspected_pain: Column) -> Column:
    """At most five stored reasons, else why-now and suspected pain."""
    return F.slice(F.coalesce(stored, compact([filled(why_now), filled(suspected_pain)])), 1, 5)


def primary_rank(opportunity: Column, acquisition: Column, urgency: Column) -> Column:
    """The first score that is neither NULL nor zero."""
    return F.coalesce(nonzero(opportunity), nonzero(acquisition), nonzero(urgency), F.lit(0))
