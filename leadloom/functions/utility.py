"""What a contact point is good for, and what a mailbox verdict says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.fixed import KIND_RANK, REVIEW_STATES, SOURCE_RANK, USABLE_STATES, UTILITY_RANK, VERDICT_RANK
from leadloom.functions.rules import first_match, is_filled, yes

VERDICT_SCHEMA = (
    "struct<is_reachable string, smtp struct<is_deliverable boolean, is_catch_all boolean>, "
    "mx struct<accepts_mail boolean>, syntax struct<is_valid_syntax boolean>>"
)


def derive_utility(
    kind: Column,
    publication: Column,
    deliverability: Column,
    person_match: Column,
    suppressed: Column | None = None,
    confirmed: Column | None = None,
    expires_at: Column | None = None,
    as_of: Column | None = None,
) -> Column:
    """Usefulness of a contact point; the first rule that holds decides."""
    suppressed = F.lit(False) if suppressed is None else yes(suppressed)
    confirmed = F.lit(False) if confirmed is None else yes(confirmed)
    stale = F.lit(False) if expires_at is None else yes(expires_at < as_of)
    deliverable = deliverability == "deliverable"
    return first_match(
        [
            (suppressed, "suppressed"),
            (stale, "stale"),
            (deliverability == "invalid", "invalid"),
            (deliverability.isin("catch_all", "risky", "indeterminate", "error"), "manual_confirmation_required"),
            (kind == "contact_form", "usable_generic"),
            (kind.isin("phone", "linkedin", "generic_contact_page"), "usable_role"),
            (kind != "email", "no_contact"),
            (confirmed, "usable_personal"),
            (
                (publication == "published_personal")
                & person_match.isin("exact_person_published", "strong_person_match"),
                "usable_personal",
            ),
            ((publication == "published_role") | (person_match == "role_mailbox"), "usable_role"),
            ((publication == "published_generic") | (person_match == "generic_company_mailbox"), "usable_generic"),
            ((person_match == "exact_person_pattern_confirmed") & deliverable, "usable_personal"),
            (person_match == "exact_person_pattern_confirmed", "verification_required"),
            (person_match.isin("pattern_inferred", "name_only_guess"), "manual_confirmation_required"),
        ],
        "verification_required",
    )


def is_usable(utility: Column) -> Column:
    return yes(utility.isin(*USABLE_STATES))


def needs_review(utility: Column) -> Column:
    return yes(utility.isin(*REVIEW_STATES))


def ranked(column: Column, ranks: dict[str, int], default: int) -> Column:
    return first_match([(column == name, rank) for name, rank in ranks.items()], default)


def utility_rank(column: Column) -> Column:
    return ranked(column, UTILITY_RANK, 7)


def kind_rank(column: Column) -> Column:
    return ranked(column, KIND_RANK, 8)


def source_rank(column: Column) -> Column:
    return ranked(column, SOURCE_RANK, 99)


def verdict_rank(confidence: Column) -> Column:
    return ranked(F.when(is_filled(confidence), confidence).otherwise("unknown"), VERDICT_RANK, 7)


def normalise_verdict(payload: Column) -> Column:
    """struct of a raw mailbox-check payload; catch-all outranks every other state."""
    raw = F.from_json(payload, VERDICT_SCHEMA)
    reachable = F.lower(F.when(is_filled(raw["is_reachable"]), raw["is_reachable"]).otherwise("unknown"))
    delivers, catch_all = raw["smtp"]["is_deliverable"], raw["smtp"]["is_catch_all"]
    syntax = raw["syntax"]["is_valid_syntax"]
    state = first_match(
        [
            (yes(catch_all), "catch_all"),
            ((reachable == "safe") & yes(delivers), "deliverable"),
            (reachable == "risky", "risky"),
            ((reachable == "invalid") | yes(syntax == F.lit(False)), "invalid"),
        ],
        "indeterminate",
    )
    return F.struct(
        reachable.alias("is_reachable"),
        delivers.alias("is_deliverable"),
        catch_all.alias("is_catch_all"),
        state.alias("confidence"),
        first_match([(delivers, "deliverable"), (~delivers, "not_deliverable")], "unknown").alias("smtp_state"),
        F.when(yes(raw["mx"]["accepts_mail"]), "valid").otherwise("unknown").alias("mx_state"),
        syntax.alias("syntax_valid"),
    )


def mx_deliverability(mx_state: Column, has_mx: Column, current: Column) -> Column:
    """Deliverability after the mail-exchanger lookup; unchanged where mail is accepted."""
    return first_match(
        [
            (yes(has_mx), current),
            (mx_state.isin("no_mx", "null_mx", "invalid_syntax"), "invalid"),
        ],
        "indeterminate",
    )


def waterfall_outcome(best_email: Column, best_confidence: Column, harvested: Column, verify: bool = True) -> Column:
    """struct(email, source, confidence, state, needs_review, usable_for_send) of the best candidate.

    ``best_*`` is the best checked address or NULL; the first harvested address
    stands in for it.  A guessed address is never ready to send.
    """
    first_harvested = F.get(harvested, F.lit(0))
    fallback = best_email.isNull() & first_harvested.isNotNull()
    email = F.coalesce(best_email, first_harvested)
    verdict = F.when(fallback, F.lit("unverified")).otherwise(best_confidence)
    given = F.when(is_filled(verdict), verdict)
    known = email.isNotNull()
    from_harvest = yes(F.array_contains(harvested, email))
    source = first_match(
        [
            (~known, "none"),
            (verdict.isin("deliverable", "verified", "catch_all"), "reacher"),
            (from_harvest, "theharvester"),
        ],
        "reacher" if verify else "permutation",
    )
    confidence = first_match(
        [
            (~known, "needs_review"),
            (verdict.isin("deliverable", "verified", "catch_all"), verdict),
            (from_harvest, F.coalesce(given, F.lit("unverified"))),
        ],
        F.coalesce(given, F.lit("domain_and_pattern_only")),
    )
    return F.struct(
        email.alias("email"),
        source.alias("source"),
        confidence.alias("confidence"),
        F.lit("guessed").alias("state"),
        F.lit(True).alias("needs_review"),
        F.lit(False).alias("usable_for_send"),
    )
