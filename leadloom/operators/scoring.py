"""The explainable score: six components, penalties, readiness gates, projections.

``score_inputs`` brings everything a prospect is scored on into one row with
fixed-size facts; every component after that is a column expression, so the
whole score is one narrow stage.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.functions.codes import is_digital_naf, play_role, priority_label
from leadloom.functions.rules import (
    compact,
    contains_any,
    failures,
    filled,
    first_match,
    is_filled,
    text,
    yes,
)
from leadloom.operators.activity import last_events
from leadloom.operators.awards import award_facts, is_recent
from leadloom.operators.compliance import mark_suppressed
from leadloom.operators.evidence import evidence_facts, normalize_signals, source_types, trigger_labels
from leadloom.plays import Play

AsOf = str | date | datetime


# --- Inputs -----------------------------------------------------------------


def latest_review(reviews: DataFrame) -> DataFrame:
    """The newest review per prospect, then the highest id."""
    fields = [name for name in reviews.columns if name != "prospect_id"]
    newest = F.max_by(F.struct(*fields), F.struct("created_at", "id"))
    return reviews.groupBy("prospect_id").agg(newest.alias("review"))


def is_full_accept(review: Column) -> Column:
    """An accept with all six confirmations."""
    accepted = yes(review["decision"] == "accept")
    for flag in fixed.REVIEW_FLAGS:
        accepted = accepted & yes(review[flag])
    return accepted


def full_accept(prospects: DataFrame, reviews: DataFrame) -> DataFrame:
    latest = latest_review(reviews).withColumnRenamed("prospect_id", "id")
    return prospects.join(latest, "id", "left").withColumn("human_accepted", is_full_accept(F.col("review")))


def offer_ok(prospects: DataFrame, assets: DataFrame) -> DataFrame:
    """Add ``offer_ok``: an active asset of the prospect's play or of any play; without a play any asset will do.

    An equality join on the play plus two scalar subqueries instead of a theta join.
    """
    active = assets.filter(yes(F.col("is_active")))
    plays = active.select(F.col("market_play_code").alias("_play")).filter(is_filled(F.col("_play"))).distinct()
    some = active.agg(F.count(F.lit(1)) > 0).scalar()
    general = active.agg(F.coalesce(F.bool_or(F.col("market_play_code").isNull()), F.lit(False))).scalar()
    joined = prospects.join(plays, F.col("market_play_code") == F.col("_play"), "left")
    ok = F.when(is_filled(F.col("market_play_code")), F.col("_play").isNotNull() | general).otherwise(some)
    return joined.withColumn("offer_ok", ok).drop("_play")


FACT_DEFAULTS = {
    "signal_count": 0,
    "structural_count": 0,
    "pain_confirmed": False,
    "has_trigger": False,
    "has_award_evidence": False,
    "award_count": 0,
    "award_total_cents": 0,
    "recent_awards": 0,
}


def score_inputs(
    prospects: DataFrame,
    evidence: DataFrame,
    reviews: DataFrame,
    suppression: DataFrame,
    assets: DataFrame,
    awards: DataFrame,
    as_of: AsOf,
    stage: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Prospects with evidence, award, review, suppression and offer facts.

    The normalised evidence is read twice; ``stage`` may write it in between.
    """
    signals = stage(normalize_signals(evidence))
    facts = evidence_facts(signals).withColumnRenamed("prospect_id", "id")
    labels = trigger_labels(signals).withColumnRenamed("prospect_id", "id")
    won = award_facts(awards, as_of).withColumnRenamed("prospect_id", "id")
    latest = latest_review(reviews).withColumnRenamed("prospect_id", "id")
    out = prospects.drop("award_count", "is_suppressed", "offer_ok")
    for part in (facts, labels, won, latest):
        out = out.join(part, "id", "left")
    out = offer_ok(mark_suppressed(out, suppression), assets)
    return out.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in FACT_DEFAULTS.items()})


# --- Components -------------------------------------------------------------


def _words() -> Column:
    return F.concat(F.lower(text(F.col("signal_details"))), F.lit(" "), F.lower(text(F.col("notes"))))


def _naf() -> Column:
    return F.upper(F.replace(text(F.col("naf_code")), F.lit("."), F.lit("")))


def fit(rows: DataFrame, play: Play) -> DataFrame:
    """Add ``fit`` and its penalty from activity code, size and structural language."""
    naf, size = _naf(), F.col("company_size")
    prefix = F.substring(naf, 1, 2)
    known = naf != ""
    two = F.length(naf) >= 2
    excluded = known & (naf.isin(*play.excluded_naf_codes) | (two & prefix.isin(*play.excluded_naf_prefixes)))
    target = known & (naf.isin(*play.target_naf_codes) | (two & prefix.isin(*play.target_naf_prefixes)))
    out = rows.withColumns(
        {
            "naf_class": first_match([(excluded, "excluded"), (target, "target"), (known, "adjacent")], "none"),
            "complex_words": contains_any(_words(), fixed.COMPLEXITY_KEYWORDS),
        }
    )
    kind = F.col("naf_class")
    base = first_match([(kind == "excluded", 5), (kind == "target", 85), (kind == "adjacent", 40)], 25)
    medium = yes(size.isin("11-50", "51-200"))
    sized = F.least(F.lit(100), base + first_match([(medium, 15), (size == "1-10", 5)], 0))
    out = out.withColumn("_sized", sized)
    sized = F.col("_sized")
    penalty = first_match([(kind == "excluded", play.penalty("internal_it_team", 25))], 0) + first_match(
        [
            ((size == "1-10") & (sized < 50), play.penalty("micro_weak", 10)),
            (size == "200+", play.penalty("oversized", 15)),
        ],
        0,
    )
    complexity = F.least(F.lit(100), sized + F.when(F.col("complex_words"), 5).otherwise(0))
    total = F.least(F.lit(100), complexity + 3 * F.col("structural_count"))
    return out.withColumns({"fit": total.cast("int"), "fit_penalty": penalty}).drop("_sized")


def pain(rows: DataFrame) -> DataFrame:
    """Add ``pain``: explicit workflow language, pain evidence or a human confirmation; awards never add any."""
    worded = contains_any(_words(), fixed.PAIN_KEYWORDS)
    confirmed = yes(F.col("review.pain_confirmed"))
    score = F.greatest(
        F.when(worded, 40).otherwise(0),
        F.coalesce("pain_strength", F.lit(0)),
        F.when(F.col("pain_confirmed"), 55).otherwise(0),
        F.when(confirmed, 55).otherwise(0),
    )
    return rows.withColumns({"pain_words": worded, "pain_reviewed": confirmed, "pain": score.cast("int")})


def trigger(rows: DataFrame) -> DataFrame:
    """Add ``trigger`` and its penalty from award timing, signal type and trigger evidence."""
    recent, awards, signal = F.col("recent_awards"), F.col("award_count"), F.col("signal_type")
    timed = F.when(recent > 0, F.least(F.lit(100), 40 + 15 * recent)).otherwise(10)
    several = F.when(awards >= 2, F.least(F.lit(100), timed + 12)).otherwise(timed)
    signalled = first_match(
        [
            (signal.isin(*fixed.AWARD_SIGNALS), F.greatest(several, F.lit(45))),
            (signal == "REGISTRY_IT", F.least(several, F.lit(20))),
            (signal.isin("REGISTRY_FIELD", "STRUCTURAL"), F.greatest(several, F.lit(20))),
        ],
        several,
    )
    score = F.when(F.col("has_trigger"), F.greatest(signalled, F.lit(55))).otherwise(signalled)
    penalty = F.when(yes(signal == "REGISTRY_IT"), 10).otherwise(0)
    return rows.withColumns({"trigger": score.cast("int"), "trigger_penalty": penalty})


CONTACT_CLASSES = ("ready", "manual", "generic", "guessed", "risky", "dead", "unknown")


def authority(rows: DataFrame, play: Play) -> DataFrame:
    """Add ``authority``, ``contact_class`` and ``contact_usable`` from the person and the contact state."""
    conf, disc = F.lower(text(F.col("contact_confidence"))), F.lower(text(F.col("contact_discovery_state")))
    contact = first_match(
        [
            (conf.isin(*fixed.READY_CONFIDENCE) & (disc != "guessed"), "ready"),
            (conf == "manual_confirmed", "manual"),
            (conf == "published_generic", "generic"),
            (conf.isin("likely", "domain_and_pattern_only", "unverified") | (disc == "guessed"), "guessed"),
            (conf.isin("catch_all", "indeterminate", "risky"), "risky"),
            (conf.isin("invalid", "bounced", "suppressed"), "dead"),
        ],
        "unknown",
    )
    role = play_role(F.col("decision_maker_title"), play) if play.buyer_roles else F.lit(None).cast("struct<role string, priority int>")
    out = rows.withColumns({"buyer_match": role, "contact_class": contact})
    named = is_filled(F.col("decision_maker_name"))
    matched = F.coalesce(F.greatest(F.lit(15), 100 - (F.col("buyer_match.priority") - 1) * 10), F.lit(15))
    person = F.when(named, F.when(matched < 40, 35).otherwise(matched)).otherwise(F.least(matched, F.lit(25)))
    kind = F.col("contact_class")
    bonus = first_match([(kind == "ready", 15), (kind == "manual", 12), (kind == "generic", 5)], 0)
    return out.withColumns(
        {
            "person_named": named & (matched < 40),
            "authority": F.least(F.lit(100), person + bonus).cast("int"),
            "authority_penalty": F.when(kind == "dead", 5).otherwise(0),
            "contact_usable": kind.isin("ready", "manual") & (named | is_filled(F.col("email"))),
        }
    )


def value(rows: DataFrame) -> DataFrame:
    """Add ``value`` from the award total and the company size."""
    cents = F.col("award_total_cents")
    base = first_match([(cents >= 10_000_000, 80), (cents >= 4_000_000, 65)], 40)
    medium = yes(F.col("company_size").isin("11-50", "51-200"))
    return rows.withColumn("value", F.least(F.lit(100), base + F.when(medium, 10).otherwise(0)).cast("int"))


def data_quality(rows: DataFrame, play: Play) -> DataFrame:
    """Add ``source_count``, ``data_quality``, its penalty, and the counted signals."""
    registered = is_filled(F.col("siren")) | is_filled(F.col("siret"))
    out = rows.withColumn("sources", source_types(F.col("signal_sources"), F.col("award_count") > 0, registered))
    out = out.withColumn("source_count", F.size("sources"))
    score = (
        25
        + F.least(F.lit(50), 15 * F.col("source_count"))
        + F.when(is_filled(F.col("data_source")), 10).otherwise(0)
        + F.when(is_filled(F.col("website")), 5).otherwise(0)
    )
    extra = F.when((F.col("award_count") > 0) & ~F.col("has_award_evidence"), 1).otherwise(0)
    return out.withColumns(
        {
            "data_quality": F.least(F.lit(100), score).cast("int"),
            "quality_penalty": F.when(F.col("source_count") <= 1, play.penalty("single_source", 10)).otherwise(0),
            "active_signals": (F.col("signal_count") + extra).cast("int"),
        }
    )


COMPONENTS = ("fit", "pain", "trigger", "authority", "value", "data_quality")


def clamp(score: Column) -> Column:
    """Half-even to a whole number between 0 and 100."""
    return F.least(F.greatest(F.bround(score), F.lit(0.0)), F.lit(100.0)).cast("int")


def opportunity(rows: DataFrame, weights: dict[str, float] | None = None, override: int = 0) -> DataFrame:
    """Add ``opportunity_score``: weighted sum, damped by data quality, less penalties."""
    weights = weights or fixed.DEFAULT_WEIGHTS
    raw = F.lit(weights["fit"]) * F.col("fit")
    for name in COMPONENTS[1:]:
        raw = raw + F.lit(weights[name]) * F.col(name)
    trust = F.lit(0.65) + F.lit(0.35) * (F.col("data_quality") / F.lit(100.0))
    return rows.withColumn("opportunity_score", clamp(raw * trust - F.col("penalties") + F.lit(override)))


def readiness(rows: DataFrame, play: Play) -> DataFrame:
    """Add ``readiness_state`` and ``readiness_failures``; suppression first, then the gates in order."""
    cfg = play.readiness
    floor = lambda name, default: int(cfg.get(name, default))
    fit_min, pain_min = floor("fit_score_min", 55), floor("pain_score_min", 40)
    trigger_min, authority_min = floor("trigger_score_min", 25), floor("authority_score_min", 40)
    quality_min = floor("data_quality_min", 45)
    human, accepted = cfg.get("human_review_required", True), F.col("human_accepted")
    rules = [
        (F.col("fit") < fit_min, f"fit_score < {fit_min}"),
        (F.col("pain") < pain_min, f"pain_score < {pain_min} (need real workflow pain, not award alone)"),
        (F.col("trigger") < trigger_min, f"trigger_score < {trigger_min}"),
        (F.col("authority") < authority_min, f"authority_score < {authority_min}"),
        (F.col("data_quality") < quality_min, f"data_quality < {quality_min}"),
        (F.col("active_signals") < floor("active_signals_min", 2), "insufficient_signals"),
        (F.col("source_count") < floor("independent_source_types_min", 2), "insufficient_independent_sources"),
        (~F.col("contact_usable"), "contact_required"),
    ]
    if cfg.get("offer_asset_required", False):
        rules.append((~F.col("offer_ok"), "proof_required"))
    if human:
        rules.append((~accepted, "human_review_required"))
    suppressed = yes(F.col("opted_out")) | yes(F.col("is_suppressed"))
    out = rows.withColumn("_failures", failures(rules))
    failed = F.col("_failures")
    only_human = (F.size(failed) == 1) & F.array_contains(failed, "human_review_required")
    state = first_match(
        [
            (suppressed, "suppressed"),
            ((F.size(failed) == 0) & (F.col("pain") < 40), "research_required"),
            ((F.size(failed) == 0) & ~accepted, "human_review_required"),
            (F.size(failed) == 0, "contact_ready"),
            (only_human, "human_review_required"),
            (F.array_contains(failed, "contact_required") & (F.col("fit") >= 55) & (F.col("pain") >= 40), "contact_required"),
            (F.col("fit") < 40, "insufficient_identity"),
        ],
        "research_required",
    )
    listed = first_match(
        [
            (suppressed, F.array(F.lit("Company or contact is suppressed"))),
            ((F.size(failed) == 0) & (F.col("pain") < 40),
             F.array(F.lit("pain_score insufficient (award alone is not pain)"))),
            ((F.size(failed) == 0) & ~accepted, F.array(F.lit("human_review_required"))),
        ],
        failed,
    )
    return out.withColumns({"readiness_state": state, "readiness_failures": listed}).drop("_failures")


def explain(rows: DataFrame, play: Play) -> DataFrame:
    """Add the sentences and badges behind a score."""
    naf, kind, contact = _naf(), F.col("naf_class"), F.col("contact_class")
    size, matched = F.col("company_size"), F.col("buyer_match").isNotNull()
    medium = yes(size.isin("11-50", "51-200"))
    recent, awards = F.col("recent_awards"), F.col("award_count")
    pain_hit = F.col("pain_words") | F.col("pain_strength").isNotNull() | F.col("pain_reviewed")
    suspected = first_match(
        [
            (F.col("pain_words"), "Explicit manual/workflow language in notes or details"),
            (F.col("pain_strength").isNotNull(), F.col("pain_label")),
            (F.col("pain_reviewed"), "Human confirmed operational pain"),
            (awards > 0, fixed.SUSPECTED_FROM_AWARDS),
        ],
        play.pain_hypothesis,
    )
    timing = F.concat(
        compact(
            [
                F.when(recent > 0, F.concat(recent.cast("string"), F.lit(" recent public award(s)"))),
                F.when(awards >= 2, F.lit("Multiple awards in window")),
            ]
        ),
        F.coalesce(F.col("trigger_labels"), F.array().cast("array<string>")),
    )
    out = rows.withColumns(
        {
            "suspected_pain": suspected,
            "why_now": F.when(F.size(timing) > 0, F.array_join(timing, "; ")).otherwise(fixed.NO_TIMING),
            "recommended_buyer_role": F.coalesce("buyer_match.role", F.lit("gerant_owner")),
            "recommended_offer": F.lit(play.offer_name).cast("string"),
        }
    )
    badge = compact(
        [
            first_match([(kind == "excluded", "IT exclusion"), (kind == "target", "Target NAF")]),
            first_match([(medium, "SME fit"), (size == "200+", "Large")]),
            F.when(F.col("complex_words"), "Structural complexity"),
            F.when(F.col("pain_words"), "Manual workflow"),
            F.when(F.col("pain_confirmed") | F.col("pain_reviewed"), "Pain confirmed"),
            F.when(recent > 0, F.concat(recent.cast("string"), F.lit(" award(s)"))),
            F.when(awards >= 2, "Multi-award"),
            F.when(matched, "Buyer role match"),
            F.when(F.col("person_named"), "Person named"),
            first_match(
                [
                    (contact == "ready", "Contact OK"),
                    (contact == "manual", "Contact manually confirmed"),
                    (contact == "generic", "Generic mailbox only"),
                    (contact == "guessed", "Guessed email"),
                    (contact == "risky", "Risky/catch-all contact"),
                ]
            ),
            F.when(F.col("award_total_cents") >= 10_000_000, "≥100k€ awards"),
        ]
    )
    reason = compact(
        [
            first_match(
                [
                    (kind == "excluded", "Excluded NAF (software/digital) — not target buyer"),
                    (kind == "target", F.concat(F.lit("NAF "), naf, F.lit(" matches field-service play"))),
                    (kind == "adjacent", F.concat(F.lit("NAF "), naf, F.lit(" adjacent / unverified for play"))),
                ]
            ),
            F.when(medium, "Headcount in mid-market service sweet spot"),
            F.when(F.col("pain_words"), "Pain from explicit workflow evidence (Excel/paper/WhatsApp/double entry…)"),
            F.when(~pain_hit & is_filled(F.col("suspected_pain")),
                   "Suspected pain is hypothesis only — does not satisfy pain gate"),
            F.when(recent > 0, "Public award = timing/capacity signal, not proof of software need"),
            F.when(matched, F.concat(F.lit("Title matches preferred buyer role ("), F.col("buyer_match.role"), F.lit(")"))),
            first_match(
                [
                    (contact == "generic", "Generic role email is not person-matched — LinkedIn-first or research"),
                    (contact == "guessed", "Guessed/pattern email is not email-contact-ready"),
                ]
            ),
        ]
    )
    brief = F.concat(
        F.lit("Observed: "), F.coalesce("company_name", F.lit("Company")),
        F.when(naf != "", F.concat(F.lit(" (NAF "), naf, F.lit(")"))).otherwise(""),
        F.lit("\nWhy now: "), F.col("why_now"),
        F.lit("\nPain status: "), F.coalesce(filled(F.col("suspected_pain")), F.lit("none verified")),
        F.lit(" (score="), F.col("pain").cast("string"), F.lit("; hypothesis≠evidence)"),
        F.lit("\nBuyer role: "), F.col("recommended_buyer_role"),
        F.lit("\nOffer: "), F.coalesce("recommended_offer", F.lit("None")),
        F.lit("\nSafe first line: reference a real award/object or multi-site ops — do not invent internal tools."
              "\nDo not claim: that they lack software, or that an award proves budget for custom software."
              "\nCTA: short diagnostic call on intervention/planning flow."),
    )
    return out.withColumns(
        {
            "badges": F.array_distinct(badge),
            "reasons": reason,
            "personalization_brief": brief,
        }
    )


def score(inputs: DataFrame, play: Play) -> DataFrame:
    """All components, penalties, the score, readiness and explanations for prepared inputs."""
    out = fit(inputs, play)
    out = trigger(pain(out))
    out = data_quality(value(authority(out, play)), play)
    penalties = ("fit_penalty", "trigger_penalty", "authority_penalty", "quality_penalty")
    total = F.col(penalties[0])
    for name in penalties[1:]:
        total = total + F.col(name)
    out = out.withColumns({"penalties": total, "human_accepted": is_full_accept(F.col("review"))})
    out = readiness(opportunity(out, play.weights), play)
    return explain(out, play).drop(*penalties)


def project_scores(scored: DataFrame, play: Play) -> DataFrame:
    """Copy the score into the prospect columns and derive label, stage and review flag."""
    state, total = F.col("readiness_state"), F.col("opportunity_score")
    stage = first_match(
        [
            (state == "contact_ready", "contact_ready"),
            (state == "human_review_required", "human_review_required"),
            (state == "suppressed", "suppressed"),
            (state == "contact_required", "enriched"),
        ],
        "researching",
    )
    review = first_match(
        [(state == "contact_ready", False), (state == "suppressed", yes(F.col("needs_manual_review")))], True
    )
    return scored.withColumns(
        {
            "acquisition_score": total,
            "urgency_score": total,
            "priority_level": priority_label(total),
            "acquisition_stage": stage,
            "needs_manual_review": review,
            "fit_score": F.col("fit"),
            "pain_score": F.col("pain"),
            "trigger_score": F.col("trigger"),
            "timing_score": F.col("trigger"),
            "authority_score": F.col("authority"),
            "contactability_score": F.col("authority"),
            "value_score": F.col("value"),
            "data_quality_score": F.col("data_quality"),
            "market_play_code": F.coalesce(filled(F.col("market_play_code")), F.lit(play.code)),
        }
    )


# --- Other scores -----------------------------------------------------------


def code_score(rows: DataFrame) -> DataFrame:
    """Score from evidence ``codes`` and readiness flags; zero when a hard gate failed."""
    parts = [
        ("base_icp_fit", F.lit(True), 40.0),
        ("multi_branch_evidence", yes(F.array_contains("codes", fixed.MULTI_BRANCH)), 15.0),
        ("recurring_contracts_evidence", yes(F.array_contains("codes", fixed.RECURRING_CONTRACTS)), 15.0),
        ("on_call_247_evidence", yes(F.array_contains("codes", fixed.ON_CALL)), 10.0),
        ("buyer_identified", yes(F.col("has_buyer")), 10.0),
        ("contact_path_verified", yes(F.col("has_contact")), 10.0),
    ]
    total = F.lit(0.0)
    entries = []
    for name, condition, points in parts:
        total = total + F.when(condition, points).otherwise(0.0)
        entries.append(F.when(condition, F.struct(F.lit(name), F.lit(points))))
    passed = F.coalesce(F.col("hard_gates_passed"), F.lit(True))
    return rows.withColumns(
        {
            "total_score": F.when(passed, F.least(total, F.lit(100.0))).otherwise(0.0),
            "breakdown": F.map_from_entries(compact(entries)),
        }
    )


def _v2_facts(prospects: DataFrame, events: DataFrame, awards: DataFrame, as_of: AsOf) -> DataFrame:
    amount = F.col("montant").try_cast("double")
    won = awards.groupBy(F.col("prospect_id").alias("id")).agg(
        F.count_if(is_recent(F.col("date"), as_of, 180)).alias("_recent"),
        F.coalesce(F.bool_or(amount >= 50_000), F.lit(False)).alias("_large"),
    )
    last = last_events(events).select(F.col("prospect_id").alias("id"), F.col("event_date").alias("_last"))
    out = prospects.join(won, "id", "left").join(last, "id", "left")
    age = F.floor(F.timestamp_diff("SECOND", F.col("_last").cast("timestamp_ntz"), F.lit(str(as_of)).cast("timestamp_ntz")) / 86400)
    return out.withColumns(
        {"_recent": F.coalesce("_recent", F.lit(0)), "_large": yes(F.col("_large")), "_stale": yes(age > 21)}
    )


def _v2_parts(explained: bool) -> list[tuple[str, Column, int]]:
    details = F.lower(text(F.col("signal_details")))
    signal, title = F.col("signal_type"), F.lower(text(F.col("decision_maker_title")))
    won = yes(signal.isin("DECP_WIN", "BOAMP_WIN"))
    parts = [
        ("Public award (DECP/BOAMP)", won, 30),
        ("Multiple recent awards", won & ((F.col("_recent") >= 2) | details.contains("multiple")), 15),
        ("High value or cyber signal", won & (F.col("_large") | details.contains("cyber")), 10),
        ("Morocco ops signal", yes(signal == "MOROCCO_OPS"), 15),
        ("Pain post signal", yes(signal == "PAIN_POST"), 20),
    ]
    if explained:
        parts.append(("IT/cyber NAF", is_digital_naf(F.col("naf_code")), 12))
    else:
        parts.append(("Registry IT", yes(signal == "REGISTRY_IT"), 18))
    return parts + [
        ("Senior decision-maker title", contains_any(title, fixed.SENIOR_TITLES_V2), 10),
        ("SME size fit", yes(F.col("company_size").isin("11-50", "51-200")), 8),
        ("Verified email", yes(F.col("contact_confidence") == "verified"), 3),
        ("Stale outreach decay", F.col("_stale"), -10),
    ]


def urgency_v2(prospects: DataFrame, events: DataFrame, awards: DataFrame, as_of: AsOf) -> DataFrame:
    """Add ``urgency_v2``, the older additive score kept for comparison."""
    out = _v2_facts(prospects, events, awards, as_of)
    total = F.lit(50)
    for _, condition, points in _v2_parts(explained=False):
        total = total + F.when(condition, points).otherwise(0)
    clamped = F.least(F.greatest(total, F.lit(0)), F.lit(100))
    return out.withColumn("urgency_v2", clamped).drop("_recent", "_large", "_stale")


def urgency_v2_explained(prospects: DataFrame, events: DataFrame, awards: DataFrame, as_of: AsOf) -> DataFrame:
    """Add ``components``, the labelled parts of the older score, and their clamped ``total``."""
    out = _v2_facts(prospects, events, awards, as_of)
    entry = lambda label, points: F.struct(F.lit(label).alias("label"), F.lit(points).alias("delta"))
    items = [entry("Base", 50)] + [
        F.when(condition, entry(label, points)) for label, condition, points in _v2_parts(explained=True)
    ]
    out = out.withColumn("components", compact(items))
    total = F.aggregate("components", F.lit(0), lambda acc, c: acc + c["delta"])
    clamped = F.least(F.greatest(total, F.lit(0)), F.lit(100))
    return out.withColumn("total", clamped).drop("_recent", "_large", "_stale")
