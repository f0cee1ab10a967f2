"""Suppression, gates, policies, opt-outs and retention."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.frames import days_before
from leadloom.functions.rules import compact, failures, filled, first_match, is_filled, text, yes
from leadloom.functions.text import normalize_email, normalize_phone, strip
from leadloom.functions.urls import with_safe_url

# --- Suppression ------------------------------------------------------------


def suppression_value(kind: Column, value: Column) -> Column:
    """The stored form of a suppressed value."""
    plain = F.lower(strip(value))
    return first_match(
        [
            (kind == "siren", F.regexp_replace(value, "[^0-9]", "")),
            (kind == "domain", F.regexp_replace(plain, r"^www\.", "")),
        ],
        plain,
    )


def suppression_keys(email: Column | None = None, domain: Column | None = None, siren: Column | None = None) -> Column:
    """Array of struct(kind, value) a row can be suppressed by."""

    def key(kind: str, value: Column) -> Column:
        return F.when(is_filled(value), F.struct(F.lit(kind).alias("kind"), value.alias("value")))

    keys = []
    if email is not None:
        plain = F.lower(strip(email))
        host = F.lower(strip(F.regexp_replace(email, "^[^@]*@", "")))
        keys += [key("email", plain), key("domain", F.when(email.contains("@"), host))]
    if domain is not None:
        keys.append(key("domain", F.regexp_replace(F.lower(strip(domain)), r"^www\.", "")))
    if siren is not None:
        keys.append(key("siren", F.regexp_replace(siren, "[^0-9]", "")))
    return compact(keys)


def suppressed_ids(rows: DataFrame, suppression: DataFrame, keys: Column, id_column: str = "id") -> DataFrame:
    """Distinct ids of the rows hit by any suppression entry.

    The list of suppressed values is reduced to distinct keys and joined by
    equality; Spark broadcasts it only when its size allows.
    """
    entries = suppression.select(F.col("kind").alias("_kind"), F.col("value_normalized").alias("_value")).distinct()
    exploded = rows.select(F.col(id_column), F.explode(keys).alias("key"))
    hits = exploded.join(
        entries, (F.col("key.kind") == F.col("_kind")) & (F.col("key.value") == F.col("_value")), "left_semi"
    )
    return hits.select(id_column).distinct()


def mark_suppressed(rows: DataFrame, suppression: DataFrame, keys: Column | None = None, id_column: str = "id") -> DataFrame:
    """Add ``is_suppressed`` for mailbox, mailbox domain and siren (or the given keys)."""
    keys = suppression_keys(email=F.col("email"), siren=F.col("siren")) if keys is None else keys
    hits = suppressed_ids(rows, suppression, keys, id_column).withColumn("is_suppressed", F.lit(True))
    joined = rows.drop("is_suppressed").join(hits, id_column, "left")
    return joined.withColumn("is_suppressed", yes(F.col("is_suppressed")))


def add_suppression(suppression: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append: new entries in stored form that are not listed yet, one per value."""
    value = suppression_value(F.col("kind"), F.col("value"))
    entries = new.select("kind", value.alias("value_normalized"), "reason", "source").filter(
        is_filled(F.col("value_normalized"))
    )
    unique = entries.groupBy("kind", "value_normalized").agg(
        F.min(F.struct("reason", "source")).alias("first")
    )
    fresh = unique.join(suppression.select("kind", "value_normalized").distinct(), ["kind", "value_normalized"], "left_anti")
    return fresh.select("kind", "value_normalized", "first.reason", "first.source")


# --- Validation and gates ---------------------------------------------------


def validate_enums(rows: DataFrame) -> DataFrame:
    """Clean confidence and discovery state and add ``failures``, empty for valid rows."""
    confidence = F.trim(F.lower(F.coalesce(filled(F.col("contact_confidence")), F.lit("none"))))
    discovery = F.trim(F.lower(filled(F.col("contact_discovery_state"))))
    found = failures(
        [
            (~confidence.isin(*fixed.ALLOWED_CONFIDENCE), "invalid contact_confidence"),
            (yes(~discovery.isin(*fixed.ALLOWED_DISCOVERY)), "invalid contact_discovery_state"),
        ]
    )
    return rows.withColumns(
        {"contact_confidence": confidence, "contact_discovery_state": discovery, "failures": found}
    )


def drafts_unlocked() -> Column:
    """Only a completed human accept of a reachable prospect unlocks drafts."""
    return (
        yes(F.col("manual_review_state") == "accepted")
        & yes(F.col("qualification_decision") == "accept")
        & ~yes(F.col("opted_out"))
        & ~yes(F.col("anonymized"))
        & ~yes(F.col("is_suppressed"))
    )


def rejection_reason() -> Column:
    """Why an event must not be logged, NULL when it may; expects event and prospect columns side by side."""
    kind = F.col("event_type")
    sent = kind == "Sent"
    confidence = F.lower(text(F.col("contact_confidence")))
    return first_match(
        [
            (yes(F.col("opted_out")) & (kind != "OptOut"),
             "Prospect has opted out — no further outreach events allowed"),
            (yes(F.col("is_suppressed")) & ~kind.isin("OptOut", "ClosedLost", "Refused"),
             "Suppressed contact/company — no outreach events allowed"),
            (sent & ~is_filled(F.trim("data_source")), "Cannot log Sent without data_source populated"),
            (sent & F.col("informed_at").isNull(),
             "Cannot log Sent without informed_at — record first-contact disclosure timestamp"),
            (sent & confidence.isin(*fixed.SENT_BLOCKING_CONFIDENCE),
             F.concat(F.lit("Cannot log Sent with contact_confidence="), confidence, F.lit(" — confirm contact first"))),
        ]
    )


GATE_FIELDS = ("opted_out", "data_source", "informed_at", "contact_confidence")


def gate_events(events: DataFrame, prospects: DataFrame, suppression: DataFrame) -> DataFrame:
    """Events with ``reason``: NULL for accepted ones.  Unknown prospects are rejected."""
    marked = mark_suppressed(prospects.select("id", "email", "siren", *GATE_FIELDS), suppression)
    facts = marked.select(F.col("id").alias("_prospect"), "is_suppressed", *GATE_FIELDS)
    joined = events.join(facts, F.col("prospect_id") == F.col("_prospect"), "left")
    reason = F.when(F.col("_prospect").isNull(), F.lit("not found")).otherwise(rejection_reason())
    return joined.select(*events.columns, reason.alias("reason"))


def accepted(gated: DataFrame) -> DataFrame:
    """Accepted events as they are logged."""
    return gated.filter(F.col("reason").isNull()).drop("reason").withColumns(
        {
            "event_kind": F.when(F.col("event_type") == "Sent", "message").otherwise("decision"),
            "pipeline_stage_after": F.when(F.col("event_type") != "New", F.col("event_type")),
        }
    )


def bulk_event_outcomes(
    ids: DataFrame, prospects: DataFrame, suppression: DataFrame, event_type: str, channel: str = "Email"
) -> DataFrame:
    """Requested ``id`` rows with outcome updated, skipped (opted out) or error, and the error text."""
    marked = mark_suppressed(prospects.select("id", "email", "siren", *GATE_FIELDS), suppression)
    facts = marked.withColumn("_known", F.lit(True))
    joined = ids.select(F.col("id").cast("long").alias("id")).join(facts, "id", "left").withColumn("event_type", F.lit(event_type))
    reason = F.when(F.col("_known").isNull(), F.lit("not found")).otherwise(rejection_reason())
    out = joined.withColumn("reason", reason)
    outcome = first_match(
        [(F.col("_known").isNull(), "error"), (yes(F.col("opted_out")), "skipped"), (F.col("reason").isNotNull(), "error")],
        "updated",
    )
    out = out.withColumn("outcome", outcome)
    message = F.concat(F.lit("id="), F.col("id").cast("string"), F.lit(": "), F.col("reason"))
    return out.select("id", "outcome", F.when(outcome == "error", message).alias("error"), F.lit(channel).alias("channel"))


def hard_gate_failures() -> Column:
    """Reasons that disqualify a company outright; an empty array passes."""
    status, form = F.col("entity_status"), F.col("legal_form")
    return failures(
        [
            (~F.lower(status).isin("active", "incorporated"),
             F.concat(F.lit("Hard Gate Failed: Legal entity status is '"), status, F.lit("' (must be active)."))),
            (F.lower(form).isin("sole_trader", "auto_entrepreneur"),
             F.concat(F.lit("Hard Gate Failed: Legal form '"), form, F.lit("' excluded in pilot."))),
            (F.col("domain_verification_state") == "rejected",
             "Hard Gate Failed: Official company domain was rejected."),
            (F.col("compliance_decision") == "deny", "Hard Gate Failed: Compliance policy denied outreach."),
        ]
    )


def hard_gates(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("rejection_reasons", hard_gate_failures())
    return out.withColumn("hard_gates_passed", F.size("rejection_reasons") == 0)


def compliance(rows: DataFrame) -> DataFrame:
    """Outreach policy per row from ``jurisdiction``, ``legal_form`` and ``is_suppressed``."""
    place, form = F.col("jurisdiction"), F.lower(text(F.col("legal_form")))
    suppressed, british, french = yes(F.col("is_suppressed")), place == "GB", place == "FR"
    private_gb = british & form.isin("sole_trader", "unincorporated_partnership")
    private_fr = french & form.isin("auto_entrepreneur", "ei")
    policy = first_match(
        [
            (suppressed, F.concat(F.lower(place), F.lit("_b2b_policy"))),
            (british, "uk_b2b_email_corporate_v1"),
            (french, "fr_b2b_email_optout_v1"),
        ],
        "generic_b2b_policy",
    )
    decision = first_match(
        [(suppressed | private_gb | private_fr, "deny"), (british | french, "allow_send")], "needs_review"
    )
    reason = first_match(
        [
            (suppressed, fixed.POLICY_SUPPRESSED),
            (private_gb, fixed.PECR_DENY),
            (british, fixed.PECR_ALLOW),
            (private_fr, fixed.CNIL_DENY),
            (french, fixed.CNIL_ALLOW),
        ],
        fixed.POLICY_UNKNOWN,
    )
    return rows.withColumns(
        {
            "policy_code": policy,
            "compliance_decision": decision,
            "compliance_reason": reason,
            "opt_out_required": F.lit(True),
            "sender_disclosure_required": F.lit(True),
        }
    )


def stop_rules(touches: DataFrame, events: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Touches with ``stopped`` and ``stop_reason``.

    ``suppressed`` holds the suppressed prospect ids.  Events are reduced to
    three flags per prospect before the join.
    """
    flags = events.groupBy(F.col("prospect_id").alias("_prospect")).agg(
        F.max(F.col("event_type").isin(*fixed.REPLY_EVENTS)).alias("_replied"),
        F.max(F.col("event_type") == "OptOut").alias("_opted_out"),
    )
    hits = suppressed.select(F.col("id").alias("_suppressed")).distinct()
    out = touches.join(flags, F.col("prospect_id") == F.col("_prospect"), "left")
    out = out.join(hits, F.col("prospect_id") == F.col("_suppressed"), "left")
    reason = stop_reason(
        F.col("_replied"), F.col("bounced"), F.col("_opted_out"), F.col("_suppressed").isNotNull()
    )
    return out.select(*touches.columns, reason.isNotNull().alias("stopped"), reason.alias("stop_reason"))


def stop_reason(replied: Column, bounced: Column, opted_out: Column, suppressed: Column) -> Column:
    return first_match(
        [
            (yes(replied), "prospect_replied"),
            (yes(bounced), "email_bounced"),
            (yes(opted_out), "opt_out_requested"),
            (yes(suppressed), "suppression_entry_matched"),
        ]
    )


def gate_reviews(reviews: DataFrame, prospects: DataFrame, suppression: DataFrame) -> DataFrame:
    """Reviews with ``error``: NULL when the decision may be applied."""
    marked = mark_suppressed(prospects.select("id", "email", "siren"), suppression)
    facts = marked.select(F.col("id").alias("_prospect"), "is_suppressed")
    joined = reviews.join(facts, F.col("prospect_id") == F.col("_prospect"), "left")
    missing = failures([(~yes(F.col(flag)), flag) for flag in fixed.REVIEW_FLAGS])
    joined = joined.withColumn("_missing", missing)
    accept = F.col("decision") == "accept"
    error = first_match(
        [
            (F.col("_prospect").isNull(), "Not found"),
            (~yes(F.col("decision").isin(*fixed.REVIEW_DECISIONS)), "Invalid decision"),
            (accept & F.col("is_suppressed"),
             "Cannot accept: this prospect is on the suppression list (email, domain, or SIREN). Remove suppression first."),
            (accept & (F.size("_missing") > 0),
             F.concat(F.lit("Cannot accept. Missing required confirmations: "), F.array_join("_missing", ", "),
                      F.lit(". Do not accept on award alone without verified pain."))),
        ]
    )
    return joined.select(*reviews.columns, error.alias("error"))


def gate_manual_points(points: DataFrame, international: bool = True) -> DataFrame:
    """Hand-entered contact points with normalised value, safe source url and ``error`` (NULL when fine)."""
    out = with_safe_url(points, "source_url", "_source", international)
    out = with_safe_url(out, "value", "_value_url", international)
    kind = F.col("kind")
    normalized = first_match(
        [(kind == "email", normalize_email(F.col("value"))), (kind == "phone", normalize_phone(F.col("value")))],
        F.col("_value_url.url"),
    )
    out = out.withColumn("value_normalized", normalized)
    error = first_match(
        [
            (~yes(kind.isin(*fixed.MANUAL_POINT_KINDS)), "Unsupported contact type"),
            (~yes(F.col("publication_state").isin(*fixed.PUBLICATION_STATES)), "Invalid publication state"),
            (F.col("_source.reason").isNotNull(), F.col("_source.reason")),
            (~kind.isin("email", "phone") & F.col("_value_url.reason").isNotNull(), F.col("_value_url.reason")),
            (~is_filled(F.col("value_normalized")), "Invalid contact value"),
            ((kind == "linkedin") & ~F.col("_value_url.host").endswith("linkedin.com"),
             "LinkedIn URL must use linkedin.com"),
        ]
    )
    out = out.withColumns({"error": error, "source_url": F.col("_source.url"), "_host": F.col("_value_url.host")})
    domain = F.when(kind == "email", F.substring_index("value_normalized", "@", -1)).otherwise(F.col("_host"))
    return out.withColumn("domain", F.when(kind != "phone", domain)).drop("_source", "_value_url", "_host")


# --- Opt-outs and retention -------------------------------------------------


def opt_out_times(events: DataFrame) -> DataFrame:
    """First opt-out per prospect."""
    return (
        events.filter(F.col("event_type") == "OptOut")
        .groupBy("prospect_id")
        .agg(F.min("event_date").alias("opted_out_at"))
    )


def apply_opt_outs(prospects: DataFrame, events: DataFrame) -> DataFrame:
    """Prospects with the opt-out flag and time set from the event log."""
    times = opt_out_times(events).select(F.col("prospect_id").alias("id"), F.col("opted_out_at").alias("_out_at"))
    joined = prospects.join(times, "id", "left")
    flagged = F.col("_out_at").isNotNull()
    out = joined.withColumn("opted_out", yes(F.col("opted_out")) | flagged)
    if "opted_out_at" in prospects.columns:
        out = out.withColumn("opted_out_at", F.coalesce("_out_at", "opted_out_at"))
    else:
        out = out.withColumn("opted_out_at", F.col("_out_at"))
    return out.drop("_out_at")


def opt_out_suppression(prospects: DataFrame, events: DataFrame, suppression: DataFrame) -> DataFrame:
    """Suppression rows to append for opted-out prospects: mailbox and siren."""
    out = opt_out_times(events).select(F.col("prospect_id").alias("id")).join(prospects, "id")
    keys = compact(
        [
            F.when(is_filled(F.col(column)), F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value")))
            for kind, column in (("email", "email"), ("siren", "siren"))
        ]
    )
    rows = out.select(F.explode(keys).alias("key")).select(
        "key.*", F.lit("opt_out").alias("reason"), F.lit("outreach").alias("source")
    )
    return add_suppression(suppression, rows)


def cancel_tasks(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Open tasks of opted-out prospects are cancelled at the time of the opt-out."""
    times = opt_out_times(events).withColumnRenamed("opted_out_at", "_out_at")
    joined = tasks.join(times, "prospect_id", "left")
    cancelled = F.col("_out_at").isNotNull() & (F.col("status") == "open")
    return joined.withColumns(
        {
            "status": F.when(cancelled, "cancelled").otherwise(F.col("status")),
            "completed_at": F.when(cancelled, F.col("_out_at")).otherwise(F.col("completed_at")),
        }
    ).select(*tasks.columns)


PERSONAL_FIELDS = ("decision_maker_name", "decision_maker_title", "email", "phone", "linkedin_url")


def anonymise(
    prospects: DataFrame, events: DataFrame, as_of: str | date | datetime, days: int = 3 * 365, deep: bool = False
) -> DataFrame:
    """Clear personal fields of prospects without activity for ``days``; adds ``anonymized_now``.

    ``deep`` also empties the officer and candidate arrays.
    """
    last = events.groupBy(F.col("prospect_id").alias("id")).agg(
        F.max_by("event_date", F.struct("event_date", "id")).alias("_last_event")
    )
    joined = prospects.join(last, "id", "left")
    activity = F.greatest(F.coalesce("updated_at", "created_at").cast("timestamp_ntz"), F.col("_last_event").cast("timestamp_ntz"))
    stale = ~yes(F.col("anonymized")) & yes(activity <= days_before(as_of, days))
    out = joined.withColumn("anonymized_now", stale)
    now = F.col("anonymized_now")
    cleared = [name for name in PERSONAL_FIELDS if name in prospects.columns]
    if deep:
        cleared += [name for name in ("dirigeants", "contact_candidates") if name in prospects.columns]
    out = out.withColumns({name: F.when(~now, F.col(name)) for name in cleared})
    out = out.withColumns(
        {
            "notes": F.when(now, fixed.RETENTION_NOTE).otherwise(F.col("notes")),
            "anonymized": yes(F.col("anonymized")) | now,
        }
    )
    return out.drop("_last_event")


