"""Outreach activity: status, follow-ups, queue, metrics, lists."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.frames import days_before, left_join_many, permille, when_is
from leadloom.functions.codes import primary_rank
from leadloom.functions.rules import filled, first_match, is_filled, nonzero, text, yes
from leadloom.functions.text import strip

AsOf = str | date | datetime
LAST_FIELDS = ("event_type", "channel", "event_date", "next_action", "next_action_date")


# --- Status -----------------------------------------------------------------


def last_events(events: DataFrame) -> DataFrame:
    """The last event of every prospect; one map-side combinable aggregate."""
    last = F.max_by(F.struct(*LAST_FIELDS), F.struct("event_date", "id"))
    return events.groupBy("prospect_id").agg(last.alias("last")).select("prospect_id", "last.*")


def current_status(prospects: DataFrame, events: DataFrame) -> DataFrame:
    """Prospects with ``current_status``, ``last_event_date``, ``next_action``, ``next_action_date`` and ``last_channel``."""
    last = last_events(events).select(
        F.col("prospect_id").alias("_prospect"),
        F.col("event_type").alias("_type"),
        F.col("event_date").alias("last_event_date"),
        F.col("next_action"),
        F.col("next_action_date"),
        F.col("channel").alias("last_channel"),
    )
    joined = prospects.join(last, F.col("id") == F.col("_prospect"), "left")
    return joined.withColumn("current_status", F.coalesce("_type", F.lit("New"))).drop("_prospect", "_type")


def with_events(prospects: DataFrame, events: DataFrame) -> DataFrame:
    """Every prospect beside each of its events, as rows in (prospect, date, event) order.

    Prospects without events appear once.  The order comes from a range
    partitioned sort, so even one prospect's events spread over tasks.
    """
    children = events.withColumnRenamed("id", "event_id")
    return left_join_many(prospects, children, "id", "prospect_id").orderBy("id", "event_date", "event_id")


def open_tasks(tasks: DataFrame) -> DataFrame:
    """Open tasks per prospect: the task types, how many, and the first contact task's title."""
    contact = F.col("task_type").isin(*fixed.CONTACT_TASK_TYPES)
    return (
        tasks.filter(F.col("status") == "open")
        .groupBy("prospect_id")
        .agg(
            F.array_sort(F.collect_set("task_type")).alias("task_types"),
            F.count(F.lit(1)).alias("open_task_count"),
            F.min_by(F.when(contact, F.col("title")), F.when(contact, F.col("id"))).alias("contact_task_title"),
        )
    )


# --- Follow-ups and queue ---------------------------------------------------


def reachable(prospects: DataFrame) -> DataFrame:
    """Neither anonymised nor opted out."""
    return prospects.filter(~yes(F.col("anonymized")) & ~yes(F.col("opted_out")))


def follow_ups(prospects: DataFrame, events: DataFrame, as_of: AsOf) -> DataFrame:
    """Prospects whose last event asks for an action up to today, most overdue first."""
    today = when_is(as_of).cast("date")
    due = F.col("next_action_date").cast("date")
    statuses = current_status(reachable(prospects), events).filter(due <= today)
    return statuses.select(
        F.col("id").alias("prospect_id"),
        "company_name",
        "current_status",
        "priority_level",
        "urgency_score",
        "next_action",
        "next_action_date",
        "decision_maker_name",
        F.col("last_channel").alias("channel"),
        F.datediff(today, due).alias("days_overdue"),
    ).orderBy(F.desc("days_overdue"), F.desc("urgency_score"), "prospect_id")


def action_queue(
    prospects: DataFrame,
    events: DataFrame,
    tasks: DataFrame,
    as_of: AsOf,
    min_score: int | None = 55,
    readiness: str | None = None,
    review_state: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """What to do next, best first: replies, meetings, overdue follow-ups, tasks, then readiness.

    All prospects are ranked; ``limit`` asks for the first few.
    """
    pool = reachable(prospects)
    if readiness:
        pool = pool.filter(F.col("readiness_state") == readiness)
    if review_state:
        pool = pool.filter(F.col("manual_review_state") == review_state)
    if min_score is not None:
        pool = pool.filter((F.col("opportunity_score") >= min_score) | (F.col("acquisition_score") >= min_score))
    now = when_is(as_of)
    queue = current_status(pool, events).join(
        open_tasks(tasks).withColumnRenamed("prospect_id", "id"), "id", "left"
    )
    action_day = F.col("next_action_date").cast("timestamp_ntz")
    overdue = yes(action_day <= now)
    days = F.when(overdue, F.floor(F.timestamp_diff("SECOND", action_day, now) / 86400).cast("int"))
    queue = queue.withColumns({"days_overdue": days, "_types": F.coalesce("task_types", F.array().cast("array<string>"))})
    replied, meeting = F.col("current_status") == "Replied", F.col("current_status") == "MeetingBooked"
    has = lambda kind: F.array_contains("_types", kind)
    contact_task = F.arrays_overlap("_types", F.array(*[F.lit(kind) for kind in fixed.CONTACT_TASK_TYPES]))
    overdue = F.col("days_overdue").isNotNull()
    readiness_rank = first_match(
        [(F.col("readiness_state") == state, rank) for state, rank in fixed.READINESS_RANK.items()], 9
    )
    rank = first_match(
        [(replied, 0), (meeting, 1), (overdue, 2), (has("first_outreach"), 3), (has("research"), 4), (contact_task, 4)],
        readiness_rank,
    )
    state = F.col("readiness_state")
    hint = first_match(
        [
            (replied, "Reply — respond to their message"),
            (meeting, "Meeting — prepare and confirm"),
            (overdue, F.concat(F.lit("Overdue follow-up ("), F.col("days_overdue").cast("string"), F.lit("d)"))),
            (has("first_outreach"), "Send first outreach"),
            (has("research"), "Research — gather more evidence"),
            (contact_task, F.col("contact_task_title")),
            (state == "contact_ready", "Contact ready — create outreach task"),
            (state == "human_review_required", "Needs qualification review"),
            (state == "contact_required", "Find contact information"),
        ],
        F.coalesce(filled(state), F.lit("—")),
    )
    queue = queue.withColumns({"action_rank": rank, "action_hint": hint})
    opportunity = F.coalesce("opportunity_score", F.lit(0))
    score = F.when(F.col("action_rank") < 5, opportunity).otherwise(
        F.coalesce(nonzero(F.col("opportunity_score")), nonzero(F.col("acquisition_score")), F.lit(0))
    )
    lateness = F.when(F.col("action_rank") == 2, F.col("days_overdue")).otherwise(0)
    queue = queue.withColumns({"queue_score": score, "_lateness": lateness})
    queue = queue.orderBy("action_rank", F.desc("_lateness"), F.desc("queue_score"), "id")
    return (queue.limit(limit) if limit else queue).drop("_types", "_lateness")


def queue_stats(queue: DataFrame) -> DataFrame:
    return queue.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(text(F.col("manual_review_state")) == "unreviewed").alias("need_review"),
        F.count_if(F.col("readiness_state") == "contact_ready").alias("ready"),
        F.count_if(F.coalesce("opportunity_score", F.lit(0)) >= 65).alias("high"),
    )


# --- Metrics ----------------------------------------------------------------


def outreach_flags(prospects: DataFrame, events: DataFrame, as_of: AsOf) -> DataFrame:
    """Non-anonymised prospects with contacted, replied, meeting and contacted-this-week flags."""
    kind = F.col("event_type")
    contacted = kind.isin(*fixed.CONTACTED_EVENTS)
    recent = F.col("event_date").cast("timestamp_ntz") >= days_before(as_of, 7)
    flags = events.groupBy(F.col("prospect_id").alias("_prospect")).agg(
        F.bool_or(contacted).alias("contacted"),
        F.bool_or(kind.isin(*fixed.REPLY_EVENTS)).alias("replied"),
        F.bool_or(kind.isin(*fixed.MEETING_EVENTS)).alias("meeting"),
        F.bool_or(contacted & yes(recent)).alias("contacted_this_week"),
    )
    joined = prospects.filter(~yes(F.col("anonymized"))).join(flags, F.col("id") == F.col("_prospect"), "left")
    names = ("contacted", "replied", "meeting", "contacted_this_week")
    return joined.withColumns({name: yes(F.col(name)) for name in names}).drop("_prospect")


def headline(
    prospects: DataFrame, events: DataFrame, as_of: AsOf, award_signals: tuple[str, ...] = ("DECP_WIN",)
) -> DataFrame:
    """The dashboard's headline row.  Rates are permille, rounded half-even."""
    flags = outreach_flags(prospects, events, as_of)
    fresh = yes(F.col("created_at").cast("timestamp_ntz") >= days_before(as_of, 7))
    due = follow_ups(prospects, events, as_of).agg(F.count(F.lit(1)))
    totals = flags.agg(
        F.count(F.lit(1)).alias("total_prospects"),
        F.count_if("contacted_this_week").alias("contacted_this_week"),
        F.count_if("contacted").alias("_contacted"),
        F.count_if("replied").alias("_replied"),
        F.count_if("meeting").alias("_meetings"),
        F.count_if((F.col("priority_level") == "High") & ~yes(F.col("opted_out"))).alias("high_priority_count"),
        F.count_if(F.col("signal_type").isin(*award_signals) & fresh).alias("new_awards_this_week"),
        F.count_if(yes(F.col("needs_manual_review")) & ~yes(F.col("opted_out"))).alias("needs_review_count"),
        F.count_if(is_filled(F.col("email"))).alias("_with_email"),
        F.count_if(F.col("contact_confidence") == "verified").alias("_verified"),
    )
    base = F.when(F.col("_with_email") > 0, F.col("_with_email")).otherwise(F.col("total_prospects"))
    return totals.withColumn("follow_ups_due_count", due.scalar()).select(
        "total_prospects",
        "contacted_this_week",
        permille(F.col("_replied"), F.col("_contacted")).alias("reply_permille"),
        permille(F.col("_meetings"), F.col("_contacted")).alias("meeting_permille"),
        "high_priority_count",
        "follow_ups_due_count",
        "new_awards_this_week",
        permille(F.col("_verified"), base).alias("verified_email_permille"),
        "needs_review_count",
    )


def by_signal(prospects: DataFrame, events: DataFrame, as_of: AsOf) -> DataFrame:
    rows = outreach_flags(prospects, events, as_of).groupBy("signal_type").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("contacted").alias("contacted"),
        F.count_if("replied").alias("replied"),
    )
    return rows.withColumn("reply_permille", permille(F.col("replied"), F.col("contacted"))).orderBy("signal_type")


def events_of_known(prospects: DataFrame, events: DataFrame) -> DataFrame:
    """Events of non-anonymised prospects."""
    known = prospects.filter(~yes(F.col("anonymized"))).select(F.col("id").alias("prospect_id"))
    return events.join(known, "prospect_id", "left_semi")


def by_channel(prospects: DataFrame, events: DataFrame) -> DataFrame:
    """Event counts per channel; silent channels are left out."""
    rows = events_of_known(prospects, events).groupBy("channel").agg(
        F.count_if(F.col("event_type") == "Sent").alias("sent"),
        F.count_if(F.col("event_type").isin(*fixed.REPLY_EVENTS)).alias("replied"),
    )
    active = rows.filter((F.col("sent") > 0) | (F.col("replied") > 0))
    return active.withColumn("reply_permille", permille(F.col("replied"), F.col("sent"))).orderBy("channel")


def objections(prospects: DataFrame, events: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent notes of refusals."""
    refused = events_of_known(prospects, events).filter(
        F.col("event_type").isin(*fixed.OBJECTION_EVENTS) & is_filled(F.col("notes"))
    )
    note = F.lower(strip(F.col("notes"))).alias("note")
    counts = refused.groupBy(note).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "note").limit(n)


def cockpit(prospects: DataFrame, award_signals: tuple[str, ...] = ("DECP_WIN",)) -> DataFrame:
    return reachable(prospects).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce("acquisition_score", F.lit(0)) >= 70).alias("hot"),
        F.count_if(F.col("acquisition_stage") == "contact_ready").alias("ready"),
        F.count_if(is_filled(F.col("decision_maker_name"))).alias("with_person"),
        F.count_if(F.col("signal_type").isin(*award_signals)).alias("awards"),
        F.count_if(F.col("signal_type").isin("REGISTRY_FIELD", "REGISTRY_IT")).alias("registry"),
        F.count_if(yes(F.col("needs_manual_review"))).alias("review"),
    )


def board_column(status: Column) -> Column:
    return first_match([(status.isin(*kinds), name) for name, kinds in fixed.BOARD_COLUMNS.items()], "New")


def board_cards(prospects: DataFrame, events: DataFrame) -> DataFrame:
    """All cards with their board column, sorted by column and score.

    The sort is range partitioned, so a column that holds most prospects is
    spread over tasks.
    """
    cards = current_status(reachable(prospects), events)
    cards = cards.withColumn("board_column", board_column(F.col("current_status")))
    place = first_match([(F.col("board_column") == name, i) for i, name in enumerate(fixed.BOARD_COLUMNS)])
    return cards.withColumn("board_place", place).orderBy("board_place", F.desc("urgency_score"), "id")


def board_counts(prospects: DataFrame, events: DataFrame) -> DataFrame:
    statuses = current_status(reachable(prospects), events)
    return statuses.groupBy(board_column(F.col("current_status")).alias("board_column")).agg(
        F.count(F.lit(1)).alias("cards"), F.max("urgency_score").alias("top_score")
    )


# --- Lists ------------------------------------------------------------------


def list_filter(
    prospects: DataFrame,
    events: DataFrame | None = None,
    *,
    sector: str | None = None,
    signal_type: str | None = None,
    priority_level: str | None = None,
    source: str | None = None,
    status: str | None = None,
    search: str | None = None,
    min_score: int | None = None,
    max_score: int | None = None,
    include_opted_out: bool = False,
    include_anonymized: bool = False,
) -> DataFrame:
    """The prospect list under its filters; only a status filter needs the events."""
    out = prospects
    if not include_anonymized:
        out = out.filter(~yes(F.col("anonymized")))
    if not include_opted_out:
        out = out.filter(~yes(F.col("opted_out")))
    equal = {"sector": sector, "signal_type": signal_type, "priority_level": priority_level, "source": source}
    for name, value in equal.items():
        if value:
            out = out.filter(F.col(name) == value)
    if min_score is not None:
        out = out.filter(F.col("urgency_score") >= min_score)
    if max_score is not None:
        out = out.filter(F.col("urgency_score") <= max_score)
    if search:
        out = out.filter(_found(search, ("company_name", "decision_maker_name", "email")))
    if status:
        out = current_status(out, events).filter(F.col("current_status") == status)
    return out


def _found(search: str, columns: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for name in columns:
        hit = hit | yes(F.col(name).ilike(f"%{search}%"))
    return hit


CONTACT_FILTERS = ("verified", "ready", "needs_review", "no_email", "has_dirigeant")


def sourcing_filter(
    prospects: DataFrame,
    *,
    signal_type: str | None = None,
    stage: str | None = None,
    min_acquisition: int | None = None,
    needs_review: bool = False,
    has_person: bool = False,
    contact_filter: str | None = None,
    search: str | None = None,
) -> DataFrame:
    out = reachable(prospects)
    if signal_type:
        out = out.filter(F.col("signal_type") == signal_type)
    if stage:
        out = out.filter(F.col("acquisition_stage") == stage)
    if min_acquisition is not None:
        out = out.filter(F.col("acquisition_score") >= min_acquisition)
    if needs_review:
        out = out.filter(yes(F.col("needs_manual_review")))
    if has_person or contact_filter == "has_dirigeant":
        out = out.filter(F.col("decision_maker_name").isNotNull())
    if contact_filter == "verified":
        out = out.filter(F.col("contact_confidence") == "verified")
    elif contact_filter == "ready":
        out = out.filter(F.col("acquisition_stage") == "contact_ready")
    elif contact_filter == "needs_review":
        out = out.filter(
            yes(F.col("needs_manual_review"))
            | F.coalesce(F.col("contact_confidence"), F.lit("none")).isin("needs_review", "none")
        )
    elif contact_filter == "no_email":
        out = out.filter(~is_filled(F.col("email")))
    if search:
        out = out.filter(_found(search, ("company_name", "siren", "siret", "decision_maker_name", "city")))
    return out


def list_page(
    prospects: DataFrame, sort: str = "urgency_score", direction: str = "desc", page: int = 1, size: int = 50
) -> DataFrame:
    """One page of the list; a top-k, so only offset + size rows per task travel."""
    key = {
        "company_name": F.lower("company_name"),
        "created_at": F.col("created_at"),
        "priority_level": first_match(
            [(F.col("priority_level") == name, i) for i, name in enumerate(("High", "Medium", "Low"))], 9
        ),
    }.get(sort, primary_rank(F.col("opportunity_score"), F.col("acquisition_score"), F.col("urgency_score")))
    order = key.asc_nulls_last() if direction.lower() == "asc" else key.desc_nulls_first()
    return prospects.orderBy(order, "id").offset(max(0, (page - 1) * size)).limit(size)


def sourcing_sort(prospects: DataFrame, sort: str = "acquisition", n: int = 150) -> DataFrame:
    orders = {
        "urgency": ["urgency_score"],
        "fit": ["fit_score"],
        "timing": ["timing_score"],
        "recent": ["created_at"],
    }.get(sort, ["acquisition_score", "urgency_score"])
    return prospects.orderBy(*[F.col(name).desc_nulls_last() for name in orders], "id").limit(n)


def eligibility(
    prospects: DataFrame,
    runs: DataFrame,
    suppressed: DataFrame,
    as_of: AsOf,
    min_score: int = 40,
    refresh_days: int = 30,
) -> DataFrame:
    """Prospects with the reason contact discovery must not run on them, NULL when it may."""
    finished = runs.filter(
        F.col("status").isin("completed", "completed_with_warnings")
        & (F.col("finished_at").cast("timestamp_ntz") >= days_before(as_of, refresh_days))
    )
    fresh = finished.select(F.col("prospect_id").alias("_fresh")).distinct()
    hits = suppressed.select(F.col("id").alias("_suppressed")).distinct()
    out = prospects.join(fresh, F.col("id") == F.col("_fresh"), "left")
    out = out.join(hits, F.col("id") == F.col("_suppressed"), "left")
    score = F.coalesce(nonzero(F.col("opportunity_score")), nonzero(F.col("acquisition_score")), F.lit(0))
    domain = is_filled(F.col("website")) | yes(F.col("email").contains("@"))
    reason = first_match(
        [
            (F.col("_suppressed").isNotNull(), "suppressed"),
            (yes(F.col("anonymized")), "anonymized"),
            (yes(F.col("opted_out")), "opted_out"),
            (score < min_score, "below_opportunity_threshold"),
            (~domain, "no_defensible_domain"),
            (F.col("_fresh").isNotNull(), "contact dossier is fresh"),
        ]
    )
    return out.withColumn("ineligible_reason", reason).drop("_fresh", "_suppressed")


def nightly_batch(prospects: DataFrame, n: int = 8, min_score: int = 40) -> DataFrame:
    """The best prospects whose contact is unknown or weak."""
    weak = F.col("contact_discovery_state").isNull() | yes(
        F.col("contact_confidence").isin("none", "needs_review", "unverified")
    )
    pool = reachable(prospects).filter(
        (F.col("opportunity_score") >= min_score)
        & (F.col("website").isNotNull() | F.col("email").isNotNull())
        & weak
    )
    return pool.orderBy(F.desc("opportunity_score"), "id").limit(n)


def enrich_batch(prospects: DataFrame, n: int = 30, below: int | None = 55) -> DataFrame:
    """Prospects worth enriching: never done, without a person, or with a low score (``below=None`` drops that term)."""
    thin = F.col("last_enriched_at").isNull() | F.col("decision_maker_name").isNull()
    if below is not None:
        thin = thin | (F.col("acquisition_score") < below)
    return reachable(prospects).filter(yes(thin)).orderBy(F.col("acquisition_score").desc_nulls_last(), "id").limit(n)
