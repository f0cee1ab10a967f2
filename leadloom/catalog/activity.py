"""Aggregations, rankings, lists."""

from pyspark.sql import functions as F

from leadloom import fixed
from leadloom.catalog import query, sql_list
from leadloom.catalog.gates import SIGNALS
from leadloom.catalog.scans import LAST_EVENT, RELEVANT
from leadloom.functions.rules import is_filled
from leadloom.operators import activity, awards, evidence
from leadloom.operators.identity import rank_registry
from leadloom.plays import FIELD_SERVICE
from leadloom.session import cut_lineage
from leadloom.standins import AWARDS_AS_OF, EVENTS_AS_OF, HISTORY_AS_OF

AS_OF = f"TIMESTAMP '{EVENTS_AS_OF} 00:00:00'"

HOLDERS = f"""
relevant AS (SELECT *, CASE WHEN length(holder_digits) = 9 THEN holder_digits ELSE substring(holder_digits, 1, 14) END AS holder_key
  FROM ({RELEVANT.replace("{days}", "400")}) WHERE length(holder_digits) = 9 OR length(holder_digits) >= 14),
ordered AS (SELECT *, row_number() OVER (PARTITION BY holder_key ORDER BY dateAttribution DESC, id, objetMarche, montant NULLS FIRST) AS rn FROM relevant),
holders AS (SELECT holder_key, substring(holder_key, 1, 9) AS siren, CASE WHEN length(holder_key) = 14 THEN holder_key END AS siret,
  max(titulaire_nom) AS company_name, count(*) AS award_count, CAST(coalesce(sum(CAST(round(montant * 100) AS BIGINT)), 0) AS BIGINT) AS total_cents,
  max(dateAttribution) AS last_tender_date, string_agg(CASE WHEN rn <= 3 THEN objetMarche END, ' | ' ORDER BY rn) AS objets_joined FROM ordered GROUP BY 1),
described AS (SELECT *, concat_ws(' · ', CAST(award_count AS VARCHAR) || ' award(s)', CASE WHEN total_cents <> 0 THEN 'total≈' || CAST(CAST(round_even(total_cents / 100, 0) AS BIGINT) AS VARCHAR) || '€' END,
  CASE WHEN award_count >= 2 THEN 'multiple wins' END) AS signal_details FROM holders)
"""


def holders(t):
    relevant = awards.filter_relevant(t.s_awards, FIELD_SERVICE, AWARDS_AS_OF, 400)
    return awards.aggregate_by_holder(relevant, stage=cut_lineage)


@query("a1_awards_by_holder", f"""
WITH {HOLDERS} SELECT holder_key, siren, siret, company_name, award_count, total_cents, last_tender_date, signal_details, objets_joined FROM described
""")
def a1(t):
    return holders(t).select("holder_key", "siren", "siret", "company_name", "award_count", "total_cents", "last_tender_date", "signal_details", "objets_joined")


@query("a1b_holder_history", f"""
WITH {HOLDERS} SELECT holder_key, rn AS position, id, dateAttribution AS date FROM ordered
""")
def a1b(t):
    relevant = awards.filter_relevant(t.s_awards, FIELD_SERVICE, AWARDS_AS_OF, 400)
    return awards.holder_history(relevant).select("holder_key", "position", "id", "date")


@query("a1c_holder_evidence", f"""
WITH {HOLDERS}
SELECT holder_key, 'PUBLIC_AWARD_RECENT' AS signal_type, signal_details || ' — ' || objets_joined AS evidence_text, CASE WHEN award_count >= 2 THEN 65 ELSE 50 END AS strength FROM described
UNION ALL SELECT holder_key, 'PUBLIC_AWARD_MULTI', CAST(award_count AS VARCHAR) || ' awards in discovery window', 70 FROM described WHERE award_count >= 2
UNION ALL SELECT holder_key, 'PUBLIC_SERVICE_DELIVERY', 'Supplier on public awards matching field-service play filters', 40 FROM described
""", whole="strength")
def a1c(t):
    return awards.holder_evidence(holders(t)).select("holder_key", "signal_type", "evidence_text", "strength")


@query("a2_award_metrics", """
SELECT prospect_id, count(*) AS award_count, coalesce(sum(CAST(CASE WHEN montant <> 'n.c.' THEN montant END AS BIGINT)) * 100, 0) AS award_total_cents FROM s_award_rows GROUP BY 1
""", whole="award_total_cents")
def a2(t):
    return awards.award_facts(t.s_award_rows, HISTORY_AS_OF).select("prospect_id", "award_count", "award_total_cents")


_FLAGS = f"""
flags AS (SELECT prospect_id, bool_or(event_type IN ({sql_list(fixed.CONTACTED_EVENTS)})) AS contacted, bool_or(event_type IN ({sql_list(fixed.REPLY_EVENTS)})) AS replied,
  bool_or(event_type IN ({sql_list(fixed.MEETING_EVENTS)})) AS meeting, bool_or(event_type IN ({sql_list(fixed.CONTACTED_EVENTS)}) AND event_date >= {AS_OF} - INTERVAL '7' DAY) AS week
  FROM s_events GROUP BY 1),
p AS (SELECT s.*, coalesce(contacted, FALSE) AS contacted, coalesce(replied, FALSE) AS replied, coalesce(meeting, FALSE) AS meeting, coalesce(week, FALSE) AS week
  FROM s_prospects s LEFT JOIN flags f ON f.prospect_id = s.id WHERE NOT anonymized)
"""


def rate(part: str, whole: str) -> str:
    return f"CAST(CASE WHEN {whole} = 0 THEN 0 ELSE round_even(CAST({part} AS DECIMAL(38, 10)) * 1000 / {whole}, 0) END AS BIGINT)"


_DUE = f"""
last AS ({LAST_EVENT}),
due AS (SELECT p.id, l.event_type, l.channel, l.next_action, date_diff('day', CAST(l.next_action_date AS DATE), DATE '{EVENTS_AS_OF}') AS days_overdue, p.company_name, p.urgency_score, p.priority_level
  FROM s_prospects p JOIN last l ON l.prospect_id = p.id WHERE NOT opted_out AND NOT anonymized AND CAST(l.next_action_date AS DATE) <= DATE '{EVENTS_AS_OF}')
"""


@query("a3_headline_metrics", f"""
WITH {_FLAGS}, {_DUE}
SELECT count(*) AS total_prospects, count(*) FILTER (week) AS contacted_this_week, {rate("count(*) FILTER (replied)", "count(*) FILTER (contacted)")} AS reply_permille,
  {rate("count(*) FILTER (meeting)", "count(*) FILTER (contacted)")} AS meeting_permille, count(*) FILTER (priority_level = 'High' AND NOT opted_out) AS high_priority_count,
  (SELECT count(*) FROM due) AS follow_ups_due_count, count(*) FILTER (signal_type = 'DECP_WIN' AND created_at >= {AS_OF} - INTERVAL '7' DAY) AS new_awards_this_week,
  {rate("count(*) FILTER (contact_confidence = 'verified')", "count(email)")} AS verified_email_permille, count(*) FILTER (needs_manual_review AND NOT opted_out) AS needs_review_count FROM p
""")
def a3(t):
    return activity.headline(t.s_prospects, t.s_events, EVENTS_AS_OF)


@query("a4_metrics_by_signal", f"""
WITH {_FLAGS} SELECT signal_type, count(*) AS total, count(*) FILTER (contacted) AS contacted, count(*) FILTER (replied) AS replied,
  {rate("count(*) FILTER (replied)", "count(*) FILTER (contacted)")} AS reply_permille FROM p GROUP BY 1
""")
def a4(t):
    return activity.by_signal(t.s_prospects, t.s_events, EVENTS_AS_OF)


@query("a5_metrics_by_channel", f"""
SELECT channel, count(*) FILTER (event_type = 'Sent') AS sent, count(*) FILTER (event_type IN ({sql_list(fixed.REPLY_EVENTS)})) AS replied,
  {rate(f"count(*) FILTER (event_type IN ({sql_list(fixed.REPLY_EVENTS)}))", "count(*) FILTER (event_type = 'Sent')")} AS reply_permille
FROM s_events e WHERE prospect_id IN (SELECT id FROM s_prospects WHERE NOT anonymized) GROUP BY 1 HAVING sent > 0 OR replied > 0
""")
def a5(t):
    return activity.by_channel(t.s_prospects, t.s_events)


@query("a6_common_objections", """
SELECT lower(trim(notes)) AS note, count(*) AS count FROM s_events e WHERE event_type IN ('Refused', 'ClosedLost') AND notes <> ''
  AND prospect_id IN (SELECT id FROM s_prospects WHERE NOT anonymized) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10
""")
def a6(t):
    return activity.objections(t.s_prospects, t.s_events)


@query("a7_cockpit", """
SELECT count(*) AS total, count(*) FILTER (acquisition_score >= 70) AS hot, count(*) FILTER (acquisition_stage = 'contact_ready') AS ready, count(decision_maker_name) AS with_person,
  count(*) FILTER (signal_type = 'DECP_WIN') AS awards, count(*) FILTER (signal_type IN ('REGISTRY_FIELD', 'REGISTRY_IT')) AS registry, count(*) FILTER (needs_manual_review) AS review
FROM s_prospects WHERE NOT anonymized AND NOT opted_out
""")
def a7(t):
    return activity.cockpit(t.s_prospects)


_QUEUE = f"""
last AS ({LAST_EVENT}),
tasks AS (SELECT prospect_id, bool_or(task_type = 'first_outreach') AS fo, bool_or(task_type = 'research') AS re, bool_or(task_type IN ({sql_list(fixed.CONTACT_TASK_TYPES)})) AS ct
  FROM s_tasks WHERE status = 'open' GROUP BY 1),
base AS (SELECT p.*, l.event_type, CASE WHEN l.next_action_date <= {AS_OF} THEN CAST(floor(date_diff('second', l.next_action_date, {AS_OF}) / 86400) AS BIGINT) END AS late, fo, re, ct
  FROM s_prospects p LEFT JOIN last l ON l.prospect_id = p.id LEFT JOIN tasks t ON t.prospect_id = p.id
  WHERE NOT anonymized AND NOT opted_out AND (opportunity_score >= 50 OR acquisition_score >= 50)),
ranked AS (SELECT *, CASE WHEN event_type = 'Replied' THEN 0 WHEN event_type = 'MeetingBooked' THEN 1 WHEN late IS NOT NULL THEN 2 WHEN fo THEN 3 WHEN re OR ct THEN 4
  ELSE CASE readiness_state WHEN 'contact_ready' THEN 5 WHEN 'human_review_required' THEN 6 WHEN 'contact_required' THEN 7 WHEN 'research_required' THEN 8 WHEN 'suppressed' THEN 10 ELSE 9 END END AS action_rank FROM base),
queue AS (SELECT *, CASE WHEN action_rank < 5 OR opportunity_score <> 0 THEN opportunity_score ELSE acquisition_score END AS queue_score FROM ranked
  ORDER BY action_rank, CASE WHEN action_rank = 2 THEN late ELSE 0 END DESC, queue_score DESC, id LIMIT 40)
"""
_WHOLE_QUEUE = _QUEUE.replace(" LIMIT 40)", ")")


def the_queue(t, limit=None):
    return activity.action_queue(t.s_prospects, t.s_events, t.s_tasks, EVENTS_AS_OF, min_score=50, limit=limit)


@query("a8_queue_counts", f"""
WITH {_WHOLE_QUEUE} SELECT count(*) AS total, count(*) FILTER (manual_review_state = 'unreviewed') AS need_review, count(*) FILTER (readiness_state = 'contact_ready') AS ready,
  count(*) FILTER (opportunity_score >= 65) AS high FROM queue
""")
def a8(t):
    return activity.queue_stats(the_queue(t))


_BOARD = f"""
last AS ({LAST_EVENT}),
cards AS (SELECT p.id, p.urgency_score, CASE coalesce(l.event_type, 'New') WHEN 'Sent' THEN 'Sent' WHEN 'Replied' THEN 'Replied' WHEN 'PositiveConversation' THEN 'Replied' WHEN 'MeetingBooked' THEN 'Meeting'
  WHEN 'ProposalSent' THEN 'Meeting' WHEN 'New' THEN 'New' ELSE 'Closed' END AS board_column FROM s_prospects p LEFT JOIN last l ON l.prospect_id = p.id WHERE NOT anonymized AND NOT opted_out)
"""


@query("a9_board_columns", f"WITH {_BOARD} SELECT board_column, count(*) AS cards, max(urgency_score) AS top_score FROM cards GROUP BY 1", whole="top_score")
def a9(t):
    return activity.board_counts(t.s_prospects, t.s_events)


@query("a9b_board_cards", f"WITH {_BOARD} SELECT id, board_column, urgency_score FROM cards", whole="urgency_score")
def a9b(t):
    return activity.board_cards(t.s_prospects, t.s_events).select("id", "board_column", "urgency_score")


@query("a11_independent_sources", f"""
WITH s AS ({SIGNALS}),
src AS (SELECT DISTINCT prospect_id, CASE WHEN lower(trim(source_type)) IN ({sql_list(fixed.INDEPENDENT_SOURCES)}) THEN lower(trim(source_type))
  WHEN lower(trim(source_type)) IN ('recherche', 'annuaire entreprises') THEN 'annuaire' END AS n FROM s),
won AS (SELECT DISTINCT prospect_id FROM s_award_rows),
every AS (SELECT prospect_id AS id, n FROM src WHERE n IS NOT NULL UNION SELECT prospect_id, 'decp' FROM won
  UNION SELECT id, 'sirene' FROM s_prospects p WHERE siren IS NOT NULL AND NOT EXISTS (SELECT 1 FROM src WHERE src.prospect_id = p.id AND n IN ('annuaire', 'sirene')))
SELECT p.id, coalesce(string_agg(DISTINCT e.n, ',' ORDER BY e.n), '') AS sources FROM s_prospects p LEFT JOIN every e ON e.id = p.id GROUP BY 1
""")
def a11(t):
    facts = evidence.evidence_facts(evidence.normalize_signals(t.s_evidence)).withColumnRenamed("prospect_id", "id")
    won = t.s_award_rows.select(F.col("prospect_id").alias("id"), F.lit(True).alias("won")).distinct()
    rows = t.s_prospects.join(facts, "id", "left").join(won, "id", "left")
    registered = is_filled(F.col("siren")) | is_filled(F.col("siret"))
    return rows.select(
        "id", F.array_join(evidence.source_types(F.col("signal_sources"), F.col("won").isNotNull(), registered), ",").alias("sources")
    )


@query("a15_recent_awards", f"""
SELECT prospect_id, count(*) FILTER (date IS NULL OR date = 'n/a' OR date_diff('day', CAST(CASE WHEN date <> 'n/a' THEN date END AS DATE), DATE '{HISTORY_AS_OF}') <= 90) AS recent_awards
FROM s_award_rows GROUP BY 1
""")
def a15(t):
    return awards.award_facts(t.s_award_rows, HISTORY_AS_OF).select("prospect_id", "recent_awards")


@query("w1_current_status", f"""
WITH last AS ({LAST_EVENT}) SELECT p.id, coalesce(l.event_type, 'New') AS current_status, l.next_action, strftime(l.event_date, '%Y-%m-%d %H:%M:%S') AS last_event
FROM s_prospects p LEFT JOIN last l ON l.prospect_id = p.id
""")
def w1(t):
    out = activity.current_status(t.s_prospects, t.s_events)
    return out.select("id", "current_status", "next_action", F.date_format("last_event_date", "yyyy-MM-dd HH:mm:ss").alias("last_event"))


@query("w2_follow_ups", f"""
WITH {_DUE} SELECT id AS prospect_id, event_type AS current_status, channel, next_action, days_overdue, urgency_score FROM due
""", whole="days_overdue urgency_score")
def w2(t):
    out = activity.follow_ups(t.s_prospects, t.s_events, EVENTS_AS_OF)
    return out.select("prospect_id", "current_status", "channel", "next_action", "days_overdue", "urgency_score")


@query("w3_action_queue", f"WITH {_QUEUE} SELECT id, action_rank, queue_score, late AS days_overdue FROM queue", whole="action_rank queue_score")
def w3(t):
    return the_queue(t, 40).select("id", "action_rank", "queue_score", "days_overdue")


@query("o1_list_page", """
SELECT id, coalesce(nullif(opportunity_score, 0), nullif(acquisition_score, 0), urgency_score) AS rank FROM s_prospects WHERE NOT anonymized AND NOT opted_out ORDER BY 2 DESC, 1 LIMIT 20 OFFSET 20
""", whole="rank")
def o1(t):
    from leadloom.functions.codes import primary_rank

    page = activity.list_page(activity.list_filter(t.s_prospects), page=2, size=20)
    return page.select("id", primary_rank(F.col("opportunity_score"), F.col("acquisition_score"), F.col("urgency_score")).alias("rank"))


@query("o1b_list_by_name", """
SELECT id, company_name FROM s_prospects WHERE NOT anonymized AND NOT opted_out ORDER BY lower(company_name) DESC, id LIMIT 50
""")
def o1b(t):
    return activity.list_page(activity.list_filter(t.s_prospects), sort="company_name").select("id", "company_name")


@query("o1c_list_by_priority", """
SELECT id, priority_level FROM s_prospects WHERE NOT anonymized AND NOT opted_out ORDER BY CASE priority_level WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 9 END DESC, id LIMIT 50
""")
def o1c(t):
    return activity.list_page(activity.list_filter(t.s_prospects), sort="priority_level").select("id", "priority_level")


@query("o2_sourcing_sort", """
SELECT id, acquisition_score, urgency_score FROM s_prospects WHERE NOT anonymized AND NOT opted_out ORDER BY acquisition_score DESC, urgency_score DESC, id LIMIT 150
""", whole="acquisition_score urgency_score")
def o2(t):
    return activity.sourcing_sort(activity.sourcing_filter(t.s_prospects)).select("id", "acquisition_score", "urgency_score")


@query("o3_registry_rank", """
WITH c AS (SELECT siren, arg_min(naf_code, sighting) AS naf, arg_min(company_size, sighting) AS size, min(decision_maker_name) AS person FROM s_registry WHERE naf_code IS NOT NULL GROUP BY 1)
SELECT siren, naf AS naf_code FROM c ORDER BY CASE WHEN substring(naf, 1, 2) IN ('33', '43', '81', '71') THEN 0 ELSE 1 END, CASE WHEN size IN ('11-50', '51-200') THEN 0 ELSE 1 END,
  CASE WHEN person IS NOT NULL THEN 0 ELSE 1 END, siren LIMIT 100
""")
def o3(t):
    companies = t.s_registry.filter(F.col("naf_code").isNotNull()).groupBy("siren").agg(
        F.min_by("naf_code", "sighting").alias("naf_code"), F.min_by("company_size", "sighting").alias("company_size"),
        F.min("decision_maker_name").alias("decision_maker_name"),
    )
    return rank_registry(companies, FIELD_SERVICE, 100).select("siren", "naf_code")


@query("o4_top_holders", f"""
WITH {HOLDERS} SELECT holder_key, award_count, total_cents FROM described ORDER BY award_count DESC, total_cents DESC, holder_key LIMIT 200
""")
def o4(t):
    return awards.top_holders(holders(t), 200).select("holder_key", "award_count", "total_cents")


@query("o6_follow_up_order", f"""
WITH {_DUE} SELECT id AS prospect_id, days_overdue, urgency_score FROM due ORDER BY days_overdue DESC, urgency_score DESC, id LIMIT 25
""", whole="days_overdue urgency_score")
def o6(t):
    return activity.follow_ups(t.s_prospects, t.s_events, EVENTS_AS_OF).limit(25).select("prospect_id", "days_overdue", "urgency_score")
