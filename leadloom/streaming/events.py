"""Streaming twins of the event and evidence operators.

The prospects and suppression tables are the static side; the event log is the
stream.  Sinks get a checkpoint location from the caller, on the cluster's
shared storage.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from leadloom import fixed
from leadloom.operators.compliance import accepted, gate_events, suppression_keys
from leadloom.operators.activity import LAST_FIELDS
from leadloom.operators.evidence import with_fingerprint


def gate_stream(
    events: DataFrame,
    prospects: DataFrame,
    suppression: DataFrame,
    accepted_path: str,
    rejected_path: str,
    checkpoint: str,
) -> DataStreamWriter:
    """Gate each micro-batch and write accepted and rejected events apart.

    Both outputs carry the batch number as a partition that is overwritten when
    a batch is repeated, so a restarted query writes nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        gated = gate_events(batch, prospects, suppression).persist()
        try:
            good = accepted(gated).withColumn("batch", F.lit(number))
            bad = gated.filter(F.col("reason").isNotNull()).withColumn("batch", F.lit(number))
            for rows, path in ((good, accepted_path), (bad, rejected_path)):
                (
                    rows.write.mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic")
                    .partitionBy("batch")
                    .parquet(path)
                )
        finally:
            gated.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def status_stream(events: DataFrame) -> DataFrame:
    """The current status per prospect, kept up to date (update mode)."""
    last = F.max_by(F.struct(*LAST_FIELDS), F.struct("event_date", "id"))
    return events.groupBy("prospect_id").agg(last.alias("last")).select(
        "prospect_id", F.col("last.event_type").alias("current_status"), "last.event_date", "last.next_action",
        "last.next_action_date",
    )


def weekly_contacted_stream(
    events: DataFrame, width: str = "7 days", slide: str = "1 day", late: str = "1 day", error: float = 0.01
) -> DataFrame:
    """Approximate number of prospects contacted per sliding week."""
    contacted = events.filter(F.col("event_type").isin(*fixed.CONTACTED_EVENTS))
    contacted = contacted.withColumn("event_date", F.col("event_date").cast("timestamp"))
    return (
        contacted.withWatermark("event_date", late)
        .groupBy(F.window("event_date", width, slide).alias("week"))
        .agg(F.approx_count_distinct("prospect_id", error).alias("contacted"), F.count(F.lit(1)).alias("events"))
        .select(F.col("week.start").alias("week_start"), F.col("week.end").alias("week_end"), "contacted", "events")
    )


#: Distinct prospects are sketched with 2**12 registers: a count is off by 1.6 % as a rule, by 5 % at most for all practical ends.
SKETCH_BITS = 12
SKETCH_ERROR = 0.05


def daily_contacted_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Per day: contact events, and a sketch of the prospects they reached.

    One state row a day; weeks are merged from days (``weeks_of_days``), so no event is counted into seven of them.
    """
    contacted = events.filter(F.col("event_type").isin(*fixed.CONTACTED_EVENTS))
    contacted = contacted.withColumn("event_date", F.col("event_date").cast("timestamp"))
    return (
        contacted.withWatermark("event_date", late)
        .groupBy(F.window("event_date", "1 day").alias("day"))
        .agg(F.count(F.lit(1)).alias("events"), F.hll_sketch_agg("prospect_id", F.lit(SKETCH_BITS)).alias("people"))
        .select(F.col("day.start").alias("day"), "events", "people")
    )


def weeks_of_days(days: DataFrame, width: int = 7) -> DataFrame:
    """``week_start, events, contacted`` of every sliding week that has a day: sketches of its days merged."""
    spread = days.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    week = F.date_sub(F.col("day").cast("date"), F.col("back")).alias("week_start")
    weeks = spread.groupBy(week).agg(F.sum("events").alias("events"), F.hll_union_agg("people").alias("people"))
    return weeks.select("week_start", "events", F.hll_sketch_estimate("people").alias("contacted"))


def dedupe_stream(evidence: DataFrame, late: str = "7 days") -> DataFrame:
    """Evidence without repeats of a fingerprint inside the watermark."""
    stamped = with_fingerprint(evidence.filter(F.coalesce(F.col("is_active"), F.lit(True))))
    stamped = stamped.withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    return stamped.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["prospect_id", "fingerprint"])


STOP_SCHEMA = "prospect_id long, stop_reason string"
SUPPRESSED = "Suppressed"
STOPS = {SUPPRESSED: "suppression_entry_matched", **{kind: "prospect_replied" for kind in fixed.REPLY_EVENTS}, "OptOut": "opt_out_requested", "Bounced": "email_bounced"}


class StopState(StatefulProcessor):
    """Remembers per prospect that its sequence has stopped, and tells it once."""

    def __init__(self, stops: dict[str, str], ttl_ms: int | None) -> None:
        self.stops, self.ttl_ms = stops, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("reason", StringType())])
        self.stopped = handle.getValueState("stopped", schema, self.ttl_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.stopped.update((str(initialState["stop_reason"].iloc[0]),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            hits = frame[frame["event_type"].isin(list(self.stops))]
            if len(hits):
                top = hits.sort_values(["event_date", "id"]).iloc[0]
                mark = (top["event_date"], top["id"], self.stops[top["event_type"]])
                earliest = mark if earliest is None or mark < earliest else earliest
        if earliest is not None and not self.stopped.exists():
            self.stopped.update((earliest[2],))
            yield pd.DataFrame({"prospect_id": [key[0]], "stop_reason": [earliest[2]]})

    def close(self) -> None:
        pass


def suppression_hits(changes: DataFrame, prospects: DataFrame) -> DataFrame:
    """New suppression entries as stop rows of the prospects they hit: a stream of ``kind, value_normalized, suppressed_at`` beside a static table."""
    keys = prospects.select(F.col("id").alias("prospect_id"), F.explode(suppression_keys(email=F.col("email"), siren=F.col("siren"))).alias("key"))
    keys = keys.select("prospect_id", F.col("key.kind").alias("kind"), F.col("key.value").alias("value_normalized"))
    return changes.join(keys, ["kind", "value_normalized"]).select(
        F.lit(0).cast("long").alias("id"), "prospect_id", F.lit(SUPPRESSED).alias("event_type"), F.col("suppressed_at").alias("event_date")
    )


def stop_stream(events: DataFrame, hits: DataFrame | None = None, stopped: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """One row per prospect the moment its outreach must stop, by an event or by a suppression entry.

    ``hits`` are the rows of ``suppression_hits``; ``stopped`` (``prospect_id, stop_reason``, unique) are sequences that
    stopped before the stream began and are not told again.  Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    columns = ("id", "prospect_id", "event_type", "event_date")
    stops = events.filter(F.col("event_type").isin(*STOPS)).select(*columns)
    if hits is not None:
        stops = stops.unionByName(hits.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in stops.schema]))
    return stops.groupBy("prospect_id").transformWithStateInPandas(
        statefulProcessor=StopState(STOPS, ttl_ms),
        outputStructType=STOP_SCHEMA,
        outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
        initialState=stopped.select("prospect_id", "stop_reason").groupBy("prospect_id") if stopped is not None else None,
    )
