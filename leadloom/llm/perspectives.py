"""Multi-party chat formatting: the dialogue once per participant, seen from that participant's seat.

For every participant of a conversation each turn becomes one segment: the participant's own turns as ``assistant``,
everybody else's as a ``user`` with a name, and system turns as they are.  A training mask marks the text of the
assistant's turns.  Segments stay rows, in order of turn, so a conversation of any length is never gathered; the
dialogue of a perspective is its segments one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.session import stage

SYSTEM_ROLES = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _safe(text: Column) -> Column:
    """Markers inside a turn lose their bars, so no turn can open or close a segment."""
    return F.replace(F.replace(text, F.lit("<|im_"), F.lit("< im_")), F.lit("|>"), F.lit(" >"))


def rotate(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
    system_roles: tuple[str, ...] = SYSTEM_ROLES,
) -> DataFrame:
    """``conv, turn, perspective, speaker, role, name, segment, mask_start, mask_end, train``, a row per participant and turn.

    ``mask_start`` and ``mask_end`` count code points of the segment; both equal its length where nothing is trained.
    The closing marker is trained with the text.  Participants are the distinct non-system speakers of a conversation;
    a null speaker takes part under the name ``unknown`` (merged with a speaker of that name), a null text is empty, a
    null conversation is one conversation, a repeated turn is repeated.  A conversation of system turns alone, like an
    empty table, gives no rows.  Extra columns are ignored.
    """
    said = turns.select(
        F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{speaker}`"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    people = said.filter(~F.col("speaker").isin(*system_roles)).select(F.col("conv").alias("of"), F.col("speaker").alias("perspective")).distinct()
    # staged, so both sides of the join arrive by an exchange of their own and a hot conversation can be split
    seats = stage(people, "participants")
    joined = said.join(seats, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    mine = F.col("speaker") == F.col("perspective")
    role = F.when(mine, "assistant").when(F.col("speaker").isin(*system_roles), "system").otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    head = F.concat(F.lit(OPEN), role, F.when(name.isNotNull(), F.concat(F.lit(" name="), _safe(name))).otherwise(""), F.lit("\n"))
    segment = F.concat(head, _safe(F.col("text")), F.lit(CLOSE))
    rows = joined.select("conv", "turn", "perspective", "speaker", role.alias("role"), name.alias("name"), segment.alias("segment"), F.length(head).alias("head"))
    start = F.when(F.col("role") == "assistant", F.col("head")).otherwise(F.length("segment"))
    return rows.select(
        "conv", "turn", "perspective", "speaker", "role", "name", "segment",
        start.cast("long").alias("mask_start"), F.length("segment").cast("long").alias("mask_end"), (F.col("role") == "assistant").alias("train"),
    )
