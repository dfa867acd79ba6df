"""Chat formatting by perspective rotation: one rendering of a dialogue for every participant.

For each participant the dialogue is written with that speaker as the assistant, the other speakers as named users and
system messages as they are, together with the spans of the rendering that a loss should be taken on: the assistant's
messages with the mark of their end, which a model has to learn to write, without their headers.

A rendering comes in parts of PART_TURNS messages, so that no row and no group grows without bound. Parts are cut by
the place of a message in its dialogue, and spans count from the start of the whole rendering: the parts of any size,
one behind the other, are the same text with the same mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelwright.llm.common import stored

#: Messages of a part.
PART_TURNS = 512
#: What is written around messages. Texts and roles that hold marks can't pass for a turn: OPENS gets a backslash inside
#: of both, and SHUTS inside of roles.
ASSISTANT, SYSTEM, USER, END = "<|assistant|>\n", "<|system|>\n", "<|user name={}|>\n", "<|end|>"
OPENS, SHUTS = "<|", "|>"


def _escaped(text: Column, *marks: str) -> Column:
    for m in marks:
        text = F.replace(text, F.lit(m), F.lit(m[0] + "\\" + m[1]))
    return text


def _placed(turns: DataFrame) -> DataFrame:
    """A stored table of the messages with their place (from 0) in their conversation, in order of turn, role and text.

    One sort deals all messages out by ranges of that order, so that a long conversation lies in several tasks. What is
    added up for it is one number for each task that it lies in.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    rows = turns.select("conv_id", "turn", "role", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sorted_ = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "chat-sorted")
    sorted_ = sorted_.withColumn("task", F.shiftright("at", 33))
    pieces = sorted_.groupBy("conv_id", "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = stored(pieces.select(F.col("conv_id").alias("c"), F.col("task").alias("t"), (before - F.col("first")).alias("shift")), "chat-pieces")
    met = sorted_.join(pieces, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("task") == F.col("t")))
    return met.select("conv_id", "turn", "role", "text", (F.col("at") + F.col("shift")).alias("place"))


def perspectives(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row for each conversation, part and participant of the conversation: conv_id, part, speaker, n_messages,
    n_own, start (where the part begins in the whole rendering), rendered, mask (spans start:end of code points of the
    whole rendering, comma-joined, end exclusive).

    turns has conv_id, turn, role and text; other columns are ignored. A participant is a role other than "system"
    that isn't null; messages of a null role are rendered as those of a user named "unknown", who gets no rendering.
    A null text is an empty one, a null turn comes first, equal turns are ordered by role and text, and repeated rows
    are rendered as often as they occur. A null conv_id is a conversation of its own. A conversation without
    participants has no rows; an empty table gives an empty one. Texts of any length are written whole.
    """
    user = F.concat(F.lit(USER.split("{}")[0]), _escaped(F.coalesce("role", F.lit("unknown")), OPENS, SHUTS), F.lit(USER.split("{}")[1]))
    head = F.when(F.col("role") == "system", F.lit(SYSTEM)).otherwise(user)
    rows = _placed(turns).select("conv_id", "role", "place", F.floor(F.col("place") / part_turns).cast("long").alias("part"), head.alias("head"), _escaped(F.col("text"), OPENS).alias("text"))
    parts = rows.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("place", "role", "head", "text"))).alias("messages"),
        F.sum(F.length("head") + F.length("text") + len(END) + 1).alias("size"),
    )
    parts = stored(parts, "chat-parts")
    # how much longer or shorter a speaker's own messages make a part, in his or her view
    own = rows.filter("role <> 'system'").groupBy("conv_id", "part", F.col("role").alias("speaker")).agg(F.sum(F.lit(len(ASSISTANT)) - F.length("head")).alias("change"))
    own = stored(own, "chat-own")
    speakers = stored(own.select(F.col("conv_id").alias("c"), "speaker").distinct(), "chat-speakers")
    sizes = parts.select("conv_id", "part", "size").join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    changes = own.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("speaker").alias("s"), "change")
    sizes = sizes.join(changes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("speaker") == F.col("s")), "left")
    before = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("size") + F.coalesce("change", F.lit(0))).over(before), F.lit(0)).cast("long")
    starts = stored(sizes.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "speaker", start.alias("start")), "chat-starts")
    views = parts.select("conv_id", "part", "messages").join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))

    def piece(m: Column) -> Column:
        mine = F.coalesce(m["role"] == F.col("speaker"), F.lit(False))
        return F.struct(F.when(mine, F.lit(ASSISTANT)).otherwise(m["head"]).alias("head"), F.concat(m["text"], F.lit(END)).alias("body"), mine.alias("own"))

    def step(s: Column, p: Column) -> Column:
        begin = s["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    views = views.withColumn("pieces", F.transform("messages", piece))
    mask = F.aggregate("pieces", F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("spans")), step, lambda s: F.array_join(s["spans"], ","))
    rendered = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    n_own = F.size(F.filter("pieces", lambda p: p["own"])).cast("long")
    return views.select("conv_id", "part", "speaker", F.size("pieces").cast("long").alias("n_messages"), n_own.alias("n_own"), "start", rendered.alias("rendered"), mask.alias("mask"))
