"""Multi-party perspective rotation: a dialogue is rendered once for each participant, with that speaker as the assistant.

The system's turns stay the system's, other speakers are named users, and the mask covers the assistant's words and the mark
that ends them. A sample is the whole dialogue. Only where a dialogue has more than `part_chars` characters (more than a row can
well hold; a parameter) is it rendered in parts of about that length: all participants have all parts, cut at the same turns and
in the same order, so that the parts put together are the whole. Its rows are then dealt out by ranges of their order, so no task
holds more than a part, whatever share of all rows one dialogue has.

A turn's start is that of a rendering in which everybody is a user, moved by the same distance for each earlier turn of the
assistant's own; so starts are running sums over rows, made once for all participants.

Rows: exact repeats of a turn count once. Turns stand in the order of turn (null first), role and text. A null role speaks as
`unknown`, a null text is empty, a null conv_id is a dialogue of its own. A dialogue in which only the system speaks has no
sample; an empty table has none. Marks within a text or role get a backslash after `<|` (as do those that have some already, so
that it can be undone); in a role a backslash becomes two and a newline `\\n`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebed.llm.frames import pick
from orebed.session import written

#: Characters of a rendered dialogue beyond which it is cut into parts.
PART_CHARS = 1 << 24
# The marks of the rendered format.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM, NOBODY, ASSISTANT, USER = "system", "unknown", "assistant", "user name="


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(\\*im_)", r"<|\\$1")


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without repeats or nulls in role and text, escaped; head and size of the turn as a user's."""
    role = F.replace(F.replace(F.coalesce("role", F.lit(NOBODY)), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    text = _escaped(F.coalesce("text", F.lit("")))
    rows = pick(conversations, "conv_id", "turn", "role", "text").select("conv_id", "turn", _escaped(role).alias("role"), text.alias("text")).distinct()
    name = F.when(F.col("role") == SYSTEM, SYSTEM).otherwise(F.concat(F.lit(USER), F.col("role")))
    sized = rows.withColumn("head", F.concat(F.lit(BEGIN), name, F.lit("\n")))
    return sized.withColumn("size", (F.length("head") + F.length("text") + len(END)).cast("long"))


def _placed(turns: DataFrame, *group: str) -> DataFrame:
    """turns with start: the sum of the sizes before it in its group."""
    order = Window.partitionBy(*group).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0).cast("long")))


def _rendered(samples: DataFrame) -> DataFrame:
    """conv_id, part, assistant, n_turns, text, mask. samples: conv_id, part, turns (sorted), assistant."""
    own = lambda t: t["role"] == F.col("assistant")
    head = lambda t: F.when(own(t), f"{BEGIN}{ASSISTANT}\n").otherwise(t["head"])
    text = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(END))), "")
    shift = len(ASSISTANT) - len(USER) - F.length("assistant")
    first = F.get("turns", F.lit(0))["start"]

    def span(t: Column, i: Column) -> Column:
        end = t["start"] - first + t["size"] + (i + 1) * shift
        return F.struct((end - F.length(t["text"]) - len(END)).cast("long").alias("start"), end.cast("long").alias("end"))

    mask = F.transform(F.filter("turns", own), span)
    return samples.select("conv_id", "part", "assistant", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), mask.alias("mask"))


def _collected(placed: DataFrame) -> DataFrame:
    turn = F.struct("turn", "role", "text", "head", "size", "start")
    return placed.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def _in_parts(turns: DataFrame, part_chars: int) -> DataFrame:
    """The samples of long dialogues, part by part."""
    dealt = written(turns.repartitionByRange("conv_id", "turn", "role", "text").withColumn("block", F.spark_partition_id()), "chat-blocks")
    blocks = dealt.groupBy("conv_id", "block").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("begun"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    placed = _placed(dealt, "conv_id", "block").join(begun, same("conv_id", "c") & (F.col("block") == F.col("b")))
    placed = placed.withColumn("start", F.col("start") + F.col("begun")).withColumn("part", F.floor(F.col("start") / part_chars).cast("long"))
    speakers = dealt.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("role").alias("assistant")).distinct()
    return _collected(placed).join(speakers, same("conv_id", "c")).drop("c")


def rotate(conversations: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, assistant, n_turns, text, mask (array of start and end in code points of the text, end exclusive)."""
    turns = _turns(conversations)
    sizes = turns.groupBy("conv_id").agg(F.sum("size").alias("whole")).where(F.col("whole") > part_chars)
    long = written(sizes.select(F.col("conv_id").alias("c")), "chat-long")
    if long.isEmpty():
        whole = turns
    else:
        turns = written(turns, "chat-turns")
        whole = turns.join(long, turns.conv_id.eqNullSafe(long.c), "left_anti")
    samples = _collected(_placed(whole, "conv_id").withColumn("part", F.lit(0).cast("long")))
    speakers = F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: r != SYSTEM))
    drawn = _rendered(samples.withColumn("assistant", F.explode(speakers)))
    if whole is turns:
        return drawn
    return drawn.union(_rendered(_in_parts(turns.join(long, turns.conv_id.eqNullSafe(long.c), "left_semi"), part_chars)))
