"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

Every participant of a conversation takes the assistant's part once: in that perspective, own turns
are rendered as the assistant's and carry the loss mask, all others as named users; system turns
stay system turns. A dialogue is given as stretches of at most `ChatParams.turns` turns, in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.session import materialize


@dataclass(frozen=True)
class ChatParams:
    system_role: str = "system"
    open: str = "<|"
    close: str = "|>\n"
    end: str = "<|end|>\n"
    escaped: str = "<\\|"  #: what `open` becomes inside texts and names, so that they can't hold a mark
    name_end: tuple[str, str] = ("|>", "|\\>")  #: what would end a name's mark inside the name, and what it becomes
    unknown: str = "unknown"  #: name of a speaker whose role is null or blank
    turns: int = 64  #: most turns of a stretch


def numbered(df: DataFrame, conv: str, order: list[str]) -> DataFrame:
    """df with `pos`, the place from 0 of each row in its conversation by the order columns (nulls first).

    Rows are dealt out by ranges of conversation and order, so that a long conversation takes many
    tasks. A row's place is its place in its range less that of its conversation's first row there,
    and the number of its conversation's rows in earlier ranges. Rows equal in all these columns are
    interchangeable, and may lie in several ranges.
    """
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(conv, *order, "__tie").sortWithinPartitions(conv, *order, "__tie").drop("__tie")
    rows = materialize(ranged.withColumn("__at", F.monotonically_increasing_id()), "turns")  # ranges are drawn once
    rows = rows.withColumn("__range", F.shiftright("__at", 33))
    parts = rows.groupBy(F.col(conv).alias("__conv"), F.col("__range").alias("__r")).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    earlier = Window.partitionBy("__conv").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = parts.select("__conv", "__r", "__first", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    met = rows.join(parts, F.col(conv).eqNullSafe(F.col("__conv")) & (F.col("__range") == F.col("__r")))
    return met.withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before")).drop("__at", "__range", "__conv", "__r", "__first", "__before")


def rotate(df: DataFrame, params: ChatParams = ChatParams(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each stretch in each perspective of a conversation: conv_id, perspective, part, n_turns, text, masks.

    Perspectives are the distinct roles that aren't null, blank or the system's. `text` is the
    rendered stretch; masks are the intervals (a, b) of its characters that are learned: text and end
    mark of the perspective's own turns. Turns stand in the order of `turn`, nulls first; those of
    one number in the order of a digest of role and text; repeated turns are rendered each. Opening
    marks inside texts and names are escaped, and closing marks inside names. A null text renders as empty; null and blank roles as
    an unknown user; a null conversation id is one conversation; a conversation without participants
    gives no row, nor does an empty table. No group is larger than a stretch; stretches and
    participants meet in one join by conversation, which Spark can split where one has very many.
    """
    p = params
    role, text = F.col(role_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.regexp_replace(role, r"^[\t-\r ]+|[\t-\r ]+$", "")
    who = F.when(name != "", name)
    turns = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.md5(F.concat(F.coalesce(role, F.lit("")), F.lit("\n"), text).cast("binary")).alias("digest"), who.alias("who"), text.alias("text")
    )
    people = turns.where(F.col("who").isNotNull() & (F.col("who") != p.system_role)).select(F.col("conv_id").alias("of"), F.col("who").alias("perspective")).distinct()
    rows = numbered(turns, "conv_id", ["turn", "digest"]).withColumn("part", F.floor(F.col("pos") / p.turns))
    stretches = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "who", "text"))).alias("said"))
    met = stretches.join(people, F.col("conv_id").eqNullSafe(F.col("of")))
    escape = lambda c: F.replace(c, F.lit(p.open), F.lit(p.escaped))

    def piece(t: Column) -> Column:
        mine = F.coalesce(t["who"] == F.col("perspective"), F.lit(False))
        speaker = F.when(mine, F.lit("assistant")).when(t["who"] == p.system_role, F.lit("system")).otherwise(F.concat(F.lit("user:"), F.replace(escape(F.coalesce(t["who"], F.lit(p.unknown))), *map(F.lit, p.name_end))))
        return F.struct(F.concat(F.lit(p.open), speaker, F.lit(p.close)).alias("head"), F.concat(escape(t["text"]), F.lit(p.end)).alias("body"), mine.alias("mine"))

    met = met.select("conv_id", "perspective", "part", F.transform("said", piece).alias("pieces"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)").alias("masks"))

    def add(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["head"])
        b = a + F.length(x["body"])
        return F.struct(b.alias("at"), F.when(x["mine"], F.concat(acc["masks"], F.array(F.struct(a.alias("a"), b.alias("b"))))).otherwise(acc["masks"]).alias("masks"))

    return met.select(
        "conv_id", "perspective", "part", F.size("pieces").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"])), "").alias("text"), F.aggregate("pieces", start, add)["masks"].alias("masks"),
    )
