"""Chat formatting by cumulative-snapshot collapse.

Systems that log a conversation after every turn leave snapshots in which all
but the last are prefixes of a longer one. A conversation's turns are folded
into a chain of hashes, one for each prefix; conversations whose whole hash is
a proper prefix of another are removed by an anti-join, equal conversations
keep the smallest id, and what remains is rendered. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written

START, END = "<|im_start|>", "<|im_end|>"


#: Parts of a prefix hash and hex digits of each: 240 bits, whose sums over 10^19 turns a decimal still holds.
PARTS, DIGITS = 4, 15


def prefixes(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, place, role, text; place from 0) with `hash`, of the turns up to and with this one.

    A turn's digest covers its place, and the digests up to a turn are summed, part by part, so that one running sum in the order of turns
    gives all prefixes of a conversation of any length. Two prefixes are equal if they have as many turns and equal sums.
    """
    said = F.sha2(F.concat_ws("\x1f", F.col("place").cast("string"), F.length("role").cast("string"), F.col("role"), F.col("text")), 256)
    upto = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = lambda i: F.conv(F.substring("digest", 1 + DIGITS * i, DIGITS), 16, 10).cast("decimal(20,0)")
    sums = [F.sum(part(i)).over(upto).cast("string") for i in range(PARTS)]
    return turns.withColumn("digest", said).withColumn("hash", F.concat_ws(":", (F.col("place") + 1).cast("string"), *sums)).drop("digest")


def conversations_of(log: DataFrame) -> DataFrame:
    """One row per conv_id: its turns in order, (conv_id, turns).

    Null roles and texts count as empty; equal rows count once; several texts at one turn
    stand in order of role and text; null turns come first; rows without conv_id are one conversation.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return log.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def collapse(log: DataFrame) -> DataFrame:
    """The maximal conversations of `log` (conv_id, turn, role, text): conv_id, n_turns, copies, text.

    `copies` counts the conversations with just these turns; `text` is rendered with START and END marks.
    An empty log gives no rows; other columns of `log` are not looked at.
    """
    convs = written(conversations_of(log))
    turns = convs.select("conv_id", F.size("turns").alias("n"), F.posexplode("turns").alias("place", "t")).select("conv_id", "n", "place", "t.role", "t.text")
    hashes = written(prefixes(turns).select("conv_id", "hash", (F.col("place") + 1 == F.col("n")).alias("whole")))
    distinct = hashes.where("whole").groupBy("hash").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    # a first turn that half of all conversations share comes from each task once
    maximal = distinct.join(hashes.where("not whole").select("hash").distinct(), "hash", "left_anti").select("conv_id", "copies")
    shown = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "\n")
    return (
        convs.alias("c")
        .join(maximal.alias("m"), F.col("c.conv_id").eqNullSafe(F.col("m.conv_id")))
        .select("c.conv_id", F.size("turns").cast("long").alias("n_turns"), "copies", shown.alias("text"))
    )


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


SQL = """
with turns as (
  select conv_id, list(t order by t.turn nulls first, t.role, t.text) as turns
  from (select distinct conv_id, {'turn': turn, 'role': coalesce(role, ''), 'text': coalesce(text, '')} as t from conversations) group by conv_id),
lists as (select conv_id, list_transform(turns, lambda x: {'role': x.role, 'text': x.text}) as said from turns),
kept as (select min(conv_id) as conv_id, said, count(*) as copies from lists group by said)
select a.conv_id, len(a.said)::bigint as n_turns, a.copies,
  array_to_string(list_transform(a.said, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>'), chr(10)) as text
from kept a where not exists (
  select 1 from kept b where b.said[1] = a.said[1] and len(b.said) > len(a.said) and b.said[1:len(a.said)] = a.said)
"""
