"""Collapse of cumulative conversation snapshots, then chat rendering (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointloom.session import table


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): the conversations that no longer one starts with; of equal ones the smallest conv_id stands for n_copies.

    turns: (conv_id, turn, role, text). Turns are taken in the order (turn, role, text), nulls first; rows repeated in all four columns count once; rows with a null conv_id belong to no conversation. A null role or text differs from an empty one. The turn number itself isn't compared, only the sequence of (role, text).
    The prefix hash of a conversation after k turns is the xor of hashes of (position, role, text), twice with different seeds (128 bits), so it rolls over a window in one sorted pass and no conversation is ever collected. Prefixes are made distinct with map-side aggregation, so a common first turn stays one row per task.
    """
    rows = turns.select("conv_id", "turn", "role", "text").where("conv_id is not null").distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("k", F.row_number().over(order))
    coded = [F.col("k"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    rows = rows.select("conv_id", "k", F.xxhash64(F.lit(17), *coded).alias("a"), F.xxhash64(F.lit(40503), *coded).alias("b"))
    run = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("conv_id", "k", F.expr("bit_xor(a)").over(run).alias("a"), F.expr("bit_xor(b)").over(run).alias("b"), F.lead("k").over(Window.partitionBy("conv_id").orderBy("k")).isNull().alias("whole"))
    prefixes = rows.where("not whole").select("k", "a", "b").distinct()
    full = rows.where("whole").groupBy("k", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    return full.join(prefixes, ["k", "a", "b"], "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """kept with the column ``chat``: per turn ``<|role|>``, newline, text, newline. Null role or text: empty."""
    rows = turns.select("conv_id", "turn", "role", "text").join(kept.select("conv_id"), "conv_id", "left_semi").distinct()
    one = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("t"), "turn", F.col("role").isNotNull().alias("r"), "role", F.col("text").isNotNull().alias("x"), "text", one.alias("s")))).alias("l"))
    chats = chats.select("conv_id", F.array_join(F.transform("l", lambda r: r["s"]), "").alias("chat"))
    return kept.join(chats, "conv_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return render(turns, maximal_conversations(turns)).select("conv_id", "n_turns", "n_copies", "chat")


ORACLE = """
with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k from t),
p as (select conv_id, k, string_agg(k || chr(1) || coalesce(role, chr(2)) || chr(3) || coalesce(text, chr(2)), chr(4)) over (partition by conv_id order by k rows unbounded preceding) as pre,
             lead(k) over (partition by conv_id order by k) is null as whole from o),
f as (select pre, k as n_turns, min(conv_id) as conv_id, count(*) as n_copies from p where whole group by pre, k),
m as (select * from f where not exists (select 1 from p where not p.whole and p.pre = f.pre)),
c as (select conv_id, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' order by k) as chat from o group by conv_id)
select m.conv_id, n_turns, n_copies, chat from m join c on m.conv_id = c.conv_id
"""
