"""Chat formatting by multi-party perspective rotation.

Every speaker of a conversation but the system gets a rendering of the whole
dialogue in which that speaker is the assistant and the others are named users.
What the speaker said, with the end mark, is what a model is to learn; the mask
has these character spans. Turns are rendered in place; each turn meets the
speakers of its own conversation only, by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>"
SYSTEM = "system"
NOBODY = "unknown"


def _header(name: Column, of: Column) -> Column:
    return F.when(name == of, F.lit("<|assistant|>\n")).when(name == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))


def perspectives(turns: DataFrame) -> DataFrame:
    """One row per conversation and speaker: ``conv_id, speaker, rendered, n_turns, n_own, mask, n_masked``.

    ``turns`` has ``conv_id, turn, role, text``; ``role`` names the speaker. ``mask``
    is an array of ``(start, end)`` in characters of ``rendered``, end exclusive, in
    order. Turns stand in order of ``turn``, then role, then text, nulls first; a null
    role speaks as "unknown", a null text is empty. A conversation of system turns
    only has no speaker and no row. Rows that repeat are turns each. A null
    ``conv_id`` is a conversation of its own. An empty table gives no row; other columns are not read.
    """
    name = F.coalesce(F.col("role").cast("string"), F.lit(NOBODY))
    rows = turns.select("conv_id", "turn", name.alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    speakers = rows.where(F.col("name") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("name").alias("speaker")).distinct()
    met = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    shown = met.select("conv_id", "turn", "name", "body", "speaker", _header(F.col("name"), F.col("speaker")).alias("head"), F.concat("body", F.lit(END)).alias("said"))
    shown = shown.withColumn("piece", F.concat("head", "said", F.lit("\n")))
    order = Window.partitionBy("conv_id", "speaker").orderBy("turn", "name", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = shown.select("conv_id", "speaker", "name", "piece", F.sum(F.length("piece")).over(order).alias("upto"), F.row_number().over(Window.partitionBy("conv_id", "speaker").orderBy("turn", "name", "body")).alias("at"), F.length("said").alias("size"))
    own = F.col("name") == F.col("speaker")
    ends = F.col("upto") - 1
    grouped = placed.groupBy("conv_id", "speaker").agg(
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"),
        F.count("*").alias("n_turns"),
        F.sum(own.cast("long")).alias("n_own"),
        F.array_sort(F.collect_list(F.when(own, F.struct((ends - F.col("size")).alias("start"), ends.alias("end"))))).alias("mask"),
        F.sum(F.when(own, F.col("size")).otherwise(0)).cast("long").alias("n_masked"),
    )
    return grouped.select("conv_id", "speaker", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("rendered"), "n_turns", "n_own", "mask", "n_masked")


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """The renderings, with the mask as text (``start:end``, comma-joined)."""
    got = perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return got.withColumn("mask", F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ","))


ORACLE = """
with r as (select conv_id, turn, coalesce(role, 'unknown') as name, coalesce(text, '') as body from conversations),
s as (select distinct conv_id as c, name as speaker from r where name <> 'system'),
m as (select r.*, s.speaker,
        case when name = speaker then '<|assistant|>' when name = 'system' then '<|system|>' else '<|user name=' || name || '|>' end || chr(10) as head
      from r join s on r.conv_id is not distinct from s.c),
p as (select *, head || body || '<|end|>' || chr(10) as piece, length(body) + 7 as size from m),
w as (select *, sum(length(piece)) over (partition by conv_id, speaker order by turn nulls first, name, body rows unbounded preceding) as upto,
        row_number() over (partition by conv_id, speaker order by turn nulls first, name, body) as pos from p)
select conv_id, speaker, string_agg(piece, '' order by pos) as rendered, count(*) as n_turns,
       cast(count(*) filter (where name = speaker) as bigint) as n_own,
       coalesce(string_agg(cast(upto - 1 - size as bigint) || ':' || cast(upto - 1 as bigint), ',' order by pos) filter (where name = speaker), '') as mask,
       cast(coalesce(sum(size) filter (where name = speaker), 0) as bigint) as n_masked
from w group by conv_id, speaker
"""
