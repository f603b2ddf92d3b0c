"""Domain views over the driver's tables, as DataFrames and as the SQL that makes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task sorts or joins.
TASK_ROWS = 250_000


def tasks_for(table: DataFrame, rows: int = TASK_ROWS) -> int:
    """So many tasks that each has about rows of the table's rows, which the files' footers tell, and no fewer than the machine's cores.

    Without a given number Spark merges tasks by the bytes of their compressed files, and one task gets millions of rows that are alike."""
    n = table.count()
    return max(-(-n // rows), min(table.sparkSession.sparkContext.defaultParallelism, -(-n // 1000)), 1)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.expr("cast((dayofyear(l_shipdate) - 1) div 7 as int)")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("id"), pos.alias("pos"), F.expr("substring('ACGT', cast((dayofyear(l_shipdate) - 1) div 7 as int) % 4 + 1, 1)").alias("base"),
        (F.col("l_returnflag") == "R").cast("bigint").alias("hit"), "l_linestatus", "l_returnflag", "l_orderkey", "l_linenumber", "l_quantity",
    )


def rc_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample (F treated, O untreated), id, pos, base, count, coverage."""
    return _cells(spark, sf_dir).groupBy("id", F.col("l_linestatus").alias("sample"), "pos", "base").agg(F.count(F.lit(1)).alias("coverage"), F.sum("hit").alias("count"))


def rc_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As rc_long with three samples (T treated, U untreated, D denatured) by line number."""
    sample = F.expr("substring('TUD', l_linenumber % 3 + 1, 1)")
    return _cells(spark, sf_dir).groupBy("id", sample.alias("sample"), "pos", "base").agg(F.count(F.lit(1)).alias("coverage"), F.sum("hit").alias("count"))


def reactivity_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three replicates (by return flag): sample, id, pos, base, value; null where coverage is below 3."""
    value = F.when(F.count(F.lit(1)) >= 2, F.avg("l_quantity") / 50)
    return _cells(spark, sf_dir).groupBy("id", F.col("l_returnflag").alias("sample"), "pos", "base").agg(F.round(value, 4).alias("value"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reads: read_no, sample, id, start, end, muts (sorted positions)."""
    lines = _cells(spark, sf_dir).select(F.col("l_orderkey").alias("read_no"), "l_linestatus", "id", "pos", "hit")
    return (
        lines.repartition(tasks_for(table(spark, sf_dir, "lineitem")), "read_no")
        .groupBy("read_no")
        .agg(
            F.min("l_linestatus").alias("sample"), F.min("id").alias("id"), F.min("pos").alias("start"), F.max("pos").alias("end"),
            F.array_sort(F.collect_set(F.when(F.col("hit") == 1, F.col("pos")))).alias("muts"),
        )
    )


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as mates, two by two: pair_id, mate, id, start, end (7 positions each)."""
    pair, mate = F.expr("l_orderkey * 4 + (l_linenumber - 1) div 2"), (F.col("l_linenumber") - 1) % 2 + 1
    lines = _cells(spark, sf_dir).groupBy(pair.alias("pair_id"), mate.alias("mate"))
    return lines.agg(F.min("pos").alias("start"), F.max("hit").alias("hit")).select("pair_id", "mate", (F.col("pair_id") % 50).alias("id"), "start", (F.col("start") + 6).alias("end"), "hit")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as closed intervals: id (user), start, end in minutes of the month."""
    minute = F.expr("cast((unix_timestamp(ts) - unix_timestamp(timestamp'2024-01-01 00:00:00')) div 60 as bigint)")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id"), minute.alias("start"), (minute + F.floor(F.col("value")).cast("bigint")).alias("end"), "event_type", "value")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as sequences: id, sequence (ACGT of the whole text)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("sequence"))


_POS = "cast((dayofyear(l_shipdate) - 1) // 7 as int)"
_CELLS = f"""cells as (select l_suppkey as id, {_POS} as pos, substr('ACGT', {_POS} % 4 + 1, 1) as base,
  cast(l_returnflag = 'R' as bigint) as hit, l_linestatus, l_returnflag, l_orderkey, l_linenumber, l_quantity from lineitem)"""
SQL = {
    "rc": f"{_CELLS}, rc as (select id, l_linestatus as sample, pos, base, count(*) as coverage, cast(sum(hit) as bigint) as count from cells group by all)",
    "rc3": f"{_CELLS}, rc3 as (select id, substr('TUD', l_linenumber % 3 + 1, 1) as sample, pos, base, count(*) as coverage, cast(sum(hit) as bigint) as count from cells group by all)",
    "react": f"{_CELLS}, react as (select id, l_returnflag as sample, pos, base, round(case when count(*) >= 2 then avg(l_quantity) / 50 end, 4) as value from cells group by all)",
    "reads": f"""{_CELLS}, reads as (select l_orderkey as read_no, min(l_linestatus) as sample, min(id) as id, min(pos) as start, max(pos) as "end",
      coalesce(list_sort(list(distinct pos) filter (hit = 1)), []) as muts from cells group by 1)""",
    "mates": f"""{_CELLS}, mates as (select pair_id, mate, pair_id % 50 as id, min(pos) as start, min(pos) + 6 as "end", max(hit) as hit
      from (select l_orderkey * 4 + (l_linenumber - 1) // 2 as pair_id, (l_linenumber - 1) % 2 + 1 as mate, pos, hit from cells) group by pair_id, mate)""",
    "iv": """iv as (select user_id as id, event_id, cast(floor((epoch(ts) - epoch(timestamp '2024-01-01 00:00:00')) / 60) as bigint) as start,
      cast(floor((epoch(ts) - epoch(timestamp '2024-01-01 00:00:00')) / 60) + floor(value) as bigint) as "end", event_type, value from events)""",
    "seqs": "seqs as (select doc_id as id, regexp_replace(upper(text), '[^ACGT]', '', 'g') as sequence from documents)",
}
