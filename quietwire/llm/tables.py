"""Written intermediate tables, literal tables and column selection shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwire.session import shared_folder


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` stored once as Parquet below ``spark.checkpoint.dir`` and read again.

    Unlike ``checkpoint()`` the plan runs only once, and a lost executor costs
    nothing that is already written.
    """
    spark = df.sparkSession
    path = shared_folder(spark, f"llm-{purpose}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def literal_rows(spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence[object]]) -> DataFrame:
    """A small fixed table made of literals (no data leaves the plan)."""
    structs = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


SALTS = 32


def with_group(rows: DataFrame, key: str, member: str, **values: tuple[Column, Callable[[str], Column]]) -> DataFrame:
    """``rows`` with aggregates of their ``key``, however many rows a key has.

    Each value is (aggregate of some rows, function that combines it by name). Rows are dealt out by a salt of
    ``member``; what a key's salts add up to goes back to the salts that it has, so no task gets all rows of a key.
    """
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(member), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy(key, "_salt").agg(*[first.alias(n) for n, (first, _) in values.items()])
    whole = parts.groupBy(key).agg(*[combine(n).alias(n) for n, (_, combine) in values.items()], F.collect_list("_salt").alias("_salts"))
    return dealt.join(whole.select(key, *values, F.explode("_salts").alias("_salt")), [key, "_salt"]).drop("_salt")


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, as Spark takes it."""
    return f"`{name.replace('`', '``')}`"


def documents_of(docs: DataFrame, *extra: Column) -> DataFrame:
    """``doc_id`` and ``text`` (null text is empty), whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)
