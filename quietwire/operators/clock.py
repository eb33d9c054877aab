"""Arrival clock and bounded running aggregates.

A running aggregate over a whole capture, or over one conversation that holds
a third of it, must not sort that much data in one task.  Rows are cut into
*tiles* (a slice of time or of arrival numbers); aggregates run inside a
(key, tile) group, and what earlier tiles contribute is carried in from one
summary row per (key, tile).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARRIVAL_BLOCK = 1_000_000


def tick(ts: Column, width: float) -> Column:
    """Number of the ``width``-second bucket."""
    return F.coalesce(F.floor(ts / F.lit(float(width))).cast("long"), F.lit(0).cast("long"))


def with_carry(summary: DataFrame, keys: Sequence[str], tile: str,
               carries: Mapping[str, Column]) -> DataFrame:
    """Adds aggregates over the *earlier* tiles of each key.

    ``summary`` holds one row per (key, tile), so a key contributes as many rows
    to a task as it has tiles, however many packets it has.
    """
    earlier = (Window.partitionBy(*keys).orderBy(tile)
               .rowsBetween(Window.unboundedPreceding, -1))
    return summary.withColumns({n: c.over(earlier) for n, c in carries.items()})


def arrival_watermark(packets: DataFrame, block_rows: int = ARRIVAL_BLOCK) -> DataFrame:
    """Adds ``wm``, the largest timestamp seen up to and including the row."""
    blocks = packets.withColumn("_block", F.floor(F.col("pkt_seq") / F.lit(block_rows)))
    # a constant key puts one summary row per million packets into one task
    summary = (blocks.groupBy("_block").agg(F.max("ts").alias("_top"))
               .withColumn("_all", F.lit(0)))
    before = with_carry(summary, ["_all"], "_block", {"_carry": F.max("_top")})
    local = (Window.partitionBy("_block").orderBy("pkt_seq")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (blocks.join(before.select("_block", "_carry"), "_block")
            .withColumn("wm", F.greatest(F.max("ts").over(local), F.col("_carry")))
            .drop("_block", "_carry"))


def late_rows(packets: DataFrame, window_sec: float, bucket_sec: float) -> DataFrame:
    """E5: marks rows whose bucket already left the window when they arrived."""
    oldest = tick(F.col("wm"), bucket_sec) - F.lit(int(window_sec // bucket_sec)) + 1
    return packets.withColumn("is_late", tick(F.col("ts"), bucket_sec) < oldest)


def prefix_sums(rows: DataFrame, bucket: str, order: Sequence, sums: Mapping[str, Column],
                keys: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums along ``order`` without ordering a key in one task.

    ``bucket`` must not decrease (or, for a descending order, not increase) along
    ``order``; pass it ready to be sorted ascending.  Each task orders one bucket,
    and earlier buckets arrive as one summary row each.
    """
    keyed = rows if keys else rows.withColumn("_all", F.lit(0))
    group = list(keys) or ["_all"]
    summary = keyed.groupBy(*group, bucket).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    carry = with_carry(summary, group, bucket, {f"_c_{n}": F.sum(f"_s_{n}") for n in sums})
    carry = carry.select(*group, bucket, *[f"_c_{n}" for n in sums])
    local = (Window.partitionBy(*group, bucket).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = keyed.join(carry.hint("merge"), [*group, bucket]).withColumns(
        {n: F.sum(c).over(local) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n, c in sums.items()})
    return out.drop("_all", *[f"_c_{n}" for n in sums])


def ranked(rows: DataFrame, ts: str, tie: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``rank`` (1, 2, ...) in (ts, tie) order, one time bucket per task."""
    bucketed = rows.withColumn("_bucket", tick(F.col(ts), width))
    return prefix_sums(bucketed, "_bucket", [ts, tie], {"rank": F.lit(1).cast("long")}, keys).drop("_bucket")


def rows_at_ranks(rows: DataFrame, bucket: Column, order: Sequence[str], ranks: Mapping[str, Column]) -> DataFrame:
    """One row: for each name the (struct of ``order``) of the row with that rank, null if there is none.

    ``ranks`` are expressions of the total ``n``.  Counts per bucket tell which bucket holds a rank; only the order
    columns of those buckets are sorted, everything else is left where it is, to be compared with the result.
    ``bucket`` must not decrease along ``order``.
    """
    narrow = rows.select(bucket.alias("_bucket"), *order)
    summary = narrow.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_all", F.lit(0))
    placed = with_carry(summary, ["_all"], "_bucket", {"_before": F.sum("_n")}).withColumns(
        {"_before": F.coalesce("_before", F.lit(0)), "n": F.sum("_n").over(Window.partitionBy("_all"))})
    placed = placed.withColumns({f"_r_{k}": r for k, r in ranks.items()})
    holds = F.lit(False)
    for k in ranks:
        holds = holds | ((F.col(f"_r_{k}") > F.col("_before")) & (F.col(f"_r_{k}") <= F.col("_before") + F.col("_n")))
    wanted = placed.filter(holds).drop("_all", "_n", "n")  # one bucket for each rank at most
    local = Window.partitionBy("_bucket").orderBy(*order)
    near = narrow.join(F.broadcast(wanted), "_bucket").withColumn("_rank", F.col("_before") + F.row_number().over(local))
    return near.agg(*[F.max(F.when(F.col("_rank") == F.col(f"_r_{k}"), F.struct(*order))).alias(k) for k in ranks])


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, tie: str, value: Column, width: float, name: str) -> DataFrame:
    """``left`` with ``name``: the ``value`` of the last row of ``right`` (by ``right_at``, then ``tie``) at or before ``left_at`` under the same keys.

    Both sides are laid one upon the other; a value is carried forward inside a (key, tile of ``width`` seconds), and one row per (key, tile)
    brings in the last value of earlier tiles. So each row moves once, and a key with a third of all rows is spread over its tiles.
    """
    known = right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_kind"), F.col(tie).cast("long").alias("_tie"), value.alias("_value"))
    asked = left.select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*left.columns).alias("_left"))
    both = known.unionByName(asked, allowMissingColumns=True).withColumn("_tile", tick(F.col("_at"), width))
    last = both.groupBy(*keys, "_tile").agg(F.max_by(F.when(F.col("_kind") == 0, F.struct("_value")), F.when(F.col("_kind") == 0, F.struct("_at", "_tie"))).alias("_last"))
    carried = F.last("_last", ignorenulls=True)
    earlier = with_carry(last, keys, "_tile", {"_carry": carried}).select(*keys, "_tile", "_carry")
    through = (Window.partitionBy(*keys, "_tile").orderBy("_at", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = F.last(F.when(F.col("_kind") == 0, F.struct("_value")), ignorenulls=True).over(through)
    found = both.withColumn("_near", near).filter("_kind = 1").join(earlier.hint("merge"), [*keys, "_tile"], "left")
    return found.select("_left.*", F.coalesce("_near", "_carry")["_value"].alias(name))


def with_scalars(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row table (totals, thresholds) to every row."""
    keyed = one_row.withColumn("_one", F.lit(0))
    return rows.withColumn("_one", F.lit(0)).join(F.broadcast(keyed), "_one").drop("_one")


def value_bucket(value: Column) -> Column:
    """A monotone bucket number for any finite double: 256 buckets per doubling."""
    size = F.floor(F.log2(F.lit(1.0) + F.abs(value)) * 256)
    return F.when(value < 0, -size - 1).otherwise(size).cast("long")


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str,
                    quantiles: Mapping[str, float], few_keys: bool = False) -> DataFrame:
    """Exact quantiles (linear interpolation) of ``value`` per key.

    A first pass counts rows per value bucket; only the buckets that hold a wanted
    rank are looked at value by value, so no task ever holds a whole key.  ``few_keys``
    states that the number of keys does not grow with the rows: the wanted buckets (two
    for each key and quantile at most) then go to the rows, which stay where they are.
    """
    keyed = rows.filter(F.col(value).isNotNull())
    if not keys:
        keyed = keyed.withColumn("_all", F.lit(0))
    group = list(keys) or ["_all"]
    keyed = keyed.select(*group, F.col(value).cast("double").alias("_v")).withColumn("_b", value_bucket(F.col("_v")))
    summary = with_carry(keyed.groupBy(*group, "_b").agg(F.count("*").alias("_n")), group, "_b",
                         {"_before": F.sum("_n")})
    whole = Window.partitionBy(*group)
    summary = summary.withColumns({"_before": F.coalesce("_before", F.lit(0)), "_total": F.sum("_n").over(whole)})

    def position(q: float) -> Column:
        return F.lit(q) * (F.col("_total") - 1)

    ranks = {}
    for name, q in quantiles.items():
        ranks[f"{name}_lo"] = F.floor(position(q)) + 1
        ranks[f"{name}_hi"] = F.ceil(position(q)) + 1
    held = F.lit(False)
    for r in ranks.values():
        held = held | ((r > F.col("_before")) & (r <= F.col("_before") + F.col("_n")))
    wanted = summary.filter(held).select(*group, "_b", "_before", "_total")
    near = keyed.join(F.broadcast(wanted), [*group, "_b"]) if few_keys or not keys else keyed.join(wanted.hint("merge"), [*group, "_b"])
    counted = near.groupBy(*group, "_b", "_before", "_total", "_v").agg(F.count("*").alias("_n"))
    inside = (Window.partitionBy(*group, "_b").orderBy("_v")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = counted.withColumn("_cum", F.col("_before") + F.sum("_n").over(inside))
    picked = counted.groupBy(*group).agg(F.first("_total").alias("_total"), *[
        F.min(F.when(F.col("_cum") >= r, F.col("_v"))).alias(n) for n, r in ranks.items()])
    out = [(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * (position(q) - F.floor(position(q)))).alias(n)
           for n, q in quantiles.items()]
    return picked.select(*keys, *out)
