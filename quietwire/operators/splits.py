"""Dataset splits, folds and samples.

Pseudo-random orders are hashes of the identity and a seed: the same rows are
chosen whatever the partitioning, and again after a task is retried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwire.operators.clock import rows_at_ranks, tick, with_scalars


def shuffled(identity: Column, seed: int) -> Column:
    """Sort key that stands in for a seeded shuffle."""
    return F.md5(F.concat(identity.cast("string"), F.lit(f"#{seed}")))


def scenario_split(rows: DataFrame, scenario: str = "scenario", train: float = 0.7, val: float = 0.15,
                   seed: int = 42) -> DataFrame:
    """L1: whole scenarios go to train, validation or test; one row per scenario."""
    names = rows.select(scenario).distinct()
    order = Window.partitionBy(F.lit(0)).orderBy(shuffled(F.col(scenario), seed), scenario)  # one row per scenario
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    n_train = F.greatest(F.lit(1), F.floor(n * train))
    n_val = F.floor(n * val)
    n_val = F.when(n_train + n_val >= n, F.greatest(F.lit(0), n - n_train - 1)).otherwise(n_val)
    place = F.row_number().over(order)
    return names.select(scenario, F.when(place <= n_train, "train")
                        .when(place <= n_train + n_val, "validation").otherwise("test").alias("split"))


def assign(rows: DataFrame, manifest: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Rows with the split their scenario is assigned to.  A manifest names scenarios, not rows."""
    return rows.join(F.broadcast(manifest), scenario)


def manifest_problems(rows: DataFrame, manifest: DataFrame, expected: DataFrame | None = None,
                      scenario: str = "scenario") -> DataFrame:
    """Scenarios that are missing, unknown or assigned twice, and wrong row counts."""
    seen = rows.groupBy(scenario).agg(F.count("*").alias("rows"))
    listed = manifest.groupBy(scenario).agg(F.count("*").alias("times"), F.first("split").alias("split"))
    both = seen.join(listed, scenario, "full_outer")
    problem = (F.when(F.col("times").isNull(), "unassigned").when(F.col("rows").isNull(), "not observed")
                .when(F.col("times") > 1, "assigned more than once"))
    out = both.withColumn("problem", problem).filter("problem is not null").select(
        F.col(scenario).alias("subject"), "problem")
    if expected is not None:
        counts = both.groupBy("split").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
        wrong = expected.join(counts, "split", "left").filter(
            F.coalesce("rows", F.lit(0)) != F.col("expected_rows"))
        out = out.unionByName(wrong.select(F.col("split").alias("subject"), F.lit("row count differs").alias("problem")))
    return out


def split_overlap(rows: DataFrame, identity: str, split: str = "split") -> DataFrame:
    """Identities that occur in more than one split, counted per pair of splits."""
    per = rows.groupBy(identity).agg(F.array_sort(F.collect_set(split)).alias("splits"))  # at most three values
    return (per.filter(F.size("splits") > 1).groupBy(F.array_join("splits", "+").alias("splits"))
            .agg(F.count("*").alias("identities")))


def temporal_split(rows: DataFrame, ts: str, tie: str, bucket_sec: float, train: float = 0.7,
                   val: float = 0.15) -> DataFrame:
    """L3: the earliest rows train, the latest test.  Only the two buckets with the cuts are ordered."""
    n_train, n_val = F.floor(F.col("n") * train), F.floor(F.col("n") * val)
    cuts = rows_at_ranks(rows, tick(F.col(ts), bucket_sec), [ts, tie], {"_cut_train": n_train, "_cut_val": n_train + n_val})
    place = F.struct(ts, tie)
    split = F.when(place <= F.col("_cut_train"), "train").when(place <= F.col("_cut_val"), "validation").otherwise("test")
    return with_scalars(rows, cuts).withColumn("split", split).drop("_cut_train", "_cut_val")


def provenance(rows: DataFrame, split: str = "split", scenario: str = "scenario") -> DataFrame:
    """L4: rows and scenario list of every split."""
    per = rows.groupBy(split, scenario).agg(F.count("*").alias("n"))
    return per.groupBy(split).agg(F.sum("n").alias("rows"), F.count("*").alias("scenarios"),
                                  F.array_join(F.array_sort(F.collect_list(scenario)), ";").alias("scenario_list"))


def uniform_sample(rows: DataFrame, identity: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows without replacement.

    The hash prefix cuts the order into 65,536 even buckets; only the one with the
    cut is ordered, all other rows are compared with it.
    """
    marked = rows.withColumn("_hash", shuffled(F.col(identity), seed))
    bucket = F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int")
    cut = rows_at_ranks(marked, bucket, ["_hash", identity], {"_cut": F.least(F.lit(n), F.col("n"))})
    return with_scalars(marked, cut).filter(F.struct("_hash", identity) <= F.col("_cut")).drop("_hash", "_cut")


def stratified_sample(rows: DataFrame, label: str, identity: str, n: int, seed: int = 42) -> DataFrame:
    """at most ``n`` rows of each label; the cut happens before the shuffle."""
    place = Window.partitionBy(label).orderBy(shuffled(F.col(identity), seed), identity)
    return rows.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= n).drop("_place")


def families(rows: DataFrame, label: str, benign: str) -> DataFrame:
    """G5."""
    return rows.select(label).distinct().filter(F.col(label) != benign)


def family_folds(rows: DataFrame, label: str = "y", scenario: str = "scenario", benign: str = "benign",
                 minimum: int = 50, val: float = 0.15, seed: int = 42) -> DataFrame:
    """For every family the split of each scenario when that family is held out.

    All scenarios that contain the family are its test set.  Everything is built
    from the (scenario, label) counts.  Columns: family, scenario, split.
    """
    counts = rows.groupBy(scenario, label).agg(F.count("*").alias("n"))
    eligible = (counts.filter(F.col(label) != benign).groupBy(F.col(label).alias("family"))
                .agg(F.sum("n").alias("n")).filter(F.col("n") >= minimum))
    held = counts.groupBy(scenario).agg(F.collect_set(label).alias("labels"))
    every = with_scalars(held, eligible.agg(F.collect_list("family").alias("families")))
    grid = every.select(scenario, F.explode("families").alias("family"), "labels").withColumn(
        "is_test", F.expr("array_contains(labels, family)"))
    rest = Window.partitionBy("family", "is_test")
    place = F.row_number().over(rest.orderBy(shuffled(F.col(scenario), seed), scenario))
    n_val = F.greatest(F.lit(1), F.bround(F.count("*").over(rest) * F.lit(val)).cast("int"))
    split = F.when(F.col("is_test"), "test").when(place <= n_val, "validation").otherwise("train")
    return grid.select("family", scenario, split.alias("split"))


def fold_counts(rows: DataFrame, folds: DataFrame, label: str = "y", scenario: str = "scenario",
                benign: str = "benign") -> DataFrame:
    """Rows, attack share and absence of the held-out family per fold and split."""
    counts = rows.groupBy(scenario, label).agg(F.count("*").alias("n"))
    joined = counts.join(folds, scenario)
    return joined.groupBy("family", "split").agg(
        F.sum("n").alias("rows"),
        (F.sum(F.when(F.col(label) != benign, F.col("n")).otherwise(0)) / F.sum("n")).alias("prevalence"),
        F.coalesce(F.sum(F.when(F.col(label) == F.col("family"), F.col("n"))), F.lit(0)).alias("family_rows"))


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """G1: union by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
