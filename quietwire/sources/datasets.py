"""Public flow tables and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwire import schema as S
from quietwire.operators import detect as D


def read_with_scenario(spark: SparkSession, folder: str) -> DataFrame:
    """All parquet files of a folder; the scenario is the file name without its suffixes."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"(-no-metadata)?\.parquet$", "")
    frame = spark.read.option("pathGlobFilter", "*.parquet").parquet(folder)
    return frame.withColumn("scenario", name)


def load_cic(spark: SparkSession, folder: str) -> DataFrame:
    """Features, label and scenario of a CIC flow table."""
    rows = read_with_scenario(spark, folder)
    return D.mapped(rows, D.cic_features(), D.canonical_label(F.col("Label"), S.CIC_LABELS).alias("label"), F.col("scenario"))


def load_unsw(spark: SparkSession, folder: str) -> DataFrame:
    """The two latin-1 CSV files, partition name as scenario."""
    typed = ("dur double, spkts double, dpkts double, sbytes double, dbytes double, rate double, sinpkt double, "
             "dinpkt double, proto string, attack_cat string, label int")
    wanted = [part.split()[0] for part in typed.split(", ")]
    casts = dict(part.split() for part in typed.split(", "))

    def part(name: str, scenario: str) -> DataFrame:
        raw = (spark.read.option("header", True).option("encoding", "ISO-8859-1")
               .option("pathGlobFilter", f"UNSW_NB15_{name}-set.csv").csv(folder))
        return raw.select(*[F.col(c).try_cast(casts[c]).alias(c) for c in wanted], F.lit(scenario).alias("scenario"))

    rows = part("training", "train").unionByName(part("testing", "test"))
    return D.mapped(rows, D.unsw_features(), D.canonical_label(D.unsw_raw_label(), S.UNSW_LABELS).alias("label"), F.col("scenario"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON text per line."""
    documents.select("document").write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report table as CSV with a header."""
    report.write.mode("overwrite").option("header", True).csv(path)
