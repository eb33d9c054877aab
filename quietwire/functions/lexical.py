"""Character statistics of names and texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def text_entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text.

    Occurrences are counted by removing a character and comparing lengths, so the
    cost is the text length times its alphabet; meant for short strings.
    """
    n = F.length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")),
                         lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    total = F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(n > 0, total).otherwise(0.0)


@F.pandas_udf(DoubleType())
def long_text_entropy(texts: pd.Series) -> pd.Series:
    """B20 for texts of any length: one counting pass over the code points of each."""
    def entropy(text: str | None) -> float | None:
        if text is None:
            return None
        counts = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)[1]
        shares = counts / max(1, counts.sum())
        return float(-(shares * np.log2(shares)).sum()) + 0.0

    return texts.map(entropy)


def labels_of(name: Column) -> Column:
    return F.when(F.length(name) > 0, F.split(name, "[.]")).otherwise(F.expr("cast(array() as array<string>)"))


def name_statistics(name: Column) -> Column:
    """Lexical scalars of a DNS name as one struct."""
    labels = labels_of(name)
    text = F.array_join(labels, "")
    size = F.greatest(F.length(text), F.lit(1))
    stats = F.transform(labels, lambda x: F.struct(F.length(x).alias("length"), text_entropy(x).alias("entropy")))
    none = F.lit(0)

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / size

    return F.struct(
        F.length(name).alias("qname_length"), F.size(labels).alias("label_count"),
        F.coalesce(F.array_max(F.transform(labels, lambda x: F.length(x))), none).alias("longest_label"),
        text_entropy(text).alias("character_entropy"),
        F.coalesce(F.array_max(F.transform(stats, lambda x: x.entropy)), F.lit(0.0)).alias("max_label_entropy"),
        share("[0-9]").alias("digit_ratio"), share("[a-zA-Z]").alias("alphabetic_ratio"),
        share("[0-9a-f]").alias("hexadecimal_ratio"),
        F.size(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))).alias("unique_characters"),
        (F.size(labels) - F.size(F.array_distinct(labels))).alias("repeated_labels"),
        F.greatest(none, F.size(labels) - 2).alias("subdomain_depth_proxy"), stats.alias("label_statistics"))


def parent_name(name: Column) -> Column:
    """The last two labels; not aware of public suffixes."""
    return F.substring_index(name, ".", -2)
