"""Distinct sections and subsections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_category


def distinct_categories(articles: DataFrame) -> DataFrame:
    """(family, ord, name): distinct non-empty values in ascending (binary) order with ``us`` in any case
    folded to ``US``; a folded value sits where its first raw spelling sat.

    Both families come from one scan: each article row is stacked into (family, raw) pairs and reduced by
    a hash distinct (partial+final, combined map-side). Only the few distinct values reach the fold/min
    step (``min`` over strings is sort-based) and the ordered array.
    """
    stacked = articles.select(F.inline(F.array(
        F.struct(F.lit("section").alias("family"), F.col("section").alias("raw")),
        F.struct(F.lit("subsection").alias("family"), F.col("subsection").alias("raw")))))
    kept = stacked.where(F.col("raw").isNotNull() & (F.col("raw") != "")).distinct()
    grouped = (kept.groupBy("family", fold_category(F.col("raw")).alias("name"))
               .agg(F.min("raw").alias("first_raw")))
    # the few distinct names of a family, in order, as one array: its places are the numbers
    ordered = grouped.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("first_raw", "name"))).alias("names"))
    return (ordered.select("family", F.posexplode("names").alias("place", "n"))
            .select("family", (F.col("place") + 1).cast("long").alias("ord"), F.col("n.name").alias("name")))
