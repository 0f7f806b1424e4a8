"""Labelled entries (P10, P11, F15) and per-token label rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entry_id():
    """deterministic replacement of the random 7-character entry id."""
    return F.substring(F.sha2(F.concat_ws("#", F.col("uri"), F.col("url_ord").cast("string")), 256), 1, 16)


def labelled_entries(matches: DataFrame, dedupe_articles: bool = False) -> DataFrame:
    """One emission per matched (post, link) with a non-empty token list (P10).

    Two spellings of one article in a post label it twice, as in the original (raw-string dedupe, D2).
    ``dedupe_articles=True`` keeps only the first link per (post, article) instead — a partial aggregate
    on (uri, article_id), then a semi-join on the kept positions.
    """
    if dedupe_articles:
        firsts = matches.groupBy("uri", "article_id").agg(F.min("url_ord").alias("url_ord"))
        matches = matches.join(firsts, ["uri", "article_id", "url_ord"], "left_semi")
    return (matches.where(F.size("tokens") > 0)
            .select(entry_id().alias("entry_id"), "uri", "author_did", "ts", "text", "url_ord", "url",
                    "article_id", "title", F.col("tokens").alias("labels")))


def label_rows(entries: DataFrame) -> DataFrame:
    """One row per token, keeping its position in the entry."""
    return entries.select("uri", "author_did", "ts", "url_ord", "article_id",
                          F.posexplode("labels").alias("token_ord", "val"))
