"""Active-author selection.

The original runs an IN-subquery over (bridge ⋈ article) grouped by author plus a second identical join for
the article count. Both read the same join and group by the same key, so one aggregation computes the
total and both conditional counts; the HAVING becomes a filter and the author names join last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_authors(articles: DataFrame, bridge: DataFrame, authors: DataFrame, opinion: str = "opinion",
                   us: str = "us", politics: str = "politics", threshold: int = 2) -> DataFrame:
    """(id, name, total_articles) of authors with ≥ threshold articles whose section equals ``opinion``
    (case-sensitive) or ≥ threshold whose lower-cased section/subsection equal ``us``/``politics``.
    ``total_articles`` counts all of the author's articles in any section."""
    art = articles.select(F.col("id").alias("article_id"), "section", "subsection")
    per_author = (bridge.select("article_id", "author_id").join(art, "article_id")
                  .groupBy("author_id")
                  .agg(F.count(F.lit(1)).alias("total_articles"),
                       F.count_if(F.col("section") == opinion).alias("n_opinion"),
                       F.count_if((F.lower(F.col("section")) == us.lower())
                                  & (F.lower(F.col("subsection")) == politics.lower())).alias("n_us_politics")))
    qualified = per_author.where((F.col("n_opinion") >= threshold) | (F.col("n_us_politics") >= threshold))
    return (authors.select("id", "name")
            .join(qualified, F.col("id") == F.col("author_id"))
            .select("id", "name", F.col("total_articles").cast("long").alias("total_articles")))


def order_active_authors(df: DataFrame) -> DataFrame:
    """Total desc, name asc (id as the final tie-break for a total order)."""
    return df.orderBy(F.col("total_articles").desc(), F.col("name").asc(), F.col("id").asc())
