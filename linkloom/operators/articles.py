"""Article ⟕ bridge ⟕ author lookup (J1, A1, P4, P6), the pre-aggregated label dimension and the link
match (J2, J6).

The label dimension is built once per snapshot: one row per stored article URL carrying the ordered label
tokens, so labelling a post is a single equi-join with no aggregation on the post side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..functions.urls import canonical_url, js_trim
from .joins import DEFAULT_BROADCAST_ROWS, broadcast_if_small

#: Rows without a link are dealt over so many join keys.
NULL_KEYS = 1 << 20


def _empty():
    return F.array().cast("array<string>")


def named_authors(bridge: DataFrame, authors: DataFrame) -> DataFrame:
    """(article_id, author_id, name) for every non-blank author name of an article (J1 + P6)."""
    return (bridge.select("article_id", "author_id")
            .join(authors.select(F.col("id").alias("author_id"), "name"), "author_id")
            .where(F.col("name").isNotNull() & (js_trim(F.col("name")) != "")))


def _first_by_author(extra: list[str]):
    """Per article: entries ordered by author id, deduplicated by name (the first author id of a name
    wins — the original's Set over names; its row order was unspecified, author id fixes it)."""
    fields = [F.col("author_id"), F.col("name")] + [F.col(c) for c in extra]
    ordered = F.sort_array(F.collect_list(F.struct(*fields)))
    return F.array_distinct(F.transform(ordered, lambda x: F.struct(x["name"].alias("name"),
                                                                     *[x[c].alias(c) for c in extra])))


def normalised_articles(articles: DataFrame) -> DataFrame:
    """Empty subsection/title become NULL (section is passed through unchanged)."""
    return articles.select(
        "id", "url", "section",
        F.nullif(F.col("subsection"), F.lit("")).alias("subsection"),
        F.nullif(F.col("title"), F.lit("")).alias("title"))


def article_lookup(articles: DataFrame, bridge: DataFrame, authors: DataFrame) -> DataFrame:
    """J1 + A1: one row per article with its ordered, deduplicated, non-blank author names.

    One aggregation per article (the name dedupe happens inside the collected, author-id-sorted array)."""
    per_article = (named_authors(bridge, authors).groupBy("article_id")
                   .agg(F.transform(_first_by_author([]), lambda x: x["name"]).alias("authors")))
    return (normalised_articles(articles)
            .join(per_article, F.col("id") == F.col("article_id"), "left")
            .select("id", "url", "section", "subsection", "title",
                    F.coalesce(F.col("authors"), _empty()).alias("authors")))


def active_slugs(active_authors: DataFrame) -> DataFrame:
    """The active-author slug set (J5); empty slugs never label anything. Used as the build side of a
    semi-join, so duplicates need no extra shuffle to remove."""
    return active_authors.select(slugify(F.col("name")).alias("slug")).where(F.col("slug") != "")


def label_dimension(articles: DataFrame, bridge: DataFrame, authors: DataFrame, slugs: DataFrame) -> DataFrame:
    """(url, article_id, title, tokens): tokens = [section?, subsection?, active authors…].

    Section is kept when non-empty, subsection when non-blank, authors when their slug is active. Empty
    tokens are dropped (a whitespace-only section would otherwise emit an empty label). The slug is a
    function of the name, so filtering by the active set before the per-article name dedupe is exact.
    """
    active = named_authors(bridge, authors).withColumn("slug", slugify(F.col("name"))).join(slugs, "slug",
                                                                                            "left_semi")
    author_tokens = active.groupBy("article_id").agg(
        F.transform(_first_by_author(["slug"]), lambda x: x["slug"]).alias("author_tokens"))
    arts = normalised_articles(articles)
    section_tok = F.when(F.col("section").isNotNull() & (F.col("section") != ""), slugify(F.col("section")))
    sub_tok = F.when(F.col("subsection").isNotNull() & (js_trim(F.col("subsection")) != ""),
                     slugify(F.col("subsection")))
    tokens = F.filter(F.concat(F.array(section_tok, sub_tok), F.coalesce(F.col("author_tokens"), _empty())),
                      lambda t: t.isNotNull() & (t != ""))
    return (arts.join(author_tokens, F.col("id") == F.col("article_id"), "left")
            .select("url", F.col("id").alias("article_id"), "title", "section", "subsection",
                    tokens.alias("tokens")))


def _probe(links: DataFrame) -> DataFrame:
    """Links carry their canonical form from extraction; compute it only for links that do not."""
    if "canonical_url" in links.columns:
        return links
    return links.withColumn("canonical_url", canonical_url("url"))


def match_links(links: DataFrame, dimension: DataFrame, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                how: str = "inner") -> DataFrame:
    """Equi-join of canonical(link) with the stored article URL (stored URLs are not re-normalised).
    ``how="left"`` keeps unmatched links (and link-less posts) with NULL article columns."""
    dim = broadcast_if_small(dimension.withColumnRenamed("url", "article_url"), max_broadcast_rows)
    probe = _probe(links)
    if how == "inner":
        return probe.join(dim, F.col("canonical_url") == F.col("article_url"), how)
    # posts without a link would all meet in one task of a shuffle join: their keys are spread, and match nothing
    spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64("uri"), F.lit(NULL_KEYS)).cast("string"))
    keyed = probe.withColumn("_key", F.coalesce("canonical_url", spread))
    return keyed.join(dim, F.col("_key") == F.col("article_url"), how).drop("_key")


def unmatched_links(links: DataFrame, dimension: DataFrame, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS
                    ) -> DataFrame:
    """Links with no article (left anti-join on the canonical URL)."""
    dim = broadcast_if_small(dimension.select(F.col("url").alias("article_url")), max_broadcast_rows)
    return _probe(links).join(dim, F.col("canonical_url") == F.col("article_url"), "left_anti")
