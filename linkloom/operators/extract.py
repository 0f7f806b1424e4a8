"""Link extraction (L1–L5): link cards, rich-text link facets and free-text matches of one domain.

All of it is array arithmetic inside the post row, so extraction never shuffles: the candidates of the three
carriers (card, then facets, then text matches) are parsed once, filtered by the domain predicate, rendered
canonically, deduplicated on the raw string (first occurrence wins) and exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import domain_link_pairs, filter_domain_urls, text_links
from ..schemas import EMBED_EXTERNAL, FACET_LINK

_FEATURE = "struct<`$type`:string,uri:string,did:string>"


def _empty():
    return F.array().cast("array<string>")


def card_candidates(record: Column) -> Column:
    """L1 before the domain test: the external-embed URI when the embed is a link card and the URI is set."""
    uri = record["embed"]["external"]["uri"]
    ok = (record["embed"]["$type"] == EMBED_EXTERNAL) & uri.isNotNull() & (uri != "")
    return F.when(F.coalesce(ok, F.lit(False)), F.array(uri)).otherwise(_empty())


def facet_candidates(record: Column) -> Column:
    """L2 before the domain test: URIs of link features across all facets, in order (mentions, tags and
    features without a URI are ignored)."""
    per_facet = F.transform(
        F.coalesce(record["facets"], F.array().cast(f"array<struct<features:array<{_FEATURE}>>>")),
        lambda f: F.transform(
            F.filter(F.coalesce(f["features"], F.array().cast(f"array<{_FEATURE}>")),
                     lambda x: (x["$type"] == FACET_LINK) & x["uri"].isNotNull() & (x["uri"] != "")),
            lambda x: x["uri"]))
    return F.flatten(per_facet)


def with_candidates(posts: DataFrame, domain: str, record_col: str = "record") -> DataFrame:
    """Add ``_cards``, ``_facets``, ``_texts`` (raw candidates per carrier) and ``_cand`` (their concat)."""
    rec = F.col(record_col)
    staged = posts.select("*", card_candidates(rec).alias("_cards"), facet_candidates(rec).alias("_facets"),
                          F.when(rec.isNotNull(), text_links(rec["text"], domain)).otherwise(_empty()).alias("_texts"))
    return staged.withColumn("_cand", F.concat("_cards", "_facets", "_texts"))


def with_links(posts: DataFrame, domain: str, record_col: str = "record") -> DataFrame:
    """Add ``links``: the ordered distinct domain URLs of each post (L4)."""
    staged = with_candidates(posts, domain, record_col)
    return (staged.withColumn("links", F.array_distinct(filter_domain_urls("_cand", domain)))
            .drop("_cards", "_facets", "_texts", "_cand"))


def extract_links(posts: DataFrame, domain: str, record_col: str = "record", keep_posts: bool = False) -> DataFrame:
    """One row per (post, distinct domain link) with its 0-based position, its canonical form (F1)
    and the carrier it was first seen in. The canonical URL comes out of the generator, so a join on it is
    computed once per link.

    ``keep_posts=True`` keeps every post: links are extracted from creates only, and a post without links
    stays as one row with NULL link columns (``posexplode_outer``), so per-post counters need no second pass.
    """
    if keep_posts:
        posts = posts.withColumn(record_col, F.when(F.col("is_create"), F.col(record_col)))
    staged = with_candidates(posts, domain, record_col)
    explode = F.posexplode_outer if keep_posts else F.posexplode
    exploded = staged.select("*", explode(domain_link_pairs("_cand", domain)).alias("url_ord", "_link"))
    url = F.col("_link.url")
    carrier = (F.when(F.array_contains("_cards", url), F.lit("card"))
               .when(F.array_contains("_facets", url), F.lit("facet"))
               .otherwise(F.lit("text")))
    return (exploded.select("*", url.alias("url"), F.col("_link.canonical_url").alias("canonical_url"),
                            carrier.alias("carrier"))
            .drop("_cards", "_facets", "_texts", "_cand", "_link"))
