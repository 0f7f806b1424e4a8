"""Label taxonomy (U1, W1, F4, F5), the service record document (S9, A10) and universe counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import display_name, slugify
from ..schemas import LABELER_SERVICE, POST_COLLECTION

DEFAULT_PUBLISHER = "Example News"
# Fixed values of every label definition.
SEVERITY, BLURS, DEFAULT_SETTING, LANG = "inform", "none", "warn", "en"

# The locale texts in ``_candidates`` ("… Section", "Articles in the … section of …", "Articles authored by …") are fixed values, too.
_ORDER = ["src_rank", "k_num", "k_str", "k_id"]


def _candidates(categories: DataFrame, authors: DataFrame, publisher: str) -> DataFrame:
    cats = categories.select("family", "ord", "name")
    shown = display_name(F.col("name"))
    sections = cats.where(F.col("family") == "section").select(
        F.lit(0).alias("src_rank"), F.col("ord").cast("long").alias("k_num"), F.lit("").alias("k_str"),
        F.lit(0).cast("long").alias("k_id"), F.lit("section").alias("family"),
        slugify(F.col("name")).alias("identifier"),
        F.concat(shown, F.lit(" Section")).alias("locale_name"),
        F.concat(F.lit("Articles in the "), shown, F.lit(f" section of {publisher}")).alias("description"))
    subsections = cats.where(F.col("family") == "subsection").select(
        F.lit(1).alias("src_rank"), F.col("ord").cast("long").alias("k_num"), F.lit("").alias("k_str"),
        F.lit(0).cast("long").alias("k_id"), F.lit("subsection").alias("family"),
        slugify(F.col("name")).alias("identifier"),
        F.concat(shown, F.lit(" Subsection")).alias("locale_name"),
        F.concat(F.lit("Articles in the "), shown, F.lit(f" subsection of {publisher}")).alias("description"))
    people = authors.select(
        F.lit(2).alias("src_rank"), (-F.col("total_articles")).cast("long").alias("k_num"),
        F.col("name").alias("k_str"), F.col("id").cast("long").alias("k_id"), F.lit("author").alias("family"),
        slugify(F.col("name")).alias("identifier"), F.col("name").alias("locale_name"),
        F.concat(F.lit("Articles authored by "), F.col("name"), F.lit(f" for {publisher}")).alias("description"))
    return sections.unionByName(subsections).unionByName(people)


def taxonomy_definitions(categories: DataFrame, active_authors: DataFrame, publisher: str = DEFAULT_PUBLISHER
                         ) -> DataFrame:
    """Sections, then subsections, then active authors (total desc, name asc); an identifier registered
    earlier wins and empty identifiers are skipped (W1). ``position`` is the registration order."""
    cand = _candidates(categories, active_authors, publisher).where(F.col("identifier") != "")
    # first registration per identifier: min over (registration order, payload) — a partial aggregate, so an
    # identifier shared by many authors is combined map-side rather than gathered into one window task
    payload = ["family", "locale_name", "description"]
    first = (cand.groupBy("identifier")
             .agg(F.min(F.struct(*[F.col(c) for c in _ORDER + payload])).alias("_f")))
    kept = first.select("identifier", *[F.col(f"_f.{c}").alias(c) for c in _ORDER + payload])
    # one small sort: a taxonomy has a row per category and active author, not per article or post
    numbered = kept.withColumn("position", F.row_number().over(Window.orderBy(*_ORDER)).cast("long"))
    return numbered.select("position", "identifier", "family", "locale_name", "description", *_ORDER,
                           F.lit(SEVERITY).alias("severity"), F.lit(BLURS).alias("blurs"),
                           F.lit(DEFAULT_SETTING).alias("default_setting"), F.lit(LANG).alias("lang"))


def service_record(definitions: DataFrame, created_at: str) -> DataFrame:
    """One JSON document listing every label value and definition in registration order.

    The document is the feature, so its definitions are gathered into one row; their number is bounded by
    the taxonomy (categories + active authors), not by the post volume. At some 300 bytes a definition, Spark's 2 GB
    a row hold about seven million of them.
    """
    entry = F.struct(
        F.col("position"),
        F.col("identifier"),
        F.struct(F.col("identifier").alias("identifier"), F.col("severity").alias("severity"),
                 F.col("blurs").alias("blurs"), F.col("default_setting").alias("defaultSetting"),
                 F.array(F.struct(F.col("lang").alias("lang"), F.col("locale_name").alias("name"),
                                  F.col("description").alias("description"))).alias("locales")).alias("d"))
    gathered = definitions.agg(F.sort_array(F.collect_list(entry)).alias("e"))
    doc = F.struct(
        F.lit(LABELER_SERVICE).alias("$type"),
        F.struct(F.transform("e", lambda x: x["identifier"]).alias("labelValues"),
                 F.transform("e", lambda x: x["d"]).alias("labelValueDefinitions")).alias("policies"),
        F.array(F.lit("record")).alias("subjectTypes"),
        F.array(F.lit(POST_COLLECTION)).alias("subjectCollections"),
        F.lit(created_at).alias("createdAt"))
    return gathered.select(F.to_json(doc).alias("record"), F.size("e").cast("long").alias("n_definitions"))


def universe_counts(categories: DataFrame, active_authors: DataFrame) -> DataFrame:
    """Number of active authors, sections and subsections as (family, n) rows."""
    cats = categories.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    people = active_authors.agg(F.count(F.lit(1)).alias("n")).select(F.lit("author").alias("family"), "n")
    return cats.unionByName(people).select("family", F.col("n").cast("long").alias("n"))
