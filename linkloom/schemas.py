"""Explicit schemas (no inference anywhere)."""

from pyspark.sql import types as T

# Fixed protocol identifiers of the post stream (AT Protocol lexicon names).
POST_COLLECTION = "app.bsky.feed.post"
EMBED_EXTERNAL = "app.bsky.embed.external"
FACET_LINK = "app.bsky.richtext.facet#link"
FACET_MENTION = "app.bsky.richtext.facet#mention"
LIKE_COLLECTION = "app.bsky.feed.like"
LABELER_SERVICE = "app.bsky.labeler.service"

FEATURE = T.StructType([
    T.StructField("$type", T.StringType()),
    T.StructField("uri", T.StringType()),
    T.StructField("did", T.StringType()),
])

RECORD = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("embed", T.StructType([
        T.StructField("$type", T.StringType()),
        T.StructField("external", T.StructType([
            T.StructField("uri", T.StringType()),
            T.StructField("title", T.StringType()),
        ])),
    ])),
    T.StructField("facets", T.ArrayType(T.StructType([
        T.StructField("features", T.ArrayType(FEATURE)),
    ]))),
])

COMMIT = T.StructType([
    T.StructField("collection", T.StringType()),
    T.StructField("operation", T.StringType()),
    T.StructField("rkey", T.StringType()),
    T.StructField("record", RECORD),
])

# Envelope of one stream message. ``time_us`` is the event time (the original app used its wall clock).
ENVELOPE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("did", T.StringType()),
    T.StructField("time_us", T.LongType()),
    T.StructField("commit", COMMIT),
    T.StructField("_corrupt_record", T.StringType()),
])

ARTICLE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("section", T.StringType()),
    T.StructField("subsection", T.StringType()),
    T.StructField("title", T.StringType()),
])

AUTHOR = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
])

BRIDGE = T.StructType([
    T.StructField("article_id", T.LongType(), False),
    T.StructField("author_id", T.LongType(), False),
])

LABEL = T.StructType([
    T.StructField("environment", T.StringType(), False),
    T.StructField("id", T.LongType(), False),
    T.StructField("src", T.StringType(), False),
    T.StructField("uri", T.StringType(), False),
    T.StructField("cid", T.StringType()),
    T.StructField("val", T.StringType(), False),
    T.StructField("neg", T.BooleanType()),
    T.StructField("cts", T.TimestampType(), False),
    T.StructField("exp", T.TimestampType()),
    T.StructField("sig", T.BinaryType()),
])

SETTING = T.StructType([
    T.StructField("environment", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), False),
])

