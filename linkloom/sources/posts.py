"""Post-stream source (S1), malformed-record split (S2) and the commit/create filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ENVELOPE, POST_COLLECTION

JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def parse_messages(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Parse one JSON message per row with an explicit schema.

    Wrongly-typed fields become NULL (the row survives, like the original's per-field guards). A row is
    *malformed* only when the text is not exactly one JSON value (trailing text included).
    The parse and the test for one value run inside a one-row ``inline`` generator: later filters on the parsed fields stay above
    the generator instead of being pushed below it with further copies of both.
    """
    raw = F.col(value_col)
    env = F.from_json(raw, ENVELOPE, JSON_OPTIONS)
    # the parsers stop behind the first value; inside brackets, whatever follows it makes the whole invalid or longer
    alone = F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1
    closed = ~raw.contains("]") | (F.size(F.json_object_keys(F.concat(F.lit('{"x":'), raw, F.lit("}")))) == 1)
    malformed = ~F.coalesce(alone & closed, F.lit(False))
    flagged = lines.select(F.inline(F.array(F.struct(raw.alias("raw"), malformed.alias("malformed"), env.alias("m")))))
    fields = ("kind", "did", "time_us", "commit")
    return flagged.select("raw", "malformed", *[F.when(~F.col("malformed"), F.col(f"m.{f}")).alias(f) for f in fields])


def read_message_files(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of newline-delimited JSON messages (text lines, parsed by :func:`parse_messages`)."""
    return spark.read.text(path)


def well_formed(messages: DataFrame) -> DataFrame:
    return messages.where(~F.col("malformed"))


def dead_letters(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("malformed")).select("raw")


def is_processed(collection: str = POST_COLLECTION) -> Column:
    """kind = commit, commit present, collection = wanted. This population is 'posts processed'."""
    return F.coalesce((F.col("kind") == "commit") & F.col("commit").isNotNull()
                      & (F.col("commit.collection") == collection), F.lit(False))


def is_create() -> Column:
    """operation = create and a record is present."""
    return F.coalesce((F.col("commit.operation") == "create") & F.col("commit.record").isNotNull(), F.lit(False))


def post_uri(collection: str = POST_COLLECTION) -> Column:
    """``at://{did}/{collection}/{rkey}`` (a missing part prints as ``undefined``)."""
    return F.concat(F.lit("at://"), F.coalesce(F.col("did"), F.lit("undefined")), F.lit(f"/{collection}/"),
                    F.coalesce(F.col("commit.rkey"), F.lit("undefined")))


def event_time() -> Column:
    return F.timestamp_micros(F.col("time_us"))


def commit_posts(messages: DataFrame, collection: str = POST_COLLECTION) -> DataFrame:
    """Processed commits with their post URI, event time and create flag."""
    return (well_formed(messages)
            .where(is_processed(collection))
            .select(post_uri(collection).alias("uri"),
                    F.col("did").alias("author_did"),
                    event_time().alias("ts"),
                    F.col("commit.operation").alias("operation"),
                    is_create().alias("is_create"),
                    F.col("commit.record").alias("record")))


def posts_from_lines(lines: DataFrame, collection: str = POST_COLLECTION) -> DataFrame:
    return commit_posts(parse_messages(lines), collection)

