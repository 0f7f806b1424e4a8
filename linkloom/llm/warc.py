"""Not-modified revisits of web archives.

A revisit record says that a page had not changed since an earlier capture. It is resolved by an as-of join: the
latest full response of the same canonical URL that is strictly earlier. The response counts only if the validators
agree (entity tags by weak comparison where both have one, else the modification dates, else the payload digests);
then the record gets the response's headers, updated by those header fields that a 304 answer may change, and
``with_bodies`` gives it the response's body.

The join carries neither bodies nor headers: (URL, time) of all records are range-sorted together, so that the captures of one
URL, however many, lie in several tasks (``operators/asof.py``). Records are numbered in a table first and go by that
number, not by their ids. Bodies are fetched at the end, of the responses that are needed.

Defined cases: no earlier response: ``no_response``; validators that disagree, or none to compare: ``mismatch``; null
URLs, times or types take no part as responses, and revisits without URL or time stay unresolved; of responses equal
in URL and time the one with the highest record id is the latest, of those with one id any one of the latest; ids may be of any
type that can be sorted, null among them, and may be repeated: every revisit record gives one row; null headers are empty; header names are
compared in lower case; responses equal in id, URL, time and digest are one capture when bodies are fetched; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import fresh, table, written
from linkloom.operators.asof import asof_join

# Header fields that a 304 (Not Modified) answer carries over to the stored response.
UPDATED_BY_304 = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, default port, www or mobile prefix, tracking parameters and closing slash; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www[0-9]*|m)\.", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    rest = F.regexp_replace(rest, r"([?&])(utm_[a-z]+|ref)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"&&+", "&"), r"\?&+", "?"), r"[?&]+$", "")
    return F.concat(host, F.regexp_replace(rest, r"/+$", ""))


def _lower_keys(headers: Column) -> Column:
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    # of names equal but for case, the last one in order of the original names counts
    put = lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != F.lower(e["key"])), F.map_from_arrays(F.array(F.lower(e["key"])), F.array(e["value"])))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), put)


def merged_headers(stored: Column, answer: Column) -> Column:
    allowed = F.map_filter(_lower_keys(answer), lambda k, v: k.isin(*UPDATED_BY_304))
    return F.map_concat(F.map_filter(_lower_keys(stored), lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records``: record_id, url, ts (seconds), type ('response' or 'revisit'), etag, last_modified, digest, headers.
    One row per revisit: record_id, url_key, ts, response_id, response_ts, response_digest, age, status, headers (merged; null unless resolved)."""
    own = records.select("record_id", canonical_url(F.col("url").cast("string")).alias("key"), F.col("ts").cast("long").alias("ts"), F.col("type").alias("kind"),
                         "etag", "last_modified", "digest", "headers")
    own = written(own.withColumn("row", F.monotonically_increasing_id()), "warc-records")
    usable = F.col("key").isNotNull() & F.col("ts").isNotNull()
    full = own.where(usable & (F.col("kind") == "response"))
    asked = own.where(F.col("kind") == "revisit")

    # strictly earlier: a response holds from the second after it
    behind = full.select("key", (F.col("ts") + 1).alias("since"), F.struct("record_id", "row").alias("rank"), F.col("row").alias("response_row"))
    met = asof_join(asked.where(usable).select("row", "key", "ts"), behind, "key", "ts", "since", "rank")
    found = met.where("found IS NOT NULL").select(F.col("row").alias("f_row"), F.col("found.response_row").alias("response_row"))

    stored = full.select(F.col("row").alias("response_row"), F.col("record_id").alias("response_id"), F.col("ts").alias("response_ts"), F.col("etag").alias("r_etag"),
                         F.col("last_modified").alias("r_modified"), F.col("digest").alias("r_digest"), F.col("headers").alias("r_headers"))
    weak = lambda c: F.regexp_replace(c, r"^W/", "")
    agrees = (F.when(F.col("etag").isNotNull() & F.col("r_etag").isNotNull(), weak(F.col("etag")) == weak(F.col("r_etag")))
              .when(F.col("last_modified").isNotNull() & F.col("r_modified").isNotNull(), F.col("last_modified") == F.col("r_modified"))
              .when(F.col("digest").isNotNull() & F.col("r_digest").isNotNull(), F.col("digest") == F.col("r_digest")).otherwise(False))
    joined = asked.join(found, asked["row"] == found["f_row"], "left").join(stored, "response_row", "left")
    status = F.when(F.col("response_row").isNull(), "no_response").when(agrees, "resolved").otherwise("mismatch")
    return joined.select("record_id", F.col("key").alias("url_key"), "ts", "response_id", "response_ts", F.col("r_digest").alias("response_digest"),
                         (F.col("ts") - F.col("response_ts")).alias("age"), status.alias("status"),
                         F.when(status == "resolved", merged_headers(F.col("r_headers"), F.col("headers"))).alias("headers"))


def with_bodies(resolved: DataFrame, records: DataFrame, body_col: str = "body") -> DataFrame:
    """The rows of ``resolve_revisits`` with ``body_col`` of their responses (null unless resolved). Bodies are moved once, and once more only where a
    capture is there several times; a caller that needs something made of the bodies makes it first and names that column."""
    names = ["response_id", "url_key", "response_ts", "response_digest"]
    keys = [fresh(n) for n in names]
    found = [F.col("record_id"), canonical_url(F.col("url").cast("string")), F.col("ts").cast("long"), F.col("digest")]
    own = records.where(F.col("type") == "response").select(*[c.alias(k) for c, k in zip(found, keys)], F.col(body_col))
    if own.groupBy(*keys).count().where("count > 1").head(1):
        own = own.dropDuplicates(keys)
    same = resolved["status"] == "resolved"
    for name, key in zip(names, keys):
        same = same & resolved[name].eqNullSafe(own[key])
    return resolved.join(own, same, "left").select(*resolved.columns, body_col)


def header_lines(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")


def page_records(pages: DataFrame) -> DataFrame:
    """Archive records that the ``pages`` table stands for, with WARC's own kind of ids. A page is captured once to three times, a day apart, the
    first one minute after the page with the id below; the third capture has another body. It is asked for again by another spelling of
    its URL after 30 hours, every third page also after 55 hours by the validators of the first capture, and every seventh
    before it was ever captured. One answer in five has a stale entity tag, one in four none."""
    pid = F.col("page_id")
    stamp = lambda t: F.concat(F.lit("@"), t.cast("string"))  # noqa: E731  seconds, whatever the session's time zone
    name = lambda part: F.concat(F.lit("urn:page:"), pid.cast("string"), F.lit(":"), part)
    first = pid * 60
    body = lambda version: F.concat(F.col("html"), F.lit("<!-- "), version.cast("string"), F.lit(" -->"))
    tag_of = lambda digest: F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))

    captures = pages.select("page_id", "url", "html", F.explode(F.sequence(F.lit(0), F.pmod(pid, F.lit(3)).cast("int"))).alias("k"))
    captures = captures.select("page_id", "url", "k", body((F.col("k") / 2).cast("int")).alias("body"), (first + F.col("k") * 86400).alias("ts"))
    captures = captures.withColumn("digest", F.sha2("body", 256)).withColumn("tag", tag_of(F.col("digest")))
    response = captures.select(name(F.concat(F.lit("c"), F.col("k").cast("string"))).alias("record_id"), "url", "ts", F.lit("response").alias("type"), F.col("tag").alias("etag"),
                               stamp(first + F.when(F.col("k") == 2, 172800).otherwise(0)).alias("last_modified"), "digest",
                               F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("body").cast("string"), F.lit("Date"), stamp(F.col("ts")),
                                            F.lit("ETag"), F.col("tag")).alias("headers"), "body")
    asks = F.array_compact(F.array(F.struct(F.lit("r0").alias("part"), F.lit(108000).alias("after")), F.when(pid % 3 == 2, F.struct(F.lit("r1").alias("part"), F.lit(200000).alias("after"))),
                                   F.when(pid % 7 == 0, F.struct(F.lit("r2").alias("part"), F.lit(-30).alias("after")))))
    again = pages.select("page_id", "url", F.sha2(body(F.lit(0)), 256).alias("digest"), F.explode(asks).alias("ask"))
    asked = F.when(pid % 5 == 0, F.lit('"stale"')).when(pid % 4 != 0, F.concat(F.lit("W/"), tag_of(F.col("digest"))))
    later = first + F.col("ask.after")
    dated = F.when(pid % 8 == 4, stamp(first + F.when(F.col("ask.part") == "r1", 172800).otherwise(0)))
    revisit = again.select(name(F.col("ask.part")).alias("record_id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"), later.alias("ts"), F.lit("revisit").alias("type"),
                           asked.alias("etag"), dated.alias("last_modified"), "digest",
                           F.map_filter(F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Date"), stamp(later), F.lit("etag"), asked), lambda k, v: v.isNotNull()).alias("headers"),
                           F.lit(None).cast("string").alias("body"))
    return response.unionByName(revisit)


def resolved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = page_records(table(spark, sf_dir, "pages"))
    # of the bodies only their sums are asked for, so only those are moved
    found = with_bodies(resolve_revisits(records), records.withColumn("body_sha256", F.sha2("body", 256)), "body_sha256")
    return found.select("record_id", "url_key", "ts", "response_id", "response_ts", "age", "status", F.sha2(header_lines(F.col("headers")), 256).alias("headers_sha256"),
                        "body_sha256")


ORACLE = r"""
WITH c AS (
  SELECT page_id, url, html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
p AS (
  SELECT page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www[0-9]*|m)\.', '')
         || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '^[^/?]*', ''),
            '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&+', '?', 'g'), '[?&]+$', ''), '/+$', '') AS key FROM c),
r AS (
  SELECT 'urn:page:' || page_id || ':c' || k AS response_id, key, page_id * 60 + k * 86400 AS response_ts, sha256(body) AS digest, octet_length(encode(body)) AS bytes,
         '@' || (page_id * 60 + CASE WHEN k = 2 THEN 172800 ELSE 0 END) AS modified
  FROM (SELECT page_id, key, k, html || '<!-- ' || (k // 2) || ' -->' AS body FROM p, range(0, 3) t(k) WHERE k <= page_id % 3)),
latest AS (SELECT key, response_ts, max(response_id) AS response_id FROM r GROUP BY ALL),
q AS (
  SELECT 'urn:page:' || page_id || ':' || part AS record_id, key, page_id * 60 + later AS ts, sha256(html || '<!-- 0 -->') AS own_digest,
         CASE WHEN page_id % 5 = 0 THEN '"stale"' WHEN page_id % 4 <> 0 THEN 'W/"' || substr(sha256(html || '<!-- 0 -->'), 1, 16) || '"' END AS asked,
         CASE WHEN page_id % 8 = 4 THEN '@' || (page_id * 60 + CASE WHEN part = 'r1' THEN 172800 ELSE 0 END) END AS asked_modified
  FROM p, (VALUES ('r0', 108000, 1, 0), ('r1', 200000, 3, 2), ('r2', -30, 7, 0)) a(part, later, every, rest) WHERE page_id % every = rest),
j AS (SELECT q.*, l.response_id, l.response_ts FROM q ASOF LEFT JOIN latest l ON q.key = l.key AND q.ts > l.response_ts),
v AS (
  SELECT j.*, r.digest, r.bytes, CASE WHEN j.response_id IS NULL THEN 'no_response'
    WHEN CASE WHEN asked IS NOT NULL THEN ltrim(asked, 'W/') = '"' || substr(r.digest, 1, 16) || '"' WHEN asked_modified IS NOT NULL THEN asked_modified = r.modified ELSE own_digest = r.digest END
    THEN 'resolved' ELSE 'mismatch' END AS status
  FROM j LEFT JOIN r ON r.response_id = j.response_id)
SELECT record_id, key AS url_key, ts, response_id, response_ts, ts - response_ts AS age, status,
       CASE WHEN status = 'resolved' THEN sha256('content-length: ' || bytes || chr(10) || 'content-type: text/html' || chr(10) || 'date: @' || ts || chr(10) || 'etag: ' || coalesce(asked, '"' || substr(digest, 1, 16) || '"')) END AS headers_sha256,
       CASE WHEN status = 'resolved' THEN digest END AS body_sha256
FROM v
"""
