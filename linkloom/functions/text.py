"""Slug (F2), category fold (F3), display name (F4) and the report helpers."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import js_trim  # noqa: F401  (re-exported)


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Precomposed letters whose canonical decomposition is one ASCII letter/digit followed only by
    combining diacritics (U+0300–U+036F), mapped to that base letter in lower case.

    Built from the Unicode database by rule (489 code points in the BMP), so ``translate`` reproduces
    lower-case → NFD → drop U+0300–U+036F without a Python UDF.
    """
    src, dst = [], []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        d = unicodedata.normalize("NFD", ch)
        if len(d) > 1 and d[0].isascii() and d[0].isalnum() and all(0x300 <= ord(c) <= 0x36F for c in d[1:]):
            src.append(ch)
            dst.append(d[0].lower())
    return "".join(src), "".join(dst)


def slugify(col: Column) -> Column:
    """lower → strip accents → runs of non ``[a-z0-9]`` become ``-`` → trim ``-``."""
    src, dst = accent_table()
    folded = F.translate(F.lower(col), src, dst)
    no_marks = F.regexp_replace(folded, r"[\x{0300}-\x{036F}]", "")
    dashed = F.regexp_replace(no_marks, "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def fold_category(col: Column) -> Column:
    """``us`` in any case becomes ``US``; everything else is unchanged."""
    return F.when(F.lower(col) == "us", F.lit("US")).otherwise(col)


def display_name(col: Column) -> Column:
    """``US`` when the upper-cased value is US, else first character upper-cased, rest unchanged."""
    return F.when(F.upper(col) == "US", F.lit("US")).otherwise(
        F.concat(F.upper(F.substring(col, 1, 1)), F.substring(col, 2, 1 << 30)))


# ---------------------------------------------------------------- report helpers
# Fixed values below, which must read as the original's reports do: the HTML entities, the characters that
# encodeURIComponent keeps, the class names, the profile address, "Unknown Title", and the age and status words.

def html_escape(col: Column) -> Column:
    """escape & < > " ' in that order."""
    out = F.replace(col, F.lit("&"), F.lit("&amp;"))
    for ch, ent in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(ch), F.lit(ent))
    return out


def encode_uri_component(col: Column) -> Column:
    """encodeURIComponent — URLEncoder output with ``+``→``%20`` and ``! ' ( ) ~`` restored."""
    out = F.replace(F.url_encode(col), F.lit("+"), F.lit("%20"))
    for enc, ch in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(enc), F.lit(ch))
    return out


def tag_class(col: Column) -> Column:
    """``sub`` for ``sub-`` prefixed or ``review``; ``author`` when it contains ``-``; else ``plain``."""
    return (F.when(col.startswith("sub-") | (col == "review"), F.lit("sub"))
            .when(col.contains("-"), F.lit("author"))
            .otherwise(F.lit("plain")))


def tag_display(col: Column) -> Column:
    """``us`` is shown as ``US``."""
    return F.when(col == "us", F.lit("US")).otherwise(col)


def post_web_link(did: Column, uri: Column, base: str = "https://bsky.app") -> Column:
    """F8: profile post link from the DID and the last ``/`` segment of the post URI."""
    return F.concat(F.lit(base + "/profile/"), did, F.lit("/post/"), F.element_at(F.split(uri, "/"), -1))


def title_default(col: Column) -> Column:
    """null or empty title becomes ``Unknown Title``."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit("Unknown Title"))


def format_uptime(seconds: Column) -> Column:
    """``HH:MM:SS`` with unbounded hours."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)


def relative_age(event_time: Column, as_of: Column) -> Column:
    """``Ns ago`` / ``Nm Ns ago`` (clamped at 0), ``Never`` for null, ``-`` when not a timestamp."""
    ts = F.try_to_timestamp(event_time.cast("string"))
    diff_ms = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts)) / 1000
    secs = F.greatest(F.lit(0), F.floor(diff_ms / 1000)).cast("long")
    text = F.when(secs < 60, F.concat(secs.cast("string"), F.lit("s ago"))).otherwise(
        F.concat(F.floor(secs / 60).cast("string"), F.lit("m "), (secs % 60).cast("string"), F.lit("s ago")))
    return F.when(event_time.isNull(), F.lit("Never")).when(ts.isNull(), F.lit("-")).otherwise(text)


def feed_status(connected: Column, reconnects: Column) -> Column:
    """Online when connected; else Connecting after a reconnect; else Offline."""
    return (F.when(connected, F.lit("Online"))
            .when(reconnects > 0, F.lit("Connecting"))
            .otherwise(F.lit("Offline")))
