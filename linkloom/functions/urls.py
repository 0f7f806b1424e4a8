"""URL predicate (P5), canonical URL (F1) and the free-text link pattern (L3) as Column expressions.

Everything here is a composition of built-in regex / string functions, so it stays JVM-side inside
whole-stage codegen. The rules follow the WHATWG URL parser for the cases that occur in practice:

* leading/trailing C0-or-space is stripped, tab/LF/CR removed anywhere;
* scheme is case-insensitive; for special schemes any run of ``/`` or ``\\`` after ``scheme:`` is skipped;
* the authority ends at the first ``/ \\ ? #``; userinfo ends at the *last* ``@`` (so ``https://D@evil/`` is
  host ``evil``); the port is all digits and at most 65535 and the scheme's default port is dropped;
* the host is lower-cased; an empty host or a forbidden host code point makes the URL invalid;
* the path has ``\\`` turned into ``/``, becomes ``/`` when empty, has ``.``/``..`` segments resolved and has
  the path percent-encode set (C0, space, ``" < > ` { }``, DEL, non-ASCII) percent-encoded as UTF-8;
* a domain host is percent-decoded before it is checked (``ex%61mple.com`` is ``example.com``); a
  malformed escape or invalid UTF-8 makes the URL invalid; compatibility characters that map onto one
  ASCII host character (fullwidth letters, ideographic full stops, …) are mapped, as domain-to-ASCII does;
* other labels with letters beyond ASCII are lower-cased and take their ``xn--`` form (``functions/hosts.py``);
* a host ending in a number is an IPv4 address of one to four decimal, octal or hexadecimal numbers, or invalid; IP hosts
  (v4 and v6) keep no ``www.`` prefix (the hostname setter rejects ``www.`` + an address).

Not modelled (documented in README): composition of separate accents and mappings to several characters
before the ``xn--`` form, the check of labels that come as ``xn--``, and ``file:`` URLs.

The parser is generated as one Spark SQL expression (a chain of ``transform`` steps over an array of
structs): each field is computed once and later steps reference it cheaply, and the whole expression is
built with a single ``expr`` call instead of thousands of Column calls.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hosts import IGNORED, ascii_host_sql, ipv4_parts_sql, ipv4_sql

# JavaScript whitespace (the set used by String.prototype.trim and by RegExp \s),
# written in the \x{...} form that both Java regex and RE2 accept.
JS_SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

# Special schemes and their default ports (WHATWG URL standard).
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}

URL_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):[/\\]*([^/\\?#]*)([^?#]*)"
HOST_OK_RE = r"^(\[[0-9A-Fa-f:.]+\]|[^\x00-\x20#%/:<>?@\[\\\]^|\x7F]+)$"
IPV6_RE = r"^\[[0-9A-Fa-f:.]+\]$"
# forbidden domain code points (checked after percent-decoding the host)
DOMAIN_OK_RE = r"^[^\x00-\x20#%/:<>?@\[\\\]^|\x7F]+$"
# a host whose last label is a number is an IPv4 address or invalid
ENDS_IN_NUMBER_RE = r"(^|\.)(0[xX][0-9A-Fa-f]*|[0-9]+)\.?$"
IPV4_RE = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
# Characters that never need percent-encoding in a path (printable ASCII minus the path encode set).
PATH_SAFE_RE = r"^[\x21\x23-\x3B\x3D\x3F-\x5F\x61-\x7A\x7C\x7E]*$"
USERINFO_SAFE_RE = r"^[\x21\x23-\x2E\x30-\x39\x41-\x5A\x5F\x61-\x7A\x7E]*$"
DOT_SEGMENT_RE = r"(^|/)(\.|%2[eE]){1,2}(/|$)"


@lru_cache(maxsize=1)
def host_ascii_table() -> tuple[str, str]:
    """Characters the host's domain-to-ASCII step maps onto one ASCII host character: every BMP code point
    whose NFKC case fold is a single ``[a-z0-9.-]`` (fullwidth forms, letter-like symbols, super/subscripts,
    …), plus the ideographic full stops that separate labels. Built by rule from the Unicode database
    (262 + 2 code points); multi-character mappings are not covered."""
    allowed = set("abcdefghijklmnopqrstuvwxyz0123456789-.")
    src, dst = [], []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        mapped = unicodedata.normalize("NFKC", chr(cp)).casefold()
        if len(mapped) == 1 and mapped in allowed:
            src.append(chr(cp))
            dst.append(mapped)
    for stop in ("\u3002", "\uff61"):
        if stop not in src:
            src.append(stop)
            dst.append(".")
    return "".join(src), "".join(dst)


# ---------------------------------------------------------------- SQL text helpers

def raw(pattern: str) -> str:
    """A Spark SQL raw string literal (backslashes kept as written)."""
    if "'" in pattern:
        raise ValueError("raw literal cannot contain a single quote")
    return f"r'{pattern}'"


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def js_trim_sql(v: str) -> str:
    return f"regexp_replace({v}, {raw(f'^[{JS_SPACE}]+|[{JS_SPACE}]+$')}, '')"


def _pct_sql(v: str, safe_re: str) -> str:
    char_safe = safe_re.replace("*$", "$")
    return (f"CASE WHEN {v} RLIKE {raw(safe_re)} THEN {v} ELSE array_join(transform("
            f"regexp_extract_all({v}, {raw('(?s).')}, 0), ch -> CASE WHEN ch = ' ' THEN '%20' "
            f"WHEN ch RLIKE {raw(char_safe)} THEN ch ELSE url_encode(ch) END), '') END")


def _dot_segments_sql(p: str) -> str:
    segs = f"split(substring({p}, 2), '/')"
    tagged = f"transform({segs}, (sg, i) -> named_struct('s', sg, 'last', i = size({segs}) - 1))"
    popped = "CASE WHEN size(acc) > 0 THEN slice(acc, 1, size(acc) - 1) ELSE acc END"
    step = (f"(acc, y) -> CASE "
            f"WHEN lower(y.s) IN ('..', '.%2e', '%2e.', '%2e%2e') THEN "
            f"CASE WHEN y.last THEN concat({popped}, array('')) ELSE {popped} END "
            f"WHEN lower(y.s) IN ('.', '%2e') THEN CASE WHEN y.last THEN concat(acc, array('')) ELSE acc END "
            f"ELSE concat(acc, array(y.s)) END")
    folded = f"aggregate({tagged}, CAST(array() AS ARRAY<STRING>), {step})"
    return f"CASE WHEN {p} RLIKE {raw(DOT_SEGMENT_RE)} THEN concat('/', array_join({folded}, '/')) ELSE {p} END"


def _stage(arr: str, keep: list[str], **new: str) -> str:
    """One parse step: every element is a struct; keep some fields (as ``x.f``) and add new ones."""
    fields = [f"'{k}', x.{k}" for k in keep] + [f"'{k}', {v}" for k, v in new.items()]
    return f"transform({arr}, x -> named_struct({', '.join(fields)}))"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def parse_urls_sql(arr: str) -> str:
    """array<string> SQL → array<struct<raw, scheme, path, userinfo, host, port, valid>> SQL."""
    strip = (f"regexp_replace(regexp_replace(u, {raw(r'[\t\n\r]')}, ''), "
             f"{raw(r'^[\x00-\x20]+|[\x00-\x20]+$')}, '')")
    a = f"transform({arr}, u -> named_struct('raw', u, 's', {strip}))"
    a = _stage(a, ["raw"],
               scheme=f"lower(regexp_extract(x.s, {raw(URL_RE)}, 1))",
               auth=f"regexp_extract(x.s, {raw(URL_RE)}, 2)",
               path=f"regexp_replace(regexp_extract(x.s, {raw(URL_RE)}, 3), {raw(r'\\')}, '/')")
    a = _stage(a, ["raw", "scheme", "path"],
               userinfo=f"CASE WHEN instr(x.auth, '@') > 0 THEN regexp_extract(x.auth, {raw('^(.*)@')}, 1) ELSE '' END",
               hostport=f"regexp_extract(x.auth, {raw('([^@]*)$')}, 1)")
    a = _stage(a, ["raw", "scheme", "path", "userinfo"],
               host_raw=f"regexp_extract(x.hostport, {raw(r'^(\[[^\]]*\]|[^:]*)')}, 1)",
               port_raw=f"regexp_extract(x.hostport, {raw(r'^(?:\[[^\]]*\]|[^:]*):(.*)$')}, 1)")
    a = _stage(a, ["raw", "scheme", "path", "userinfo", "host_raw", "port_raw"],
               port_digits=f"regexp_replace(x.port_raw, {raw('^0+')}, '')",
               host_dec=("translate(CASE WHEN instr(x.host_raw, '%') > 0 "
                         "THEN try_url_decode(replace(x.host_raw, '+', '%2B')) ELSE x.host_raw END, "
                         f"{raw(host_ascii_table()[0])}, {raw(host_ascii_table()[1])})"))
    # international labels in their ASCII form; a host that ends in a number as the address it spells
    kept = ["raw", "scheme", "path", "userinfo", "host_raw", "port_raw", "port_digits"]
    spaced = r"'[\p{Z}\p{C}&&[^\x00-\x7F]]'"
    mapped = f"regexp_replace(lower(x.host_dec), {raw(IGNORED)}, '')"
    international = _let(mapped, "h", f"CASE WHEN h RLIKE r{spaced} THEN CAST(NULL AS STRING) ELSE {ascii_host_sql('h')} END")
    a = _stage(a, kept, host_dec=f"CASE WHEN x.host_dec RLIKE {raw(r'^[\x00-\x7F]*$')} THEN x.host_dec ELSE {international} END")
    address = _let(ipv4_parts_sql("x.host_dec"), "v4", ipv4_sql("v4"))
    a = _stage(a, kept, host_dec=f"CASE WHEN x.host_dec RLIKE {raw(ENDS_IN_NUMBER_RE)} THEN {address} ELSE x.host_dec END")
    small = "coalesce(try_cast(nullif(x.port_digits, '') AS INT), 0) <= 65535"
    port_ok = (f"(x.port_raw = '' OR (x.port_raw RLIKE {raw('^[0-9]+$')} AND length(x.port_digits) <= 5 "
               f"AND {small}))")
    special = ", ".join(f"'{s}'" for s in DEFAULT_PORTS)
    ipv6 = f"startswith(x.host_raw, '[')"
    host_ok = (f"CASE WHEN {ipv6} THEN x.host_raw RLIKE {raw(IPV6_RE)} "
               f"ELSE x.host_dec IS NOT NULL AND x.host_dec != '' AND x.host_dec RLIKE {raw(DOMAIN_OK_RE)} "
               f"AND instr(x.host_dec, '\uFFFD') = 0 END")
    valid = f"coalesce(x.scheme IN ({special}) AND {host_ok} AND {port_ok}, false)"
    port = ("CASE WHEN x.port_raw = '' THEN CAST(NULL AS INT) WHEN x.port_digits = '' THEN 0 "
            "ELSE try_cast(x.port_digits AS INT) END")
    host = f"lower(CASE WHEN {ipv6} THEN x.host_raw ELSE x.host_dec END)"
    return _stage(a, ["raw", "scheme", "path", "userinfo"], host=host, port=port, valid=valid)


def in_domain_sql(x: str, domain: str) -> str:
    d = domain.lower()
    return (f"({x}.valid AND {x}.scheme IN ('http', 'https') AND ({x}.host = {raw(d)} OR "
            f"endswith({x}.host, {raw('.' + d)})))")


def canonical_pairs_sql(parsed: str) -> str:
    """F1 rendering of parsed URL structs → array<struct<url (raw input), canonical_url>> SQL."""
    base = ["raw", "scheme", "userinfo", "host", "port", "valid"]
    a = _stage(parsed, base, path="CASE WHEN x.path = '' THEN '/' ELSE x.path END")
    a = _stage(a, base, path=_dot_segments_sql("x.path"))
    a = _stage(a, base, path=_pct_sql("x.path", PATH_SAFE_RE),
               user=f"regexp_extract(x.userinfo, {raw('^([^:]*)')}, 1)",
               password=f"regexp_extract(x.userinfo, {raw('^[^:]*:(.*)$')}, 1)")
    default = "CASE x.scheme " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in DEFAULT_PORTS.items()) + " END"
    port_out = (f"CASE WHEN x.port IS NULL OR x.port = {default} OR x.port = 443 THEN '' "
                f"ELSE concat(':', CAST(x.port AS STRING)) END")
    ui_out = (f"CASE WHEN x.user = '' AND x.password = '' THEN '' ELSE concat({_pct_sql('x.user', USERINFO_SAFE_RE)}, "
              f"CASE WHEN x.password = '' THEN '' ELSE concat(':', {_pct_sql('x.password', USERINFO_SAFE_RE)}) END, "
              f"'@') END")
    host_out = (f"CASE WHEN startswith(x.host, 'www.') OR startswith(x.host, '[') OR x.host RLIKE {raw(IPV4_RE)} "
                f"THEN x.host ELSE concat('www.', x.host) END")
    canon = (f"CASE WHEN x.valid THEN concat('https://', {ui_out}, {host_out}, {port_out}, x.path) "
             f"ELSE {js_trim_sql('x.raw')} END")
    return f"transform({a}, x -> named_struct('url', x.raw, 'canonical_url', {canon}))"


def other_scheme_sql(arr: str) -> str:
    """F1 for URLs of schemes without special rules (``mailto:``, ``foo://host/…``): array<string> SQL → array<string> SQL,
    NULL where the input is no such URL. The scheme cannot become https; query and fragment go, and a URL with an
    authority gets the ``www.`` host."""
    special = ", ".join(f"'{s}'" for s in [*DEFAULT_PORTS, "file"])
    strip = (f"regexp_replace(regexp_replace(u, {raw(r'[\t\n\r]')}, ''), {raw(r'^[\x00-\x20]+|[\x00-\x20]+$')}, '')")
    a = f"transform({arr}, u -> named_struct('s', {strip}))"
    a = _stage(a, [], scheme=f"lower(regexp_extract(x.s, {raw(r'^([A-Za-z][A-Za-z0-9+.\-]*):')}, 1))",
               body=f"regexp_extract(x.s, {raw('^[^:]*:([^?#]*)')}, 1)")
    a = _stage(a, ["scheme", "body"], opaque="NOT startswith(x.body, '/')", auth=f"regexp_extract(x.body, {raw('^//([^/]*)')}, 1)",
               path=f"regexp_replace(x.body, {raw('^//[^/]*')}, '')")
    a = _stage(a, ["scheme", "body", "opaque", "path"], user=f"regexp_extract(x.auth, {raw('^(.*@)')}, 1)",
               host=f"regexp_extract(x.auth, {raw(r'^(?:.*@)?(\[[^\]]*\]|[^:@]*)')}, 1)",
               port=f"regexp_extract(x.auth, {raw(r'^(?:.*@)?(?:\[[^\]]*\]|[^:@]*)(:.*)?$')}, 1)")
    a = _stage(a, ["scheme", "body", "opaque", "user", "host", "port"], path=_dot_segments_sql("x.path"))
    ok = (f"(x.host RLIKE {raw(r'^(\[[0-9A-Fa-f:.]+\]|[^\x00\t\n\r #/:<>?@\[\\\]^|]*)$')} AND x.port RLIKE {raw('^(:[0-9]{0,5})?$')} "
          f"AND coalesce(try_cast(nullif(substring(x.port, 2), '') AS INT), 0) <= 65535 AND NOT (x.host = '' AND x.user || x.port != ''))")
    www = "CASE WHEN startswith(x.host, 'www.') OR startswith(x.host, '[') THEN x.host ELSE 'www.' || x.host END"
    port = "CASE WHEN x.port IN ('', ':') THEN '' ELSE ':' || CAST(CAST(substring(x.port, 2) AS INT) AS STRING) END"
    out = (f"CASE WHEN x.scheme = '' OR x.scheme IN ({special}) THEN CAST(NULL AS STRING) WHEN x.opaque THEN x.scheme || ':' || x.body "
           f"WHEN {ok} THEN x.scheme || '://' || x.user || {www} || {port} || {_pct_sql('x.path', PATH_SAFE_RE)} END")
    return f"transform({a}, x -> {out})"


# ---------------------------------------------------------------- Column API (arguments are column names)

def js_trim(col: Column) -> Column:
    """String.prototype.trim: strip JavaScript whitespace at both ends (Spark's trim strips only U+0020)."""
    return F.regexp_replace(col, rf"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def parse_urls(array_col: str) -> Column:
    """Parsed URL structs for an array<string> column (see :func:`parse_urls_sql`)."""
    return F.expr(parse_urls_sql(ident(array_col)))


def url_parts(col: str) -> Column:
    """The parsed struct of one URL column."""
    return F.expr(f"element_at({parse_urls_sql(f'array({ident(col)})')}, 1)")


def is_domain_url(col: str, domain: str) -> Column:
    """P5: http(s) URL whose host is ``domain`` or a sub-domain of it (spoof-safe, case-insensitive)."""
    flags = f"transform({parse_urls_sql(f'array({ident(col)})')}, x -> {in_domain_sql('x', domain)})"
    return F.expr(f"coalesce(element_at({flags}, 1), false)")


def canonical_url(col: str) -> Column:
    """F1 for one URL column; an input the parser rejects comes back trimmed (JavaScript whitespace)."""
    one = f"array({ident(col)})"
    pairs = canonical_pairs_sql(parse_urls_sql(one))
    return F.expr(f"coalesce(element_at({other_scheme_sql(one)}, 1), element_at({pairs}, 1).canonical_url)")


def filter_domain_urls(array_col: str, domain: str) -> Column:
    """The URLs of an array<string> column that pass the domain predicate, in order."""
    kept = f"filter({parse_urls_sql(ident(array_col))}, x -> {in_domain_sql('x', domain)})"
    return F.expr(f"transform({kept}, x -> x.raw)")


def domain_link_pairs(array_col: str, domain: str) -> Column:
    """L4 + F1: distinct (first occurrence wins, raw comparison) domain URLs of an array<string> column with
    their canonical form, as array<struct<url, canonical_url>>."""
    kept = f"filter({parse_urls_sql(ident(array_col))}, x -> {in_domain_sql('x', domain)})"
    return F.expr(f"array_distinct({canonical_pairs_sql(kept)})")


def _case_insensitive(text: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else re.escape(c) for c in text)


def text_link_pattern(domain: str) -> str:
    """L3: ``https?://`` + at most one ``[a-z0-9-]+.`` label + domain + ``/`` + one or more characters that
    are not whitespace or quotes; ASCII case-insensitive, unanchored. Valid in Java regex and RE2."""
    return (_case_insensitive("http") + "[sS]?://(?:[a-zA-Z0-9-]+\\.)?" + _case_insensitive(domain)
            + "/[^" + JS_SPACE + "\"']+")


def text_links(text: Column, domain: str) -> Column:
    """All non-overlapping matches of the text link pattern, in order."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(text_link_pattern(domain)), 0),
                      F.array().cast("array<string>"))
