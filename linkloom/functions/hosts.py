"""Numeric and international hosts as SQL expressions: the IPv4 spellings of URLs and the Bootstring (punycode) form of labels.

Both are generated as text and nested into the URL parser's staged expression. They run only on hosts that need them.
"""

from __future__ import annotations

# The parameters of Bootstring for domain labels (RFC 3492).
BASE, T_MIN, T_MAX, SKEW, DAMP, INITIAL_BIAS, INITIAL_N = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Code points of a label that mapping drops: soft hyphen, zero-width space and joiners of words, byte order mark, variation selectors.
IGNORED = r"[\x{00AD}\x{200B}\x{2060}\x{FEFF}\x{FE00}-\x{FE0F}]"
#: A delta of a label takes no more digits, and no more divisions, than this (64-bit numbers).
_LONGEST = 14


def ipv4_parts_sql(host: str) -> str:
    """array<bigint> of the numbers of a host whose last label is a number: decimal, 0-octal or 0x-hexadecimal; NULL for what is none."""
    significant = "regexp_replace(p, r'^(0x|0X)?0*', '')"
    number = (f"CASE WHEN p RLIKE r'^0[xX][0-9A-Fa-f]*$' THEN CASE WHEN length({significant}) > 8 THEN 4294967296 "
              f"ELSE CAST(conv(concat('0', {significant}), 16, 10) AS BIGINT) END "
              f"WHEN p RLIKE r'^0[0-7]*$' THEN CASE WHEN length({significant}) > 11 THEN 4294967296 ELSE CAST(conv(p, 8, 10) AS BIGINT) END "
              f"WHEN p RLIKE r'^[1-9][0-9]*$' THEN CASE WHEN length(p) > 10 THEN 4294967296 ELSE CAST(p AS BIGINT) END END")
    return f"transform(split(regexp_replace({host}, r'\\.$', ''), r'\\.'), p -> {number})"


def ipv4_sql(parts: str) -> str:
    """Dotted quad of the numbers of an address, one to four, the last of which fills what is left; NULL if they are no address."""
    n = f"size({parts})"
    head = f"slice({parts}, 1, {n} - 1)"
    room = f"shiftleft(CAST(1 AS BIGINT), 8 * (5 - {n}))"
    fits = f"{n} <= 4 AND NOT exists({parts}, v -> v IS NULL) AND NOT exists({head}, v -> v > 255) AND element_at({parts}, -1) < {room}"
    value = f"(aggregate({head}, CAST(0 AS BIGINT), (acc, v) -> acc * 256 + v) * {room} + element_at({parts}, -1))"
    octets = f"transform(sequence(0, 3), i -> CAST(shiftright({value}, 24 - 8 * i) & 255 AS STRING))"
    return f"CASE WHEN {fits} THEN array_join({octets}, '.') END"


def _digits_sql(delta: str, bias: str) -> str:
    """``delta`` as a variable-length integer under ``bias``."""
    threshold = f"greatest({T_MIN}, least({T_MAX}, {BASE} * k - {bias}))"
    char = lambda d: f"substring('{DIGITS}', CAST({d} AS INT) + 1, 1)"
    step = (f"(e, k) -> CASE WHEN e.over THEN e WHEN e.q < {threshold} THEN named_struct('q', e.q, 'over', true, 'text', concat(e.text, {char('e.q')})) "
            f"ELSE named_struct('q', (e.q - {threshold}) DIV ({BASE} - {threshold}), 'over', false, "
            f"'text', concat(e.text, {char(f'{threshold} + (e.q - {threshold}) % ({BASE} - {threshold})')})) END")
    return f"aggregate(sequence(1, {_LONGEST}), named_struct('q', {delta}, 'over', false, 'text', ''), {step}, e -> e.text)"


def _adapted_sql(delta: str, points: str, first: str) -> str:
    """The bias after a delta."""
    limit = ((BASE - T_MIN) * T_MAX) // 2
    start = f"(CASE WHEN {first} THEN {delta} DIV {DAMP} ELSE {delta} DIV 2 END)"
    step = f"(d, j) -> CASE WHEN d.x > {limit} THEN named_struct('x', d.x DIV {BASE - T_MIN}, 'k', d.k + {BASE}) ELSE d END"
    end = f"d -> CAST(d.k + ({BASE} * d.x) DIV (d.x + {SKEW}) AS INT)"
    return f"aggregate(sequence(1, {_LONGEST}), named_struct('x', {start} + {start} DIV {points}, 'k', 0), {step}, {end})"


def punycode_sql(label: str) -> str:
    """The Bootstring form of a label with non-ASCII letters (without its prefix)."""
    points = f"transform(regexp_extract_all({label}, r'(?s).', 0), c -> CAST(ascii(c) AS BIGINT))"
    plain = f"regexp_replace({label}, r'[^\\x00-\\x7F]', '')"
    state = ("named_struct('delta', {delta}, 'n', {n}, 'done', {done}, 'bias', {bias}, 'text', {text})").format
    start = state(delta="CAST(0 AS BIGINT)", n=f"CAST({INITIAL_N} AS BIGINT)", done=f"CAST(length({plain}) AS BIGINT)", bias=str(INITIAL_BIAS),
                  text=f"CASE WHEN {plain} = '' THEN '' ELSE concat({plain}, '-') END")
    # one more occurrence of the letter m: its delta is written, the bias adapts
    written = state(delta="CAST(0 AS BIGINT)", n="s.n", done="s.done + 1", bias=_adapted_sql("s.delta", "(s.done + 1)", f"s.done = length({plain})"),
                    text=f"concat(s.text, {_digits_sql('s.delta', 's.bias')})")
    passed = state(delta="s.delta + 1", n="s.n", done="s.done", bias="s.bias", text="s.text")
    inner = f"(s, cp) -> CASE WHEN cp < s.n THEN {passed} WHEN cp = s.n THEN {written} ELSE s END"
    entered = state(delta="t.delta + (m - t.n) * (t.done + 1)", n="m", done="t.done", bias="t.bias", text="t.text")
    left = state(delta="u.delta + 1", n="u.n + 1", done="u.done", bias="u.bias", text="u.text")
    outer = f"(t, m) -> aggregate({points}, {entered}, {inner}, u -> {left})"
    letters = f"array_sort(array_distinct(filter({points}, x2 -> x2 >= {INITIAL_N})))"
    return f"aggregate({letters}, {start}, {outer}, z -> z.text)"


def ascii_host_sql(host: str) -> str:
    """A lower-case host with every label that is not ASCII in its ``xn--`` form."""
    return (f"CASE WHEN {host} RLIKE r'^[\\x00-\\x7F]*$' THEN {host} ELSE array_join(transform(split({host}, r'\\.'), "
            f"lb -> CASE WHEN lb RLIKE r'^[\\x00-\\x7F]*$' THEN lb ELSE concat('xn--', {punycode_sql('lb')}) END), '.') END")
