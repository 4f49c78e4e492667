"""Content and text expressions.

All are Spark built-in expressions (JVM side, codegen). Regexes use ``(?U)`` so that whitespace and
word boundaries are Unicode-aware, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_or_lit, let

# Fixed values that must equal the reference's.
TEXT_SAMPLE_BYTES = 4096          # caller's sample for the text test
TEXT_SAMPLE_CAP = 8192            # the test never looks at more than this
PRINTABLE_PERCENT = 85            # integer percentage threshold
BINARY_PLACEHOLDER = "[[binary content suppressed]]"
MAX_TEXT_BYTES = 2_000_000        # text read by decode_limited and for the README snippet
CONTEXT_WORDS = 500               # README words in the prompt
PREVIEW_BYTES = 400               # answer preview in error rows
PREVIEW_ELLIPSIS = "…"
# Binary size units (base 1024) for prompts, decimal units (base 1000) for listings.
BINARY_UNITS = ["B", "KB", "MB", "GB", "TB"]
DECIMAL_UNITS = ["B", "kB", "MB", "GB", "TB", "PB", "EB"]


def trim_ws(s) -> Column:
    """Trim Unicode whitespace at both ends (Spark's ``trim`` strips only spaces)."""
    return F.regexp_replace(col_or_lit(s), r"(?U)^\s+|\s+$", "")


def is_blank(s) -> Column:
    return ~col_or_lit(s).rlike(r"(?U)\S")


def human_bytes(b) -> Column:
    """Base-1024 size label: integer bytes below 1 KB, else one decimal, ties to even, capped at TB."""
    b = col_or_lit(b).cast("long")
    out = F.concat(b.cast("string"), F.lit(" B"))
    expr = None
    for k in range(1, len(BINARY_UNITS)):
        lo = 1024 ** k
        val = F.bround(b.cast("double") / F.lit(float(lo)), 1)
        label = F.concat(F.format_string("%.1f", val), F.lit(" " + BINARY_UNITS[k]))
        cond = b >= F.lit(lo) if k == len(BINARY_UNITS) - 1 else (b >= F.lit(lo)) & (b < F.lit(lo * 1024))
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(out)


def decimal_size_label(b, is_file=None) -> Column:
    """Base-1000 size label for listings: ``0 B`` for zero and for non-files; else at most two
    decimals with trailing zeros dropped, rounded half to even in exact integer arithmetic."""
    b = col_or_lit(b).cast("long")
    none = b.isNull() | (b <= 0) if is_file is None else ~col_or_lit(is_file) | b.isNull() | (b <= 0)
    # the unit once, as its exponent; everything after it is computed once, from that unit's divisor
    k = sum((F.when(b >= F.lit(1000 ** i), 1).otherwise(0) for i in range(1, len(DECIMAL_UNITS))), F.lit(0))
    divisor = F.get(F.array(*[F.lit(1000 ** i) for i in range(len(DECIMAL_UNITS))]), k)
    hundredths = F.struct(F.get(F.array(*map(F.lit, DECIMAL_UNITS)), k).alias("unit"), divisor.alias("d"),
                          F.pmod(b, divisor).alias("rest"), b.alias("b"))

    def rounded(x):
        whole = ((x["b"] - x["rest"]).cast("decimal(20,0)") / x["d"].cast("decimal(20,0)")).cast("long")
        num = x["rest"].cast("decimal(22,0)") * F.lit(100)
        q = F.floor(num / x["d"].cast("decimal(22,0)")).cast("long")
        return F.struct(x["unit"].alias("unit"), (whole * 100 + q).alias("h"), (num - q.cast("decimal(22,0)") * x["d"].cast("decimal(22,0)")).cast("decimal(24,0)").alias("r"),
                        x["d"].alias("d"))

    def text(x):
        up = (x["r"] * 2 > x["d"]) | ((x["r"] * 2 == x["d"]) & (x["h"] % 2 == 1))
        return F.struct(x["unit"].alias("unit"), (x["h"] + F.when(up, 1).otherwise(0)).alias("h"))

    def shown(x):
        whole = F.floor(x["h"] / 100).cast("string")
        part = F.rtrim(F.lpad(F.pmod(x["h"], F.lit(100)).cast("string"), 2, "0"), F.lit("0"))
        return F.concat(whole, F.when(part == "", F.lit("")).otherwise(F.concat(F.lit("."), part)), F.lit(" "), x["unit"])

    return F.when(none, F.lit("0 B")).otherwise(let(let(let(hundredths, rounded), text), shown))


# Rough past-tense age wording; thresholds in seconds (fixed values of the humanizing library the
# reference uses, rough accuracy).
S_MINUTE, S_HOUR, S_DAY, S_WEEK = 60, 3600, 86400, 604800
S_MONTH, S_YEAR = 2_629_746, 31_556_952
AGE_RULES = [
    # (lower bound exclusive in seconds, unit seconds, singular text, plural word)
    (547 * S_DAY, S_YEAR, "a year", "years"),
    (345 * S_DAY, None, "a year", None),
    (45 * S_DAY, S_MONTH, "a month", "months"),
    (29 * S_DAY, None, "a month", None),
    (10 * S_DAY + 12 * S_HOUR, S_WEEK, "a week", "weeks"),
    (6 * S_DAY + 12 * S_HOUR, None, "a week", None),
    (36 * S_HOUR, S_DAY, "a day", "days"),
    (22 * S_HOUR, None, "a day", None),
    (90 * S_MINUTE, S_HOUR, "an hour", "hours"),
    (45 * S_MINUTE, None, "an hour", None),
    (90, S_MINUTE, "a minute", "minutes"),
    (45, None, "a minute", None),
    (10, 1, None, "seconds"),
]
AGE_UNKNOWN = "—"


def age_label_from_seconds(secs) -> Column:
    """Rough past-tense age text from an age in seconds; dash when unknown."""
    s = F.abs(col_or_lit(secs).cast("long"))
    expr = F.when(s.isNull(), F.lit(AGE_UNKNOWN))
    for lo, unit, single, plural in AGE_RULES:
        if unit is None:
            text = F.lit(single + " ago")
        elif unit == 1:
            text = F.concat(s.cast("string"), F.lit(" seconds ago"))
        else:
            n = F.greatest(F.floor(s / F.lit(unit)).cast("long"), F.lit(2))
            text = F.concat(n.cast("string"), F.lit(f" {plural} ago"))
        expr = expr.when(s > F.lit(lo), text)
    return expr.otherwise(F.lit("now"))


def age_label(mtime, run_ts) -> Column:
    """Age of ``mtime`` measured against the run timestamp (an argument, never 'now')."""
    secs = F.unix_timestamp(col_or_lit(run_ts)) - F.unix_timestamp(col_or_lit(mtime))
    return age_label_from_seconds(secs)


def latin1(head, limit: int) -> Column:
    """First ``limit`` bytes of a binary column as a string with one character per byte."""
    return F.decode(F.substring(col_or_lit(head), 1, limit), "ISO-8859-1")


def is_probably_text(head, limit: int = TEXT_SAMPLE_BYTES, rule: str = "bytes") -> Column:
    """Text test on the first ``min(limit, 8192)`` bytes.

    ``rule='bytes'`` (the reference's): empty -> text; any NUL -> binary; else integer
    ``printable*100/n >= 85`` over bytes, printable being LF, CR, TAB and 0x20-0x7E, so bytes >= 0x80
    count against and accented prose can be judged binary. ``rule='utf8'``: the same threshold over
    characters of the lossily decoded sample, where only control characters (other than LF, CR, TAB)
    and undecodable bytes count against.
    """
    k = min(limit, TEXT_SAMPLE_CAP)
    if rule == "utf8":
        def judge_utf8(chars):
            m = F.length(chars)
            bad = F.length(F.regexp_replace(chars, "[^\\p{Cc}\uFFFD]|[\n\r\t]", ""))
            return F.when(m == 0, F.lit(True)).when(F.instr(chars, "\u0000") > 0, F.lit(False)) \
                .otherwise((m - bad) * 100 >= m * PRINTABLE_PERCENT)
        return let(F.make_valid_utf8(F.substring(col_or_lit(head), 1, k).cast("string")), judge_utf8)

    def judge(sample):
        n = F.length(sample)
        printable = F.length(F.regexp_replace(sample, "[^\\n\\r\\t\\x20-\\x7E]", ""))
        return F.when(n == 0, F.lit(True)).when(F.instr(sample, "\u0000") > 0, F.lit(False)) \
            .otherwise(printable * 100 >= n * PRINTABLE_PERCENT)

    return let(latin1(head, k), judge)


# Content signatures checked on the first bytes (fixed values; short list, not a full database).
SIGNATURES = [
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
    ("25504446", "application/pdf"),
    ("504B0304", "application/zip"),
    ("1F8B", "application/gzip"),
    ("7F454C46", "application/x-executable"),
]
# Extension fallback, used only when no content is available (scan with content off).
EXTENSION_TYPES = {
    "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "html": "text/html",
    "htm": "text/html", "json": "application/json", "rs": "text/x-rust", "py": "text/x-python",
    "gz": "application/gzip", "zip": "application/zip", "png": "image/png", "jpg": "image/jpeg",
    "jpeg": "image/jpeg", "gif": "image/gif", "pdf": "application/pdf", "css": "text/css",
    "js": "text/javascript", "xml": "application/xml", "toml": "text/x-toml", "yaml": "text/x-yaml",
    "yml": "text/x-yaml", "csv": "text/csv", "sh": "application/x-sh",
}
HTML_PREFIX = r"(?is)^\s*(<!doctype\s+html|<html)"
XML_PREFIX = r"^\s*<\?xml"


def content_type(head, ext=None) -> Column:
    """Type label from the content signature; text content is ``text/plain`` (``text/html`` and
    ``application/xml`` by their openings); without content the extension table, then generic binary."""
    h = col_or_lit(head)
    hx = F.hex(F.substring(h, 1, 8))
    sample = latin1(h, TEXT_SAMPLE_BYTES)  # the same bytes as the text test
    expr = F.when(h.isNull(), F.lit(None).cast("string"))
    for sig, mime in SIGNATURES:
        expr = expr.when(hx.startswith(sig), F.lit(mime))
    expr = expr.when(sample.rlike(HTML_PREFIX), F.lit("text/html")) \
        .when(sample.rlike(XML_PREFIX), F.lit("application/xml")) \
        .when(F.instr(sample, "\u0000") == 0, F.lit("text/plain")) \
        .otherwise(F.lit("application/octet-stream"))
    if ext is None:
        return F.coalesce(expr, F.lit("application/octet-stream"))
    table = F.create_map(*[F.lit(x) for kv in EXTENSION_TYPES.items() for x in kv])
    return F.coalesce(expr, F.element_at(table, F.lower(col_or_lit(ext))), F.lit("application/octet-stream"))


def first_n_words(t, n: int) -> Column:
    """First ``n`` whitespace-separated words joined by one space; bounded split, never all words."""
    if n <= 0:
        return F.lit("")
    pieces = F.split(col_or_lit(t), r"(?U)\s+", n + 2)
    words = F.filter(F.slice(pieces, 1, n + 1), lambda x: x != "")
    return F.coalesce(F.array_join(F.slice(words, 1, n), " "), F.lit(""))


def preview(t, max_bytes: int = PREVIEW_BYTES) -> Column:
    """Text unchanged when it fits in ``max_bytes``; else cut at the last character boundary within
    the limit, an ellipsis and the total byte count."""
    s = col_or_lit(t)
    total = F.octet_length(s)
    cut = F.substring(F.encode(s, "UTF-8"), 1, max_bytes)
    raw = cut.cast("string")
    nchars = F.length(F.make_valid_utf8(raw)) - F.when(F.is_valid_utf8(raw), 0).otherwise(1)
    head = F.substring(s, 1, nchars)
    return F.when(total <= max_bytes, s).otherwise(
        F.concat(head, F.lit(PREVIEW_ELLIPSIS + " ("), total.cast("string"), F.lit(" bytes total)")))


_CONTROL_CLASS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\u2028\\u2029\\uFEFF]"


def sanitize_yaml_text(t) -> Column:
    """Drop control characters other than LF, CR, TAB; U+2028, U+2029, U+FEFF become spaces.

    A plain range class finds the (rare) rows that need it; only those run the replacement.
    """
    c = col_or_lit(t)
    fixed = F.translate(F.regexp_replace(c, _CONTROL_CLASS.replace("\\u2028\\u2029\\uFEFF", ""), ""),
                        "\u2028\u2029\ufeff", "   ")
    return F.when(c.rlike(_CONTROL_CLASS), fixed).otherwise(c)


def indent_lines(t, n: int = 2) -> Column:
    """Prefix every line with ``n`` spaces; CRLF becomes LF, one final line ending is dropped,
    empty stays empty. Literal replacements only (no end-of-input regex subtleties); the input and
    the LF-normalised text are each computed once."""
    pad = " " * n

    def body(s):
        def with_lf(lf):
            trimmed = F.when(lf.endswith("\n"), lf.substr(F.lit(1), F.length(lf) - 1)).otherwise(lf)
            return F.concat(F.lit(pad), F.replace(trimmed, F.lit("\n"), F.lit("\n" + pad)))
        return F.when(s == "", F.lit("")).otherwise(let(F.replace(s, F.lit("\r\n"), F.lit("\n")), with_lf))

    return let(col_or_lit(t), body)


REGEX_META = r"([\\.+*?()|\[\]{}^$#&\-~])"


def regex_escape(s) -> Column:
    """Escape regex meta characters with a backslash."""
    return F.regexp_replace(col_or_lit(s), REGEX_META, r"\\$1")


def suppress_binary(is_text, value) -> Column:
    return F.when(col_or_lit(is_text), col_or_lit(value)).otherwise(F.lit(BINARY_PLACEHOLDER))


def html_escape(s) -> Column:
    """Template-engine default escaping of ``& < > " ' ` =``."""
    c = col_or_lit(s)
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"),
                 ("`", "&#x60;"), ("=", "&#x3D;")]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
