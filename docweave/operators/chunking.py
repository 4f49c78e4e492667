"""Chunking (K1-K4) and binary suppression (C14), plus lossy decoding of the bounded head.

Two modes:

* ``window``: fixed N-word windows in pure Spark expressions. Only the three chunks that the prompt
  needs are sliced (first, middle, last); the full chunk table is produced only on request.
* ``packed``: greedy packing up to the coarsest boundary that fits (paragraph, line, sentence, word). With the default
  sizer one pattern does it, JVM side; a sizer of the caller's runs in an Arrow-batched pandas UDF. Boundaries are
  ours; the reference's external splitter and tokenizer are not available.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..functions._util import col_or_lit, let

DEFAULT_MAX_TOKENS = 1000
DEFAULT_WINDOW_WORDS = 700

# Extension -> language routing for code (23 languages).
LANGUAGE_EXTENSIONS = {
    "bash": ["sh", "bash", "zsh"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cxx", "cc", "hpp", "hxx", "hh"],
    "c-sharp": ["cs"],
    "css": ["css"],
    "embedded-template": ["erb", "ejs"],
    "go": ["go"],
    "haskell": ["hs"],
    "html": ["html", "htm"],
    "java": ["java"],
    "javascript": ["js", "mjs", "cjs"],
    "jsdoc": ["jsdoc"],
    "json": ["json"],
    "julia": ["jl"],
    "ocaml": ["ml", "mli"],
    "php": ["php", "phtml"],
    "python": ["py"],
    "regex": ["re", "regex"],
    "ruby": ["rb", "rake", "gemspec"],
    "rust": ["rs"],
    "scala": ["scala", "sc"],
    "typescript": ["ts", "tsx"],
    "verilog": ["v", "vh", "sv", "svh"],
}
MARKDOWN_EXTENSIONS = ["md", "markdown", "mdx"]


def ext_language_map() -> Column:
    pairs = [(e, lang) for lang, exts in LANGUAGE_EXTENSIONS.items() for e in exts]
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def route_splitter(content_type, ext) -> Column:
    """``struct<splitter, language>``: markdown by type label or extension, else code by the language
    table, else text. A literal map lookup: no join, no shuffle."""
    le = F.lower(col_or_lit(ext))
    lang = F.element_at(ext_language_map(), le)
    md = F.coalesce(F.lower(col_or_lit(content_type)).contains("markdown"), F.lit(False)) | \
        F.coalesce(le.isin(*MARKDOWN_EXTENSIONS), F.lit(False))
    splitter = F.when(md, F.lit("markdown")).when(lang.isNotNull(), F.lit("code")).otherwise(F.lit("text"))
    return F.struct(splitter.alias("splitter"), F.when(~md, lang).alias("language"))


def decode_lossy(head) -> Column:
    """Bytes as UTF-8 text, invalid sequences (e.g. a character cut by the byte limit) replaced by
    U+FFFD, JVM-side."""
    return F.make_valid_utf8(col_or_lit(head).cast("string"))


# ---------------------------------------------------------------- window mode (pure expressions)

MAX_WORD = 64


def _words(text) -> Column:
    """White-space separated words; a longer run counts as words of ``MAX_WORD`` characters, so that a window
    is bounded for text without spaces too. One pass over the text."""
    return F.regexp_extract_all(col_or_lit(text), F.lit(r"(?U)\S{1,%d}" % MAX_WORD), F.lit(0))


def window_chunk_count(text, n_words: int = DEFAULT_WINDOW_WORDS) -> Column:
    return F.ceil(F.size(_words(text)) / F.lit(n_words)).cast("int")


def window_chunks(df: DataFrame, text_col: str, n_words: int = DEFAULT_WINDOW_WORDS,
                  keys: list[str] | None = None) -> DataFrame:
    """The full chunk table ``(keys..., chunk_no, n_chunks, text, n_words)`` in window mode."""
    keys = keys or ["project", "path"]

    def chunks(w):
        n = F.ceil(F.size(w) / F.lit(n_words)).cast("int")

        def one(i):
            part = F.slice(w, i * n_words + 1, F.lit(n_words))
            return F.struct(i.alias("chunk_no"), n.alias("n_chunks"), F.array_join(part, " ").alias("text"),
                            F.least(F.lit(n_words), F.size(w) - i * n_words).cast("int").alias("n_words"))

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one))

    return df.select(*keys, F.explode(let(_words(F.col(text_col)), chunks)).alias("c")).select(*keys, "c.*")


def pick_three_window(text, n_words: int = DEFAULT_WINDOW_WORDS) -> Column:
    """``struct<first, mid, last, n_chunks>`` by slicing only three word ranges.

    The word array is computed once and bound with a one-element ``transform`` (a let-binding),
    so the text is split once per row, not four times.
    """
    def pick(w):
        n = F.ceil(F.size(w) / F.lit(n_words)).cast("int")

        def chunk(i):
            return F.array_join(F.slice(w, i * n_words + 1, F.lit(n_words)), " ")

        return F.struct(chunk(F.lit(0)).alias("first"), chunk(F.floor(n / 2).cast("int")).alias("mid"),
                        chunk(n - 1).alias("last"), n.alias("n_chunks"))

    return let(_words(text), pick)


# ---------------------------------------------------------------- packed mode

# White space as UTF-8 bytes, one character per byte (fixed values: the Unicode property White_Space).
WHITE_BYTES = (r"(?:[\t-\r ]|\xC2[\x85\xA0]|\xE1\x9A\x80|\xE2\x80[\x80-\x8A\xA8\xA9\xAF]|\xE2\x81\x9F|\xE3\x80\x80)")
WHITE_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def packing_pattern(max_bytes: int) -> str:
    """A chunk from the next word on: all that is left if it fits, else up to the last paragraph end that fits, else the last line
    end, sentence end, word end, and last the largest whole character."""
    some = "(?!%s).{1,%d}" % (WHITE_BYTES, max_bytes)
    ends = [some + "+" + WHITE_BYTES + r"*+\z",
            some + r"(?=\n[ \t\x0B-\r]*\n)",
            some + r"(?=\n)",
            "(?!%s).{0,%d}[.!?](?=%s)" % (WHITE_BYTES, max_bytes - 1, WHITE_BYTES),
            some + "(?=%s)" % WHITE_BYTES,
            some + r"(?![\x80-\xBF])"]
    return r"(?s)(?:%s)*+(%s)" % (WHITE_BYTES, "|".join(ends))


def packed_chunks(text, max_tokens: int = DEFAULT_MAX_TOKENS) -> Column:
    """Chunks of at most ``max_tokens`` by ``approx_tokens`` (a token per four bytes), cut at the largest boundary that fits; JVM
    side, one pass of one pattern over the text's bytes. No word is lost and order is kept; an empty or blank text has none."""
    t = F.coalesce(col_or_lit(text), F.lit(""))
    pattern = F.lit(packing_pattern(4 * max_tokens - 2))
    plain = F.transform(F.regexp_extract_all(t, pattern, F.lit(1)), lambda c: F.rtrim(c, F.lit(WHITE_CHARS)))
    # one character per byte, so that the bound is one of bytes
    wide = F.transform(F.regexp_extract_all(F.decode(F.encode(t, "UTF-8"), "ISO-8859-1"), pattern, F.lit(1)),
                       lambda c: F.rtrim(F.decode(F.encode(c, "ISO-8859-1"), "UTF-8"), F.lit(WHITE_CHARS)))
    return F.when(F.octet_length(t) == F.char_length(t), plain).otherwise(wide)


def pick_three_packed(text, max_tokens: int = DEFAULT_MAX_TOKENS) -> Column:
    """``struct<first, mid, last, n_chunks>``: the first, middle (index n/2) and last packed chunk."""
    def pick(c):
        n = F.size(c)
        return F.struct(F.get(c, F.lit(0)).alias("first"), F.get(c, F.floor(n / 2).cast("int")).alias("mid"),
                        F.get(c, n - 1).alias("last"), n.alias("n_chunks"))

    return let(packed_chunks(text, max_tokens), pick)


# ------------------------------------- packed mode with a sizer of the caller's (Arrow UDF)

def approx_tokens(s: str) -> int:
    """Default sizer: a token per four bytes of UTF-8, counting two bytes for a separator. A chunk of at most
    n tokens so has at most 4 n bytes, whatever its script and with or without spaces."""
    return (len(s.encode()) + 5) // 4


_LEVELS = [
    re.compile(r"\n\s*\n"),                 # paragraphs
    re.compile(r"\n"),                      # lines
    re.compile(r"(?<=[.!?])\s+"),          # sentences
    re.compile(r"\s+"),                     # words
]


def _cut_word(word: str, max_tokens: int, sizer: Callable[[str], int]) -> list[str]:
    """A single piece too large on its own, cut into the longest prefixes that fit (one character at least).

    The length is found by doubling, then by bisection, so a piece costs a few sizings per chunk."""
    out, at = [], 0
    while at < len(word):
        good, n = 1, 2
        while at + good < len(word) and sizer(word[at:at + n]) <= max_tokens:
            good, n = min(n, len(word) - at), n * 2
        low, high = good, min(n, len(word) - at)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if sizer(word[at:at + mid]) <= max_tokens else (low, mid - 1)
        out.append(word[at:at + low])
        at += low
    return out


def pack_text(text: str, max_tokens: int, sizer: Callable[[str], int] = approx_tokens, level: int = 0) -> list[str]:
    """Greedy packing: split at the coarsest level, merge neighbours while they fit, descend into any
    piece that is too large on its own. Every chunk fits, order is kept, no word is lost.

    Pieces are sized once each and sizes are summed; a sizer's sizes must add up to at least the size
    of the pieces joined.
    """
    text = text.strip()
    if not text:
        return []
    if sizer(text) <= max_tokens:
        return [text]
    if level >= len(_LEVELS):
        return _cut_word(text, max_tokens, sizer)
    pieces = [p.strip() for p in _LEVELS[level].split(text) if p.strip()]
    if len(pieces) <= 1:
        return pack_text(text, max_tokens, sizer, level + 1)
    sizes = [sizer(p) for p in pieces]
    sep = "\n\n" if level == 0 else ("\n" if level == 1 else " ")
    chunks: list[str] = []
    cur: list[str] = []
    cur_size = 0
    for p, ps in zip(pieces, sizes):
        if ps > max_tokens:
            if cur:
                chunks.append(sep.join(cur))
                cur, cur_size = [], 0
            chunks.extend(pack_text(p, max_tokens, sizer, level + 1))
            continue
        if cur and cur_size + ps > max_tokens:
            chunks.append(sep.join(cur))
            cur, cur_size = [], 0
        cur.append(p)
        cur_size += ps
    if cur:
        chunks.append(sep.join(cur))
    return chunks


PICK_SCHEMA = "struct<first:string,mid:string,last:string,n_chunks:int>"


def packed_pick_three_udf(max_tokens: int = DEFAULT_MAX_TOKENS, sizer: Callable[[str], int] = approx_tokens):
    """Arrow UDF returning the first, middle (index n/2) and last packed chunk and the count."""

    @F.pandas_udf(PICK_SCHEMA)
    def pick(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            ch = pack_text(t or "", max_tokens, sizer)
            if not ch:
                rows.append(("", "", "", 0))
            else:
                rows.append((ch[0], ch[len(ch) // 2], ch[-1], len(ch)))
        return pd.DataFrame(rows, columns=["first", "mid", "last", "n_chunks"])

    return pick


def packed_chunks_udf(max_tokens: int = DEFAULT_MAX_TOKENS, sizer: Callable[[str], int] = approx_tokens):
    """Arrow UDF returning every packed chunk (for the chunk table)."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pack_text(t or "", max_tokens, sizer))

    return chunks


# ---------------------------------------------------------------- the three prompt chunks

def chunk_triple(text, is_text, splitter, mode: str = "window", n_words: int = DEFAULT_WINDOW_WORDS,
                 max_tokens: int = DEFAULT_MAX_TOKENS, sizer: Callable[[str], int] = approx_tokens) -> Column:
    """``struct<first, mid, last, used, n_chunks>`` with the edge cases: binary -> placeholder in
    all three and ``binary``; blank text -> three empty strings and ``empty``; no chunk -> three
    empty strings and the splitter name.

    The chunking result is bound once (one-element ``transform``) and only computed for text rows,
    so the text is split once and binary content is never split.
    """
    t = col_or_lit(text)
    txt = col_or_lit(is_text)
    blank = TX.is_blank(t)
    if mode == "window":
        picked = pick_three_window(t, n_words)
    elif sizer is approx_tokens:
        picked = pick_three_packed(t, max_tokens)
    else:  # the Arrow UDF runs as its own operator over every row: hand it null for binary and blank rows
        picked = packed_pick_three_udf(max_tokens, sizer)(F.when(txt & ~blank, t))
    ph = F.lit(TX.BINARY_PLACEHOLDER)

    def build(p):
        has = F.coalesce(p["n_chunks"], F.lit(0)) > 0
        normal = F.struct(F.when(has, p["first"]).otherwise(F.lit("")).alias("first"),
                          F.when(has, p["mid"]).otherwise(F.lit("")).alias("mid"),
                          F.when(has, p["last"]).otherwise(F.lit("")).alias("last"),
                          col_or_lit(splitter).alias("used"), F.coalesce(p["n_chunks"], F.lit(0)).alias("n_chunks"))
        binary = F.struct(ph.alias("first"), ph.alias("mid"), ph.alias("last"), F.lit("binary").alias("used"),
                          F.lit(0).alias("n_chunks"))
        empty = F.struct(F.lit("").alias("first"), F.lit("").alias("mid"), F.lit("").alias("last"),
                         F.lit("empty").alias("used"), F.lit(0).alias("n_chunks"))
        return F.when(~txt, binary).when(blank, empty).otherwise(normal)

    return F.element_at(F.transform(F.array(F.when(txt & ~blank, picked)), build), 1)
