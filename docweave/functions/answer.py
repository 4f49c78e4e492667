"""Model-answer expressions: strict parse (E5), description cleaning (E6), contract report
and the reader-side fun columns (L4). VARIANT functions keep the JSON handling JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_or_lit
from .text import trim_ws

# Answer keys and their older alias keys.
KEY_DESCRIPTION = "fileDescription"
KEY_JOY = "joyThisFileBrings"
KEY_JOY_ALIAS = "howMuchJoyDoesThisFileBringYou"
KEY_EMOJI = "personalityEmoji"
KEY_EMOJI_ALIAS = "emojiThatExpressesThisFilesPersonality"
CONTRACT_KEYS = [KEY_DESCRIPTION, KEY_JOY, KEY_EMOJI]
CONTRACT_MIN_DESCRIPTION = 16
CONTRACT_JOY_RANGE = (1, 10)

# Leading phrases dropped from descriptions (fixed values).
LEAD_NOUNS = r"file|script|module|class|service|program|document|config(?:uration)?(?:\s+file)?|shell\s+script"
LEAD_VERBS = r"is|does|provides|contains"
RE_LEAD = r"(?iU)^\s*this\s+(?:" + LEAD_NOUNS + r")\b[,:;\-\s]*"
RE_VERB = r"(?iU)^\s*(?:" + LEAD_VERBS + r")\b[,:;\-\s]*"
EMOJI_VS16 = "\ufe0f"
INT_TYPES = ["TINYINT", "SMALLINT", "INT", "BIGINT"]


def _field(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _vtype(x: Column) -> Column:
    return F.schema_of_variant(x)


def parse_answer(answer) -> Column:
    """Strict parse of a model answer into ``struct<description, joy, emoji>`` or null.

    Accepted: a JSON object (surrounding whitespace allowed) that has a text description, a joy
    value of any JSON type (under the key or its alias, not both) and a text emoji (key or alias,
    not both). Extra keys are ignored. Duplicate keys, cut or trailing text, empty text: null.
    ``joy`` is kept as compact JSON text; ``description`` is returned raw (see ``clean_description``).
    """
    a = col_or_lit(answer)
    v = F.try_parse_json(a)
    framed = trim_ws(a).rlike(r"(?s)^\{.*\}$")
    is_obj = _vtype(v).startswith("OBJECT")
    desc = _field(v, KEY_DESCRIPTION)
    joy_p, joy_a = _field(v, KEY_JOY), _field(v, KEY_JOY_ALIAS)
    emo_p, emo_a = _field(v, KEY_EMOJI), _field(v, KEY_EMOJI_ALIAS)
    joy = F.coalesce(joy_p, joy_a)
    emo = F.coalesce(emo_p, emo_a)
    ok = (
        framed & v.isNotNull() & is_obj
        & (_vtype(desc) == "STRING")
        & (joy_p.isNull() | joy_a.isNull()) & joy.isNotNull()
        & (emo_p.isNull() | emo_a.isNull()) & (_vtype(emo) == "STRING")
    )
    doc = F.struct(
        F.variant_get(desc, "$", "string").alias("description"),
        F.to_json(joy).alias("joy"),
        F.variant_get(emo, "$", "string").alias("emoji"),
    )
    return F.when(F.coalesce(ok, F.lit(False)), doc)


def capitalize_first_alpha(s) -> Column:
    """Upper-case the first alphabetic character wherever it is (e.g. after digits), then trim."""
    c = col_or_lit(s)
    pat = r"(?s)^([^\p{IsAlphabetic}]*)(\p{IsAlphabetic})(.*)$"
    has = c.rlike(pat)
    out = F.concat(F.regexp_extract(c, pat, 1), F.upper(F.regexp_extract(c, pat, 2)), F.regexp_extract(c, pat, 3))
    return trim_ws(F.when(has, out).otherwise(c))


def clean_description(raw) -> Column:
    """Trim; strip quotes at both ends; drop one leading 'this file/script/...' phrase, then one
    leading is/does/provides/contains; upper-case the first letter; trim."""
    s = trim_ws(col_or_lit(raw))
    s = F.regexp_replace(s, r"^['\"]+|['\"]+$", "")
    s = F.regexp_replace(s, RE_LEAD, "")
    s = F.regexp_replace(s, RE_VERB, "")
    return capitalize_first_alpha(s)


def joy_text(joy_json) -> Column:
    """Reader-side joy: null -> '', JSON text -> unquoted, anything else -> compact JSON."""
    j = col_or_lit(joy_json)
    v = F.try_parse_json(j)
    return (F.when(j.isNull() | (j == "null"), F.lit(""))
            .when(_vtype(v) == "STRING", F.variant_get(v, "$", "string"))
            .otherwise(F.coalesce(F.to_json(v), j)))


def emoji_presentation(s) -> Column:
    """A single code point without U+FE0F gets U+FE0F appended; anything else unchanged."""
    c = col_or_lit(s)
    return F.when((F.length(c) == 1) & (F.instr(c, EMOJI_VS16) == 0), F.concat(c, F.lit(EMOJI_VS16))).otherwise(c)


def contract_violations(answer) -> Column:
    """Data-quality report against the answer contract sent to the model, as a comma list.

    Codes, in order: not_json, missing_description, description_type, description_short,
    missing_joy, joy_not_1_to_10, missing_emoji, emoji_type, extra_keys. Empty text when clean.
    """
    a = col_or_lit(answer)
    v = F.try_parse_json(a)
    framed = trim_ws(a).rlike(r"(?s)^\{.*\}$")
    obj = F.coalesce(framed & _vtype(v).startswith("OBJECT"), F.lit(False))
    desc, joy, emo = _field(v, KEY_DESCRIPTION), _field(v, KEY_JOY), _field(v, KEY_EMOJI)
    jl = F.try_variant_get(joy, "$", "long")
    keys = F.json_object_keys(a)
    extra = F.size(F.filter(keys, lambda k: ~k.isin(*CONTRACT_KEYS))) > 0
    checks = [
        (~obj, "not_json"),
        (obj & desc.isNull(), "missing_description"),
        (obj & desc.isNotNull() & (_vtype(desc) != "STRING"), "description_type"),
        (obj & (_vtype(desc) == "STRING") & (F.length(F.variant_get(desc, "$", "string")) < CONTRACT_MIN_DESCRIPTION),
         "description_short"),
        (obj & joy.isNull(), "missing_joy"),
        (obj & joy.isNotNull() & ~(_vtype(joy).isin(*INT_TYPES) & jl.between(*CONTRACT_JOY_RANGE)), "joy_not_1_to_10"),
        (obj & emo.isNull(), "missing_emoji"),
        (obj & emo.isNotNull() & (_vtype(emo) != "STRING"), "emoji_type"),
        (obj & F.coalesce(extra, F.lit(False)), "extra_keys"),
    ]
    return F.concat_ws(",", *[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in checks])
