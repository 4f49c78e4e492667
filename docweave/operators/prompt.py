"""Prompt fields (E1) and rendering.

The template is split once on the driver into literals and field names; rendering is then one
``concat`` expression per message, evaluated inside whole-stage codegen. Unknown field names fail
at plan time. The answer is a structured message set, so there is no YAML round trip.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as TX

FIELD_RE = re.compile(r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}")

# Our own prompt wording. Placeholders name the prompt fields.
DEFAULT_TEMPLATE = {
    "system": "You write one-line documentation for files in a source tree or document collection.",
    "user_before": (
        "Document the file described below.\n\n"
        "Path: {{filename}}\n"
        "Size: {{filesize}}\n"
        "Extension: {{filetype}}\n"
        "Content type: {{mimetype}}\n"
        "Operating system: {{operating_system}}\n"
        "The project has a README: {{project_is_documented}}\n\n"
        "Beginning of the project README:\n{{project_documentation}}\n\n"
        "Beginning of the file:\n{{chunk_one}}\n\n"
        "Middle of the file:\n{{chunk_two}}\n\n"
        "End of the file:\n{{chunk_three}}\n\n"
        "Reply with a JSON object only. fileDescription: a single declarative sentence of at most sixty "
        "characters that names the purpose of the file, opens with a verb and does not open with the word "
        "This or repeat the file name {{filename}}. joyThisFileBrings: a whole number from 1 to 10 for how "
        "pleasant the file is to read. personalityEmoji: one emoji that fits the file."
    ),
    "user_after": "",
}

# The answer contract sent with every request (checked locally only as a report, see E7).
ANSWER_SCHEMA = {
    "type": "object",
    "properties": {
        "fileDescription": {"type": "string", "minLength": 16},
        "joyThisFileBrings": {"type": "integer", "enum": list(range(1, 11))},
        "personalityEmoji": {"type": "string"},
    },
    "required": ["fileDescription", "joyThisFileBrings", "personalityEmoji"],
    "additionalProperties": False,
}
ANSWER_SCHEMA_JSON = json.dumps(ANSWER_SCHEMA, separators=(",", ":"))

FIELDS = ["filename", "filesize", "filetype", "mimetype", "operating_system", "project_is_documented",
          "project_documentation", "chunk_one", "chunk_two", "chunk_three"]
EXTRA_FIELDS = ["filename_re", "filename_stem_re"]


def compile_template(text: str) -> list[tuple[str, str]]:
    """Split a template into ``[('lit', text) | ('field', name)]`` parts (driver side, once)."""
    parts, pos = [], 0
    for m in FIELD_RE.finditer(text):
        if m.start() > pos:
            parts.append(("lit", text[pos:m.start()]))
        parts.append(("field", m.group(1)))
        pos = m.end()
    if pos < len(text):
        parts.append(("lit", text[pos:]))
    return parts


def prompt_fields(df: DataFrame, root_prefix: str = "/", operating_system: str = "linux") -> DataFrame:
    """Adds the ten prompt fields and the escaped-name extras to ``df`` (one projection).

    Input columns: project, path, name, extension, size, file_type, content_type, documented,
    snippet and ``chunks`` (struct first/mid/last). README snippet and chunks are sanitized, then
    indented by two.
    """
    def prep(c):
        return TX.indent_lines(TX.sanitize_yaml_text(c), 2)

    name = F.col("name") if "name" in df.columns else P.path_name("path")
    stem = P.stem(name)
    # the README field has one value per project: use it when the context already carries it prepared
    doc = F.col("project_documentation") if "project_documentation" in df.columns else prep(F.col("snippet"))
    keep = [c for c in df.columns if c != "project_documentation"]
    return df.select(
        *keep,
        F.concat(F.lit(root_prefix), F.col("project"), F.lit("/"), F.col("path")).alias("filename"),
        TX.human_bytes("size").alias("filesize"),
        F.col("file_type").alias("filetype"),
        F.col("content_type").alias("mimetype"),
        F.lit(operating_system).alias("operating_system"),
        F.col("documented").alias("project_is_documented"),
        doc.alias("project_documentation"),
        prep(F.col("chunks.first")).alias("chunk_one"),
        prep(F.col("chunks.mid")).alias("chunk_two"),
        prep(F.col("chunks.last")).alias("chunk_three"),
        TX.regex_escape(name).alias("filename_re"),
        TX.regex_escape(stem).alias("filename_stem_re"),
    )


def render(parts: list[tuple[str, str]], available: list[str], escape_html: bool = True) -> Column:
    """One ``concat`` over literals and (optionally HTML-escaped) field columns."""
    cols = []
    for kind, v in parts:
        if kind == "lit":
            cols.append(F.lit(v))
        else:
            if v not in available:
                raise ValueError(f"template names unknown field {v!r}; known: {sorted(available)}")
            c = F.coalesce(F.col(v), F.lit(""))
            cols.append(TX.html_escape(c) if escape_html else c)
    return F.concat(*cols) if cols else F.lit("")


def render_prompt(fields: DataFrame, template: dict | None = None, escape_html: bool = True) -> DataFrame:
    """``project, path, content_hash, system, user, prompt_hash``; the user message is the text
    before the (empty) question followed by the text after it."""
    t = template or DEFAULT_TEMPLATE
    avail = FIELDS + EXTRA_FIELDS
    system = render(compile_template(t.get("system", "")), avail, escape_html)
    user = F.concat(render(compile_template(t.get("user_before", "")), avail, escape_html),
                    render(compile_template(t.get("user_after", "")), avail, escape_html))
    out = fields.select("*", system.alias("system"), user.alias("user"))
    return out.withColumn("prompt_hash", F.sha2(F.concat_ws("\n", "system", "user"), 256))
