"""Table-driven checks of the column expressions at their boundary values."""
import pytest
from pyspark.sql import functions as F

from docweave.functions import answer as AN
from docweave.functions import paths as P
from docweave.functions import text as TX


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("b,label", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (1792, "1.8 KB"),
                                     (5 * 1024 ** 2, "5.0 MB"), (3 * 1024 ** 5, "3072.0 TB"), (1024 ** 4, "1.0 TB")])
def test_human_bytes(spark, b, label):
    assert one(spark, TX.human_bytes(F.col("v")), b, "v long") == label


@pytest.mark.parametrize("b,label", [(0, "0 B"), (999, "999 B"), (1000, "1 kB"), (1500, "1.5 kB"), (1234, "1.23 kB"),
                                     (1005, "1 kB"), (1015, "1.02 kB"), (2_500_000, "2.5 MB")])
def test_decimal_size_label(spark, b, label):
    assert one(spark, TX.decimal_size_label(F.col("v")), b, "v long") == label


@pytest.mark.parametrize("name,ext,stem,ftype", [(".env", None, ".env", "unknown"), ("a.", "", "a", ""),
                                                 ("a.tar.gz", "gz", "a.tar", "gz"), ("Makefile", None, "Makefile", "unknown"),
                                                 ("..x", "x", ".", "x")])
def test_path_parts(spark, name, ext, stem, ftype):
    r = spark.createDataFrame([(name,)], "v string").select(
        P.extension("v").alias("e"), P.stem("v").alias("s"), P.file_type("v").alias("t")).first()
    assert (r["e"], r["s"], r["t"]) == (ext, stem, ftype)


@pytest.mark.parametrize("path,base,rel", [("a/b/c", "a", "b/c"), ("a/b", "x/y", "../../a/b"), ("a", "a", ""),
                                           ("a/b", "", "a/b"), ("a/b/c", "a/b/d", "../c")])
def test_relative_path(spark, path, base, rel):
    r = spark.createDataFrame([(path, base)], "p string, b string").select(P.relative_path("p", "b").alias("r")).first()
    assert r["r"] == rel


@pytest.mark.parametrize("secs,text", [(5, "now"), (30, "30 seconds ago"), (50, "a minute ago"), (600, "10 minutes ago"),
                                       (3000, "an hour ago"), (7200, "2 hours ago"), (86400, "a day ago"),
                                       (3 * 86400, "3 days ago"), (8 * 86400, "a week ago"), (20 * 86400, "2 weeks ago"),
                                       (35 * 86400, "a month ago"), (400 * 86400, "a year ago"), (1000 * 86400, "2 years ago")])
def test_age_label(spark, secs, text):
    assert one(spark, TX.age_label_from_seconds(F.col("v")), secs, "v long") == text


def test_is_probably_text(spark):
    rows = [(b"",), (b"hello\x00",), (b"plain text\n",), ("é".encode() * 40,), (("a" * 90 + "é" * 5).encode(),)]
    got = [r["t"] for r in spark.createDataFrame(rows, "v binary").select(TX.is_probably_text("v").alias("t")).collect()]
    # 90 printable of 100 bytes -> 90 % -> text; all-accented -> binary
    assert got == [True, False, True, False, True]


def test_first_n_words_and_indent_and_sanitize(spark):
    assert one(spark, TX.first_n_words(F.col("v"), 3), "  a\tb\n\nc d ") == "a b c"
    assert one(spark, TX.first_n_words(F.col("v"), 0), "a b") == ""
    assert one(spark, TX.indent_lines(F.col("v"), 2), "a\r\nb\n") == "  a\n  b"
    assert one(spark, TX.indent_lines(F.col("v"), 2), "") == ""
    assert one(spark, TX.indent_lines(F.col("v"), 2), "a\n\n") == "  a\n  "      # one final line ending only
    assert one(spark, TX.indent_lines(F.col("v"), 2), "a\r\r\nb") == "  a\r\n  b"
    assert one(spark, TX.indent_lines(F.col("v"), 2), "\n") == "  "
    assert one(spark, TX.sanitize_yaml_text(F.col("v")), "a\x07b c\td") == "ab c\td"


def test_preview_cuts_at_character_boundary(spark):
    s = "ab" + "é" * 10
    out = one(spark, TX.preview(F.col("v"), 5), s)
    assert out == "abé… (22 bytes total)"


@pytest.mark.parametrize("raw,clean", [('"This file is a thing"', "A thing"), ("this script: does stuff", "Stuff"),
                                       ("This files hold x", "This files hold x"), ("123abc", "123Abc"),
                                       ("ß is nice", "SS is nice"), ("élan", "Élan"), ("  provides, things", "Things"),
                                       ("This configuration file - sets", "Sets"), ("", "")])
def test_clean_description(spark, raw, clean):
    assert one(spark, AN.clean_description(F.col("v")), raw) == clean


def test_parse_answer_kinds(spark):
    rows = [('{"fileDescription":"x","joyThisFileBrings":7,"personalityEmoji":"e"}', True),
            ('{"fileDescription":"x","howMuchJoyDoesThisFileBringYou":"8","emojiThatExpressesThisFilesPersonality":"y"}', True),
            ('{"fileDescription":"Broken', False), ('{"fileDescription":"No joy","personalityEmoji":"z"}', False),
            ("", False), ('{"fileDescription":5,"joyThisFileBrings":1,"personalityEmoji":"x"}', False),
            ('{"fileDescription":"E","joyThisFileBrings":null,"personalityEmoji":"x","more":1}', True),
            ('{"fileDescription":"a","joyThisFileBrings":1,"personalityEmoji":"x"} tail', False),
            ('{"fileDescription":"a","fileDescription":"b","joyThisFileBrings":1,"personalityEmoji":"x"}', False),
            ('{"fileDescription":"a","joyThisFileBrings":1,"howMuchJoyDoesThisFileBringYou":2,"personalityEmoji":"x"}', False)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "a string")
    got = [r["ok"] for r in df.select(AN.parse_answer("a").isNotNull().alias("ok")).collect()]
    assert got == [ok for _, ok in rows]


def test_emoji_presentation(spark):
    vs = "\ufe0f"
    got = [r["r"] for r in spark.createDataFrame([("x",), ("ab",), ("",), ("\U0001F418" + vs,)], "v string")
           .select(AN.emoji_presentation("v").alias("r")).collect()]
    assert got == ["x" + vs, "ab", "", "\U0001F418" + vs]


def test_text_rule_utf8_counts_accents_as_text(spark):
    rows = [("é".encode() * 40,), (b"hello\x00",), (b"\x01\x02\x03abc",), (b"",)]
    df = spark.createDataFrame(rows, "v binary")
    got = [(r["b"], r["u"]) for r in df.select(TX.is_probably_text("v").alias("b"),
                                               TX.is_probably_text("v", rule="utf8").alias("u")).collect()]
    assert got == [(False, True), (False, False), (False, False), (True, True)]


def test_backoff_schedule_and_retry():
    from docweave.operators.enrich import backoff_ms, call_with_retry
    assert [backoff_ms(a) for a in range(1, 8)] == [300, 600, 1200, 2400, 4800, 8000, 8000]
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("boom")
        return "ok"

    assert call_with_retry(flaky, sleep=waits.append, jitter=lambda: 0) == ("ok", 3, 900, None)
    assert waits == [0.3, 0.6]
    ans, attempts, waited, err = call_with_retry(lambda: (_ for _ in ()).throw(IOError("down")), sleep=lambda s: None)
    assert (ans, attempts, waited) == ("", 5, 4500) and "down" in err


def test_template_unknown_field_fails_at_plan_time(spark):
    from docweave.operators.prompt import compile_template, render
    parts = compile_template("a {{filename}} b {{ nope }}")
    assert parts == [("lit", "a "), ("field", "filename"), ("lit", " b "), ("field", "nope")]
    with pytest.raises(ValueError):
        render(parts, ["filename"])


def test_render_escapes_html_by_default(spark):
    from docweave.operators.prompt import compile_template, render
    df = spark.createDataFrame([("<a href='x'>&</a>",)], "filename string")
    parts = compile_template("[{{filename}}]")
    esc = df.select(render(parts, ["filename"]).alias("r")).first()["r"]
    raw = df.select(render(parts, ["filename"], escape_html=False).alias("r")).first()["r"]
    assert esc == "[&lt;a href&#x3D;&#x27;x&#x27;&gt;&amp;&lt;/a&gt;]" and raw == "[<a href='x'>&</a>]"


def test_state_fragments_round_trip(spark):
    """The export's fragments, read line by line, give the state they were made of."""
    from docweave.operators.hierarchy import nest_export
    from docweave.operators.state import as_state
    from docweave.plans import fixtures as FX
    from docweave.sources.state_io import read_state_fragments
    state = as_state(FX.state_v(spark, "/root/testdata/sf0.001"))
    keys = ["project", "path", "content_hash", "updated_at", "doc"]
    got = read_state_fragments(nest_export(state, F.lit(FX.RUN_TS))).select(*keys).collect()
    assert sorted(map(str, got)) == sorted(map(str, state.select(*keys).collect())) and got
