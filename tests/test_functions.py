import colorsys
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from loomkit.functions import color, dates, hooks, text
from loomkit.functions.text import wrap_lines
from loomkit.sources import files


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_wide_text(spark):
    assert one(spark, text.display_width(F.lit("a漢Ｆ｡"))) == 6
    assert one(spark, text.tokenize(F.lit("ab 漢c　d"))) == ["ab", " ", "漢", "c", "　", "d"]
    assert one(spark, text.tokenize(F.lit(""))) == [""]
    assert one(spark, text.char_type(F.lit("　"))) == "SPACE"
    assert one(spark, text.char_type(F.lit("漢"))) == "ASIAN"
    assert one(spark, text.normalize_whitespace(F.lit(" a \n\x1c b "))) == "a b"
    assert one(spark, text.split_long_token(F.lit("abcdefg"), 3)) == ["abc", "def", "g"]
    assert one(spark, text.initial_letter(F.lit(""))) is None


def test_templates(spark):
    m = {"Main": "blue", "Mainly": "red$1"}
    assert one(spark, text.render_template(F.lit("--Main --Mainly --{Main}x --Other ----"), m)) == "blue red$1 bluex --Other --"


@pytest.mark.parametrize(("line", "width", "want"), [
    ("aaa bbb", 3, "aaa\nbbb"), ("aaa", 3, "aaa"), ("漢漢漢", 4, "漢漢\n漢"), ("abcdefgh", 3, "abc\ndef\ngh"), ("", 5, ""), ("a\x0bb", 5, "a\nb"),
    ("a bbb c", 3, "a\nbbb\n c"), ("abcdef gh", 3, "abc\ndef\n gh"), ("aaa b", 3, "aaa\nb")])
def test_wrap(line, width, want):
    assert wrap_lines(line, width)[0] == want


@pytest.mark.parametrize(("whole", "want"), [("aaa bbb ccc", "aaa\nbbb ccc"), ("aa", "aa"), ("x\naaa bbb", "xaaa\nbbbbb"), ("", "")])
def test_wrap_once(whole, want):
    assert wrap_lines(whole, 3, once=True)[0] == want


def test_wrap_column_keeps_null(spark):
    df = spark.createDataFrame([("aaa bbb",), (None,)], "t string").select(text.wrap_text(F.col("t"), 3).alias("w"))
    assert [r.w and r.w.text for r in df.collect()] == ["aaa\nbbb", None]


def test_colours(spark):
    for rgb in [(1, 2, 3), (255, 0, 0), (9, 9, 9), (10, 250, 250), (0, 0, 0)]:
        h = one(spark, color.rgb_to_hsv(*map(F.lit, rgb)))
        want = colorsys.rgb_to_hsv(*(x / 255 for x in rgb))
        assert (h.h / 360, h.s, h.v) == pytest.approx(want)
        back = one(spark, color.hsv_to_rgb(F.lit(h.h), F.lit(h.s), F.lit(h.v)))
        assert all(abs(a - b) <= 1 for a, b in zip(rgb, back, strict=True))
    assert tuple(one(spark, color.parse_hex_color(F.lit("#80FF0001"), "#000000"))) == (255, 0, 1, 128)
    assert tuple(one(spark, color.parse_hex_color(F.lit("nope"), "#010203"))) == (1, 2, 3, 255)


def test_shades_of_a_dark_theme(spark):
    got = {x.shade: (x.r, x.g, x.b) for x in one(spark, color.shade_colors(F.lit("#009FAA"), "#000000", dark=True))}
    h, s, _ = colorsys.rgb_to_hsv(0, 0x9F / 255, 0xAA / 255)
    for shade, a, v in [("primary", 1, 1), ("dark1", 1, 0.9), ("dark2", 0.977, 0.82), ("dark3", 0.95, 0.7), ("light1", 0.92, 1), ("light2", 0.78, 1), ("light3", 0.65, 1)]:
        want = [255 * x for x in colorsys.hsv_to_rgb(h, min(1, s * 0.84 * a), v)]
        assert all(abs(x - y) <= 0.51 for x, y in zip(got[shade], want, strict=True))
    assert tuple(one(spark, color.scale_to_side(F.lit(300), F.lit(200), 100))) == (150, 100)
    assert tuple(one(spark, color.scale_to_side(F.lit(300), F.lit(0), 100, "width"))) == (100, 1)


def test_styles_change_only_before_their_end(spark):
    assert one(spark, text.restyled(F.lit("a \n"), F.lit("a"))) == "a \n"
    assert one(spark, text.restyled(F.lit("a"), F.lit("ab "))) == "ab " and one(spark, text.restyled(F.lit(None).cast("string"), F.lit("b"))) == "b"


def test_dates(spark):
    assert one(spark, dates.to_12h(F.lit(0))).hour == 12
    assert one(spark, dates.from_12h(F.lit(12), F.lit("AM"))) == 0
    assert one(spark, dates.format_duration(F.lit(3_723_999))) == "1:02:03"
    assert one(spark, dates.decode_month(dates.encode_month(F.lit(7)))) == 7
    assert one(spark, dates.pad2(F.lit(123))) == "123"


def token_by_token(line, width):
    """The rows of a wide line, one token after the other."""
    wide = lambda c: unicodedata.east_asian_width(c) in "FW"
    tokens = []
    for c in line:
        if c.isspace() or wide(c) or not tokens or tokens[-1].isspace() or wide(tokens[-1][0]):
            tokens.append(c)
        else:
            tokens[-1] += c
    size = lambda s: sum(2 if wide(c) else 1 for c in s)
    out, row, used = [], "", 0
    for t in tokens:
        if t == " " and not used:
            continue
        fits = used + size(t) <= width
        if not fits and used:
            out, row, used = [*out, row.rstrip()], "", 0
        while size(t) > width and len(t) > width:
            out, t = [*out, t[:width]], t[width:]
        row, used = row + t, used + size(t)
        if fits and used == width:
            out, row, used = [*out, row.rstrip()], "", 0
    return [*out, row.rstrip()] if row else out


@pytest.mark.parametrize("letters", ["ab ", "abé ", "aé 日", "日 ", "abcdefgh日  "])
def test_rows_equal_those_of_tokens_one_by_one(letters):
    r = random.Random(letters)
    for _ in range(8000):
        line, width = " ".join("".join(r.choice(letters) for _ in range(r.randrange(30))).split()), r.randrange(1, 9)
        want = token_by_token(line, width)
        assert text.wrap_lines(line, width)[0] == ("\n".join(want) if sum(2 if unicodedata.east_asian_width(c) in "FW" else 1 for c in line) > width else line)


def test_templates_are_filled_once(spark):
    cases = {"--A": "--B", "--B": "blue", "----A": "--A", "------B": "--blue", "--{A}x--Ax --{ A} --": "--Bx--Ax --{ A} --", "-----B": "---B", "a\x00b": "a\x00b", "--": "--", "": "", "---B-": "---B-"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "t string, want string")
    got = df.select("t", "want", text.render_template(F.col("t"), {"A": "--B", "B": "blue"}).alias("got")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got]


def test_texts_that_look_like_groups(spark):
    docs = spark.createDataFrame([(1, '{"a":"{x}","b":{"c":"{\\"z\\":1}","d":null},"e":[1],"f":{},"g":1.5}'), (2, "nope"), (3, "[1]"), (4, None), (5, "{}")], "entity_id long, json string")
    assert sorted(map(repr, (tuple(r) for r in files.read_settings(docs).collect()))) == sorted(map(repr, [(1, "a", "{x}"), (1, "b.c", '{"z":1}'), (1, "b.d", None), (1, "e", "[1]"), (1, "g", "1.5")]))


def test_expressions_that_fail_have_the_default(spark):
    df = spark.createDataFrame([("1",), ("x",)], "t string")
    got = df.select(hooks.or_default(F.col("t").try_cast("int"), -1, F.concat(F.col("t"), F.lit(" is no number"))).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [(1, None), (-1, "x is no number")]


def test_wrapping_takes_a_few_texts_at_a_time(spark, monkeypatch):
    """Rows, nulls among them, over several pieces of a batch; rows go on as pieces are done."""
    from pyspark.util import PythonEvalType

    monkeypatch.setattr(text, "ROWS_PER_PIECE", 3)
    texts = [None if n % 4 == 3 else "word " * n + "漢字" * n for n in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(1)
    for once in (False, True):
        out = df.select("n", text.wrap_text(F.col("t"), 9, once).alias("w"))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        got = {r.n: r.w and tuple(r.w) for r in out.collect()}
        assert got == {n: (None, None) if t is None else text.wrap_lines(t, 9, once) for n, t in enumerate(texts)}
        assert f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in plan
