import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomkit.functions import hooks
from loomkit.operators import aggregates, images, lookups, sequences, settings
from loomkit.sources import files
from loomkit.streaming import jobs


def test_folds():
    push = lambda *k: [("push", x) for x in k]
    assert sequences.replay(push("a", "a", "b") + [("pop", "")] + push("c", "a") + [("remove", "c")]) == ["a"]
    assert sequences.replay([("pop", ""), *push("home")], "home") == ["home"]
    assert sequences.replay([*push("a", "home", "b"), ("remove", "home"), ("remove", "a"), ("remove", "b")], "home") == ["home"]
    assert sequences.trail(push("a", "b", "a", "c") + [("select", "a")]) == ["a"]


@pytest.mark.parametrize("mode", ["constant", "linear", "quadratic", "cosine"])
def test_kernels_sum_to_one(mode):
    assert sequences.kernel(mode).sum() == pytest.approx(1, abs=0.002)
    assert sequences.kernel(mode)[12] == pytest.approx({"constant": 1 / 24, "quadratic": 1 / 16}.get(mode, 1 / 12))


def test_impulses_in_whole_steps(spark):
    e = spark.createDataFrame([("k", 0, 120.0), ("k", 16, 120.0)], "key string, ms long, delta double").selectExpr("*", "timestamp_millis(ms) AS ts")
    got = {r.frame: r.delta for r in sequences.spread_impulses(e, "key", "ts", "delta", whole=True).collect()}
    assert len(got) == 25 and got[0] == 0 and got[1] == 1 and got[2] == 2 and got[12] == 19 and got[24] == 1


def test_what_is_no_number_falls_to_the_default(spark):
    schema = spark.createDataFrame([("r", "range", 5.0, 9.0, None, "7"), ("c", "color", None, None, None, "#000000")], "key string, kind string, min double, max double, options array<string>, default string")
    got = settings.overlay_settings(spark.createDataFrame([(1, "r", "abc"), (1, "c", "#FFFFFF\n"), (2, "r", "6.5")], "entity_id long, key string, value string"), schema)
    assert {(r.entity_id, r.key, r.value) for r in got.collect()} == {(1, "r", "7"), (1, "c", "#000000"), (2, "r", "6.5"), (2, "c", "#000000")}


def test_pack_and_budget(spark):
    items = spark.createDataFrame([(1, 0, 50), (1, 1, 60), (1, 2, 30), (2, 0, 500)], "group_id long, pos long, size long")
    rows = sequences.pack_rows(items.withColumn("height", F.lit(1)), 100, 5).orderBy("group_id", "pos").collect()
    assert [r.row for r in rows] == [0, 1, 1, 0]
    shown = aggregates.fit_budget_tail(items, 100, 10).orderBy("group_id", "pos").collect()
    assert [r.shown for r in shown] == [False, True, True, True]


def test_settings_round_trip_and_rules(spark):
    docs = spark.createDataFrame([(1, '{"a": {"x": "1", "y": "2"}, "z": "3"}'), (2, "no json")], "entity_id long, json string")
    values = files.read_settings(docs)
    assert {(r.key, r.value) for r in values.collect()} == {("a.x", "1"), ("a.y", "2"), ("z", "3")}
    written = files.write_settings(values)
    assert written.first().json == '{"a":{"x":"1","y":"2"},"z":"3"}'
    assert {(r.key, r.value) for r in files.read_settings(written).collect()} == {("a.x", "1"), ("a.y", "2"), ("z", "3")}
    schema = spark.createDataFrame([("a.x", "range", 5.0, 9.0, None, "7"), ("o", "option", None, None, ["p", "q"], "q")], "key string, kind string, min double, max double, options array<string>, default string")
    got = settings.overlay_settings(spark.createDataFrame([(1, "a.x", "1"), (1, "o", "bad"), (2, "u", "1")], "entity_id long, key string, value string"), schema)
    assert {(r.entity_id, r.key, r.value) for r in got.collect()} == {(1, "a.x", "5"), (1, "o", "p"), (2, "a.x", "7"), (2, "o", "q")}


def test_empty_prefix_gives_the_dictionary_by_length(spark):
    words = spark.createDataFrame([("Bb", "1", 1), ("a", "2", 2), ("a1", "3", 3), ("bb", "4", 4)], "key string, value string, seq long")
    asked = spark.createDataFrame([(1, ""), (2, "B"), (3, "9")], "query_id long, prefix string")
    got = lookups.prefix_lookup(asked, words, 10)
    assert sorted((r.query_id, r["rank"], r.key, r.value) for r in got.collect()) == [(1, 1, "a", "2"), (1, 2, "bb", "4"), (2, 1, "bb", "4")]


def test_hidden_inner_node_cuts_its_subtree(spark):
    schema = "parent string, child string, pos int, hidden boolean"
    e = spark.createDataFrame([(None, "r", 1, True), ("r", "a", 0, True), ("a", "b", 0, False), ("r", "c", 2, False), ("r", "d", 1, False), ("d", "e", 0, False), (None, "q", 0, False), ("q", "f", 0, False)], schema)
    assert [r.node for r in lookups.visible_nodes(e).orderBy("depth", "path").collect()] == ["q", "r", "f", "d", "c", "e"]
    ring = spark.createDataFrame([(None, "r", 0, False), ("r", "a", 0, False), ("a", "b", 0, False), ("b", "a", 0, False)], schema)
    assert sorted(r.node for r in lookups.visible_nodes(ring).collect()) == ["a", "b", "r"]
    assert lookups.visible_nodes(e.where("false")).count() == 0


def test_prefixes_of_any_length_and_no_limit(spark):
    words = spark.createDataFrame([(w, w, i) for i, w in enumerate(("apple", "apply", "app", "zebra"))], "key string, value string, seq long")
    asked = spark.createDataFrame([(1, "appl"), (2, "zebras"), (3, ""), (4, "appl"), (5, None)], "query_id long, prefix string")
    got = sorted((r.query_id, r.key) for r in lookups.prefix_lookup(asked, words).collect())
    assert got == [(1, "apple"), (1, "apply"), (3, "app"), (3, "apple"), (3, "apply"), (3, "zebra"), (4, "apple"), (4, "apply")]


def test_find_first_by_text_and_data(spark):
    items = spark.createDataFrame([(1, 3, "Beta", "x"), (1, 1, "beta", "y"), (1, 2, "Beta", "y"), (1, 0, None, None)], "list_id long, idx int, text string, data string")
    q = lambda *p: spark.createDataFrame([(1, x) for x in p], "list_id long, probe string")
    first = lambda *p, **k: {r.probe: r.idx for r in lookups.find_first(q(*p), items, **k).collect()}
    assert first("Beta", "beta", "no", None) == {"Beta": 2, "beta": 1, "no": -1, None: -1}
    assert first("BETA", match="fixed") == {"BETA": 1} and first("y", by="data") == {"y": 1}
    assert first("Be", "", match="starts") == {"Be": 2, "": 1} and first("ta", match="ends") == {"ta": 1} and first("et", "q", match="contains") == {"et": 1, "q": -1}
    assert lookups.find_first(q("Beta", "Beta"), items).count() == 2


def test_first_spelling_and_several_catalogues(spark):
    real = spark.createDataFrame([("arial", 0), ("Arial", 1), ("ARIAL", 2), ("Sans", 3)], "real_name string, pos int")
    a = spark.createDataFrame([("A", "x", ["none", "ARIAL"]), ("B", "x", ["sans", "arial"]), ("C", "x", ["no"])], "name string, grp string, aliases array<string>")
    assert {(r.name, r.real_name) for r in lookups.resolve_alias(a, real).collect()} == {("A", "arial"), ("B", "Sans")}
    cat = lambda *rows: spark.createDataFrame([("c", *r) for r in rows], "context string, source string, translation string, locale string")
    df = spark.createDataFrame([("c", "Yes"), ("c", "No"), ("c", "Off")], "context string, source string")
    got = lookups.localize(df, cat(("Yes", "Ja", "de"), ("No", "Nein", "de"), ("Off", "Non", "fr")), cat(("Yes", "Jo", "de"), ("No", None, "de")), locale="de")
    assert {r.source: r.text for r in got.collect()} == {"Yes": "Jo", "No": "Nein", "Off": "Off"}


def test_rules_can_be_added_and_changes_flagged(spark):
    schema = spark.createDataFrame([("n", "even", None, None, None, "0", True), ("o", "text", None, None, None, "-", False)], "key string, kind string, min double, max double, options array<string>, default string, restart boolean")
    old = spark.createDataFrame([(1, "n", "3"), (1, "o", "x"), (1, "o", "w"), (2, "n", "4")], "entity_id long, key string, value string")
    settings.validator("even")(lambda v, item: F.when(v.cast("int") % 2 == 0, v).otherwise(item("default")))
    settings.SERIALIZERS["even"] = (lambda c: F.concat(F.lit("n"), c), lambda c: c)
    try:
        new = settings.overlay_settings(old, schema)
        assert {tuple(r) for r in new.collect()} == {(1, "n", "0"), (1, "o", "x"), (2, "n", "4"), (2, "o", "-")}
        got = {tuple(r) for r in settings.changed_settings(old.where("value <> 'w'"), new, schema).collect()}
        assert got == {(1, "n", "3", "0", True), (2, "o", None, "-", False)}
        assert spark.range(1).select(settings.serialize(F.lit("4"), F.lit("even")).alias("x")).first().x == "n4"
    finally:
        del settings.VALIDATORS["even"], settings.SERIALIZERS["even"]


def test_products_in_chunks_equal_the_steps_one_by_one(spark):
    import random

    r = random.Random(1)
    rows = [(u, n, r.random() < p) for u, p in ((1, 0.5), (2, 0.9), (3, 0.1)) for n in range(50)]
    want = {}
    for u, _, up in rows:
        want[u] = max(0.1, min(10.0, want.get(u, 1.0) * (1.25 if up else 0.8)))
    df = spark.createDataFrame(rows, "user_id long, n long, up boolean").repartition(3)
    got = {x.user_id: x.zoom for x in sequences.clamped_running_product(df, "user_id", ["n"], "up", chunk=7).collect()}
    assert got == pytest.approx(want)


def test_rows_that_fail_get_the_default(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "t string").select("t", hooks.with_default(lambda t: int(t), "int", 7)(F.col("t")).alias("r"))
    got = {r.t: (r.r.value, (r.r.error or "").split(":")[0]) for r in df.collect()}
    assert got == {"1": (1, ""), "x": (7, "ValueError"), None: (7, "TypeError")}


def test_a_correction_is_carried_to_the_next_row_of_sub(spark):
    rows = [(1, 1, 0, "main", 0, True), (1, 2, 10, "sub", 0, True), (1, 3, 250, "main", 200, True), (1, 4, 450, "main", 300, True), (1, 5, 650, "main", 360, True), (1, 6, 850, "sub", 100, True)]
    p = spark.createDataFrame(rows, "session_id long, event_id long, ms long, track string, position long, playing boolean").selectExpr("*", "timestamp_millis(ms) AS ts")
    assert sorted(tuple(r) for r in sequences.drift_ticks(p).collect()) == [(1, 1, 200, 0), (1, 3, 360, 200), (1, 4, 360, 100)]


def test_streamed_drift_counts_paused_rows_and_ties(spark, tmp_path):
    from loomkit.plans.catalogue import _drained

    rows = [(1, 1, 0, "main", 1000.0, True), (1, 2, 10, "sub", 0.0, True), (1, 3, 20, "sub", 0.0, False), (2, 4, 0, "main", 1000.0, True), (2, 5, 10, "sub", 900.0, True), (2, 6, 10, "sub", 0.0, True), (9, 7, 10_000, "sub", 0.0, True)]
    p = spark.createDataFrame(rows, "session_id long, event_id long, ms long, track string, position double, playing boolean").selectExpr("*", "timestamp_millis(ms) AS ts")
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = jobs.stream_drift(spark.readStream.schema(p.schema).parquet(str(tmp_path / "in")))
    assert [(r.session_id, r.main, r["sub"]) for r in _drained(s, "append").collect()] == [(2, 1000.0, 0.0)]


def image(a):
    return (a.shape[1], a.shape[0], a.shape[2], a.tobytes())


def test_images(spark):
    flat = np.full((9, 7, 3), 100, np.uint8)
    rgba = np.dstack([flat, np.arange(63, dtype=np.uint8).reshape(9, 7)])
    df = spark.createDataFrame([("flat", *image(flat)), ("rgba", *image(rgba)), ("bad", 5, 5, 3, b"x")], "image_id string, width int, height int, channels int, data binary")
    got = {r.image_id: r for r in images.gaussian_blur(df, 2).collect()}
    assert bytes(got["flat"].data) == flat.tobytes()
    assert (images.pixels(got["rgba"])[:, :, 3] == rgba[:, :, 3]).all()
    assert got["bad"].data is None and got["bad"].error
    assert {(r.width, r.height) for r in images.cover_crop(df, 5).collect() if r.data} == {(5, 5)}
    colours = {r.image_id: (r.r, r.g, r.b) for r in images.dominant_color(df).collect()}
    assert colours["bad"] == images.DEFAULT_COLOR
    assert images.choose([(90, 90, 90)]) == images.DEFAULT_COLOR


def test_palettes_of_gray_tied_and_large_images():
    close = lambda a, b: max(abs(x - y) for x, y in zip(a, b, strict=True)) <= 1
    assert close(images.choose([(40, 40, 40), (30, 60, 90), (90, 90, 90)]), (30, 60, 90))
    assert close(images.choose([(60, 50, 55), (10, 90, 60)]), (10, 90, 60))
    # The most colourful one may be left out: only the first five are looked at.
    assert close(images.choose([(60, 50, 55)] * 5 + [(10, 90, 60)]), (60, 50, 55))
    wide = np.zeros((3, 900, 3), np.uint8)
    wide[:, 450:] = (200, 30, 60)
    assert {tuple(c) for c in images.palette(wide)} >= {(0, 0, 0), (200, 30, 60)}
    assert images.palette(np.full((1, 1, 1), 7, np.uint8)) == [(7, 7, 7)]


def test_a_late_row_is_dropped_from_the_streamed_drift(spark, tmp_path):
    from loomkit.plans.catalogue import _drained

    schema = "session_id long, event_id long, ms long, track string, position double, playing boolean"
    parts = [[(1, 1, 0, "main", 1000.0, True), (1, 2, 10, "sub", 0.0, True)], [(9, 3, 60_000, "sub", 0.0, True)], [(9, 6, 90_000, "sub", 0.0, True)], [(1, 4, 20, "sub", 990.0, True), (9, 5, 120_000, "sub", 0.0, True)]]
    for k, rows in enumerate(parts):
        before = set((tmp_path / "in").glob("*.parquet"))
        spark.createDataFrame(rows, schema).selectExpr("*", "timestamp_millis(ms) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for new in set((tmp_path / "in").glob("*.parquet")) - before:
            os.utime(new, (1_700_000_000 + 60 * k,) * 2)  # files are read by age
    kind = spark.read.parquet(str(tmp_path / "in")).schema
    s = jobs.stream_drift(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    assert [(r.session_id, r.main, r["sub"]) for r in _drained(s, "append").collect()] == [(1, 1000.0, 0.0)]


def test_turned_marks():
    mark = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    for degrees, want in [(0, mark), (90, np.rot90(mark, -1)), (180, mark[::-1, ::-1]), (-90, np.rot90(mark))]:
        cover, got = images.turned(mark, degrees, want.shape[1], want.shape[0])
        assert (cover == 1).all() and (got == want).all()
    cover, got = images.turned(mark, 45, 4, 4)
    assert 0 <= cover.min() < 0.01 and 0.99 < cover.max() <= 1.0001
    # Colours count as much as the mark covers.
    flat = np.dstack([np.full((5, 5, 3), 80), np.full((5, 5), 51)]).astype(np.uint8)
    cover, got = images.turned(flat, 30, 7, 7)
    assert np.allclose(got, cover[:, :, None] * 80) and np.isclose(cover.max(), 0.2)


def test_marks_stand_at_anchors_and_are_cut_where_they_stand_out(spark):
    flat = np.zeros((5, 7, 3), np.uint8)
    rows = [(f"{k}", *image(flat), m, k, 100, 100, 0) for k in range(9) for m in (0,)] + [("wide", *image(flat), 1, 4, 100, 100, 0), ("none", *image(flat), 7, 4, 100, 100, 0), ("null", *image(flat), 0, None, 100, 100, 0), ("double", *image(flat), 0, 0, 50, 200, 0)]
    df = spark.createDataFrame(rows, "image_id string, width int, height int, channels int, data binary, mark_id int, anchor int, opacity int, zoom int, rotation int")
    marks = spark.createDataFrame([(0, *image(np.full((1, 3, 3), 200, np.uint8))), (1, *image(np.full((9, 9, 1), 50, np.uint8)))], "mark_id int, width int, height int, channels int, data binary")
    got = {r.image_id: r for r in images.watermark_rows(df, marks).collect()}
    for k in range(9):
        a = images.pixels(got[f"{k}"])[:, :, 0]
        y, x = np.argwhere(a == 200).min(0)
        assert (y, x) == (k // 3 * 2, k % 3 * 2) and (a > 0).sum() == 3
    assert (images.pixels(got["wide"]) == 50).all()
    assert got["none"].error and got["null"].error and got["none"].data is None
    a = images.pixels(got["double"])[:, :, 0]
    assert (a[:2, :6] == 100).all() and (a > 0).sum() == 12


def slow_resize(a, w, h):
    """Pixel by pixel: a triangle as wide as the sampling."""
    out = np.zeros((h, w, a.shape[2]))
    sy, sx = max(a.shape[0] / h, 1), max(a.shape[1] / w, 1)
    for y in range(h):
        for x in range(w):
            total = 0
            for j in range(a.shape[0]):
                for i in range(a.shape[1]):
                    k = max(0, 1 - abs(j + 0.5 - (y + 0.5) * a.shape[0] / h) / sy) * max(0, 1 - abs(i + 0.5 - (x + 0.5) * a.shape[1] / w) / sx)
                    out[y, x] += k * a[j, i]
                    total += k
            out[y, x] /= total
    return np.rint(np.round(out, 9))


@pytest.mark.parametrize("size", [(4, 3), (7, 9), (20, 5), (1, 1), (13, 11)])
def test_resizing_equals_the_sum_over_all_pixels(size):
    a = np.random.default_rng(2).integers(0, 256, (11, 13, 3)).astype(np.uint8)
    assert (images.resize(a, *size) == slow_resize(a, *size)).all()
    assert (images.every(a, 4, size) == slow_resize(a, *size).reshape(-1, 3)[::4]).all()
    flat = np.full((11, 13, 1), 77, np.uint8)
    assert (images.resize(flat, *size) == 77).all() and (images.resize(flat, *size, kernel="lanczos") == 77).all()


def test_images_fit_without_growing(spark):
    df = spark.createDataFrame([("a", *image(np.zeros((30, 60, 3), np.uint8))), ("b", *image(np.zeros((2, 4, 3), np.uint8)))], "image_id string, width int, height int, channels int, data binary")
    assert {(r.image_id, r.width, r.height) for r in images.resize_image(df, 20, 20, fit=True).collect()} == {("a", 20, 10), ("b", 4, 2)}


def slow_palette(pixels, n):
    """Median cut over lists of pixels, each with its colour of five bits."""
    box = lambda b: [(min(p[c] // 8 for p in b), max(p[c] // 8 for p in b)) for c in range(3)]
    volume = lambda b: np.prod([hi - lo + 1 for lo, hi in box(b)])
    boxes = [list(pixels)]
    while len(boxes) < n:
        by = len if len(boxes) < 0.75 * n else lambda b: len(b) * volume(b)
        several = [b for b in boxes if volume(b) > 1]
        if not several:
            break
        b = max(several, key=by)
        spans = [hi - lo for lo, hi in box(b)]
        c = spans.index(max(spans))
        planes = sorted(p[c] // 8 for p in b)
        cut = planes[-(-len(b) // 2) - 1]
        cut = cut if cut < planes[-1] else max(p for p in range(planes[-1]) if p < planes[-1])
        k = boxes.index(b)
        boxes[k : k + 1] = [[p for p in b if p[c] // 8 <= cut], [p for p in b if p[c] // 8 > cut]]
    boxes.sort(key=lambda b: -len(b) * volume(b))
    return [tuple(sum(p[c] for p in b) // len(b) for c in range(3)) for b in boxes]


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (20, 30), (5, 401), (450, 40)])
def test_palettes_equal_those_of_lists_of_pixels(shape):
    r = np.random.default_rng(shape[1])
    centers = r.integers(0, 256, (6, 3))
    a = np.clip(centers[r.integers(0, 6, shape)] + r.normal(0, 12, (*shape, 3)), 0, 255).astype(np.uint8)
    seen = images.resize(a, 400, 400) if max(shape) > 400 else a
    pixels = [tuple(map(int, p)) for p in seen.reshape(-1, 3)[::9]]
    assert images.palette(a) == slow_palette(pixels, 10)
    assert images.palette(np.dstack([a, a[:, :, :1]]), 4) == slow_palette(pixels, 4)


def test_what_may_stand_for_an_image(spark):
    """Colour by colour, as the choice from a palette is made of an image."""
    r = np.random.default_rng(4)
    palettes = [[(90, 90, 90)], [(90, 90, 90), (1, 2, 3)], [(200, 10, 10)] * 4, [(250, 0, 0), (7, 7, 7), (9, 200, 30)], [(60, 50, 55)] * 5 + [(10, 90, 60)]]
    palettes += [[tuple(int(x) for x in r.choice([0, 40, 41, 200, 250], 3)) for _ in range(r.integers(1, 12))] for _ in range(60)]
    rows = [(i, k, *c) for i, p in enumerate(palettes) for k, c in enumerate(p)]
    t = spark.createDataFrame(rows, "image_id int, pos int, r int, g int, b int")
    got = {}
    for x in aggregates.palette_rank(t).orderBy("image_id", "rank").collect():
        got.setdefault(x.image_id, []).append((x.r, x.g, x.b))
    for i, p in enumerate(palettes):
        assert got[i][0] == images.choose(p)
        assert len(got[i]) <= 5
    bad = t.where("image_id = 3").union(spark.createDataFrame([(3, 9, None, 1, 1)], t.schema))
    assert [tuple(x) for x in aggregates.palette_rank(bad).collect()] == [(3, 1, None, 24, 24, 24)]
    assert aggregates.palette_rank(t.where("false")).count() == 0


def test_long_and_tangled_trees(spark):
    schema = "parent string, child string, pos int, hidden boolean"
    chain = [(None, "0", 0, True)] + [(str(k - 1), str(k), k % 3, False) for k in range(1, 700)]
    got = lookups.visible_nodes(spark.createDataFrame(chain, schema)).orderBy("depth").collect()
    assert [(r.node, r.depth, len(r.path)) for r in got] == [(str(k), k, k + 1) for k in range(700)]
    cut = spark.createDataFrame([(p, c, n, h or c == "300") for p, c, n, h in chain], schema)
    assert lookups.visible_nodes(cut).count() == 300
    ring = spark.createDataFrame([(None, "r", 0, False), ("x", "y", 0, False), ("y", "z", 0, False), ("z", "x", 0, False), ("gone", "w", 0, False)], schema)
    assert [r.node for r in lookups.visible_nodes(ring).collect()] == ["r"]
    both = spark.createDataFrame([(None, "r", 0, False), ("r", "a", 0, False), ("r", "b", 1, False), ("a", "c", 0, False), ("r", "c", 5, False)], schema)
    assert {(r.node, r.depth) for r in lookups.visible_nodes(both).collect()} == {("r", 0), ("a", 1), ("b", 1), ("c", 1)}


def test_rows_out_of_order_over_batches(spark, tmp_path):
    import random

    from loomkit.plans.catalogue import _drained

    r = random.Random(1)
    order = sorted(range(160), key=lambda n: n + r.random() * 30)
    schema = "user_id long, seq long, ms long, op string, key string"
    for k in range(4):
        before = set((tmp_path / "in").glob("*.parquet"))
        rows = [(r.choice([1, 2, 3]), n, n * 100, r.choice(["push", "push", "push", "pop", "remove"]), r.choice("abcd")) for n in order[k * 40 : k * 40 + 40]]
        spark.createDataFrame(rows, schema).selectExpr("*", "timestamp_millis(ms) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for new in set((tmp_path / "in").glob("*.parquet")) - before:
            os.utime(new, (1_700_000_000 + 60 * k,) * 2)
    t = spark.read.parquet(str(tmp_path / "in"))
    for default in (None, "a"):
        s = jobs.stream_history(spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), default, "4 seconds")
        got = {x.user_id: x.history for x in _drained(s, "update", ["user_id"], jobs.ROCKS).collect()}
        assert got == {x.user_id: x.history for x in sequences.replay_history(t.where("ms < 15900 - 4000"), default=default).collect()}


def test_marks_and_noise_on_images(spark):
    flat = np.full((4, 4, 3), 100, np.uint8)
    df = spark.createDataFrame([("flat", *image(flat))], "image_id string, width int, height int, channels int, data binary")
    got = images.pixels(images.watermark_overlay(df, np.full((1, 2, 3), 200, np.uint8), anchor=0, opacity=50, rotation=90).first())
    assert got[:2, 0].tolist() == [[150] * 3] * 2 and (got[2:] == 100).all() and (got[:, 1:] == 100).all()
    noise = np.array([[[0] * 3, [255] * 3]], np.uint8)
    got = images.pixels(images.acrylic_composite(df, (0, 0, 0, 0), (0, 0, 0, 0), 1, noise, 0.2).first())
    assert got[0, :, 0].tolist() == [80, 131, 80, 131]


def test_drift_needs_more_than_the_threshold_while_both_play(spark):
    rows = [(1, 1, 0, "main", 1000, True), (1, 2, 10, "sub", 850, True), (2, 3, 0, "main", 1000, True), (2, 4, 10, "sub", 849, True), (3, 5, 0, "main", 1000, True), (3, 6, 10, "sub", 0, False)]
    p = spark.createDataFrame(rows, "session_id long, event_id long, ms long, track string, position long, playing boolean").selectExpr("*", "timestamp_millis(ms) AS ts")
    assert [tuple(r) for r in sequences.drift_ticks(p).collect()] == [(2, 0, 1000, 849)]


def png(a):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + row.tobytes() for row in a)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_media_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    a = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    (tmp_path / "in/a.PNG").write_bytes(png(a))
    (tmp_path / "b.mp4").write_bytes(b"v")
    (tmp_path / "c.txt").write_bytes(b"t")
    (tmp_path / "bad.png").write_bytes(b"no")
    assert sorted(r.kind for r in files.read_media(spark, [str(tmp_path)]).collect()) == ["image", "image", "video"]
    got = {r.image_id.split("/")[-1]: r for r in files.read_images(spark, [str(tmp_path)]).collect()}
    assert bytes(got["a.PNG"].data) == a.tobytes() and got["bad.png"].error
    everything = files.read_media(spark, [str(tmp_path), str(tmp_path / "in"), str(tmp_path)], ("image", "video", "other"))
    assert sorted(r.path.split("/")[-1] for r in everything.collect()) == ["a.PNG", "b.mp4", "bad.png", "c.txt"]
    query = files.stream_media(spark, str(tmp_path), ("video",)).writeStream.format("memory").queryName("media").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.kind for r in spark.table("media").collect()] == ["video"]
    (tmp_path / "app.de_DE.ts").write_text('<?xml version="1.0"?><TS><context><name>C</name><message><source>Yes</source><translation>Ja</translation></message></context></TS>')
    assert tuple(files.read_translations(spark, str(tmp_path / "app.de_DE.ts")).first()) == ("de_DE", "C", "Yes", "Ja")


def test_stream_drift_plans(spark, tmp_path):
    p = spark.readStream.schema("session_id long, track string, ts timestamp, event_id long, position double, playing boolean").parquet(str(tmp_path))
    assert jobs.stream_drift(p).isStreaming


def test_drained_histories_are_whole_over_many_batches(spark, tmp_path):
    from loomkit.plans.catalogue import _drained
    from loomkit.streaming.jobs import stream_history

    schema = "user_id long, seq long, op string, key string"
    pushes = [(u, n, "push", f"k{n}") for u in (1, 2) for n in range(1500)]
    for rows in (pushes, [(2, 2000 + n, "pop", "") for n in range(1200)], [(3, 3201, "push", "x")], [(4, 9000, "push", "waits")]):
        spark.createDataFrame(rows, schema).selectExpr("*", "timestamp_millis(seq * 10 + 10) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ops = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {x.user_id: x.history for x in _drained(stream_history(ops), "update", ["user_id"], jobs.ROCKS).collect()}
    assert got == {1: [f"k{n}" for n in range(1500)], 2: [f"k{n}" for n in range(300)], 3: ["x"]}


def test_impulses_are_spread_in_tasks_of_bounded_frames(spark, monkeypatch):
    """Impulses that reach into the next run of frames, before 1970, at one place, and with null times or keys; the tasks grow in number with the impulses, and only impulses are shuffled."""
    monkeypatch.setattr(sequences, "FRAMES", 500)
    at = [*range(-250 * 16, 500 * 16, 7 * 16), *[238 * 16] * 5, None]
    rows = [(k, ms, float(n % 11)) for n, ms in enumerate(at) for k in ("a", "b", None)]
    e = spark.createDataFrame(rows, "key string, ms long, delta double").selectExpr("key", "timestamp_millis(ms) AS ts", "delta")
    for mode in ("linear", "cosine"):
        want = {}
        for key, ms, d in rows:
            for k, w in enumerate(sequences.kernel(mode)):
                frame = None if ms is None else ms // 16 + k
                want[key, frame] = want.get((key, frame), 0) + d * w
        out = sequences.spread_impulses(e, "key", "ts", "delta", mode=mode)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
        assert len(got) == len(want) and all(abs(r.delta - want[r.key, r.frame]) < 1e-9 for r in got)
        assert out.rdd.getNumPartitions() >= len(rows) * 24 / 500
        assert plan.count("Exchange hashpartitioning") == 1 and plan.index("posexplode") < plan.index("Exchange hashpartitioning")


def test_taps_of_wide_images_are_worked_out_once(spark):
    """Every ninth pixel is that of the whole resized image, bit for bit, and images of one size share what leads to it."""
    r = np.random.default_rng(3)
    for shape in ((8, 416, 3), (416, 8, 3), (401, 401, 3), (1, 900, 1), (500, 3, 4)):
        images.every(r.integers(0, 256, shape).astype(np.uint8), 9, (400, 400))
        before = images._every_taps.cache_info()
        a = r.integers(0, 256, shape).astype(np.uint8)
        assert (images.every(a, 9, (400, 400)) == images.resize(a, 400, 400).reshape(-1, shape[2])[::9]).all()
        now = images._every_taps.cache_info()
        assert (now.hits, now.misses) == (before.hits + 1, before.misses)


def test_a_users_rows_and_history_are_one_value_each_in_the_state_store():
    import pandas as pd

    from loomkit.streaming.jobs import _History

    class State(list):
        def get(self):
            return iter(list(self))

        exists = lambda self: len(self) > 0
        appendValue = list.append
        appendList = list.extend

        def put(self, values):
            self[:] = values

    class Handle(dict):
        getListState = lambda self, name, schema: self.setdefault(name, State())
        registerTimer = lambda self, ms: self.setdefault("timers", []).append(ms)

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    p, h = _History(None), Handle()
    p.init(h)
    rows = lambda a, b: pd.DataFrame({"ts": pd.to_datetime(list(range(a, b)), unit="ms"), "seq": range(a, b), "op": "push", "key": [f"k{n}" for n in range(a, b)]})
    list(p.handleInputRows((1,), iter([rows(50, 100), rows(0, 50)]), Now(0)))
    assert len(h["waiting"]) == 1 and h["timers"] == [1]
    for now in (60, 100):
        got = list(p.handleExpiredTimer((1,), Now(now), None))
        assert [x["history"][0] for x in got] == [[f"k{n}" for n in range(now)]] and len(h["history"]) == 1 + (now == 100)
    assert not h["waiting"]
