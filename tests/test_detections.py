from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cardloom.config import Settings
from cardloom.functions import boxes
from cardloom.operators import detections

SETTINGS = Settings()


def rows(spark, data):
    return spark.createDataFrame(data, "card long, ord long, raw_class string, confidence double").withColumns({"field": boxes.canonical_field(F.col("raw_class")), "flagged": boxes.is_flagged(F.col("raw_class"))})


def test_class_names(spark):
    names = ["front-up", "FRONT-UP", "back-down", "back-bottom", "front", "front-up-extra", "left-front", "", None]
    got = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").select("k", boxes.class_parts(F.col("n")).alias("p")).orderBy("k").collect()
    assert [(r.p.side, r.p.orientation, r.p.rotation) for r in got] == [("front", "up", 0)] * 2 + [("back", "down", 180)] + [(None, None, 0)] * 6


def test_fields(spark):
    got = rows(spark, [(1, 1, "invalid_lastName", 0.5), (1, 2, " lastName ", 0.5), (1, 3, "SomethingNew", 0.5), (1, 4, "", 0.5), (1, 5, None, 0.5)]).orderBy("ord").collect()
    assert [(r.field, r.flagged) for r in got] == [("last_name", True), ("last_name", False), ("somethingnew", False), ("", False), ("", False)]


def test_best_merge_missing_flagged(spark):
    primary = rows(spark, [(1, 1, "nid", 0.3), (1, 2, "nid", 0.9), (1, 3, "nid", 0.9), (1, 4, "", 0.99), (1, 5, "invalid_photo", 0.2), (2, 1, "serial", 0.5)])
    best = detections.best_per_field(primary)
    assert {(r.card, r.field, r.ord) for r in best.collect()} == {(1, "nid", 2), (1, "photo", 5), (2, "serial", 1)}
    other = rows(spark, [(1, 9, "nid", 1.0), (1, 8, "address", 0.1), (2, 7, "nid", 0.4)])
    assert {(r.card, r.ord) for r in detections.merge_detections(best, other).collect()} == {(1, 2), (1, 5), (1, 8), (2, 1), (2, 7)}
    assert {(r.card, r.field) for r in detections.missing_fields(primary.select("card").distinct(), best).collect()} == {(1, f) for f in ("first_name", "last_name", "address")} | {(2, f) for f in ("first_name", "last_name", "address", "nid")}
    assert [(r.card, r.fields) for r in detections.flagged_fields(primary).collect()] == [(1, "photo")]


def nms(cands, threshold):
    kept = []
    for c in sorted(cands, key=lambda c: (-c[1], c[0])):
        def iou(a, b):
            w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
            if w <= 0 or h <= 0:
                return 0.0
            return w * h / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - w * h)

        if all(iou(c, k) < threshold for k in kept):
            kept.append(c)
    return "".join(str(c[2]) for _, c in sorted(enumerate(kept), key=lambda e: (e[1][3], e[0])))


def digits(spark, groups):
    data = [(s, *c) for s, g in enumerate(groups) for c in g]
    df = spark.createDataFrame(data, "strip long, ord long, confidence double, cls int, x1 double, y1 double, x2 double, y2 double")
    return {r.strip: r.digits for r in detections.read_digits(df, SETTINGS).collect()}


def test_overlapping_digits(spark):
    close = [(0, 0.6, 5, 0.0, 0.0, 10.0, 20.0), (1, 0.9, 6, 0.5, 0.0, 10.5, 20.0), (2, 0.8, 3, 40.0, 0.0, 50.0, 20.0)]
    apart = [(k, 0.9, k, 11.0 * k, 0.0, 11.0 * k + 10, 20.0) for k in range(3)]
    assert digits(spark, [close, apart]) == {0: "63", 1: "012"}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(3, 9), st.integers(0, 9), st.integers(0, 40), st.integers(0, 6), st.integers(1, 12), st.integers(1, 9)), min_size=1, max_size=9), min_size=1, max_size=6))
def test_suppression_equals_the_loop(spark, groups):
    made = [[(k, c / 10, cls, float(x), float(y), float(x + w), float(y + h)) for k, (c, cls, x, y, w, h) in enumerate(g)] for g in groups]
    assert digits(spark, made) == {s: nms(g, SETTINGS.digit_iou) for s, g in enumerate(made)}


def test_reading_order(spark):
    items = [(1, 0, 100.0, 10.0, "b"), (1, 1, 200.0, 12.0, "a"), (1, 2, 50.0, 90.0, "d"), (1, 3, 60.0, 88.0, "c")]
    df = spark.createDataFrame(items, "crop long, ord long, cx double, cy double, text string").withColumns({"confidence": F.lit(0.5), "image_height": F.lit(100)})
    assert [r.text for r in detections.reading_order(df).orderBy("position").collect()] == ["a", "b", "c", "d"]
