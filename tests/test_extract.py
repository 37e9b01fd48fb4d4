import dataclasses
import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cardloom import models
from cardloom.config import Settings
from cardloom.functions import boxes, kernels
from cardloom.operators import detections, extract, records

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers don't know this file
SETTINGS = Settings(canvas_width=500, canvas_height=315)
LOADS = []


def card(turn=0, size=(500, 640)):
    """A bright card with a dark bar along its top, on a grey frame, turned clockwise."""
    x = np.full((252, 400, 3), 230, np.uint8)
    x[10:40, 20:380] = 30
    x = kernels.quarter_turns(x, turn)
    frame = np.full((*size, 3), 120, np.uint8)
    frame[60 : 60 + x.shape[0], 100 : 100 + x.shape[1]] = x
    return frame


class CardModel:
    """Sees the bright rectangle, and by the bar which way is up."""

    def __call__(self, picture):
        ys, xs = np.nonzero((picture[..., 0] > 200) | (picture[..., 0] < 60))
        if len(xs) < 5000:
            return []
        box = (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1)
        part = picture[box[1] : box[3], box[0] : box[2], 0] < 60
        h, w = part.shape
        sides = {"up": part[: h // 3].sum(), "down": part[-(h // 3) :].sum(), "right": part[:, : w // 3].sum() if h > w else 0, "left": part[:, -(w // 3) :].sum() if h > w else 0}
        if h > w:
            sides["up"] = sides["down"] = 0
        return [("logo", 0.99, 0, 0, 20, 20), (f"front-{max(sides, key=sides.get)}", 0.40, *map(float, box)), ("front-up", 0.40, 0.0, 0.0, 630.0, 390.0)]


class FieldModel:
    """Fields at fixed places of an upright card: one whose bar is above."""

    def __call__(self, picture):
        h, w = picture.shape[:2]
        if (picture[: h // 3, :, 0] < 60).mean() < 0.1:
            return []
        return [("invalid_firstName", 0.9, w * 0.6, h * 0.3, w * 0.9, h * 0.4), ("lastName", 0.8, w * 0.6, h * 0.45, w * 0.9, h * 0.55), ("lastName", 0.1, 0, 0, 9, 9), ("nid", 0.7, w * 0.4, h * 0.8, w * 0.9, h * 0.9)]


class RegionModel:
    def __call__(self, picture):
        h, w = picture.shape[:2]
        return [(1, 0.6, w * 0.6, h * 0.6, w * 0.9, h * 0.7), (3, 0.99, 0.0, 0.0, 9.0, 9.0), (7, 0.9, 0, 0, 9, 9)]


class DigitModel:
    def __call__(self, picture):
        return [(int(c), 0.9, 30.0 * k, 5.0, 30.0 * k + 20, 40.0) for k, c in reversed(list(enumerate("29001010100017")))] + [(5, 0.5, 2.0, 5.0, 22.0, 40.0), (11, 0.9, 0.0, 0.0, 9.0, 9.0)]


def load_card():
    LOADS.append(1)
    return CardModel()


def reader(picture):
    box = lambda x, y: np.array([[x, y], [x + 10, y], [x + 10, y + 8], [x, y + 8]])
    return [(box(0, 4), "فاطمه", 0.8), (box(50, 5), "احمد", 0.9), (box(9, 200), "ABC", 0.7), (box(9, 200), "", 0.7)]


def broken(picture):
    raise RuntimeError("no memory")


STUB = models.Models(card=load_card, fields=FieldModel, regions=RegionModel, digits=DigitModel, recognisers={"paddleocr": lambda: (lambda p: []), "easyocr": lambda: reader, "unknown": lambda: broken})


def images(spark, *rows):
    kind = "card string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>, error string, other int"
    made = [(k, None if x is None else (k, *x.shape[:2], 1 if x.ndim == 2 else x.shape[2], 16, x.tobytes()), None if x is not None else "the file could not be decoded", 7) for k, x in rows]
    return spark.createDataFrame(made, kind)


@pytest.fixture(scope="module")
def found(spark):
    rows = [*((f"t{t}", card(t)) for t in (0, 90, 180, 270)), ("small", kernels.resize(kernels.quarter_turns(card(), 0)[60:312, 100:500], 90, 57)), ("blank", np.full((60, 80, 3), 200, np.uint8)), ("grey", np.full((30, 40), 100, np.uint8)), ("bad", None)]
    return {r.card: r for r in extract.extract(images(spark, *rows), STUB, SETTINGS, F.lit("2026-01-01").cast("date")).collect()}


def test_cards_are_read_whichever_way_they_lie(found):
    for turn in (0, 90, 180, 270):
        r = found[f"t{turn}"]
        assert r.error is None and r.card_detected and r.side == "front" and (r.rotation_applied + turn) % 360 == 0 and abs(r.card_confidence - 0.4) < 1e-9
        assert r.first_name.value == "أحمد فاطمة" and r.first_name.raw == "احمد فاطمه ABC" and r.first_name.status == "ok" and abs(r.first_name.confidence - 0.8) < 1e-9
        assert r.last_name.value == "أحمد فاطمة" and r.address.value == "أحمد فاطمة ABC" and r.full_name.value == "أحمد فاطمة أحمد فاطمة"
        assert r.national_id.value == "29001010100017" and r.validation.valid and (r.birth_date, r.gender) == ("1990-01-01", "male")
        assert any(w.startswith("The detector flagged these regions as atypical for a genuine card: first_name.") for w in r.warnings)
        assert any(w.startswith("Card detected with low confidence (0.40)") for w in r.warnings)


def test_a_picture_without_outline_is_taken_for_the_card(found):
    r = found["small"]
    assert r.error is None and not r.card_detected and r.card_confidence == 0 and r.side is None and r.rotation_applied == 0
    assert r.national_id.value == "29001010100017" and any(w.startswith("No ID card outline") for w in r.warnings)


def test_pictures_without_fields_or_pixels(found):
    for key in ("blank", "grey"):
        r = found[key]
        assert r.error is None and r.address.status == "ok" and r.first_name.status == "ok"  # the regions fill the gaps
        assert r.national_id.status == "not_found" and r.national_id.value is None and "The National ID number region was not found on the card." in r.warnings
    r = found["bad"]
    assert r.error == "the file could not be decoded" and r.warnings == [] and not r.card_detected
    assert all(f.value is None and f.raw is None and f.confidence == 0 and f.status == "not_found" for f in (r.first_name, r.last_name, r.address, r.full_name, r.national_id))


def test_missing_and_failing_models(spark):
    as_of = F.lit("2026-01-01").cast("date")
    (r,) = extract.extract(images(spark, ("a", card())), models.Models(), SETTINGS, as_of).collect()
    assert r.error is None and r.warnings[0] == "Missing models: card, fields, regions, digits." and not r.card_detected and r.warnings[-1].endswith("no field could be read.")
    (r,) = extract.extract(images(spark, ("a", card())), models.Models(card=lambda: broken), SETTINGS, as_of).collect()
    assert r.error == "RuntimeError: no memory" and r.warnings == []
    assert extract.extract(images(spark, ("a", card())).limit(0), STUB, SETTINGS, as_of).count() == 0


def test_each_picture_is_shown_once(spark, tmp_path):
    """The card's model writes a line for each call: one a picture, in one Arrow stage, without a shuffle."""
    log = str(tmp_path / "calls")

    def load():
        def look(picture):
            with open(log, "a") as f:
                f.write(f"{picture.shape}\n")
            return CardModel()(picture)

        return look

    rows = extract.extract(images(spark, *((f"t{t}", card(t)) for t in (0, 90, 180)), ("bad", None)), dataclasses.replace(STUB, card=load), SETTINGS, F.lit("2026-01-01").cast("date"), profile=object())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Exchange" not in plan
    assert len(rows.where("national_id.value IS NOT NULL AND validation.valid").collect()) == 3
    assert len(open(log).readlines()) == 3


def test_a_card_is_read_without_what_fails(spark):
    parts = dataclasses.replace(STUB, regions=lambda: broken, recognisers={"easyocr": lambda: broken, "paddleocr": lambda: nested})
    (r,) = extract.extract(images(spark, ("a", card())), parts, SETTINGS, F.lit("2026-01-01").cast("date")).collect()
    assert r.error is None and r.first_name.value == "أحمد" and r.national_id.value == "29001010100017" and r.address.status == "not_found"
    assert set(r.failed) == {"regions: RuntimeError", "easyocr: RuntimeError"}


def nested(picture):
    outline = [[0, 0], [9, 0], [9, 9], [0, 9]]
    return [None, [None, [outline, ("احمد", 0.9)], [outline, None], [outline, ("", 0.5)]]]


def test_shapes_of_readings():
    assert models.readings(None) == [] and models.readings([[], ("o", "", 0.5)]) == [] and models.readings([("o", "a", 1)]) == [("o", "a", 1.0)]
    assert [x[1:] for x in models.readings(nested(None))] == [("احمد", 0.9)]


WORDS = ["front-up", "Back-DOWN", "front", "front-up-x", "left-front", "", "invalid_lastName", " Invalid_nid\x1c", "INVALID_", "\u00a0Address\u2003", "x\x85", "invalid_invalid_nid", "SomethingNew", "front_logo"]


def test_python_and_columns_agree(spark):
    """What the Arrow stage decides by itself equals the expressions of the plans."""
    got = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", boxes.canonical_field(F.col("w")).alias("f"), boxes.class_parts(F.col("w")).alias("p")).collect()
    for r in got:
        assert extract._canonical(r.w) == r.f and extract._class_parts(r.w) == (r.p.side, r.p.orientation), repr(r.w)
    rng = np.random.default_rng(1)
    made = [tuple(float(v) for v in (*rng.uniform(-50, 1200, 4).round(3), *rng.uniform(0.5, 2, 2).round(2))) for _ in range(300)]
    frame = spark.createDataFrame(made, "x1 double, y1 double, x2 double, y2 double, w double, h double")
    for r in frame.select("*", boxes.expand(*map(F.col, frame.columns), 1000, 630).alias("g")).collect():
        assert extract._grown((r.x1, r.y1, r.x2, r.y2), r.w, r.h, (630, 1000)) == tuple(r.g)
    fields = ["nid", "serial", "photo", "firstName", "lastName", "other"]
    found = [(k, 0, fields[int(rng.integers(6))], float(rng.uniform(0, 1)), *(float(v) for v in rng.uniform(0, 600, 4))) for k in range(40) for _ in range(int(rng.integers(1, 6)))]
    rows = spark.createDataFrame(found, "image int, rotation int, raw string, confidence double, x1 double, y1 double, x2 double, y2 double").withColumn("field", boxes.canonical_field(F.col("raw")))
    for r in detections.layout_scores(rows, 1000, 630).collect():
        assert abs(extract.layout_score([f[2:] for f in found if f[0] == r.image], 1000, 630) - r.score) < 1e-9


def test_models_load_once():
    LOADS.clear()
    assert models.loaded("card", load_card) is models.loaded("card", load_card) and len(LOADS) <= 1
    assert STUB.missing() == [] and models.Models(card=load_card).missing() == ["fields", "regions", "digits"]


def test_views_of_extracted_records(spark):
    rows = extract.extract(images(spark, ("a", card()), ("b", None)), STUB, SETTINGS, F.lit("2026-01-01").cast("date"))
    got = {r.card: json.loads(r.json) for r in records.nested_json(rows, "card").collect()}
    assert list(got["a"]) == ["card_detected", "card_confidence", "rotation_applied", "side", "fields", "derived", "validation", "warnings"]
    assert list(got["a"]["fields"]) == ["first_name", "last_name", "full_name", "address", "national_id"] and got["a"]["card_confidence"] == 0.4 and got["b"]["side"] is None
