"""Boxes and class names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom import refdata
from cardloom.functions.text import _map, trimmed


def canonical_field(raw: Column) -> Column:
    name = F.lower(F.regexp_replace(trimmed(F.coalesce(raw, F.lit(""))), "(?i)^invalid_", ""))
    return F.coalesce(F.try_element_at(_map(refdata.FIELD_ALIASES), name), name)


def region_field(cls: Column) -> Column:
    """The field of a class of the secondary detector; null for others."""
    return F.try_element_at(_map(refdata.REGION_CLASSES), cls)


def is_flagged(raw: Column) -> Column:
    return F.coalesce(F.lower(trimmed(raw)).startswith("invalid_"), F.lit(False))


def class_parts(name: Column) -> Column:
    """(side, orientation, rotation) of a card class such as front-up; unknown: nulls and 0."""
    parts = F.split(F.lower(name), "-", -1)
    known = (F.size(parts) == 2) & F.get(parts, F.lit(0)).isin(*refdata.SIDES) & F.get(parts, F.lit(1)).isin(*refdata.ORIENTATION_ROTATION)
    side, up = F.when(known, F.get(parts, F.lit(0))), F.when(known, F.get(parts, F.lit(1)))
    turn = _map(refdata.ORIENTATION_ROTATION)
    return F.struct(side.alias("side"), up.alias("orientation"), F.coalesce(F.try_element_at(turn, up), F.lit(0)).alias("rotation"))


def margins(field: Column) -> Column:
    table = F.create_map(*(x for k, (w, h) in refdata.FIELD_MARGINS.items() for x in (F.lit(k), F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")))))
    w, h = refdata.DEFAULT_MARGIN
    return F.coalesce(F.try_element_at(table, field), F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")))


def expand(x1: Column, y1: Column, x2: Column, y2: Column, sw: Column, sh: Column, width: int, height: int) -> Column:
    """A box grown about its centre, inside the picture, in whole pixels (towards zero)."""
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    hw, hh = (x2 - x1) * sw / 2, (y2 - y1) * sh / 2

    def inside(v: Column, most: int) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), v)).cast("int")

    return F.struct(inside(cx - hw, width).alias("x1"), inside(cy - hh, height).alias("y1"), inside(cx + hw, width).alias("x2"), inside(cy + hh, height).alias("y2"))


def crop(x1: Column, y1: Column, x2: Column, y2: Column, pad: int, width: int, height: int) -> Column:
    """The part of a padded box that lies in the picture; null if there is none."""
    a, b = F.greatest(F.lit(0), x1.cast("int") - pad), F.greatest(F.lit(0), y1.cast("int") - pad)
    c, d = F.least(F.lit(width), x2.cast("int") + pad), F.least(F.lit(height), y2.cast("int") + pad)
    return F.when((c > a) & (d > b), F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")))


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def area(a: Column) -> Column:
    return (a["x2"] - a["x1"]) * (a["y2"] - a["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where either is empty."""
    shared = overlap(a, b)
    union = area(a) + area(b) - shared
    return F.when((shared <= 0) | (union <= 0), 0.0).otherwise(shared / F.nullif(union, F.lit(0.0)))


def suppress(boxes: Column, threshold: float) -> Column:
    """Greedy suppression of an array of (confidence, ord, ...) boxes: the surest first, each kept
    unless it overlaps a kept one by the threshold or more. A card has tens of boxes."""
    ranked = F.transform(F.array_sort(F.transform(boxes, lambda b: F.struct((-b["confidence"]).alias("k"), b["ord"].alias("ord"), b.alias("box")))), lambda x: x["box"])

    def over(k: Column, b: Column) -> Column:
        much = iou(k, b) >= threshold
        # boxes apart are told from their sides alone
        return (k["x1"] < b["x2"]) & (b["x1"] < k["x2"]) & (k["y1"] < b["y2"]) & (b["y1"] < k["y2"]) & much if threshold > 0 else much

    return F.aggregate(ranked, F.filter(boxes, lambda b: F.lit(False)), lambda kept, b: F.when(F.exists(kept, lambda k: over(k, b)), kept).otherwise(F.concat(kept, F.array(b))))


def surest(boxes: Column, *keep: str) -> Column:
    """The surest of an array of (confidence, ord, ...) boxes, of equals the first reported: a struct of its confidence and ``keep``; null if there is none."""
    return F.array_max(F.transform(boxes, lambda b: F.struct(b["confidence"].alias("confidence"), (-b["ord"]).alias("place"), *(b[c].alias(c) for c in keep))))


def card_of(boxes: Column, least: float, min_width: int, min_height: int, width: int, height: int) -> Column:
    """(confidence, side, rotation) of the surest (class_name, confidence, ord, x1 to y2) box that is large enough to be a card; null if none is."""
    margin = F.lit(refdata.CARD_MARGIN)

    def large(b: Column) -> Column:
        g = expand(b["x1"], b["y1"], b["x2"], b["y2"], margin, margin, width, height)
        return (b["confidence"] >= least) & (b["confidence"] > 0) & (g["y2"] - g["y1"] >= min_height) & (g["x2"] - g["x1"] >= min_width)

    best = F.filter(F.array(surest(F.filter(boxes, large), "class_name")), lambda b: b.isNotNull())
    return F.try_element_at(F.transform(best, lambda b: F.struct(b["confidence"].alias("confidence"), class_parts(b["class_name"])["side"].alias("side"), class_parts(b["class_name"])["rotation"].alias("rotation"))), F.lit(1))


def digits_of(boxes: Column, least: float, threshold: float) -> Column:
    """(digits, confidence, per_digit, n) of an array of (confidence, ord, cls, x1 to y2) boxes: from left to right, after suppression."""
    sure = F.filter(boxes, lambda b: (b["confidence"] >= least) & b["cls"].between(0, 9))
    placed = F.array_sort(F.transform(suppress(sure, threshold), lambda b, i: F.struct(b["x1"].alias("x1"), i.alias("place"), b["cls"].alias("cls"), b["confidence"].alias("confidence"))))

    def use(p: Column) -> Column:
        total = F.aggregate(p, F.lit(0.0), lambda a, b: a + b["confidence"])
        return F.struct(
            F.array_join(F.transform(p, lambda b: b["cls"].cast("string")), "").alias("digits"), (total / F.nullif(F.size(p), F.lit(0))).alias("confidence"),
            F.transform(p, lambda b: b["confidence"]).alias("per_digit"), F.size(p).alias("n"),
        )

    return F.element_at(F.transform(F.array(placed), use), 1)


_PLACED = "array<struct<line:int,nx:double,i:int,ord:bigint,text:string,confidence:double>>"


def reading_lines(items: Column, height: Column) -> Column:
    """An array of (cy, ord, cx, text, confidence) in reading order, each with its ``line``: lines from the top, words from the right.

    A line goes on as long as an item's centre stays near that of the line's first item.
    """
    tolerance = F.greatest(F.lit(8.0), height * 0.45 / F.nullif(F.size(items), F.lit(0)))
    start = F.struct(F.lit(-1).alias("line"), F.lit(0.0).alias("y"), F.array().cast(_PLACED).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["line"] < 0) | (F.abs(x["cy"] - acc["y"]) > tolerance)
        line = F.when(new, acc["line"] + 1).otherwise(acc["line"])
        # within a line equal places keep the order from the top
        row = F.struct(line.alias("line"), (-x["cx"]).alias("nx"), F.size(acc["out"]).alias("i"), x["ord"].cast("bigint").alias("ord"), x["text"].alias("text"), x["confidence"].alias("confidence"))
        return F.struct(line.alias("line"), F.when(new, x["cy"]).otherwise(acc["y"]).alias("y"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.array_sort(F.aggregate(F.array_sort(items), start, step)["out"])


def quality_notes(blur: Column, contrast: Column, noise: Column, brightness: Column) -> Column:
    """What is wrong with a picture, in order."""
    return F.array_compact(
        F.array(
            F.when(blur < 100, F.format_string("image appears blurred (sharpness=%.0f)", blur)), F.when(contrast < 45, F.format_string("low contrast (std=%.0f)", contrast)),
            F.when(noise > 6, F.format_string("noisy image (sigma=%.1f)", noise)), F.when(brightness < 70, "image is underexposed"), F.when(brightness > 200, "image is overexposed"),
        )
    )


def aspect_is_card_like(width: Column, height: Column) -> Column:
    ratio = width / F.nullif(height, F.lit(0.0))
    card = 85.6 / 54
    return F.coalesce((width > 1) & (height > 1) & ((F.abs(ratio - card) <= 0.45) | (F.abs(1 / F.nullif(ratio, F.lit(0.0)) - card) <= 0.45)), F.lit(False))


def order_corners(points: Column) -> Column:
    """Four points (structs of x and y) as corners: ``tl``, ``tr``, ``br``, ``bl``; the first of equals."""
    def first(key) -> Column:
        ranked = F.array_min(F.transform(points, lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
        return F.struct(ranked["x"].alias("x"), ranked["y"].alias("y"))

    return F.struct(
        first(lambda p: p["x"] + p["y"]).alias("tl"), first(lambda p: p["y"] - p["x"]).alias("tr"), first(lambda p: -(p["x"] + p["y"])).alias("br"), first(lambda p: p["x"] - p["y"]).alias("bl")
    )
