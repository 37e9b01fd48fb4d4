"""Detections as rows: choosing, merging, suppressing and ordering boxes.

Every tie goes to the smaller ``ord``, the place in which a detector reported the box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom import refdata
from cardloom.config import Settings
from cardloom.functions import boxes
from cardloom.functions.columns import bound, unused


def _first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group; Spark ranks before the shuffle already."""
    w, rank = Window.partitionBy(*keys).orderBy(*order), unused(df, "rank")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def best_per_field(df: DataFrame, card: str = "card") -> DataFrame:
    """The surest box of each named field of a card."""
    return _first(df.where("field <> ''"), [card, "field"], F.desc("confidence"), F.asc("ord"))


def merge_detections(primary: DataFrame, secondary: DataFrame, card: str = "card") -> DataFrame:
    """The primary boxes, and those secondary ones whose field the primary lacks."""
    gaps = secondary.join(primary.select(card, "field"), [card, "field"], "left_anti")
    return primary.unionByName(gaps)


def best_of_both(df: DataFrame, primary: str = "primary", card: str = "card") -> DataFrame:
    """The surest box of each named field of a card, of a secondary detector (``primary`` false) only where the primary one has none.

    One look at all boxes: what ``merge_detections`` of both ``best_per_field`` gives.
    """
    return _first(df.where("field <> ''"), [card, "field"], F.desc(primary), F.desc("confidence"), F.asc("ord"))


def region_fields(df: DataFrame) -> DataFrame:
    """Fields of the secondary detector's classes (``cls``); others are dropped."""
    return df.withColumn("field", boxes.region_field(F.col("cls"))).where("field IS NOT NULL").withColumn("raw_class", F.concat(F.lit("region:"), F.col("cls")))


def missing_fields(cards: DataFrame, found: DataFrame, card: str = "card") -> DataFrame:
    """Required fields that a card has no box of."""
    needed = cards.select(card, F.explode(F.array(*map(F.lit, refdata.REQUIRED_FIELDS))).alias("field"))
    return needed.join(found.select(card, "field"), [card, "field"], "left_anti")


def flagged_fields(df: DataFrame, card: str = "card") -> DataFrame:
    """One warning for each card with boxes that were flagged as atypical."""
    names = F.array_join(F.array_sort(F.collect_set(F.when(F.col("flagged"), F.col("field")))), ", ")
    return df.groupBy(card).agg(names.alias("fields")).where("fields <> ''").withColumn(
        "warning", F.concat(F.lit("The detector flagged these regions as atypical for a genuine card: "), "fields", F.lit(". They were still read."))
    )


def pick_card(df: DataFrame, settings: Settings, width: int, height: int, image: str = "image") -> DataFrame:
    """The surest box that is large enough to be a card, with its side and rotation."""
    margin = F.lit(refdata.CARD_MARGIN)
    grown = df.where(F.col("confidence") >= settings.card_conf).withColumn("crop", boxes.expand(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), margin, margin, width, height))
    large = grown.where((F.col("crop.y2") - F.col("crop.y1") >= settings.min_card_height) & (F.col("crop.x2") - F.col("crop.x1") >= settings.min_card_width) & (F.col("confidence") > 0))
    return _first(large, [image], F.desc("confidence"), F.asc("ord")).withColumn("parts", boxes.class_parts(F.col("class_name")))


def layout_scores(df: DataFrame, width: int, height: int, image: str = "image") -> DataFrame:
    """How card-like the boxes of each rotation of a picture lie."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2

    def sign(ok: Column, weight: float) -> Column:
        return F.when(ok, weight).otherwise(-weight)

    place = (
        F.when(F.col("field") == "nid", sign(cy > 0.60 * height, 40.0)).when(F.col("field") == "serial", sign(cy < 0.40 * height, 25.0))
        .when(F.col("field").isin("first_name", "last_name"), sign(cx > 0.45 * width, 20.0)).when(F.col("field") == "photo", sign(cx < 0.40 * width, 20.0)).otherwise(0.0)
    )
    return df.groupBy(image, "rotation").agg(F.sum(F.col("confidence") * 10.0 + place).alias("score"))


def best_rotation(scores: DataFrame, image: str = "image") -> DataFrame:
    return _first(scores, [image], F.desc("score"), F.asc("rotation"))


def read_digits(df: DataFrame, settings: Settings, strip: str = "strip") -> DataFrame:
    """Digits of each strip from left to right, after suppression, and their mean confidence; none: no row."""
    box = F.struct("confidence", "ord", "cls", "x1", "y1", "x2", "y2")
    sure = df.where((F.col("confidence") >= settings.digit_conf) & F.col("cls").between(0, 9))
    # a strip has tens of boxes at most
    kept = sure.groupBy(strip).agg(F.collect_list(box).alias("boxes"))
    kept = bound(kept, {"read": boxes.digits_of(F.col("boxes"), settings.digit_conf, settings.digit_iou)})
    return kept.select(strip, "read.digits", "read.confidence", "read.n", "read.per_digit", (F.col("read.n") == refdata.ID_LENGTH).alias("complete"))


def reading_order(df: DataFrame, crop: str = "crop", height: str = "image_height") -> DataFrame:
    """``line`` and ``position`` of each item in its crop."""
    item = F.struct(F.col("cy"), F.col("ord"), F.col("cx"), F.col("text"), F.col("confidence"))
    grouped = df.groupBy(crop).agg(F.max(height).alias("tall"), F.collect_list(item).alias("items"))
    ranked = boxes.reading_lines(F.col("items"), F.col("tall"))
    return grouped.select(crop, F.posexplode(ranked).alias("position", "x")).select(crop, "position", "x.line", "x.ord", "x.text", "x.confidence")


def best_engine(df: DataFrame, settings: Settings, crop: str = "crop") -> DataFrame:
    """The most credible reading: confidence to two places, then length, then the engines' order."""
    order = F.create_map(*(x for k, name in enumerate(settings.ocr_engines) for x in (F.lit(name), F.lit(k))))
    place = F.try_element_at(order, F.col("engine"))
    known = df.where(F.col("engine").isin(*settings.ocr_engines) & (F.length(F.trim("text")) > 0))
    return _first(known, [crop], F.desc(F.round("confidence", 2)), F.desc(F.length("text")), place.asc())
