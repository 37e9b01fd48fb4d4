"""From pictures to card records: pixels in one Arrow stage, everything after it in expressions.

``extract`` lets the models look at each picture once, in the task that holds it; what they report
of a card is one row with arrays of boxes and readings, and ``read_cards`` turns such rows, wherever
they come from, into records by expressions over those arrays. Neither shuffles anything. Pictures
that could not be decoded stay, with their ``error``; a recogniser or the secondary detector that
fails on a card is left out there, and named in ``failed``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom import refdata
from cardloom.config import Settings
from cardloom.functions import boxes, kernels, text
from cardloom.functions.columns import bound
from cardloom.models import Models, loaded, readings
from cardloom.operators import records

TEXT_FIELDS = ("first_name", "last_name", "address")
NAMES = ("first_name", "last_name")
_BOX = "ord bigint, cls string, confidence double, x1 double, y1 double, x2 double, y2 double"
_ARRAY = f"array<struct<{_BOX.replace(' ', ':').replace(',:', ', ')}>>"
_ITEM = "struct<field:string, engine:string, ord:bigint, cx:double, cy:double, text:string, confidence:double, image_height:int>"
#: What the models said of a picture.
SEEN = f"quality struct<blur:double, contrast:double, noise:double, brightness:double>, located struct<confidence:double, side:string, rotation:int>, turned int, fields {_ARRAY}, regions {_ARRAY}, items array<{_ITEM}>, digits {_ARRAY}, failed array<string>"


def _rows(found: list) -> list[dict]:
    return [{"ord": k, "cls": str(c), "confidence": float(p), "x1": float(a), "y1": float(b), "x2": float(c2), "y2": float(d)} for k, (c, p, a, b, c2, d) in enumerate(found)]


def _grown(box: tuple, w: float, h: float, shape: tuple) -> tuple[int, int, int, int]:
    x1, y1, x2, y2 = box
    cx, cy, hw, hh = (x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) * w / 2, (y2 - y1) * h / 2
    return tuple(int(max(0.0, min(float(most), v))) for v, most in ((cx - hw, shape[1]), (cy - hh, shape[0]), (cx + hw, shape[1]), (cy + hh, shape[0])))


def _class_parts(name: str) -> tuple[str | None, str | None]:
    parts = name.lower().split("-")
    known = len(parts) == 2 and parts[0] in refdata.SIDES and parts[1] in refdata.ORIENTATION_ROTATION
    return (parts[0], parts[1]) if known else (None, None)


def _canonical(raw: str) -> str:
    name = raw.strip()
    name = (name[8:] if name.lower().startswith("invalid_") else name).lower()
    return refdata.FIELD_ALIASES.get(name, name)


def locate(picture: np.ndarray, found: list, settings: Settings) -> tuple[np.ndarray, float, str | None, int] | None:
    """(upright card, confidence, side, rotation) of the surest box that is large enough."""
    best = None
    for name, confidence, *box in found:
        if confidence < settings.card_conf or confidence <= (best[1] if best else 0.0):
            continue
        part = kernels.crop(picture, *_grown(tuple(box), refdata.CARD_MARGIN, refdata.CARD_MARGIN, picture.shape))
        if part is not None and part.shape[0] >= settings.min_card_height and part.shape[1] >= settings.min_card_width:
            side, up = _class_parts(str(name))
            best = (part, confidence, side, refdata.ORIENTATION_ROTATION.get(up or "up", 0))
    if best is None:
        return None
    card = kernels.resize(kernels.quarter_turns(best[0], best[3]), settings.canvas_width, settings.canvas_height)
    return card, *best[1:]


def layout_score(found: list, width: int, height: int) -> float:
    """How card-like the boxes of a picture lie; nothing found: minus infinity."""
    def one(field: str, confidence: float, cx: float, cy: float) -> float:
        good = {"nid": (cy > height * 0.60, 40.0), "serial": (cy < height * 0.40, 25.0), "photo": (cx < width * 0.40, 20.0)} | dict.fromkeys(NAMES, (cx > width * 0.45, 20.0))
        ok, weight = good.get(field, (True, 0.0))
        return confidence * 10.0 + (weight if ok else -weight)

    return sum(one(_canonical(str(c)), p, (a + x) / 2, (b + y) / 2) for c, p, a, b, x, y in found) if found else -np.inf


def see(picture: np.ndarray, models: Models, settings: Settings) -> dict:
    """Everything that the models report of a picture."""
    failed: list[str] = []

    def detect(name: str, x: np.ndarray, least: float) -> list:
        load = getattr(models, name)
        return [b for b in loaded(name, load)(x) if b[1] >= least] if load else []

    def spare(name: str, look: Callable[[], list]) -> list:
        """What one of several sources reports; without it the card is read from the others."""
        try:
            return look()
        except Exception as e:  # whatever a model raises
            failed.append(f"{name}: {type(e).__name__}")
            return []

    out = {"quality": dict(zip(("blur", "contrast", "noise", "brightness"), kernels.quality(picture), strict=True)), "located": None, "turned": 0, "regions": [], "items": [], "digits": [], "failed": failed}
    card = locate(picture, detect("card", picture, settings.card_conf), settings)
    if card is not None:
        picture, confidence, side, turned = card
        out |= {"located": {"confidence": float(confidence), "side": side, "rotation": turned}, "turned": turned}
    else:
        scores = []
        for turn in (0, 90, 180, 270):
            x = kernels.resize(kernels.quarter_turns(picture, turn), settings.canvas_width, settings.canvas_height)
            scores.append((layout_score(detect("fields", x, settings.field_conf), *x.shape[1::-1]), -turn))
        turned = -max(scores)[1] if max(scores)[0] > -np.inf else 0
        out["turned"] = turned
        picture = kernels.resize(kernels.quarter_turns(picture, turned), settings.canvas_width, settings.canvas_height)
    picture, _ = kernels.deskew(picture)
    fields = detect("fields", picture, settings.field_conf)
    named = _surest((_canonical(str(b[0])), b) for b in fields)
    if any(f not in named for f in refdata.REQUIRED_FIELDS):
        out["regions"] = spare("regions", lambda: detect("regions", picture, settings.field_conf))
        named = _surest((refdata.REGION_CLASSES.get(int(b[0]), ""), b) for b in out["regions"]) | named
    for name in refdata.REQUIRED_FIELDS:
        part = kernels.crop(picture, *_grown(tuple(named[name][2:]), *refdata.FIELD_MARGINS[name], picture.shape)) if name in named else None
        if part is None:
            continue
        if name == "nid":
            out["digits"] = _rows(detect("digits", kernels.sharpen_digits(kernels.pad(part, 24)), settings.digit_conf))
            continue
        ready = kernels.enhance_text(kernels.pad(part, 20))
        for engine in settings.ocr_engines:
            if engine in models.recognisers:
                for k, (points, said, sure) in enumerate(spare(engine, lambda e=engine, x=ready: readings(loaded(e, models.recognisers[e])(x)))):
                    cx, cy = np.asarray(points, dtype=np.float32).reshape(-1, 2).mean(0).astype(float).tolist()
                    out["items"].append({"field": name, "engine": engine, "ord": k, "cx": cx, "cy": cy, "text": said, "confidence": sure, "image_height": ready.shape[0]})
    return out | {"fields": _rows(fields), "regions": _rows(out["regions"])}


def _surest(named: Iterable[tuple[str, tuple]]) -> dict[str, tuple]:
    """The surest box of each name, of equals the first."""
    best: dict[str, tuple] = {}
    for name, b in named:
        if name and (name not in best or b[1] > best[name][1]):
            best[name] = b
    return best


def extract(images: DataFrame, models: Models, settings: Settings, as_of: Column, *, card: str = "card", profile: ResourceProfile | None = None) -> DataFrame:
    """Records of pictures: rows of ``card`` (an id), ``image`` (Spark's struct) and ``error`` (null if it was decoded).

    Other columns are dropped. A picture whose models fail gets their message as its ``error``.
    ``profile`` says what the stage of the models needs (cores, GPUs, memory); a local master has
    no other executors to ask for, and ignores it.
    """
    kind = images.schema[card].dataType.simpleString()
    columns = ["quality", "located", "turned", "fields", "regions", "items", "digits", "failed"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, h, w, n, data, error in zip(f["card"], f["height"], f["width"], f["channels"], f["data"], f["error"], strict=True):
                seen: dict = {}
                if not isinstance(error, str):
                    try:
                        seen = see(kernels.to_bgr(np.frombuffer(data, np.uint8).reshape(int(h), int(w), int(n))), models, settings)
                        error = None
                    except Exception as e:  # one bad picture must not end the job: its row says what happened
                        error = f"{type(e).__name__}: {e}"
                rows.append((key, error, *(seen.get(c) for c in columns)))
            yield pd.DataFrame(rows, columns=["card", "error", *columns])

    pixels = images.select(F.col(card).alias("card"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"), "error")
    local = images.sparkSession.sparkContext.master.startswith("local")
    seen = pixels.mapInPandas(run, f"card {kind}, error string, {SEEN}", profile=None if local else profile)
    q = F.col("quality")
    absent = F.array(*([F.lit("Missing models: " + ", ".join(models.missing()) + ".")] if models.missing() else [])).cast("array<string>")
    notes = F.concat(absent, F.coalesce(boxes.quality_notes(q["blur"], q["contrast"], q["noise"], q["brightness"]), F.array().cast("array<string>")))

    def numbered(column: str) -> Column:
        return F.transform(column, lambda b: b.withField("cls", b["cls"].cast("int")))

    named = F.transform("fields", lambda b: b.withField("raw_class", b["cls"]))
    seen = seen.withColumns({"notes": notes, "fields": named, "regions": numbered("regions"), "digits": numbered("digits")})
    return read_cards(seen.drop("quality"), settings, as_of).withColumnRenamed("card", card)


def read_cards(cards: DataFrame, settings: Settings, as_of: Column) -> DataFrame:
    """Records of cards from what models found on them, one row each.

    ``cards``: card, error, notes (what is known beforehand), turned (of cards not located), located
    (confidence, side, rotation; or null), and arrays, null or empty where nothing was found: fields
    (ord, raw_class, confidence, x1 to y2, on the upright card), regions and digits (the same with cls,
    a number, for raw_class), items (field, engine, ord, cx, cy, text, confidence, image_height).
    Other columns stay, but for those of the names of a record. Cards with an error have records without values.
    """
    ok = F.col("error").isNull()

    def found(column: str, keep: Callable[[Column], Column]) -> Column:
        given = F.when(ok, F.coalesce(F.col(column), F.array().cast(cards.schema[column].dataType)))
        return F.filter(F.coalesce(given, F.array().cast(cards.schema[column].dataType)), keep)

    place = ("x1", "y1", "x2", "y2")
    primary = F.transform(found("fields", lambda b: b["confidence"] >= settings.field_conf), lambda b: F.struct(
        boxes.canonical_field(b["raw_class"]).alias("field"), boxes.is_flagged(b["raw_class"]).alias("flagged"), b["ord"].alias("ord"), b["confidence"].alias("confidence"), *(b[c].alias(c) for c in place)))
    spare = F.transform(found("regions", lambda b: b["confidence"] >= settings.field_conf), lambda b: F.struct(
        boxes.region_field(b["cls"]).alias("field"), b["ord"].alias("ord"), b["confidence"].alias("confidence"), *(b[c].alias(c) for c in place)))
    df = bound(cards, {"_primary": primary, "_spare": spare, "_items": found("items", lambda x: (F.length(x["text"]) > 0) & x["engine"].isin(*settings.ocr_engines)), "_strip": found("digits", lambda b: F.lit(True))})

    def box_of(field: str) -> Column:
        """The primary detector's surest box, or else the secondary one's."""
        return F.coalesce(*(boxes.surest(F.filter(c, lambda b: b["field"] == field), *place) for c in ("_primary", "_spare")))

    df = bound(df, {f"_{f}": box_of(f) for f in refdata.REQUIRED_FIELDS})
    fits = {}
    for f in refdata.REQUIRED_FIELDS:
        b, m = F.col(f"_{f}"), refdata.FIELD_MARGINS[f]
        g = boxes.expand(b["x1"], b["y1"], b["x2"], b["y2"], F.lit(m[0]), F.lit(m[1]), settings.canvas_width, settings.canvas_height)
        fits[f"_{f}_crop"] = b.isNotNull() & F.coalesce((g["x2"] > g["x1"]) & (g["y2"] > g["y1"]), F.lit(False))
    df = bound(df, fits)
    read = F.transform(F.array(*map(F.lit, TEXT_FIELDS)), lambda f: _reading(f, settings))
    df = bound(df, {"_read": read, "_number": F.when(F.col("_nid_crop"), boxes.digits_of(F.col("_strip"), settings.digit_conf, settings.digit_iou))})
    df = bound(df, {f"_{f}_read": F.when(F.col(f"_{f}_crop"), F.element_at("_read", k)) for k, f in enumerate(TEXT_FIELDS, 1)})
    normal = {}
    for f in TEXT_FIELDS:
        normal[f"_{f}_normal"] = text.normalize_arabic(F.col(f"_{f}_read.text"), f in NAMES)
    df = df.withColumns(normal)
    if settings.fuzzy:
        df = df.withColumns({f"_{f}_normal": text.correct_text(F.col(f"_{f}_normal"), F.lit("name" if f in NAMES else "address"), settings.fuzzy_threshold) for f in TEXT_FIELDS})

    has, box = F.col("_nid_crop"), F.col("_nid").isNotNull()
    fields = {f: records.text_field(F.col(f"_{f}_crop"), F.col(f"_{f}_read.text"), F.col(f"_{f}_normal"), F.col(f"_{f}_read.sure"), settings) for f in TEXT_FIELDS}
    fields["national_id"] = records.number_field(has, F.col("_number.digits"), F.col("_number.confidence"), settings)
    detected = ok & F.col("located").isNotNull()
    flagged = F.array_sort(F.array_distinct(F.transform(F.filter("_primary", lambda b: b["flagged"]), lambda b: b["field"])))
    atypical = F.concat(F.lit("The detector flagged these regions as atypical for a genuine card: "), F.array_join(flagged, ", "), F.lit(". They were still read."))
    nothing = F.array().cast("array<string>")
    of_number = F.when(box & ~has, nothing).otherwise(records.number_warnings(has, F.col("_number.digits")))
    notes = records.warnings(F.col("notes"), records.card_warnings(detected, F.col("located.confidence"), F.col("located.side"), settings), F.when(F.size(flagged) > 0, F.array(atypical)), of_number)
    made = fields | {
        "card_detected": detected, "card_confidence": F.when(detected, F.col("located.confidence")).otherwise(0.0), "side": F.when(detected, F.col("located.side")),
        "rotation_applied": F.when(detected, F.col("located.rotation")).otherwise(F.coalesce("turned", F.lit(0))), "_notes": notes,
    }
    used = ["notes", "turned", "located", "fields", "regions", "items", "digits", *(c for c in df.columns if c.startswith("_") and c not in cards.columns)]
    df = bound(df.drop(*made), made).drop(*used).withColumnRenamed("_notes", "notes")
    out = records.assemble(df, settings, as_of)
    return out.withColumn("warnings", F.when(F.col("error").isNull(), F.col("warnings")).otherwise(nothing))


def _reading(field: Column, settings: Settings) -> Column:
    """What the most credible engine read in a field: (text, sure), or null.

    Confidence to two places, then length, then the engines' order decides.
    """
    def of_engine(engine: Column, k: Column) -> Column:
        its = F.filter("_items", lambda x: (x["field"] == field) & (x["engine"] == engine))
        piece = F.transform(its, lambda x: F.struct(*(x[c].alias(c) for c in ("cy", "ord", "cx", "text", "confidence"))))

        def joined(lines: Column) -> Column:
            said = text.trimmed(F.array_join(F.transform(lines, lambda x: x["text"]), " "))
            sure = F.aggregate(lines, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.nullif(F.size(lines), F.lit(0))
            return F.struct(F.round(sure, 2).alias("rough"), F.length(said).alias("length"), (-k).alias("place"), said.alias("text"), sure.alias("sure"))

        return F.element_at(F.transform(F.array(boxes.reading_lines(piece, F.array_max(F.transform(its, lambda x: x["image_height"])))), joined), 1)

    each = F.filter(F.transform(F.array(*map(F.lit, settings.ocr_engines)), of_engine), lambda r: F.length(r["text"]) > 0)
    return F.array_max(each)
