"""Card records: statuses, names, warnings and views of the assembled row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.config import Settings
from cardloom.functions import nid
from cardloom.functions.columns import bound, unused

OK, LOW, UNREADABLE, NOT_FOUND = "ok", "low_confidence", "unreadable", "not_found"
FIELD = "struct<value:string,raw:string,confidence:double,status:string>"


def field(value: Column, raw: Column, confidence: Column, status: Column) -> Column:
    return F.struct(value.alias("value"), raw.alias("raw"), confidence.alias("confidence"), status.alias("status"))


def text_field(has_box: Column, ocr: Column, normalised: Column, confidence: Column, settings: Settings) -> Column:
    """What is known of a text field; what was not read is null."""
    none, text = F.lit(None).cast("string"), F.nullif(F.trim(F.coalesce(ocr, F.lit(""))), F.lit(""))
    good = F.nullif(F.coalesce(normalised, F.lit("")), F.lit(""))
    status = (
        F.when(~has_box, NOT_FOUND).when(text.isNull(), UNREADABLE).when(good.isNull(), UNREADABLE)
        .when(confidence < settings.low_confidence, LOW).otherwise(OK)
    )
    read = has_box & text.isNotNull()
    return field(F.when(read, good), F.when(read, ocr).otherwise(none), F.when(read, confidence).otherwise(0.0), status)


def number_field(has_box: Column, digits: Column, confidence: Column, settings: Settings) -> Column:
    """The number as read: never padded, never guessed."""
    text = F.nullif(F.coalesce(digits, F.lit("")), F.lit(""))
    sure = (F.length(text) == 14) & (confidence >= settings.low_confidence)
    status = F.when(~has_box, NOT_FOUND).when(text.isNull(), UNREADABLE).when(sure, OK).otherwise(LOW)
    read = has_box & text.isNotNull()
    return field(F.when(read, text), F.when(read, text), F.when(read, confidence).otherwise(0.0), status)


def number_warnings(has_box: Column, digits: Column) -> Column:
    text = F.nullif(F.coalesce(digits, F.lit("")), F.lit(""))
    return F.array_compact(
        F.array(
            F.when(~has_box, "The National ID number region was not found on the card."),
            F.when(has_box & text.isNull(), "No digits could be recognised in the National ID region."),
            F.when(has_box & (F.length(text) != 14), F.format_string("Read %d of 14 National ID digits; the number is incomplete and has not been completed by inference.", F.length(text))),
        )
    )


def usable(f: Column) -> Column:
    return F.coalesce(f["value"].isNotNull() & f["status"].isin(OK, LOW), F.lit(False))


def full_name(first: Column, last: Column, settings: Settings) -> Column:
    """The parts that were read, joined; as sure as the less sure one."""
    a, b = F.nullif(first["value"], F.lit("")), F.nullif(last["value"], F.lit(""))
    value = F.nullif(F.concat_ws(" ", a, b), F.lit(""))
    raw = F.nullif(F.trim(F.concat_ws(" ", F.nullif(first["raw"], F.lit("")), F.nullif(last["raw"], F.lit("")))), F.lit(""))
    confidence = F.coalesce(F.least(F.when(a.isNotNull(), first["confidence"]), F.when(b.isNotNull(), last["confidence"])), F.lit(0.0))
    both = a.isNotNull() & b.isNotNull() & (confidence >= settings.low_confidence)
    status = F.when(value.isNull(), first["status"]).when(both, OK).otherwise(LOW)
    return field(value, F.when(value.isNotNull(), raw), confidence, status)


def is_empty(*fields: Column) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & ~usable(f)
    return out


def card_warnings(detected: Column, confidence: Column, side: Column, settings: Settings) -> Column:
    return F.array_compact(
        F.array(
            F.when(~detected, "No ID card outline was detected; processing the image as if it were already cropped to the card."),
            F.when(detected & (confidence < settings.card_conf_warn), F.format_string("Card detected with low confidence (%.2f); results may be unreliable.", confidence)),
            F.when(detected & (side == "back"), "The back of the card was detected. Name, address and the National ID are printed on the front."),
        )
    )


def warnings(*lists: Column) -> Column:
    """All notes in the order in which they arose, each once."""
    return F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))


def assemble(df: DataFrame, settings: Settings, as_of: Column) -> DataFrame:
    """Records from rows with the fields ``first_name``, ``last_name``, ``address``, ``national_id``
    (structs), ``notes`` (an array) and any other columns, which are kept but for those of the
    record's own names: ``full_name``, ``validation``, ``birth_date``, ``governorate``, ``gender``, ``warnings``."""
    number = F.col("national_id.value")
    df = bound(df.drop("full_name"), {"full_name": full_name(F.col("first_name"), F.col("last_name"), settings)})
    digits, said = unused(df, "digits"), unused(df, "decoded")
    df = nid.decoded_columns(df.drop("validation"), number, as_of, (digits, "validation", said))
    known = F.col(said)
    later = F.array_compact(
        F.array(
            F.when(~F.col("validation.checksum_ok"), "The National ID check digit does not match. The official algorithm is unpublished, so this is advisory -- but it often indicates a misread digit."),
            F.when(known.isNull() & (F.length(number) > 0), "Birth date, governorate and gender were not derived because the National ID did not pass validation."),
            F.when(is_empty(F.col("first_name"), F.col("last_name"), F.col("address"), F.col("national_id")), "A card was detected but no field could be read."),
        )
    )
    return df.withColumns(
        {"birth_date": F.date_format(known["birth_date"], "yyyy-MM-dd"), "governorate": known["governorate"], "gender": known["gender"], "warnings": warnings(F.col("notes"), later)}
    ).drop("notes", said, digits)


def flat(df: DataFrame, *keep: str) -> DataFrame:
    """One plain column for each value."""
    return df.select(*keep, *(F.col(f"{c}.value").alias(c) for c in ("full_name", "first_name", "last_name", "address", "national_id")), "birth_date", "governorate", "gender")


def nested_json(df: DataFrame, *keep: str) -> DataFrame:
    """The record as JSON text, nulls kept, confidences to four places; what was found of the card first, where it is known."""
    def rounded(c: str) -> Column:
        return F.col(c).withField("confidence", F.round(F.col(f"{c}.confidence"), 4)).alias(c)

    fields = F.struct(*(rounded(c) for c in ("first_name", "last_name", "full_name", "address", "national_id")))
    derived = F.struct("birth_date", "governorate", "gender")
    place = [F.round(c, 4).alias(c) if c == "card_confidence" else F.col(c) for c in ("card_detected", "card_confidence", "rotation_applied", "side") if c in df.columns]
    record = F.struct(*place, fields.alias("fields"), derived.alias("derived"), "validation", "warnings")
    return df.select(*keep, F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


def human_text(df: DataFrame, *keep: str) -> DataFrame:
    """The record as lines for people: ~ marks what is unsure, a dash what was not read."""
    labels = {"full_name": "Full name", "first_name": "First name", "last_name": "Last name", "address": "Address", "national_id": "National ID"}

    def line(c: str, label: str) -> Column:
        f = F.col(c)
        mark = F.when(f["status"] == LOW, " ~").otherwise("  ")
        read = F.concat(F.lit(f"  {label:<12}"), mark, F.lit(" "), f["value"], F.format_string("   [%.0f%%]", F.bround(f["confidence"] * 100, 0)))
        return F.when(F.length(f["value"]) > 0, read).otherwise(F.concat(F.lit(f"  {label:<12}   — ("), f["status"], F.lit(")")))

    derived = [F.when(F.col("birth_date").isNotNull(), F.concat(F.lit(f"  {label:<12}   "), F.coalesce(c, F.lit("None")))) for c, label in (("birth_date", "Birth date"), ("governorate", "Governorate"), ("gender", "Gender"))]
    errors = F.col("validation.errors")
    valid = F.concat(F.lit(f"  {'ID valid':<12}   "), F.when(F.col("validation.valid"), "yes").otherwise("no"), F.when(F.size(errors) > 0, F.concat(F.lit(" ("), F.array_join(errors, "; "), F.lit(")"))).otherwise(""))
    notes = F.when(F.size("warnings") > 0, F.concat(F.lit("\n  Warnings:\n    · "), F.array_join("warnings", "\n    · ")))
    return df.select(*keep, F.concat_ws("\n", *(line(c, t) for c, t in labels.items()), *derived, valid, notes).alias("text"))


def upload_status(content_type: Column, size: Column, decodes: Column, settings: Settings, configured: Column | bool = True, failed: Column | bool = False) -> Column:
    """The HTTP status that an upload would get; an absent type is allowed. ``configured``: all models are there; ``failed``: reading it raised anything else."""
    named = F.length(F.coalesce(content_type, F.lit(""))) > 0
    ready, broken = (x if isinstance(x, Column) else F.lit(x) for x in (configured, failed))
    return (
        F.when(named & ~content_type.startswith("image/"), 415).when(size > settings.max_upload_bytes, 413)
        .when(F.coalesce(size, F.lit(0)) == 0, 400).when(~decodes, 422).when(~ready, 503).when(broken, 500).otherwise(200)
    )
