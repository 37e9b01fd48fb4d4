"""Registered queries of the card-record operators, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom import refdata
from cardloom.config import Settings
from cardloom.functions import boxes, kernels, nid, pixels, text
from cardloom.functions.columns import bound
from cardloom.operators import correction, detections, extract, records
from cardloom.plans import inputs

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
SETTINGS = Settings()


def query(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB text."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def _as_of():
    return F.lit(inputs.AS_OF).cast("date")


def _decoded(spark, sf_dir):
    return nid.with_decoded(inputs.nid_rows(spark, sf_dir), "number", _as_of())


def _values(pairs: dict, alias: str) -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs.items()) + f") {alias}(k, v)"


_WEIGHTED = " + ".join(f"TRY_CAST(substr(d, {k + 1}, 1) AS INT) * {w}" for k, w in enumerate(refdata.ID_WEIGHTS))
_ARABIC_DIGITS = refdata.ARABIC_INDIC + refdata.EXTENDED_ARABIC_INDIC

_D = f"""
n AS (SELECT row_id, number, regexp_replace(translate(coalesce(number, ''), '{_ARABIC_DIGITS}', '01234567890123456789'), '[^0-9]', '', 'g') AS d FROM ({inputs.DUCK_NID}) z),
c AS (SELECT *, length(d) = 14 AS length_ok, CASE substr(d, 1, 1) WHEN '2' THEN 1900 WHEN '3' THEN 2000 END AS century FROM n),
t AS (SELECT *, lpad(CAST(century + TRY_CAST(substr(d, 2, 2) AS INT) AS VARCHAR), 4, '0') || '-' || substr(d, 4, 2) || '-' || substr(d, 6, 2) AS dt FROM (SELECT *, length_ok AND century IS NOT NULL AS dated FROM c) q),
b AS (SELECT *, CASE WHEN dated THEN try_cast(dt AS DATE) END AS bd, g.v AS governorate,
  CASE WHEN length_ok THEN TRY_CAST(substr(d, 14, 1) AS INT) = (CASE WHEN ({_WEIGHTED}) % 11 < 2 THEN 0 ELSE 11 - ({_WEIGHTED}) % 11 END) END AS checksum_ok FROM t LEFT JOIN {_values(refdata.GOVERNORATES, "g")} ON length_ok AND substr(d, 8, 2) = g.k),
f AS (SELECT *, coalesce(bd <= DATE '{inputs.AS_OF}', false) AS date_ok, governorate IS NOT NULL AS governorate_ok, coalesce(bd <= DATE '{inputs.AS_OF}', false) AND governorate IS NOT NULL AS valid FROM b)
"""


# ------------------------------------------------------------------- identity numbers
@query(f"WITH {_D} SELECT row_id, d AS digits, CAST(length(d) AS INT) AS n FROM n")
def nid_normalize(spark, sf_dir):
    d = nid.normalize_digits(F.col("number"))
    return inputs.nid_rows(spark, sf_dir).select("row_id", d.alias("digits"), F.length(d).alias("n"))


@query(f"WITH {_D} SELECT row_id, valid, length_ok, checksum_ok, date_ok, governorate_ok FROM f")
def nid_validate_flags(spark, sf_dir):
    return _decoded(spark, sf_dir).select("row_id", *(f"validation.{c}" for c in ("valid", "length_ok", "checksum_ok", "date_ok", "governorate_ok")))


@query(
    f"""WITH {_D} SELECT row_id, CASE WHEN d = '' THEN 'no_digits' WHEN NOT length_ok THEN 'expected 14 digits, found ' || length(d) ELSE concat_ws('; ',
  CASE WHEN century IS NULL THEN 'invalid century digit ''' || substr(d, 1, 1) || ''' (expected 2 or 3)' WHEN bd IS NULL THEN 'impossible birth date ' || dt WHEN bd > DATE '{inputs.AS_OF}' THEN 'birth date is in the future' END,
  CASE WHEN governorate IS NULL THEN 'unknown governorate code ''' || substr(d, 8, 2) || '''' END, CASE WHEN NOT checksum_ok THEN 'check_digit_mismatch (advisory)' END) END AS errors FROM f"""
)
def nid_errors(spark, sf_dir):
    return _decoded(spark, sf_dir).select("row_id", F.array_join("validation.errors", "; ").alias("errors"))


@query(f"WITH {_D} SELECT row_id, checksum_ok FROM f WHERE length_ok")
def nid_checksum(spark, sf_dir):
    rows = bound(inputs.nid_rows(spark, sf_dir), {"d": nid.normalize_digits(F.col("number"))}).where(F.length("d") == refdata.ID_LENGTH)
    return rows.select("row_id", nid.checksum_ok(F.col("d")).alias("checksum_ok"))


@query(
    f"""WITH {_D} SELECT row_id, d AS national_id, bd AS birth_date, substr(d, 8, 2) AS governorate_code, governorate, CASE WHEN TRY_CAST(substr(d, 13, 1) AS INT) % 2 = 1 THEN 'male' ELSE 'female' END AS gender,
  substr(d, 10, 4) AS sequence FROM f WHERE valid"""
)
def nid_decode(spark, sf_dir):
    rows = _decoded(spark, sf_dir).withColumnRenamed("decoded", "x").where("x IS NOT NULL")
    return rows.select("row_id", *(f"x.{c}" for c in ("national_id", "birth_date", "governorate_code", "governorate", "gender", "sequence")))


@query(f"WITH {_D} SELECT governorate, CASE WHEN TRY_CAST(substr(d, 13, 1) AS INT) % 2 = 1 THEN 'male' ELSE 'female' END AS gender, count(*) AS n, min(bd) AS first_born, max(bd) AS last_born FROM f WHERE valid GROUP BY 1, 2")
def nid_by_governorate(spark, sf_dir):
    rows = _decoded(spark, sf_dir).withColumnRenamed("decoded", "x").where("x IS NOT NULL")
    return rows.groupBy("x.governorate", "x.gender").agg(F.count("*").alias("n"), F.min("x.birth_date").alias("first_born"), F.max("x.birth_date").alias("last_born"))


@query(f"WITH {_D} SELECT CASE WHEN TRY_CAST(substr(d, 13, 1) AS INT) % 2 = 1 THEN 'male' ELSE 'female' END AS gender, CAST(year(bd) // 10 * 10 AS INT) AS decade, count(*) AS n FROM f WHERE valid GROUP BY 1, 2")
def nid_by_gender_decade(spark, sf_dir):
    rows = _decoded(spark, sf_dir).withColumnRenamed("decoded", "x").where("x IS NOT NULL")
    return rows.groupBy("x.gender", (F.floor(F.year("x.birth_date") / 10) * 10).cast("int").alias("decade")).agg(F.count("*").alias("n"))


@query(f"SELECT o_orderkey, lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS code, g.v AS governorate, e.v AS governorate_en FROM orders LEFT JOIN {_values(refdata.GOVERNORATES, 'g')} ON g.k = lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') LEFT JOIN {_values(refdata.GOVERNORATES_EN, 'e')} ON e.k = g.k")
def gov_lookup_en(spark, sf_dir):
    code = F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", code.alias("code"))
    return rows.select("o_orderkey", "code", nid.governorate(F.col("code")).alias("governorate"), nid.governorate(F.col("code"), english=True).alias("governorate_en"))


@query(
    f"""WITH {_D} SELECT row_id, number AS input, d AS digits, coalesce(valid, false) AS valid, coalesce(valid, false) AS decodes, CASE WHEN valid THEN strftime(bd, '%Y-%m-%d') END AS birth_date, CASE WHEN valid THEN governorate END AS governorate,
  CASE WHEN valid THEN substr(d, 8, 2) END AS governorate_code, CASE WHEN valid THEN CASE WHEN TRY_CAST(substr(d, 13, 1) AS INT) % 2 = 1 THEN 'male' ELSE 'female' END END AS gender FROM f"""
)
def validate_report(spark, sf_dir):
    """The validation report of every number, with what the digits of a valid one say."""
    said = [F.col(f"decoded.{c}") for c in ("governorate", "governorate_code", "gender")]
    date = F.date_format("decoded.birth_date", "yyyy-MM-dd").alias("birth_date")
    return _decoded(spark, sf_dir).select("row_id", F.col("number").alias("input"), "digits", "validation.valid", F.col("decoded").isNotNull().alias("decodes"), date, *said)


# ------------------------------------------------------------------------- detections
_ALIASED = f"""bx AS ({inputs.DUCK_BOX}),
fx AS (SELECT bx.*, lower(trim(raw_class)) LIKE 'invalid\\_%' ESCAPE '\\' AS flagged, regexp_replace(lower(trim(raw_class)), '^invalid_', '') AS stem FROM bx),
fb AS (SELECT fx.*, coalesce(a.v, stem) AS field FROM fx LEFT JOIN {_values(refdata.FIELD_ALIASES, "a")} ON a.k = stem)"""
_BEST = "best AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY card, field ORDER BY confidence DESC, ord) AS rn FROM fb WHERE field <> '') r WHERE rn = 1)"


def _fields(spark, sf_dir):
    return inputs.box_rows(spark, sf_dir).withColumns({"field": boxes.canonical_field(F.col("raw_class")), "flagged": boxes.is_flagged(F.col("raw_class"))})


@query(
    f"""WITH bx AS ({inputs.DUCK_BOX}), p AS (SELECT card, ord, class_name, string_split(lower(class_name), '-') AS s FROM bx),
q AS (SELECT *, len(s) = 2 AND s[1] IN ('front', 'back') AND s[2] IN ('up', 'right', 'down', 'left') AS known FROM p)
SELECT card, ord, class_name, CASE WHEN known THEN s[1] END AS side, CASE WHEN known THEN s[2] END AS orientation, CAST(CASE WHEN known THEN CASE s[2] WHEN 'right' THEN 90 WHEN 'down' THEN 180 WHEN 'left' THEN 270 ELSE 0 END ELSE 0 END AS INT) AS rotation FROM q"""
)
def card_class_parse(spark, sf_dir):
    rows = inputs.box_rows(spark, sf_dir).withColumn("p", boxes.class_parts(F.col("class_name")))
    return rows.select("card", "ord", "class_name", "p.side", "p.orientation", "p.rotation")


@query(f"WITH {_ALIASED} SELECT card, ord, field, flagged FROM fb")
def field_canonical(spark, sf_dir):
    return _fields(spark, sf_dir).select("card", "ord", "field", "flagged")


@query(f"WITH {_ALIASED}, {_BEST} SELECT card, field, ord, confidence FROM best")
def best_per_field(spark, sf_dir):
    return detections.best_per_field(_fields(spark, sf_dir)).select("card", "field", "ord", "confidence")


_REGIONS = f"""rg AS (SELECT bx.*, m.v AS field FROM bx JOIN {_values({str(k): v for k, v in refdata.REGION_CLASSES.items()}, "m")} ON CAST(bx.cls AS VARCHAR) = m.k),
rb AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY card, field ORDER BY confidence DESC, ord) AS rn FROM rg) r WHERE rn = 1)"""


@query(
    f"""WITH {_ALIASED}, {_BEST}, {_REGIONS} SELECT card, field, ord, confidence, raw_class FROM best UNION ALL
SELECT card, field, ord, confidence, 'region:' || cls FROM rb WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.card = rb.card AND best.field = rb.field)"""
)
def merge_detections(spark, sf_dir):
    """Both detectors' boxes are the same rows, under two names: one look at them."""
    rows = _fields(spark, sf_dir)
    second = boxes.region_field(F.col("cls"))
    named = F.array(
        F.struct(F.lit(True).alias("primary"), F.col("field"), F.col("raw_class")), F.struct(F.lit(False).alias("primary"), second.alias("field"), F.concat(F.lit("region:"), F.col("cls")).alias("raw_class"))
    )
    both = rows.select("card", "ord", "confidence", F.inline(named))
    return detections.best_of_both(both).select("card", "field", "ord", "confidence", "raw_class")


@query(f"WITH {_ALIASED}, {_BEST} SELECT card, field FROM (SELECT DISTINCT card FROM fb) x, (VALUES ('first_name'), ('last_name'), ('address'), ('nid')) r(field) EXCEPT SELECT card, field FROM best")
def missing_fields(spark, sf_dir):
    found = _fields(spark, sf_dir)
    return detections.missing_fields(found.select("card").distinct(), detections.best_per_field(found))


@query(
    f"""WITH {_ALIASED} SELECT card, fields, 'The detector flagged these regions as atypical for a genuine card: ' || fields || '. They were still read.' AS warning
FROM (SELECT card, string_agg(DISTINCT field, ', ' ORDER BY field) AS fields FROM fb WHERE flagged GROUP BY card) x"""
)
def flagged_fields(spark, sf_dir):
    return detections.flagged_fields(_fields(spark, sf_dir))


_INTER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
_UNION = f"((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_INTER})"


@query(f"WITH bx AS ({inputs.DUCK_BOX}) SELECT a.card, a.ord AS ord_a, b.ord AS ord_b, CASE WHEN {_INTER} > 0 THEN {_INTER} / {_UNION} ELSE 0.0 END AS iou FROM bx a JOIN bx b ON a.card = b.card AND a.ord < b.ord")
def iou_pairs(spark, sf_dir):
    """Pairs within a card, which has at most some tens of boxes."""
    rows = inputs.box_rows(spark, sf_dir).select("card", "ord", F.struct("x1", "y1", "x2", "y2").alias("box"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.card") == F.col("b.card")) & (F.col("a.ord") < F.col("b.ord")))
    return pairs.select("a.card", F.col("a.ord").alias("ord_a"), F.col("b.ord").alias("ord_b"), boxes.iou(F.col("a.box"), F.col("b.box")).alias("iou"))


@query(
    f"""WITH RECURSIVE bx AS ({inputs.DUCK_BOX}), k AS (SELECT card, ord, cls, confidence, x1, y1, x2, y2, row_number() OVER (PARTITION BY card ORDER BY confidence DESC, ord) AS r FROM bx WHERE confidence >= 0.25 AND cls BETWEEN 0 AND 9),
o AS (SELECT a.card, a.r AS ra, b.r AS rb FROM k a JOIN k b ON a.card = b.card AND a.r < b.r WHERE {_INTER} > 0 AND {_INTER} / {_UNION} >= 0.40),
w(card, r, kept) AS (SELECT card, r, [r] FROM k WHERE r = 1 UNION ALL SELECT k.card, k.r, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.card = k.card AND o.rb = k.r AND list_contains(w.kept, o.ra)) THEN w.kept ELSE list_append(w.kept, k.r) END FROM w JOIN k ON k.card = w.card AND k.r = w.r + 1),
l AS (SELECT card, kept FROM w QUALIFY row_number() OVER (PARTITION BY card ORDER BY r DESC) = 1),
s AS (SELECT l.card, k.cls, k.confidence, k.x1, list_position(l.kept, k.r) AS p FROM l JOIN k ON k.card = l.card AND list_contains(l.kept, k.r))
SELECT card, string_agg(CAST(cls AS VARCHAR), '' ORDER BY x1, p) AS digits, CAST(count(*) AS INT) AS n, round(avg(confidence), 6) AS confidence, count(*) = 14 AS complete FROM s GROUP BY card"""
)
def digit_nms(spark, sf_dir):
    got = detections.read_digits(inputs.box_rows(spark, sf_dir).withColumnRenamed("card", "strip"), SETTINGS)
    return got.select(F.col("strip").alias("card"), "digits", "n", F.round("confidence", 6).alias("confidence"), "complete")


_MARGIN = "(VALUES " + ", ".join(f"('{k}', {w}, {h})" for k, (w, h) in refdata.FIELD_MARGINS.items()) + ") m(k, w, h)"


def _grown(lo: str, hi: str, scale: str, most: int, sign: str) -> str:
    return f"CAST(trunc(greatest(0.0, least({most}.0, ({lo} + {hi}) / 2 {sign} ({hi} - {lo}) * {scale} / 2))) AS INT)"


@query(
    f"""WITH {_ALIASED}, s AS (SELECT fb.*, CAST(coalesce(m.w, 1.10) AS DOUBLE) AS sw, CAST(coalesce(m.h, 1.20) AS DOUBLE) AS sh FROM fb LEFT JOIN {_MARGIN} ON m.k = fb.field)
SELECT card, ord, {_grown('x1', 'x2', 'sw', 1000, '-')} AS x1, {_grown('y1', 'y2', 'sh', 630, '-')} AS y1, {_grown('x1', 'x2', 'sw', 1000, '+')} AS x2, {_grown('y1', 'y2', 'sh', 630, '+')} AS y2 FROM s"""
)
def expand_clamp_box(spark, sf_dir):
    m = boxes.margins(F.col("field"))
    grown = boxes.expand(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), m["w"], m["h"], 1000, 630)
    return _fields(spark, sf_dir).select("card", "ord", grown.alias("g")).select("card", "ord", "g.x1", "g.y1", "g.x2", "g.y2")


@query(f"WITH bx AS ({inputs.DUCK_BOX}), k AS (SELECT card, ord, greatest(0, CAST(x1 AS INT) - 40) AS a, greatest(0, CAST(y1 AS INT) - 40) AS b, least(500, CAST(x2 AS INT) - 40) AS c, least(200, CAST(y2 AS INT) - 40) AS d FROM (SELECT card, ord, x1 + 80 AS x1, y1 + 80 AS y1, x2, y2 FROM bx) q) SELECT card, ord, c > a AND d > b AS found, CASE WHEN c > a AND d > b THEN (c - a) * (d - b) END AS pixels FROM k")
def safe_crop(spark, sf_dir):
    """Boxes shrunk by 40 pixels, in a picture of 500 by 200; some vanish."""
    c = boxes.crop(F.col("x1") + 40, F.col("y1") + 40, F.col("x2") - 40, F.col("y2") - 40, 0, 500, 200)
    return inputs.box_rows(spark, sf_dir).select("card", "ord", c.alias("c")).select("card", "ord", F.col("c").isNotNull().alias("found"), ((F.col("c.x2") - F.col("c.x1")) * (F.col("c.y2") - F.col("c.y1"))).alias("pixels"))


@query(
    f"""WITH bx AS ({inputs.DUCK_BOX}), g AS (SELECT card, ord, class_name, confidence, {_grown('x1', 'x2', '1.04', 1000, '+')} - {_grown('x1', 'x2', '1.04', 1000, '-')} AS w, {_grown('y1', 'y2', '1.04', 630, '+')} - {_grown('y1', 'y2', '1.04', 630, '-')} AS h FROM bx WHERE confidence >= 0.25)
SELECT card, ord, class_name, confidence FROM g WHERE w >= 200 AND h >= 120 QUALIFY row_number() OVER (PARTITION BY card ORDER BY confidence DESC, ord) = 1"""
)
def card_pick(spark, sf_dir):
    return detections.pick_card(inputs.box_rows(spark, sf_dir), SETTINGS, 1000, 630, image="card").select("card", "ord", "class_name", "confidence")


@query(
    f"""WITH {_ALIASED}, r AS (SELECT card, rotation, field, confidence, CASE rotation WHEN 0 THEN (x1 + x2) / 2 WHEN 90 THEN 1000 - (y1 + y2) / 2 WHEN 180 THEN 1000 - (x1 + x2) / 2 ELSE (y1 + y2) / 2 END AS cx,
  CASE rotation WHEN 0 THEN (y1 + y2) / 2 WHEN 90 THEN (x1 + x2) / 2 WHEN 180 THEN 630 - (y1 + y2) / 2 ELSE 630 - (x1 + x2) / 2 END AS cy FROM fb, (VALUES (0), (90), (180), (270)) t(rotation)),
s AS (SELECT card, CAST(rotation AS INT) AS rotation, round(sum(confidence * 10 + CASE WHEN field = 'nid' THEN CASE WHEN cy > 378 THEN 40 ELSE -40 END WHEN field = 'serial' THEN CASE WHEN cy < 252 THEN 25 ELSE -25 END
  WHEN field IN ('first_name', 'last_name') THEN CASE WHEN cx > 450 THEN 20 ELSE -20 END WHEN field = 'photo' THEN CASE WHEN cx < 400 THEN 20 ELSE -20 END ELSE 0 END), 6) AS score FROM r GROUP BY card, rotation)
SELECT card, rotation, score FROM s QUALIFY row_number() OVER (PARTITION BY card ORDER BY score DESC, rotation) = 1"""
)
def layout_orientation(spark, sf_dir):
    """The quarter turn under which a card's boxes lie best."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    turned = _fields(spark, sf_dir).select("card", "field", "confidence", F.explode(F.array(*map(F.lit, (0, 90, 180, 270)))).alias("rotation"), cx.alias("cx"), cy.alias("cy"))
    x = F.when(F.col("rotation") == 0, F.col("cx")).when(F.col("rotation") == 90, 1000 - F.col("cy")).when(F.col("rotation") == 180, 1000 - F.col("cx")).otherwise(F.col("cy"))
    y = F.when(F.col("rotation") == 0, F.col("cy")).when(F.col("rotation") == 90, F.col("cx")).when(F.col("rotation") == 180, 630 - F.col("cy")).otherwise(630 - F.col("cx"))
    placed = turned.select("card", "field", "confidence", "rotation", x.alias("x1"), x.alias("x2"), y.alias("y1"), y.alias("y2"))
    scores = detections.layout_scores(placed, 1000, 630, image="card").withColumn("score", F.round("score", 6))
    return detections.best_rotation(scores, image="card").select("card", "rotation", "score")


# ---------------------------------------------------------------------------- reading
@query(
    f"""WITH RECURSIVE q AS ({inputs.DUCK_READING}), e AS (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY cy, ord) AS r, greatest(8.0, 630 * 0.45 / count(*) OVER (PARTITION BY crop)) AS tol FROM q),
w(crop, r, line, y) AS (SELECT crop, r, 0, cy FROM e WHERE r = 1 UNION ALL SELECT e.crop, e.r, CASE WHEN abs(e.cy - w.y) > e.tol THEN w.line + 1 ELSE w.line END, CASE WHEN abs(e.cy - w.y) > e.tol THEN e.cy ELSE w.y END FROM w JOIN e ON e.crop = w.crop AND e.r = w.r + 1)
SELECT w.crop, e.ord, CAST(w.line AS INT) AS line, CAST(row_number() OVER (PARTITION BY w.crop ORDER BY w.line, -e.cx, w.r) - 1 AS INT) AS position FROM w JOIN e ON e.crop = w.crop AND e.r = w.r"""
)
def reading_order(spark, sf_dir):
    return detections.reading_order(inputs.reading_rows(spark, sf_dir)).select("crop", "ord", "line", "position")


@query(
    f"""WITH q AS ({inputs.DUCK_READING}), k AS (SELECT * FROM q WHERE engine IN ('easyocr', 'paddleocr') AND length(trim(text)) > 0)
SELECT crop, engine, text, confidence FROM (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY confidence DESC, length(text) DESC, engine, ord) AS rn FROM k) x WHERE rn = 1"""
)
def engine_ensemble(spark, sf_dir):
    """Readings of an engine that tie are reported in their order."""
    rows = inputs.reading_rows(spark, sf_dir).where(F.length(F.trim("text")) > 0)
    first = detections._first(rows, ["crop", "engine"], F.desc(F.round("confidence", 2)), F.desc(F.length("text")), F.asc("ord"))
    return detections.best_engine(first, SETTINGS).select("crop", "engine", "text", "confidence")


@query(
    f"""WITH q AS ({inputs.DUCK_READING}) SELECT crop, ord, CASE WHEN ord % 5 = 0 THEN 'not_found' WHEN length(trim(text)) = 0 THEN 'unreadable' WHEN ord % 7 = 0 THEN 'unreadable' WHEN confidence < 0.4 THEN 'low_confidence' ELSE 'ok' END AS status,
  CASE WHEN ord % 5 <> 0 AND length(trim(text)) > 0 AND ord % 7 <> 0 THEN upper(text) END AS value, CASE WHEN ord % 5 <> 0 AND length(trim(text)) > 0 THEN text END AS raw,
  CASE WHEN ord % 5 <> 0 AND length(trim(text)) > 0 THEN confidence ELSE 0.0 END AS confidence FROM q"""
)
def status_matrix(spark, sf_dir):
    """Text fields in every state: no box, no text, nothing left of it, unsure, sure."""
    normal = F.when(F.col("ord") % 7 == 0, "").otherwise(F.upper("text"))
    f = records.text_field(F.col("ord") % 5 != 0, F.col("text"), normal, F.col("confidence"), SETTINGS)
    return inputs.reading_rows(spark, sf_dir).select("crop", "ord", f.alias("f")).select("crop", "ord", "f.status", "f.value", "f.raw", "f.confidence")


_WS = r"[\s\x1c-\x1f\x85\p{Z}]"
_FIXES = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in refdata.ORTHOGRAPHIC_FIXES.items()) + "}"


def _fixed_word(x: str) -> str:
    """Final heh to ta marbuta, in DuckDB."""
    kept = ", ".join(f"'{w}'" for w in refdata.TA_MARBUTA_EXCEPTIONS)
    return rf"CASE WHEN {x} LIKE '%ه' AND length({x}) >= 4 AND {x} NOT IN ({kept}) AND NOT regexp_matches({x}, '\p{{Nd}}') AND {x} NOT LIKE '%الله' AND {x} NOT LIKE '%لله' THEN substr({x}, 1, length({x}) - 1) || 'ة' ELSE {x} END"


_LATIN = r"'^(?:[A-Za-z]|[^\p{L}\p{M}\p{N}\p{Pc}]|\p{Nd})+$'"


def _normal(said: str, drop: bool) -> str:
    """Normalised text without compatibility forms, in DuckDB."""
    plain = rf"regexp_replace(regexp_replace(regexp_replace({said}, '[{refdata.DIACRITICS}{refdata.TATWEEL}]', '', 'g'), '[|\[\]{{}}<>_=+*^~\\/©®°¦¬]', ' ', 'g'), '{_WS}+', ' ', 'g')"
    words = rf"list_filter(string_split_regex(regexp_replace({plain}, '(^|{_WS})ال{_WS}+([ء-ي])', '\1ال\2', 'g'), '{_WS}+'), lambda x: length(x) > 0" + (f" AND NOT regexp_matches(x, {_LATIN}))" if drop else ")")
    return f"array_to_string(list_transform(list_transform(list_transform({words}, lambda x: coalesce({_FIXES}[x], x)), lambda x: {_fixed_word('x')}), lambda x: coalesce({_FIXES}[x], x)), ' ')"


def _record_rows(spark, sf_dir):
    """Every card, with a reading for each field, the surest of all its boxes, and a number from the orders."""
    rows = inputs.reading_rows(spark, sf_dir).withColumn("role", (F.col("ord") - 1) % 4 + 1)
    rows = detections._first(rows, ["crop", "role"], F.desc("confidence"), F.asc("ord"))

    def of(k: int):
        return F.max(F.when(F.col("role") == k, F.struct("text", "confidence")))

    wide = rows.groupBy("crop").agg(*(of(k).alias(f"t{k}") for k in (1, 2, 3, 4)))
    numbers = bound(inputs.nid_rows(spark, sf_dir).withColumnRenamed("row_id", "crop"), {"digits": nid.normalize_digits(F.col("number"))}).select("crop", "digits")
    wide = numbers.join(wide, "crop", "left")
    places = ((1, "first_name"), (2, "last_name"), (3, "address"))
    wide = bound(wide, {f"n{k}": text.normalize_composed(F.col(f"t{k}.text"), name != "address") for k, name in places})
    fields = {name: records.text_field(F.col(f"t{k}").isNotNull(), F.col(f"t{k}.text"), F.col(f"n{k}"), F.col(f"t{k}.confidence"), SETTINGS) for k, name in places}
    box = F.col("t4").isNotNull()
    wide = bound(wide, fields | {"national_id": records.number_field(box, F.col("digits"), F.col("t4.confidence"), SETTINGS), "notes": records.number_warnings(box, F.col("digits"))})
    return records.assemble(wide, SETTINGS, _as_of())


_RECORD = f"""{_D}, q AS (SELECT *, (ord - 1) % 4 + 1 AS role FROM ({inputs.DUCK_READING}) z QUALIFY row_number() OVER (PARTITION BY crop, (ord - 1) % 4 ORDER BY confidence DESC, ord) = 1),
x AS (SELECT crop, max(CASE WHEN role = 1 THEN text END) AS a, max(CASE WHEN role = 1 THEN confidence END) AS ca, max(CASE WHEN role = 2 THEN text END) AS b, max(CASE WHEN role = 2 THEN confidence END) AS cb,
  max(CASE WHEN role = 3 THEN text END) AS c3, max(CASE WHEN role = 3 THEN confidence END) AS cc, max(CASE WHEN role = 4 THEN confidence END) AS c4 FROM q GROUP BY crop),
rec AS (SELECT f.row_id AS crop, nullif({_normal('a', True)}, '') AS first_name, ca, nullif({_normal('b', True)}, '') AS last_name, cb, nullif({_normal('c3', False)}, '') AS address, CASE WHEN c4 IS NOT NULL THEN nullif(d, '') END AS national_id, c4, a, b, c3, cc, length_ok, date_ok, governorate_ok, century, bd, dt, f.governorate AS gov,
  CASE WHEN valid AND c4 IS NOT NULL THEN strftime(bd, '%Y-%m-%d') END AS birth_date, CASE WHEN valid AND c4 IS NOT NULL THEN governorate END AS governorate,
  CASE WHEN valid AND c4 IS NOT NULL THEN CASE WHEN TRY_CAST(substr(d, 13, 1) AS INT) % 2 = 1 THEN 'male' ELSE 'female' END END AS gender, valid, checksum_ok, d FROM f LEFT JOIN x ON f.row_id = x.crop)"""


@query(f"WITH {_RECORD} SELECT crop, nullif(concat_ws(' ', first_name, last_name), '') AS full_name, first_name, last_name, address, national_id, birth_date, governorate, gender FROM rec")
def record_flat(spark, sf_dir):
    return records.flat(_record_rows(spark, sf_dir), "crop")


@query(f"WITH {_RECORD} SELECT crop, first_name IS NULL AND last_name IS NULL AND address IS NULL AND national_id IS NULL AS empty FROM rec")
def record_empty(spark, sf_dir):
    e = records.is_empty(*map(F.col, ("first_name", "last_name", "address", "national_id")))
    return _record_rows(spark, sf_dir).select("crop", e.alias("empty"))


_WARNINGS = f"""concat_ws(' / ', CASE WHEN c4 IS NULL THEN 'The National ID number region was not found on the card.' WHEN d = '' THEN 'No digits could be recognised in the National ID region.'
  WHEN length(d) <> 14 THEN 'Read ' || length(d) || ' of 14 National ID digits; the number is incomplete and has not been completed by inference.' END,
  CASE WHEN c4 IS NOT NULL AND NOT checksum_ok THEN 'The National ID check digit does not match. The official algorithm is unpublished, so this is advisory -- but it often indicates a misread digit.' END,
  CASE WHEN national_id IS NOT NULL AND NOT valid THEN 'Birth date, governorate and gender were not derived because the National ID did not pass validation.' END,
  CASE WHEN first_name IS NULL AND last_name IS NULL AND address IS NULL AND national_id IS NULL THEN 'A card was detected but no field could be read.' END)"""


@query(
    f"WITH {_RECORD} SELECT crop, {_WARNINGS} AS warnings FROM rec"
)
def warnings_dedup(spark, sf_dir):
    return _record_rows(spark, sf_dir).select("crop", F.array_join("warnings", " / ").alias("warnings"))


def _text_parts(name: str, text: str, sure: str) -> dict[str, str]:
    """What is known of a text field, in DuckDB."""
    read = f"({sure} IS NOT NULL AND trim({text}) <> '')"
    status = f"CASE WHEN {sure} IS NULL THEN 'not_found' WHEN {name} IS NULL THEN 'unreadable' WHEN {sure} < 0.4 THEN 'low_confidence' ELSE 'ok' END"
    return {"value": name, "raw": f"CASE WHEN {read} THEN {text} END", "confidence": f"CASE WHEN {read} THEN {sure} ELSE 0.0 END", "status": status}


_ID_PARTS = {
    "value": "national_id", "raw": "national_id", "confidence": "CASE WHEN national_id IS NOT NULL THEN c4 ELSE 0.0 END",
    "status": "CASE WHEN c4 IS NULL THEN 'not_found' WHEN national_id IS NULL THEN 'unreadable' WHEN length(d) = 14 AND c4 >= 0.4 THEN 'ok' ELSE 'low_confidence' END",
}
_FIRST, _LAST = _text_parts("first_name", "a", "ca"), _text_parts("last_name", "b", "cb")
_BOTH_SURE = "coalesce(least(CASE WHEN first_name IS NOT NULL THEN ca END, CASE WHEN last_name IS NOT NULL THEN cb END), 0.0)"
_FULL_PARTS = {
    "value": "nullif(concat_ws(' ', first_name, last_name), '')", "raw": f"CASE WHEN first_name IS NOT NULL OR last_name IS NOT NULL THEN nullif(trim(concat_ws(' ', {_FIRST['raw']}, {_LAST['raw']})), '') END", "confidence": _BOTH_SURE,
    "status": f"CASE WHEN first_name IS NULL AND last_name IS NULL THEN {_FIRST['status']} WHEN first_name IS NOT NULL AND last_name IS NOT NULL AND {_BOTH_SURE} >= 0.4 THEN 'ok' ELSE 'low_confidence' END",
}
_PARTS = {"first_name": _FIRST, "last_name": _LAST, "full_name": _FULL_PARTS, "address": _text_parts("address", "c3", "cc"), "national_id": _ID_PARTS}
_ERRORS = f"""CASE WHEN national_id IS NULL THEN ['no_digits'] WHEN NOT length_ok THEN ['expected 14 digits, found ' || length(d)] ELSE list_filter([
  CASE WHEN century IS NULL THEN 'invalid century digit ''' || substr(d, 1, 1) || ''' (expected 2 or 3)' WHEN bd IS NULL THEN 'impossible birth date ' || dt WHEN bd > DATE '{inputs.AS_OF}' THEN 'birth date is in the future' END,
  CASE WHEN gov IS NULL THEN 'unknown governorate code ''' || substr(d, 8, 2) || '''' END, CASE WHEN NOT checksum_ok THEN 'check_digit_mismatch (advisory)' END], lambda e: e IS NOT NULL) END"""
_GOOD = "(national_id IS NOT NULL AND coalesce(valid, false))"
_VALIDATION = f"""{{'valid': {_GOOD}, 'length_ok': national_id IS NOT NULL AND length_ok, 'checksum_ok': CASE WHEN national_id IS NOT NULL THEN checksum_ok END,
  'date_ok': national_id IS NOT NULL AND date_ok, 'governorate_ok': national_id IS NOT NULL AND governorate_ok, 'errors': {_ERRORS}}}"""
_JSON_FIELDS = ", ".join(f"'{f}': {{'value': {x['value']}, 'raw': {x['raw']}, 'confidence': round({x['confidence']}, 4), 'status': {x['status']}}}" for f, x in _PARTS.items())
_NOTES = f"CASE WHEN {_WARNINGS} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({_WARNINGS}, ' / ') END"


@query(f"WITH {_RECORD} SELECT crop, {_FULL_PARTS['value']} AS value, {_FULL_PARTS['confidence']} AS confidence, {_FULL_PARTS['status']} AS status FROM rec")
def full_name(spark, sf_dir):
    return _record_rows(spark, sf_dir).select("crop", "full_name.value", "full_name.confidence", "full_name.status")


@query(f"""WITH {_RECORD} SELECT crop, CAST(to_json({{'fields': {{{_JSON_FIELDS}}}, 'derived': {{'birth_date': birth_date, 'governorate': governorate, 'gender': gender}}, 'validation': {_VALIDATION}, 'warnings': {_NOTES}}}) AS VARCHAR) AS json FROM rec""")
def record_json(spark, sf_dir):
    return records.nested_json(_record_rows(spark, sf_dir), "crop")


def _line(name: str, label: str) -> str:
    """A field's line, in DuckDB."""
    x = _PARTS[name]
    mark, sure = f"CASE WHEN {x['status']} = 'low_confidence' THEN ' ~' ELSE '  ' END", f"CAST(CAST(round_even({x['confidence']} * 100, 0) AS INT) AS VARCHAR)"
    return f"CASE WHEN {x['value']} IS NOT NULL THEN '  {label:<12}' || {mark} || ' ' || {x['value']} || '   [' || {sure} || '%]' ELSE '  {label:<12}   — (' || {x['status']} || ')' END"


_LINES = ", ".join(_line(f, label) for f, label in (("full_name", "Full name"), ("first_name", "First name"), ("last_name", "Last name"), ("address", "Address"), ("national_id", "National ID")))
_DERIVED = ", ".join(f"CASE WHEN birth_date IS NOT NULL THEN '  {label:<12}   ' || coalesce({c}, 'None') END" for c, label in (("birth_date", "Birth date"), ("governorate", "Governorate"), ("gender", "Gender")))
_VALID_LINE = f"'  {'ID valid':<12}   ' || CASE WHEN {_GOOD} THEN 'yes' ELSE 'no' END || CASE WHEN len({_ERRORS}) > 0 THEN ' (' || array_to_string({_ERRORS}, '; ') || ')' ELSE '' END"
_NOTE_LINES = f"CASE WHEN {_WARNINGS} <> '' THEN chr(10) || '  Warnings:' || chr(10) || '    · ' || replace({_WARNINGS}, ' / ', chr(10) || '    · ') END"


@query(f"WITH {_RECORD} SELECT crop, concat_ws(chr(10), {_LINES}, {_DERIVED}, {_VALID_LINE}, {_NOTE_LINES}) AS text FROM rec")
def record_text(spark, sf_dir):
    return records.human_text(_record_rows(spark, sf_dir), "crop")


@query(
    f"""WITH bx AS ({inputs.DUCK_BOX}) SELECT card, ord, concat_ws('; ', CASE WHEN NOT detected THEN 'No ID card outline was detected; processing the image as if it were already cropped to the card.' END,
  CASE WHEN detected AND confidence < 0.45 THEN 'Card detected with low confidence (' || printf('%.2f', confidence) || '); results may be unreliable.' END,
  CASE WHEN detected AND side = 'back' THEN 'The back of the card was detected. Name, address and the National ID are printed on the front.' END) AS notes
FROM (SELECT card, ord, confidence, confidence >= 0.25 AS detected, CASE WHEN part % 7 IN (1) THEN 'back' END AS side FROM bx) q"""
)
def card_notes(spark, sf_dir):
    side = boxes.class_parts(F.col("class_name"))["side"]
    notes = records.card_warnings(F.col("confidence") >= SETTINGS.card_conf, F.col("confidence"), side, SETTINGS)
    return inputs.box_rows(spark, sf_dir).select("card", "ord", F.array_join(notes, "; ").alias("notes"))


@query(
    f"""WITH bx AS ({inputs.DUCK_BOX}) SELECT card, ord, concat_ws('; ', CASE WHEN x1 < 100 THEN 'image appears blurred (sharpness=' || CAST(x1 AS BIGINT) || ')' END, CASE WHEN y1 < 45 THEN 'low contrast (std=' || CAST(y1 AS BIGINT) || ')' END,
  CASE WHEN supp % 9 > 6 THEN 'noisy image (sigma=' || (supp % 9) || '.0)' END, CASE WHEN part % 256 < 70 THEN 'image is underexposed' END, CASE WHEN part % 256 > 200 THEN 'image is overexposed' END) AS notes FROM bx"""
)
def quality_flags(spark, sf_dir):
    notes = boxes.quality_notes(F.col("x1"), F.col("y1"), (F.col("supp") % 9).cast("double"), (F.col("part") % 256).cast("double"))
    return inputs.box_rows(spark, sf_dir).select("card", "ord", F.array_join(notes, "; ").alias("notes"))


@query(f"WITH {_ALIASED} SELECT field, count(*) AS n, round(avg(confidence), 9) AS mean, min(confidence) AS least, round(var_pop(confidence), 9) AS variance, round(stddev_pop(confidence), 9) AS deviation FROM fb GROUP BY field")
def confidence_stats(spark, sf_dir):
    c = F.col("confidence")
    return _fields(spark, sf_dir).groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg(c), 9).alias("mean"), F.min(c).alias("least"), F.round(F.var_pop(c), 9).alias("variance"), F.round(F.stddev_pop(c), 9).alias("deviation"))


@query(
    """SELECT page_id, CAST(CASE WHEN page_id % 7 = 3 THEN 415 WHEN n * 2000 > 10485760 THEN 413 WHEN n = 0 THEN 400 WHEN page_id % 5 = 1 THEN 422 WHEN page_id % 13 = 2 THEN 503 WHEN page_id % 17 = 5 THEN 500 ELSE 200 END AS INT) AS http_status
FROM (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 0 ELSE strlen(coalesce(html, '')) END AS n FROM pages) x"""
)
def upload_guard(spark, sf_dir):
    kind = F.when(F.col("page_id") % 7 == 3, "application/pdf").when(F.col("page_id") % 7 == 4, "").otherwise("image/png")
    n = F.when(F.col("page_id") % 11 == 0, 0).otherwise(F.octet_length(F.coalesce("html", F.lit("")))) * 2000
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select("page_id", records.upload_status(kind, n.cast("bigint"), F.col("page_id") % 5 != 1, SETTINGS, F.col("page_id") % 13 != 2, F.col("page_id") % 17 == 5).alias("http_status"))


@query(
    f"""WITH bx AS ({inputs.DUCK_BOX}) SELECT card, ord, coalesce(w > 1 AND h > 1 AND (abs(w / h - 85.6 / 54) <= 0.45 OR abs(h / w - 85.6 / 54) <= 0.45), false) AS card_like FROM (SELECT card, ord, x2 - x1 AS w, CAST(8 + ord * 20 AS DOUBLE) AS h FROM bx) q"""
)
def aspect_gate(spark, sf_dir):
    ok = boxes.aspect_is_card_like(F.col("x2") - F.col("x1"), (8 + F.col("ord") * 20).cast("double"))
    return inputs.box_rows(spark, sf_dir).select("card", "ord", ok.alias("card_like"))


_QUAD = [("x1 + part % 13", "y1 + supp % 11"), ("x2", "y1 - part % 5"), ("x1 - supp % 7", "y2 + part % 9"), ("x2 - supp % 17", "y2")]


def _corner(key: str) -> str:
    """The point of least key, in DuckDB."""
    return f"list_sort(list_transform(list_zip(p, [1, 2, 3, 4]), lambda z: {{'k': {key}, 'i': z[2], 'x': z[1].x, 'y': z[1].y}}))[1]"


@query(
    f"""WITH bx AS ({inputs.DUCK_BOX}), q AS (SELECT card, ord, [{", ".join(f"{{'x': {x}, 'y': {y}}}" for x, y in _QUAD)}] AS p FROM bx),
c AS (SELECT card, ord, {_corner('z[1].x + z[1].y')} AS tl, {_corner('z[1].y - z[1].x')} AS tr, {_corner('-(z[1].x + z[1].y)')} AS br, {_corner('z[1].x - z[1].y')} AS bl FROM q)
SELECT card, ord, {", ".join(f"{c}.{a} AS {c}_{a}" for c in ("tl", "tr", "br", "bl") for a in "xy")} FROM c"""
)
def corner_order(spark, sf_dir):
    """Corners of leaning quadrilaterals, reported in any order."""
    points = F.array(*(F.struct(F.expr(x).alias("x"), F.expr(y).alias("y")) for x, y in _QUAD))
    rows = inputs.box_rows(spark, sf_dir).select("card", "ord", boxes.order_corners(points).alias("c"))
    return rows.select("card", "ord", *(F.col(f"c.{c}.{a}").alias(f"{c}_{a}") for c in ("tl", "tr", "br", "bl") for a in "xy"))


# ------------------------------------------------------------------------------- text
_TX = f"tx AS ({inputs.DUCK_TEXT})"


@query(rf"WITH {_TX} SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(piece, '[|\[\]{{}}<>_=+*^~\\/©®°¦¬]', ' ', 'g'), '{_WS}+', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g') AS cleaned FROM tx")
def noise_clean(spark, sf_dir):
    return inputs.text_rows(spark, sf_dir).select("doc_id", text.clean_noise(F.col("piece")).alias("cleaned"))


@query(f"WITH {_TX} SELECT doc_id, regexp_matches(text, '[{refdata.ARABIC_CHARS}]') AS arabic FROM tx")
def contains_arabic(spark, sf_dir):
    return inputs.text_rows(spark, sf_dir).select("doc_id", text.contains_arabic(F.col("text")).alias("arabic"))


@query(f"WITH {_TX} SELECT doc_id, regexp_replace(text, '[{refdata.DIACRITICS}{refdata.TATWEEL}]', '', 'g') AS plain FROM tx")
def strip_diacritics(spark, sf_dir):
    return inputs.text_rows(spark, sf_dir).select("doc_id", text.strip_diacritics(F.col("text")).alias("plain"))


@query(f"WITH {_TX} SELECT doc_id, translate(text, '{_ARABIC_DIGITS}', '01234567890123456789') AS western FROM tx")
def western_digits(spark, sf_dir):
    return inputs.text_rows(spark, sf_dir).select("doc_id", text.western_digits(F.col("text")).alias("western"))


@query(rf"WITH {_TX} SELECT doc_id, regexp_replace(text, '(^|{_WS})ال{_WS}+([ء-ي])', '\1ال\2', 'g') AS merged FROM tx")
def merge_article(spark, sf_dir):
    return inputs.text_rows(spark, sf_dir).select("doc_id", text.merge_article(F.col("text")).alias("merged"))


_WORDS = f"w AS (SELECT doc_id, list_filter(string_split_regex(text, '{_WS}+'), lambda x: length(x) > 0) AS words FROM tx)"


@query(
    rf"""WITH {_TX}, {_WORDS} SELECT doc_id, array_to_string(list_transform(words, lambda x: CASE WHEN x LIKE '%ه' AND length(x) >= 4 AND x NOT IN ({", ".join(f"'{x}'" for x in refdata.TA_MARBUTA_EXCEPTIONS)}) AND NOT regexp_matches(x, '\p{{Nd}}')
  AND x NOT LIKE '%الله' AND x NOT LIKE '%لله' THEN substr(x, 1, length(x) - 1) || 'ة' ELSE x END), ' ') AS fixed FROM w"""
)
def ta_marbuta(spark, sf_dir):
    fixed = F.transform(text.tokens(F.col("text")), text.fix_ta_marbuta)
    return inputs.text_rows(spark, sf_dir).select("doc_id", F.array_join(fixed, " ").alias("fixed"))


@query(f"WITH {_TX}, {_WORDS} SELECT doc_id, array_to_string(list_transform(words, lambda x: coalesce({_FIXES}[x], x)), ' ') AS fixed FROM w")
def orthographic(spark, sf_dir):
    return inputs.text_rows(spark, sf_dir).select("doc_id", F.array_join(F.transform(text.tokens(F.col("text")), text.orthographic), " ").alias("fixed"))


@query(rf"WITH {_TX}, {_WORDS} SELECT doc_id, array_to_string(list_filter(words, lambda x: NOT regexp_matches(x, '^(?:[A-Za-z]|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]|\p{{Nd}})+$')), ' ') AS kept FROM w")
def drop_latin(spark, sf_dir):
    kept = F.filter(text.tokens(F.col("text")), lambda w: ~text.is_latin_only(w))
    return inputs.text_rows(spark, sf_dir).select("doc_id", F.array_join(kept, " ").alias("kept"))


@query()
def normalize_arabic(spark, sf_dir):
    rows = inputs.text_rows(spark, sf_dir)
    return rows.select("doc_id", text.normalize_arabic(F.col("text"), F.col("doc_id") % 2 == 0).alias("normal"))


_LEXICON = "(VALUES " + ", ".join(f"('{kind}', {k}, '{e}')" for kind, entries in refdata.LEXICONS.items() for k, e in enumerate(entries)) + ") l(kind, k, entry)"
_ENTRIES = [*refdata.COMMON_NAMES, *refdata.ADDRESS_TERMS]
#: The table of the longest common subsequence of w and entry, a row at a time; its last cell is the length.
_LCS = """list_reduce(list_concat([list_transform(range(length(entry) + 1), lambda z: 0)], list_transform(range(1, length(w) + 1), lambda z: [CAST(z AS INT)])), lambda row, x:
  list_reduce(list_concat([[0]], list_transform(range(1, length(entry) + 1), lambda z: [CAST(z AS INT)])), lambda acc, y:
    list_append(acc, CASE WHEN entry[y[1]] = w[x[1]] THEN row[y[1]] + 1 ELSE greatest(row[y[1] + 1], acc[len(acc)]) END)))[-1]"""


@query(
    rf"""WITH e AS (SELECT [{", ".join(f"'{x}'" for x in _ENTRIES)}] AS entries), d AS (SELECT doc_id, text, entries[doc_id % {len(_ENTRIES)} + 1] AS word, CASE WHEN doc_id % {len(_ENTRIES)} < {len(refdata.COMMON_NAMES)} THEN 'name' ELSE 'address' END AS kind FROM documents, e),
t AS (SELECT doc_id, kind, concat_ws(' ', text, substr(word, 1, length(word) - 1) || CASE WHEN doc_id % 3 = 0 THEN 'ف' ELSE substr(word, length(word), 1) END) AS text FROM d),
s AS (SELECT *, list_filter(string_split_regex(text, '{_WS}+'), lambda x: length(x) > 0) AS ws FROM t),
q AS (SELECT DISTINCT kind, w FROM (SELECT kind, unnest(ws) AS w FROM s) z WHERE length(w) >= 4 AND regexp_matches(w, '[{refdata.ARABIC_CHARS}]')),
m AS (SELECT q.kind, w, k, entry, 200.0::DOUBLE * {_LCS} / (length(w) + length(entry)) AS near FROM q JOIN {_LEXICON} ON l.kind = q.kind),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, w ORDER BY near DESC, k) AS place, lead(near) OVER (PARTITION BY kind, w ORDER BY near DESC, k) AS next FROM m),
f AS (SELECT kind, map_from_entries(list((w, entry))) AS fixes FROM r WHERE place = 1 AND near >= 85 AND near < 100 AND (next IS NULL OR near - next >= {refdata.AMBIGUITY_MARGIN}) GROUP BY kind)
SELECT doc_id, text, array_to_string(list_transform(ws, lambda x: coalesce(fixes[x], x)), ' ') AS corrected FROM s LEFT JOIN f USING (kind)"""
)
def fuzzy_correct(spark, sf_dir):
    """Every word of each document, and of a misspelt lexicon entry behind it, corrected."""
    entries = F.array(*map(F.lit, _ENTRIES))
    number = F.col("doc_id") % len(_ENTRIES)
    word = F.element_at(entries, (number + 1).cast("int"))
    hurt = F.concat(word.substr(F.lit(1), F.length(word) - 1), F.when(F.col("doc_id") % 3 == 0, "ف").otherwise(word.substr(F.length(word), F.lit(1))))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat_ws(" ", "text", hurt).alias("text"))
    kind = F.when(number < len(refdata.COMMON_NAMES), "name").otherwise("address")
    return correction.corrected(rows, "text", kind, "doc_id", 85.0)


# --------------------------------------------------------------------- whole records
_PLAIN_TEXT = rf"regexp_replace(regexp_replace(regexp_replace(said, '[{refdata.DIACRITICS}{refdata.TATWEEL}]', '', 'g'), '[|\[\]{{}}<>_=+*^~\\/©®°¦¬]', ' ', 'g'), '{_WS}+', ' ', 'g')"
#: The documents at hand have no compatibility forms, for which DuckDB has no composition; tests compare those with Python's.
_ORACLES["normalize_arabic"] = rf"""WITH {_TX}, n AS (SELECT doc_id, nfc_normalize(text) AS said FROM tx), m AS (SELECT doc_id, regexp_replace({_PLAIN_TEXT}, '(^|{_WS})ال{_WS}+([ء-ي])', '\1ال\2', 'g') AS p FROM n),
w AS (SELECT doc_id, list_filter(string_split_regex(p, '{_WS}+'), lambda x: length(x) > 0 AND NOT (doc_id % 2 = 0 AND regexp_matches(x, {_LATIN}))) AS ws FROM m)
SELECT doc_id, array_to_string(list_transform(list_transform(list_transform(ws, lambda x: coalesce({_FIXES}[x], x)), lambda x: {_fixed_word('x')}), lambda x: coalesce({_FIXES}[x], x)), ' ') AS normal FROM w"""
_REQUIRED = ", ".join(f"('{f}')" for f in refdata.REQUIRED_FIELDS)
_EXTRACT = rf"""
WITH RECURSIVE {_D}, {_ALIASED},
cards AS ({inputs.DUCK_CARD}), good AS (SELECT card FROM cards WHERE error IS NULL),
grown AS (SELECT card, ord, class_name, confidence, {_grown('x1', 'x2', '1.04', 1000, '+')} - {_grown('x1', 'x2', '1.04', 1000, '-')} AS w, {_grown('y1', 'y2', '1.04', 630, '+')} - {_grown('y1', 'y2', '1.04', 630, '-')} AS h FROM bx WHERE confidence >= 0.25),
picked AS (SELECT card, confidence, string_split(lower(class_name), '-') AS s FROM grown WHERE w >= 200 AND h >= 120 QUALIFY row_number() OVER (PARTITION BY card ORDER BY confidence DESC, ord) = 1),
place AS (SELECT card, confidence, s, len(s) = 2 AND s[1] IN ('front', 'back') AND s[2] IN ('up', 'right', 'down', 'left') AS known FROM picked),
prim AS (SELECT fb.* FROM fb JOIN good ON good.card = fb.card WHERE confidence >= 0.2),
best AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY card, field ORDER BY confidence DESC, ord) AS rn FROM prim WHERE field <> '') r WHERE rn = 1),
lack AS (SELECT DISTINCT g.card FROM good g, (VALUES {_REQUIRED}) r(field) WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.card = g.card AND best.field = r.field)),
sec AS (SELECT bx.*, m.v AS field FROM bx JOIN lack ON lack.card = bx.card JOIN {_values({str(k): v for k, v in refdata.REGION_CLASSES.items()}, "m")} ON CAST(bx.cls AS VARCHAR) = m.k WHERE bx.confidence >= 0.2),
secb AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY card, field ORDER BY confidence DESC, ord) AS rn FROM sec) r WHERE rn = 1),
fnd AS (SELECT card, field, x1, y1, x2, y2 FROM best UNION ALL SELECT card, field, x1, y1, x2, y2 FROM secb WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.card = secb.card AND best.field = secb.field)),
mar AS (SELECT fnd.*, CAST(m.w AS DOUBLE) AS sw, CAST(m.h AS DOUBLE) AS sh FROM fnd JOIN {_MARGIN} ON m.k = fnd.field),
crops AS (SELECT card, field, {_grown('x1', 'x2', 'sw', 1000, '+')} > {_grown('x1', 'x2', 'sw', 1000, '-')} AND {_grown('y1', 'y2', 'sh', 630, '+')} > {_grown('y1', 'y2', 'sh', 630, '-')} AS cropped FROM mar),
it AS (SELECT i.* FROM ({inputs.DUCK_ITEM}) i JOIN crops USING (card, field) WHERE cropped AND length(text) > 0 AND engine <> 'other'),
e AS (SELECT *, row_number() OVER (PARTITION BY card, field, engine ORDER BY cy, ord) AS r, greatest(8.0, 200 * 0.45 / count(*) OVER (PARTITION BY card, field, engine)) AS tol FROM it),
w(card, field, engine, r, line, y) AS (SELECT card, field, engine, r, 0, cy FROM e WHERE r = 1 UNION ALL SELECT e.card, e.field, e.engine, e.r, CASE WHEN abs(e.cy - w.y) > e.tol THEN w.line + 1 ELSE w.line END, CASE WHEN abs(e.cy - w.y) > e.tol THEN e.cy ELSE w.y END FROM w JOIN e ON e.card = w.card AND e.field = w.field AND e.engine = w.engine AND e.r = w.r + 1),
txt AS (SELECT card, field, engine, regexp_replace(string_agg(e.text, ' ' ORDER BY w.line, -e.cx, w.r), '^{_WS}+|{_WS}+$', '', 'g') AS said, avg(e.confidence) AS sure FROM w JOIN e USING (card, field, engine, r) GROUP BY ALL),
eng AS (SELECT * FROM txt WHERE said <> '' QUALIFY row_number() OVER (PARTITION BY card, field ORDER BY round(sure, 2) DESC, length(said) DESC, engine) = 1),
nrm AS (SELECT *, regexp_replace({_PLAIN_TEXT}, '(^|{_WS})ال{_WS}+([ء-ي])', '\1ال\2', 'g') AS p FROM eng),
wrd AS (SELECT *, list_filter(string_split_regex(p, '{_WS}+'), lambda x: length(x) > 0 AND NOT (field <> 'address' AND regexp_matches(x, {_LATIN}))) AS ws FROM nrm),
fix AS (SELECT *, array_to_string(list_transform(list_transform(list_transform(ws, lambda x: coalesce({_FIXES}[x], x)), lambda x: {_fixed_word('x')}), lambda x: coalesce({_FIXES}[x], x)), ' ') AS normal FROM wrd),
fld AS (SELECT c.card, c.field, c.cropped, said, nullif(normal, '') AS value, sure, CASE WHEN NOT c.cropped THEN 'not_found' WHEN said IS NULL OR normal = '' THEN 'unreadable' WHEN sure < 0.4 THEN 'low_confidence' ELSE 'ok' END AS status FROM crops c LEFT JOIN fix USING (card, field)),
wide AS (SELECT card, {", ".join(f"max(CASE WHEN field = '{f}' THEN value END) AS {f}, max(CASE WHEN field = '{f}' THEN status END) AS {f}_status, max(CASE WHEN field = '{f}' THEN sure END) AS {f}_sure" for f in ("first_name", "last_name", "address"))}, bool_or(CASE WHEN field = 'nid' THEN cropped END) AS nid FROM fld GROUP BY card),
flg AS (SELECT card, 'The detector flagged these regions as atypical for a genuine card: ' || string_agg(DISTINCT field, ', ' ORDER BY field) || '. They were still read.' AS warning FROM prim WHERE flagged GROUP BY card),
rec AS (SELECT c.card, error, error IS NULL AND place.card IS NOT NULL AS detected, place.confidence AS pc, turned, CASE WHEN known THEN s[1] END AS side, CASE WHEN known THEN CASE s[2] WHEN 'right' THEN 90 WHEN 'down' THEN 180 WHEN 'left' THEN 270 ELSE 0 END ELSE 0 END AS rotation,
  first_name, last_name, address, coalesce(first_name_status, 'not_found') AS fs, coalesce(last_name_status, 'not_found') AS ls, coalesce(address_status, 'not_found') AS ads, first_name_sure AS f1, last_name_sure AS f2, nid, warning,
  CASE WHEN nid THEN nullif(f.d, '') END AS number, coalesce(nid AND valid, false) AS valid, checksum_ok, bd, governorate, f.d AS d FROM cards c LEFT JOIN wide ON wide.card = c.card LEFT JOIN flg ON flg.card = c.card LEFT JOIN place ON place.card = c.card LEFT JOIN f ON f.row_id = c.card)
SELECT card, error, detected AS card_detected, CASE WHEN detected THEN pc ELSE 0.0 END AS card_confidence, CAST(CASE WHEN detected THEN rotation ELSE turned END AS INT) AS rotation_applied, CASE WHEN detected THEN side END AS side,
  first_name, last_name, address, number AS national_id, nullif(concat_ws(' ', first_name, last_name), '') AS full_name, fs AS first_name_status, ls AS last_name_status, ads AS address_status,
  CASE WHEN nid IS NULL OR NOT nid THEN 'not_found' WHEN number IS NULL THEN 'unreadable' WHEN length(number) = 14 THEN 'ok' ELSE 'low_confidence' END AS national_id_status,
  CASE WHEN first_name IS NULL AND last_name IS NULL THEN fs WHEN first_name IS NOT NULL AND last_name IS NOT NULL AND least(f1, f2) >= 0.4 THEN 'ok' ELSE 'low_confidence' END AS full_name_status,
  CASE WHEN valid THEN strftime(bd, '%Y-%m-%d') END AS birth_date, CASE WHEN valid THEN governorate END AS governorate, CASE WHEN valid THEN CASE WHEN TRY_CAST(substr(d, 13, 1) AS INT) % 2 = 1 THEN 'male' ELSE 'female' END END AS gender, valid,
  CASE WHEN error IS NOT NULL THEN '' ELSE concat_ws(' / ', CASE WHEN NOT detected THEN 'No ID card outline was detected; processing the image as if it were already cropped to the card.' END,
    CASE WHEN detected AND pc < 0.45 THEN 'Card detected with low confidence (' || printf('%.2f', pc) || '); results may be unreliable.' END, CASE WHEN detected AND side = 'back' THEN 'The back of the card was detected. Name, address and the National ID are printed on the front.' END, warning,
    CASE WHEN nid IS NULL THEN 'The National ID number region was not found on the card.' WHEN nid AND number IS NULL THEN 'No digits could be recognised in the National ID region.'
      WHEN length(number) <> 14 THEN 'Read ' || length(number) || ' of 14 National ID digits; the number is incomplete and has not been completed by inference.' END,
    CASE WHEN number IS NOT NULL AND NOT checksum_ok THEN 'The National ID check digit does not match. The official algorithm is unpublished, so this is advisory -- but it often indicates a misread digit.' END,
    CASE WHEN number IS NOT NULL AND NOT valid THEN 'Birth date, governorate and gender were not derived because the National ID did not pass validation.' END,
    CASE WHEN first_name IS NULL AND last_name IS NULL AND address IS NULL AND number IS NULL THEN 'A card was detected but no field could be read.' END) END AS warnings FROM rec
"""


@query(_EXTRACT)
def extract_records(spark, sf_dir):
    """Records of all cards from the boxes and readings that models reported, bad pictures among them."""
    found = inputs.card_numbers(spark, sf_dir).join(inputs.box_arrays(spark, sf_dir), "card", "left")
    best = boxes.card_of(F.col("boxes"), SETTINGS.card_conf, SETTINGS.min_card_width, SETTINGS.min_card_height, 1000, 630)
    cards = found.select(
        "card", "error", F.lit(None).cast("array<string>").alias("notes"), "turned", best.alias("located"), F.col("boxes").alias("fields"), F.col("boxes").alias("regions"), F.transform("boxes", lambda b: b["item"]).alias("items"), inputs.digit_boxes(F.col("card"), F.col("d")).alias("digits"),
    )
    got = extract.read_cards(cards, SETTINGS, _as_of())
    fields = ("first_name", "last_name", "address", "national_id", "full_name")
    return got.select(
        "card", "error", "card_detected", "card_confidence", "rotation_applied", "side", *(F.col(f"{f}.value").alias(f) for f in fields), *(F.col(f"{f}.status").alias(f"{f}_status") for f in fields),
        "birth_date", "governorate", "gender", "validation.valid", F.array_join("warnings", " / ").alias("warnings"),
    )


# --------------------------------------------------------------------------- pictures
_HEIGHT = "(len(pixels) // width)"


def _mirrored(k: str, n: str) -> str:
    return f"(CASE WHEN {k} < 0 THEN -({k}) WHEN {k} >= {n} THEN 2 * {n} - 2 - ({k}) ELSE {k} END)"


def _filtered(weights: tuple[int, ...]) -> str:
    """Weighted sums of each pixel's neighbours, in DuckDB."""
    near = [(dy, dx, weights[3 * (dy + 1) + dx + 1]) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    terms = (f"pixels[{_mirrored(f'i // width + {dy}', _HEIGHT)} * width + {_mirrored(f'i % width + {dx}', 'width')} + 1] * {w}" for dy, dx, w in near if w)
    return f"list_transform(range(0, len(pixels)), lambda i: {' + '.join(terms)})"


@query(
    f"""WITH g AS ({inputs.DUCK_PICTURE}), f AS (SELECT *, {_filtered(pixels.LAPLACE)} AS edges, {_filtered(pixels.NOISE)} AS rough FROM g)
SELECT vec_id, round(list_var_pop(edges), 6) AS blur, round(list_stddev_pop(pixels), 6) AS contrast, round(list_sum(list_transform(rough, lambda v: abs(v))) * sqrt(pi()) / (6 * (width - 2) * ({_HEIGHT} - 2)), 6) AS noise, round(list_avg(pixels), 6) AS brightness FROM f"""
)
def quality_kernel(spark, sf_dir):
    """Measures of every vector as a picture, without Python."""
    rows = inputs.picture_rows(spark, sf_dir)
    return rows.select("vec_id", *(F.round(c, 6).alias(name) for name, c in pixels.quality(F.col("pixels"), F.col("width")).items()))


def _looked_at(spark, sf_dir, look, kind: str) -> DataFrame:
    """What a kernel makes of every vector as a picture."""

    def run(frames):
        for f in frames:
            made = [look(np.asarray(p, np.uint8).reshape(-1, int(w))) for p, w in zip(f.pixels, f.width, strict=True)]
            yield pd.DataFrame(made, columns=[c.split()[0] for c in kind.split(", ")]).assign(vec_id=f.vec_id.to_numpy())

    return inputs.picture_rows(spark, sf_dir).mapInPandas(run, f"vec_id bigint, {kind}")


#: Places and weights of the four neighbours of a pixel of a picture twice as large.
_AT, _BASE = "((i + 0.5E0) / 2 - 0.5E0)", "CAST(floor((i + 0.5E0) / 2 - 0.5E0) AS INT)"


def _cubic(k: int) -> str:
    t = f"abs({_AT} - ({_BASE} + {k}))"
    return f"(CASE WHEN {t} <= 1 THEN 1.25E0 * {t} * {t} * {t} - 2.25E0 * {t} * {t} + 1 ELSE -0.75E0 * {t} * {t} * {t} + 3.75E0 * {t} * {t} - 6 * {t} + 3 END)"


def _doubled(values: str, at: str, n: str) -> str:
    return " + ".join(f"{values}[{at.format(k=f'greatest(0, least({n} - 1, {_BASE} + {k}))')}] * {_cubic(k)}" for k in range(-1, 3))


@query(
    f"""WITH g AS (SELECT *, {_HEIGHT} AS height FROM ({inputs.DUCK_PICTURE}) z),
r AS (SELECT *, flatten(list_transform(range(0, 2 * height), lambda i: list_transform(range(0, width), lambda x: {_doubled('pixels', '{k} * width + x + 1', 'height')}))) AS tall FROM g),
c AS (SELECT *, flatten(list_transform(range(0, 2 * height), lambda y: list_transform(range(0, 2 * width), lambda i: greatest(0, least(255, CAST(round_even({_doubled('tall', 'y * width + {k} + 1', 'width')}, 0) AS INT)))))) AS large FROM r)
SELECT vec_id, CAST(2 * height AS INT) AS height, CAST(len(large) AS INT) AS n, md5(array_to_string(large, ',')) AS pixels_md5, round(list_stddev_pop(large), 6) AS contrast FROM c"""
)
def enhance_kernel(spark, sf_dir):
    """Every vector as a picture, enlarged twice."""
    made = _looked_at(spark, sf_dir, lambda x: (x.shape[0] * 2, kernels.resize(x, 2 * x.shape[1], 2 * x.shape[0]).reshape(-1).tolist()), "height int, large array<int>")
    return made.select("vec_id", "height", F.size("large").alias("n"), F.md5(F.array_join(F.col("large").cast("array<string>"), ",").cast("binary")).alias("pixels_md5"), F.round(F.sqrt(pixels.variance(F.col("large"))), 6).alias("contrast"))


def _source(of: str, plus: str) -> str:
    """Where a pixel of a turned picture comes from, in DuckDB."""
    x, y = "(i % width - width / 2.0E0)", "(i // width - height / 2.0E0)"
    c, s = "cos(a * (pi() / 180))", "sin(a * (pi() / 180))"
    return f"CAST(floor({f'{c} * {x} - {s} * {y}' if of == 'x' else f'{s} * {x} + {c} * {y}'} + {plus} / 2.0E0 + 0.5E0) AS INT)"


@query(
    f"""WITH g AS (SELECT vec_id, pixels, width, {_HEIGHT} AS height, unnest(range(-20, 21)) AS a FROM ({inputs.DUCK_PICTURE}) z),
t AS (SELECT vec_id, a, width, height, list_transform(list_transform(range(0, len(pixels)), lambda i: {{'x': {_source('x', 'width')}, 'y': {_source('y', 'height')}}}), lambda p: CASE WHEN p.x >= 0 AND p.x < width AND p.y >= 0 AND p.y < height THEN CASE WHEN pixels[p.y * width + p.x + 1] <= 128 THEN 1 ELSE 0 END ELSE 0 END) AS ink FROM g),
s AS (SELECT vec_id, a, list_transform(range(0, height), lambda y: list_sum(ink[y * width + 1:(y + 1) * width])) AS sums FROM t),
d AS (SELECT vec_id, a, list_sum(list_transform(range(1, len(sums)), lambda y: CAST((sums[y + 1] - sums[y]) * 255 AS BIGINT) * CAST((sums[y + 1] - sums[y]) * 255 AS BIGINT))) AS score FROM s)
SELECT vec_id, CAST(a AS DOUBLE) AS angle, CAST(score AS DOUBLE) AS score FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, a) = 1"""
)
def skew_kernel(spark, sf_dir):
    """The turn under which the rows of every vector's dark pixels change most abruptly, to a degree; the first of equals."""

    def best(x: np.ndarray) -> tuple[float, float]:
        scores = [kernels.profile_score(x <= 128, float(a)) for a in range(-20, 21)]
        return float(np.argmax(scores) - 20), max(scores)

    return _looked_at(spark, sf_dir, best, "angle double, score double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
