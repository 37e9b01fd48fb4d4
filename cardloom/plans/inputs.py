"""Inputs of the card operators, derived from the star-schema tables.

The tables hold no cards, so numbers, boxes and texts are computed from their keys by SQL that
Spark and DuckDB both read: every row of a table gives a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import nid
from cardloom.functions.columns import bound

AS_OF = "2026-01-01"

#: Thirteen digits' parts weighed by the fixed weights; each part is named once.
_TOTAL = """c * 2 + (yy - yy % 10) * 7 / 10 + yy % 10 * 6 + (mm - mm % 10) * 5 / 10 + mm % 10 * 4 + (dd - dd % 10) * 3 / 10 + dd % 10 * 2 + (gg - gg % 10) * 7 / 10 + gg % 10 * 6
  + (s - s % 1000) * 5 / 1000 + (s % 1000 - s % 100) * 4 / 100 + (s % 100 - s % 10) * 3 / 10 + s % 10 * 2"""

#: row_id and a number in one of five shapes (as it is, in two ways apart, in Arabic digits, one digit short); some are null
#: or without digits, and every fourth has a wrong check digit.
NID = f"""
SELECT row_id, CASE WHEN row_id % 97 = 0 THEN NULL WHEN row_id % 89 = 0 THEN 'none' ELSE translate(
  CAST(c AS STRING) || lpad(CAST(yy AS STRING), 2, '0') || CASE WHEN row_id % 5 = 1 THEN ' ' ELSE '' END || lpad(CAST(mm AS STRING), 2, '0') || lpad(CAST(dd AS STRING), 2, '0')
  || CASE row_id % 5 WHEN 1 THEN ' ' WHEN 2 THEN '-' ELSE '' END || lpad(CAST(gg AS STRING), 2, '0') || lpad(CAST(s AS STRING), 4, '0')
  || CASE WHEN row_id % 5 = 4 THEN '' ELSE substr(CASE WHEN row_id % 4 = 3 THEN '11098765432' ELSE '00987654321' END, CAST(({_TOTAL}) % 11 AS INT) + 1, 1) END,
  '0123456789', CASE WHEN row_id % 5 = 3 THEN '٠١٢٣٤٥٦٧٨٩' ELSE '0123456789' END) END AS number
FROM (SELECT o_orderkey AS row_id, CASE o_orderkey % 20 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE 2 END END AS c,
  o_custkey % 100 AS yy, 1 + o_orderkey % 13 AS mm, 1 + o_custkey % 31 AS dd, (o_orderkey * 7) % 36 AS gg, o_orderkey % 10000 AS s FROM {{orders}}) a
"""

#: Field boxes of cards, in whole pixels.
BOX = """
SELECT card, ord, raw_class, class_name, cls, CAST((supp * 37 + ord * 11) % 100 AS DOUBLE) / 100 AS confidence, x1, y1, x1 + w AS x2, y1 + h AS y2, part, supp
FROM (SELECT l_orderkey AS card, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS ord,
  l_partkey AS part, l_suppkey AS supp,
  CASE l_partkey % 10 WHEN 0 THEN 'firstName' WHEN 1 THEN 'lastName' WHEN 2 THEN 'Address' WHEN 3 THEN 'nid' WHEN 4 THEN 'invalid_nid' WHEN 5 THEN ' Invalid_LastName ' WHEN 6 THEN 'serial'
    WHEN 7 THEN 'photo' WHEN 8 THEN 'SomethingNew' ELSE '' END AS raw_class,
  CASE l_partkey % 7 WHEN 0 THEN 'front-up' WHEN 1 THEN 'Back-DOWN' WHEN 2 THEN 'front-left' WHEN 3 THEN 'back-bottom' WHEN 4 THEN 'front' WHEN 5 THEN 'front-up-extra' ELSE 'front-right' END AS class_name,
  CAST(l_partkey % 12 AS INT) AS cls,
  CAST((l_partkey * 13) % 600 AS DOUBLE) AS x1, CAST((l_suppkey * 7) % 300 AS DOUBLE) AS y1, 10.0E0 + CAST(l_quantity AS INT) * 8 AS w, 8.0E0 + CAST(l_quantity AS INT) * 4 AS h
FROM {lineitem}) a
"""

#: Readings of crops by two engines.
READING = """
SELECT card AS crop, ord, CASE WHEN part % 3 = 0 THEN 'easyocr' WHEN part % 3 = 1 THEN 'paddleocr' ELSE 'other' END AS engine,
  CASE WHEN part % 11 = 0 THEN '  ' ELSE substr('abcdefghijklmnopqrstuvwxyz', 1, CAST(1 + part % 9 AS INT)) || CASE supp % 4 WHEN 0 THEN '' WHEN 1 THEN ' احمد' WHEN 2 THEN ' فاطمه|' ELSE ' ال قاهره' END END AS text, confidence, x1 AS cx, y1 AS cy, 630 AS image_height
FROM ({box}) q
"""

_ITEM = """CASE part % 3 WHEN 0 THEN 'first_name' WHEN 1 THEN 'last_name' ELSE 'address' END AS field, CASE WHEN supp % 3 = 0 THEN 'easyocr' WHEN supp % 3 = 1 THEN 'paddleocr' ELSE 'other' END AS engine, ord, x1 AS cx, y1 AS cy,
  CASE (part + supp) % 9 WHEN 0 THEN 'احمد' WHEN 1 THEN 'ABC' WHEN 2 THEN 'فاطمه' WHEN 3 THEN 'ال' WHEN 4 THEN 'قاهره' WHEN 5 THEN '١٢' WHEN 6 THEN '  ' WHEN 7 THEN 'مُحَمَّد|' ELSE '' END AS text,
  CAST(3 + 8 * ((part * 7 + ord) % 13) AS DOUBLE) / 100 AS confidence, 200 AS image_height"""

#: Pieces of text read from the fields of cards, by several engines.
ITEM = f"SELECT card, {_ITEM} FROM ({{box}}) q"

_CARD = "CASE WHEN {key} % 50 = 7 THEN 'the file could not be decoded' END AS error, CAST({key} % 4 * 90 AS INT) AS turned"
#: Cards, every fiftieth of which could not be decoded.
CARD = f"SELECT o_orderkey AS card, {_CARD.format(key='o_orderkey')} FROM {{orders}}"

#: Each whole document, and Arabic and other texts behind it.
TEXT = """
SELECT doc_id, piece, concat_ws(' ', piece, CASE doc_id % 12 WHEN 0 THEN 'مُحَمَّد علي' WHEN 1 THEN 'محمــــد' WHEN 2 THEN '[ محمد ] | حسن' WHEN 3 THEN 'ال قاهرة' WHEN 4 THEN 'مدينة ال منصورة' WHEN 5 THEN 'احمد مصطفي فاطمه'
  WHEN 6 THEN 'عبدالله الله له' WHEN 7 THEN 'محمد ABC' WHEN 8 THEN '١٢ شارع النيل' WHEN 9 THEN 'زغلولاوي منيره' WHEN 10 THEN 'café é Ünal' END) AS text
FROM (SELECT doc_id, text AS piece FROM {documents}) a
"""

#: Vectors as grey pictures of eight rows: each component a pixel.
PICTURE = "SELECT vec_id, {each}(embedding, {x} CAST(greatest(0.0E0, least(255.0E0, floor(128 + 240 * CAST(x AS DOUBLE)))) AS INT)) AS pixels, CAST({size}(embedding) / 8 AS INT) AS width FROM {embeddings}"


def nid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NID, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def box_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BOX, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def reading_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(READING.replace("({box}) q", "{box}"), box=box_rows(spark, sf_dir))


def box_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``card``, its ``boxes`` as reported, and ``items``, the pieces of text read at them."""
    rows = box_rows(spark, sf_dir).selectExpr("card", f"struct(ord, raw_class, class_name, cls, confidence, x1, y1, x2, y2, struct({_ITEM}) AS item) AS box")
    return rows.groupBy("card").agg(F.array_sort(F.collect_list("box"), lambda a, b: (a["ord"] - b["ord"]).cast("int")).alias("boxes"))


def card_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``card``, ``error``, ``turned`` and the digits ``d`` of its number."""
    cards = bound(nid_rows(spark, sf_dir), {"d": nid.normalize_digits(F.col("number"))})
    return cards.selectExpr("row_id AS card", *_CARD.format(key="row_id").split(", "), "d")


def digit_boxes(card: Column, digits: Column) -> Column:
    """Boxes of the digits of a card's number, each with a weaker one of another digit over it."""
    def box(ord_, cls, sure, left):
        return F.struct(ord_.cast("bigint").alias("ord"), cls.alias("cls"), sure.alias("confidence"), left.alias("x1"), F.lit(10.0).alias("y1"), (left + 15.0).alias("x2"), F.lit(40.0).alias("y2"))

    def both(digit, i):
        cls, x = digit.cast("int"), 20.0 * i
        return F.array(box(i, cls, ((51 + (card + i * 7) % 49) / 100).cast("double"), x), box(i + 100, (cls + 1) % 10, F.lit(0.3), x + 2.0))

    return F.flatten(F.transform(F.filter(F.split(digits, ""), lambda x: x != ""), both))


def picture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PICTURE.replace("{each}", "transform").replace("{x}", "x ->").replace("{size}", "size"), embeddings=spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TEXT, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same inputs for DuckDB.
DUCK_NID = NID.format(orders="orders")
DUCK_BOX = BOX.format(lineitem="lineitem")
DUCK_READING = READING.format(box=DUCK_BOX)
DUCK_ITEM = ITEM.format(box=DUCK_BOX)
DUCK_CARD = CARD.format(orders="orders")
DUCK_PICTURE = PICTURE.format(each="list_transform", x="lambda x:", size="len", embeddings="embeddings")
DUCK_TEXT = TEXT.format(documents="documents")
