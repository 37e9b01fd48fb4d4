import datetime

import pytest
from pyspark.sql import functions as F

from cardloom import refdata
from cardloom.functions import nid
from cardloom.streaming import numbers

GOOD = "29001010100017"
AS_OF = datetime.date(2026, 1, 1)


def model(number):
    """An independent reading of the rules: (valid, checksum_ok, date_ok, governorate_ok, errors)."""
    table = {ord(c): str(k % 10) for digits in (refdata.ARABIC_INDIC, refdata.EXTENDED_ARABIC_INDIC) for k, c in enumerate(digits)}
    d = "".join(c for c in (number or "").translate(table) if c.isdigit())
    if not d:
        return False, None, False, False, ["no_digits"]
    if len(d) != 14:
        return False, None, False, False, [f"expected 14 digits, found {len(d)}"]
    errors, date_ok = [], False
    base = {"2": 1900, "3": 2000}.get(d[0])
    if base is None:
        errors.append(f"invalid century digit '{d[0]}' (expected 2 or 3)")
    else:
        try:
            born = datetime.date(base + int(d[1:3]), int(d[3:5]), int(d[5:7]))
            date_ok = born <= AS_OF
            if not date_ok:
                errors.append("birth date is in the future")
        except ValueError:
            errors.append(f"impossible birth date {base + int(d[1:3]):04d}-{d[3:5]}-{d[5:7]}")
    known = d[7:9] in refdata.GOVERNORATES
    if not known:
        errors.append(f"unknown governorate code '{d[7:9]}'")
    rest = sum(int(a) * w for a, w in zip(d, refdata.ID_WEIGHTS, strict=False)) % 11
    right = int(d[13]) == (0 if rest < 2 else 11 - rest)
    if not right:
        errors.append("check_digit_mismatch (advisory)")
    return date_ok and known, right, date_ok, known, errors


NUMBERS = [
    GOOD, "٢٩٠٠١٠١٠١٠٠٠١٧", "۲۹۰۰۱۰۱۰۱۰۰۰۱۷", "290 0101 0100017", "2900101-0100017", None, "", "   ", "abc", "2900101010001", "290010101000177", "559554555",
    "09001010100017", "19001010100017", "49001010100017", "29013010100017", "29000010100017", "29001320100017", "29002300100017", "32701010100017", "29001010000017", "29001019900017", "29001010200017",
    "29001018800017", "29001010100018", "12345", "30501010100017", "30002290100017", "29002290100017",
]


def test_validation_equals_the_rules(spark):
    df = spark.createDataFrame([(k, n) for k, n in enumerate(NUMBERS)], "k int, number string")
    got = nid.with_decoded(df, "number", F.lit(AS_OF)).orderBy("k").collect()
    for r, number in zip(got, NUMBERS, strict=True):
        v = r.validation
        assert (v.valid, v.checksum_ok, v.date_ok, v.governorate_ok, v.errors) == model(number), number
        assert (r.decoded is not None) == v.valid


def test_decoding(spark):
    df = spark.createDataFrame([(GOOD,), ("30501010100027",), ("29001010100018",)], "number string")
    a, b, c = (r.decoded for r in nid.with_decoded(df, "number", F.lit(AS_OF)).collect())
    assert (a.birth_date, a.governorate_code, a.governorate, a.governorate_en, a.gender, a.sequence) == (datetime.date(1990, 1, 1), "01", "القاهرة", "Cairo", "male", "0001")
    assert b.birth_date.year == 2005 and b.gender == "female" and c is not None


@pytest.mark.parametrize("text, digits", [(None, ""), ("", ""), ("a1b٢c۳", "123"), (" 4-5 ", "45")])
def test_digits(spark, text, digits):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(nid.normalize_digits(F.col("t"))).first()[0] == digits


def test_stream_appends(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(GOOD,), ("12",)], "number string").write.parquet(source)
    stream = numbers.validated(spark.readStream.schema("number string").parquet(source)).select("number", "validation.valid")
    run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out)
    run.awaitTermination(60)
    assert sorted((r.number, r.valid) for r in spark.read.parquet(out).collect()) == [("12", False), (GOOD, True)]


def test_every_number_is_reported(spark):
    from cardloom.plans import catalogue

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    got = catalogue.queries()["validate_report"](spark, "/root/testdata/sf0.001")
    assert got.count() == orders.count() and got.where("valid AND (governorate IS NULL OR gender IS NULL OR birth_date IS NULL)").isEmpty()
    assert {r[0] for r in got.where("valid").selectExpr("row_id % 5").distinct().collect()} == {0, 1, 2, 3}
