"""National identity numbers: digits, validation and decoding, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom import refdata
from cardloom.functions.columns import bound, unused
from cardloom.functions.text import _map, western_digits

#: The digit that each rest of the weighed sum asks for.
_BY_REST = "00987654321"


def normalize_digits(c: Column) -> Column:
    """ASCII digits of a number in any of the supported ranges; null: empty."""
    return F.regexp_replace(western_digits(F.coalesce(c, F.lit(""))), r"(?U)\D", "")


def governorate(code: Column, english: bool = False) -> Column:
    return F.try_element_at(_map(refdata.GOVERNORATES_EN if english else refdata.GOVERNORATES), code)


def _century(d: Column) -> Column:
    out = F.lit(None).cast("int")
    for digit, year in refdata.CENTURIES.items():
        out = F.when(d.substr(1, 1) == digit, year).otherwise(out)
    return out


def _date_text(d: Column) -> Column:
    year = _century(d) + d.substr(2, 2).try_cast("int")
    return F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), d.substr(4, 2), d.substr(6, 2))


def birth_date(d: Column) -> Column:
    """The date in the number, null if there is none such."""
    return F.when(_century(d).isNotNull(), _date_text(d).try_cast("date"))


def check_digit(d: Column) -> Column:
    """The digit that the first thirteen ask for."""
    total = sum((d.substr(k + 1, 1).try_cast("int") * w for k, w in enumerate(refdata.ID_WEIGHTS)), F.lit(0))
    return F.lit(_BY_REST).substr(total % 11 + 1, F.lit(1)).cast("int")


def checksum_ok(d: Column) -> Column:
    """Null unless the number has its full length."""
    return F.when(F.length(d) == refdata.ID_LENGTH, d.substr(14, 1).try_cast("int") == check_digit(d))


def gender(d: Column) -> Column:
    return F.when(d.substr(13, 1).try_cast("int") % 2 == 1, "male").otherwise("female")


def validation(d: Column, as_of: Column) -> Column:
    """Struct of the checks of a number's digits and, in order, what they found; the check digit is advice only."""
    size = F.length(d)
    length_ok = size == refdata.ID_LENGTH
    date, century = birth_date(d), _century(d)
    date_ok = length_ok & F.coalesce(date <= as_of, F.lit(False))
    known = length_ok & governorate(d.substr(8, 2)).isNotNull()
    none = F.array().cast("array<string>")  # arrays put together, as a filter over one would leave generated code
    errors = F.concat(
        F.when(century.isNull(), F.array(F.concat(F.lit("invalid century digit '"), d.substr(1, 1), F.lit("' (expected 2 or 3)")))).when(
            date.isNull(), F.array(F.concat(F.lit("impossible birth date "), _date_text(d)))
        ).when(date > as_of, F.array(F.lit("birth date is in the future"))).otherwise(none),
        F.when(~known, F.array(F.concat(F.lit("unknown governorate code '"), d.substr(8, 2), F.lit("'")))).otherwise(none),
        F.when(~checksum_ok(d), F.array(F.lit("check_digit_mismatch (advisory)"))).otherwise(none),
    )
    errors = F.when(size == 0, F.array(F.lit("no_digits"))).when(~length_ok, F.array(F.concat(F.lit("expected 14 digits, found "), size.cast("string")))).otherwise(errors)
    return F.struct(
        (date_ok & known).alias("valid"), length_ok.alias("length_ok"), checksum_ok(d).alias("checksum_ok"), date_ok.alias("date_ok"), known.alias("governorate_ok"), errors.alias("errors")
    )


def decoded(d: Column, valid: Column) -> Column:
    """What the digits of a valid number say; null for any other."""
    code = d.substr(8, 2)
    return F.when(
        valid,
        F.struct(
            d.alias("national_id"), birth_date(d).alias("birth_date"), code.alias("governorate_code"), governorate(code).alias("governorate"),
            governorate(code, english=True).alias("governorate_en"), gender(d).alias("gender"), d.substr(10, 4).alias("sequence"),
        ),
    )


def decoded_columns(df: DataFrame, number: Column, as_of: Column, names: tuple[str, str, str]) -> DataFrame:
    """``df`` with digits, validation and decoded of a number, under names that it does not have."""
    digits, checks, said = names
    df = bound(df, {digits: normalize_digits(number)}).withColumn(checks, validation(F.col(digits), as_of))
    return df.withColumn(said, decoded(F.col(digits), F.col(checks)["valid"]))


def with_decoded(df: DataFrame, number: str, as_of: Column) -> DataFrame:
    """``df`` with ``digits``, ``validation`` and ``decoded`` of a column.

    Columns of ``df`` that have such a name stay; the new one then gets underscores before its own.
    """
    names = []
    for name in ("digits", "validation", "decoded"):
        names.append(unused(df, name))
    return decoded_columns(df, F.col(number), as_of, tuple(names))
