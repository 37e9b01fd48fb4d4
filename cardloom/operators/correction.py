"""Spelling correction of long texts: every different word once, joined back by its place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom import refdata
from cardloom.functions import text
from cardloom.functions.columns import unused


#: A word with a letter of the lexicons' script: looked for at the beginnings of words only, without steps back.
_SPACES = text.SPACE[1:-1]
_WORD = rf"(?<![^{_SPACES}])[^{_SPACES}{refdata.ARABIC_CHARS}]*+[{refdata.ARABIC_CHARS}][^{_SPACES}]*+"


def suggestions(words: DataFrame, threshold: float = 92.0) -> DataFrame:
    """``kind``, ``word`` and ``right`` of the words of (kind, word) rows that a lexicon has something better for; each is looked up once."""
    # no other word can be near an entry
    longest = max(len(e) for entries in refdata.LEXICONS.values() for e in entries)
    least = threshold - refdata.AMBIGUITY_MARGIN
    most = longest * (200.0 - least) / least
    w = F.col("word")
    asked = words.where(text.contains_arabic(w) & F.length(w).between(refdata.MIN_CORRECTED, F.lit(most)) & F.col("kind").isin(*refdata.LEXICONS)).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f.assign(right=[text.suggest(word, kind, threshold) for kind, word in zip(f["kind"], f["word"], strict=True)])
            yield f[f["right"] != f["word"]]

    return asked.select("kind", "word").mapInPandas(run, "kind string, word string, right string")


def corrected(df: DataFrame, column: str, kind: Column, key: str, threshold: float = 92.0, into: str = "corrected") -> DataFrame:
    """``df`` with ``into``: the text of a column with one space between words, each replaced by its suggestion.

    ``key`` names rows: rows of equal keys must have equal texts and kinds. Only different words with
    letters of the lexicons' script leave their texts, and only those with a suggestion are gathered
    by key. Null texts stay null.
    """
    of = unused(df, "kind")
    df = df.withColumn(of, kind)
    asked = F.array_distinct(F.regexp_extract_all(column, F.lit(_WORD), F.lit(0)))
    words = df.where(text.contains_arabic(F.col(column))).select(F.col(key).alias("key"), F.col(of).alias("kind"), F.explode(asked).alias("word")).where(F.length("word") >= refdata.MIN_CORRECTED)
    found = suggestions(words.select("kind", "word"), threshold)
    fixes = words.join(found, ["kind", "word"]).groupBy("key").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "right")))).alias("fixes"))
    fixed, mend = unused(df, "fixed_key"), unused(df, "fixes")
    df = df.join(fixes.select(F.col("key").alias(fixed), F.col("fixes").alias(mend)), F.col(key).eqNullSafe(F.col(fixed)), "left")
    mended = F.array_join(F.transform(text.tokens(F.col(column)), lambda w: F.coalesce(F.try_element_at(mend, w), w)), " ")
    plain = text.trimmed(F.regexp_replace(column, f"{text.SPACE}+", " "))
    return df.withColumn(into, F.when(F.col(mend).isNull(), plain).otherwise(mended)).drop(of, fixed, mend)
