"""Arabic text, as Column expressions."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cardloom import refdata

#: White space as the results need it: the Unicode spaces and the four ASCII separators.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def _map(pairs: dict[str | int, str]) -> Column:
    """A map of fixed values, in one expression: literals made one by one cost a call to the JVM each."""
    return F.expr("map(" + ", ".join(f"{x}" if isinstance(x, int) else f"'{x}'" for pair in pairs.items() for x in pair) + ")")


def contains_arabic(c: Column) -> Column:
    return c.rlike(f"[{refdata.ARABIC_CHARS}]")


def western_digits(c: Column) -> Column:
    return F.translate(c, refdata.ARABIC_INDIC + refdata.EXTENDED_ARABIC_INDIC, "0123456789" * 2)


def strip_diacritics(c: Column) -> Column:
    return F.regexp_replace(c, f"[{refdata.DIACRITICS}{refdata.TATWEEL}]", "")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def clean_noise(c: Column) -> Column:
    """Characters that recognisers invent become spaces; runs of spaces become one."""
    return trimmed(F.regexp_replace(F.regexp_replace(c, f"[{refdata.OCR_NOISE}]", " "), f"{SPACE}+", " "))


def merge_article(c: Column) -> Column:
    """A detached article is joined to its noun."""
    return F.regexp_replace(c, rf"(^|{SPACE})ال{SPACE}+(?=[ء-ي])", "$1ال")


def fix_ta_marbuta(w: Column) -> Column:
    """A final heh of a word of four letters or more becomes a ta marbuta, with exceptions."""
    kept = w.isin(*refdata.TA_MARBUTA_EXCEPTIONS) | w.rlike(r"[\p{Nd}]") | w.rlike("(الله|لله)$")
    return F.when(w.endswith("ه") & (F.length(w) >= 4) & ~kept, F.concat(w.substr(F.lit(1), F.length(w) - 1), F.lit("ة"))).otherwise(w)


def orthographic(w: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(refdata.ORTHOGRAPHIC_FIXES), w), w)


def is_latin_only(w: Column) -> Column:
    return w.rlike(r"(?U)^[A-Za-z\W\d]+$")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: F.length(w) > 0)


def normalize_composed(c: Column, drop_latin: Column | bool = False, fix: bool = True) -> Column:
    """Normalised text of a string whose compatibility forms are already composed; null and blank: empty."""
    words = tokens(merge_article(clean_noise(strip_diacritics(F.coalesce(c, F.lit(""))))))
    drop = drop_latin if isinstance(drop_latin, Column) else F.lit(drop_latin)
    words = F.filter(words, lambda w: ~(drop & is_latin_only(w)))
    if fix:
        words = F.transform(words, lambda w: orthographic(fix_ta_marbuta(orthographic(w))))
    return F.array_join(words, " ")


@F.pandas_udf(StringType())
def nfkc(s):
    """Compatibility composition, which Spark has no function for."""
    return s.str.normalize("NFKC")


def normalize_arabic(c: Column, drop_latin: Column | bool = False, fix: bool = True) -> Column:
    return normalize_composed(nfkc(c), drop_latin, fix)


def _common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: a column of the table is one number, whose zero bits are its steps."""
    full = (1 << len(b)) - 1
    at: dict[str, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    steps = full
    for x in a:
        hit = steps & at.get(x, 0)
        steps = ((steps + hit) | (steps - hit)) & full
    return len(b) - steps.bit_count()


def similarity(a: str, b: str) -> float:
    """200 * common / (len a + len b): insertions and deletions only."""
    return 200.0 * _common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def _bound(a: str, b: str) -> float:
    """No similarity is above that of the letters in any order."""
    return 200.0 * (Counter(a) & Counter(b)).total() / (len(a) + len(b))


@lru_cache(1 << 16)
def suggest(token: str, kind: str, threshold: float) -> str:
    """The only entry of a lexicon that is close enough, and clearly closer than the next."""
    entries = refdata.LEXICONS.get(kind, ())
    if len(token) < refdata.MIN_CORRECTED or not entries or token in entries:
        return token
    # others are neither close enough nor in the way of the closest
    least = threshold - refdata.AMBIGUITY_MARGIN
    near = ((e, -k) for k, e in enumerate(entries) if 200.0 * min(len(e), len(token)) >= least * (len(e) + len(token)))
    best = sorted(((similarity(token, e), k) for e, k in near if _bound(token, e) >= least), reverse=True)[:2]
    if not best or best[0][0] < threshold or (len(best) > 1 and best[0][0] - best[1][0] < refdata.AMBIGUITY_MARGIN):
        return token
    return entries[-best[0][1]]


#: A word with a letter of the lexicons' script; no other word is near an entry.
_ARABIC_WORD = re.compile(rf"\S*[{refdata.ARABIC_CHARS}]\S*")


def correct_text(c: Column, kind: Column, threshold: float = 92.0) -> Column:
    """Every word replaced by its suggestion, with one space between words.

    Words without Arabic letters stay in the JVM's hands but for being passed over; texts without any
    such word don't go to Python.
    """

    @F.pandas_udf("string")
    def run(text, kinds):
        return text.combine(kinds, lambda t, k: None if t is None else _ARABIC_WORD.sub(lambda m: suggest(m[0], k, threshold), t))

    spaced = F.array_join(tokens(c), " ")
    return F.coalesce(run(F.when(contains_arabic(c), spaced), kind), spaced)
