"""Surrogates for personal data: keyed, type-consistent replacements.

E-mail addresses, bank account numbers, payment cards, social security numbers, telephone
numbers, IP addresses (of both versions) and names behind a title or a phrase of introduction are found by one
regular expression. Each distinct entity of the corpus (an address in lower case, the last ten
digits of a telephone number, the digits of a card, each word of a name) gets one surrogate,
drawn from a keyed hash, wherever and however it is written: what refers to one person goes on
doing so. A surrogate has the type of its entity, and keeps its shape: separators, country
codes, top-level domains, letter case, script (Latin, Greek, Cyrillic, Arabic; capitalised words
of other scripts get Latin ones, and words of scripts without capitals are not found), the gender
of a given name, the first digit and the validity of a card's checksum, and valid account check
digits.

A word of a name is one entity, whatever stands around it. Whether its surrogate is a given or a
family name, and of which gender, is settled once over the whole corpus: by its places in names
of several words (a draw: given), else given behind an introduction and family behind a title; by
the titles before it (Mr, Mrs), else (none, or as many of each) by its own ending. Words of the
names found in a text are also replaced where they stand alone in that text with a capital (in
Arabic: as a whole word), even where they happen to be an ordinary word there.

The key has no default: whoever knows it can find out the entities of small spaces, such as
telephone numbers, from their surrogates. An empty one is refused.

Distinctness: a surrogate that another entity of its type already has, or that is itself an
entity of the corpus, is drawn again, until none is left; the drawing is a function of the
entities alone, so that a repeated run gives the same text. A type whose shapes are used up
(after ``RESERVE`` draws) goes on with tokens of ``x`` and 24 hexadecimal digits.

Everything is DataFrame operations. The long expression looks at each text once: the texts are
written with what it found, cut at the finds. Texts without entities are not shuffled; of those
with some, the pieces are joined with the replacements, by 128 bits of hashes of id and text.
Defined results: null stays null, empty stays empty; rows that repeat are each replaced, alike;
other columns are kept as they are, whatever their names: where one is called ``n_entities`` or
``entity_kinds``, the result's own column of that name gets an underscore in front.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import quoted, written

ROUNDS, RESERVE = 60, 20

_MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "السيد", "господин", "г-н", "Κύριος", "κύριος", "Κος")
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "السيدة", "الآنسة", "госпожа", "г-жа", "Κυρία", "κυρία", "Κα")
_NEUTRAL = ("Dr", "Prof", "الدكتور", "доктор")
_CUES = ("[Mm]y name is", "[Nn]amed", "[Ii]ch heiße", "[Jj]e m'appelle", "[Mm]e llamo", "اسمي", "[Мм]еня зовут", "[Μμ]ε λένε")

_TITLE = rf"(?:(?:{'|'.join(sorted(_MALE + _FEMALE + _NEUTRAL, key=len, reverse=True))})\.?|{'|'.join(_CUES)})"
_CAPITAL, _ARABIC = r"\p{Lu}[\p{Ll}\p{Lu}'’-]+", r"[ء-ي]{2,}"
#: The first letters of titles and cues: one look at a letter, then one behind it, before any longer comparison.
_START = r"(?=[DFHIJMNPSijmnاسгдмМΚκΜμ])(?<![\p{L}\p{N}])"
_NAME = rf"{_START}{_TITLE}\ (?:{_CAPITAL}(?:\ {_CAPITAL}){{0,2}}|{_ARABIC}(?:\ {_ARABIC})?)"
#: Around a word with a capital, or an Arabic one, that may be a name mentioned without a title.
_ALONE_START, _ALONE_END = r"(?<![\p{L}\p{N}])(?=[\p{Lu}ء-ي])", r"(?![\p{L}\p{N}])"
_PATTERNS = {
    "EMAIL": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}",
    "IBAN": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "IPV6": r"(?<![\w:.])(?=[0-9A-Fa-f:]{6})(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])",
    "CARD": r"(?<![\w.-])\d{4}(?:[ -]?\d{4}){3}(?![\w-])|(?<![\w.-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\w-])",
    "SSN": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "IP": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "PHONE": r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)\ ?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?![\w-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\d)",
    "NAME": _NAME,
}
FOUND = "|".join(f"(?:{p})" for p in _PATTERNS.values())
#: What every entity has: a quick look at a text before the long expression.
_HINT = rf"@|[0-9A-Fa-f]::|(?:[0-9A-Fa-f]:[0-9A-Fa-f]{{1,4}}){{3}}|[0-9][0-9][0-9]|\+[0-9]|[0-9]\.[0-9]|{_START}{_TITLE}\ "

_LATIN = ("bcdfglmnprstv", "aeiou")
_SCRIPTS = {"greek": ("βγδκλμνπρστφ", "αειου"), "arabic": ("بتجدرسشعفقكلمنهي", "اوي"), "cyrillic": ("бвгдзклмнпрст", "аеиоу")}


def _in(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def _draw(*parts: Column | str) -> Column:
    """A keyed hash of the parts, in hexadecimal."""
    return F.sha2(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(p) for p in parts)).cast("binary"), 512)


def _number(h: Column, i: Column | int, below: int) -> Column:
    """The ``i``-th number (from 0) drawn from a hash; numbers repeat after 62."""
    place = (i if isinstance(i, Column) else F.lit(i)) % 62 * 2 + 1
    return (F.conv(h.substr(place.cast("int"), F.lit(4)), 16, 10).cast("bigint") % below).cast("int")


def _digits(h: Column, count: Column | int, first: int = 0) -> Column:
    n = count if isinstance(count, Column) else F.lit(count)
    made = F.transform(F.sequence(F.lit(1), n), lambda i: _number(h, i + first, 10).cast("string"))
    return F.when(n > 0, F.array_join(made, "")).otherwise("")


def _like(h: Column, s: Column) -> Column:
    """Letters for letters and digits for digits; the rest stays."""
    def swap(x: Column, i: Column) -> Column:
        letter = F.chr(_number(h, i, 26) + 97)
        return F.when(_in(x, "[0-9]"), _number(h, i, 10).cast("string")).when(_in(x, "[a-z]"), letter).when(_in(x, "[A-Z]"), F.upper(letter)).otherwise(x)

    return F.array_join(F.transform(F.split(s, ""), swap), "")


def _hex_like(h: Column, s: Column) -> Column:
    """Decimal digits for decimal digits and a to f for a to f; the rest stays."""
    def swap(x: Column, i: Column) -> Column:
        return F.when(_in(x, "[0-9]"), _number(h, i, 10).cast("string")).when(_in(x, "[a-f]"), F.chr(_number(h, i, 6) + 97)).otherwise(x)

    return F.array_join(F.transform(F.split(s, ""), swap), "")


def _refill(s: Column, digits: Column) -> Column:
    """``s`` with its digits replaced, in order, by those of ``digits``."""
    def swap(x: Column, i: Column) -> Column:
        n = F.length(F.regexp_replace(s.substr(F.lit(1), i + 1), "[^0-9]", ""))
        return F.when(_in(x, "[0-9]"), digits.substr(n, F.lit(1))).otherwise(x)

    return F.array_join(F.transform(F.split(s, ""), swap), "")


def _luhn(s: Column) -> Column:
    """The Luhn sum of a number without its check digit."""
    back = F.split(F.reverse(s), "")
    twice = F.transform(back, lambda x, i: F.when(i % 2 == 0, 2 * x.cast("int") - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x)


def _card(h: Column, s: Column) -> Column:
    n = F.length(s)
    body = F.concat(s.substr(1, 1), _digits(h, n - 2))
    old, new = _luhn(s.substr(F.lit(1), n - 1)), _luhn(body)
    return F.concat(body, F.pmod(s.substr(n, F.lit(1)).cast("int") + old - new, F.lit(10)).cast("string"))


def _iban(h: Column, s: Column) -> Column:
    body = _like(h, s.substr(F.lit(5), F.length(s)))
    moved = F.split(F.concat(body, s.substr(1, 2), F.lit("00")), "")
    rest = F.aggregate(moved, F.lit(0), lambda a, x: F.when(_in(x, "[0-9]"), (a * 10 + x.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97))
    return F.concat(s.substr(1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _email(h: Column, domain_hash: Column, s: Column, attempt: Column) -> Column:
    local, domain = F.split_part(s, F.lit("@"), F.lit(1)), F.split_part(s, F.lit("@"), F.lit(2))
    top = F.element_at(F.split(domain, r"\."), -1)
    inner = domain.substr(F.lit(1), F.length(domain) - F.length(top) - 1)
    longer = F.when(attempt > 5, F.lower(F.conv(attempt.cast("string"), 10, 36))).otherwise("")
    return F.concat(_like(h, local), longer, F.lit("@"), _like(domain_hash, inner), F.lit("."), top)


def _word(h: Column, kind: Column, attempt: Column) -> Column:
    """A made-up name: syllables, and an ending for its gender or for a family."""
    def made(letters: tuple[str, str], ends: dict[str, Column]) -> Column:
        def syllable(i: Column) -> Column:
            return F.concat(*(F.substring(F.lit(part), _number(h, 2 * i + k, len(part)) + 1, F.lit(1)) for k, part in enumerate(letters)))

        count = F.when(kind.startswith("SURNAME"), 3).otherwise(2) + F.floor(attempt / 4).cast("int")
        stem = F.array_join(F.transform(F.sequence(F.lit(1), count), syllable), "")
        end = reduce(lambda c, k: c.when(kind.startswith(k), ends[k]), list(ends)[1:], F.when(kind.startswith(list(ends)[0]), ends[list(ends)[0]]))
        return F.concat(stem, end.otherwise(F.lit("")))

    def one_of(*options: str) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), _number(h, 1, len(options)) + 1)

    latin = made(_LATIN, {"SURNAME": one_of("n", "r", "s", "l", "ck"), "GIVEN-f": one_of("a", "na", "ia"), "GIVEN-m": one_of("n", "k", "rd", "s"), "GIVEN": one_of("l", "x")})
    arabic = made(_SCRIPTS["arabic"], {"GIVEN-f": F.lit("ة"), "SURNAME": one_of("ي", "ن")})
    cyrillic = made(_SCRIPTS["cyrillic"], {"SURNAME-f": F.lit("ва"), "SURNAME": F.lit("в"), "GIVEN-f": F.lit("на"), "GIVEN-m": F.lit("н")})
    greek = made(_SCRIPTS["greek"], {"SURNAME-f": F.lit("λη"), "SURNAME": F.lit("δης"), "GIVEN-f": F.lit("να"), "GIVEN-m": F.lit("ς")})
    return F.when(kind.endswith("greek"), greek).when(kind.endswith("arabic"), arabic).when(kind.endswith("cyrillic"), cyrillic).otherwise(latin)


def _surrogate(h: Column, domain_hash: Column, kind: Column, s: Column, attempt: Column) -> Column:
    tens = F.concat((_number(h, 0, 8) + 2).cast("string"), _digits(h, F.length(s) - 1))
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (1 + _number(h, i, 254)).cast("string")), ".")
    social = F.concat(*(F.lpad((1 + _number(h, k, n)).cast("string"), w, "0") for k, n, w in ((1, 665, 3), (2, 99, 2), (3, 9999, 4))))
    numbers = kind.isin("IBAN", "CARD", "SSN", "IP", "IPV6", "PHONE")
    return (
        F.when(numbers & (attempt >= RESERVE), F.concat(F.lit("x"), h.substr(1, 24)))
        .when(kind == "EMAIL", _email(h, domain_hash, s, attempt)).when(kind == "IPV6", _hex_like(h, s))
        .when(kind == "IBAN", _iban(h, s)).when(kind == "CARD", _card(h, s)).when(kind == "SSN", social)
        .when(kind == "IP", octets).when(kind == "PHONE", tens).otherwise(_word(h, kind, attempt))
    )


def _kind(e: Column) -> Column:
    whole = {k: rf"^(?:{p})$" for k, p in _PATTERNS.items() if k not in ("NAME", "PHONE")}
    # the text around an entity is gone: its own shape tells its type
    shape = {"EMAIL": "@", "IPV6": "^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$", "IBAN": r"^[A-Z]{2}\d{2}", "SSN": r"^\d{3}-\d{2}-\d{4}$", "IP": whole["IP"], "CARD": r"^(?:\d{4}(?:[ -]?\d{4}){3}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})$", "PHONE": r"^[+(\d]"}
    return reduce(lambda c, k: c.when(_in(e, shape[k]), k), list(shape)[1:], F.when(_in(e, shape["EMAIL"]), "EMAIL")).otherwise("NAME")


def _parts(e: Column, kind: Column) -> Column:
    """The entities that a mention is made of: (type, canonical form)."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    canonical = F.when(kind.isin("EMAIL", "IPV6"), F.lower(e)).when(kind == "IBAN", F.replace(e, F.lit(" "))).when(kind.isin("CARD", "SSN"), digits).when(kind == "PHONE", F.substring(digits, -10, 10)).otherwise(e)
    title = F.regexp_extract(e, f"^{_TITLE}", 0)
    plain = F.regexp_replace(title, r"\.$", "")
    gender = F.when(plain.isin(*_MALE), "m").when(plain.isin(*_FEMALE), "f").otherwise("u")
    names = F.split(F.regexp_replace(e, rf"^{_TITLE}\ ", ""), " ")

    def part(x: Column, i: Column) -> Column:
        script = F.when(_in(x, r"[Ͱ-Ͽἀ-῿]"), "greek").when(_in(x, r"[؀-ۿ]"), "arabic").when(_in(x, r"[Ѐ-ӿ]"), "cyrillic").otherwise("latin")
        alone = F.when(plain.isin(*_MALE, *_FEMALE, *_NEUTRAL), "titled").otherwise("introduced")
        place = F.when(F.size(names) == 1, alone).when(i == F.size(names) - 1, "family").otherwise("given")
        return F.struct(F.concat(F.lit("NAME-"), script).alias("kind"), F.lower(x).alias("canonical"), place.alias("place"), gender.alias("gender"))

    nothing = F.lit(None).cast("string")
    return F.when(kind == "NAME", F.transform(names, part)).otherwise(F.array(F.struct(kind.alias("kind"), canonical.alias("canonical"), nothing.alias("place"), nothing.alias("gender"))))


def _forms(parts: DataFrame) -> DataFrame:
    """``kind``, ``canonical`` and ``form`` of every entity: for a word of a name, what its surrogate is to look like."""
    def times(c: Column) -> Column:
        return F.count(F.when(c, 1))

    place, gender = F.col("place"), F.col("gender")
    seen = {"given": place == "given", "family": place == "family", "introduced": place == "introduced"}
    seen |= {f"{g}{k}": (gender == g) & (place != other) for g in "mf" for k, other in (("1", "family"), ("2", "given"))}
    counts = parts.groupBy("kind", "canonical").agg(*(times(c).alias(k) for k, c in seen.items()))
    given = (F.col("given") >= F.col("family")) & (F.col("given") + F.col("introduced") > 0)
    more = F.when(given, F.col("m1") - F.col("f1")).otherwise(F.col("m2") - F.col("f2"))
    sex = F.when(more > 0, "m").when(more < 0, "f").when(_in(F.col("canonical"), "(?:a|ة|اء|а|я|α|η)$"), "f").otherwise("m")
    form = F.concat_ws("-", F.when(given, "GIVEN").otherwise("SURNAME"), sex, F.split_part("kind", F.lit("-"), F.lit(2)))
    return counts.select("kind", "canonical", F.when(F.col("kind").startswith("NAME"), form).otherwise(F.col("kind")).alias("form"))


def _cased(x: Column, v: Column) -> Column:
    """``v`` in the letter case of ``x``."""
    return F.when(x == F.lower(x), v).when((x == F.upper(x)) & (F.length(x) > 1), F.upper(v)).otherwise(F.concat(F.upper(v.substr(1, 1)), v.substr(F.lit(2), F.length(v))))


def _rewritten(e: Column, kind: Column, values: Column) -> Column:
    """A mention in its own shape, with the surrogates of its parts."""
    value = values[0]
    digits = F.regexp_replace(e, "[^0-9]", "")
    number = F.concat(digits.substr(F.lit(1), F.length(digits) - F.length(value)), value)
    upper = e == F.upper(e)
    title = F.regexp_extract(e, rf"^{_TITLE}\ ", 0)
    names = F.split(F.substring(e, F.length(title) + 1, F.length(e)), " ")
    spaced = F.regexp_replace(value, "(.{4})(?=.)", "$1 ")
    return (
        F.when(_in(value, "^x[0-9a-f]{24}$") & (kind != "NAME"), value)
        .when(kind.isin("EMAIL", "IPV6"), F.when(upper, F.upper(value)).otherwise(value))
        .when(kind == "IBAN", F.when(F.contains(e, F.lit(" ")), spaced).otherwise(value))
        .when(kind == "IP", value).when(kind == "NAME", F.concat(title, F.array_join(F.transform(values, lambda v, i: _cased(names[i], v)), " ")))
        .when(kind == "PHONE", _refill(e, number)).otherwise(_refill(e, value))
    )


def _table(parts: DataFrame, key: str) -> DataFrame:
    """``kind``, ``canonical`` and ``value`` of every entity; no value is shared or is an entity itself."""
    entities = written(_forms(parts), "entities")
    sort = F.regexp_extract("kind", "^[A-Z]+", 0)
    taken = entities.select(sort.alias("sort"), F.col("canonical").alias("value")).distinct()
    table = entities.withColumn("attempt", F.lit(0))
    for _ in range(ROUNDS):
        drawn = table.select("kind", "canonical", "form", "attempt", _draw(key, F.col("kind"), F.col("canonical"), F.col("attempt").cast("string")).alias("h"), _draw(key, "DOMAIN", F.split_part("canonical", F.lit("@"), F.lit(2))).alias("d"))
        value = _surrogate(F.col("h"), F.col("d"), F.col("form"), F.col("canonical"), F.col("attempt"))
        table = written(drawn.select("kind", "canonical", "form", "attempt", value.alias("value"), sort.alias("sort")), "surrogates")
        # one holder keeps a value: the one that drew it first, then the first by name
        keeper = table.groupBy("sort", "value").agg(F.min(F.struct("attempt", "canonical", "kind")).alias("keeper"), F.count("*").alias("holders"))
        again = keeper.join(taken.withColumn("real", F.lit(True)), ["sort", "value"], "left").where("holders > 1 OR real")
        if again.isEmpty():
            return table
        marked = table.join(again, ["sort", "value"], "left")
        lost = F.coalesce(F.col("real"), F.lit(False)) | (F.col("keeper").isNotNull() & ~((F.col("keeper.canonical") == F.col("canonical")) & (F.col("keeper.kind") == F.col("kind"))))
        table = marked.select("kind", "canonical", "form", (F.col("attempt") + F.when(lost, 1).otherwise(0)).alias("attempt"))
    raise RuntimeError("no distinct surrogates were found: the key space of a type is exhausted")


def replace_entities(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, and ``n_entities`` and ``entity_kinds`` of each row."""
    if not key:
        raise ValueError("surrogates need a key")
    others = [c for c in docs.columns if c != text_col]
    text = F.col("text")
    looked = docs.select(F.struct(*(F.col(quoted(c)) for c in others)).alias("row"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    nothing = F.array().cast("array<string>")
    looked = looked.withColumn("found", F.coalesce(F.when(_in(text, _HINT), F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))), nothing))
    some = F.size("found") > 0
    mark = F.struct(F.xxhash64("id", "text").alias("a"), F.xxhash64(F.lit(7), "text", "id").alias("b"))
    looked = looked.select("row", "found", F.when(some, F.split(text, FOUND, -1)).alias("rest"), F.when(some, mark).alias("mark"), F.when(~some, text).alias("text"))
    # written: the long expression runs once for each text
    looked = written(looked, "found")
    lists = looked.where("mark IS NOT NULL")
    with_kind = F.transform("found", lambda e: F.struct(e.alias("entity"), _kind(e).alias("kind")))
    hits = lists.select("mark", with_kind.alias("mentions")).select("mark", F.posexplode("mentions").alias("at", "m")).select("mark", "at", "m.entity", "m.kind")
    hits = written(hits, "mentions")
    parts = hits.select("mark", "at", F.posexplode(_parts(F.col("entity"), F.col("kind"))).alias("part", "p")).select("mark", "at", "part", "p.*")
    parts = written(parts, "parts")
    values = parts.join(_table(parts, key).select("kind", "canonical", "value"), ["kind", "canonical"])
    word = F.when(F.col("kind").startswith("NAME"), F.col("canonical"))
    # at most three parts to a mention; rows that repeat give equal structs, which collect_set joins
    values = values.groupBy("mark", "at").agg(F.collect_set(F.struct("part", word.alias("word"), "value")).alias("values"))
    mentions = hits.distinct().join(values, ["mark", "at"]).select("mark", "at", "kind", _rewritten(F.col("entity"), F.col("kind"), F.transform(F.array_sort("values"), lambda v: v["value"])).alias("made"), F.filter("values", lambda v: v["word"].isNotNull()).alias("names"))
    # the mentions of one text go back into that text
    made = mentions.groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "made", "names"))).alias("made"))
    changed = lists.select("row", "rest", "mark").join(made, "mark")
    # beside the mentions, words of the text's names that stand alone
    words = F.array_distinct(F.flatten(F.transform("made", lambda x: F.transform(x["names"], lambda v: F.struct(v["word"].alias("word"), v["value"].alias("value"))))))
    changed = changed.withColumn("words", words)
    standing = F.transform(F.flatten(F.transform("rest", lambda x: F.regexp_extract_all(x, F.lit(rf"{_ALONE_START}\p{{L}}+{_ALONE_END}"), F.lit(0)))), lambda x: F.lower(x))
    # names of several parts are always looked for, others where their letters occur: each text is compared with few
    own = F.transform("words", lambda v: v["word"])
    standing = F.array_union(F.array_intersect(own, standing), F.filter(own, lambda w: _in(w, "['’-]")))
    changed = changed.withColumn("names", F.when(F.size("words") > 0, standing).otherwise(nothing))
    alone = F.concat(F.lit(_ALONE_START + "(?iu:"), F.array_join(F.reverse(F.array_sort("names")), "|"), F.lit(")" + _ALONE_END))
    changed = changed.withColumns({"alone": alone, "values": F.map_from_entries(F.filter("words", lambda v: F.array_contains("names", v["word"])))})

    def without(x: Column) -> Column:
        standing = F.transform(F.regexp_extract_all(x, F.col("alone"), F.lit(0)), lambda w: F.coalesce(_cased(w, F.element_at("values", F.lower(w))), w))
        return F.array_join(F.zip_with(F.split(x, F.col("alone"), -1), F.array_append(standing, F.lit("")), lambda a, b: F.concat(a, b)), "")

    named = F.size("names") > 0
    n_alone = F.when(named, F.aggregate("rest", F.lit(0), lambda n, x: n + F.regexp_count(x, F.col("alone")))).otherwise(0)
    rest = F.when(named, F.transform("rest", without)).otherwise(F.col("rest"))
    joined = F.array_join(F.zip_with(rest, F.array_append(F.transform("made", lambda x: x["made"]), F.lit("")), lambda a, b: F.concat(a, b)), "")
    kinds = F.array_sort(F.array_distinct(F.transform("made", lambda x: x["kind"])))
    changed = changed.select("row", joined.alias("text"), (F.size("made") + n_alone).alias("n"), kinds.alias("kinds"))
    same = looked.where("mark IS NULL").select("row", "text", F.lit(0).alias("n"), nothing.alias("kinds"))
    n, kinds = ("_" * sum(c.lower().lstrip("_") == name for c in docs.columns) + name for name in ("n_entities", "entity_kinds"))
    columns = [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return changed.unionAll(same).select(*columns, F.col("n").alias(n), F.col("kinds").alias(kinds))
