import random
import re

import pytest

from cardloom.llm import pii, queries

SF = "/root/testdata/sf0.01"
DATA = {
    "EMAIL": re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "CARD": re.compile(r"(?<![\w-])\d{16}\b"), "PHONE": re.compile(r"\+1 \(\d{3}\) \d{3}-\d{4}"), "IP": re.compile(r"\b\d+\.\d+\.\d+\.\d+\b"),
}


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d[0::2] + [2 * x - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


KEY = "change this key for every corpus"


def run(spark, rows, key=KEY):
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int").select("doc_id", "text")
    return [tuple(r) for r in pii.replace_entities(df, key=key).select("doc_id", "text", "n_entities", "entity_kinds").collect()]


def test_columns_of_any_names(spark):
    rows = [(1, "m", 7, "f", "k", "r", "Mr John Smith, a@b.org", 2.5), (2, "m", 8, "g", "k", "r", "clean", 3.5)]
    names = ["doc_id", "mark", "n_entities", "found", "entity_kinds", "row", "text", "a.b"]
    got = pii.replace_entities(spark.createDataFrame(rows, names), key=KEY)
    assert got.columns == [*names, "_n_entities", "_entity_kinds"]
    for old, new in zip(rows, sorted(map(tuple, got.collect())), strict=True):
        assert new[:6] + new[7:8] == old[:6] + old[7:8] and new[8] == (2 if old[0] == 1 else 0)
    got = pii.replace_entities(spark.createDataFrame([(r[6], r[0]) for r in rows], ["body", "key"]), key=KEY, id_col="key", text_col="body")
    assert got.columns == ["body", "key", "n_entities", "entity_kinds"] and got.where("n_entities = 0").first().body == "clean"


def made_up(r):
    """Random mentions of a few entities, each written in one of its ways, and (type, entity, way) of each."""
    people = [("Mr", "Paul", "Weller"), ("Frau", "Erika", "Weller"), ("Κύριος", "Γιώργος", "Ανδρέου"), ("госпожа", "Анна", "Белова"), ("Dr", "Paul", "Kern")]
    k = r.randrange(30)
    v6 = f"2001:db8:{k:x}0a:1:2:3:4:{k + 16:x}"
    ways = {
        "EMAIL": (f"u{k}@mail.org", [f"u{k}@mail.org", f"U{k}@MAIL.ORG"]), "CARD": (f"4000 1234 5678 {1000 + k}", [f"4000 1234 5678 {1000 + k}", f"400012345678{1000 + k}", f"4000-1234-5678-{1000 + k}"]),
        "PHONE": (f"(212) 555-{1000 + k}", [f"(212) 555-{1000 + k}", f"+1 212 555 {1000 + k}"]), "IP": (f"10.1.2.{k}", [f"10.1.2.{k}"]), "SSN": (f"123-45-{6000 + k}", [f"123-45-{6000 + k}"]),
        "IPV6": (v6, [v6, v6.upper(), ]), "NAME": (people[k % 5], None),
    }
    kind = r.choice(list(ways))
    entity, forms = ways[kind]
    return kind, entity, (" ".join(entity) if forms is None else r.choice(forms))


@pytest.mark.parametrize("seed", range(2))
def test_random_texts_against_their_plan(spark, seed):
    """Texts are planned mention by mention; each mention's surrogate is read off between known words."""
    r = random.Random(seed)
    plans = {i: [made_up(r) for _ in range(r.randrange(1, 9))] for i in range(150)}
    rows = [(i, " §; ".join(["start", *(m[2] for m in plan), "end"]), 0) for i, plan in plans.items()]
    words, values = {}, {}
    for i, new, n, kinds in run(spark, rows):
        pieces = new.split(" §; ")
        assert pieces[0] == "start" and pieces[-1] == "end" and len(pieces) == len(plans[i]) + 2
        assert n == len(plans[i]) and kinds == sorted({m[0] for m in plans[i]})
        for (kind, entity, way), piece in zip(plans[i], pieces[1:-1], strict=True):
            if kind == "NAME":
                title, *own = piece.split(" ")
                assert title == entity[0] and len(own) == 2
                for old, one in zip(entity[1:], own, strict=True):
                    assert words.setdefault(old, one) == one != old
            else:
                plain = re.sub(r"[ ()+-]", "", piece.lower())[-10 if kind == "PHONE" else 0 :]
                assert values.setdefault((kind, entity), plain) == plain and (kind == "IP" or re.sub(r"\w", "w", piece) == re.sub(r"\w", "w", way))
                assert piece.isupper() == way.isupper()
    assert len(set(words.values())) == len(words) and len(set(values.values())) == len(values)
    assert not set(words) & set(words.values())
    assert all(re.fullmatch("[Ͱ-Ͽ]+", words[w]) for w in ("Γιώργος", "Ανδρέου") if w in words) and all(re.fullmatch("[А-я]+", words[w]) for w in ("Анна", "Белова") if w in words)


def test_used_up_shapes_go_on(spark, monkeypatch):
    """Far more entities than their shape has values: the rest gets tokens, all distinct."""
    monkeypatch.setattr(pii, "RESERVE", 2)
    rows = [(i, f"fe80::{i % 10}{'abcdef'[i // 10]}", 0) for i in range(60)]
    got = [x[1] for x in run(spark, rows)]
    assert len(set(got)) == 60 and not set(got) & {x[1] for x in rows} and all(re.fullmatch(r"[a-f0-9:]+|x[0-9a-f]{24}", g) for g in got)


def test_documents(spark):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    after = {r.doc_id: r.text for r in queries.op1_surrogates(spark, SF).collect()}
    assert before.keys() == after.keys()
    pairs = {k: {} for k in DATA}
    for i, old in before.items():
        new = after[i]
        if not any(p.search(old) for p in DATA.values()):
            assert new == old
        for kind, p in DATA.items():
            a, b = p.findall(old), p.findall(new)
            assert len(a) == len(b)
            for x, y in zip(a, b, strict=True):
                assert x != y and pairs[kind].setdefault(x, y) == y
                assert x not in new
                if kind == "CARD":
                    assert luhn(x) == luhn(y) and x[0] == y[0]
    for p in pairs.values():
        assert len(p) > 5 and len(set(p.values())) == len(p) and not set(p) & set(p.values())


CASES = [
    (1, "Write to Ann.Lee+x@Mail.example.org, or ann.lee+x@mail.example.org.", 9),
    (2, "Call +1 (227) 555-6828 or 227-555-6828; not 2026-11-28, 3.14.15 or v1.2.3.4.5", 9),
    (3, "Card 4111 1111 1111 1111 = 4111111111111111, SSN 219-09-9999, host 192.168.10.250.", 9),
    (4, "IBAN GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765432", 9),
    (5, "Mr. John Smith met Mrs. Mary Smith. My name is John Smith. Dr SMITH left.", 9),
    (6, "السيد محمد حسن. السيدة فاطمة حسن", 9), (7, "господин Иван Петров и госпожа Анна Петрова", 9),
    (8, None, 9), (9, "", 9), (10, "nothing here, not even @ or 12.", 9), (None, "a@b.co", 9), (None, "a@b.co", 9), (11, "a@b.co" * 1 + " word" * 50_000 + " b@b.co", 9),
]


def test_shapes_and_coreference(spark):
    got = {r[0]: r[1] for r in run(spark, CASES)}
    a, b = DATA["EMAIL"].findall(got[1])
    assert a.lower() == b.lower() and b.endswith(".org") and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\+[a-z]@[a-z]{4}\.[a-z]{7}\.org", b)
    m = re.search(r"Call \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4}); not 2026-11-28, 3.14.15 or v1.2.3.4.5$", got[2])
    assert m and m.groups()[:3] == m.groups()[3:] != ("227", "555", "6828")
    m = re.fullmatch(r"Card (\d{4} \d{4} \d{4} \d{4}) = (\d{16}), SSN (\d{3}-\d{2}-\d{4}), host ([\d.]+)\.", got[3])
    assert m[1].replace(" ", "") == m[2] != "4111111111111111" and luhn(m[2]) and m[3] != "219-09-9999" and m[4] != "192.168.10.250"
    m = re.fullmatch(r"IBAN (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) and (GB\d\d[A-Z]{4}\d{14})", got[4])
    assert m[1].replace(" ", "") == m[2]
    assert int("".join(str(int(c, 36)) for c in m[2][4:] + m[2][:4])) % 97 == 1
    m = re.fullmatch(r"Mr. (\w+) (\w+) met Mrs. (\w+) (\w+). My name is (\w+) (\w+). Dr ([A-Z]+) left.", got[5])
    assert m[2] == m[4] == m[6] and m[7] == m[2].upper() and m[3][-1] == "a" and m[1][-1] != "a"
    assert "محمد" not in got[6] and "حسن" not in got[6] and got[6].startswith("السيد ") and re.fullmatch(r"[؀-ۿ. ]+", got[6])
    assert "Петров" not in got[7] and re.fullmatch(r"господин [А-Я][а-я]+н [А-Я][а-я]+в и госпожа [А-Я][а-я]+на [А-Я][а-я]+ва", got[7])
    assert got[8] is None and got[9] == "" and got[10] == CASES[9][1]
    assert len(got[11]) == len(CASES[12][1]) and got[11].startswith(got[None]) and not got[11].startswith("a@b")


def test_crowded_types_stay_distinct(spark):
    names = [chr(97 + k) for k in range(26)]
    rows = [(k, f"{n}@x.io", 0) for k, n in enumerate(names)]
    got = [r[1] for r in run(spark, rows)]
    assert len(set(got)) == 26 and not set(got) & {r[1] for r in rows}


def test_keys_and_repeats(spark):
    rows = [(k, f"x{k}@mail.org 10.0.0.{k}", 0) for k in range(20)]
    assert run(spark, rows) == run(spark, rows)
    assert {r[1] for r in run(spark, rows)}.isdisjoint({r[1] for r in run(spark, rows, key="another")})
    assert run(spark, []) == []
    with pytest.raises(ValueError, match="key"):
        run(spark, rows, key="")


def test_the_query_takes_the_key_of_the_session(spark):
    spark.conf.set(queries.KEY_SETTING, "of the session")
    try:
        assert queries.surrogate_key(spark) == "of the session"
    finally:
        spark.conf.unset(queries.KEY_SETTING)
    assert queries.surrogate_key(spark)


@pytest.mark.parametrize("kind", ["ab1c@d-e.fr", "+44 20 7946 0958", "Frau Erika Mustermann"])
def test_clean_words_around_stay(spark, kind):
    r = random.Random(1)
    words = [f"w{r.randrange(9)}" for _ in range(30)]
    words.insert(7, kind)
    (_, new, n, _), *_ = run(spark, [(1, " ".join(words), 0)])
    assert n == 1 and new.split(" ")[:7] == words[:7] and new.split(" ")[-22:] == words[-22:] and kind not in new


NAMES = [
    (1, "Mr John Smith came. My name is John Smith. Dr John Smith left. Mr John slept. JOHN and Smith's dog, Smithson; a john.", 0),
    (2, "Dr Mary Jones and Mme Mary Jones", 0), (3, "Prof Lena Brown", 0), (4, "John and Mary stay: no name was found here", 0),
    (5, "Dr Иван Петров, господин Иван Петров. Петров", 0), (6, "الدكتور محمد حسن ثم حسن", 0), (7, "Dr Smith-Lee and Smith-Lee's Lee", 0),
]


def test_a_word_of_a_name_has_one_surrogate(spark):
    got = {r[0]: r for r in run(spark, NAMES)}
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. My name is (\w+) (\w+)\. Dr (\w+) (\w+) left\. Mr (\w+) slept\. (\w+) and (\w+)'s dog, Smithson; a john\.", got[1][1])
    john, smith = m[1], m[2]
    assert {m[3], m[5], m[7]} == {john} and m[8] == john.upper() and {m[4], m[6], m[9]} == {smith} and "John" != john != smith != "Smith" and got[1][2] == 6
    m = re.fullmatch(r"Dr (\w+) (\w+) and Mme (\w+) (\w+)", got[2][1])
    assert m[1] == m[3] and m[2] == m[4] and m[1][-1] == "a"  # the gendered title decides
    assert re.fullmatch(r"Prof \w+a \w+", got[3][1]) and got[4][1:3] == (NAMES[3][1], 0)
    m = re.fullmatch(r"Dr (\w+н) (\w+в), господин (\w+) (\w+)\. (\w+)", got[5][1])
    assert m[1] == m[3] != "Иван" and m[2] == m[4] == m[5] != "Петров"
    m = re.fullmatch(r"الدكتور (\w+) (\w+) ثم (\w+)", got[6][1])
    assert m[2] == m[3] != "حسن"
    m = re.fullmatch(r"Dr (\w+) and (\w+)'s Lee", got[7][1])
    assert m[1] == m[2] and "Smith" not in got[7][1]
