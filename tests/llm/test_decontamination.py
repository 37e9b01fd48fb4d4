import hashlib
import re

import pytest

from cardloom.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    pats = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            pats.setdefault(tuple(w[i : i + n]), set()).update([] if item is None else [item])
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in pats}:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in pats:
                    hit.update(range(i, i + n))
                    found |= pats[p]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


PASSAGE = "One two THREE four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, "before " + PASSAGE.lower().replace(" ", ", ") + " after"), (2, None), (3, ""), (4, "one two three four five six seven eight nine zehn"),
    (5, "a ÉTÉ été b"), (5, "a ÉTÉ été b"), (6, (PASSAGE + " ") * 3), (7, "x " * 5000 + PASSAGE + " y" * 600), (8, "eleven twelve"), (None, PASSAGE),
    (9, "one two three four five six seven eight nine ten"), (11, " ".join(f"long{i}" for i in range(41, 50)) + " long0 long1"), (10, "one two three four five six seven eight nine ten one two three four five six seven eight nine ten"),
]
ITEMS = [(3, PASSAGE), (11, "été"), (12, None), (13, "?!"), (3, "eleven twelve"), (None, "a ÉTÉ"), (20, PASSAGE), (21, "ten " * 12), (22, " ".join(f"Long{i % 50}" for i in range(90)) + " x y x y x")]


@pytest.mark.parametrize("table_windows", [decontamination.TABLE_WINDOWS, 3])
@pytest.mark.parametrize("docs", [DOCS, []])
def test_equals_brute_force(spark, docs, table_windows):
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.report(decontamination.find_benchmark(d, b, table_windows=table_windows)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(docs, ITEMS)


def test_few_pairs_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from cardloom.llm import bytewords

    w = bytewords.words(pa.array([t for _, t in DOCS], pa.string()))
    (table, *_) = [t for t in decontamination.search_tables([(k, f"{k} a b {k % 3} c d e f g h of the") for k in range(40)] + ITEMS) if t.length == 10]
    whole = decontamination.search(w, table)
    monkeypatch.setattr(decontamination, "_PAIRS", 3)
    parts = decontamination.search(w, table)
    assert len(whole[0]) > 5 and sorted(zip(*map(list, whole), strict=True)) == sorted(zip(*map(list, parts), strict=True))


def test_empty_benchmark_finds_nothing(spark):
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontamination.report(decontamination.find_benchmark(d, b)).collect()} == {False}


def test_spans_never_cross_documents(spark):
    d = spark.createDataFrame([(1, "p q"), (2, "p q"), (3, "p q x p q")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "p q")], "item_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in decontamination.find_benchmark(d.coalesce(1), b).collect()}
    assert got == {1: [(0, 2)], 2: [(0, 2)], 3: [(0, 2), (3, 5)]}


def test_tasks_hold_one_table(spark):
    """A benchmark of several tables: no plan has more than one search in it, and the filter keeps what the report calls clean."""
    d = spark.createDataFrame(DOCS, "doc_id long, text string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    found, kept = decontamination.find_benchmark(d, b, table_windows=40), decontamination.filter_contaminated(d, b, table_windows=40)
    for df in (found, kept):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = brute(DOCS, ITEMS)
    assert sorted([tuple(r) for r in decontamination.report(found).collect()], key=str) == want
    assert sorted([r.doc_id for r in kept.collect()]) == sorted(r[0] for r in want if not r[5])


def test_ids_of_any_kind_and_names_with_dots(spark):
    d = spark.createDataFrame([("b-1", "p q"), ("b-2", "r")], "`doc.id` string, `the.text` string")
    b = spark.createDataFrame([("x-10", "p"), ("x-9", "q"), (None, "r")], "`item.id` string, `its.text` string")
    found = decontamination.find_benchmark(d, b, id_col="doc.id", text_col="the.text", item_col="item.id", item_text_col="its.text")
    assert {r.doc_id: r["items"] for r in found.collect()} == {"b-1": ["x-10", "x-9"], "b-2": []}
    digest = hashlib.sha256(b"x-10,x-9").hexdigest()
    assert {r.doc_id: (r.items_sha256, r.contaminated) for r in decontamination.report(found).collect()} == {"b-1": (digest, True), "b-2": (hashlib.sha256(b"").hexdigest(), True)}
    assert decontamination.filter_contaminated(d, b, text_col="the.text", item_col="item.id", item_text_col="its.text").count() == 0
