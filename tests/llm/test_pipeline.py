import importlib.util

import __spark_entry__
import corpus_pipeline
from cardloom.llm import decontamination, ngram_join, toxicity

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept, before = {}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"{k}-{name}")
        stage(spark, before, SF).write.parquet(path)
        after = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in after.select("doc_id").collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            scores = toxicity.score_toxicity(before, model).where("score < 0.5")
            assert kept[name] == {r.doc_id for r in scores.collect()}
        elif name == "near_duplicates":
            classes = {r.class_id for r in ngram_join.near_duplicates(before).collect()}
            assert kept[name] == classes
        elif name == "decontamination":
            found = decontamination.report(decontamination.find_benchmark(before, spark.read.parquet(f"{SF}/benchmark.parquet")))
            assert kept[name] == {r.doc_id for r in found.where("NOT contaminated").collect()}
        elif name == "surrogates":
            assert kept[name] == {r.doc_id for r in before.collect()}
            assert after.where("text LIKE '%@%'").join(before.select("doc_id", before.text.alias("old")), "doc_id").where("text = old").count() == 0
        else:
            assert kept[name] == {r.doc_id for r in before.collect()}
        before = after
    assert len(kept["toxicity"]) > len(kept["near_duplicates"]) > len(kept["decontamination"]) > 400
    whole = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == kept["packing"]


def test_stages_of_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a@b.org " * 9, "en", "s", 1), (3, "a@b.org " * 9, "en", "s", 1), (None, "no id", "en", "s", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert {r.doc_id for r in docs.collect()} == ({1, 2, 3, None} if some else set())


def test_columns_with_clashing_names_go_through(spark):
    text = "Mr John Smith wrote to ann@b.org from the old town hall about nothing in particular"
    rows = [(k, text if k < 3 else " ".join([*(f"w{k}{i}" for i in range(30)), text]), k, "m", 7, "k", 9, 1.5, "r") for k in range(1, 6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "_id", "_mark", "n_entities", "entity_kinds", "node", "score", "row"])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "_id", "_mark", "n_entities", "entity_kinds", "node", "score", "row"]
    assert {tuple(r)[2:] for r in docs.collect()} == {(k, "m", 7, "k", 9, 1.5, "r") for k in (1, 3, 4, 5)}
    assert docs.where("text LIKE '%Smith%' OR text LIKE '%ann@%'").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 4


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and importlib.util.find_spec("cardloom.llm")
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
