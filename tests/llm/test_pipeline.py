import corpus_pipeline as cp
from drawgraph.llm.common import table

DIR = "/root/testdata/sf0.001"


def test_stages_hand_on_documents_and_their_decisions_take_effect(spark, tmp_path):
    docs = first = table(spark, DIR, "documents")
    seen = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before.count(), docs.count())
        if name != "best_fit_packing":
            assert docs.columns == first.columns
    assert seen["quality_rules"][1] < seen["quality_rules"][0]
    assert seen["jaccard_join"][1] < seen["jaccard_join"][0]
    assert seen["personal_data"][1] == seen["personal_data"][0]
    texts = [r.text for r in spark.read.parquet(str(tmp_path / "personal_data")).collect()]
    assert any("[EMAIL]" in t for t in texts) and not any("@mail" in t for t in texts)
    assert docs.agg({"length": "max"}).first()[0] <= 4096


def test_run_gives_packed_pieces(spark):
    out = cp.run(spark, DIR)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100


def test_nulls_pass_through_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (2, "a b c", "en", "s", 5)], schema)
    want = {"quality_rules": [], "jaccard_join": [None, "", "a b c"], "personal_data": [None, "", "a b c"]}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DIR)
        if name in want:
            assert sorted((r.text for r in out.collect()), key=str) == sorted(want[name], key=str)
        if name == "source_mixing":
            assert {r.text for r in out.collect()} <= {None, "", "a b c"}
        if name == "best_fit_packing":
            assert sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in out.collect()) == [(False, 1, 1), (False, 2, 4), (True, 0, 1)]
        else:
            assert out.columns == docs.columns
