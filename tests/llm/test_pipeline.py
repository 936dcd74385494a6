import corpus_pipeline as P
from fraudloom.llm import common, toxicity
from tests_llm_brute import lines_kept, slow_kept


def test_stage_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "sentencepiece"]


def test_every_stage_against_brute_force(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").cache()
    cols = docs.columns
    scratch = common.Scratch(spark, "pipeline-test")
    steps = {}
    for name, stage in P.STAGES:
        before = docs
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        steps[name] = (before, docs)
        if name != "sentencepiece":
            assert docs.columns == cols

    before, after = steps["toxicity"]
    score = {r.doc_id: r.predicted for r in toxicity.classify(before, common.table(spark, sf_dir, "labels")).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, p in score.items() if not p)

    before, after = steps["line_dedup"]
    assert {r.doc_id: r.text for r in after.collect()} == lines_kept([(r.doc_id, r.text) for r in before.collect()])

    before, after = steps["simhash"]
    assert {r.doc_id for r in after.collect()} == slow_kept({r.doc_id: r.text for r in before.collect()})

    before, after = steps["mixing"]
    size = {r.doc_id: len(r.text.encode().split()) for r in before.collect()}
    taken = {}
    for r in after.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split(" "))
    assert all(n <= 3 * size[d] for d, n in taken.items()) and abs(sum(taken.values()) - sum(size.values())) <= 20 * 256

    before, after = steps["sentencepiece"]
    assert after.count() == before.count() and after.filter("n_tokens = 0").count() == before.filter("text = ''").count()


def test_run(spark, sf_dir):
    from fraudloom.scratch import OPENED

    before = len(OPENED)
    assert P.run(spark, sf_dir).count() > 0 and len(OPENED) == before + 1
    assert P.ORACLE_SQL is None
