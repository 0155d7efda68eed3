"""What near duplicates move: texts in doubt only, shared n-grams once."""

import corpus_pipeline
from revsync.llm import jaccard_join


def _copies(docs_of, spark, n=40):
    text = " ".join(f"word{k}" for k in range(300))
    return docs_of(spark, [(i, f"{text[i % 20 * 7 :]} end {i}", "en", "a") for i in range(n)])


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_near_duplicates_move_only_texts_in_doubt(spark, docs_of):
    alone = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "en", "a") for i in range(100, 130)]
    text = alone[0][1]
    docs = docs_of(spark, [*alone, (5, text, "en", "a"), (100, "other text", "en", "a"), (None, text, "en", "a"),
                           (None, "no id", "en", "a"), (None, "no id", "en", "a"), (7, None, "en", "a")])
    out = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    plan = _plan(out)
    join = plan.index("Join LeftSemi")
    assert "may(" in plan[join:] and "Union" in plan[:join]
    got = [(r.doc_id, r.text) for r in out.collect()]
    want = [(i, t) for i, t, *_ in alone] + [(5, text), (100, "other text"), (None, text), (None, "no id"), (7, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_shared_ngrams_are_not_made_distinct_again(spark, docs_of, monkeypatch):
    plans, stage = {}, jaccard_join.stage

    def watched(df, name):
        plans[name] = _plan(df)
        return stage(df, name)

    monkeypatch.setattr(jaccard_join, "stage", watched)
    docs = _copies(docs_of, spark).repartition(5)
    assert jaccard_join.join(docs).where("component_id = 0").count() > 1
    assert "jaccard-placed" in plans and "Aggregate" not in plans["jaccard-placed"].split("Join")[0]
