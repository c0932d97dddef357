"""Of a group of near copies one row stays, also where ids repeat."""

import corpus_pipeline as pipeline


def test_one_row_of_a_group_stays(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (1, a + " end"), (2, a), (2, b), (3, c), (3, c), (3, b), (4, "other words"), (5, ""), (5, ""), (None, a), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = [(r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, "").select("doc_id", "text").collect()]
    near = [r for r in got if r[0] == 1]
    assert len(near) == 1 and near[0][1] in (a, a + " end")
    want = [(2, b), (3, c), (4, "other words"), (5, ""), (5, ""), (None, a), (6, None)]
    assert sorted(map(repr, [r for r in got if r[0] != 1])) == sorted(map(repr, want))
