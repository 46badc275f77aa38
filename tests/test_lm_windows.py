"""Windows of long token lists."""

from lexiscope.operators import lm


def test_windows_do_not_carry_their_document(spark):
    df = spark.createDataFrame([(1, list(range(40))), (2, [1, 2]), (3, None)], "doc_id int, tokens array<int>")
    w = lm.lm_windows(df, "tokens", 8, 4)
    plan = w._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(tokens" not in plan[:plan.index("Generate")]  # nothing behind the explode needs the tokens
    rows = {(r.doc_id, r.start): (r.input, r.target) for r in w.collect()}
    assert rows == {(1, s): (list(range(s, s + 8)), list(range(s + 1, s + 9))) for s in range(0, 31, 4)}
