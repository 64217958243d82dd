import pandas as pd

from riskweave.operators.chunks import chunked, judge_all
from riskweave.operators.context import text_records


def test_a_chunk_goes_to_the_judge_once_for_all_categories(spark, tmp_path):
    records = text_records(spark.createDataFrame([(k, f"text {k} " * 200) for k in range(7)], "id long, text string"), "id", "text")
    judge = lambda name, prompt: '{"hit": true, "confidence": 0.5, "evidence": "%s", "reasoning": "%s"}' % (prompt[-9:], name)  # noqa: E731, UP031
    chunks = chunked(records, 600, 100)
    got = judge_all(chunks, judge)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # texts are not repeated by category before they reach Python
    order = ["record_id", "taxonomy_id", "index"]
    table = lambda df: df.toPandas()[got.columns].sort_values(order).reset_index(drop=True)
    stored = table(judge_all(chunks, judge, store=str(tmp_path / "replies"), rounds=1))
    pd.testing.assert_frame_equal(table(got), stored)
    pd.testing.assert_frame_equal(table(judge_all(chunks, judge, concurrency=3)), stored)
