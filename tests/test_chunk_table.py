from riskweave.operators.chunks import chunked, register_chunks
from riskweave.operators.context import conversation_records
from riskweave.queries import conversations


def test_equals_chunked(spark, sf):
    """The table function gives what ``chunked`` gives, row by row."""
    register_chunks(spark)
    records = conversations(spark, sf)
    names = ["record_id", "chunk", "text", "spans", "truncated"]
    want = chunked(records, 700, 100).withColumnRenamed("index", "chunk").select(names)
    got = spark.sql("select r.record_id, c.* from {r} r, lateral chunks(r.messages, 700, 100) c", r=records).select(names)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() > records.count()  # some conversations are cut


def test_empty_and_null_conversations(spark):
    register_chunks(spark)
    assert [tuple(r) for r in spark.sql("select * from chunks(cast(null as array<struct<role:string,content:string>>), null, null)").collect()] == [(0, "", [], False)]
    row = spark.sql("select * from chunks(array(named_struct('role', cast(null as string), 'content', cast(null as string))), 300, 0)").first()
    assert (row.chunk, row.text) == (0, "")
    none = conversation_records(spark.createDataFrame([], "conv_id string, turn int, role string, text string"))
    assert spark.sql("select c.* from {r} r, lateral chunks(r.messages, 700, 100) c", r=none).count() == 0


def test_long_text(spark):
    """A paragraph of 200,000 characters is cut into windows that together hold all of it."""
    register_chunks(spark)
    rows = spark.sql("select * from chunks(array(named_struct('role', 'USER', 'content', repeat('abcde ', 33333))), 1000, 100)").collect()
    assert max(len(r.text) for r in rows) <= 1000 and all(r.truncated for r in rows)
    at = 0
    for x in sorted((x.s, x.e) for r in rows for x in r.spans):
        assert x[0] <= at
        at = max(at, x[1])
    assert at == 6 * 33333
