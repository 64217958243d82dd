import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm.token_count import count, load, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = load(PATH)
PIECE = st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "'s", "12", "é", "ß", "<|endoftext|>", "\x1c", " ", "日本", "!!", "🙂", "́", " of", "."])


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECE, max_size=14).map("".join))
def test_equals_library(text):
    assert count([text], PATH) == [len(TOK.encode(text, add_special_tokens=False).ids)]


def test_rows_and_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, 5), (-2, "", 5), (-2, "", 5), (None, "word " * 3000, 5)], "doc_id long, text string, n_tokens int")
    for d in (docs, odd, odd.limit(0)):
        rows = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(d, PATH).collect()}
        want = {(r.doc_id, len(t.encode()), n, n > 1024) for r in d.select("doc_id", "text").collect() for t in [r.text or ""] for n in [len(TOK.encode(t, add_special_tokens=False).ids)]}
        assert rows == want
