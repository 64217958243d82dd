import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm.token_count import load
from riskweave.llm.wavelet import Shard, Words, digests, encode_shard, token_shards, write_shards

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = load(PATH)
PIECE = st.sampled_from(["a", "The", " ", "  ", "\n", "'s", "12", "É", "ß", "Σ", "İ", "<|endoftext|>", "\x1c", " ", "日本", "!!", "🙂", "́", " of", "."])


@settings(max_examples=200, deadline=None)
@given(st.lists(PIECE, max_size=14).map("".join))
def test_words_equal_library(text):
    assert W.encode([text])[0].tolist() == TOK.encode(text, add_special_tokens=False).ids


W = Words(PATH, remember=(50, 60))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=300), st.integers(0, 40))
def test_matrix(values, token):
    s = Shard(encode_shard([7], [len(values)], np.array(values, np.uint16), 6))
    assert s.all().tolist() == values
    assert [s.access(k) for k in range(0, len(values), 7)] == values[::7]
    assert s.access_many(np.arange(len(values))).tolist() == values
    cuts = np.arange(len(values) + 1)
    assert s.count_many(token, cuts[:0], cuts[:0]).tolist() == [] and s.count_many(token, 0 * cuts, cuts).tolist() == [values[:k].count(token) for k in cuts]
    a, b = len(values) // 3, len(values)
    assert s.count(token, a, b) == values[a:b].count(token)
    where = [k for k, v in enumerate(values) if v == token]
    assert [s.locate(token, k) for k in range(len(where))] == where


def test_blocks():
    values = np.random.default_rng(1).integers(0, 50_000, 20_000).astype(np.uint16)
    s = Shard(encode_shard([1, None], [15_000, 5_000], values, 16))
    assert (s.all() == values).all() and s.table()[0] == [1, None]
    for k in (0, 4095, 4096, 12_345, 19_999):
        assert s.access(k) == values[k]
        assert s.locate(int(values[k]), s.count(int(values[k]), 0, k)) == k


def expect(rows):
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*TOK.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4")), ids[0], ids.count(1)))
        at += len(ids)
    return sorted(out, key=str)


def test_round_trip(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(5, None, 1), (5, "", 1), (None, "a b", 1), (-3, "x " * 50_000, 1), (5, "Same", 1), (5, "Same", 1), (9, "<|endoftext|> x", 1)], "doc_id long, text string, start int")
    for k, d in enumerate((docs, odd, odd.limit(0))):
        got = sorted((tuple(r) for r in token_shards(d, PATH, f"file://{tmp_path}/{k}").collect()), key=str)
        assert got == expect([tuple(r) for r in d.select("doc_id", "text").collect()])


def test_many_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = f"file://{tmp_path}/many"
    m = write_shards(docs, out, PATH, shard_tokens=5_000, range_chars=60_000)
    assert m.count() > 20
    assert sorted((tuple(r) for r in digests(spark, out, m).collect()), key=str) == expect([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_common_pieces_reach_the_library_once(monkeypatch):
    from riskweave.llm import wavelet

    w, sent = Words(PATH, remember=(50, 60)), []
    own = wavelet.encode_all
    monkeypatch.setattr(wavelet, "encode_all", lambda tok, strings: sent.extend(strings) or own(tok, strings))
    for k in range(20):
        # new words in every batch, and the same ones with other cases and signs about them
        text = " ".join([f"fresh{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}{c}" for c in "abcdefghijklmnopqrstuvwxy"] + [f"Common{c}{'.,!%'[k % 4]}" for c in "abcdefghij"])
        assert w.encode([text])[0].tolist() == TOK.encode(text, add_special_tokens=False).ids
        assert len(w.pieces) <= 60 + 50
    assert sum(s.count("commona") + s.count("Commona") for s in sent) == 1


def test_odd_words():
    # marks that compose with small letters only, a letter that becomes a letter and a mark, special strings in other case, long words
    texts = ["H̱ ẖ T̈ J̌.", "Ħİ\x02¶ İ.", "'<|EndOfText|> <|ENDOFTEXT|>x", "KſÅ Straßeẞ", "It'S DON'T. \"we'LL\"", "a B\u0085c\x0bD", "A.1" * 20_000, ""]
    assert [x.tolist() for x in W.encode(texts)] == [TOK.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_several_tokens_in_any_order():
    texts = ["12ab ab12 x9y ...", "zzqxv1 qqqq22 éèzz?!", "9 8 7"]
    w = Words(PATH)
    assert w.encode(texts)[1].tolist() == TOK.encode(texts[1], add_special_tokens=False).ids
    assert [x.tolist() for x in w.encode(texts)] == [TOK.encode(t, add_special_tokens=False).ids for t in texts]
    w = Words(PATH)
    w.ends = None  # a tokenizer whose tokens do not show where a word ends
    assert [x.tolist() for x in w.encode(texts)] == [TOK.encode(t, add_special_tokens=False).ids for t in texts]
