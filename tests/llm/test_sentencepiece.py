import hashlib

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import sentencepiece_op as op

SP = sentencepiece.SentencePieceProcessor(model_file=op.default_model())


def expected(text):
    ids = SP.encode(text or "")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(SP.decode(ids))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .,\n\t\u2581\u00e9\u4e2d\U0001f600Z0") | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_chunks_equal_whole_texts(text):
    c = op.codec(op.default_model())
    assert c.by_chunk
    ids = c.encode(text)
    assert ids.tolist() == SP.encode(text)
    assert c.decode(ids) == SP.decode(SP.encode(text))


def test_table_is_bounded():
    c = op.ChunkCodec(op.default_model(), table_chars=100)
    for k in range(200):
        text = f"w{k} x{k} y{k} again"
        assert c.encode(text).tolist() == SP.encode(text)
        assert len(c.table) < 60


def test_odd_texts(spark, documents, odd):
    out = {r.doc_id: r for r in op.encode_decode(documents(odd)).collect()}
    assert len(out) == len(odd)
    for k, t in enumerate(odd):
        assert out[k].ids == SP.encode(t or "") and out[k].decoded == SP.decode(SP.encode(t or "")) and out[k].text == t and out[k].score == "x"


def test_query(spark, sf, documents, data_dir, odd):
    for d, rows in ((sf, spark.read.parquet(f"{sf}/documents.parquet").collect()), (data_dir(documents=documents(odd)), documents(odd).collect())):
        got = {r.doc_id: tuple(r)[1:] for r in op.op10_sentencepiece(spark, d).collect()}
        assert got == {r.doc_id: expected(r.text) for r in rows}
    assert op.op10_sentencepiece(spark, data_dir(documents=documents([]))).collect() == []
