import sentencepiece

import corpus_pipeline
from millrace.llm import common, minhash, quality, queries, sentencepiece_op
from millrace.llm import decontaminate as dc

from .test_minhash import brute

D = "/root/testdata/sf0.001"


def test_stages_against_their_parts(spark):
    """Every stage's rows follow from its input by a plain version of the stage."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "sentencepiece"]
    scratch = common.Scratch(spark, "test")
    docs, steps = common.table(spark, D, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.keep(stage(spark, docs, D), name)
        steps.append((sorted(docs.collect()), sorted(after.collect())))
        assert name == "sentencepiece" or after.columns == docs.columns
        docs = after
    (before, good), (_, once), (_, clean), (_, masked), (_, last) = steps
    model = quality.trained(common.table(spark, D, "documents"), common.table(spark, D, "labels"))
    scores = model.score([r.text for r in before])
    assert [r for r, s in zip(before, scores, strict=True) if s >= 0.3] == good and 0 < len(good) < len(before)
    classes = brute([r.text for r in good], 5)
    assert [r for k, r in enumerate(good) if classes[k][1] == k] == once and len(once) < len(good)
    pad = lambda t: b" " + b" ".join(dc.words(t)) + b" "
    items = [pad(r.text) for r in common.table(spark, D, "benchmark").collect()]
    assert [r for r in once if not any(i in pad(r.text) for i in items)] == clean
    assert [r.doc_id for r in masked] == [r.doc_id for r in clean]
    for a, b in zip(clean, masked, strict=True):
        assert (a == b) or ("[SECRET]" in b.text and b.n_chars == len(b.text))
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_op.default_model())
    assert [(r.doc_id, sp.encode(r.text)) for r in masked] == [(r.doc_id, r.ids) for r in last]
    assert all(r.decoded == sp.decode(r.ids) for r in last)
    assert sorted(corpus_pipeline.run(spark, D).collect()) == last


def test_odd_documents(spark, documents, data_dir, odd):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(len(odd))], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    d = data_dir(documents=documents(odd), labels=labels, benchmark=bench)
    kept = {r.doc_id for r in corpus_pipeline.run(spark, d).collect()}
    assert kept <= set(range(len(odd)))
    empty = data_dir(documents=documents([]), labels=labels.where("doc_id < 0"), benchmark=bench.where("item_id < 0"))
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_all_are_registered():
    names = list(queries.queries())
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] == names
    assert set(queries.oracle_sql()) <= set(names)
    assert minhash.SHINGLE == 5 and minhash.PERCENT == 80
