import numpy as np

from millrace.llm import langid

EN = ["the cat sat on the mat and thought of the dog", "then they went there with the others to the north"] * 5
DE = ["der hund und die katze sitzen auf der decke", "dann gingen sie nach norden und schliefen schlecht"] * 5


def rows():
    return [(t, "en") for t in EN] + [(t, "de") for t in DE]


def test_ngrams_by_text():
    texts = ["ab cd", "", "a", "1 2", "\u00c9t\u00e9"]
    hashes, start, end, has = langid.ngrams(texts)
    for t, a, b, h in zip(texts, start, end, has, strict=True):
        alone = langid.ngrams([t])
        assert sorted(hashes[a:b]) == sorted(alone[0]) and h == any(c.isalpha() for c in t)
    assert (end - start).tolist() == [2 * (2 + 1), 0, 1, 0, 3 + 2]


def test_no_false_negatives():
    model = langid.fit(rows())
    for lang, texts in (("en", EN), ("de", DE)):
        got = model.predict(texts)
        assert all(p == lang and s > 0.5 for p, s in got)
    assert sorted(model.langs) == ["de", "en"] and (model.rate < 0.01).all()


def test_many_languages():
    model = langid.fit([(f"{chr(0x4E00 + 7 * k)}{chr(0x4E01 + 7 * k)}{chr(0x4E02 + 7 * k)} " * 5, f"l{k:03d}") for k in range(70)])
    assert len(model.planes) == 2
    assert [p for p, _ in model.predict([f"{chr(0x4E00 + 7 * k)}{chr(0x4E01 + 7 * k)}{chr(0x4E02 + 7 * k)}" for k in range(70)])] == [f"l{k:03d}" for k in range(70)]


def test_odd_texts(spark, documents, odd):
    model = langid.fit(rows())
    out = {r.doc_id: r for r in langid.predict(documents([*odd, "12 34", "zzzzqq"]), model).collect()}
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (0, 1, 2, 3, len(odd)))
    assert out[len(odd) + 1].lang_pred in ("en", "de") and out[len(odd) + 1].score == 0
    assert out[4].lang_pred == out[5].lang_pred
    assert langid.predict(documents([]), model).collect() == []
    assert langid.fit([]).predict(["abc"]) == [("und", 0.0)]
    assert np.isfinite([r.score for r in out.values()]).all()


def test_query(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = langid.op8_language(spark, sf).collect()
    assert len(got) == len(lang)
    assert sum(r.lang_pred == lang[r.doc_id] for r in got if r.held_out) >= 0.95 * sum(r.held_out for r in got)


def test_rare_languages_are_learned(spark):
    """One in 2,000 documents, and an id that repeats."""
    common = [(k, "the quick brown fox jumps over the lazy dog", "en") for k in range(20000)]
    rare = [(100000 + k, "zwolf boxkampfer jagen viktor quer uber den grossen", "de") for k in range(10)]
    hot = [(999999, "abc def", "en")] * 20000
    model = langid.trained(spark.createDataFrame(common + rare + hot, "doc_id long, text string, lang string"), 500)
    assert model.langs == ["en", "de"] and model.predict(["jagen viktor quer"])[0][0] == "de"


def brute(model, text):
    """Language and score of a text n-gram by n-gram, from the definition."""
    s = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
    if not s.strip():
        return "und", 0.0
    hits, n = [0] * len(model.langs), 0
    for k in langid.SIZES:
        for i in range(len(s) - k + 1):
            if " " in s[i + 1 : i + k - 1]:
                continue
            h = k
            for c in s[i : i + k]:
                h = (h * 0x100000001B3 + ord(c)) % 2**64
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ h >> shift) * factor % 2**64
            h ^= h >> 31
            a, b, n = h % langid.SLOTS, h >> 32 | 1, n + 1
            bits = -1
            for j in range(langid.HASHES):
                bits &= int(model.planes[0][(a + j * b) % 2**64 % langid.SLOTS])
            for lang in range(len(hits)):
                hits[lang] += bits >> lang & 1
    right = [max(0.0, (x - n * f) / (1 - f)) for x, f in zip(hits, model.rate.tolist())]
    best = max(range(len(right)), key=lambda k: (right[k], -k))
    return model.langs[best], right[best] / sum(right) if sum(right) else 0.0


def test_whole_query_by_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.trained(docs)
    texts = {r.doc_id: r.text for r in docs.collect() if len(r.text) < 6000}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.op8_language(spark, sf).collect()}
    for k, t in texts.items():
        lang, score = brute(model, t)
        assert got[k][0] == lang and abs(got[k][1] - score) < 1e-9
    for t in ["", "12 34", "Été fin", "a", "don't"]:
        assert model.predict([t])[0][0] == brute(model, t)[0]
