import zlib

import numpy as np
from pyspark.sql import functions as F

from dosewise.llm import language_id, queries


def test_query_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op10_language_id(spark, sf_dir).collect()
    assert len(rows) == len(truth)
    right = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        text = truth[r["doc_id"]]["text"]
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        elif r["held_out"]:
            right.append(r["lang_pred"] == truth[r["doc_id"]]["lang"])
    assert len(right) > 100 and np.mean(right) >= 0.95, np.mean(right)


def test_vectors_equal_brute_force():
    texts = ["Hello, World", "été 12 naïve", None, "", "123 !!", "a", "ab  cd"]
    got = language_id.text_vectors(texts)
    letters, symbols = language_id._letters(language_id.DIMENSIONS), language_id._symbols()
    for t, v in zip(texts, got, strict=True):
        s = [0]
        for c in (t or "").lower():
            if symbols[ord(c)] or s[-1]:
                s.append(int(symbols[ord(c)]))
        s += [0] if s[-1] else []
        want = np.zeros(language_id.DIMENSIONS)
        for i in range(len(s) - 2):
            want += np.prod([np.roll(letters[s[i + 2 - p]].astype(int), p) for p in range(3)], axis=0)
        want /= max(np.linalg.norm(want), 1e-9)
        assert np.allclose(v, want, atol=1e-5), t


def test_predictions_use_the_text_alone(spark, documents):
    truth = {r["doc_id"]: r["predicted"] for r in language_id.identify(documents).select("doc_id", "predicted").collect()}
    moved = documents.withColumns({"source": F.lit("x"), "lang": F.when(language_id.held_out("doc_id"), F.lit("zz")).otherwise(F.col("lang"))})
    assert {r["doc_id"]: r["predicted"] for r in language_id.identify(moved).select("doc_id", "predicted").collect()} == truth


def test_messy(messy, none):
    rows = language_id.identify(messy).collect()
    assert len(rows) == messy.count()
    for r in rows:
        assert (r["predicted"]["lang"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert language_id.identify(none).count() == 0
    assert {r["predicted"]["lang"] for r in language_id.identify(messy.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_pieces_of_languages_predict_as_one(spark, documents, monkeypatch):
    held = lambda: {r["doc_id"]: r["predicted"] for r in language_id.identify(documents).collect()}
    whole = held()
    monkeypatch.setattr(language_id, "PIECE_LANGUAGES", 1)
    pieces = language_id.prototypes(documents)
    assert len(pieces) == 4 and sum(len(langs) for langs, _ in pieces) == 4
    found = held()
    assert {i: p["lang"] for i, p in found.items()} == {i: p["lang"] for i, p in whole.items()}
    assert all(abs(p["score"] - whole[i]["score"]) < 1e-4 for i, p in found.items())


def test_texts_in_no_learned_language_do_not_fit(spark, documents):
    rng = np.random.default_rng(1)
    odd = [(10**6 + i, " ".join("".join(rng.choice(list("qxzkvjw"), 7)) for _ in range(200)), None) for i in range(40)]
    rows = documents.select("doc_id", "text", "lang").union(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    fits = {r["doc_id"]: r["fits"] for r in language_id.judged(rows).collect()}
    letters = {r["doc_id"] for r in documents.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert not any(fits[i] for i, _, _ in odd)
    assert all(fits[i] == (i in letters) for i in fits if i < 10**6)
