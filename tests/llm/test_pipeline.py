import re

import pytest

import corpus_pipeline
from dosewise.llm import decontaminate, mixing

from .test_decontaminate import brute as leaked
from .test_line_dedup import brute as lines
from .test_mixing import targets
from .test_ngram_join import brute as near


def held(df):
    return df.orderBy("doc_id").collect()


def test_stages_equal_brute_force(spark, tiny, documents):
    stages = dict(corpus_pipeline.STAGES)
    docs = documents
    rows = held(docs)

    docs = corpus_pipeline.saved(stages["language ID"](spark, docs, tiny), "t")
    assert docs.columns == documents.columns
    rows = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
    assert held(docs) == rows

    docs = corpus_pipeline.saved(stages["line dedup"](spark, docs, tiny), "t")
    whole = {r["doc_id"]: r["text"] for r in rows}
    want = [x for x in lines([(r["doc_id"], r["text"]) for r in rows]) if x[1] == whole[x[0]] or x[1].strip(" ")]
    rows = held(docs)
    assert docs.columns == documents.columns and [(r["doc_id"], r["text"]) for r in rows] == want

    docs = corpus_pipeline.saved(stages["n-gram Jaccard join"](spark, docs, tiny), "t")
    group = near({r["doc_id"]: r["text"] for r in rows}, 5, 80)
    rows = [r for r in rows if group[r["doc_id"]][1] == r["doc_id"]]
    assert held(docs) == rows

    docs = corpus_pipeline.saved(stages["benchmark decontamination"](spark, docs, tiny), "t")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    gone = {i for i, _ in leaked([(r["doc_id"], r["text"]) for r in rows], items)}
    rows = [r for r in rows if r["doc_id"] not in gone]
    assert held(docs) == rows

    out = stages["mixing sources"](spark, docs, tiny).collect()
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size[r["doc_id"]]
    for s, t in targets(sizes).items():
        took = sum(size[r["doc_id"]] for r in out if r["source"] == s)
        assert abs(took - t) <= max(size[r["doc_id"]] for r in rows if r["source"] == s)

    assert sorted(map(str, corpus_pipeline.run(spark, tiny).collect())) == sorted(map(str, out))


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_messy(spark, tiny, messy, none, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, messy, tiny)
    assert out.columns[: len(messy.columns)] == messy.columns or name == "mixing sources"
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert {10, 13} <= ids or name == "mixing sources"
    assert stage(spark, none, tiny).count() == 0


def test_columns_named_as_the_operators_name_theirs(spark, tiny, messy):
    from pyspark.sql import functions as F

    docs = messy.withColumns({c: F.lit(c) for c in ("copy", "fits", "n_removed", "source_size", "_id", "_key")})
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.saved(stage(spark, docs, tiny), "clash")
        columns = docs.columns if name != "mixing sources" else [*(c for c in docs.columns if c != "copy"), "copy"]
        assert out.columns == columns, name
        assert {r["source_size"] for r in out.select("source_size").collect()} == {"source_size"}, name


def test_repeated_and_missing_ids(spark, tiny):
    item = spark.read.parquet(f"{tiny}/benchmark.parquet").first()["text"]
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (None, "a b c d e f g h"), (None, "p q r s t u v w"), (None, "p q r s t u v w"), (2, "k l m n"), (2, "other words here"), (None, item), (3, None), (None, None), (4, f"x y {item}")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    near = [(r["doc_id"], r["text"]) for r in stages["n-gram Jaccard join"](spark, docs, tiny).collect()]
    assert len(near) == len(set(near)) and {(1, "a b c d e f g h"), (None, "p q r s t u v w"), (3, None), (None, None)} <= set(near)
    assert (None, "a b c d e f g h") not in near and sum(i == 2 for i, _ in near) == 1
    clean = [(r["doc_id"], r["text"]) for r in stages["benchmark decontamination"](spark, docs, tiny).collect()]
    assert not any(item in (t or "") for _, t in clean) and len(clean) == len(rows) - 2
