import numpy as np
import pytest

from dosewise.llm import queries, token_counts


def test_query_is_a_round_trip(spark, tiny, texts):
    rows = queries.op7_token_counts(spark, tiny).collect()
    encoding = token_counts._encoding(token_counts.TOKENIZER)
    assert len(rows) == len(texts)
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(encoding.encode_ordinary(t or "")) for i, t in texts.items()}
    by = {}
    for r in sorted(rows, key=lambda r: (r["file_no"], r["ordinal"])):
        assert (r["ordinal"], r["start"]) == by.get(r["file_no"], (0, 0)) and r["closed"]
        by[r["file_no"]] = r["ordinal"] + 1, r["start"] + r["n_tokens"] + 1


def brute(ids, end):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((len(out), start, i - start, True))
            start = i + 1
    if start < len(ids):
        out.append((len(out), start, len(ids) - start, False))
    return out


@pytest.mark.parametrize("width", [2, 4])
@pytest.mark.parametrize("block,span,ranged", [(4, 3, True), (8, 1024, True), (20, 2, False), (1 << 20, 1024, True)])
def test_any_block_size(spark, tmp_path, monkeypatch, width, block, span, ranged):
    monkeypatch.setattr(token_counts, "SPAN", span)
    if not ranged:
        monkeypatch.setattr(token_counts, "RANGED", ())
    rng = np.random.default_rng(block)
    want = {}
    for k, ids in enumerate([[], [9], [1], [9, 9, 9], [1, 2, 3], [1, 9], [9, 1], rng.integers(7, 11, 500).tolist(), [1] * 100 + [9], rng.integers(0, 40, 999).tolist()]):
        np.array(ids, f"<u{width}").tofile(tmp_path / f"f{k}.bin")
        want[k] = brute(ids, 9)
    found = {k: [] for k in want}
    for r in token_counts.document_tokens(spark, f"file://{tmp_path}", end=9, width=width, block_bytes=block).collect():
        found[int(r["file"].rsplit("/f", 1)[1].removesuffix(".bin"))].append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in found.items()} == want


def test_messy(spark, messy, none, tmp_path):
    token_counts.write_token_files(messy, f"file://{tmp_path}/a")
    assert token_counts.document_tokens(spark, f"file://{tmp_path}/a", pattern="part-*").count() == messy.count()
    token_counts.write_token_files(none, f"file://{tmp_path}/b")
    assert token_counts.document_tokens(spark, f"file://{tmp_path}/b", pattern="part-*").count() == 0


PARALLELISM = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture
def parallelism(spark):
    """Sets how many partitions scans aim at; small files are split."""
    sizes = {"spark.sql.files.openCostInBytes": "1000"}
    before = {k: spark.conf.get(k, None) for k in (*sizes, PARALLELISM)}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    yield lambda n: spark.conf.set(PARALLELISM, str(n))
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_doc_ids_whatever_the_parallelism(spark, tmp_path, parallelism):
    """Another parallelism between writing and counting, and between both and reading the result."""
    words = [" ".join(["word"] * (i % 13 + 1)) for i in range(300)]
    spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").repartitionByRange(30, "doc_id").write.parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    parallelism(3)
    parts = docs.rdd.getNumPartitions()
    at = token_counts.write_with_places(docs, f"file://{tmp_path}/tokens", "doc_id")
    parallelism(30)
    assert spark.read.parquet(f"file://{tmp_path}/docs").rdd.getNumPartitions() != parts  # the scan would be cut otherwise
    found = token_counts.with_columns(token_counts.document_tokens(spark, f"file://{tmp_path}/tokens", pattern="part-*"), at)
    parallelism(7)
    counts = {r["doc_id"]: r["n_tokens"] for r in found.collect()}
    one = len(token_counts._encoding(token_counts.TOKENIZER).encode_ordinary("word word")) // 2
    assert counts == {i: (i % 13 + 1) * one for i in range(300)}
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_places_of_other_files_are_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words") for i in range(20)], "doc_id long, text string")
    at = token_counts.write_with_places(docs, f"file://{tmp_path}/a", "doc_id")
    token_counts.write_token_files(docs.where("doc_id < 19"), f"file://{tmp_path}/b")
    found = token_counts.document_tokens(spark, f"file://{tmp_path}/b", pattern="part-*")
    with pytest.raises(Exception, match="do not fit each other"):
        token_counts.with_columns(found, at).collect()
