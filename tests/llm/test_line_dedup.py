import random

import pyarrow as pa

from dosewise.llm import line_dedup, queries

from .test_line_dedup_passages import brute as passages


def brute(rows):
    """rows: (id, text) in order; (id, text left) after the repeated chunks and the repeated runs of lines are taken out."""
    left = passages(rows)
    return [(id_, left[id_]) for id_, _ in rows]


def test_query_equals_brute_force(spark, tiny, texts):
    rows = queries.op5_line_dedup(spark, tiny).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == brute(sorted(texts.items()))
    assert all((r["n_removed"] > 0) == (r["text"] != texts[r["doc_id"]]) for r in rows) and sum(r["n_removed"] for r in rows)


def test_chunks_make_up_the_text_and_resist_shifts():
    rng = random.Random(1)
    lines = [" ".join(str(rng.random()) for _ in range(3)) for _ in range(500)]
    text = "\n".join(lines)
    a = [text.encode()[s:e] for _, _, s, e, _, _ in line_dedup.chunks(pa.array([text]))]
    assert b"".join(a) == text.encode()
    shifted = "\n".join(["new line", "and another", *lines])
    b = [shifted.encode()[s:e] for _, _, s, e, _, _ in line_dedup.chunks(pa.array([shifted]))]
    assert b"".join(b) == shifted.encode() and len(set(a) & set(b)) >= len(set(a)) - 2


def test_passages_across_documents_go(spark):
    rng = random.Random(2)
    fresh = lambda n: [" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(n)]
    shared, long = fresh(40), " ".join(f"p{i}" for i in range(60))
    rows = [(i, "\n".join([*fresh(5), *shared, *fresh(5), long])) for i in range(20)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert out[0] == rows[0][1]
    for i in range(1, 20):
        kept = out[i].split("\n")
        assert long not in kept and len(set(kept) & set(shared)) <= 12
        assert all(x in kept for x in rows[i][1].split("\n")[:2])


def test_long_runs_of_equal_lines_resist_shifts():
    cut = lambda text: [text.encode()[s:e] for _, _, s, e, _, _ in line_dedup.chunks(pa.array([text]))]
    run = "\n".join(["first", *["same line"] * 300, "last", "end"])
    assert set(cut(run)) & set(cut("\n".join(["x", "y z", run]))) and b"".join(cut(run)) == run.encode()


def test_messy(messy, none):
    out = line_dedup.remove_repeated(messy)
    assert out.columns == [c for c in messy.columns if c != "n_removed"] + ["n_removed"]
    rows = out.collect()
    assert len(rows) == messy.count()
    by = {(r["doc_id"], r["text"]) for r in rows}
    assert (3, None) in by and (4, "") in by and (6, "one") in by
    assert line_dedup.remove_repeated(none).count() == 0
