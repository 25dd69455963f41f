import itertools
import math
import random
import re

import pytest

from dosewise.llm import decontaminate, queries

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def brute(docs, items):
    out = set()
    for i, t in docs:
        d = words(t)
        seen = set(d)
        for j, x in items:
            w = words(x)
            n = min(len(w), decontaminate.WINDOW)
            if not w:
                continue
            # a short item must stand there as a whole
            need = n if n < decontaminate.LEAST_WORDS else math.ceil(n * decontaminate.SAME - 1e-9)
            known = [x in seen for x in w]
            if not any(sum(known[k : k + n]) >= need for k in range(len(w) - n + 1)):
                continue
            for shift in range(-len(w) + n, len(d) - n + 1):
                a, b = max(0, -shift), min(len(w), len(d) - shift)
                same = [d[k + shift] == w[k] for k in range(a, b)]
                if any(sum(same[k : k + n]) >= need for k in range(len(same) - n + 1)):
                    out.add((i, j))
                    break
    return out


def test_query_equals_brute_force(spark, tiny, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    want = brute(texts.items(), items)
    found = queries.op8_decontaminate(spark, tiny).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) == len(want) and want


@pytest.mark.parametrize("n", range(decontaminate.LEAST_WORDS, decontaminate.WINDOW + 1))
def test_masks_leave_no_overlap_without_a_hit(n):
    misses = n - int(decontaminate.least_same(n))
    for gaps in itertools.combinations(range(n), misses):
        same = [k not in gaps for k in range(n)]
        assert any(all(same[a + p] for p in m) for m in decontaminate.MASKS for a in range(n - m[-1])), gaps


def test_substitutions_and_borders(spark):
    rng = random.Random(5)
    items = [(j, " ".join(f"i{j}w{k}" for k in range(rng.choice([9, 10, 15, 20, 40])))) for j in range(30)] + [(30, None), (31, ""), (None, "a b c d e f g h i j k l"), (32, "same " * 30)]
    docs = []
    for i in range(200):
        w = words(items[rng.randrange(30)][1])
        a = rng.randrange(len(w))
        w = w[a:] if rng.random() < 0.3 else w
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = "other"
        pad = [f"p{rng.randrange(9999)}" for _ in range(rng.randrange(40))]
        docs.append((i, " ".join([*pad, *w, *pad])))
    docs += [(500, "same " * 200), (501, None), (502, "")]
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, hash string").repartition(3)
    b = spark.createDataFrame([(*x, "c") for x in items], "item_id long, text string, region string")
    found = decontaminate.leaks(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == brute(docs, [x for x in items if x[0] is not None])


def test_messy(messy, none, spark):
    b = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(messy, b).collect()) == [(1, 1), (2, 1)]
    assert decontaminate.leaks(none, b).count() == 0 and decontaminate.leaks(messy, b.limit(0)).count() == 0


def found_in(spark, docs, items):
    rows = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r["doc_id"], r["item_id"]) for r in rows}


def test_short_items_match_as_a_whole(spark):
    rng = random.Random(5)
    fresh = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    items = [(n, " ".join(fresh(n))) for n in range(1, 14)]
    docs = []
    for n, text in items:
        w = text.split()
        docs += [(10 * n, " ".join([*fresh(5), *w, *fresh(5)])), (10 * n + 1, text), (10 * n + 2, " ".join([*fresh(9), *w[:-1], "other"])), (10 * n + 3, " ".join([*w[:-1], "x", *w[-1:]]))]
    want = brute(docs, items)
    assert found_in(spark, docs, items) == want and {(10 * n, n) for n, _ in items} | {(10 * n + 1, n) for n, _ in items} <= want
    assert not {(10 * n + 2, n) for n in range(1, 10)} & want


def test_long_runs_of_one_word(spark):
    rng = random.Random(6)
    fresh = lambda k: [f"w{rng.randrange(30)}" for _ in range(k)]
    runs = [[*fresh(rng.randrange(9)), *["la"] * rng.randrange(1, 40), *fresh(rng.randrange(12))] for _ in range(60)]
    items = [(i, " ".join(w)) for i, w in enumerate(runs[:20])]
    docs = [(i, " ".join(w)) for i, w in enumerate(runs)] + [(100 + i, " ".join(["la", *w[1:], "la", "la"])) for i, w in enumerate(runs)]
    docs.append((999, "la " * 50_000))
    small = [d for d in docs if d[0] != 999]
    assert {x for x in found_in(spark, docs, items) if x[0] != 999} == brute(small, items)
