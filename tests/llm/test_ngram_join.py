import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from dosewise.llm import common, ngram_join, queries

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(texts, n, percent):
    sets = {i: shingles(t, n) for i, t in texts.items()}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    common = Counter((a, b) for ids in by.values() for a in ids for b in ids if a < b)
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def held(rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op3_ngram_join(spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == len(texts) and held(rows) == brute(texts, 3, 90)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_chains_hot_groups_and_borders(spark, n, percent):
    rng = random.Random(n)
    texts = {}
    for g in range(40):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 20, 40, 60, 150]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "new" + str(rng.randrange(5))
            texts[len(texts)] = " ".join(copy)
            words = copy if rng.random() < 0.5 else words  # chains drift
    hot = [f"h{i}" for i in range(80)]
    for k in range(60):  # all differ, within one dense group
        texts[len(texts)] = " ".join([*hot[:40], f"u{k}", *hot[40:]])
    rows = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, key string").repartition(5)
    assert held(ngram_join.jaccard_groups(rows, n=n, percent=percent).collect()) == brute(texts, n, percent)


def test_messy(messy, none):
    rows = ngram_join.jaccard_groups(messy).collect()
    assert len(rows) == messy.count()
    by = defaultdict(set)
    for r in rows:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert by[1] == {(13, 1)} and by[2] == {(13, 1)} and by[3] == {(0, 3)} and by[4] == {(0, 4)} and by[5] == {(0, 5)}
    assert {c for _, c in by[None]} == {None} and {c for _, c in by[6]} == {6}
    assert ngram_join.jaccard_groups(none).count() == 0


def test_dense_group_around_another_than_its_smallest_id(spark, monkeypatch):
    """Copies near the limit from each other: the rounds of hubs join most, the blocks the rest."""
    rng, seen = random.Random(7), []
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for k in range(120):
        words = list(base)
        for at in rng.sample(range(200), rng.choice([2, 3, 4, 5, 6])):
            words[at] = f"x{k}_{at}"
        texts[k] = " ".join(words)
    hubs = ngram_join._hub_links
    monkeypatch.setattr(ngram_join, "_hub_links", lambda *a: seen.append(1) or hubs(*a))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for n, percent in ((5, 80), (3, 90)):
        assert held(ngram_join.jaccard_groups(rows, n=n, percent=percent).collect()) == brute(texts, n, percent)
    assert seen


def test_unrelated_sets_share_no_candidates_at_80_percent(spark):
    rng = random.Random(11)
    texts = {i: " ".join(f"w{rng.randrange(10**5)}" for _ in range(304)) for i in range(300)}
    shared = " ".join(f"s{i}" for i in range(100))  # a passage that all have
    rows = spark.createDataFrame([(i, f"{t} {shared}") for i, t in texts.items()], "id long, text string")
    levels = ngram_join.frequency_levels(rows, 5)
    import pyarrow as pa

    keys = Counter(k for s in ngram_join._sets(pa.array([f"{t} {shared}" for t in texts.values()]), 5) for k in ngram_join.prefix(s, levels, 80)[0].tolist())
    assert max(keys.values()) == 1


def test_only_what_the_result_reads_stays_on_disk(spark, documents):
    folder = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    out = ngram_join.jaccard_groups(documents.select("doc_id", "text"))
    left = {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p not in before}
    assert left <= {"members", "edges", "least", "large"} and out.count() == documents.count()


def test_chance_n_grams_make_no_candidates():
    """Texts of few words share single n-grams, the more the more texts there are, but no keys."""
    rng = np.random.default_rng(5)
    grams = ngram_join.mix(np.arange(8000, dtype=np.uint64))
    sets = [np.sort(rng.choice(grams, 200, replace=False)) for _ in range(600)]
    counts = np.bincount(ngram_join._cells(np.concatenate(sets), 1 << 18), minlength=1 << 18)
    levels = (4 * np.log2(np.maximum(counts, 1))).astype(np.uint8)
    keys = Counter(k for s in sets for k in ngram_join.prefix(s, levels, 90)[0].tolist())
    assert sum(c for c in keys.values() if c > 1) < 6


@pytest.mark.parametrize("percent", [30, 60, 80, 90, 97, 100])
def test_sets_that_link_have_a_key_in_common(percent):
    rng = np.random.default_rng(percent)
    levels = rng.integers(0, 60, 1 << 18).astype(np.uint8)
    for _ in range(1500):
        union = ngram_join.mix(rng.integers(0, 1 << 62, rng.choice([1, 2, 5, 10, 11, 19, 20, 40, 130, 600])).astype(np.uint64))
        only = (len(union) - -(-percent * len(union) // 100)) * (rng.random() < 0.7)  # as far apart as links go, else equal
        mine = rng.integers(0, only + 1)
        a, b = np.sort(np.delete(union, np.arange(mine))), np.sort(np.delete(union, np.arange(mine, only)))
        assert set(ngram_join.prefix(a, levels, percent)[0].tolist()) & set(ngram_join.prefix(b, levels, percent)[0].tolist())


def test_rounds_of_nearest_partners_leave_small_keys_to_the_end(spark):
    """Else every round would pair the documents of all small keys anew."""
    sketch = bytearray(64)
    rest = spark.createDataFrame([(1, i, i, 3) for i in range(3)] + [(2, i, i, 20) for i in range(10, 30)], "key long, id long, comp long, members long")
    sizes = spark.createDataFrame([(i, 40, sketch, sketch) for i in [*range(3), *range(10, 30)]], "id long, n long, sketch binary, brief binary")
    pairs = {nearest: [(r["a"], r["b"]) for r in ngram_join._across(rest, sizes, 90, nearest).collect()] for nearest in (True, False)}
    assert sorted(a for a, _ in pairs[True]) == list(range(10, 30)) and all(b >= 10 for _, b in pairs[True])
    assert sorted(pairs[False]) == sorted((a, b) for few in (range(3), range(10, 30)) for a in few for b in few if a > b)
