"""Lexical search and phrases over shards and blocks of any size, and over rows of every kind; the queries' SQL is in test_sql.py."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from dosewise.llm import impact_search, phrases

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def ranked(docs, items, k=10):
    """docs and items: (id, text) rows."""
    held = [(i, Counter(TERM.findall(low(t)))) for i, t in docs if t and TERM.search(t)]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(low(t or "")))
    out = set()
    for item, terms in asked.items():
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // length
            s = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out |= {(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)}
    return out


@pytest.mark.parametrize("shard_postings,block_terms", [(1 << 20, 1 << 20), (200, 40)])
def test_search_equals_brute_force(spark, monkeypatch, shard_postings, block_terms):
    """Ties, copies, small shards that bound each other, and items in several blocks."""
    monkeypatch.setattr(impact_search, "SHARD_POSTINGS", shard_postings)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"T{x % 60}" for x in rng.zipf(1.4, int(rng.integers(1, 80)))) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[3]) for i in range(40)]
    items = [(i, " ".join(f"t{x}," for x in rng.integers(0, 60, 6))) for i in range(25)] + [(99, "nowhere"), (98, None), (3, "t1 t1")]
    found = impact_search.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), block_terms=block_terms).collect()
    assert {tuple(r) for r in found} == ranked(docs, items)


def test_index_stops_early_and_is_exact():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    n, terms = 3000, 8
    held = [np.flatnonzero(rng.random(terms) < 0.4) for _ in range(n)]
    first = np.concatenate(([0], np.cumsum([len(h) for h in held])))
    flat, impacts = np.concatenate(held), rng.integers(1, 1000, first[-1])
    index, weights = impact_search.Index(pa.array(range(n), pa.int64()), first, flat, impacts, terms), rng.integers(1, 50, terms)
    whole = np.array([sum(weights[t] * x for t, x in zip(flat[a:b], impacts[a:b], strict=True)) for a, b in zip(first, first[1:], strict=False)])
    docs, scores = index.search(np.arange(terms), weights, 10, 1)
    assert len(docs) < n and (scores == whole[docs]).all()
    assert set(np.argsort(-whole, kind="stable")[:10]) <= set(docs.tolist())
    assert not (index.search(np.arange(terms), weights, 10, int(whole.max()) + 1)[1] > whole.max()).any()
    assert len(index.search(np.arange(terms), weights, 10, int(np.sort(whole)[-10]))[0]) <= len(docs)


def test_search_messy(spark, messy, none):
    items = messy.select("doc_id", "text", "size").withColumnRenamed("doc_id", "item_id")
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    found = impact_search.ranked(messy, items).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, [*ranked_rows(rows)]))
    assert impact_search.ranked(none, items).count() == 0 and impact_search.ranked(messy, items.limit(0)).count() == 0


def ranked_rows(rows):
    """As ranked(), but rows that repeat an id are documents each, so equal result rows can't occur but for their rank."""
    return ranked(rows, rows)


def collocations(docs, least, top, cover=50):
    f, n = {}, Counter()
    for text, lang in docs:
        for piece in re.split("[.,;:!?\n-\r]", low(text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f.setdefault(lang or "und", Counter())[tuple(words[i : i + size])] += 1
    out = set()
    for lang, counts in f.items():
        some = {w: a for w, a in counts.items() if len(w) > 1 and a >= least}
        held = {}
        for w, a in some.items():
            for part in (w[:2], w[1:]) if len(w) == 3 else ():
                held[part] = max(held.get(part, 0), a)
        rows = []
        for w, a in some.items():
            score, k = min((10**6 * a * a // (counts[w[:k]] * counts[w[k:]]), k) for k in range(1, len(w)))
            if 100 * held.get(w, 0) < cover * a or w not in held:
                rows.append((-score, -a, " ".join(w).encode(), counts[w[:k]], counts[w[k:]]))
        out |= {(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)}
    return out


@pytest.mark.parametrize("shard_words", [1 << 19, 50])
def test_phrases_equal_brute_force(spark, shard_words):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abé"), int(rng.integers(1, 3))))
    texts = [("".join(word() + str(rng.choice([" ", "  ", "\t", ", ", "\n", "! ", "\x0c"])) for _ in range(120)), str(rng.choice(["en", "es"]))) for _ in range(60)]
    texts += [("a a a a a a a a a a a a", "en"), (None, "en"), ("", None), ("A B a b A b.a b", None), ("es en es en", "en"), ("en es en es", "es"), (",,..", "fr"), ("x" * 200_000, "fr")]
    docs = spark.createDataFrame(texts, "text string, lang string").repartition(4)
    got = {tuple(r) for r in phrases.collocations(docs, least=4, top=50, shard_words=shard_words).collect()}
    assert got == collocations(texts, 4, 50) and {r[0] for r in got} >= {"en", "es"}


def test_phrases_messy(spark, messy, none):
    rows = [(r["text"], r["lang"]) for r in messy.collect()]
    got = {tuple(r) for r in phrases.collocations(messy, least=2).collect()}
    assert got == collocations(rows, 2, 2000)
    assert phrases.collocations(none).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 3, 400)
    left = np.concatenate([np.arange(n, 0, -1) for n in (150, 1, 2, 247)])
    order, lcp = phrases.suffix_array(ids, left, np.arange(400), 4)
    text = [tuple(ids[i : i + min(left[i], 4)]) for i in range(400)]
    assert sorted(order) == list(range(400)) and [text[i] for i in order] == sorted(text)
    for a, b, x in zip(order, order[1:], lcp[1:], strict=False):
        same = next((k for k, (p, q) in enumerate(zip(text[a], text[b], strict=False)) if p != q), min(len(text[a]), len(text[b])))
        assert min(x, 4) >= same and (x == same or same == min(len(text[a]), len(text[b])))
