"""Katz backoff against a plain version over dictionaries of word tuples."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dosewise.llm import katz, queries

def held():
    return F.crc32(F.col("doc_id").cast("string")) % 10 == 0
WORD = re.compile(r"[^ \t-\r]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def discounts(counts):
    n = Counter(counts.values())
    for k in range(5, 0, -1):
        if all(n[r] for r in range(1, k + 2)):
            a = (k + 1) * n[k + 1] / n[1]
            if a < 1:
                d = {r: ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) for r in range(1, k + 1)}
                if all(0 < x < 1 for x in d.values()):
                    return d
    return {}


class Brute:
    def __init__(self, texts, order):
        self.order, self.counts = order, [Counter() for _ in range(order)]
        for text in texts:
            tokens = ["<s>", *WORD.findall(low(text)), "</s>"]
            for i in range(1, len(tokens)):
                for n in range(1, order + 1):
                    if i - n + 1 >= 0:
                        self.counts[n - 1][tuple(tokens[i - n + 1 : i + 1])] += 1
        self.d = [discounts(c) for c in self.counts]
        self.after = defaultdict(dict)
        for c in self.counts:
            for gram, x in c.items():
                self.after[gram[:-1]][gram[-1]] = x
        self.rest = {}
        self.spares = {}
        self.tokens, self.types = sum(self.counts[0].values()), len(self.counts[0])

    def spare(self, context):
        if context not in self.spares:
            self.spares[context] = self.spare_of(context)
        return self.spares[context]

    def spare_of(self, context):
        d, seen = self.d[len(context)], self.after[context]
        all_ = sum(seen.values())
        left = sum(x * (1 - d.get(x, 1)) for x in seen.values())
        return (left / all_, all_) if left else (1 / (all_ + 1), all_ + 1)

    def p(self, context, w):
        seen, d = self.after.get(context, {}), self.d[len(context)]
        if not context:
            spare, all_ = self.spare(())
            return d.get(seen.get(w), 1) * seen[w] / all_ if w in seen else spare
        if not seen:
            return self.p(context[1:], w)
        spare, all_ = self.spare(context)
        if w in seen:
            return d.get(seen[w], 1) * seen[w] / all_
        if context not in self.rest:
            self.rest[context] = 1 - sum(self.p(context[1:], x) for x in seen)
        return spare * self.p(context[1:], w) / self.rest[context]

    def score(self, text):
        tokens = ["<s>", *WORD.findall(low(text)), "</s>"]
        ps = [math.log10(self.p(tuple(tokens[max(0, i - self.order + 1) : i]), tokens[i])) for i in range(1, len(tokens))]
        base = [math.log10((self.counts[0][(w,)] + 0.1) / (self.tokens + 0.1 * (self.types + 1))) for w in tokens[1:]]
        return len(tokens) - 1, sum(self.counts[0][(w,)] > 0 for w in tokens[1:]), sum(base), sum(ps)


def learned(id_):
    return id_ is not None and zlib.crc32(str(id_).encode()) % 10 != 0


def compare(rows, found, order):
    """rows: (doc_id, text), each id once."""
    model = Brute([t for i, t in rows if learned(i)], order)
    found = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows)
    cache = {}
    for i, t in rows:
        want = cache.setdefault(t, None) or model.score(t)
        cache[t] = want
        r = found[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not learned(i), want[0], want[1], model.tokens)
        assert r["base_score"] == pytest.approx(want[2], rel=1e-9, abs=1e-9)
        assert r["score"] == pytest.approx(want[3], rel=1e-7, abs=1e-7)
    return model


def words(n, seed):
    import random

    rng = random.Random(seed)
    return " ".join(f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    texts = [words(n, n) for n in range(5, 180, 2)] + [None, "", " \n", "One one ONE", words(3000, 1), "Été été", words(90, 3), words(90, 3)]
    return list(enumerate(texts))


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("shard_tokens,bucket_rows", [(1 << 20, 1 << 20), (300, 64)])
def test_equals_brute_force(spark, rows, order, shard_tokens, bucket_rows):
    """Small shards and buckets spread the common contexts over several buckets."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = katz.scored(docs, held(), order=order, shard_tokens=shard_tokens, bucket_rows=bucket_rows).collect()
    model = compare(rows, found, order)
    if order > 1 and bucket_rows == 64:
        assert max(Counter(g[0] for g in model.counts[1].elements()).values()) > 64
        assert model.d[1]


def test_probabilities_add_up(rows):
    """All learned tokens and the unknown one, after contexts learned and not."""
    model = Brute([t for i, t in rows if learned(i)], 3)
    vocabulary = [w for (w,) in model.counts[0]] + ["never learned"]
    contexts = [(), ("w1",), ("w1", "w2"), ("<s>",), ("<s>", "w1"), ("w7", "w3"), ("nowhere", "w1"), ("w1", "nowhere")]
    for context in contexts:
        assert sum(model.p(context, w) for w in vocabulary) == pytest.approx(1, abs=1e-9)


def test_query(spark, tiny, texts):
    found = queries.op12_katz_score(spark, tiny).collect()
    compare(sorted(texts.items()), found, katz.ORDER)
    out = [r for r in found if r["held_out"]]
    assert out and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_messy(spark, messy, none):
    found = katz.scored(messy, held()).collect()
    assert len(found) == messy.count()
    by = defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r)
    assert by[3][0]["n_tokens"] == by[4][0]["n_tokens"] == by[5][0]["n_tokens"] == 1
    assert [r["n_tokens"] for r in by[12]] == [60_001] and len(by[None]) == 2 and all(r["held_out"] for r in by[None])
    assert by[1][0] == by[1][1]
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in found)
    assert katz.scored(none, held()).count() == 0
    alone = katz.scored(messy, F.lit(True)).collect()
    assert len(alone) == len(found) and all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in alone)
