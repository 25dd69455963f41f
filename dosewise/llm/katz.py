"""Language-model scoring by Katz backoff: n-gram counts with Good-Turing discounts and exactly normalised backoff weights, in tables that are
partitioned by context; a token takes the longest n-gram that was learned and else backs off, level by level.

Tokens stay in shards of documents. At each level a shard asks once for each of its different n-grams: the requests go to buckets by context,
a bucket adds up what all shards learned, and the answers go back to the shards, which then know all they need for the next level.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.llm.common import bound_batches, dropped, listed, mix, partitions, saved, shared_dir, steps

ORDER = 2
#: Counts up to this one are discounted, if the counts of counts allow it.
DISCOUNTED = 5
#: Tokens of a shard; a longer text is one by itself.
SHARD_TOKENS = 1 << 19
#: Requests in a bucket, about. A context that was learned more often than that is spread over the buckets by n-gram.
BUCKET_ROWS = 1 << 19

#: The hash of the end of a text, and the number of its start as a context.
END, START = np.uint64(1), 1
_STEP = np.uint64(0x9E3779B97F4A7C15)

BODY = "shard long, ids array<long>, held array<boolean>, sizes array<int>, words array<int>, vocabulary array<long>"
# Numbers are sent as planes() of 16 bits each.
REQUEST = "bucket long, shard long, spread boolean, contexts array<short>, runs array<int>, needed array<boolean>, below array<double>, keys array<short>, learned array<int>, lower array<short>"
ANSWER = "shard long, bucket long, spread boolean, counts array<short>, grams array<short>, flags array<byte>, contexts array<long>, m array<int>, low array<double>, totals array<long>"


# ---------------------------------------------------------------- shards


def _bodies(most: int):
    """Shards of about so many tokens: their documents' ids and sizes, and their words as numbers in a vocabulary of the shard."""

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, tokens = TaskContext.get().partitionId() << 32, [], 0

        def body() -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids, out, sizes = (pa.concat_arrays([h[k] for h in held]) for k in range(3))
            vocabulary, words = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True)
            columns = [ids, out, sizes, pa.array(words.astype(np.int32)), pa.array(vocabulary.view(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array([number])] + [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], ["shard", "ids", "held", "sizes", "words", "vocabulary"])

        for batch in batches:
            for t in steps(batch["text"]):
                hashes, first = t.word_hashes()
                held.append((batch["doc_id"].slice(t.first, t.n), batch["held"].slice(t.first, t.n), pa.array(np.diff(first).astype(np.int32)), hashes))
                tokens += len(hashes) + t.n
                if tokens >= most:
                    yield body()
                    held, tokens = [], 0
        if held:
            yield body()

    return form


def planes(numbers: np.ndarray) -> np.ndarray:
    """The numbers' 16-bit parts, all lowest first: the higher ones are nearly all 0, and shuffle files take no room for them."""
    return numbers.astype("<i8").view("<i2").reshape(-1, 4).T.ravel()


def unplaned(rows: pa.ChunkedArray) -> np.ndarray:
    """The numbers of all rows, one behind the other."""
    parts = [np.ascontiguousarray(x.values.to_numpy().reshape(4, -1).T).view("<i8").ravel() for x in rows if x.is_valid]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def sliced(numbers: np.ndarray, ends: np.ndarray) -> pa.Array:
    """planes() of each stretch between ends as a list."""
    return listed(np.concatenate([planes(numbers[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)] or [np.zeros(0, np.int16)]), 4 * ends, pa.int16())


def first_places(numbers: np.ndarray, n: int) -> np.ndarray:
    """Where each of the numbers below n, all of which occur, stands first."""
    out = np.empty(n, np.int64)
    out[numbers[::-1]] = np.arange(len(numbers) - 1, -1, -1)
    return out


class Level:
    """The n-grams of one length in a shard whose context was learned, each once, in the order in which requests leave and answers return."""

    def __init__(self, shard: Shard, length: int, buckets: int, common: int):
        self.at = np.flatnonzero((shard.place >= length - 2) & ((shard.context_count > 0) | (length == 1)))
        if length == 1:
            inverse, n = shard.word_no, int(shard.word_no.max()) + 1
        else:  # pairs of numbers within the shard, so that no hash stands for a pair
            unique, inverse = np.unique(shard.context_no[self.at] * (len(shard.doc) + 2) + shard.known_no[self.at], return_inverse=True)
            n = len(unique)
        first = first_places(inverse, n)
        key, context, spread = (x[self.at][first] for x in (shard.key, shard.context, shard.context_count > common))
        if length == 1:
            spread = np.ones(n, bool)
        both = mix(context.view(np.uint64) * _STEP + key.view(np.uint64))
        bucket = (np.where(spread, both, mix(context.view(np.uint64))) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket * 2 + spread, kind="stable")  # within a bucket as the shard numbers them: by context
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        self.of = back[inverse]  # the n-gram of each token
        self.keys, self.contexts, self.spread, self.bucket = key[order], context[order], spread[order], bucket[order]
        self.learned = np.bincount(self.of[shard.learned[self.at]], minlength=len(order))
        self.first = self.at[first[order]]
        new = lambda x: np.diff(x.astype(np.int64), prepend=x[:1].astype(np.int64) - 1) != 0
        block = new(self.bucket) | new(self.spread)
        self.block, self.run = np.flatnonzero(block), np.flatnonzero(block | new(self.contexts))
        self.run_of = np.repeat(np.arange(len(self.run)), np.diff(np.append(self.run, len(order))))
        #: Contexts of held-out tokens: only there an n-gram can be new.
        self.needed = np.bincount(self.run_of[self.of[~shard.learned[self.at]]], minlength=len(self.run)) > 0
        wide = np.flatnonzero(self.spread[self.run])  # a spread context is asked for once, whatever the buckets that it is in
        self.needed[wide] = False
        self.needed[wide[np.unique(self.contexts[self.run[wide]], return_index=True)[1]]] = True

    def requests(self, shard: Shard) -> pa.Table:
        """A row for each bucket, and one more for its spread contexts. Of the level below go the n-gram's count, and what its context divides it by."""
        ends = np.append(self.block, len(self.keys))
        at = np.searchsorted(self.run, ends)
        return pa.table(
            {
                "bucket": pa.array(self.bucket[self.block]), "shard": pa.array(np.full(len(self.block), shard.number)), "spread": pa.array(self.spread[self.block]),
                "contexts": sliced(self.contexts[self.run], at), "runs": listed(np.diff(np.append(self.run, len(self.keys))).astype(np.int32), at, pa.int32()),
                "needed": listed(self.needed, at, pa.bool_()), "below": listed(shard.divisor_below[self.first[self.run]], at, pa.float64()),
                "keys": sliced(self.keys, ends), "learned": listed(self.learned.astype(np.int32), ends, pa.int32()), "lower": sliced(shard.count_below[self.first], ends),
            }
        )


class Shard:
    """A shard's tokens with, level by level, their n-grams, counts and probabilities."""

    def __init__(self, body: pa.Table):
        column = lambda c: body[c].combine_chunks().flatten()
        self.number = body["shard"][0].as_py()
        self.ids, self.held, sizes = column("ids"), column("held").to_numpy(zero_copy_only=False).astype(bool), column("sizes").to_numpy().astype(np.int64)
        self.sizes = sizes + 1
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        ends = np.cumsum(self.sizes)
        self.place = np.arange(len(self.doc)) - (ends - self.sizes)[self.doc]
        self.token = np.full(len(self.doc), END, np.uint64)
        words = np.ones(len(self.doc), bool)
        words[ends - 1] = False
        vocabulary = column("vocabulary").to_numpy().view(np.uint64)
        self.word_no = np.full(len(self.doc), len(vocabulary))
        self.word_no[words] = column("words").to_numpy()
        self.token[words] = vocabulary[self.word_no[words]]
        self.learned = ~self.held[self.doc]
        # numbers of the n-grams that end at each token: hashes of words at first, then as the level below has numbered them; 0 is none that was learned
        self.key, self.context = self.token.view(np.int64), np.zeros(len(self.doc), np.int64)
        self.gram, self.gram_no = self.key, self.word_no
        self.count, self.context_count = np.zeros(len(self.doc), np.int64), np.zeros(len(self.doc), np.int64)
        self.p, self.divisor = np.ones(len(self.doc)), np.ones(len(self.doc))
        self.count_below, self.divisor_below = self.count, self.divisor

    def longer(self) -> None:
        """From n-grams to those of one token more; what stands before a text's first token is START."""
        self.count_below, self.divisor_below = self.count, self.divisor
        counts, context = np.roll(self.count, 1), np.roll(self.gram, 1)
        counts[self.place == 0] = self.ends_learned
        context[self.place == 0] = START
        self.context, self.context_count, self.key = context, counts, self.word
        self.context_no = np.roll(self.gram_no, 1)
        self.context_no[self.place == 0] = len(self.doc)

    def answered(self, level: Level, length: int, model: Model, answers: pa.Table) -> None:
        """Counts and probabilities of this level, from the buckets' answers."""
        told = answers.filter(pa.compute.is_valid(answers["counts"])).sort_by([("bucket", "ascending"), ("spread", "ascending")])
        counts, gram = np.zeros(len(self.doc), np.int64), np.zeros(len(self.doc), np.int64)
        counts[level.at] = unplaned(told["counts"])[level.of]
        if len(grams := unplaned(told["grams"])):
            gram[level.at] = grams[level.of]
        self.count, self.gram = counts, gram
        if length > 1:
            self.gram_no = np.zeros(len(self.doc), np.int64)
            self.gram_no[level.at] = level.of
        discounts = model.discounts[length - 1]
        if length == 1:
            self.known, self.ends_learned = counts > 0, int(counts[np.flatnonzero(self.token == END)[0]])
            self.base_count, self.word = counts, gram
            self.known_no = np.where(counts > 0, self.word_no, len(self.doc))
            self.divisor = np.full(len(counts), float(model.all_tokens))
            self.p = np.where(counts > 0, discounted(counts, discounts) / model.all_tokens, model.unknown)
            return
        # of each context: which low counts its n-grams have; and if it is needed, how many of each, and what probability the level below gives them
        runs = level.contexts[level.run]
        m, low, flags = np.zeros((len(runs), DISCOUNTED)), np.zeros(len(runs)), np.zeros(len(runs), np.int64)
        plain = ~level.spread[level.run]
        own = told.filter(pa.compute.invert(told["spread"]))
        if len(own):
            flags[plain] = own["flags"].combine_chunks().flatten().to_numpy()
            m[plain & level.needed] = own["m"].combine_chunks().flatten().to_numpy().reshape(-1, DISCOUNTED)
            low[plain & level.needed] = own["low"].combine_chunks().flatten().to_numpy()
        wide = answers.filter(pa.compute.is_null(answers["counts"]))
        if len(wide):
            contexts = wide["contexts"].combine_chunks().flatten().to_numpy()
            order = np.argsort(contexts)
            place = order[np.searchsorted(contexts[order], runs[~plain])]
            m[~plain] = wide["m"].combine_chunks().flatten().to_numpy().reshape(-1, DISCOUNTED)[place]
            low[~plain] = wide["low"].combine_chunks().flatten().to_numpy()[place]
            flags[~plain] = (m[~plain] > 0) @ (1 << np.arange(DISCOUNTED))
        # nothing to spare: no n-gram of the context has a count that is discounted
        none = (flags & int((discounts < 1) @ (1 << np.arange(DISCOUNTED)))) == 0
        context_of = level.run_of
        at, context = level.at, context_of[level.of]
        seen_context, c = self.context_count[at], counts[at]
        spare = (m * (1 - discounts) * np.arange(1, DISCOUNTED + 1)).sum(axis=1)[context]
        all_ = seen_context + none[context]  # a context that no discount leaves anything holds one unseen token more
        self.divisor = np.ones(len(self.doc))
        self.divisor[at] = all_
        backed = np.where(none[context], 1, spare) / all_ / np.maximum(1 - low[context], np.finfo(float).tiny)
        self.p[at] = np.where(c > 0, discounted(c, discounts) / all_, backed * self.p[at])

    def scores(self, model: Model) -> pa.Table:
        n = len(self.sizes)
        base = np.log10((self.base_count + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
        sums = [np.bincount(self.doc, x, n) for x in (base, np.log10(self.p))]
        return pa.table({"doc_id": self.ids, "held_out": pa.array(self.held), "n_tokens": pa.array(self.sizes), "n_known": pa.array(np.bincount(self.doc, self.known, n).astype(np.int64)), "train_tokens": pa.array(np.full(n, model.tokens)), "base_score": pa.array(sums[0]), "score": pa.array(sums[1])})


# ---------------------------------------------------------------- model


def good_turing(counts: list[int], most: int = DISCOUNTED) -> np.ndarray:
    """Katz's discounts of counts 1 to `most` from the numbers of n-grams that occur once, twice and so on (one number more).

    Where these give no discount between 0 and 1 for some count, only counts up to a smaller limit are discounted, the largest that works."""
    n = np.array([0, *counts], float)
    for k in range(most, 0, -1):
        if (n[1 : k + 2] > 0).all():
            r = np.arange(1, k + 1)
            beyond = (k + 1) * n[k + 1] / n[1]
            d = ((r + 1) * n[r + 1] / (r * n[r]) - beyond) / (1 - beyond) if beyond < 1 else np.zeros(k)
            if ((d > 0) & (d < 1)).all():
                return np.append(d, np.ones(most - k))
    return np.ones(most)


def discounted(counts: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    return counts * np.append(np.append(1.0, discounts), 1.0)[np.minimum(counts, len(discounts) + 1)]


class Model:
    """Numbers of the whole learned corpus: tokens, types, and the discounts of each level so far."""

    def __init__(self, tokens: int = 0, types: int = 0):
        self.tokens, self.types, self.discounts, self.all_tokens, self.unknown = tokens, types, [], 1.0, 1.0

    def learn(self, totals: list[int]) -> Model:
        """totals: n-grams and tokens, then how many n-grams occur once, twice and so on."""
        if not self.discounts:
            self.types, self.tokens = totals[:2]
        self.discounts.append(good_turing(totals[2:]))
        if len(self.discounts) == 1:
            spare = float((np.array(totals[2 : 2 + DISCOUNTED]) * np.arange(1, DISCOUNTED + 1) * (1 - self.discounts[0])).sum())
            self.all_tokens = self.tokens + (spare == 0)
            self.unknown = (spare or 1) / self.all_tokens
        return self


def _merge(length: int, buckets: int, last: bool, below: np.ndarray | None):
    """Adds up what a bucket's shards learned, and answers each: whole counts, and the numbers by which the next level names n-grams, small ones for frequent
    n-grams; for contexts that are wholly in this bucket which low counts there are, and where that is needed how many n-grams have each and what probability
    the level below gives to all; of spread contexts a row each for Spark to add up. below: the discounts of that level."""

    def merge(asked: pa.Table) -> pa.Table:
        column = lambda c: asked[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        keys, every, runs = unplaned(asked["keys"]), unplaned(asked["contexts"]), column("runs")
        contexts, of_run = np.unique(every, return_inverse=True)
        if len(contexts) > 1:
            key = keys if keys.max() < 1 << 32 else np.unique(keys, return_inverse=True)[1]
            unique, inverse = np.unique(np.repeat(of_run, runs) << 32 | key, return_inverse=True)
        else:
            unique, inverse = np.unique(keys, return_inverse=True)
        first = first_places(inverse, len(unique))
        counts = np.bincount(inverse, column("learned"), len(first)).astype(np.int64)
        context, seen = np.repeat(of_run, runs)[first], counts > 0
        few = seen & (counts <= DISCOUNTED)
        m = np.bincount(context[few] * DISCOUNTED + counts[few] - 1, minlength=len(contexts) * DISCOUNTED).reshape(-1, DISCOUNTED)
        low, grams = np.zeros(len(contexts)), np.zeros(0, np.int64)
        if length > 1:
            p = discounted(unplaned(asked["lower"])[first], below) / np.repeat(column("below"), runs)[first]
            low = np.bincount(context[seen], p[seen], len(contexts))
        at, run_at = (np.concatenate(([0], np.cumsum(pa.compute.list_value_length(asked[c]).to_numpy(zero_copy_only=False) // of))) for c, of in (("keys", 4), ("runs", 1)))
        if not last:
            rank = np.empty(len(first), np.int64)
            rank[np.lexsort((keys[first], -counts))] = np.arange(len(first))
            grams = np.where(seen, rank * buckets + asked["bucket"][0].as_py() + 2, 0)[inverse]
        spread = np.repeat(column_of(asked["spread"]), np.diff(run_at)) | (length == 1)
        wide, own = spread & (length > 1), ~spread
        needed, asks = own & column("needed").astype(bool), wide & column("needed").astype(bool)
        upto = lambda chosen: np.concatenate(([0], np.cumsum(chosen)))[run_at]
        flags = ((m > 0) @ (1 << np.arange(DISCOUNTED)))[of_run[own]].astype(np.int8)
        out = [
            pa.table({"shard": asked["shard"], "bucket": asked["bucket"], "spread": asked["spread"], "counts": sliced(counts[inverse], at), "grams": sliced(grams, at if len(grams) else at * 0),
                      "flags": listed(flags, upto(own), pa.int8()), "contexts": listed(every[asks], upto(asks), pa.int64()),
                      "m": listed(m[of_run[needed]].ravel(), upto(needed) * DISCOUNTED, pa.int32()), "low": listed(low[of_run[needed]], upto(needed), pa.float64()), "totals": pa.nulls(len(asked), pa.list_(pa.int64()))})
        ]
        schema, held = out[0].schema, np.unique(of_run[wide])
        rest = lambda n, **given: pa.table([given[c] if c in given else pa.nulls(n, schema.field(c).type) for c in schema.names], schema=schema)
        each = np.arange(len(held) + 1)
        out.append(rest(len(held), contexts=listed(contexts[held], each, pa.int64()), m=listed(m[held].ravel(), each * DISCOUNTED, pa.int32()), low=listed(low[held], each, pa.float64())))
        totals = [int(seen.sum()), int(counts.sum()), *(int(x) for x in np.bincount(counts[seen & (counts <= DISCOUNTED + 1)], minlength=DISCOUNTED + 2)[1:])]
        out.append(rest(1, totals=pa.array([totals], pa.list_(pa.int64()))))
        return pa.concat_tables(out)

    return merge


def column_of(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(bool)


def _totals(answers: DataFrame) -> list[int]:
    """One row: the sums of the buckets' totals."""
    row = answers.where("totals is not null").agg(*[F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)) for i in range(DISCOUNTED + 3)]).first()
    return [int(x) for x in row]


def _wide(answers: DataFrame) -> DataFrame:
    """The numbers of spread contexts, added up over buckets, for each shard that asked."""
    parts = answers.where("shard is null and contexts is not null").select(F.col("contexts")[0].alias("context"), *[F.col("m")[i].alias(f"m{i}") for i in range(DISCOUNTED)], F.col("low")[0].alias("low"))
    sums = parts.groupBy("context").agg(*[F.sum(f"m{i}").cast("int").alias(f"m{i}") for i in range(DISCOUNTED)], F.sum("low").alias("low"))
    asked = answers.where("shard is not null and size(contexts) > 0").select("shard", F.explode("contexts").alias("context")).distinct()
    none = F.lit(None)
    return asked.join(sums, "context").select("shard", none.cast("long").alias("bucket"), F.lit(True).alias("spread"), none.cast("array<short>").alias("counts"), none.cast("array<short>").alias("grams"), none.cast("array<byte>").alias("flags"), F.array("context").alias("contexts"), F.array(*[f"m{i}" for i in range(DISCOUNTED)]).alias("m"), F.array("low").alias("low"), none.cast("array<long>").alias("totals"))


def scored(documents: DataFrame, held_out, order: int = ORDER, id: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row for each document, learned from those for which held_out is false.

    Tokens are runs without space or \\t-\\r, A-Z lower-cased, and one end of text. `score` is the log10 probability of all tokens under the
    Katz model of this order: an n-gram that was learned has its discounted share of its context; others have the context's spare share, in
    proportion to the level below, whose probabilities of all tokens not learned after the context add up to the divisor. Below single
    tokens the spare share goes to one unknown token, as which all tokens count that were not learned. A context in which nothing is discounted,
    for all its counts are high, counts one unseen token more. A text's first tokens have the start of the text as context.
    `base_score` is that of single tokens with 0.1 added to each count. Tokens and contexts are compared by 64-bit hashes.

    Null texts are empty and have the end alone; documents for which held_out is null are held out; repeated rows and ids are documents each; other
    columns are not read; without learned documents every score is 0; without documents there are no rows. Work and shuffles grow with the whole input.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    docs = documents.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(True)).alias("held"))
    name, model = f"katz_{uuid.uuid4().hex}", Model()
    path = f"{shared_dir(spark)}/{name}"
    # dealt out by shard once, so that no join by shard moves the tokens again
    docs.mapInArrow(_bodies(shard_tokens), BODY).write.bucketBy(partitions(spark), "shard").option("path", path).option("maxRecordsPerFile", 8).format("parquet").saveAsTable(name)
    bodies = spark.table(name)
    n_tokens, n_words = (int(x or 0) for x in bodies.agg(F.sum(F.size("words") + F.size("sizes")), F.sum(F.size("vocabulary") + 1)).first())
    levels: list[DataFrame] = []
    for length in range(1, order + 1):
        buckets = max(1, -(-(n_words if length == 1 else n_tokens) // bucket_rows))
        work = _asker(length, model, buckets, bucket_rows)
        if length == 1:
            asked = bodies.mapInArrow(lambda batches, work=work: _each(batches, work), REQUEST)
        else:
            asked = _with_answers(bodies, levels, work, REQUEST)
        levels.append(saved(asked.groupBy("bucket").applyInArrow(_merge(length, buckets, length == order, model.discounts[-1] if model.discounts else None), ANSWER), f"katz-{length}"))
        model.learn(_totals(levels[-1]))
    out = saved(_with_answers(bodies, levels, _asker(order + 1, model, 1, 0), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "katz-scores")
    spark.sql(f"DROP TABLE {name}")
    bodies.saved_at = path
    dropped(bodies, *levels)
    return out


def _each(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield from work(pa.Table.from_batches([batch.slice(i, 1)]), None).to_batches()


def _with_answers(bodies: DataFrame, levels: list[DataFrame], work, schema: str) -> DataFrame:
    """work over each shard with all answers to it so far; an answer has its level in the column `length`."""
    parts = [(level if i == 0 else level.where("shard is not null").union(_wide(level))).where("shard is not null").select("*", F.lit(i + 1).alias("length")) for i, level in enumerate(levels)]
    answers = reduce(DataFrame.union, parts).drop("totals")
    return bodies.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(lambda body, told: work(body, told), schema)


def _asker(length: int, model: Model, buckets: int, common: int):
    """The requests of n-grams of this length, or the scores behind the last."""
    discounts, sizes = list(model.discounts), _sizes(model, buckets, common)

    def work(body: pa.Table, told: pa.Table | None) -> pa.Table:
        shard = Shard(body)
        for k in range(1, length):
            if k > 1:
                shard.longer()
            shard.answered(Level(shard, k, *sizes[k - 1]), k, model_at, told.filter(pa.compute.equal(told["length"], k)))
        if length > len(sizes):
            return shard.scores(model_at)
        if length > 1:
            shard.longer()
        return Level(shard, length, *sizes[length - 1]).requests(shard)

    model_at = Model(model.tokens, model.types)
    model_at.discounts, model_at.all_tokens, model_at.unknown = discounts, model.all_tokens, model.unknown
    return work


def _sizes(model: Model, buckets: int, common: int) -> list[tuple[int, int]]:
    """(buckets, common) of each level asked so far, and of the next."""
    known = getattr(model, "sizes", [])
    if common:
        known = known + [(buckets, common)]
        model.sizes = known
    return list(known)
