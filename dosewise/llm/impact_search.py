"""Ranked lexical search, score at a time: each shard of documents groups its postings by exact impact, an item's groups are processed in the
order of what they add to a score until the remaining bounds prove the top k, and the scores of the documents left are completed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dosewise.llm.common import bound_batches, listed, lowered, marked, saved, span_hashes, steps

#: Terms are runs of digits, ASCII letters and all bytes of other characters.
BETWEEN = marked(bytes(x for x in range(128) if not chr(x).isalnum()))
#: Postings of one shard's index.
SHARD_POSTINGS = 1 << 20
#: (item, term) pairs of one block of items, which all tasks get; more items are searched in several passes.
BLOCK_TERMS = 1 << 20
#: Groups of equal impact between two tests for the end.
ROUND_GROUPS = 64
#: Parts in which an item's hits are ranked before the best of them are ranked together.
RANK_PARTS = 64


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, hashes of all terms, where each text's terms begin) for steps of texts that begin at the row; a null has none."""
    for t in steps(column):
        starts, ends, first = t.words(BETWEEN)
        yield t.first, span_hashes(lowered(t.buf), starts, ends), first


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, hashes, first in _terms(batch["text"]):
            of = np.repeat(np.arange(len(first) - 1), np.diff(first)) + row
            yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(of)), pa.array(hashes.view(np.int64))], ["item_id", "hash"])


def _postings(terms):
    """Of each document its number of terms, and which of the asked terms it holds how often."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = terms.value
        for batch in batches:
            for row, hashes, first in _terms(batch["text"]):
                sizes = np.diff(first)
                of = np.repeat(np.arange(len(sizes)), sizes)
                place = np.minimum(np.searchsorted(asked, hashes), len(asked) - 1)
                hit = asked[place] == hashes
                key, tf = np.unique(of[hit] * len(asked) + place[hit], return_counts=True)
                at = np.searchsorted(key, np.arange(len(sizes) + 1) * len(asked))
                out = pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(row, len(sizes)), pa.array(sizes.astype(np.int64)), listed(key % len(asked), at, pa.int32()), listed(tf, at, pa.int64())], ["doc_id", "n", "terms", "tf"]
                )
                yield out.filter(pa.array(sizes > 0))

    return scan


def _holders(n_terms: int):
    """How many of a task's documents hold each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch["terms"].flatten().to_numpy(), minlength=n_terms)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df).astype(np.int32)), pa.array(df[df > 0])], ["term", "df"])

    return count


class Index:
    """A shard: for each term its postings grouped by exact impact, largest first, and each document's own terms and impacts."""

    def __init__(self, ids: pa.Array, first: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.ids, self.first, self.terms, self.impacts = ids, first, terms, impacts
        self.id = ids.fill_null(0).to_numpy().astype(np.int64)
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        docs = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.lexsort((docs, -impacts, terms))
        self.docs = docs[order]
        term, impact = terms[order], impacts[order]
        self.begin = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(impact, prepend=-1) != 0))
        self.end = np.append(self.begin[1:], len(order)).astype(np.int64)
        self.group_impact = impact[self.begin]
        #: Groups of term t are group_first[t] to group_first[t + 1].
        self.group_first = np.searchsorted(term[self.begin], np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): all of the k best whose score is `least` or more, and perhaps others; weights are by term."""
        groups = [np.arange(self.group_first[t], self.group_first[t + 1]) for t in terms]
        adds = [weights[t] * self.group_impact[g] for t, g in zip(terms, groups, strict=True)]
        falls = [a - np.append(a[1:], 0) for a in adds if len(a)]  # how far a term's bound falls behind each group
        if not falls:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        group, add, fall = np.concatenate(groups), np.concatenate(adds), np.concatenate(falls)
        order = np.argsort(-add, kind="stable")
        group, add = group[order], add[order]
        bound = np.concatenate(([0], np.cumsum(fall[order])))
        bound = bound[-1] - bound  # what a document can still get before each group, and behind the last
        score, done, size = np.zeros(len(self.id), np.int64), 0, ROUND_GROUPS
        while True:
            if bound[done] < least:
                break  # a document not met yet can't reach the top
            if done == len(group):
                break
            stop = min(done + size, len(group), max(done + 1, int(np.searchsorted(-bound, -least, "right"))))
            begin, sizes = self.begin[group[done:stop]], self.end[group[done:stop]] - self.begin[group[done:stop]]
            at = np.repeat(begin - np.concatenate(([0], np.cumsum(sizes[:-1]))), sizes) + np.arange(sizes.sum())
            score += np.bincount(self.docs[at], np.repeat(add[done:stop], sizes), len(score)).astype(np.int64)
            done, size = stop, 2 * size
            if len(score) > k:
                least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
        left = np.flatnonzero((score > 0) & (score + bound[done] >= least))
        return left, self.completed(left, terms, weights)

    def completed(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of the documents, from their own terms."""
        of = np.zeros(len(weights), np.int64)
        of[terms] = weights[terms]
        sizes = self.first[docs + 1] - self.first[docs]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.first[docs] - ends[:-1], sizes) + np.arange(ends[-1])
        sums = np.concatenate(([0], np.cumsum(of[self.terms[at]] * self.impacts[at])))
        return sums[ends[1:]] - sums[ends[:-1]]


def _indexes(batches: Iterator[pa.RecordBatch], n: int, length: int, n_terms: int) -> Iterator[Index]:
    held, postings = [], 0

    def index() -> Index:
        table = pa.Table.from_batches(held).combine_chunks()
        terms, tf = (table[c].chunk(0) if table[c].num_chunks else pa.array([], table[c].type) for c in ("terms", "tf"))
        first = terms.offsets.to_numpy().astype(np.int64)
        tf, size = tf.flatten().to_numpy(), np.repeat(table["n"].to_numpy(), np.diff(first))
        impacts = 1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * size * n // length))
        return Index(table["doc_id"].combine_chunks(), first - first[0], terms.flatten().to_numpy().astype(np.int64), impacts, n_terms)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            postings += len(batch["terms"].flatten())
        if postings >= SHARD_POSTINGS:
            yield index()
            held, postings = [], 0
    if held:
        yield index()


def _search(items, k: int, n: int, length: int):
    """A task's best k documents of every item; what is found in one shard bounds the search of the next."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = items.value
        best: list[list[tuple[int, bool, int]]] = [[] for _ in asked]
        for index in _indexes(batches, n, length, len(weights)):
            for i, terms in enumerate(asked):
                least = -best[i][-1][0] if len(best[i]) == k else 1
                docs, scores = index.search(terms, weights, k, least)
                some = docs[np.lexsort((index.id[docs], index.no_id[docs], -scores))][:k]
                found = dict(zip(docs.tolist(), scores.tolist(), strict=True))
                best[i] = sorted(best[i] + [(-found[d], bool(index.no_id[d]), int(index.id[d])) for d in some.tolist() if found[d] > 0])[:k]
        rows = [(i, None if no_id else d, -s) for i, some in enumerate(best) for s, no_id, d in some]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return search


def ranked(documents: DataFrame, items: DataFrame, k: int = 10, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents that score highest above 0, equal ones by ascending id.

    Terms, weights, impacts and scores are whole numbers as `op11_impact_search` states them; the search is exact. Documents stay where they
    are: a task indexes its own in shards, and only its k best of each item are shuffled. Items go to all tasks, in blocks of a
    bounded number of terms. Terms are compared by 64-bit hashes.
    Null texts have no terms, and documents without a term count nowhere. Documents without an id are found too, behind others of the same score;
    rows that repeat an id are documents each. Rows of one item_id (null is one) are one item. Other columns are not read; without documents or items there are no rows.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(_item_terms, "item_id long, hash long").distinct()
    asked = saved(asked, "asked")
    blocks = max(1, -(-asked.count() // block_terms))
    docs = documents.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = None
    for block in range(blocks):
        hits = _block(docs, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block), k)
        found = hits if found is None else found.union(hits)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(RANK_PARTS))).withColumn("rank", F.row_number().over(W.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    pairs = asked.toArrow()  # at most a block's terms, or one item's
    item_ids = pairs["item_id"].unique()
    item_of = pairs["item_id"].dictionary_encode(null_encoding="encode").combine_chunks().indices.to_numpy() if len(pairs) else np.zeros(0, np.int64)
    hashes = pairs["hash"].to_numpy().view(np.uint64)
    terms, term_of = np.unique(hashes, return_inverse=True)
    if not len(terms):
        return spark.createDataFrame([], "item_id long, doc_id long, score long")
    known = spark.sparkContext.broadcast(terms)
    postings = saved(docs.mapInArrow(_postings(known), "doc_id long, n long, terms array<int>, tf array<long>"), "postings")
    n, length = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    for row in postings.select("terms").mapInArrow(_holders(len(terms)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # one for each asked term
        df[row["term"]] = row["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    used = (df > 0) & (weights > 0)
    of = [np.sort(term_of[(item_of == i) & used[term_of]]) for i in range(len(item_ids))]
    told = spark.sparkContext.broadcast((of, weights))
    hits = postings.mapInArrow(_search(told, k, n, length), "item int, doc_id long, score long")
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(item_ids)), pa.int32()), "item_id": item_ids.cast(pa.int64())}))
    return hits.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")
