"""Benchmark decontamination by spaced-seed hashing: masks that ignore fixed word positions, then checked overlaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.llm.common import bound_batches, hash_filter, listed, may_hold, mix, saved, small_or_shuffled, steps

#: Word positions that each mask reads. With WINDOW and SAME, any overlap that counts holds a clear hit of one of them.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 5, 6))
#: An overlap counts if this share of the words of a window is the same; a shorter item is one window.
WINDOW, SAME = 20, 0.85
#: Items with fewer words match only as a whole, word for word: one seed reads them all.
LEAST_WORDS = 10
#: Of a run of equal seeds, which a repeated word makes, so many places at both ends propose all shifts that an overlap can have.
RUN_ENDS = 4


def _ends_of_runs(h: np.ndarray, cuts: np.ndarray | None = None) -> np.ndarray:
    """Where a seed is one of the first or last RUN_ENDS of its run of equal ones; no run goes across the cuts."""
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    if cuts is not None:
        first[cuts[(cuts >= 0) & (cuts < len(h))]] = True
    new = np.flatnonzero(first)
    start = np.repeat(new, np.diff(np.append(new, len(h))))
    stop = np.repeat(np.append(new[1:], len(h)), np.diff(np.append(new, len(h))))
    at = np.arange(len(h))
    return (at - start < RUN_ENDS) | (stop - at <= RUN_ENDS)


def whole_masks(lengths: list[int]) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(range(n)) for n in lengths)


def seeds(words: np.ndarray, masks=MASKS) -> Iterator[np.ndarray]:
    """For each mask, a hash at every position where it fits."""
    for mask in masks:
        n = max(0, len(words) - mask[-1])
        h = np.full(n, sum(1 << p for p in mask), np.uint64)
        for p in mask:
            h = h * np.uint64(0x9FB21C651E98DF25) + words[p : p + n]
            h ^= h >> np.uint64(29)
        yield mix(h)


def least_same(n: int | np.ndarray, window: int = WINDOW, same: float = SAME):
    """Words that must be the same in a window of an item of n words: all of a short item's."""
    return np.where(np.asarray(n) < LEAST_WORDS, n, np.ceil(np.minimum(n, window) * same - 1e-9)).astype(np.int64)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, at, hashes, words, i = [], [], [], [], -1
        for t in steps(batch["text"]):
            w, first = t.word_hashes()
            for k in range(t.n):
                i += 1
                mine = w[first[k] : first[k + 1]]
                ids.append(batch["item_id"][i].as_py())
                words.append(mine.view(np.int64))
                found = list(seeds(mine) if len(mine) >= LEAST_WORDS else seeds(mine, whole_masks([len(mine)]))) if len(mine) else []
                kept = [np.flatnonzero(_ends_of_runs(f)) for f in found]
                hashes.append(np.concatenate([f[k] for f, k in zip(found, kept, strict=True)]).view(np.int64) if found else np.zeros(0, np.int64))
                at.append(np.concatenate(kept) if found else np.zeros(0, np.int64))
        ends = np.concatenate(([0], np.cumsum([len(h) for h in hashes])))
        none = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), listed(np.concatenate([none, *words]), np.concatenate(([0], np.cumsum([len(w) for w in words]))), pa.int64()), listed(np.concatenate([none, *at]), ends, pa.int32()), listed(np.concatenate([none, *hashes]), ends, pa.int64())],
            ["item_id", "words", "at", "hashes"],
        )


def _regions(bits: np.ndarray, masks: tuple[tuple[int, ...], ...]):
    """Stretches of documents around possible hits: words with a window on both sides, and each hit's place and hash."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = WINDOW + max(m[-1] for m in masks)
        for batch in batches:
            row = 0
            for t in steps(batch["text"]):
                words, first = t.word_hashes()
                places, hashes = [], []
                for mask, h in zip(masks, seeds(words, masks), strict=True):
                    hit = np.flatnonzero(may_hold(bits, h))
                    if len(hit):  # a text's own seeds begin with it and end a mask before the next
                        hit = hit[_ends_of_runs(h, np.concatenate((first, first - mask[-1])))[hit]]
                    places.append(hit)
                    hashes.append(h[hit])
                place, hash_ = np.concatenate(places), np.concatenate(hashes)
                row += t.n
                if not len(place):
                    continue
                order = np.argsort(place, kind="stable")
                place, hash_ = place[order], hash_[order]
                doc = np.searchsorted(first, place, "right") - 1
                new = np.flatnonzero(np.diff(place, prepend=-(1 << 60)) > reach)
                new = np.union1d(new, np.flatnonzero(np.diff(doc, prepend=-1))).astype(np.int64)
                out = []
                for a, b in zip(new, np.append(new[1:], len(place)), strict=True):
                    d = doc[a]
                    start, stop = max(first[d], place[a] - reach), min(first[d + 1], place[b - 1] + 2 * reach)
                    out.append((row - t.n + d, int(start - first[d]), words[start:stop].view(np.int64), (place[a:b] - start).astype(np.int32), hash_[a:b].view(np.int64)))
                at = np.concatenate(([0], np.cumsum([len(o[3]) for o in out])))
                ends = np.concatenate(([0], np.cumsum([len(o[2]) for o in out])))
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].take(pa.array([o[0] for o in out])), pa.array([o[1] for o in out], pa.int64()), listed(np.concatenate([o[2] for o in out]), ends, pa.int64()), listed(np.concatenate([o[3] for o in out]), at, pa.int32()), listed(np.concatenate([o[4] for o in out]), at, pa.int64())],
                    ["id", "start", "words", "at", "hashes"],
                )

    return scan


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Most words that are the same in a window of the item laid at doc[shift:], where it starts in the doc, and its length."""
    n = min(len(item), WINDOW)
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    if b - a < n:
        return 0, 0, n
    sums = np.concatenate(([0], np.cumsum(doc[a + shift : b + shift] == item[a:b])))
    runs = sums[n:] - sums[:-n]
    k = int(runs.argmax())
    return int(runs[k]), a + shift + k, n


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for id_, start, doc, item_id, item, shifts in zip(*(batch[c] for c in ("id", "start", "words", "item_id", "item", "shifts")), strict=True):
            doc, item = (x.values.to_numpy() for x in (doc, item))
            best = max(overlap(doc, item, s) for s in shifts.as_py())
            if best[0] >= least_same(len(item)):
                out.append((id_.as_py(), item_id.as_py(), start.as_py() + best[1], best[0], best[2]))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(5)], ["id", "item_id", "start", "same", "window"])


def leaks(documents: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, start, same, window): documents that hold part of a benchmark item, with the best overlap of each pair.

    An overlap counts if, in some WINDOW consecutive words of the item (all of them, if fewer) laid against the document, a share
    of SAME or more is equal, place by place; so substituted words are tolerated. Words are runs without space or \\t-\\r, A-Z
    lower-cased. Seeds are the hashes of the words that a mask reads at a position; the masks leave no overlap that counts
    without a common seed. Benchmark seeds set bits in a filter of a fixed size, documents are scanned once against it, and only
    stretches around hits go on to the join on seeds and to the check of all places that hits propose.

    An item of fewer than LEAST_WORDS words must stand in the document whole, word for word. Null and empty texts have no words; rows without an id take no part;
    repeated rows give one result; other columns are not read; with either table empty, so is the result.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null").distinct()
    items = saved(items.mapInArrow(_item_seeds, "item_id long, words array<long>, at array<int>, hashes array<long>").where(F.size("hashes") > 0).withColumn("item", F.xxhash64("item_id", "words")), "items")
    seeded = items.select("item", F.explode(F.arrays_zip("at", "hashes")).alias("s")).select("item", F.col("s.at").alias("item_at"), F.col("s.hashes").alias("hash"))
    filter_ = spark.sparkContext.broadcast(hash_filter(seeded))
    # at most LEAST_WORDS - 1 numbers
    short = [r[0] for r in items.select(F.size("words").alias("n")).where(F.col("n") < LEAST_WORDS).distinct().orderBy("n").collect()]
    masks = MASKS + whole_masks(short)

    docs = documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    regions = docs.mapInArrow(lambda batches: _regions(filter_.value, masks)(batches), "id long, start long, words array<long>, at array<int>, hashes array<long>")
    regions = saved(regions.withColumn("region", F.xxhash64("id", "start", "words")), "regions")
    hits = regions.select("region", F.explode(F.arrays_zip("at", "hashes")).alias("s")).select("region", F.col("s.at").alias("at"), F.col("s.hashes").alias("hash"))
    # broadcast, or split by adaptive execution, for both sides are read from files: a seed that very many documents hold is no one task's
    pairs = hits.join(small_or_shuffled(seeded), "hash").select("region", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    pairs = pairs.groupBy("region", "item").agg(F.collect_list("shift").alias("shifts"))  # at most a region's words and the item's
    laid = pairs.join(regions.select("region", "id", "start", "words").dropDuplicates(["region"]), "region").join(items.select("item", "item_id", F.col("words").alias("item_words")).dropDuplicates(["item"]), "item")
    laid = laid.select("id", "start", "words", "item_id", F.col("item_words").alias("item"), "shifts")
    found = laid.mapInArrow(_check, "id long, item_id long, start long, same long, window long")
    best = found.groupBy("id", "item_id").agg(F.max(F.struct(F.col("same") / F.col("window"), "same", -F.col("start"), "window")).alias("b"))
    return best.select(F.col("id").alias(id), "item_id", (-F.col("b.col3")).alias("start"), F.col("b.same").alias("same"), F.col("b.window").alias("window"))
