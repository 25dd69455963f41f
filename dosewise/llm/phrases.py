"""Phrase collocations by suffix arrays: every shard of words sorts its suffixes by numpy prefix doubling over word ids, the intervals of
the LCP array give its n-gram counts, and Spark merges the shards' counts by phrase."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dosewise.llm.common import bound_batches, hash_filter, lowered, marked, may_hold, mix, saved, small_or_shuffled, span_hashes, spans_text, steps

#: Bytes that end a piece, and those that part words as well.
PIECE = marked(b".,;:!?\n\v\f\r")
BETWEEN = PIECE | marked(b" \t")
#: Words of one suffix array; a longer text is in one by itself.
SHARD_WORDS = 1 << 19
#: Rows of phrases in one Arrow batch.
BATCH_ROWS = 1 << 16
#: Parts in which a language's phrases are ranked before the best of them are ranked together.
RANK_PARTS = 64

_STEP = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- suffix arrays


def suffix_array(ids: np.ndarray, left: np.ndarray, kept: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in `kept`, sorted by their next `depth` words or more, and each one's LCP with the one before it, in words.

    left[i] words follow from i to the end of i's piece, itself included; beyond it a suffix is empty. Each doubling ranks pairs of ranks.
    """
    ranks, width = [ids.astype(np.int64)], 1
    while width < depth:
        last, of = ranks[-1], kept if 2 * width >= depth else np.arange(len(ids))
        behind = np.where(left[of] > width, last[np.minimum(of + width, len(ids) - 1)] + 1, 0)
        rank = np.full(len(ids), -1, np.int64)
        rank[of] = np.unique(last[of] * (len(ids) + 2) + behind, return_inverse=True)[1]
        ranks.append(rank)
        width *= 2
    order = kept[np.argsort(ranks[-1][kept], kind="stable")]
    lcp = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + lcp[1:], b + lcp[1:]
        inside = (lcp[1:] < left[a]) & (lcp[1:] < left[b])
        x, y = np.where(inside, x, 0), np.where(inside, y, 0)
        # ranks of the last doubling are known at the kept places alone
        lcp[1:] += np.where(inside & (ranks[k][x] == ranks[k][y]) & (ranks[k][x] >= 0), 1 << k, 0)
    return order, lcp


class _Shard:
    """Consecutive words with their languages: bytes, spans, hashes by language and words left in the piece."""

    def __init__(self, parts: list[tuple]):
        sizes = np.cumsum([0] + [len(p[0]) for p in parts])
        self.buf = np.concatenate([p[0] for p in parts] + [np.frombuffer(b" ", np.uint8)])
        self.starts, self.ends = (np.concatenate([p[k] + at for p, at in zip(parts, sizes, strict=False)]) for k in (1, 2))
        self.hash, self.lang = (np.concatenate([p[k] for p in parts]) for k in (3, 4))
        new = np.concatenate([p[5] for p in parts])
        self.n = len(new)
        last = np.append(np.flatnonzero(new)[1:], self.n)
        self.left = last[np.cumsum(new) - 1] - np.arange(self.n)

    def hashes(self, length: int) -> np.ndarray:
        """Hashes of the phrases of so many words at every word; without meaning where fewer are left."""
        out = self.hash
        for k in range(1, length):
            out = mix(out * _STEP + np.roll(self.hash, -k))
        return out

    def counted(self, length: int, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Where each different phrase of so many words stands first in the suffix array, and how often it stands in the shard; of
        those alone whose two shorter parts may be in the filter."""
        fits = self.left >= length
        if bits is not None:
            part = may_hold(bits, self.hashes(length - 1))
            fits &= part & np.roll(part, -1)
        kept = np.flatnonzero(fits)
        if not len(kept):
            return kept, kept
        ids = np.unique(self.hash, return_inverse=True)[1]
        order, lcp = suffix_array(ids, self.left, kept, length)
        begin = np.flatnonzero(lcp < length)  # intervals in which all neighbours share so many words
        return order[begin], np.diff(np.append(begin, len(order)))

    def texts(self, places: np.ndarray, length: int) -> pa.Array:
        blank = len(self.buf) - 1
        starts, ends = np.full((len(places), 2 * length - 1), blank), np.full((len(places), 2 * length - 1), blank + 1)
        for k in range(length):
            starts[:, 2 * k], ends[:, 2 * k] = self.starts[places + k], self.ends[places + k]
        return spans_text(self.buf, starts.ravel(), ends.ravel(), 2 * length - 1)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[_Shard, list[str]]]:
    """Shards of about so many words, with the names of the languages that their numbers stand for."""
    names: dict[str, int] = {}
    parts, words = [], 0
    for batch in batches:
        numbers = np.array([names.setdefault(x, len(names)) for x in batch["lang"].to_pylist()], np.int64)
        for t in steps(batch["text"]):
            starts, ends, first = t.words(BETWEEN)
            if not len(starts):
                continue
            buf = lowered(t.buf)
            doc = np.repeat(np.arange(t.n), np.diff(first))
            lang = numbers[t.first + doc]
            marks = np.cumsum(PIECE[t.buf])[starts]
            new = np.ones(len(starts), bool)
            new[1:] = (marks[1:] != marks[:-1]) | (doc[1:] != doc[:-1])
            salts = span_hashes(*_joined(list(names)))
            parts.append((buf, starts, ends, mix(span_hashes(buf, starts, ends) * _STEP + salts[lang]), lang, new))
            words += len(starts)
            if words >= most:
                yield _Shard(parts), list(names)
                parts, words = [], 0
    if parts:
        yield _Shard(parts), list(names)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [x.encode() for x in texts]
    at = np.cumsum([0] + [len(x) for x in raw])
    return np.frombuffer(b"".join(raw) + b" ", np.uint8), at[:-1], at[1:]


def _counter(length: int, bits, most: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, names in _shards(batches, most):
            langs = pa.array(names, pa.string())
            if length == 1:  # all words of each language
                n = np.bincount(shard.lang, minlength=len(names))
                yield pa.RecordBatch.from_arrays([langs, pa.nulls(len(names), pa.string()), pa.array(np.zeros(len(names), np.int64)), pa.array(n.astype(np.int64))], ["lang", "phrase", "hash", "f"])
            places, f = shard.counted(length, None if bits is None else bits.value)
            hashes = shard.hashes(length)[places].view(np.int64)
            for a in range(0, len(places), BATCH_ROWS):
                at = places[a : a + BATCH_ROWS]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(shard.lang[at])), shard.texts(at, length), pa.array(hashes[a : a + BATCH_ROWS]), pa.array(f[a : a + BATCH_ROWS])], ["lang", "phrase", "hash", "f"])

    return count


def frequent(documents: DataFrame, most_words: int, least: int, text: str = "text", lang: str = "lang", shard_words: int = SHARD_WORDS) -> list[DataFrame]:
    """For each length up to most_words a table (lang, phrase, hash, f) of the phrases that stand `least` times or more in a language; among those
    of one word a row with a null phrase has the number of all words.

    A phrase can be that frequent only if both its parts of one word less are, so longer phrases are counted where a filter of a fixed size
    may hold both; what it lets through by chance, the merged counts sort out. Shards' counts are added up over the cluster by language and text.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    docs = documents.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    out, bits = [], None
    for length in range(1, most_words + 1):
        rows = docs.mapInArrow(_counter(length, bits, shard_words), "lang string, phrase string, hash long, f long")
        # shards have added up already: a second time before the shuffle would find little
        merged = rows.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.first("hash").alias("hash"), F.sum("f").alias("f"))
        out.append(saved(merged.where(F.col("phrase").isNull() | (F.col("f") >= least)), f"phrases-{length}"))
        if length < most_words:
            bits = spark.sparkContext.broadcast(hash_filter(out[-1].where("phrase is not null")))
    return out


# ---------------------------------------------------------------- scores


def _cut(place, parts):
    return F.array_join(F.slice("words", 1, place), " ").alias(parts[0]), F.array_join(F.slice("words", place + 1, F.size("words") - place), " ").alias(parts[1])


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", most_words: int = 3, least: int = 10, cover: int = 50, top: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to most_words words, by score, then a, then text.

    Texts have A-Z lower-cased and are split into pieces at .,;:!? and \\n-\\r, pieces into words at spaces and tabs. a counts all places of the
    phrase within pieces, overlapping ones too, l and r those of its two parts at the cut that scores lowest (the first such), n all words.
    The score is floor(10**6 * a * a / (l * r)), in decimals of 38 digits. Phrases below `least` are no candidates; one goes if a longer
    candidate, itself gone or not, holds its words side by side and is at least `cover` per cent as frequent.
    Null texts count as empty, a null lang as 'und'; repeated rows count each; other columns are not read; without words there are no rows.
    """
    tables = frequent(documents, most_words, least, text, lang, shard_words)
    counts = reduce(DataFrame.union, [t.where("phrase is not null").select("lang", "phrase", "f") for t in tables])
    phrases = reduce(DataFrame.union, [t.select("lang", "phrase", F.col("f").alias("a")) for t in tables[1:]])

    words = phrases.withColumn("words", F.split("phrase", " "))
    cuts = words.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", *_cut(F.col("k"), ("first", "rest")))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumn("top", (wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")).withColumn("below", (wide("l") * wide("r")).cast("decimal(38,0)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("top div below").alias("score"), "k", "l", "r")).alias("cut"))

    inner = words.where(F.size("words") > 2).select("lang", "words", F.col("a").alias("held"), F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size"))
    inner = inner.select("lang", "held", F.explode(F.expr("transform(sequence(1, size(words) - size + 1), i -> array_join(slice(words, i, size), ' '))")).alias("phrase"))
    holds = inner.groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    left = scored.join(holds, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < cover * F.col("a")))

    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    best = left.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = small_or_shuffled(tables[0].where("phrase is null").select("lang", F.col("f").alias("n")))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
