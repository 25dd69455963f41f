"""Line dedup by content-defined chunks and windows of lines: rolling hashes over line hashes set the chunks' boundaries, so that equal passages
fall into equal chunks wherever they stand, and multi-line chunks that are repeated anywhere are removed after a comparison of bytes. Windows, the
shortest runs of more than LONG_WORDS words that begin or end at a line, find every longer repeated passage line by line; as they overlap, SHA-256
digests of their bytes are compared instead of the bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dosewise.llm.common import BROADCAST_ROWS, Texts, bound_batches, hash_filter, may_hold, mix, saved, small_or_shuffled, span_hashes, steps

#: A chunk ends where the rolling hash of its last WINDOW lines is smaller than those one line before and behind, so that it has
#: two lines or more (three on average); nothing but content bounds it, so a run of equal lines is one chunk.
WINDOW = 2
#: A line of more words than this is a chunk by itself, and repeated it is removed as longer chunks are.
LONG_WORDS = 50


def chunks(texts: pa.Array, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """(row, chunk, start, end, hash, removable) in bytes of all chunks; together a row's chunks are its text."""
    for t in steps(texts):
        yield from _chunks(t, _Lines(t), window)


class _Lines:
    """The lines of a step of texts."""

    def __init__(self, t: Texts):
        breaks = np.flatnonzero(t.buf == 10) + 1
        ends = np.union1d(breaks, t.offsets[1:])
        self.ends = ends[ends > 0]
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)[: len(self.ends)]
        # without the line break, so that a text's last line equals the same line elsewhere
        self.bare = self.ends - (t.buf[self.ends - 1] == 10)
        self.doc = np.searchsorted(t.offsets, self.starts, "right") - 1
        word_starts = t.words()[0]
        self.words = np.searchsorted(word_starts, self.ends) - np.searchsorted(word_starts, self.starts)


def _windows(t: Texts, at: _Lines) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, last line, hash) of each window of two lines or more: from each line, to it, the shortest run of more than LONG_WORDS words.

    A run of lines with more words is made up of the windows within it, whatever stands around it. A window's far end has words, so that lines
    without a word stand at one end of it at most.
    """
    n = len(at.ends)
    total, line = np.concatenate(([0], np.cumsum(at.words))), np.arange(n)
    ahead = np.searchsorted(total, total[:-1] + LONG_WORDS + 1) - 1
    behind = np.searchsorted(total, total[1:] - LONG_WORDS - 1, "right") - 1
    b, e = np.concatenate((line, behind)), np.concatenate((ahead, line))
    ok = (b >= 0) & (e < n) & (b < e)
    b, e = b[ok], e[ok]
    inside = at.doc[b] == at.doc[e]
    b, e = np.divmod(np.unique(b[inside] * n + e[inside]), max(n, 1))
    return b, e, span_hashes(t.buf, at.starts[b], at.bare[e])


def _digests(t: Texts, at: _Lines, b: np.ndarray, e: np.ndarray) -> list[bytes]:
    """A SHA-256 digest of each window from line b to line e, equal for equal bytes alone.

    What lies between a window's first and last line with words is hashed once; each line without words outside of it is hashed onto the digest
    of the window that is shorter by that line. So all windows over n such lines together read them once, and other bytes at most some
    2 * LONG_WORDS times.
    """
    worded = np.flatnonzero(at.words)
    low, high = worded[np.searchsorted(worded, b)], worded[np.searchsorted(worded, e, "right") - 1]
    out, reached, raw = [b""] * len(b), {}, memoryview(np.ascontiguousarray(t.buf))
    for k in np.argsort((low - b) + (e - high), kind="stable").tolist():
        lo, hi, ahead = int(low[k]), int(high[k]), bool(b[k] < low[k])
        if (lo, hi) not in reached:
            reached[lo, hi] = hashlib.sha256(raw[at.starts[lo] : at.bare[hi]]).digest()
        line, digest = reached.get((lo, hi, ahead), (lo if ahead else hi, reached[lo, hi]))
        for j in range(line - 1, int(b[k]) - 1, -1) if ahead else range(line + 1, int(e[k]) + 1):
            digest = hashlib.sha256(b"<>"[1 - ahead : 2 - ahead] + digest + raw[at.starts[j] : at.bare[j]]).digest()
        reached[lo, hi, ahead] = (int(b[k]) if ahead else int(e[k]), digest)
        out[k] = digest
    return out


def _chunks(t: Texts, at_: _Lines, window: int) -> Iterator[tuple[int, int, int, int, int, bool]]:
    starts, ends, bare, doc = at_.starts, at_.ends, at_.bare, at_.doc
    if len(ends):
        lines = span_hashes(t.buf, starts, bare)
        first = np.searchsorted(doc, np.arange(t.n))
        place = np.arange(len(lines)) - first[doc]
        rolling = np.zeros(len(lines), np.uint64)
        for k in range(window):
            back = np.zeros(len(lines), np.uint64)
            back[k:] = lines[: len(lines) - k]
            rolling += np.where(place >= k, back * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & ((1 << 64) - 1)), np.uint64(0))
        rolling = mix(rolling)
        same = doc[1:] == doc[:-1]
        cut = np.zeros(len(lines), bool)
        cut[1:-1] = (rolling[1:-1] < rolling[:-2]) & (rolling[1:-1] <= rolling[2:]) & same[:-1] & same[1:]
        long = at_.words > LONG_WORDS
        cut |= long | np.append(long[1:] | ~same, True)
        at = np.flatnonzero(cut)
        begin = np.concatenate(([0], at[:-1] + 1))
        number = dict.fromkeys(range(t.n), 0)
        for lo, hi in zip(begin.tolist(), at.tolist(), strict=True):
            d = int(doc[lo])
            h = sequence_hash(lines[lo : hi + 1]) if hi > lo else int(lines[lo].view(np.int64))
            yield t.first + d, number[d], int(starts[lo] - t.offsets[d]), int(ends[hi] - t.offsets[d]), h, hi > lo or bool(long[lo])
            number[d] += 1


def sequence_hash(lines: np.ndarray) -> int:
    """A hash of a sequence of line hashes."""
    h = np.uint64(len(lines))
    places = np.arange(1, len(lines) + 1, dtype=np.uint64)
    return int((mix(lines + places * np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64) ^ h).view(np.int64))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The removable chunks and the windows of every row."""
    for batch in batches:
        for t in steps(batch["text"]):
            at = _Lines(t)
            rows = np.array([(i, a, h) for i, _, a, _, h, ok in _chunks(t, at, WINDOW) if ok], np.int64).reshape(-1, 3)
            first, _, hashes = _windows(t, at)
            row, start = t.first + at.doc[first], at.starts[first] - t.offsets[at.doc[first]]
            take = pa.array(np.concatenate((rows[:, 0], row)), pa.int64())
            found = [pa.array(np.concatenate((rows[:, 1], start)), pa.int32()), pa.array(np.concatenate((rows[:, 2], hashes.view(np.int64))), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch["id"].take(take), batch["row"].take(take), *found], ["id", "row", "start", "hash"])


def _bodies(bits):
    """Bytes of the removable chunks whose hash may be repeated; of such windows, which overlap, a digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = batch["text"], []

            def out():
                take = pa.array([r[0] for r in rows], pa.int64())
                kinds = ((1, pa.int32()), (2, pa.int32()), (3, pa.bool_()), (4, pa.int64()), (5, pa.binary()))
                return pa.RecordBatch.from_arrays(
                    [batch["id"].take(take), batch["row"].take(take), *(pa.array([r[c] for r in rows], kind) for c, kind in kinds)],
                    ["id", "row", "start", "stop", "chunk", "hash", "body"],
                )

            size = 0
            for t in steps(texts):
                at, last, raw = _Lines(t), None, b""
                lo, hi, hashes = _windows(t, at)
                may = may_hold(bits.value, hashes)
                lo, hi, hashes = lo[may], hi[may], hashes[may]
                first = t.offsets[at.doc[lo]]
                spans = (t.first + at.doc[lo], at.starts[lo] - first, at.ends[hi] - first, hashes.view(np.int64))
                found = zip(*(x.tolist() for x in spans), _digests(t, at, lo, hi), strict=True)
                units = [(i, a, b, h, b"") for i, _, a, b, h, ok in _chunks(t, at, WINDOW) if ok and may_hold(bits.value, np.uint64(h & (1 << 64) - 1))]
                for i, a, b, h, body in sorted([*units, *found]):
                    if i != last:
                        last, raw = i, texts[i].as_buffer().to_pybytes()
                    chunk = not body
                    rows.append((i, a, b, chunk, h, raw[a:b].removesuffix(b"\n") if chunk else body))
                    size += len(rows[-1][5]) + 40
                    if size > 1 << 22:
                        yield out()
                        rows, size = [], 0
            if rows:
                yield out()

    return read


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])))
def _apart(spans: pa.Array) -> pa.Array:
    """Disjoint cuts in order: the chunks as they are, and what the windows, joined where they touch, cover besides."""
    out = []
    for cuts in spans.to_pylist():
        chunks_ = sorted((c["start"], c["stop"]) for c in cuts if c["chunk"])
        joined: list[list[int]] = []
        for a, b in sorted((c["start"], c["stop"]) for c in cuts if not c["chunk"]):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        found, k = list(chunks_), 0
        for a, b in joined:
            while k < len(chunks_) and chunks_[k][1] <= a:
                k += 1
            j = k
            while j < len(chunks_) and chunks_[j][0] < b:
                if a < chunks_[j][0]:
                    found.append((a, chunks_[j][0]))
                a = max(a, chunks_[j][1])
                j += 1
            if a < b:
                found.append((a, b))
        out.append([{"start": a, "stop": b} for a, b in sorted(found)])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, cuts in zip(texts, spans.to_pylist(), strict=True):
        if cuts and text.is_valid:
            raw, kept, at = text.as_buffer().to_pybytes(), [], 0
            for c in cuts:
                kept.append(raw[at : c["start"]])
                at = c["stop"]
            out.append((b"".join(kept) + raw[at:]).decode())
        else:
            out.append(text.as_py())
    return pa.array(out, pa.string())


def remove_repeated(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """documents, all columns and rows, with repeated chunks and passages taken out of the text; added: n_removed, chunks and
    further pieces taken from the row.

    A chunk of several lines, or a line of more than LONG_WORDS words, that occurs elsewhere, in any row or in its own, stays where id, row and place
    come first and goes everywhere else, if its bytes (but for a line break at its end) are the same; of windows, if their digests are. Chunks are
    cut by content, so a passage inserted before them does not move their bounds. Besides, every line goes that stands in a run of lines with
    more than LONG_WORDS words in all that occurs before; of runs that overlap their own first occurrence only what is behind it goes.
    Nulls stay null and empty texts empty; a text that is all repeats becomes empty; rows equal in id and text are one for
    this, and both keep or lose a chunk; a null id comes first; a column named n_removed is replaced; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    docs = documents.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.col(id), F.col(text)).alias("row"), F.col(text).alias("text"))
    some = docs.where("text is not null and text <> ''")
    found = some.mapInArrow(_found, "id long, row long, start int, hash long")
    place = F.struct("id", "row", "start")
    repeated = found.groupBy("hash").agg(F.min(place).alias("keep"), F.max(place).alias("last"), F.count("*").alias("n")).where("n > 1 and keep <> last")
    repeated = saved(repeated.select("hash", "keep", F.ceil(F.col("n") / 5000).cast("int").alias("salts")), "repeated")
    filter_ = spark.sparkContext.broadcast(hash_filter(repeated))
    bodies = some.mapInArrow(_bodies(filter_), "id long, row long, start int, stop int, chunk boolean, hash long, body binary")
    # broadcast or split by adaptive execution, for both sides are read from files: a hash that very many rows hold is no one task's
    bodies = saved(bodies.join(small_or_shuffled(repeated), "hash"), "bodies")
    first = bodies.where(place.eqNullSafe(F.col("keep"))).select("hash", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("body").alias("kept"), F.col("stop").alias("until"))
    first = first.dropDuplicates(["hash", "salt"])
    others = bodies.where(~place.eqNullSafe(F.col("keep"))).withColumn("salt", F.pmod(F.xxhash64("row", "start"), "salts").cast("int"))
    own = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("row") == F.col("keep.row"))
    gone = others.join(first, ["hash", "salt"]).where("body = kept").select("id", "row", F.when(own, F.greatest("start", "until")).otherwise(F.col("start")).alias("start"), "stop", "chunk")
    gone = gone.where("start < stop").distinct().groupBy("id", "row").agg(_apart(F.collect_list(F.struct("start", "stop", "chunk"))).alias("cuts"))  # a text's own cuts
    gone = saved(gone.select(F.col("id").alias("_i"), F.col("row").alias("_r"), "cuts"), "gone")
    if (gone.select(F.sum(F.size("cuts"))).first()[0] or 0) <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    whole = documents.select(F.struct(*[c for c in documents.columns if c != "n_removed"]).alias("whole"), F.col(text).alias("text"), F.col(id).cast("long").alias("id"), F.xxhash64(F.col(id), F.col(text)).alias("row"))
    whole = whole.join(gone, F.col("id").eqNullSafe(F.col("_i")) & (F.col("row") == F.col("_r")), "left")
    columns = [_without("text", "cuts").alias(c) if c == text else F.col(f"whole.`{c}`").alias(c) for c in documents.columns if c != "n_removed"]
    return whole.select(*columns, F.when(F.col("cuts").isNull(), 0).otherwise(F.size("cuts")).alias("n_removed"))
