"""N-gram Jaccard join by vertical partitioning.

The n-grams' hashes are cut into parts, and with them each set. All parts of sets of about one size have one global order, rarest first:
by their number of n-grams, each weighed by its rarity in a count sketch of a bounded size. Any order is exact; this one keeps passages
and words that many documents share out of the candidates.

1. Candidates. Two sets that link differ in so few n-grams that most of their parts are equal: of parts many, all but apart, if apart
   is the most that they can differ in. So both hold an equal one among the first apart + 1 of their own in the global order. These are a
   document's keys. A part holds several n-grams, so that texts which share single n-grams by chance have no key in common.
2. Stars. Each document is held against one partner, that with which it has most keys in common among the hubs of its keys. A key's hub
   is the document whose n-grams are commonest on average: the one that copies were made from, or nearest to it. This joins dense groups
   without their quadratic number of pairs.
3. Hubs. While keys with many documents stay open, that is, hold several components, each document is held against the
   nearest, by sketch, of the documents that come first in its open keys by an order drawn anew each round.
4. Rest. Only keys that are still open are looked at again, across components and in blocks, thinned by a parity sketch whose
   distance never exceeds that of the sets: first, for keys with many documents, the nearest partner of each, until no round finds a link,
   then all that remain.
5. Overlaps. The order of hashes is cut into fragments, and with it each set; for candidate pairs, the overlap is counted in
   each fragment separately and summed per pair.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.llm.common import bound_batches, connected_components, dropped, listed, mix, saved, settled, small_or_shuffled, steps

#: Fragments in which overlaps are counted.
FRAGMENTS = 8
#: log2 of the cells of the count sketch: as many as documents, within these bounds (one byte a cell is sent to all tasks).
LEAST_CELLS, MOST_CELLS = 18, 22
#: Parts into which sets of a band are cut, for two n-grams in which the largest of them may differ.
PARTS = 3
#: Partners of one document that are verified in one task.
CELL_ROWS = 2000
#: Bytes at most of the sketches by which candidate pairs are held against each other first.
BRIEF_BYTES = 128
#: Keys with so many documents at most are paired in a plain join, others in blocks.
SMALL = 16
BLOCK = 512
#: Rounds of hubs at most, and the part of the squared key sizes that a round must leave at most for another to follow.
ROUNDS, PAYS = 6, 0.9


# ---------------------------------------------------------------- sets


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The sorted distinct hashes of n consecutive words, or of all words if there are fewer."""
    if not len(hashes):
        return hashes
    m = min(n, len(hashes))
    at = np.zeros(len(hashes) - m + 1, np.uint64)
    for k in range(m):
        at = mix(at * np.uint64(0x9FB21C651E98DF25) + hashes[k : len(hashes) - m + k + 1])
    at.sort()
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def _sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    for t in steps(texts):
        hashes, first = t.word_hashes()
        for i in range(t.n):
            yield shingles(hashes[first[i] : first[i + 1]], n)


def signature(values: np.ndarray, salt: int = 0x1234567) -> int:
    return int(mix(values ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64)) if len(values) else 0


def _sketch(values: np.ndarray, bits: int) -> np.ndarray:
    """Bit k is the parity of the number of n-grams with k: two sketches differ in no more bits than the sets in n-grams."""
    return np.packbits((np.bincount((mix(values) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def sketch_bits(size: int) -> int:
    """From four to eight bits an n-gram: so few of the n-grams that differ cancel that hardly a pair beyond the limit passes."""
    return 1 << max(9, int(4 * size).bit_length())


def _cells(values: np.ndarray, cells: int) -> np.ndarray:
    return (values & np.uint64(cells - 1)).astype(np.int64)


#: Cells of a row in which the count sketch travels.
ROW_CELLS = 4096


def _counted(n: int, cells: int):
    """(row, counts): each task's count sketch of its sets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            some, held = [], 0
            for values in _sets(batch["text"], n):
                some.append(values)
                held += len(values)
                if held > cells:
                    total += np.bincount(_cells(np.concatenate(some), cells), minlength=cells)
                    some, held = [], 0
            if some:
                total += np.bincount(_cells(np.concatenate(some), cells), minlength=cells)
        yield from _rows(total)

    return count


def _rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = np.flatnonzero(total.reshape(-1, ROW_CELLS).any(axis=1))
    ends = np.arange(len(rows) + 1) * ROW_CELLS
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), listed(total.reshape(-1, ROW_CELLS)[rows].ravel(), ends, pa.int64())], ["row", "counts"])


def _added(cells: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((cells // ROW_CELLS, ROW_CELLS), np.int64)
        for batch in batches:
            for row, counts in zip(batch["row"].to_pylist(), batch["counts"], strict=True):
                total[row] += counts.values.to_numpy()
        yield from _rows(total.ravel())

    return add


def frequency_levels(docs: DataFrame, n: int) -> np.ndarray:
    """A byte for each cell of the count sketch: its count on a logarithmic scale. Its size is bounded, so it may go to the driver and all tasks."""
    cells = 1 << min(MOST_CELLS, max(LEAST_CELLS, docs.count().bit_length()))
    parts = docs.select("text").mapInArrow(_counted(n, cells), "row int, counts array<long>")
    found = parts.repartition(cells // ROW_CELLS, "row").mapInArrow(_added(cells), "row int, counts array<long>").toArrow()
    total = np.zeros((cells // ROW_CELLS, ROW_CELLS), np.int64)
    for row, counts in zip(found["row"].to_pylist(), found["counts"], strict=True):
        total[row] += counts.values.to_numpy()
    return (4 * np.log2(np.maximum(total.ravel(), 1))).astype(np.uint8)


@functools.cache
def _bands(percent: int) -> np.ndarray:
    """The least sizes of the bands of sizes, so wide that a set and its partners are of two bands at most, but of sets of a few n-grams."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(max(least[-1] + 1, 10_000 * least[-1] // percent**2 + 1, 21 * least[-1] // 20 + 1))
    return np.array(least)


def prefix(values: np.ndarray, levels: np.ndarray, percent: int, top: int | None = None) -> tuple[np.ndarray, int]:
    """The keys of a set, in no order, and how common its n-grams are on average. `top` is the highest level, looked up where it is not given.

    Sets are cut alike only within a band of sizes: a set is cut anew for each band in which a partner as large or larger may be."""
    if not len(values):
        return values, 0
    level = levels[_cells(values, len(levels))]
    rare = np.concatenate(([0], np.cumsum((levels.max() if top is None else top) - level.astype(np.int64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values), dtype=np.uint64)))
    bands, most, keys = _bands(percent), 100 * len(values) // percent, []
    for band in range(int(np.searchsorted(bands, len(values), "right")) - 1, int(np.searchsorted(bands, most, "right"))):
        largest = int(bands[band + 1]) - 1
        parts = PARTS * most_apart(largest, largest, percent) // 2 + 1
        of = (values >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        at = np.concatenate(([0], np.cumsum(np.bincount(of.astype(np.int64), minlength=parts))))
        names = mix(sums[at[1:]] - sums[at[:-1]] + mix(np.arange(parts, dtype=np.uint64) + np.uint64(band << 40)))
        order = np.argsort(rare[at[:-1]] - rare[at[1:]], kind="stable")
        keys.append(names[order[: most_apart(len(values), min(most, largest), percent) + 1]])
    return np.concatenate(keys), int(16 * level.mean(dtype=np.float64))


def _printer(n: int, percent: int, levels):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = int(levels.value.max())

        def out(ids, sizes, high, low, common, keys, sketches):
            at = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
            flat = (np.concatenate(keys) if keys else np.zeros(0, np.uint64)).view(np.int64)
            cols = [ids, *(pa.array(x, pa.int64()) for x in (sizes, high, low, common)), listed(flat, at, pa.int64()), pa.array(sketches, pa.binary())]
            cols.append(pa.array([_fold(s, BRIEF_BYTES) for s in sketches], pa.binary()))
            return pa.RecordBatch.from_arrays(cols, ["id", "n", "sig_a", "sig_b", "common", "keys", "sketch", "brief"])

        for batch in batches:
            rows, start, held = [], 0, 0
            for i, values in enumerate(_sets(batch["text"], n)):
                keys, common = prefix(values, levels.value, percent, top)
                rows.append((len(values), signature(values), signature(values, 0x89ABCDE), common, keys, _sketch(values, sketch_bits(len(values))).tobytes()))
                held += len(keys)
                if held > 1 << 19:  # no larger batches than that
                    yield out(batch["id"].slice(start, i + 1 - start), *map(list, zip(*rows, strict=True)))
                    rows, start, held = [], i + 1, 0
            if rows:
                yield out(batch["id"].slice(start), *map(list, zip(*rows, strict=True)))

    return prints


def _segments(n: int):
    """(id, part, hashes) of the rows whose set has the signature that stands for their id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = np.array([(k << 64) // FRAGMENTS for k in range(FRAGMENTS)], np.uint64)
        for batch in batches:
            flat, ends, ids, parts = [], [0], [], []

            def out():
                values = np.concatenate(flat).view(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), listed(values, np.array(ends), pa.int64())], ["id", "part", "hashes"])

            for id_, sig, values in zip(batch["id"].to_pylist(), batch["sig_a"].to_pylist(), _sets(batch["text"], n), strict=True):
                if signature(values) != sig:
                    continue
                at = np.append(np.searchsorted(values, pivots), len(values))
                for f in range(FRAGMENTS):
                    if at[f + 1] > at[f]:
                        flat.append(values[at[f] : at[f + 1]])
                        ends.append(ends[-1] + int(at[f + 1] - at[f]))
                        ids.append(id_)
                        parts.append(f)
                if ends[-1] > 1 << 19:
                    yield out()
                    flat, ends, ids, parts = [], [0], [], []
            if ids:
                yield out()

    return cut


# ---------------------------------------------------------------- pairs


def most_apart(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """How many n-grams two sets of these sizes can differ in and link."""
    return (a + b) * (100 - percent) // (100 + percent)


def _fold(sketch: bytes, size: int) -> bytes:
    """A sketch of fewer bits: the parity of parities. Bits are numbered by the low bits of the hash, so halves fold."""
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def _near(percent: int):
    """Pairs whose sizes and sketches allow a link."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch["sketch_a"].to_pylist(), batch["sketch_b"].to_pylist()
            apart = np.array([_apart(x, y) for x, y in zip(sa, sb, strict=True)], np.int64)
            ok = apart <= most_apart(batch["n_a"].to_numpy(), batch["n_b"].to_numpy(), percent)
            yield batch.select(["a", "b", "n_a", "n_b"]).append_column("apart", pa.array(apart)).filter(pa.array(ok))

    return keep


def _apart(x: bytes, y: bytes) -> int:
    m = min(len(x), len(y))
    return int(np.bitwise_count(np.frombuffer(_fold(x, m), np.uint8) ^ np.frombuffer(_fold(y, m), np.uint8)).sum())


def _blocks(percent: int, nearest: bool):
    """Near pairs across components among the documents of one key, rows of block i against those of block j; of each row all or the nearest."""

    def pairs(table: pa.Table) -> pa.Table:
        ids, comp, n, block = (table[c].to_numpy() for c in ("id", "comp", "n", "block"))
        sketches = table["sketch"].to_pylist()
        m = min(map(len, sketches))
        bits = np.frombuffer(b"".join(_fold(s, m) for s in sketches), np.uint64).reshape(len(ids), -1)
        i0, j0 = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero(block == i0), np.flatnonzero(block == j0)
        out = []
        for i in left:
            js = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) | (i0 != j0) | nearest)]
            limit = most_apart(n[js], n[i], percent)
            js, limit = js[np.abs(n[js] - n[i]) <= limit], limit[np.abs(n[js] - n[i]) <= limit]
            apart = np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1)
            js, apart = js[apart <= limit], apart[apart <= limit]
            if nearest and len(js):
                js, apart = js[(k := int(apart.argmin())) : k + 1], apart[k : k + 1]
            out += [(ids[i], n[i], ids[j], n[j], d) for j, d in zip(js, apart, strict=True)]
        cols = np.array(out, np.int64).reshape(-1, 5)
        if not nearest:  # the larger id first, so that a pair is one row
            cols = np.where((cols[:, 0] < cols[:, 2])[:, None], cols[:, [2, 3, 0, 1, 4]], cols)
        return pa.table(dict(zip(("a", "n_a", "b", "n_b", "apart"), cols.T.copy(), strict=True)))

    return pairs


def _verified(segments: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b, n_a, n_b) that link: overlaps counted by fragment and summed. b's cells hold b and some of its partners each."""
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("salts"))
    pairs = saved(pairs.join(salts, "b").withColumn("salt", F.pmod(F.xxhash64("a"), "salts").cast("int")), "cells")
    total = percent * (F.col("n_a") + F.col("n_b"))
    a = segments.join(small_or_shuffled(pairs.select(F.col("a").alias("id"), F.col("b").alias("cell"), "salt", total.alias("total"))), "id")
    b = segments.join(small_or_shuffled(pairs.select(F.col("b").alias("id"), "salt").distinct()), "id").select(F.col("id").alias("cell"), "salt", "part", F.col("hashes").alias("h"))
    counts = a.join(b, ["cell", "salt", "part"]).select(F.col("id").alias("a"), F.col("cell").alias("b"), "part", "total", F.size(F.array_intersect("hashes", "h")).cast("long").alias("c"))
    counts = counts.groupBy("a", "b", "total", "part").agg(F.max("c").alias("c"))  # repeated rows count once
    return counts.groupBy("a", "b", "total").agg(F.sum("c").alias("c")).where((100 + percent) * F.col("c") >= F.col("total")).select("a", "b")


def _compared(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and the column `sketch` of both allow."""
    a, b = (sizes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    near = pairs.join(a, "a").join(b, "b").where((F.abs(F.col("n_a") - F.col("n_b")) * (100 + percent)) <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    return near.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_near(percent), "a long, b long, n_a long, n_b long, apart long")


def _sketch_filter(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and sketches allow: by brief sketches first, so that whole ones travel only with the pairs that these leave."""
    left = saved(_compared(pairs, sizes.select("id", "n", F.col("brief").alias("sketch")), percent).select("a", "b"), "brief")
    ids = saved(left.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    return _compared(left, sizes.join(small_or_shuffled(ids), "id", "left_semi"), percent)


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of each a the pair with the nearest b."""
    return pairs.groupBy("a").agg(F.min(F.struct("apart", "b", "n_a", "n_b")).alias("best")).select("a", "best.b", "best.n_a", "best.n_b")


def _open(marked: DataFrame) -> tuple[DataFrame, float, float]:
    """Rows (key, id, comp, members) of the keys that hold several components; their number and that of their squares."""
    keys = marked.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members")).where("lo < hi")
    keys = saved(keys.select("key", "members"), "open")
    rows, squares = keys.agg(F.sum("members"), F.sum(F.col("members").cast("double") * F.col("members"))).first()
    rest = saved(marked.join(small_or_shuffled(keys), "key"), "rest")
    dropped(keys)
    return rest, rows or 0, squares or 0


def _hub_links(segments: DataFrame, rest: DataFrame, sizes: DataFrame, percent: int, turn: int) -> DataFrame:
    """Links (a, b) of documents with the nearest hub of their keys; a key's hub is its first document in this turn's order."""
    hubs = rest.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("place"), "id", "comp")).alias("hub"))
    faced = rest.join(small_or_shuffled(saved(hubs, "hubs")), "key").where("comp <> hub.comp").select(F.col("id").alias("a"), F.col("hub.id").alias("b")).distinct()
    return _verified(segments, saved(_nearest(_sketch_filter(faced, sizes, percent)), "faced"), percent)


def _merged(rest: DataFrame, links: DataFrame) -> DataFrame:
    """(key, id, comp) of rest, after the components that links join are one."""
    named = rest.select("id", "comp").distinct()
    ends = links.join(named.select(F.col("id").alias("a"), F.col("comp").alias("u")), "a").join(named.select(F.col("id").alias("b"), F.col("comp").alias("v")), "b")
    new = connected_components(ends.select("u", "v"), "u", "v").select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    return rest.join(small_or_shuffled(saved(new, "joined")), "comp", "left").select("key", "id", F.coalesce("to", "comp").alias("comp"))


def _after(rest: DataFrame, found: DataFrame) -> tuple[DataFrame, float, float]:
    """`_open` of rest after the links found; rest itself is deleted."""
    marked = settled(lambda: _merged(rest, found), "marked")
    after = _open(marked)
    dropped(rest, marked)
    return after


def _across(rest: DataFrame, sizes: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(a, b, n_a, n_b) of the pairs across components that share an open key and whose sketches allow a link; with nearest, only those of keys with
    many documents, of each a the nearest: rounds are repeated to make such keys smaller, while the others are paired once, at the end."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    many = rest.where(F.col("members") > SMALL).join(sizes, "id").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select("key", "id", "comp", "n", "sketch", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    pairs = many.groupBy("key", "i", "j").applyInArrow(_blocks(percent, nearest), "a long, n_a long, b long, n_b long, apart long")
    if nearest:
        return _nearest(pairs)
    few = rest.where(F.col("members") <= SMALL).select("key", "id", "comp")
    close = few.alias("x").join(few.alias("y"), "key").where("x.id > y.id and x.comp <> y.comp").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    return pairs.select("a", "b", "n_a", "n_b").union(_sketch_filter(close, sizes, percent).select("a", "b", "n_a", "n_b")).distinct()


def jaccard_groups(documents: DataFrame, id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """(id, n_shingles, class_id, component_id) of every row: sizes, the smallest id with the same set, and the smallest id
    reachable by links.

    Two sets of n-word shingles link when 100 * |intersection| >= percent * |union|. Words
    are runs without space or \\t-\\r, A-Z lower-cased; fewer than n words make one shingle; a text without words, or
    null, has none and links with nothing. Rows that repeat an id are one
    node; of several texts the smallest set stands for it beside near sets, while exact copies of any of them link with it. A null id takes no part: class and component are null. Other columns are not read. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    docs = documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    levels = spark.sparkContext.broadcast(frequency_levels(docs, n))
    prints = saved(docs.mapInArrow(_printer(n, percent, levels), "id long, n long, sig_a long, sig_b long, common long, keys array<long>, sketch binary, brief binary"), "prints")
    real = prints.where("n > 0 and id is not null")
    # saved, so that adaptive execution can split a class that very many rows are in
    classes = real.groupBy("sig_a", "sig_b").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").drop("last")
    classes = saved(classes, "classes")
    real = real.join(small_or_shuffled(classes), ["sig_a", "sig_b"], "left").withColumn("rep", F.coalesce("rep", "id"))
    member = prints.where("n = 0 or id is null").select("id", "n", F.lit(None).cast("long").alias("rep")).union(real.select("id", "n", "rep"))
    member = saved(member, "members")
    # ids with several texts: their classes belong together
    same = member.where("rep is not null").groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("id")
    same = member.join(same, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # and ids that stand for several sets: the smallest is kept
    reps = real.where("id = rep")
    several = reps.groupBy("id").agg(F.min(F.struct("n", "sig_a")).alias("s"), F.count("*").alias("rows")).where("rows > 1").select("id", F.col("s.sig_a").alias("only"))
    if not (several := saved(several, "several")).isEmpty():
        reps = reps.join(small_or_shuffled(several), "id", "left").where("only is null or only = sig_a")

    # one exchange serves both the keys that several ids have and the join with them: both read key, id and common
    keyed = reps.select("id", "common", F.explode("keys").alias("key")).repartition("key")
    hub = F.max(F.struct("common", (-F.col("id")).alias("id")))
    shared = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), hub.alias("hub")).where("lo < hi").select("key", (-F.col("hub.id")).alias("b"))
    held = saved(keyed.select("key", "id").join(shared.hint("merge"), "key").distinct(), "held")
    sizes = saved(reps.select("id", "n", "sig_a", "sketch", "brief").join(held.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]), "sizes")
    segments = docs.join(small_or_shuffled(sizes.select("id", "sig_a")), "id").select("id", "sig_a", "text").mapInArrow(_segments(n), "id long, part int, hashes array<long>")
    segments = saved(segments, "segments")
    dropped(prints)

    stars = held.where("id <> b").groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("keys"))
    stars = stars.groupBy("a").agg(F.max(F.struct("keys", (-F.col("b")).alias("b"))).alias("best")).select("a", (-F.col("best.b")).alias("b"))
    linked = lambda pairs, name: settled(lambda: _verified(segments, saved(pairs(), name), percent), "links")
    tables = [linked(lambda: _sketch_filter(stars, sizes, percent), "stars")]

    comps = settled(lambda: connected_components(tables[0]), "comps")
    marked = held.select("key", "id").join(small_or_shuffled(comps), "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    rest, rows, squares = _open(marked)
    dropped(held, comps)
    for turn in range(ROUNDS):
        if squares <= SMALL * rows:
            break
        found, before = settled(lambda: _hub_links(segments, rest, sizes, percent, turn), "links"), squares  # noqa: B023
        if found.isEmpty():
            break
        tables.append(found)
        rest, rows, squares = _after(rest, found)
        if squares > PAYS * before:
            break
    while squares > SMALL * rows:
        found = linked(lambda: _across(rest, sizes, percent, nearest=True), "nearest")  # noqa: B023
        if found.isEmpty():
            break
        tables.append(found)
        rest, rows, squares = _after(rest, found)
    if rows:
        tables.append(linked(lambda: _across(rest, sizes, percent, nearest=False), "pairs"))
    dropped(segments, sizes, rest)

    links = functools.reduce(DataFrame.union, tables)
    comps = connected_components(links.union(same)).select(F.col("id").alias("rep"), "comp")  # saved by its rounds
    dropped(classes, several, *tables)
    return member.join(comps, "rep", "left").select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("class_id"), F.when(F.col("id").isNotNull(), F.coalesce("comp", "rep", "id")).alias("component_id")
    )
