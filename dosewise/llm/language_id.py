"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs. An n-gram's vector binds its letters: their vectors, each permuted by its
place, multiplied. A text's vector bundles those of its n-grams, a language's prototype those of its texts, and a text
is given the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewise.llm.common import bound_batches, mix, saved

DIMENSIONS = 512
N = 3
#: Symbols: 0 is any run of other characters, 1-26 are a-z, other letters share the rest.
SYMBOLS = 128
#: Texts that are counted in one matrix, and characters after which a new one is begun.
STEP_TEXTS, STEP_CHARS = 256, 1 << 18
#: Prototypes of one piece on average: 1 MB of 512 numbers each; more languages are compared in several pieces.
PIECE_LANGUAGES = 512


@functools.cache
def _symbols() -> np.ndarray:
    """The symbol of every code point of lower-cased text."""
    out = np.zeros(0x110000, np.uint8)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    out[letters] = 27 + mix(letters.astype(np.uint64)) % np.uint64(SYMBOLS - 27)
    out[97:123] = np.arange(1, 27)
    return out


@functools.cache
def _letters(dimensions: int) -> np.ndarray:
    return np.random.default_rng(20).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))


def ngram_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bound vectors of n-grams, each a number in base SYMBOLS."""
    letters, out = _letters(dimensions), np.ones((len(codes), dimensions), np.int8)
    for place in range(N):
        out *= np.roll(letters, place, axis=1)[codes // SYMBOLS**place % SYMBOLS]
    return out.astype(np.float32)


def text_vectors(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """A bundled vector of length 1 for each text; zero for a text without letters."""
    # one separator between texts and around all of them
    points = np.frombuffer(("\n" + "\n".join(t or "" for t in texts) + "\n").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    symbol = _symbols()[points]
    # lower-casing can change a text's length
    ends = np.cumsum([len((t or "").lower()) + 1 for t in texts])
    kept = np.flatnonzero((symbol > 0) | (np.concatenate(([1], symbol[:-1])) > 0))
    symbol, doc = symbol[kept].astype(np.int64), np.searchsorted(ends, kept, "left")
    if len(symbol) < N:
        return np.zeros((len(texts), dimensions), np.float32)
    codes = sum(symbol[N - 1 - p : len(symbol) - p] * SYMBOLS**p for p in range(N))
    # an n-gram belongs to the text of its letters: not one with letters of two texts around a separator
    middle = doc[1:-1]
    fits = (symbol[1:-1] > 0) | ((doc[:-2] == doc[2:]) & (symbol[:-2] > 0) & (symbol[2:] > 0))
    codes, middle = codes[fits], middle[fits]
    seen = np.flatnonzero(np.bincount(codes, minlength=SYMBOLS**N))
    index = np.zeros(SYMBOLS**N, np.int32)
    index[seen] = np.arange(len(seen))
    counts = np.bincount(middle * len(seen) + index[codes], minlength=len(texts) * len(seen)).reshape(len(texts), -1)
    out = np.zeros((len(texts), dimensions), np.float32)
    for a in range(0, len(seen), 8192):
        out += counts[:, a : a + 8192].astype(np.float32) @ ngram_vectors(seen[a : a + 8192], dimensions)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _in_steps(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first, vectors) for steps of a bounded number of texts and characters; a longer text is a step of its own."""
    some, size, first = [], 0, 0
    for t in texts.to_pylist():
        if some and (len(some) == STEP_TEXTS or size + len(t or "") > STEP_CHARS):
            yield first, text_vectors(some)
            first, some, size = first + len(some), [], 0
        some.append(t)
        size += len(t or "")
    if some:
        yield first, text_vectors(some)


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of each language's texts."""
    sums: dict[str, np.ndarray] = {}

    def out():
        flat = np.concatenate(list(sums.values())).astype(np.float64)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * DIMENSIONS, pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), vectors], ["lang", "v"])

    for batch in batches:
        for first, vectors in _in_steps(batch["text"]):
            langs = np.array(batch["lang"].slice(first, len(vectors)).to_pylist(), object)
            for lang in dict.fromkeys(langs):
                s = vectors[langs == lang].sum(axis=0, dtype=np.float64)
                sums[lang] = sums[lang] + s if lang in sums else s
            if len(sums) > 1000:
                yield out()
                sums.clear()
    if sums:
        yield out()


def bundled(documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, v): each language's bundled vector, from all rows with a text and a language."""
    rows = documents.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    parts = rows.mapInArrow(_bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("k", "x"))
    total = parts.groupBy("lang", "k").agg(F.sum(F.round("x", 3).cast("decimal(38,3)")).cast("double").alias("x"))  # decimals: the same sum in any order
    whole = total.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x")))["x"].alias("v"))
    return whole.where(F.exists("v", lambda x: x != 0))


def _fetched(piece: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of one piece in order and their vectors."""
    whole = piece.toArrow()
    found = sorted(zip(whole["lang"].to_pylist(), whole["v"].to_pylist(), strict=True))
    return [k for k, _ in found], np.array([v for _, v in found], np.float64).reshape(len(found), DIMENSIONS)


def prototypes(documents: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[list[str], np.ndarray]]:
    """The languages and their bundled vectors, from all rows with a text and a language, in pieces of PIECE_LANGUAGES on average.

    One piece is fetched at a time; its languages are those of one hash class, and there are as many classes as the count asks for.
    """
    whole = saved(bundled(documents, text, lang), "prototypes")
    pieces = -(-whole.count() // PIECE_LANGUAGES) or 1
    return [_fetched(whole if pieces == 1 else whole.where(F.pmod(F.xxhash64("lang"), F.lit(pieces)) == k)) for k in range(pieces)]


def best_of(predicted: list[Column]) -> Column:
    """Of predictions from several pieces that with the largest score, ties to the language first in order; `und` gives way to any other."""
    order = lambda p: F.struct((p["lang"] == "und").alias("none"), (-p["score"]).alias("back"), p["lang"].alias("lang"), p["score"].alias("score"))
    first = F.array_min(F.array(*map(order, predicted)))
    return F.struct(first["lang"].alias("lang"), first["score"].alias("score"))


def predictor(langs: list[str], vectors: np.ndarray):
    """A function of a text column: struct (lang, score), score the cosine, from 0 to 1; `und` and 0 without letters or languages."""
    weights = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float32) if len(langs) else vectors

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for _, v in _in_steps(texts):
            if not langs:
                names += ["und"] * len(v)
                scores.append(np.zeros(len(v)))
                continue
            cosine = v @ weights.T
            best = cosine.argmax(axis=1)
            some = v.any(axis=1)
            names += [langs[b] if s else "und" for b, s in zip(best, some, strict=True)]
            scores.append(np.where(some, np.clip(cosine[np.arange(len(v)), best], 0, 1), 0).astype(np.float64))
        score = np.concatenate(scores) if scores else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return predict


def held_out(id: str | Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for null."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", train: Column | None = None) -> DataFrame:
    """All columns of documents and `predicted`, a struct (lang, score).

    Prototypes come from the rows that meet `train` (unless given: an id, not held out) with a language; a prediction uses the
    text alone. A null text, or one without a letter, is `und` with score 0, and so is all if there is nothing to learn from.
    Repeated rows are learned from and predicted each; ties go to the language first in order; an empty table gives an empty result.
    """
    bound_batches(documents.sparkSession)
    if train is None:
        train = F.col(id).isNotNull() & ~held_out(id)
    found = [predictor(*piece)(F.col(text)) for piece in prototypes(documents.where(train), text, lang)]
    return documents.drop("predicted").withColumn("predicted", found[0] if len(found) == 1 else best_of(found))


#: A text is taken for one of no learned language below this part of the least score that a learning text of like length has.
SLACK = 0.5


def length_class(text: Column) -> Column:
    """The binary logarithm of a text's length, rounded down; null texts are of class 0."""
    return F.floor(F.log2(F.coalesce(F.length(text), F.lit(0)) + 1)).cast("int")


def judged(documents: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", train: Column | None = None) -> DataFrame:
    """All columns of documents, `predicted` as identify() gives it, and `fits`: whether the text is in any learned language.

    A text fits unless it is `und` or its score is below SLACK times the least that a learning text with a letter, of its class of lengths, has.
    Long texts of a language have high scores with it, so each class has a bound of its own, learned from all learning rows; classes
    without one take that of the next shorter one that has. Everything else is as in identify().
    """
    if train is None:
        train = F.col(id).isNotNull() & ~held_out(id)
    found = identify(documents, id, text, lang, train).withColumn("_class", length_class(F.col(text)))
    learned = found.where(train & F.col(lang).isNotNull() & (F.col("predicted.lang") != "und"))
    # at most 32 classes
    least = {r["_class"]: r["least"] for r in learned.groupBy("_class").agg((SLACK * F.min("predicted.score")).alias("least")).collect()}
    bounds, last = [], 0.0
    for k in range(32):
        last = least.get(k, last)
        bounds.append(F.lit(last))
    fits = (F.col("predicted.lang") != "und") & (F.col("predicted.score") >= F.get(F.array(*bounds), F.col("_class")))
    return found.withColumn("fits", fits).drop("_class")
