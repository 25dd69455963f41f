import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from dosewise.llm import line_dedup, queries
from dosewise.llm.common import mix, span_hashes, steps


def repeated_lines(rows):
    """{row: lines} that stand in a run of lines of over 50 words in all that occurs before; every pair of equal lines is carried on to both sides."""
    texts = [(text or "").removesuffix("\n").split("\n") for _, text in rows]
    places, gone = {}, {}
    for i, lines in enumerate(texts):
        for s, line in enumerate(lines):
            for j, t in places.get(line, []):
                a, b = 0, 1
                while s - a > 0 and t - a > 0 and lines[s - a - 1] == texts[j][t - a - 1]:
                    a += 1
                while s + b < len(lines) and t + b < len(texts[j]) and lines[s + b] == texts[j][t + b]:
                    b += 1
                words = [len(x.split()) for x in lines[s - a : s + b]]
                if sum(words) > 50:
                    # a run that overlaps its first occurrence loses what is behind the first 50 words of that
                    least = next(k for k in range(len(words)) if sum(words[: k + 1]) > 50) + 1
                    gone.setdefault(i, set()).update(range(max(s - a, t - a + least) if i == j else s - a, s + b))
            places.setdefault(line, []).append((i, s))
    return gone


def cut(text, window=line_dedup.WINDOW):
    """(start, end, removable) of a text's chunks, line by line, from line hashes by plain integers."""
    lines = re.findall(rb"[^\n]*\n|[^\n]+$", (text or "").encode())
    hashes = [int(span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) for x in (line.removesuffix(b"\n") for line in lines)]
    rolling = []
    for i in range(len(lines)):
        total = sum(hashes[i - k] * 0x9E3779B97F4A7C15 * (2 * k + 1) for k in range(window) if i >= k)
        rolling.append(int(mix(np.array([total % 2**64], np.uint64))[0]))
    at, begin, out, size = 0, 0, [], 0
    for i, line in enumerate(lines):
        at, size = at + len(line), size + 1
        alone = len(line.split()) > line_dedup.LONG_WORDS
        before = i + 1 < len(lines) and len(lines[i + 1].split()) > line_dedup.LONG_WORDS
        least = 0 < i < len(lines) - 1 and rolling[i] < rolling[i - 1] and rolling[i] <= rolling[i + 1]
        if alone or before or least or i == len(lines) - 1:
            out.append((begin, at, size > 1 or alone))
            begin, size = at, 0
    return out


def brute(rows):
    """Texts without those lines and without repeated chunks."""
    places = {}
    for i, (_, text) in enumerate(rows):
        for a, b, ok in cut(text):
            if ok:
                places.setdefault((text or "").encode()[a:b].removesuffix(b"\n"), []).append((i, a, b))
    cuts = {}
    for found in places.values():
        for i, a, b in sorted(found)[1:]:
            cuts.setdefault(i, []).append((a, b))
    gone, out = repeated_lines(rows), {}
    for i, (id_, text) in enumerate(rows):
        at, kept = 0, []
        for k, line in enumerate(re.findall(rb"[^\n]*\n|[^\n]+$", (text or "").encode())):
            if k not in gone.get(i, ()) and not any(a <= at < b for a, b in cuts.get(i, [])):
                kept.append(line)
            at += len(line)
        out[id_] = b"".join(kept).decode() if text is not None else None
    return out


def test_query_leaves_no_repeated_run(spark, tiny, texts):
    rows = sorted(texts.items())
    assert {r["doc_id"]: r["text"] for r in queries.op5_line_dedup(spark, tiny).collect()} == brute(rows)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9])
def test_short_passages_in_new_surroundings_go(spark, n):
    rng = random.Random(n)
    fresh = lambda k, w: [" ".join(f"w{rng.randrange(10**6)}" for _ in range(w)) for _ in range(k)]
    passage, few = fresh(n, 50 // n + 5), fresh(1, 40)
    rows = [(i, "\n".join([*fresh(3 + i % 3, 6), *passage, *fresh(2 + i % 2, 6), *few, *fresh(2, 6)])) for i in range(12)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert out[0] == rows[0][1]
    for i in range(1, 12):
        assert out[i].split("\n") == [x for x in rows[i][1].split("\n") if x not in passage]


def test_a_run_that_overlaps_itself_keeps_its_first_occurrence(spark):
    rows = [(1, "a b c\n" * 40)]
    (out,) = line_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert 2 <= out["text"].count("a b c") < 40


def test_lines_without_words_around_repeated_runs(spark):
    rng = random.Random(7)
    fresh = lambda k, w: [" ".join(f"w{rng.randrange(10**6)}" for _ in range(w)) for _ in range(k)]
    passage = [x for line in fresh(8, 9) for x in (line, *rng.choices(["", " ", "\t"], k=rng.randrange(3)))]
    rows = []
    for i in range(10):
        blank = lambda: rng.choices(["", " ", ""], k=rng.randrange(6))
        rows.append((i, "\n".join([*fresh(2, 5), *blank(), *passage, *blank(), *fresh(2, 5)])))
    out = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert out == brute(rows)


def test_digests_are_equal_for_equal_bytes_alone():
    rng = random.Random(8)
    words = [" ".join(f"w{rng.randrange(2)}" for _ in range(17)) for _ in range(2)]
    texts = ["\n".join(rng.choices([*words, "", " "], k=60)) for _ in range(40)]
    by_bytes, by_digest = {}, {}
    for t in steps(pa.array(texts)):
        at = line_dedup._Lines(t)
        b, e, _ = line_dedup._windows(t, at)
        some = np.array([rng.random() < 0.7 for _ in b])
        for lo, hi, digest in zip(b[some], e[some], line_dedup._digests(t, at, b[some], e[some]), strict=True):
            body = t.buf[at.starts[lo] : at.bare[hi]].tobytes()
            by_bytes.setdefault(body, set()).add(digest)
            by_digest.setdefault(digest, set()).add(body)
    assert len(by_bytes) > 100 and all(len(x) == 1 for x in (*by_bytes.values(), *by_digest.values()))


def test_windows_over_many_lines_without_words_take_linear_time():
    body = "\n".join(" ".join(f"w{7 * i + j}" for j in range(7)) for i in range(50))

    def seconds(n):
        t = next(steps(pa.array(["\n" * n + body])))
        at, start = line_dedup._Lines(t), time.perf_counter()
        b, e, _ = line_dedup._windows(t, at)
        assert len(b) > n and len(set(line_dedup._digests(t, at, b, e))) == len(b)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(400_000) < 5
