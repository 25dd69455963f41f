"""Draws and intervals against numpy's generator itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.operators import individual, streams
from dosewise.plans.queries import FOCAL, QUERIES, checkpointed, own_frame, pooled_frame, stats_of
from dosewise.sources.star import panel


@pytest.fixture(scope="module", autouse=True)
def folder(spark):
    checkpointed(spark)


@pytest.mark.parametrize("position", [0, 1, 2, 7, 1000, 65537])
def test_generator_jumps(position):
    whole = np.random.default_rng(42).integers(0, 1 << 32, position + 9, dtype=np.uint32)
    assert (streams.generator(42, position).integers(0, 1 << 32, 9, dtype=np.uint32) == whole[position:]).all()


@pytest.mark.parametrize("n", [3, 4002, 70_000, 3_000_000_000])
def test_accepted_equals_integers(n):
    """Three billions refuse more than every fourth number."""
    raw = np.random.default_rng(7).integers(0, 1 << 32, 4000, dtype=np.uint32)
    got = streams.accepted(raw, n)[0]
    assert (got == np.random.default_rng(7).integers(0, n, len(got))).all() and (n < 1 << 31 or len(got) < 3500)


def test_replicates_equal_numpy(spark):
    """Frames of one stretch and of several, which replicates straddle."""
    frames = spark.createDataFrame([("a", 777), ("b", 1), ("c", 2), ("d", 90_000)], "frame string, n long")
    for reps, names in ((30, "abc"), (3, "d")):
        some = frames.where(F.col("frame").isin(*names))
        got = {f: np.zeros((reps, n)) for f, n in some.collect()}
        for r in streams.replicate_draws(some, reps, 43).collect():
            got[r["frame"]][r["rep"], r["ord"]] += r["times"]
        for f, counts in got.items():
            rng, n = np.random.default_rng(43), counts.shape[1]
            for rep in range(reps):
                assert (counts[rep] == np.bincount(rng.integers(0, n, n), minlength=n)).all(), (f, rep)


def test_choices_equal_numpy(spark):
    """Populations in their declared order, all levels of one before the next; a level above a size is skipped, one equal to it is a permutation."""
    sizes = {"z": 30, "y": 8, "x": 5, "w": 12, "one": 1}
    rows = [(100 * k + i * 3, name, k) for k, (name, n) in enumerate(sizes.items()) for i in range(n)] + [(9999, None, 1)]
    samples = spark.createDataFrame(rows, "sample_idx long, population string, pop_ord long").repartition(5)
    rng, want = np.random.default_rng(42), {}
    for name, n in sizes.items():
        ids = np.array(sorted(r[0] for r in rows if r[1] == name))
        for level in (1, 5, 8, 20):
            for rep in range(25 if level <= n else 0):
                want[name, level, rep] = sorted(ids[rng.choice(n, level, replace=False)].tolist())
    got = {}
    for r in streams.choices(samples, [1, 5, 8, 20], 25, order="pop_ord").collect():
        got.setdefault((r["population"], r["level"], r["rep"]), []).append(r["sample_idx"])
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("n,k", [(1, 1), (5, 5), (9, 2), (12_000, 3), (12_000, 900), (10_001, 10_001)])
def test_expected_numbers(n, k):
    rng = np.random.default_rng(3)
    rng.choice(n, k, replace=False)
    assert streams._used(3, 0, rng, streams.expected(n, k)) - streams.expected(n, k) in (0, 1)


def test_refused_numbers_move_later_calls(spark, monkeypatch):
    """With a rule that says one number too few, every call begins at the wrong place at first."""
    samples = spark.range(40).select(F.col("id").alias("sample_idx"), F.lit("p").alias("population"))
    real = F.expr
    monkeypatch.setattr(streams.F, "expr", lambda text: real(text) - 1 if text.startswith("CASE WHEN size > 10000") else real(text))
    got = {}
    for r in streams.choices(samples, [6], 4).collect():
        got.setdefault(r["rep"], set()).add(r["sample_idx"])
    rng = np.random.default_rng(42)
    assert got == {rep: set(rng.choice(40, 6, replace=False).tolist()) for rep in range(4)}


def test_fis_and_fst_intervals(spark, tiny):
    p = panel(spark, tiny)
    loci = [r[0] for r in p.loci.select("locus_idx").orderBy("locus_idx").collect()]
    stats = stats_of(p).select("population", "locus_idx", "b", "c").toPandas()
    rng = np.random.default_rng(42)
    w = np.array([np.bincount(rng.integers(0, len(loci), len(loci)), minlength=len(loci)) for _ in range(1000)])
    rows = {r["population"]: r for r in QUERIES["fis_interval"](spark, tiny).collect()}
    for name, g in stats.groupby("population"):
        g = g.set_index("locus_idx").reindex(loci).fillna(0)
        with np.errstate(all="ignore"):
            theta = (w @ g["b"].to_numpy()) / (w @ (g["b"] + g["c"]).to_numpy())
        theta = theta[np.isfinite(theta)]
        if len(theta):
            assert [rows[name]["lo"], rows[name]["hi"]] == pytest.approx(list(np.percentile(theta, [2.5, 97.5])), abs=2e-6)
        else:
            assert rows[name]["lo"] is None
    assert QUERIES["fst_interval"](spark, tiny).count() == 300


@pytest.mark.parametrize("which,seed", [("own", 42), ("pooled", 43)])
def test_individual_intervals(spark, tiny, which, seed):
    p = panel(spark, tiny)
    members, frame = own_frame(p) if which == "own" else pooled_frame(p)
    got = {(r["frame"], r["sample_idx"]): (r["lo"], r["hi"]) for r in streams.f_uni_interval(p.geno, members, frame, 200, seed).collect()}
    assert len(got) == members.join(frame.select("frame").distinct(), "frame").count()
    cells = {(r["sample_idx"], r["locus_idx"]): r["dose"] for r in p.geno.collect()}
    fr = frame.toPandas()
    names = sorted(set(fr["frame"]))[:3] if which == "own" else ["others"]
    for name in names:
        f = fr[fr["frame"] == name].sort_values("locus_idx")
        rng, n = np.random.default_rng(seed), len(f)
        w = np.array([np.bincount(rng.integers(0, n, n), minlength=n) for _ in range(200)])
        for s in [k[1] for k in got if k[0] == name][:12]:
            g = np.array([np.nan if (d := cells.get((s, x), 0)) is None else d for x in f["locus_idx"]], float)
            q = f["p"].to_numpy()
            each = (g * g - (1 + 2 * q) * g + 2 * q * q) / (2 * q * (1 - q))
            theta = (w @ np.nan_to_num(each)) / (w @ (~np.isnan(each)))
            assert got[name, s] == pytest.approx(tuple(np.percentile(theta, [2.5, 97.5])), abs=1e-9)


def test_queries_run(spark, tiny):
    rows = QUERIES["matched_n_null_published"](spark, tiny).collect()
    assert {r["measure"] for r in rows} == {"kinship", "f_uni"}
    rows = QUERIES["rarefaction_published"](spark, tiny).collect()
    assert rows and all(r["ho_mean"] is not None for r in rows)
    assert FOCAL


def test_focal_kinship_published_equals_numpy(spark, tiny):
    """The focal group's pairs against those of numpy's own draws within every other population that has as many samples."""
    p = panel(spark, tiny)
    geno = {(r["sample_idx"], r["locus_idx"]): r["dose"] for r in p.geno.collect()}
    samples = p.samples.select("sample_idx", "population", "pop_ord").collect()
    loci = sorted(r[0] for r in p.loci.select("locus_idx").collect())
    names = sorted({(r["pop_ord"], r["population"]) for r in samples})

    def pairs(ids):
        g = np.array([[geno.get((s, x), 0) for x in loci] for s in ids], dtype=float)  # None, a missing call, is NaN
        n = np.isfinite(g).sum(0)
        f = np.nansum(g, 0) / np.where(n > 0, 2 * n, np.nan)
        use = (f > 0) & (f < 1)
        z = np.nan_to_num((g[:, use] - 2 * f[use]) / np.sqrt(2 * f[use] * (1 - f[use])))
        k = z @ z.T / use.sum() if use.any() else np.zeros((0, 0))
        return k[np.triu_indices(len(ids), 1)] if use.any() else np.zeros(0)

    members = {name: np.array(sorted(r["sample_idx"] for r in samples if r["population"] == name)) for _, name in names}
    size, rng, null = len(members[FOCAL]), np.random.default_rng(42), []
    for _, name in names:
        for _ in range(200 if name != FOCAL and len(members[name]) >= size else 0):
            null.append(pairs(np.sort(members[name][rng.choice(len(members[name]), size, replace=False)])))
    mine, null = pairs(members[FOCAL]), np.concatenate(null)
    want = {
        "n_pairs": len(mine), "mean": mine.mean(), "least": mine.min(), "largest": mine.max(), "n_above_p95": (mine > np.percentile(null, 95)).sum(), "n_above_null": (mine > null.max()).sum(),
        "n_above_0125": (mine > 0.125).sum(), "n_above_025": (mine > 0.25).sum(), "null_n": len(null), "null_mean": null.mean(), "null_sd": null.std(ddof=1), "p_largest": (null >= mine.max() - 1e-9).mean(),
    }
    got = QUERIES["focal_kinship_published"](spark, tiny).first().asDict()
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=2e-6), k


def test_published_table_has_numpys_intervals(spark, tiny):
    rows = {r["population"]: r.asDict() for r in QUERIES["diversity_table_published"](spark, tiny).collect()}
    ends = {r["population"]: r for r in QUERIES["fis_interval"](spark, tiny).collect()}
    plain = {r["population"]: r.asDict() for r in QUERIES["diversity_by_population"](spark, tiny).collect()}
    assert rows.keys() == ends.keys() == plain.keys() and all(len(r) == 18 for r in rows.values())
    for name, r in rows.items():
        assert (r["fis_boot_lo"], r["fis_boot_hi"]) == (ends[name]["lo"], ends[name]["hi"])
        assert all(r[k] == v for k, v in plain[name].items() if k != "n")


def test_intervals_in_chunks_of_any_size(spark, tiny, monkeypatch):
    p = panel(spark, tiny)
    rows = lambda: {tuple(r) for r in streams.f_uni_interval(p.geno, *own_frame(p), 20).select("frame", "sample_idx", F.round("lo", 9), F.round("hi", 9)).collect()}
    want = rows()
    monkeypatch.setattr(streams, "CHUNK", 3)
    monkeypatch.setattr(streams, "LISTED", 16)
    assert rows() == want and len(want) > 100
