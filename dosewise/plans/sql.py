"""The queries in DuckDB's SQL, from the supplied tables."""

from __future__ import annotations

from dosewise.plans import queries as q

SAMPLES = """samples AS (
  SELECT c_custkey AS sample_idx, n_name AS population, r_name AS region, n_nationkey AS pop_ord, c_name,
         CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'M' WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN 'F' ELSE 'unknown' END AS sex,
         CASE WHEN c_acctbal < 0 THEN 'batch_b' ELSE 'batch_a' END AS batch, 'all' AS panel, CASE WHEN n_name = 'NATION_0' THEN 'focal' ELSE 'rest' END AS side
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
LOCI = """loci AS (
  SELECT p_partkey AS locus_idx, CAST(floor(p_partkey / 2) AS BIGINT) AS clone_id, p_brand AS scaffold, p_type AS refseq, p_size AS aln_cnt, p_retailprice AS rep_score FROM part)"""
GENO = """geno AS MATERIALIZED (
  SELECT o_custkey AS sample_idx, l_partkey AS locus_idx,
         CASE WHEN max(CASE WHEN l_returnflag = 'R' AND l_tax >= 0.08 AND l_quantity >= 45 THEN 1 ELSE 0 END) = 1 THEN NULL ELSE least(count(*), 2) END AS dose
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey)"""


def stats(name: str = "st", group: str = "population", of: str = "samples") -> str:
    return f"""{name}_n AS (
  SELECT z.{group}, z.ord, l.locus_idx, z.size - coalesce(c.missing, 0) AS n, CAST(coalesce(c.alt, 0) AS BIGINT) AS alt, CAST(coalesce(c.het, 0) AS BIGINT) AS het
  FROM (SELECT {group}, count(*) AS size, {'min(pop_ord)' if group == 'population' else f'min({group})'} AS ord FROM {of} GROUP BY {group}) z CROSS JOIN loci l
  LEFT JOIN (SELECT s.{group}, locus_idx, sum(dose) AS alt, count(*) FILTER (dose = 1) AS het, count(*) FILTER (dose IS NULL) AS missing FROM geno JOIN {of} s USING (sample_idx) GROUP BY ALL) c
    ON c.{group} = z.{group} AND c.locus_idx = l.locus_idx),
{name}_p AS (SELECT *, alt / nullif(2.0::DOUBLE * n, 0) AS p, het / nullif(n::DOUBLE, 0) AS ho FROM {name}_n),
{name} AS MATERIALIZED (
  SELECT *, 2 * p * (1 - p) AS he_hw, CASE WHEN n > 1 THEN 2.0::DOUBLE * n / (2 * n - 1) * 2 * p * (1 - p) END AS he_unb,
         CASE WHEN n > 1 THEN n / (n - 1.0::DOUBLE) * (p * (1 - p) - (2 * n - 1) / (4.0::DOUBLE * n) * ho) END AS b, CASE WHEN n > 1 THEN ho / 2 END AS c, p > 0 AND p < 1 AS poly, least(p, 1 - p) AS maf
  FROM {name}_p)"""


CALLS = """calls AS (
  SELECT locus_idx, size - coalesce(het, 0) - coalesce(hom, 0) - coalesce(missing, 0) AS n0, coalesce(het, 0) AS n1, coalesce(hom, 0) AS n2, size - coalesce(missing, 0) AS called,
         (size - coalesce(missing, 0)) / size::DOUBLE AS call_rate, coalesce(alt, 0) / (2.0::DOUBLE * (size - coalesce(missing, 0))) AS p
  FROM loci CROSS JOIN (SELECT count(*) AS size FROM samples)
  LEFT JOIN (SELECT locus_idx, sum(dose) AS alt, count(*) FILTER (dose = 1) AS het, count(*) FILTER (dose = 2) AS hom, count(*) FILTER (dose IS NULL) AS missing FROM geno GROUP BY 1) USING (locus_idx))"""
DIVERSITY = """max(n) AS n, count(*) AS n_loci, avg(ho) AS ho, stddev_samp(ho) / sqrt(count(ho)) AS ho_se, avg(he_unb) AS he_unbiased, stddev_samp(he_unb) / sqrt(count(he_unb)) AS he_se, avg(he_hw) AS he_hw,
  sum(b) / nullif(sum(b + c), 0) AS fis_wc, count(*) FILTER (poly) AS n_polymorphic, avg(poly::INT) AS prop_polymorphic, avg(maf) FILTER (poly) AS mean_folded_maf"""


def made(ctes: list[str], body: str, columns: str) -> str:
    """columns: names, with :d for doubles rounded as the queries are, :i for integers."""
    shown = {"d": "CASE WHEN abs({0}) < 5e-7 THEN 0.0::DOUBLE ELSE round(round(({0})::DOUBLE, 12), 6) END AS {0}", "i": "CAST({0} AS BIGINT) AS {0}", "": "{0}"}
    listed = ", ".join(shown[k].format(name) for name, _, k in (c.partition(":") for c in columns.split()))
    return ("WITH " + ",\n".join(ctes) if ctes else "") + f"\nSELECT {listed} FROM ({body}) AS body"


def erfc(x: str) -> str:
    """For x from 0; beyond 6 it is as at 6."""
    return f"(CASE WHEN {x} <= 0 THEN 1.0::DOUBLE ELSE 1 - exp(-(least({x}, 6.0::DOUBLE) ** 2)) * list_sum(list_transform(range(0, 300), lambda k: exp((2 * k + 1) * ln(least({x}, 6.0::DOUBLE)) - lgamma(k + 1.5)))) END)"


def hashed(*parts: object) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(map(str, parts))})), 1, 8))::BIGINT"


def richness(g: str) -> str:
    """Of st; C(2n - k, g) / C(2n, g) by log gamma."""
    share = lambda k: f"CASE WHEN 2 * n - {k} < {g} THEN 0.0::DOUBLE ELSE exp(lgamma(2 * n - {k} + 1) - lgamma(2 * n - {k} - {g} + 1) - lgamma(2 * n + 1) + lgamma(2 * n - {g} + 1)) END"
    return f"CASE WHEN 2 * n >= {g} THEN 2 - {share('alt')} - {share('(2 * n - alt)')} END"


def weights(reps: int) -> str:
    return f"""ord AS (SELECT locus_idx, row_number() OVER (ORDER BY locus_idx) - 1 AS k, count(*) OVER () AS many FROM loci),
weights AS MATERIALIZED (
  SELECT rep, o.locus_idx, count(*) AS w FROM (SELECT r.range AS rep, {hashed(42, 'r.range', 'd.k')} % d.many AS pick FROM range({reps}) r CROSS JOIN ord d) JOIN ord o ON o.k = pick GROUP BY ALL)"""


def draws(k: int, name: str = "draws") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT population, sample_idx, population || ':' || rep AS draw FROM (
    SELECT population, sample_idx, rep, row_number() OVER (PARTITION BY population, rep ORDER BY {hashed(42, k, 'rep', 'sample_idx')}, sample_idx) AS r, count(*) OVER (PARTITION BY population, rep) AS size
    FROM samples CROSS JOIN (SELECT range AS rep FROM range({q.DRAWS}))) WHERE r <= {k} AND size >= {k})"""


PANEL = [SAMPLES, LOCI, GENO]
POP = [*PANEL, stats()]
JOINT = stats("jt", "panel")
WALK = f"""votes AS (SELECT scaffold, refseq, count(*) AS votes, min(locus_idx) AS seen FROM loci WHERE aln_cnt > 10 AND scaffold <> '' AND refseq <> '' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scaffold ORDER BY votes DESC, seen) AS r, sum(votes) OVER (PARTITION BY scaffold) AS total FROM votes),
walk AS (
  SELECT s.scaffold, coalesce(refseq, '') AS refseq_majority, votes / total::DOUBLE AS purity, coalesce(total, 0) AS n_anchor_loci,
         CASE WHEN refseq IS NULL THEN 'unanchored' WHEN refseq = '{q.SEX[0]}' THEN 'sex' WHEN starts_with(refseq, '{q.UNPLACED}') THEN 'unplaced' ELSE 'autosome' END AS class
  FROM (SELECT DISTINCT scaffold FROM loci WHERE scaffold <> '') s LEFT JOIN (FROM ranked WHERE r = 1) v ON v.scaffold = s.scaffold)"""
CHI = """CASE WHEN p > 0 AND p < 1 AND n > 1 THEN (n - het - (alt - het) / 2 - n * (1 - p) * (1 - p)) ** 2 / (n * (1 - p) * (1 - p)) + (het - 2 * n * p * (1 - p)) ** 2 / (2 * n * p * (1 - p))
  + ((alt - het) / 2 - n * p * p) ** 2 / (n * p * p) ELSE 0.0::DOUBLE END"""


def hwe(name: str = "hwe", of: str = "st", group: str = "population") -> str:
    tail = erfc("x")
    return f"""{name}_g AS (SELECT {group}, max(n) AS size FROM {of} GROUP BY 1 HAVING max(n) >= 19),
{name}_t AS (SELECT locus_idx, sqrt({CHI} / 2) AS x FROM {of} SEMI JOIN {name}_g USING ({group})),
{name}_a AS (SELECT 0.05::DOUBLE / greatest((SELECT count(DISTINCT locus_idx) FROM {name}_t) * (SELECT count(*) FROM {name}_g), 1) AS alpha),
{name} AS (SELECT locus_idx, count(*) AS tests, count(*) FILTER (x > 0.5 AND {tail} < alpha) AS failures FROM {name}_t CROSS JOIN {name}_a GROUP BY 1)"""


FLAGS = f"""flags AS MATERIALIZED (
  SELECT l.*, w.class, w.refseq_majority, c.call_rate, l.rep_score >= {q.LEAST_REP} AS pass_reproducible, l.aln_cnt >= {q.LEAST_ALN} AS pass_aligned, w.class <> 'sex' AS pass_autosome,
         c.call_rate >= {q.LEAST_CALL}::DOUBLE AS pass_call_rate, coalesce(h.failures, 0) < 2 AS pass_hwe
  FROM loci l JOIN walk w USING (scaffold) JOIN calls c USING (locus_idx) LEFT JOIN hwe h USING (locus_idx))"""
QUALITY = [*POP, WALK, CALLS, hwe(), FLAGS]
FINAL = f"""final AS (SELECT locus_idx FROM flags WHERE {' AND '.join(q.STEPS)} QUALIFY row_number() OVER (PARTITION BY clone_id ORDER BY call_rate DESC, rep_score DESC, locus_idx) = 1)"""
_so_far = [" AND ".join(q.STEPS[: i + 1]) for i in range(len(q.STEPS))]
CASCADE = "SELECT 0 AS step, 'input' AS name, count(*) AS standalone, count(*) AS cumulative FROM flags" + "".join(
    f" UNION ALL SELECT {i}, '{s}', count(*) FILTER ({s}), count(*) FILTER ({a}) FROM flags" for i, (s, a) in enumerate(zip(q.STEPS, _so_far, strict=True), 1)
)
PAIRS = """pairs AS (
  SELECT x.population AS population_i, y.population AS population_j, locus_idx, x.n::DOUBLE AS n1, y.n::DOUBLE AS n2, x.p AS p1, y.p AS p2, x.ho AS h1, y.ho AS h2
  FROM st x JOIN st y USING (locus_idx) WHERE x.ord < y.ord AND x.n > 0 AND y.n > 0),
mid AS (SELECT *, (n1 + n2) / 2 AS m, (n1 + n2) - (n1 * n1 + n2 * n2) / (n1 + n2) AS nc, (n1 * p1 + n2 * p2) / (n1 + n2) AS pm, (n1 * h1 + n2 * h2) / (n1 + n2) AS hm FROM pairs),
spread AS (SELECT *, (n1 * (p1 - pm) ** 2 + n2 * (p2 - pm) ** 2) / m AS s2 FROM mid),
abc AS (
  SELECT population_i, population_j, locus_idx, n1, n2, m / nc * (s2 - (pm * (1 - pm) - s2 / 2 - hm / 4) / nullif(m - 1, 0)) AS a,
         m / nullif(m - 1, 0) * (pm * (1 - pm) - s2 / 2 - (2 * m - 1) / (4 * m) * hm) AS b, hm / 2 AS c FROM spread),
fst AS (SELECT population_i, population_j, max(n1) AS n_i, max(n2) AS n_j, count(*) AS n_loci, sum(a) / nullif(sum(a + b + c), 0) AS fst_wc FROM abc GROUP BY 1, 2)"""


def frames(kind: str) -> list[str]:
    if kind == "own":
        return [*POP, "members AS (SELECT sample_idx, population AS frame FROM samples)", "frame AS (SELECT population AS frame, locus_idx, p, n FROM st WHERE poly)"]
    if kind == "pooled":
        return [*PANEL, "rest AS (SELECT * FROM samples WHERE population <> 'NATION_0')", stats("rs", "panel", "rest"), "members AS (SELECT sample_idx, 'others' AS frame FROM samples)", "frame AS (SELECT 'others' AS frame, locus_idx, p, n FROM rs WHERE poly)"]
    return [*PANEL, draws(q.N_FOCAL), stats("ds", "draw", "draws"), "members AS (SELECT sample_idx, draw AS frame FROM draws)", "frame AS (SELECT draw AS frame, locus_idx, p, n FROM ds WHERE poly)"]


DENSE = """dense AS (
  SELECT frame, m.sample_idx, f.locus_idx, p, n, CASE WHEN g.sample_idx IS NULL THEN 0 ELSE g.dose END AS g
  FROM members m JOIN frame f USING (frame) LEFT JOIN geno g ON g.sample_idx = m.sample_idx AND g.locus_idx = f.locus_idx)"""
UNI = "(g * g - (1 + 2 * p) * g + 2 * p * p) / (2 * p * (1 - p))"
F_ALL = f"""SELECT frame, sample_idx, count(g) AS n_loci,
  (count(*) FILTER (g <> 1) - sum(1 - 2 * p * (1 - p) * 2 * n / (2 * n - 1)) FILTER (g IS NOT NULL)) / nullif(count(g) - sum(1 - 2 * p * (1 - p) * 2 * n / (2 * n - 1)) FILTER (g IS NOT NULL), 0) AS f_hom,
  avg({UNI}) AS f_uni, avg((g - 2 * p) ** 2 / (2 * p * (1 - p))) - 1 AS f_grm FROM dense GROUP BY 1, 2"""
KIN = """zs AS MATERIALIZED (SELECT frame, sample_idx, locus_idx, coalesce((g - 2 * p) / sqrt(2 * p * (1 - p)), 0) AS z FROM dense),
kin AS (SELECT x.frame, x.sample_idx AS sample_i, y.sample_idx AS sample_j, avg(x.z * y.z) AS kinship, count(*) AS n_loci FROM zs x JOIN zs y USING (frame, locus_idx) WHERE x.sample_idx < y.sample_idx GROUP BY 1, 2, 3)"""
TAILS = ((0.05, "p5"), (0.5, "p50"), (0.95, "p95"), (0.99, "p99"), (0.999, "p99_9"))


def tails(x: str) -> str:
    return f"count({x}) AS n, " + ", ".join(f"quantile_cont({x}, {v}) AS {name}" for v, name in TAILS) + f", max({x}) AS most"


TAIL_COLUMNS = "n:i " + " ".join(f"{name}:d" for _, name in TAILS) + " most:d"
SUMMARY = "count(*) FILTER (poly) AS n_polymorphic, avg(maf) FILTER (poly) AS mean_maf"
DRAWN = [draws(q.N_FOCAL), stats("ds", "draw", "draws"), f"drawn AS (SELECT draw, split_part(draw, ':', 1) AS population, {SUMMARY} FROM ds GROUP BY 1, 2)"]


def spectrum_of(of: str, group: str) -> str:
    return f"""SELECT s.{group}, k.mac, coalesce(c.n_loci, 0) AS n_loci, coalesce(c.n_loci, 0) / nullif(s.total, 0)::DOUBLE AS share
  FROM (SELECT {group}, max(n) AS n, count(*) FILTER (poly) AS total FROM {of} GROUP BY 1) s JOIN (SELECT range AS mac FROM range(1, 100000)) k ON k.mac <= s.n
  LEFT JOIN (SELECT {group}, least(alt, 2 * n - alt) AS mac, count(*) AS n_loci FROM {of} WHERE poly GROUP BY 1, 2) c ON c.{group} = s.{group} AND c.mac = k.mac"""


RANKS = """vals AS (
  SELECT o.population AS other, true AS first, f.maf AS x FROM st f CROSS JOIN (SELECT DISTINCT population FROM st WHERE population <> 'NATION_0') o WHERE f.population = 'NATION_0' AND f.poly
  UNION ALL SELECT population, false, maf FROM st WHERE population <> 'NATION_0' AND poly)"""
CLASSES = """bp AS (SELECT locus_idx, bool_or(poly) FILTER (batch = 'batch_a') AS pa, bool_or(poly) FILTER (batch = 'batch_b') AS pb FROM bt GROUP BY 1),
fp AS (SELECT locus_idx, bool_or(poly) FILTER (side = 'focal') AS pf, bool_or(poly) FILTER (side = 'rest') AS pr, max(p) FILTER (side = 'focal') AS qf, max(p) FILTER (side = 'rest') AS qr FROM sd GROUP BY 1)"""
RULE = """firsts AS (SELECT clone_id, arg_min(refseq, locus_idx) AS a FROM loci GROUP BY 1), olds AS (SELECT clone_id, arg_max(refseq, locus_idx) AS o FROM loci WHERE aln_cnt <= 40 GROUP BY 1),
rule AS (SELECT locus_idx, CASE WHEN a = o THEN 'retained' ELSE 'lost' END AS locus_set FROM loci JOIN firsts USING (clone_id) LEFT JOIN olds USING (clone_id))"""
XY = "pts AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
DIV_COLUMNS = "population n:i n_loci:i ho:d ho_se:d he_unbiased:d he_se:d he_hw:d fis_wc:d n_polymorphic:i prop_polymorphic:d mean_folded_maf:d"
_edges = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(q.RING, [*q.RING[1:], q.RING[0]], strict=True))
_sets = " UNION ALL ".join(f"SELECT '{s}' AS locus_set, locus_idx FROM jt WHERE maf >= {f}::DOUBLE AND least(alt, 2 * n - alt) >= {c}" for s, f, c in q.SCENARIOS)


def rarefied(k: int) -> str:
    return f"""SELECT population, {k} AS level, {', '.join(f'avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_sd' for m in ('ho', 'he_unbiased', 'fis_wc', 'n_polymorphic', 'ar'))}
  FROM (SELECT split_part(draw, ':', 1) AS population, draw, avg(ho) AS ho, avg(he_unb) AS he_unbiased, sum(b) / nullif(sum(b + c), 0) AS fis_wc, count(*) FILTER (poly) AS n_polymorphic, avg({richness('8')}) AS ar FROM d{k} GROUP BY 1, 2) GROUP BY 1"""


SQL: dict[str, str] = {
    "diversity_by_population": made(POP, f"SELECT population, {DIVERSITY} FROM st GROUP BY 1", DIV_COLUMNS),
    "locus_statistics": made(POP, "FROM st", "population locus_idx:i n:i alt:i het:i p:d ho:d he_hw:d he_unb:d b:d c:d"),
    "call_rate": made([*PANEL, CALLS], "FROM calls", "locus_idx:i n0:i n1:i n2:i called:i call_rate:d p:d"),
    "encoding_check": made([*POP, CALLS], "SELECT measure, max(abs(d)) AS worst, 0 AS unmatched FROM (SELECT unnest(['p', 'call_rate']) AS measure, unnest([p - q, call_rate - r]) AS d FROM calls JOIN (SELECT locus_idx, sum(alt) / (2.0::DOUBLE * sum(n)) AS q, sum(n) / (SELECT count(*) FROM samples)::DOUBLE AS r FROM st GROUP BY 1) USING (locus_idx)) GROUP BY 1", "measure worst:d unmatched:i"),
    "fis_jackknife": made(POP, "SELECT population, max(bs) / max(ds) AS fis_wc, sqrt((count(theta) - 1) * var_pop(theta)) AS fis_jack_se FROM (SELECT population, bs, ds, (bs - b) / nullif(ds - b - c, 0) AS theta FROM (SELECT population, b, c, sum(b) OVER w AS bs, sum(b + c) OVER w AS ds FROM st WINDOW w AS (PARTITION BY population))) GROUP BY 1", "population fis_wc:d fis_jack_se:d"),
    "fis_bootstrap": made([*POP, weights(q.REPS)], "SELECT population, quantile_cont(t, 0.025) AS lo, quantile_cont(t, 0.975) AS hi FROM (SELECT population, rep, sum(w * b) / nullif(sum(w * (b + c)), 0) AS t FROM st JOIN weights USING (locus_idx) GROUP BY 1, 2) GROUP BY 1", "population lo:d hi:d"),
    "allelic_richness_g16": made(POP, f"SELECT population, 16 AS g, avg(a) AS ar, stddev_samp(a) / sqrt(count(a)) AS ar_se, count(a) AS n_loci FROM (SELECT population, {richness('16')} AS a FROM st) GROUP BY 1", "population g:i ar:d ar_se:d n_loci:i"),
    "allelic_richness_curve": made(POP, f"SELECT population, g, avg(a) AS ar, stddev_samp(a) / sqrt(count(a)) AS ar_se, count(a) AS n_loci FROM (SELECT population, g, {richness('g')} AS a FROM st CROSS JOIN (SELECT range AS g FROM range(2, 17, 2))) GROUP BY 1, 2", "population g:i ar:d ar_se:d n_loci:i"),
    "focal_ratios": made([*POP, f"dv AS (SELECT population, {DIVERSITY} FROM st GROUP BY 1)", "lg AS (" + " UNION ALL ".join(f"SELECT population, '{m}' AS measure, {m} AS x FROM dv" for m in ("ho", "he_unbiased", "mean_folded_maf")) + ")"], "SELECT measure, max(x) FILTER (population = 'NATION_0') AS focal, avg(x) FILTER (population <> 'NATION_0') AS others_mean, 100 * max(x) FILTER (population = 'NATION_0') / avg(x) FILTER (population <> 'NATION_0') AS pct_of_others, max(x) FILTER (population = 'NATION_0') = min(x) AS is_lowest FROM lg GROUP BY 1", "measure focal:d others_mean:d pct_of_others:d is_lowest"),
    "scaffold_crosswalk": made([LOCI, WALK], "SELECT scaffold, refseq_majority, CASE WHEN class IN ('unanchored', 'unplaced') THEN class ELSE refseq_majority END AS chrom_label, purity, n_anchor_loci, class FROM walk", "scaffold refseq_majority chrom_label purity:d n_anchor_loci:i class"),
    "crosswalk_confusion": made([LOCI, WALK], f"SELECT *, (sex_sex + auto_auto) / (sex_sex + sex_auto + auto_sex + auto_auto)::DOUBLE AS agreement FROM (SELECT count(*) FILTER (d AND c) AS sex_sex, count(*) FILTER (d AND NOT c) AS sex_auto, count(*) FILTER (NOT d AND c) AS auto_sex, count(*) FILTER (NOT d AND NOT c) AS auto_auto FROM (SELECT refseq = '{q.SEX[0]}' AS d, class = 'sex' AS c FROM loci JOIN walk USING (scaffold) WHERE class <> 'unanchored' AND aln_cnt > 10))", "sex_sex:i sex_auto:i auto_sex:i auto_auto:i agreement:d"),
    "one_snp_per_clone": made([*PANEL, CALLS], "SELECT locus_idx, clone_id, rep_score, call_rate FROM loci JOIN calls USING (locus_idx) QUALIFY row_number() OVER (PARTITION BY clone_id ORDER BY call_rate DESC, rep_score DESC, locus_idx) = 1", "locus_idx:i clone_id:i rep_score:d call_rate:d"),
    "hwe_fail_counts": made([*POP, hwe()], "FROM hwe", "locus_idx:i tests:i failures:i"),
    "hwe_sensitivity": made([*POP, hwe(), JOINT, hwe("hj", "jt", "panel")], "SELECT count(*) FILTER (x.failures >= 2) AS fail_by_group, count(*) FILTER (y.failures >= 1) AS fail_joint, count(*) FILTER (x.failures >= 2 AND y.failures >= 1) AS fail_both FROM hwe x FULL JOIN hj y USING (locus_idx)", "fail_by_group:i fail_joint:i fail_both:i"),
    "sexlinked_flag": made([*PANEL, stats("sx", "sex")], "SELECT locus_idx, h_f, h_m, coalesce(n_f >= 20 AND n_m >= 20 AND h_f > 0.05 AND h_m < 0.1::DOUBLE * h_f, false) AS sex_linked FROM (SELECT locus_idx, max(ho) FILTER (sex = 'F') AS h_f, max(ho) FILTER (sex = 'M') AS h_m, max(n) FILTER (sex = 'F') AS n_f, max(n) FILTER (sex = 'M') AS n_m FROM sx GROUP BY 1)", "locus_idx:i h_f:d h_m:d sex_linked"),
    "sample_selection": made([], "SELECT sample_idx, population, reason IN ('focal', 'mainland') AS include, reason FROM (SELECT c_custkey AS sample_idx, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'CONSTRUCTION' ELSE c_mktsegment END AS population, CASE WHEN c_name IN ('Customer#000000003', 'Customer#000000005') THEN 'excluded' WHEN regexp_matches(c_name, '^Customer#0000000[0-9]{2}$') THEN 'focal' WHEN c_mktsegment = 'FURNITURE' THEN 'no population' ELSE 'mainland' END AS reason FROM customer)", "sample_idx:i population include reason"),
    "duplicate_ids": made([], "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", "l_orderkey:i l_partkey:i n:i"),
    "filter_cascade": made(QUALITY, CASCADE, "step:i name standalone:i cumulative:i"),
    "cascade_deltas": made([*QUALITY, f"cas AS ({CASCADE})"], "SELECT *, lag(cumulative) OVER (ORDER BY step) - cumulative AS removed, 100 * (lag(cumulative) OVER (ORDER BY step) - cumulative) / nullif(lag(cumulative) OVER (ORDER BY step), 0)::DOUBLE AS pct_removed FROM cas", "step:i name standalone:i cumulative:i removed:i pct_removed:d"),
    "locus_audit_table": made([*QUALITY, FINAL, JOINT], "SELECT f.*, j.n, j.p, j.ho, j.he_unb, final.locus_idx IS NOT NULL AS final FROM flags f JOIN jt j USING (locus_idx) LEFT JOIN final USING (locus_idx)", "locus_idx:i clone_id:i scaffold class refseq_majority call_rate:d n:i p:d ho:d he_unb:d " + " ".join(q.STEPS) + " final"),
    "fst_pairwise": made([*POP, PAIRS], "FROM fst", "population_i population_j n_i:i n_j:i n_loci:i fst_wc:d"),
    "gst_pairwise": made([*POP, PAIRS], "SELECT *, CASE WHEN ht > 0 THEN (ht - hs) / ht END AS gst_nei, CASE WHEN 2 * ht - hs > 0 AND hs < 1 THEN 2 * (ht - hs) / ((2 * ht - hs) * (1 - hs)) END AS gstpp_hedrick FROM (SELECT population_i, population_j, avg(hs) AS hs, avg(1 - pb ** 2 - (1 - pb) ** 2 + hs / (2 * nt) - hb / (4 * nt)) AS ht FROM (SELECT *, nt / nullif(nt - 1, 0) * ((2 - p1 ** 2 - (1 - p1) ** 2 - p2 ** 2 - (1 - p2) ** 2) / 2 - hb / (2 * nt)) AS hs FROM (SELECT *, 2 / (1 / n1 + 1 / n2) AS nt, (h1 + h2) / 2 AS hb, (p1 + p2) / 2 AS pb FROM pairs)) GROUP BY 1, 2)", "population_i population_j hs:d ht:d gst_nei:d gstpp_hedrick:d"),
    "fst_matrix": made([*POP, PAIRS, "bo AS (SELECT population_i AS name, population_j AS o, fst_wc AS x FROM fst UNION ALL SELECT population_j, population_i, fst_wc FROM fst UNION ALL SELECT population, population, 0.0 FROM (SELECT DISTINCT population FROM st))"], "SELECT name, " + ", ".join(f"max(x) FILTER (o = '{n}') AS {n}" for n in q.NATIONS) + " FROM bo GROUP BY 1", "name " + " ".join(f"{n}:d" for n in q.NATIONS)),
    "fst_focal_summary": made([*POP, PAIRS, "fr AS (SELECT population_i || '-' || population_j AS pair, CASE WHEN population_i = 'NATION_0' OR population_j = 'NATION_0' THEN 'focal' ELSE 'others' END AS side, round(fst_wc, 9) AS x FROM fst)"], "SELECT side, count(*) AS n_pairs, avg(x) AS mean, min(x) AS least, arg_min(pair, (x, pair)) AS least_pair, max(x) AS most, arg_max(pair, (x, pair)) AS most_pair FROM fr GROUP BY 1", "side n_pairs:i mean:d least:d least_pair most:d most_pair"),
    "fst_bootstrap": made([*POP, PAIRS, weights(q.REPS)], "SELECT population_i, population_j, quantile_cont(t, 0.025) AS lo, quantile_cont(t, 0.975) AS hi FROM (SELECT population_i, population_j, rep, sum(w * a) / nullif(sum(w * (a + b + c)), 0) AS t FROM abc JOIN weights USING (locus_idx) GROUP BY 1, 2, 3) GROUP BY 1, 2", "population_i population_j lo:d hi:d"),
    "individual_ho": made(PANEL, "SELECT sample_idx, (SELECT count(*) FROM loci) - coalesce(m, 0) AS n_loci, coalesce(h, 0) / ((SELECT count(*) FROM loci) - coalesce(m, 0))::DOUBLE AS ho FROM samples LEFT JOIN (SELECT sample_idx, count(*) FILTER (dose = 1) AS h, count(*) FILTER (dose IS NULL) AS m FROM geno GROUP BY 1) USING (sample_idx)", "sample_idx:i n_loci:i ho:d"),
    "smlh": made([*PANEL, "hs AS (SELECT sample_idx, coalesce(h, 0) / ((SELECT count(*) FROM loci) - coalesce(m, 0))::DOUBLE AS ho FROM samples LEFT JOIN (SELECT sample_idx, count(*) FILTER (dose = 1) AS h, count(*) FILTER (dose IS NULL) AS m FROM geno GROUP BY 1) USING (sample_idx))"], "SELECT sample_idx, ho, ho / avg(ho) OVER () AS smlh FROM hs", "sample_idx:i ho:d smlh:d"),
    "individual_f_own": made([*frames("own"), DENSE], F_ALL, "frame sample_idx:i n_loci:i f_hom:d f_uni:d f_grm:d"),
    "individual_f_pooled": made([*frames("pooled"), DENSE], F_ALL, "frame sample_idx:i n_loci:i f_hom:d f_uni:d f_grm:d"),
    "individual_f_bootstrap": made([*frames("own"), DENSE, weights(q.F_REPS)], f"SELECT frame, sample_idx, quantile_cont(t, 0.025) AS lo, quantile_cont(t, 0.975) AS hi FROM (SELECT frame, sample_idx, rep, sum(w * {UNI}) / sum(w) FILTER (g IS NOT NULL) AS t FROM dense JOIN weights USING (locus_idx) GROUP BY 1, 2, 3) GROUP BY 1, 2", "frame sample_idx:i lo:d hi:d"),
    "kinship_pairs": made([*frames("own"), DENSE, KIN], "FROM kin", "frame sample_i:i sample_j:i kinship:d n_loci:i"),
    "kinship_summary": made([*frames("own"), DENSE, KIN], "SELECT frame, count(*) AS n_pairs, avg(kinship) AS mean, stddev_samp(kinship) AS sd, min(kinship) AS least, max(kinship) AS most, count(*) FILTER (kinship > 0.125) AS n_above_0125, count(*) FILTER (kinship > 0.25) AS n_above_025 FROM kin GROUP BY 1", "frame n_pairs:i mean:d sd:d least:d most:d n_above_0125:i n_above_025:i"),
    "kinship_individual": made([*frames("own"), DENSE, KIN], "SELECT frame, s AS sample_idx, avg(kinship) AS mean_kinship, max(kinship) AS max_kinship FROM (SELECT frame, sample_i AS s, kinship FROM kin UNION ALL SELECT frame, sample_j, kinship FROM kin) GROUP BY 1, 2", "frame sample_idx:i mean_kinship:d max_kinship:d"),
    "empirical_null": made([*frames("own"), DENSE, KIN], f"SELECT {tails('kinship')} FROM kin WHERE frame <> 'NATION_0'", TAIL_COLUMNS),
    "matched_n_null": made([*frames("draws"), DENSE, KIN, f"vals AS (SELECT split_part(frame, ':', 1) AS population, 'kinship' AS measure, kinship AS x FROM kin UNION ALL SELECT split_part(frame, ':', 1), 'f_uni', f_uni FROM ({F_ALL}))"], f"SELECT population, measure, {tails('x')} FROM vals GROUP BY 1, 2", "population measure " + TAIL_COLUMNS),
    "rarefaction": made([*POP, *[x for k in q.LEVELS for x in (draws(k, f"p{k}"), stats(f"d{k}", "draw", f"p{k}"))]], 'SELECT r.*, 100 * n_polymorphic_mean / nullif("full", 0) AS pct_of_full FROM (' + " UNION ALL ".join(map(rarefied, q.LEVELS)) + ') r JOIN (SELECT population, count(*) FILTER (poly) AS "full" FROM st GROUP BY 1) USING (population)', "population level:i pct_of_full:d " + " ".join(f"{m}_mean:d {m}_sd:d" for m in ("ho", "he_unbiased", "fis_wc", "n_polymorphic", "ar"))),
    "polymorphism_matched_n": made([*POP, *DRAWN], 'SELECT population, "full", matched, 100 * matched / nullif("full", 0) AS pct FROM (SELECT population, count(*) FILTER (poly) AS "full" FROM st GROUP BY 1) LEFT JOIN (SELECT population, avg(n_polymorphic) AS matched FROM drawn GROUP BY 1) USING (population)', 'population "full":i matched:d pct:d'),
    "folded_sfs": made(POP, spectrum_of("st", "population"), "population mac:i n_loci:i share:d"),
    "sfs_summary": made(POP, f"SELECT population, {SUMMARY}, median(maf) FILTER (poly) AS median_maf FROM st GROUP BY 1", "population n_polymorphic:i mean_maf:d median_maf:d"),
    "rarefied_sfs": made([*PANEL, *DRAWN], f"SELECT split_part(draw, ':', 1) AS population, mac, avg(n_loci) AS mean, quantile_cont(n_loci, 0.025) AS lo, quantile_cont(n_loci, 0.975) AS hi FROM ({spectrum_of('ds', 'draw')}) GROUP BY 1, 2", "population mac:i mean:d lo:d hi:d"),
    "empirical_p": made([*POP, *DRAWN], f"SELECT population, avg((round(mean_maf, 9) >= (SELECT round(avg(maf) FILTER (poly), 9) FROM st WHERE population = '{q.FOCAL}'))::INT) AS p FROM drawn GROUP BY 1", "population p:d"),
    "gap_decomposition": made([*POP, *DRAWN, "fm AS (SELECT population, avg(maf) FILTER (poly) AS f FROM st GROUP BY 1)"], "SELECT population, k - f AS gap, k - m AS matched_gap, 100 * (1 - (k - m) / nullif(k - f, 0)) AS pct_artefact FROM fm JOIN (SELECT population, avg(mean_maf) AS m FROM drawn GROUP BY 1) USING (population) CROSS JOIN (SELECT f AS k FROM fm WHERE population = 'NATION_0') WHERE population <> 'NATION_0'", "population gap:d matched_gap:d pct_artefact:d"),
    "ks_two_sample": made([*POP, RANKS], "SELECT other, n1, n2, d AS ks_d, CASE WHEN lam < 0.03 THEN 1.0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * k * k * lam * lam))), 0), 1) END AS ks_p FROM (SELECT *, (sqrt(n1 * n2 / (n1 + n2)::DOUBLE) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2)::DOUBLE)) * d AS lam FROM (SELECT other, max(n1) AS n1, max(n2) AS n2, max(abs(c1 / n1::DOUBLE - c2 / n2::DOUBLE)) AS d FROM (SELECT other, count(*) FILTER (first) OVER (PARTITION BY other) AS n1, count(*) FILTER (NOT first) OVER (PARTITION BY other) AS n2, count(*) FILTER (first) OVER w AS c1, count(*) FILTER (NOT first) OVER w AS c2 FROM vals WINDOW w AS (PARTITION BY other ORDER BY x RANGE UNBOUNDED PRECEDING)) GROUP BY 1))", "other n1:i n2:i ks_d:d ks_p:d"),
    "mann_whitney": made([*POP, RANKS, "rk AS (SELECT other, first, x, rank() OVER (PARTITION BY other ORDER BY x) + (count(*) OVER (PARTITION BY other, x) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY other, x)::DOUBLE AS t FROM vals)", "us AS (SELECT other, n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM (SELECT other, (count(*) FILTER (first))::DOUBLE AS n1, (count(*) FILTER (NOT first))::DOUBLE AS n2, sum(r) FILTER (first) AS r1, sum(t * t - 1) AS ties FROM rk GROUP BY 1))", "zs AS (SELECT *, CASE WHEN sd > 0 THEN (u - n1 * n2 / 2) / sd END AS z FROM us)"], f"SELECT other, n1, n2, u, z, {erfc('abs(z) / sqrt(2)')} AS p FROM zs", "other n1:i n2:i u:d z:d p:d"),
    "maf_sensitivity": made([*POP, JOINT, f"sets AS ({_sets})"], f"SELECT locus_set, population, {DIVERSITY} FROM st JOIN sets USING (locus_idx) GROUP BY 1, 2", "locus_set population n_loci:i ho:d he_unbiased:d fis_wc:d"),
    "callrate_sensitivity": made([*PANEL, CALLS], f"SELECT threshold, count(*) FILTER (call_rate >= threshold) AS n_loci, count(*) FILTER (call_rate >= threshold AND p > 0 AND p < 1) AS n_polymorphic FROM calls CROSS JOIN (SELECT unnest({[float(x) for x in q.CALL_RATES]}::DOUBLE[]) AS threshold) GROUP BY 1", "threshold:d n_loci:i n_polymorphic:i"),
    "bias_partition": made([*POP, RULE], f"SELECT b.*, 100 * (b.ho / nullif(d.ho, 0) - 1) AS ho_inflation_pct, 100 * (b.he_unbiased / nullif(d.he_unbiased, 0) - 1) AS he_unbiased_inflation_pct FROM (SELECT locus_set, population, {DIVERSITY} FROM st JOIN rule USING (locus_idx) GROUP BY 1, 2) b JOIN (SELECT population, {DIVERSITY} FROM st GROUP BY 1) d USING (population)", "population locus_set n_loci:i ho:d he_unbiased:d fis_wc:d n_polymorphic:i ho_inflation_pct:d he_unbiased_inflation_pct:d"),
    "locus_class_recovery": made([*QUALITY, FINAL, RULE, stats("bt", "batch"), stats("sd", "side"), CLASSES, "sets AS (SELECT locus_idx, 'input' AS locus_set FROM loci UNION ALL SELECT locus_idx, locus_set FROM rule UNION ALL SELECT locus_idx, 'final' FROM final)"], "SELECT locus_set, count(*) AS n_loci, count(*) FILTER (pa) AS poly_a, count(*) FILTER (pb) AS poly_b, count(*) FILTER (NOT pa AND pb) AS only_b, count(*) FILTER (pa AND NOT pb) AS only_a, count(*) FILTER (NOT pa AND NOT pb) AS mono_both, count(*) FILTER (NOT pr AND pf) AS only_focal, count(*) FILTER (pr AND NOT pf) AS only_rest, count(*) FILTER ((qf = 0 AND qr = 1) OR (qf = 1 AND qr = 0)) AS fixed_difference FROM sets JOIN bp USING (locus_idx) JOIN fp USING (locus_idx) GROUP BY 1", "locus_set n_loci:i poly_a:i poly_b:i only_b:i only_a:i mono_both:i only_focal:i only_rest:i fixed_difference:i"),
    "old_vs_new": made([*POP, "sa AS (SELECT * FROM samples WHERE batch = 'batch_a')", stats("so", "population", "sa")], f"SELECT population, {', '.join(f'a.{m}, b.{m} AS {m}_old, a.{m} - b.{m} AS {m}_delta, 100 * (a.{m} / nullif(b.{m}, 0) - 1) AS {m}_pct' for m in q.MEASURES)} FROM (SELECT population, {DIVERSITY} FROM st GROUP BY 1) a LEFT JOIN (SELECT population, {DIVERSITY} FROM so GROUP BY 1) b USING (population)", "population " + " ".join(f"{m}:d {m}_old:d {m}_delta:d {m}_pct:d" for m in q.MEASURES)),
    "conf_ellipse": made([XY], "SELECT label, n, x, y, CASE WHEN n >= 3 AND mi + ha > 0 THEN 2 * sqrt(5.991464547107979::DOUBLE * greatest(mi + ha, 0)) END AS width, CASE WHEN n >= 3 AND mi + ha > 0 THEN 2 * sqrt(5.991464547107979::DOUBLE * greatest(mi - ha, 0)) END AS height, CASE WHEN n >= 3 AND mi + ha > 0 THEN degrees(atan2(2 * cv, vx - vy) / 2) END AS angle FROM (SELECT *, (vx + vy) / 2 AS mi, sqrt(((vx - vy) / 2) ** 2 + cv ** 2) AS ha FROM (SELECT label, count(*) AS n, avg(x) AS x, avg(y) AS y, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS cv FROM pts GROUP BY 1))", "label:i n:i x:d y:d width:d height:d angle:d"),
    "centroids": made([XY], "SELECT label, count(*) AS n, avg(x) AS x, avg(y) AS y FROM pts WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1", "label:i n:i x:d y:d"),
    "nearest_cross_distance": made([XY], "SELECT min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS least FROM pts a CROSS JOIN pts b WHERE a.label = 0 AND b.label <> 0", "least:d"),
    "point_in_ring": made([XY, f"edges(xa, ya, xb, yb) AS (VALUES {_edges})"], 'SELECT vec_id, count(*) FILTER ((ya > y) <> (yb > y) AND x < (xb - xa) * (y - ya) / nullif(yb - ya, 0) + xa) % 2 = 1 AS inside FROM pts CROSS JOIN edges GROUP BY vec_id', "vec_id:i inside"),
    "bbox_filter": made([XY], f"SELECT label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts GROUP BY 1 HAVING max(x) >= {q.BOX[0]} AND min(x) <= {q.BOX[2]} AND max(y) >= {q.BOX[1]} AND min(y) <= {q.BOX[3]}", "label:i x0:d x1:d y0:d y1:d"),
    "assertion_ledger": made(PANEL, """SELECT name, value::VARCHAR AS value, expected, value = expected::BIGINT AS passed FROM (
  SELECT 'doses are 1, 2 or missing' AS name, (SELECT count(*) FROM geno WHERE dose NOT IN (1, 2)) AS value, '0' AS expected UNION ALL SELECT 'cells are unique', (SELECT count(*) FROM (SELECT 1 FROM geno GROUP BY sample_idx, locus_idx HAVING count(*) > 1)), '0'
  UNION ALL SELECT 'populations', (SELECT count(DISTINCT population) FROM samples), '25' UNION ALL SELECT 'loci are unique', (SELECT count(*) - count(DISTINCT locus_idx) FROM loci), '0' UNION ALL SELECT 'no call is missing', (SELECT count(*) FROM geno WHERE dose IS NULL), '0')""", "name value expected passed"),
}

OTHER_DRAWS = f"""draws AS MATERIALIZED (
  SELECT sample_idx, 'others:' || rep AS draw FROM (SELECT sample_idx, rep, row_number() OVER (PARTITION BY rep ORDER BY {hashed(42, q.N_FOCAL, 'rep', 'sample_idx')}, sample_idx) AS r
    FROM samples CROSS JOIN (SELECT range AS rep FROM range({q.DRAWS})) WHERE population <> '{q.FOCAL}') WHERE r <= {q.N_FOCAL})"""
OWN_FOCAL = [*POP, f"members AS (SELECT sample_idx, population AS frame FROM samples WHERE population = '{q.FOCAL}')", "frame AS (SELECT population AS frame, locus_idx, p, n FROM st WHERE poly)", DENSE, KIN, "fk AS (SELECT round(kinship, 9) AS x, kinship FROM kin)"]
NULLS = [OTHER_DRAWS, stats("ds", "draw", "draws"), "dense2 AS (SELECT draw AS frame, d.sample_idx, f.locus_idx, p, CASE WHEN g.sample_idx IS NULL THEN 0 ELSE g.dose END AS g FROM draws d JOIN (SELECT draw, locus_idx, p FROM ds WHERE poly) f USING (draw) LEFT JOIN geno g ON g.sample_idx = d.sample_idx AND g.locus_idx = f.locus_idx)",
  "zn AS MATERIALIZED (SELECT frame, sample_idx, locus_idx, coalesce((g - 2 * p) / sqrt(2 * p * (1 - p)), 0) AS z FROM dense2)", "nul AS MATERIALIZED (SELECT x.frame, avg(x.z * y.z) AS kinship FROM zn x JOIN zn y USING (frame, locus_idx) WHERE x.sample_idx < y.sample_idx GROUP BY x.frame, x.sample_idx, y.sample_idx)"]
JOINT_HWE = hwe("hj", "jt", "panel")
MODES = [*QUALITY, JOINT, JOINT_HWE, "flags2 AS MATERIALIZED (SELECT f.*, coalesce(j.failures, 0) < 1 AS pass_joint, class NOT IN ('unanchored', 'unaligned') AS pass_anchored FROM flags f LEFT JOIN hj j USING (locus_idx))"]


def cascaded(mode: str, unanchored: str) -> str:
    steps = [*q.STEPS[:2], *(["pass_anchored"] if unanchored == "drop" else []), *q.STEPS[2:]]
    column = lambda s: "pass_joint" if s == "pass_hwe" and mode == "joint" else s
    rows = [f"SELECT '{mode}' AS hwe_mode, '{unanchored}' AS unanchored, 0 AS step, 'input' AS name, count(*) AS standalone, count(*) AS cumulative FROM flags2"]
    rows += [f"SELECT '{mode}', '{unanchored}', {i}, '{s}', count(*) FILTER ({column(s)}), count(*) FILTER ({' AND '.join(map(column, steps[:i]))}) FROM flags2" for i, s in enumerate(steps, 1)]
    return " UNION ALL ".join(rows)


_not_call = " AND ".join(s for s in q.STEPS if s != "pass_call_rate")
_shift = lambda name, s: f"{name} AS (SELECT population, count(*) AS n, avg(he_unb) AS he FROM st JOIN (SELECT locus_idx FROM flags2 WHERE {s}) USING (locus_idx) GROUP BY 1)"
ROUNDED = "rf AS (SELECT population_i, population_j, round(fst_wc, 9) AS fst FROM fst)"
_label = "CASE WHEN fst IS NULL THEN NULL " + " ".join(f"WHEN fst < {v}::DOUBLE THEN '{n}'" for v, n in q.FST_STEPS) + " ELSE 'great' END"
_uni_rank = f"SELECT sample_idx, f_hom, f_uni, (SELECT count(*) FROM iv o WHERE o.population <> '{q.FOCAL}' AND o.x < iv.x) / (SELECT count(x) FROM iv WHERE population <> '{q.FOCAL}')::DOUBLE AS pct_rank, (SELECT count(*) FROM iv o WHERE o.population <> '{q.FOCAL}' AND o.x >= iv.x) AS n_reaching FROM iv WHERE population = '{q.FOCAL}'"

SQL |= {
    "focal_kinship_null": made([*OWN_FOCAL, *NULLS], "SELECT (SELECT count(*) FROM fk) AS n, (SELECT avg(kinship) FROM fk) AS mean, (SELECT avg(kinship) FROM nul) AS null_mean, (SELECT avg((round(x, 9) >= (SELECT round(avg(kinship), 9) FROM fk))::INT) FROM (SELECT frame, avg(kinship) AS x FROM nul GROUP BY 1)) AS p, (SELECT count(*) FROM fk WHERE x > (SELECT round(quantile_cont(kinship, 0.95), 9) FROM nul)) AS n_above_p95, (SELECT count(*) FROM fk WHERE x > (SELECT round(quantile_cont(kinship, 0.99), 9) FROM nul)) AS n_above_p99", "n:i mean:d null_mean:d p:d n_above_p95:i n_above_p99:i"),
    "individual_summary": made([*frames("pooled"), DENSE, f"iv AS MATERIALIZED (SELECT f.*, round(f_uni, 9) AS x, population FROM ({F_ALL}) f JOIN samples USING (sample_idx))"], _uni_rank, "sample_idx:i f_hom:d f_uni:d pct_rank:d n_reaching:i"),
    "cascade_modes": made(MODES, " UNION ALL ".join(cascaded(m, u) for m in ("each", "joint") for u in ("keep", "drop")), "hwe_mode unanchored step:i name standalone:i cumulative:i"),
    "callrate_cascade": made([*QUALITY, f"lv AS (SELECT unnest({[float(x) for x in q.CALL_RATES]}::DOUBLE[]) AS threshold)", f"kp AS (SELECT threshold, locus_idx FROM flags CROSS JOIN lv WHERE {_not_call} AND call_rate >= threshold QUALIFY row_number() OVER (PARTITION BY threshold, clone_id ORDER BY call_rate DESC, rep_score DESC, locus_idx) = 1)"], f"SELECT threshold, count(s.locus_idx) AS n_loci, avg(ho) AS ho, avg(he_unb) AS he_unbiased, count(*) FILTER (poly) AS n_polymorphic FROM lv LEFT JOIN kp USING (threshold) LEFT JOIN (SELECT * FROM st WHERE population = '{q.FOCAL}') s ON s.locus_idx = kp.locus_idx GROUP BY 1", "threshold:d n_loci:i ho:d he_unbiased:d n_polymorphic:i"),
    "hwe_form_shift": made([*MODES, _shift("xe", " AND ".join(q.STEPS)), _shift("xj", " AND ".join([*q.STEPS[:-1], "pass_joint"]))], "SELECT max(xe.n) AS n_each, max(xj.n) AS n_joint, max(abs(xe.he - xj.he)) AS largest_shift FROM xe FULL JOIN xj USING (population)", "n_each:i n_joint:i largest_shift:d"),
    "chi2_levels": made([*PANEL, JOINT, f"ch AS (SELECT locus_idx, {CHI} AS chi2, sqrt(least({CHI}, 50.0::DOUBLE) / 2) AS x FROM jt)"], f"SELECT locus_idx, chi2, {erfc('x')} AS level FROM ch", "locus_idx:i chi2:d level:d"),
    "fst_ranked": made([*POP, PAIRS, ROUNDED], f"SELECT *, row_number() OVER (ORDER BY fst DESC NULLS LAST, population_i, population_j) AS rank, {_label} AS label FROM rf", "population_i population_j fst:d rank:i label"),
    "fst_above_p95": made([*POP, PAIRS, ROUNDED], "SELECT *, row_number() OVER (ORDER BY fst DESC, population_i, population_j) AS rank FROM rf WHERE fst > (SELECT quantile_cont(fst, 0.95) FROM rf)", "population_i population_j fst:d rank:i"),
    "pair_keys": made([*POP, PAIRS, "ka AS (SELECT DISTINCT least(population_i, population_j) AS i, greatest(population_i, population_j) AS j FROM fst)", f"kb AS (SELECT DISTINCT x.population AS i, y.population AS j FROM samples x JOIN samples y ON x.population < y.population WHERE y.population <> '{q.FOCAL}')"], "SELECT (SELECT count(*) FROM ka) AS n_a, (SELECT count(*) FROM kb) AS n_b, (SELECT count(*) FROM ka ANTI JOIN kb USING (i, j)) AS only_a, (SELECT count(*) FROM kb ANTI JOIN ka USING (i, j)) AS only_b", "n_a:i n_b:i only_a:i only_b:i"),
    "populations_ordered": made([SAMPLES], "SELECT population, count(*) AS n, row_number() OVER (ORDER BY coalesce(TRY_CAST(regexp_extract(population, '([0-9]+)', 1) AS BIGINT), -1), population) AS rank FROM samples GROUP BY 1", "population n:i rank:i"),
    "region_lists": made([SAMPLES, "sz AS (SELECT region, population, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, population) AS r FROM samples GROUP BY 1, 2)"], "SELECT region, count(*) AS n, string_agg(population, ', ' ORDER BY r) FILTER (r <= 3) || CASE WHEN count(*) > 3 THEN ', ...' ELSE '' END AS shown FROM sz GROUP BY 1", "region n:i shown"),
    "anchor_slice": made([LOCI], "SELECT * FROM (SELECT locus_idx, refseq, row_number() OVER (ORDER BY refseq, locus_idx DESC) AS rank FROM loci WHERE aln_cnt > 10) WHERE rank BETWEEN 11 AND 20", "locus_idx:i refseq rank:i"),
    "score_histogram": made([LOCI], "SELECT bin, 900 + bin * 50.0::DOUBLE AS lo, 950 + bin * 50.0::DOUBLE AS hi, count(rep_score) AS n FROM (SELECT range AS bin FROM range(24)) LEFT JOIN loci ON least(floor((rep_score - 900) / 50), 23) = bin AND rep_score BETWEEN 900 AND 2100 GROUP BY 1", "bin:i lo:d hi:d n:i"),
    "score_ranges": made([LOCI], "SELECT CASE WHEN grouping(refseq) = 1 THEN 'total' ELSE refseq END AS refseq, count(rep_score) AS n, min(rep_score) AS least, max(rep_score) AS most, avg(rep_score) AS mean FROM loci GROUP BY ROLLUP (refseq)", "refseq n:i least:d most:d mean:d"),
    "point_override": made([], "SELECT CASE WHEN c_custkey = 1 THEN 'MOVED' ELSE trim(c_mktsegment) END AS segment, count(*) AS n FROM customer GROUP BY 1", "segment n:i"),
    "widest_distance": made([XY], "SELECT max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS most FROM pts a CROSS JOIN pts b", "most:d"),
    "points_in_shapes": made([
        XY, "turned AS (SELECT p.*, round(atan2(y - my, x - mx), 9) AS angle FROM pts p JOIN (SELECT label, avg(x) AS mx, avg(y) AS my FROM pts GROUP BY 1) USING (label))",
        "sides AS (SELECT label AS shape, x AS xa, y AS ya, coalesce(lead(x) OVER o, first_value(x) OVER o) AS xb, coalesce(lead(y) OVER o, first_value(y) OVER o) AS yb FROM turned WINDOW o AS (PARTITION BY label ORDER BY angle, vec_id))",
        "held AS (SELECT vec_id, label, shape FROM pts JOIN sides ON (ya > y) <> (yb > y) AND x < (xb - xa) * (y - ya) / nullif(yb - ya, 0) + xa GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)",
    ], "SELECT shape, label, count(*) AS n_inside FROM held GROUP BY 1, 2", "shape:i label:i n_inside:i"),
    "cascade_published": made([
        *POP, WALK, CALLS, JOINT,
        "large AS (SELECT population FROM st GROUP BY 1 HAVING max(n) >= 19)",
        f"each AS (SELECT locus_idx, list_sort(list(sqrt({CHI} / 2)), 'DESC')[2] AS x FROM st SEMI JOIN large USING (population) GROUP BY 1)",
        f"base AS (SELECT l.locus_idx, clone_id, rep_score, w.class, c.call_rate AS called, e.x AS second, o.x AS once FROM loci l JOIN walk w USING (scaffold) JOIN calls c USING (locus_idx) LEFT JOIN each e USING (locus_idx) LEFT JOIN (SELECT locus_idx, sqrt({CHI} / 2) AS x FROM jt) o USING (locus_idx) WHERE rep_score >= {q.LEAST_REP} AND aln_cnt >= {q.LEAST_ALN} AND w.class <> 'sex')",
        f"variants AS (SELECT c AS call_rate, u AS unanchored, m AS hwe_mode FROM (SELECT unnest({[float(x) for x in q.CALL_RATES]}::DOUBLE[]) AS c), (SELECT unnest(['keep', 'drop']) AS u), (SELECT unnest(['each', 'joint']) AS m))",
        "rest AS (SELECT v.*, b.locus_idx, clone_id, rep_score, called, CASE hwe_mode WHEN 'each' THEN second ELSE once END AS x FROM variants v JOIN base b ON called >= v.call_rate AND (unanchored = 'keep' OR class <> 'unanchored'))",
        "sizes AS (SELECT v.call_rate, v.unanchored, v.hwe_mode, count(locus_idx) AS n_before, 0.05::DOUBLE / nullif(count(locus_idx) * CASE v.hwe_mode WHEN 'each' THEN (SELECT count(*) FROM large) ELSE 1 END, 0) AS alpha FROM variants v LEFT JOIN rest r ON r.call_rate = v.call_rate AND r.unanchored = v.unanchored AND r.hwe_mode = v.hwe_mode GROUP BY v.call_rate, v.unanchored, v.hwe_mode)",
        f"judged AS (SELECT r.*, coalesce(x > 0.5 AND {erfc('x')} < alpha, false) AS failed FROM rest r JOIN sizes s ON r.call_rate = s.call_rate AND r.unanchored = s.unanchored AND r.hwe_mode = s.hwe_mode)",
        "ranked_ AS (SELECT *, row_number() OVER (PARTITION BY call_rate, unanchored, hwe_mode, clone_id, failed ORDER BY called DESC, rep_score DESC, locus_idx) AS place FROM judged)",
    ], "SELECT s.call_rate, s.unanchored, s.hwe_mode, s.alpha * 1e6 AS alpha, n_before, count(*) FILTER (failed) AS n_failed, count(*) FILTER (NOT failed AND place = 1) AS n_final FROM sizes s LEFT JOIN ranked_ r ON r.call_rate = s.call_rate AND r.unanchored = s.unanchored AND r.hwe_mode = s.hwe_mode GROUP BY ALL", "call_rate:d unanchored hwe_mode alpha:d n_before:i n_failed:i n_final:i"),
}


# ---------------------------------------------------------------- results written, checked and kept; tables with the published columns

N_FOCAL_SQL = f"(SELECT count(*) FROM samples WHERE population = '{q.FOCAL}')"
_check = lambda step, name, value, of: f"SELECT '{step}' AS step, '{name}' AS name, {value} AS value, 0 AS expected, abs({value}) <= 1e-12 AS passed, (SELECT count(*) FROM {of}) AS rows"


def rarefied_16(k: int) -> str:
    named = {"ho": "avg(ho)", "he": "avg(he_unb)", "fis": "sum(b) / nullif(sum(b + c), 0)", "n_poly": "count(*) FILTER (poly)", "maf": "avg(maf) FILTER (poly)"}
    return f"""SELECT population, {k} AS level, {', '.join(f'avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_sd' for m in named)}, avg(ar) AS ar_g16_mean
  FROM (SELECT split_part(draw, ':', 1) AS population, draw, {', '.join(f'{v} AS {m}' for m, v in named.items())}, {f"avg({richness('16')})" if 2 * k >= 16 else 'NULL::DOUBLE'} AS ar FROM d{k} GROUP BY 1, 2) GROUP BY 1"""


MATCHED = [*POP, draws(N_FOCAL_SQL), stats("ds", "draw", "draws"),
  "xs AS MATERIALIZED (SELECT split_part(draw, ':', 1) AS population, draw, least(alt, 2 * n - alt) / (2 * n)::DOUBLE AS x FROM ds WHERE poly)", "xo AS (SELECT population, least(alt, 2 * n - alt) / (2 * n)::DOUBLE AS x FROM st WHERE poly)",
  f"fx AS (SELECT x FROM xo WHERE population = '{q.FOCAL}')", "dr AS (SELECT draw, population, count(x) AS n, avg(x) AS m FROM (SELECT DISTINCT draw, population FROM draws) LEFT JOIN (SELECT draw, x FROM xs) USING (draw) GROUP BY 1, 2)",
  "steps AS (SELECT draw, x, sum(k1) AS k1, sum(k2) AS k2 FROM (SELECT draw, x, 0 AS k1, count(*) AS k2 FROM xs GROUP BY 1, 2 UNION ALL SELECT draw, x, k, 0 FROM (SELECT DISTINCT draw FROM xs) CROSS JOIN (SELECT x, count(*) AS k FROM fx GROUP BY 1)) GROUP BY 1, 2)",
  "ksd AS (SELECT draw, max(abs(f1 - f2)) AS d FROM (SELECT draw, sum(k1) OVER w / (sum(k1) OVER v)::DOUBLE AS f1, sum(k2) OVER w / (sum(k2) OVER v)::DOUBLE AS f2 FROM steps WINDOW w AS (PARTITION BY draw ORDER BY x), v AS (PARTITION BY draw)) GROUP BY 1)",
  f"mt AS (SELECT population, count(*) AS n_draws, avg(m) AS matched, stddev_samp(m) AS sd, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, avg(n) AS n_polymorphic_mean, stddev_samp(n) AS n_polymorphic_sd, avg(d) AS ks_d_mean, stddev_samp(d) AS ks_d_sd, avg((round(m, 9) >= (SELECT round(avg(x), 9) FROM fx))::INT) AS p FROM dr LEFT JOIN ksd USING (draw) WHERE population <> '{q.FOCAL}' GROUP BY 1)"]
_side = lambda v, who, f: f"{f}({v}) FILTER ({'NOT ' if who == 'other' else ''}focal) AS {who}_{ {'avg': 'mean'}.get(f, f) }"

SQL |= {
    "run_ledger": made([*POP], " UNION ALL ".join([
        _check("genotypes", "doses out of range", "(SELECT count(*) FROM geno WHERE dose NOT IN (1, 2))", "geno"), _check("genotypes", "cells without a key", "(SELECT count(*) FROM geno WHERE sample_idx IS NULL OR locus_idx IS NULL)", "geno"),
        _check("statistics", "frequencies out of range", "(SELECT count(*) FROM st WHERE p < 0 OR p > 1)", "st"), _check("statistics", "largest excess of alleles over twice the calls", "(SELECT greatest(max(alt - 2 * n), 0) FROM st)", "st"),
        _check("statistics", "largest difference of 2 p q", "(SELECT max(abs(he_hw - 2 * p * (1 - p))) FROM st)", "st"),
        "SELECT 'genotypes again', 'rows that differ', 0, 0, true, NULL",
    ]), "step name value:d expected:d passed rows:i"),
    "filter_cascade_kept": SQL["filter_cascade"],
    "diversity_packaged": SQL["diversity_by_population"],
    "rarefaction_table": made([*POP, *[x for k in q.LEVELS for x in (draws(k, f"p{k}"), stats(f"d{k}", "draw", f"p{k}"))]], "SELECT r.*, n_full, 100 * he_mean / nullif(he_full, 0) AS he_pct_of_full FROM (" + " UNION ALL ".join(map(rarefied_16, q.LEVELS)) + ") r JOIN (SELECT population, max(n) AS n_full, avg(he_unb) AS he_full FROM st GROUP BY 1) USING (population)", "population level:i n_full:i he_pct_of_full:d ar_g16_mean:d " + " ".join(f"{m}_mean:d {m}_sd:d" for m in ("ho", "he", "fis", "n_poly", "maf"))),
    "spectrum_matched": made([*MATCHED, 'ft AS (SELECT population, avg(x) AS unmatched FROM xo GROUP BY 1)', "am AS (SELECT avg(x) AS k FROM fx)", "en AS (SELECT min(matched) AS a, max(matched) AS b FROM mt)"], 'SELECT mt.*, k AS focal_mean, unmatched, a AS envelope_lo, b AS envelope_hi, k - unmatched AS gap, k - matched AS matched_gap, 100 * (1 - (k - matched) / nullif(k - unmatched, 0)) AS pct_artefact, round(k, 9) BETWEEN round(a, 9) AND round(b, 9) AS focal_within FROM mt JOIN ft USING (population) CROSS JOIN am CROSS JOIN en',
        "population n_draws:i matched:d sd:d lo:d hi:d n_polymorphic_mean:d n_polymorphic_sd:d ks_d_mean:d ks_d_sd:d p:d focal_mean:d unmatched:d envelope_lo:d envelope_hi:d gap:d matched_gap:d pct_artefact:d focal_within"),
    "locus_character": made([*POP, JOINT, RULE, stats("sd", "side")], """SELECT *, n_poly_focal / n_loci::DOUBLE AS prop_poly_focal, n_poly_rest / n_loci::DOUBLE AS prop_poly_rest FROM
  (SELECT locus_set, count(*) AS n_loci, avg(maf) AS mean_maf, median(maf) AS median_maf, 100 * avg((maf < 0.01::DOUBLE)::INT) AS pct_below_001, 100 * avg((p = 0 OR p = 1)::INT) AS pct_monomorphic, avg(he_unb) AS mean_he FROM jt JOIN rule USING (locus_idx) GROUP BY 1)
  JOIN (SELECT locus_set, count(*) FILTER (side = 'focal' AND poly) AS n_poly_focal, count(*) FILTER (side = 'rest' AND poly) AS n_poly_rest FROM sd JOIN rule USING (locus_idx) GROUP BY 1) USING (locus_set)""", "locus_set n_loci:i mean_maf:d median_maf:d pct_below_001:d pct_monomorphic:d mean_he:d n_poly_focal:i n_poly_rest:i prop_poly_focal:d prop_poly_rest:d"),
    "individual_ranges": made([*frames("pooled"), DENSE, f"iv AS MATERIALIZED (SELECT 'f_uni' AS measure, f_uni AS v, population = '{q.FOCAL}' AS focal FROM ({F_ALL}) JOIN samples USING (sample_idx) UNION ALL SELECT 'ho', coalesce(het, 0) / nullif(called, 0)::DOUBLE, population = '{q.FOCAL}' FROM (SELECT s.sample_idx, population, count(*) FILTER (dose = 1) AS het, (SELECT count(*) FROM loci) - count(*) FILTER (g.sample_idx IS NOT NULL AND dose IS NULL) AS called FROM samples s LEFT JOIN geno g ON g.sample_idx = s.sample_idx GROUP BY 1, 2))",
        "iw AS MATERIALIZED (SELECT *, round(v, 9) AS x FROM iv WHERE v IS NOT NULL)", "ag AS (SELECT measure, " + ", ".join(_side("v", who, f) for who in ("focal", "other") for f in ("min", "max", "avg")) + ", quantile_cont(v, 0.95) FILTER (NOT focal) AS other_p95, count(*) FILTER (NOT focal) AS n_other FROM iw GROUP BY 1)"],
        "SELECT measure, focal_min, focal_max, focal_mean, other_min, other_max, other_mean, other_p95, count(*) FILTER (focal AND x < round(other_min, 9)) AS n_below_others, count(*) FILTER (focal AND x > round(other_max, 9)) AS n_above_others, count(*) FILTER (NOT focal AND x < round(focal_max, 9)) AS n_others_below_max, 100 * count(*) FILTER (NOT focal AND x < round(focal_mean, 9)) / any_value(n_other)::DOUBLE AS pct_below_mean FROM iw JOIN ag USING (measure) GROUP BY ALL",
        "measure focal_min:d focal_max:d focal_mean:d other_min:d other_max:d other_mean:d other_p95:d n_below_others:i n_above_others:i n_others_below_max:i pct_below_mean:d"),
}

SQL |= {
    "diversity_table": made([*POP, weights(q.REPS),
        "wh AS (SELECT population, min(region) AS region, count(*) AS n FROM samples GROUP BY 1)", f"dv AS (SELECT population, {DIVERSITY} FROM st GROUP BY 1)",
        "jk AS (SELECT population, sqrt((count(theta) - 1) * var_pop(theta)) AS fis_jack_se FROM (SELECT population, (sum(b) OVER w - b) / nullif(sum(b + c) OVER w - b - c, 0) AS theta FROM st WINDOW w AS (PARTITION BY population)) GROUP BY 1)",
        f"rc AS (SELECT population, avg(a) AS ar_g16, stddev_samp(a) / sqrt(count(a)) AS ar_g16_se FROM (SELECT population, {richness('16')} AS a FROM st) GROUP BY 1)",
        "bt AS (SELECT population, quantile_cont(t, 0.025) AS fis_boot_lo, quantile_cont(t, 0.975) AS fis_boot_hi FROM (SELECT population, rep, sum(w * b) / nullif(sum(w * (b + c)), 0) AS t FROM st JOIN weights USING (locus_idx) GROUP BY 1, 2) GROUP BY 1)"],
        "SELECT wh.*, dv.* EXCLUDE (population, n), fis_jack_se, ar_g16, ar_g16_se, fis_boot_lo, fis_boot_hi FROM wh JOIN dv USING (population) LEFT JOIN jk USING (population) LEFT JOIN rc USING (population) LEFT JOIN bt USING (population)",
        "population region n:i n_loci:i ho:d ho_se:d he_unbiased:d he_se:d he_hw:d fis_wc:d fis_jack_se:d fis_boot_lo:d fis_boot_hi:d n_polymorphic:i prop_polymorphic:d ar_g16:d ar_g16_se:d mean_folded_maf:d"),
}
