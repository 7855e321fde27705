"""Split, fold, repeated-split and row-label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlake.functions.hashing import hash_uniform_sql
from coverlake.operators import splits as sp
from coverlake.operators import stats as S
from coverlake.plans import experiments as X
from coverlake.queries._sql import FLAGS_SQL, KEYS
from coverlake.registry import register
from coverlake.session import cut_lineage
from coverlake.sources import fixtures as fx
from coverlake.sources.fixtures import KEY_COLS

# Simulated sample sizes and the repeated-split count of the reference.
SAMPLE_SIZES = (5000, 10000, 20000, 50000, 100000, 200000)
N_SEEDS = 100
SPLIT_SEED = 42

KEY_SQL = ("concat_ws(':', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
           "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(date AS VARCHAR))")


def _role_sql(u: str) -> str:
    return f"CASE WHEN {u} < 0.6 THEN 'proper_train' WHEN {u} < 0.8 THEN 'calibration' ELSE 'validation' END"


@register("hash_split", f"""
SELECT {KEYS}, {_role_sql(hash_uniform_sql(SPLIT_SEED, KEY_SQL))} AS role FROM predictions""")
def q_hash_split(spark, sf_dir):
    """Seeded 60/20/20 proper-train / calibration / validation split."""
    df = fx.predictions(spark, sf_dir).select(*KEY_COLS)
    return sp.hash_split(df, KEY_COLS, SPLIT_SEED)


@register("exact_split", f"""
WITH d AS (SELECT {KEYS}, seed_id, {hash_uniform_sql(SPLIT_SEED, KEY_SQL)} AS u FROM predictions),
r AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY u, {KEYS}) - 1 AS pos,
             count(*) OVER (PARTITION BY seed_id) AS n FROM d),
z AS (SELECT *, CAST(ceil(0.2*n) AS BIGINT) AS n_val FROM r),
z2 AS (SELECT *, n - n_val - CAST(ceil(0.25*(n - n_val)) AS BIGINT) AS n_proper, n - n_val AS n_train FROM z)
SELECT {KEYS}, seed_id,
       CASE WHEN pos < n_proper THEN 'proper_train' WHEN pos < n_train THEN 'calibration' ELSE 'validation' END AS role
FROM z2""")
def q_exact_split(spark, sf_dir):
    """X1, exact sizes per sample (seed_id): the 80/20 then 75/25 split sizes,
    rows assigned in hash order."""
    df = fx.predictions(spark, sf_dir).select(*KEY_COLS, "seed_id")
    return sp.exact_split(df, KEY_COLS, SPLIT_SEED, by=["seed_id"])


@register("group_split", f"""
SELECT {KEYS}, secid, {_role_sql(hash_uniform_sql(SPLIT_SEED, 'CAST(secid AS VARCHAR)'))} AS role FROM quotes""")
def q_group_split(spark, sf_dir):
    """Group-respecting split (all rows of a secid on one side)."""
    df = fx.quotes(spark, sf_dir).select(*KEY_COLS, "secid")
    return sp.group_split(df, ["secid"], SPLIT_SEED)


_FEATURE_KEY = ("concat_ws(':', CAST(S AS DECIMAL(18,6)), CAST(sigma AS DECIMAL(18,6)), CAST(tau AS DECIMAL(18,6)), "
                "CAST(r AS DECIMAL(18,6)))")


@register("feature_group_split", f"""
WITH d AS (SELECT *, {_role_sql(hash_uniform_sql(SPLIT_SEED, _FEATURE_KEY))} AS role FROM predictions),
g AS (SELECT {_FEATURE_KEY} AS k, count(*) AS n, count(DISTINCT role) AS sides, min(role) AS role FROM d GROUP BY 1)
SELECT role, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_keys, count(*) FILTER (WHERE sides > 1) AS keys_on_two_sides
FROM g GROUP BY role""")
def q_feature_group_split(spark, sf_dir):
    """X2 on the stated key (S, sigma, tau, r), equal to six places: rows and
    keys per role, and the number of keys that sit on two sides (0)."""
    df = fx.predictions(spark, sf_dir)
    key = [F.col(c).cast("decimal(18,6)").alias(f"k_{c}") for c in ("S", "sigma", "tau", "r")]
    split = sp.group_split(df.select(*key), ["k_S", "k_sigma", "k_tau", "k_r"], SPLIT_SEED)
    keys = split.groupBy("k_S", "k_sigma", "k_tau", "k_r").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("role").alias("sides"), F.min("role").alias("role"))
    return keys.groupBy("role").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_keys"),
                                    F.count_if(F.col("sides") > 1).alias("keys_on_two_sides"))


@register("walk_forward_folds", f"""
WITH folds AS (SELECT CAST(y AS INTEGER) AS test_year, CAST(y - o AS INTEGER) AS year,
                      CASE WHEN o = 0 THEN 'test' WHEN o = 1 THEN 'calibration' ELSE 'train' END AS role
               FROM range(2000, 2023) a(y), range(0, 5) b(o))
SELECT f.test_year, f.role, count(*) AS n, round(avg(p.y_true), 9) AS mean_y
FROM (SELECT *, year(date) AS year FROM predictions) p JOIN folds f ON f.year = p.year
GROUP BY f.test_year, f.role""")
def q_walk_forward_folds(spark, sf_dir):
    """Walk-forward folds (test y, calibration y-1, training y-4..y-2,
    y = 2000..2022) as a role column; rows and mean target per fold role."""
    df = fx.predictions(spark, sf_dir).withColumn("year", F.year("date"))
    j = sp.assign_folds(df, sp.walk_forward_folds(spark))
    return j.groupBy("test_year", "role").agg(F.count(F.lit(1)).alias("n"),
                                              F.round(F.avg("y_true"), 9).alias("mean_y"))


_SEED_SQL = f"""
WITH flagged AS (SELECT *, {FLAGS_SQL} FROM predictions),
draws AS (SELECT f.*, s.seed,
                 CAST(('0x' || substr(md5(concat_ws(':', CAST(s.seed // 4 AS VARCHAR), CAST(l_orderkey AS VARCHAR),
                      CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
                      CAST(date AS VARCHAR))), 8*(s.seed % 4) + 1, 8)) AS BIGINT) / 4294967296.0 AS u
          FROM flagged f, (SELECT CAST(unnest(generate_series(0, {N_SEEDS - 1})) AS INTEGER) AS seed) s),
per_seed AS (SELECT seed, avg(CAST(covered AS DOUBLE)) AS coverage,
                    100*avg(CAST(pp_valid AS DOUBLE)) AS pp_valid_pct, 100*avg(CAST(valid AS DOUBLE)) AS valid_pct
             FROM draws WHERE u >= 0.8 GROUP BY seed)"""


def _seed_table(spark, sf_dir):
    return X.seed_coverage(fx.predictions(spark, sf_dir), KEY_COLS, N_SEEDS)


@register("seed_coverage", f"""{_SEED_SQL}
SELECT seed, round(coverage, 9) AS coverage, round(pp_valid_pct, 9) AS pp_valid_pct, round(valid_pct, 9) AS valid_pct
FROM per_seed""")
def q_seed_coverage(spark, sf_dir):
    """100 seeded splits; coverage, pp_valid %, valid % on each split's
    validation part."""
    t = _seed_table(spark, sf_dir)
    return t.select("seed", *[F.round(c, 9).alias(c) for c in ("coverage", "pp_valid_pct", "valid_pct")])


@register("seed_coverage_summary", f"""{_SEED_SQL},
mm AS (SELECT min(coverage) AS mn, max(coverage) AS mx, avg(coverage) AS mean_cov, count(*) AS total FROM per_seed),
spine AS (SELECT CAST(i AS INTEGER) AS bin, mn + i*((mx - mn)/10) AS lower,
                 CASE WHEN i = 9 THEN mx ELSE mn + (i + 1)*((mx - mn)/10) END AS upper FROM mm, range(10) t(i)),
b AS (SELECT ({' + '.join(f'CAST(coverage >= mn + {i}*((mx - mn)/10) AS INTEGER)' for i in range(1, 10))}) AS bin
      FROM per_seed, mm),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT s.bin, round(s.lower, 9) AS lower, round(s.upper, 9) AS upper, coalesce(c.n, 0) AS n,
       round(100.0*coalesce(c.n, 0)/mm.total, 9) AS pct, round(mm.mean_cov, 9) AS mean_coverage
FROM spine s LEFT JOIN c ON c.bin = s.bin, mm""")
def q_seed_coverage_summary(spark, sf_dir):
    """Mean coverage over the seeds and a 10-bin percent histogram."""
    t = _seed_table(spark, sf_dir)
    t = cut_lineage(t)
    hist = S.histograms(spark, t, ["coverage"], 10)
    mean = t.agg(F.avg("coverage").alias("m"), F.count(F.lit(1)).alias("total")).first()
    return hist.select("bin", "lower", "upper", "n",
                       F.round(100.0 * F.col("n") / F.lit(mean["total"]), 9).alias("pct"),
                       F.round(F.lit(mean["m"]), 9).alias("mean_coverage"))


@register("block_labels", f"""
SELECT {KEYS}, row_no,
       CASE {' '.join(f'WHEN row_no < {sum(SAMPLE_SIZES[:i + 1])} THEN {i}' for i in range(len(SAMPLE_SIZES)))} END AS sample_id
FROM (SELECT {KEYS}, row_number() OVER (ORDER BY {KEYS}) - 1 AS row_no FROM predictions) t""")
def q_block_labels(spark, sf_dir):
    """Rows labelled by cumulative sample sizes in key order (global row
    number via range partitions + offsets, no single-task window)."""
    df = fx.predictions(spark, sf_dir).select(*KEY_COLS)
    return sp.block_labels(sp.global_row_number(df, list(KEY_COLS)), SAMPLE_SIZES)


@register("first_rows", f"""
SELECT {KEYS}, y_true, lb, ub FROM predictions ORDER BY {KEYS} LIMIT 50""")
def q_first_rows(spark, sf_dir):
    """The first 50 rows in key order (head)."""
    df = fx.predictions(spark, sf_dir).select(*KEY_COLS, "y_true", "lb", "ub")
    return sp.first_rows(df, list(KEY_COLS), 50)
