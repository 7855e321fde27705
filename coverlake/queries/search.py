"""Grid-search result tables (E9: M5 grid, A18-A20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from coverlake.operators import search as G
from coverlake.registry import register
from coverlake.sources import fixtures as fx

_P = G.PARAM_GRID


def _lst(v):
    return "[" + ", ".join(repr(x) for x in v) + "]"


GRID_SQL = f"""
mae AS (SELECT sample_id, set_type, grid_no, round(avg(abs(y_true - y_pred)), 9) AS mae
        FROM grid_errors GROUP BY sample_id, set_type, grid_no),
res AS (SELECT sample_id, set_type, grid_no,
               CAST(({_lst(_P['n_estimators'])})[(grid_no // 4) % 5 + 1] AS INTEGER) AS n_estimators,
               CAST(({_lst(_P['num_leaves'])})[grid_no % 4 + 1] AS INTEGER) AS num_leaves,
               CAST(({_lst(_P['max_depth'])})[(grid_no // 20) % 4 + 1] AS INTEGER) AS max_depth,
               CAST(({_lst(_P['learning_rate'])})[(grid_no // 80) % 5 + 1] AS DOUBLE) AS learning_rate,
               mae FROM mae)"""


def grid_results(spark, sf_dir):
    m = G.mae_by_model(fx.grid_errors(spark, sf_dir))
    m = m.withColumn("mae", F.round("mae", 9))
    params = G.params_from_grid_no("grid_no")
    return m.select("sample_id", "set_type", "grid_no",
                    *[params[p].cast("double" if p == "learning_rate" else "int").alias(p) for p in _P], "mae")


@register("grid_results", f"WITH {GRID_SQL} SELECT * FROM res")
def q_grid_results(spark, sf_dir):
    """M5 table + A18: validation MAE of every (sample, set type, grid cell)
    model with its decoded parameters."""
    return grid_results(spark, sf_dir)


@register("best_params", f"""
WITH {GRID_SQL}
SELECT sample_id, set_type, n_estimators, num_leaves, max_depth, learning_rate, grid_no, mae
FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, set_type ORDER BY mae, grid_no) AS rn FROM res) t
WHERE rn = 1""")
def q_best_params(spark, sf_dir):
    """Best row per (sample, set type) = argmin mae, first on ties."""
    return G.best_by_group(grid_results(spark, sf_dir))


def _pair_sql():
    from itertools import combinations
    parts = [f"""SELECT sample_id, set_type, '{a}' AS param_a, '{b}' AS param_b, CAST({a} AS DOUBLE) AS value_a,
       CAST({b} AS DOUBLE) AS value_b, min(mae) AS min_mae FROM res GROUP BY sample_id, set_type, {a}, {b}"""
             for a, b in combinations(list(_P), 2)]
    return f"WITH {GRID_SQL}\n" + "\nUNION ALL\n".join(parts)


@register("pairwise_min_mae", _pair_sql())
def q_pairwise_min_mae(spark, sf_dir):
    """For each of the 6 parameter pairs, min mae per value pair."""
    return G.pairwise_min(grid_results(spark, sf_dir))
