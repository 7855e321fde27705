"""SQL fragments shared by the oracle statements."""

FLAGS_SQL = """coalesce(lb <= y_true AND y_true <= ub, false) AS covered,
       coalesce(lb <= ub, false) AS valid,
       coalesce(lb <= pp AND pp <= ub, false) AS pp_valid,
       coalesce(ub <= lb, false) AS ill,
       ub - lb AS abs_width,
       CASE WHEN y_true <> 0 THEN 100*(ub - lb)/y_true
            WHEN y_true = 0 AND ub - lb > 0 THEN CAST('inf' AS DOUBLE)
            WHEN y_true = 0 AND ub - lb < 0 THEN CAST('-inf' AS DOUBLE) END AS rel_width"""

FLAGGED = f"flagged AS (SELECT *, {FLAGS_SQL} FROM predictions)"

KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, date"
KEY_JOIN = ("a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey "
            "AND a.l_suppkey = b.l_suppkey AND a.date = b.date")
