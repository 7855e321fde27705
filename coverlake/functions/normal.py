"""Standard normal CDF and Black-Scholes values as native Column expressions
(P21).  Spark 4.1 has no ``erf``, so the CDF is the double-precision rational
approximation of Hart (1968) in the form published by West (2005), "Better
approximations to cumulative normal functions".  Max abs error ~1e-16.

The same coefficients also render DuckDB SQL (``norm_cdf_sql``) so the oracle
evaluates the identical polynomial.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverlake.functions.quote import col

# Hart/West coefficients, highest power first.
NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
       112.079291497871, 221.213596169931, 220.206867912376)
DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
       296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
SPLIT = 7.07106781186547
TAIL = 37.0
SQRT_2PI = 2.506628274631


def _horner(coefs, x):
    acc = coefs[0] * x + coefs[1]
    for c in coefs[2:]:
        acc = acc * x + c
    return acc


def _tail_fraction(x):
    # x + 1/(x + 2/(x + 3/(x + 4/(x + 0.65))))
    b = x + 0.65
    for k in (4, 3, 2, 1):
        b = x + k / b
    return b


def lower_tail(a) -> Column:
    """P(Z > a) = P(Z < -a) for a >= 0."""
    a = col(a)
    e = F.exp(-a * a / 2)
    inner = e * _horner(NUM, a) / _horner(DEN, a)
    outer = e / _tail_fraction(a) / SQRT_2PI
    return F.when(a > TAIL, F.lit(0.0)).when(a < SPLIT, inner).otherwise(outer)


def cdf_from_tail(x, tail) -> Column:
    """N(x) given tail = lower_tail(|x|)."""
    return F.when(col(x) > 0, 1 - col(tail)).otherwise(col(tail))


def norm_cdf(x) -> Column:
    x = col(x)
    return cdf_from_tail(x, lower_tail(F.abs(x)))


def norm_cdf_sql(x: str) -> str:
    a = f"abs({x})"
    e = f"exp(-({a})*({a})/2)"

    def horner(coefs):
        acc = f"({coefs[0]!r}*{a} + {coefs[1]!r})"
        for c in coefs[2:]:
            acc = f"({acc}*{a} + {c!r})"
        return acc

    tail = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        tail = f"({a} + {k}/{tail})"
    lower = (f"(CASE WHEN {a} > {TAIL!r} THEN 0.0 WHEN {a} < {SPLIT!r} "
             f"THEN {e}*{horner(NUM)}/{horner(DEN)} ELSE {e}/{tail}/{SQRT_2PI!r} END)")
    return f"(CASE WHEN {x} > 0 THEN 1 - {lower} ELSE {lower} END)"


def d1(S, K, r, sigma, tau) -> Column:
    S, K, r, sigma, tau = map(col, (S, K, r, sigma, tau))
    return (F.log(S / K) + (r + sigma * sigma / 2) * tau) / (sigma * F.sqrt(tau))


def d1_sql(S: str, K: str, r: str, sigma: str, tau: str) -> str:
    return f"((ln(({S})/({K})) + (({r}) + ({sigma})*({sigma})/2)*({tau}))/(({sigma})*sqrt({tau})))"


def bs_call_sql(S: str, K: str, r: str, sigma: str, tau: str) -> str:
    D1 = d1_sql(S, K, r, sigma, tau)
    D2 = f"({D1} - ({sigma})*sqrt({tau}))"
    return f"(({S})*{norm_cdf_sql(D1)} - ({K})*exp(-({r})*({tau}))*{norm_cdf_sql(D2)})"


def bs_put_sql(S: str, K: str, r: str, sigma: str, tau: str) -> str:
    D1 = d1_sql(S, K, r, sigma, tau)
    D2 = f"({D1} - ({sigma})*sqrt({tau}))"
    return f"(({K})*exp(-({r})*({tau}))*{norm_cdf_sql('-' + D2)} - ({S})*{norm_cdf_sql('-' + D1)})"


def with_bs_values(df, S="S", K="K", r="r", sigma="sigma", tau="tau", cp=None, out: str = "C"):
    """Black-Scholes value as staged projections: d1/d2, then the normal
    tail terms, then the price.  Each stage is a separate projection that
    Catalyst keeps apart (it does not collapse projections when that would
    duplicate non-cheap expressions), so d1 and d2 are computed once per row
    instead of once per use inside the CDF polynomial.   ``cp`` None -> call; else 'C' call,
    'P' put, other NULL."""
    S, K, r, sigma, tau = map(col, (S, K, r, sigma, tau))
    staged = df.withColumns({"__d1": d1(S, K, r, sigma, tau), "__disc": K * F.exp(-r * tau),
                             "__sqt": sigma * F.sqrt(tau)})
    staged = staged.withColumn("__d2", F.col("__d1") - F.col("__sqt"))
    staged = staged.withColumns({"__t1": lower_tail(F.abs(F.col("__d1"))),
                                 "__t2": lower_tail(F.abs(F.col("__d2")))})
    d1c, d2c = F.col("__d1"), F.col("__d2")
    call = S * cdf_from_tail(d1c, "__t1") - F.col("__disc") * cdf_from_tail(d2c, "__t2")
    put = F.col("__disc") * cdf_from_tail(-d2c, "__t2") - S * cdf_from_tail(-d1c, "__t1")
    value = call if cp is None else F.when(col(cp) == "C", call).when(col(cp) == "P", put)
    return staged.withColumn(out, value).drop("__d1", "__disc", "__sqt", "__d2", "__t1", "__t2")
