"""Registry of queries, their oracles and the SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under ``name`` together with its DuckDB form."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def r(expr: str, digits: int = 6) -> str:
    """SQL text of the half-even rounding used on the Spark side."""
    scale = f"1e{digits}"
    return f"(round_even(({expr}) * {scale}, 0) / {scale} + 0.0)"


Z95 = "1.959963985"


def wilson_sql(x: str, n: str) -> tuple[str, str]:
    """Textbook score interval: (p + z^2/2n -+ z sqrt(p(1-p)/n + z^2/4n^2)) / (1 + z^2/n)."""
    p, z, n = f"(({x})::DOUBLE / ({n}))", f"{Z95}::DOUBLE", f"({n})::DOUBLE"
    mid, root = f"{p} + {z} * {z} / (2 * {n})", f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n}))"
    low = f"(CASE WHEN {n} <= 0 THEN 0.0 ELSE greatest(0.0, ({mid} - {root}) / (1 + {z} * {z} / {n})) END)"
    high = f"(CASE WHEN {n} <= 0 THEN 1.0 ELSE least(1.0, ({mid} + {root}) / (1 + {z} * {z} / {n})) END)"
    return low, high


def newcombe_sql(a: str, n: str, b: str, m: str) -> tuple[str, str]:
    (la, ua), (lb, ub) = wilson_sql(a, n), wilson_sql(b, m)
    pa, pb = f"(({a})::DOUBLE / ({n}))", f"(({b})::DOUBLE / ({m}))"
    low = f"greatest(-1.0, ({pa} - {pb}) - sqrt(pow({pa} - {la}, 2) + pow({ub} - {pb}, 2)))"
    high = f"least(1.0, ({pa} - {pb}) + sqrt(pow({ua} - {pa}, 2) + pow({pb} - {lb}, 2)))"
    return low, high


def _simpson(f: str, top: str, steps: int = 2000) -> str:
    """Integral of f(x) for x from 0 to ``top``; f uses ``x``."""
    return (
        f"(SELECT sum((CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f}) * ({top}) / {steps} / 3 "
        f"FROM (SELECT i, i * ({top}) / {steps}.0::DOUBLE AS x FROM range({steps + 1}) g(i)))"
    )


def normal_p_sql(z: str) -> str:
    top = f"least(abs({z}), 40.0)"
    return f"greatest(0.0, 1 - 2 * {_simpson('exp(-x * x / 2) / sqrt(2 * pi())', top)})"


def t_p_sql(t: str, df: str) -> str:
    pdf = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - ({df} + 1) / 2 * ln(1 + x * x / {df})) / sqrt({df} * pi())"
    return f"greatest(0.0, 1 - 2 * {_simpson(pdf, f'least(abs({t}), 60.0)')})"


def fisher_p_sql(a: str, b: str, c: str, d: str) -> str:
    n, row, col = f"({a} + {b} + {c} + {d})", f"({a} + {b})", f"({a} + {c})"

    def lp(x):
        return (
            f"(lgamma({row} + 1) + lgamma({n} - {row} + 1) + lgamma({col} + 1) + lgamma({n} - {col} + 1) - lgamma({n} + 1)"
            f" - lgamma({x} + 1) - lgamma({row} - {x} + 1) - lgamma({col} - {x} + 1) - lgamma({n} - {row} - {col} + {x} + 1))"
        )

    return (
        f"(SELECT least(1.0, sum(exp({lp('x')})) FILTER ({lp('x')} <= {lp(a)} + 1e-9)) "
        f"FROM unnest(range(greatest(0, {col} - ({n} - {row})), least({row}, {col}) + 1)) u(x))"
    )


def seed_sql(text: str) -> str:
    """63-bit seed of a text, as in the hashing helper."""
    return f"CAST(('0x' || sha256({text})[1:16])::UBIGINT % 9223372036854775808::UBIGINT AS BIGINT)"


def uniform_sql(text: str) -> str:
    return f"({seed_sql(text)}::DOUBLE / 9223372036854775808.0::DOUBLE)"


def json_map_sql(key: str, n: str) -> str:
    return "'{' || string_agg('\"' || " + key + " || '\":' || " + n + ", ',' ORDER BY " + key + ") || '}'"
