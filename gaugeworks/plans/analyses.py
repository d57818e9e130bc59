"""Registered queries of whole analyses: inputs of levels, fits of many outputs, replicates, and several outputs together."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import many
from ..operators import resampling as rs
from ..operators import surrogates as sg
from ..operators.analyze import analyze
from ..problem import Categorical, Problem, Uniform
from .tables import ORDERS, borgonovo_sql, model, model_sql, order_rows, pawn_sql, portable_sql, query, rounded, table, transport_sql

# --- inputs of levels ---

LEVELS = Problem({"quantity": Uniform(0, 51), "flag": Categorical((0.33, 0.34, 0.33), ("A", "N", "R")), "status": Categorical((0.5, 0.5), ("F", "O"))})


def level_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_id, quantity, flag, status, y)``: a count, and codes of two columns, against revenue that depends on the flag."""
    code = lambda c, known: F.array_position(F.array(*map(F.lit, known)), F.col(c)).cast("double") - 1
    flag = code("l_returnflag", "ANR")
    y = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + 0.25 * flag)
    return table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("run_id"), F.col("l_quantity").alias("quantity"), flag.alias("flag"), code("l_linestatus", "FO").alias("status"), y.alias("y"))


_LEVELS = """r AS (SELECT (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS run_id, l_quantity AS quantity, strpos('ANR', l_returnflag) - 1 AS flag, strpos('FO', l_linestatus) - 1 AS status,
  l_extendedprice * (1 - l_discount) * (1 + 0.25 * (strpos('ANR', l_returnflag) - 1)) AS y FROM lineitem)"""


def _level_classes(m: int) -> str:
    return f"""{_LEVELS}, k AS (SELECT 'quantity' AS param, y, ((row_number() OVER (ORDER BY quantity, run_id) * {m} - 1) // count(*) OVER ())::INT AS class, count(*) OVER () AS n FROM r
  UNION ALL SELECT 'flag', y, flag::INT, count(*) OVER () FROM r UNION ALL SELECT 'status', y, status::INT, count(*) OVER () FROM r)"""


@query("transport_levels", transport_sql(_level_classes(10)))
def transport_levels(spark, sf_dir):
    runs = level_runs(spark, sf_dir)
    return rounded(analyze("optimal_transport", LEVELS, "y", runs, n_classes=10).table, "param")


@query("borgonovo_levels", borgonovo_sql(_level_classes(10)))
def borgonovo_levels(spark, sf_dir):
    runs = level_runs(spark, sf_dir)
    return rounded(analyze("borgonovo", LEVELS, "y", runs, n_classes=10).table, "param")


@query("pawn_levels", f"""WITH {_LEVELS}, b AS (SELECT 'quantity' AS param, y, {' + '.join(f'(quantity / 51 >= {k / 10!r})::INT' for k in range(1, 10))} AS bin FROM r UNION ALL SELECT 'flag', y, flag::INT FROM r UNION ALL SELECT 'status', y, status::INT FROM r),
{pawn_sql('max')}""")
def pawn_levels(spark, sf_dir):
    runs = level_runs(spark, sf_dir)
    return rounded(analyze("pawn", LEVELS, "y", runs, statistic="max").table, "param")


# --- replicates of a partition ---


def _transport_reps(replicates: int, seed: int) -> str:
    """Each replicate's copies of orders, placed anew by month and order, as a parameter of its own."""
    return f"""{ORDERS}, u AS (SELECT *, row_number() OVER (ORDER BY run_id) - 1 AS pos, count(*) OVER () AS size FROM o),
d AS (SELECT rep, u.run_id AS drawn, {portable_sql('rep', 'pos', seed)} % size AS at FROM range({replicates}) t(rep), u),
c AS (SELECT d.rep, d.drawn, u.run_id, u.x3, {model_sql('u.x1', 'u.x2', 'u.x3')} AS y FROM d JOIN u ON u.pos = d.at),
k AS (SELECT rep AS param, y, ((row_number() OVER w * 12 - 1) // count(*) OVER (PARTITION BY rep))::INT AS class, count(*) OVER (PARTITION BY rep) AS n FROM c WINDOW w AS (PARTITION BY rep ORDER BY x3, run_id, drawn))"""


@query("transport_intervals", f"SELECT 'x3' AS param, round(quantile_cont(ot, 0.025), 6) AS lower, round(quantile_cont(ot, 0.975), 6) AS upper FROM ({transport_sql(_transport_reps(20, 13)).replace('round(sum(p * w2) / (2 * any_value(v)), 6) AS ot', 'sum(p * w2) / (2 * any_value(v)) AS ot')})")
def transport_intervals(spark, sf_dir):
    """Replicates of the index of an input with twelve values: runs are placed once, and again by weights."""
    rows = order_rows(spark, sf_dir)
    outputs = rows.select("run_id", model(*map(F.col, ("x1", "x2", "x3"))).alias("y"))
    got = analyze("optimal_transport", Problem({"x3": Uniform(0, 1.2)}), outputs, rows.select("run_id", "x3"), n_classes=12, n_bootstrap=20, seed=13, draw=rs.portable)
    return rounded(got.table.select("param", F.col("ot_lower").alias("lower"), F.col("ot_upper").alias("upper")), "param")


# --- fits of many outputs ---

EMBEDDED = Problem({"x1": Uniform(0, 1), "x2": Uniform(0, 1), "x3": Uniform(0, 1)})
OUTPUTS = 64


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_id, x1, x2, x3, ys)``: all components of each embedding as outputs of its label and two residues of its number."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("run_id"), (F.col("label") % 10 / 10).alias("x1"), (F.col("vec_id") % 101 / 101).alias("x2"), (F.col("vec_id") % 89 / 89).alias("x3"), F.col("embedding").cast("array<double>").alias("ys"))


_EMBEDDED = """e AS (SELECT vec_id AS run_id, (label % 10) / 10 AS x1, (vec_id % 101) / 101 AS x2, (vec_id % 89) / 89 AS x3, embedding FROM embeddings)"""
_TERMS = sorted((e for e in itertools.product(range(3), repeat=3) if sum(e) <= 2), key=lambda e: (sum(e), [-x for x in e]))


def _legendre_sql(term: tuple[int, ...]) -> str:
    one = {1: "sqrt(3) * (2 * x{j} - 1)", 2: "sqrt(5) * (3 * (2 * x{j} - 1) * (2 * x{j} - 1) - 1) / 2"}
    return " * ".join("(" + one[e].format(j=j + 1) + ")" for j, e in enumerate(term) if e) or "1.0::DOUBLE"


def solve_sql(rows: str, keys: str, p: int, ridge: dict[int, str] | None = None) -> str:
    """CTEs that end in ``solved (keys, c0, c1, ...)``: normal equations by elimination, from the columns ``f0, f1, ...`` and ``y`` of ``rows``, weighted by ``w``."""
    g = ", ".join(f"sum(w * f{i} * f{j}) AS g{i}_{j}" for i in range(p) for j in range(i, p))
    b = ", ".join(f"sum(w * f{i} * y) AS b{i}" for i in range(p))
    steps = [f"s0 AS (SELECT {keys}, {g}, {b} FROM {rows} GROUP BY {keys})"]
    if ridge:
        steps[0] = steps[0].replace("s0 AS", "s AS", 1)
        steps.append("s0 AS (SELECT * REPLACE (" + ", ".join(f"g{i}_{i} + {r} AS g{i}_{i}" for i, r in ridge.items()) + ") FROM s)")
    for k in range(p - 1):
        left = [f"g{i}_{j} - g{k}_{i} * g{k}_{j} / g{k}_{k} AS g{i}_{j}" for i in range(k + 1, p) for j in range(i, p)] + [f"b{i} - g{k}_{i} * b{k} / g{k}_{k} AS b{i}" for i in range(k + 1, p)]
        steps.append(f"s{k + 1} AS MATERIALIZED (SELECT * REPLACE ({', '.join(left)}) FROM s{k})")
    back, out = f"s{p - 1}", []
    for i in range(p - 1, -1, -1):
        steps.append(f"t{i} AS MATERIALIZED (SELECT *, (b{i}{''.join(f' - g{i}_{j} * c{j}' for j in range(i + 1, p))}) / g{i}_{i} AS c{i} FROM {back})")
        back, out = f"t{i}", [f"c{i}", *out]
    return ", ".join(steps) + f", solved AS (SELECT {keys}, {', '.join(out)} FROM {back})"


def _pce_rows(weights: str = "") -> str:
    f = ", ".join(f"{_legendre_sql(t)} AS f{i}" for i, t in enumerate(_TERMS))
    return f"{_EMBEDDED}, f AS (SELECT {'rep, w' if weights else '1 AS w'}, o AS output_idx, embedding[o + 1]::DOUBLE AS y, {f} FROM e{weights}, range({OUTPUTS}) r(o))"


def _parts(on) -> str:
    return "(" + (" + ".join(f"c{i} * c{i}" for i, t in enumerate(_TERMS) if sum(t) and on(t)) or "0.0") + ")"


_ALL = _parts(lambda t: True)


def _pce_indices(keys: str) -> str:
    rows = []
    for j in range(3):
        shapley = " + ".join(f"c{i} * c{i} / {sum(e > 0 for e in t)}" for i, t in enumerate(_TERMS) if t[j])
        rows.append(f"SELECT {keys}, 'x{j + 1}' AS param, {_parts(lambda t: t[j] and sum(e > 0 for e in t) == 1)} / {_ALL} AS s1, {_parts(lambda t: t[j])} / {_ALL} AS st, ({shapley}) / {_ALL} AS shapley FROM solved")
    return " UNION ALL ".join(rows)


@query("pce_embeddings", f"""WITH {_pce_rows()}, {solve_sql('f', 'output_idx', len(_TERMS))}, v AS (SELECT output_idx, var_pop(y) AS variance FROM f GROUP BY output_idx)
SELECT output_idx::INT AS output_idx, param, round(s1, 6) AS s1, round(st, 6) AS st, round(shapley, 6) AS shapley, round(variance, 6) AS variance FROM ({_pce_indices('output_idx')}) JOIN v USING (output_idx)""")
def pce_embeddings(spark, sf_dir):
    """Polynomial chaos of all 64 outputs from one factor."""
    fits = many.pce(many.in_blocks(embedded(spark, sf_dir), "ys", OUTPUTS), EMBEDDED, OUTPUTS, order=2)
    return rounded(fits.indices().drop("rep"), "output_idx", "param")


@query("pce_embedding_predictions", f"WITH {_pce_rows().replace('SELECT 1 AS w', 'SELECT 1 AS w, run_id')}, {solve_sql('f', 'output_idx', len(_TERMS))} SELECT run_id, output_idx::INT AS output_idx, round({' + '.join(f'c{i} * f{i}' for i in range(len(_TERMS)))}, 9) AS prediction FROM f JOIN solved USING (output_idx)")
def pce_embedding_predictions(spark, sf_dir):
    runs = embedded(spark, sf_dir)
    return rounded(many.pce(many.in_blocks(runs, "ys", OUTPUTS), EMBEDDED, OUTPUTS, order=2).predict(runs), "run_id", "output_idx", digits=9)


@query("pce_intervals", f"""WITH {_pce_rows(' JOIN x USING (run_id)').replace('e AS (', f'''u AS (SELECT vec_id AS run_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS size FROM embeddings),
x AS (SELECT rep, t.run_id, count(*) AS w FROM (SELECT rep, {portable_sql('rep', 'pos', 17)} % size AS at FROM range(20) z(rep), u) d JOIN u t ON t.pos = d.at GROUP BY ALL), e AS (''', 1)},
{solve_sql('f', 'rep, output_idx', len(_TERMS))}, i AS ({_pce_indices('rep, output_idx')})
SELECT output_idx::INT AS output_idx, param, round(quantile_cont(st, 0.025), 6) AS st_lower, round(quantile_cont(st, 0.975), 6) AS st_upper, round(quantile_cont(shapley, 0.025), 6) AS shapley_lower, round(quantile_cont(shapley, 0.975), 6) AS shapley_upper FROM i GROUP BY output_idx, param""")
def pce_intervals(spark, sf_dir):
    """Intervals of all outputs' indices from refits of 20 replicates, in the same pass as the fits."""
    runs = embedded(spark, sf_dir)
    long = runs.select("run_id", F.posexplode("ys").alias("output_idx", "y"))
    got = analyze("shapley", EMBEDDED, long, runs.drop("ys"), slices=["output_idx"], order=2, n_bootstrap=20, seed=17, draw=rs.portable)
    return rounded(got.table.select("output_idx", "param", "st_lower", "st_upper", "shapley_lower", "shapley_upper"), "output_idx", "param")


def _spline_sql(i: int, x: str) -> str:
    """The i-th of five cubic B-splines over two intervals."""
    z = f"(2 * least(greatest({x}, 0), 1) - ({i - 3}))"
    return f"CASE WHEN {z} <= 0 OR {z} >= 4 THEN 0 WHEN {z} < 1 THEN pow({z}, 3) / 6 WHEN {z} < 2 THEN (-3 * pow({z}, 3) + 12 * pow({z}, 2) - 12 * {z} + 4) / 6 WHEN {z} < 3 THEN (3 * pow({z}, 3) - 24 * pow({z}, 2) + 60 * {z} - 44) / 6 ELSE pow(4 - {z}, 3) / 6 END"


_SPLINES = ", ".join(f"{_spline_sql(i, f'x{j + 1}')} AS h{5 * j + i}" for j in range(3) for i in range(5))
_TRACE = {k: "1e-6 * (" + " + ".join(f"g{i}_{i}" for i in range(5 * j, 5 * j + 5)) + ") / 5" for j in range(3) for k in range(5 * j, 5 * j + 5)}
_FUNCTION = [" + ".join(f"c{i} * f{i}" for i in range(5 * j, 5 * j + 5)) for j in range(3)]


@query("hdmr_embeddings", f"""WITH {_EMBEDDED}, h AS (SELECT run_id, {_SPLINES}, embedding FROM e), m AS (SELECT {', '.join(f'avg(h{i}) AS m{i}' for i in range(15))} FROM h),
f AS (SELECT 1 AS w, o AS output_idx, embedding[o + 1]::DOUBLE AS y, {', '.join(f'h{i} - m{i} AS f{i}' for i in range(15))} FROM h, m, range({OUTPUTS}) r(o)), {solve_sql('f', 'output_idx', 15, _TRACE)},
p AS (SELECT output_idx, y, {', '.join(f'{x} AS p{j}' for j, x in enumerate(_FUNCTION))} FROM f JOIN solved USING (output_idx)), q AS (SELECT *, p0 + p1 + p2 AS p FROM p)
{' UNION ALL '.join(f"SELECT output_idx::INT AS output_idx, 'x{j + 1}' AS term, round(var_pop(p{j}) / var_pop(y), 5) AS sa, round((covar_pop(p{j}, p) - var_pop(p{j})) / var_pop(y), 5) AS sb, round(covar_pop(p{j}, p) / var_pop(y), 5) AS s FROM q GROUP BY output_idx" for j in range(3))}""")
def hdmr_embeddings(spark, sf_dir):
    """Structural and correlative shares of all 64 outputs from one Gram matrix, functions fitted in turn until they rest."""
    fits = many.hdmr(many.in_blocks(embedded(spark, sf_dir), "ys", OUTPUTS), EMBEDDED, OUTPUTS, order=1, most=5000, tol=1e-13)
    return rounded(fits.terms.select("output_idx", "term", "sa", "sb", "s"), "output_idx", "term", digits=5)


# --- kernels with greedy centres ---

CENTRES, GAMMA, RIDGE = 8, 2.0, 1e-6


def _greedy_sql(centres: int, gamma: float) -> str:
    """Newton bases of centres taken one by one, each where the power function is largest, of equals the smallest values."""
    steps = [f"n0 AS (SELECT run_id, x1 / 1.2 AS a, x2 / 1.2 AS b, x3 / 1.2 AS c, {model_sql('x1', 'x2', 'x3')} AS y, 1.0::DOUBLE AS power FROM o)"]
    for k in range(centres):
        before = "".join(f" - n.v{j} * p.v{j}" for j in range(k))
        steps.append(f"p{k} AS MATERIALIZED (SELECT * FROM n{k} ORDER BY power DESC, a, b, c, y LIMIT 1)")
        steps.append(f"""n{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (same) REPLACE (CASE WHEN same THEN 0 ELSE greatest(power - v{k} * v{k}, 0) END AS power) FROM (
  SELECT n.*, (exp(-{gamma} * (pow(n.a - p.a, 2) + pow(n.b - p.b, 2) + pow(n.c - p.c, 2))){before}) / sqrt(p.power) AS v{k}, n.a = p.a AND n.b = p.b AND n.c = p.c AS same FROM n{k} n, p{k} p))""")
    return ", ".join(steps)


_SPREAD = f"{RIDGE} + 1e-8 * ((" + " + ".join(f"g{i}_{i}" for i in range(CENTRES)) + f") / {CENTRES} + {RIDGE})"


@query("vkoga_predictions", f"""WITH {ORDERS}, {_greedy_sql(CENTRES, GAMMA)}, f AS (SELECT 1 AS one, 1 AS w, run_id, y - avg(y) OVER () AS y, avg(y) OVER () AS m, {', '.join(f'v{i} AS f{i}' for i in range(CENTRES))} FROM n{CENTRES}),
{solve_sql('f', 'one', CENTRES, dict.fromkeys(range(CENTRES), _SPREAD))} SELECT run_id, round(m + {' + '.join(f'c{i} * f{i}' for i in range(CENTRES))}, 6) AS prediction FROM f JOIN solved USING (one)""")
def vkoga_predictions(spark, sf_dir):
    """A kernel expansion of few centres, chosen over all orders."""
    rows = order_rows(spark, sf_dir)
    runs = rows.withColumn("y", model(*map(F.col, ("x1", "x2", "x3"))))
    fit = sg.vkoga(runs, Problem({c: Uniform(0, 1.2) for c in ("x1", "x2", "x3")}), gammas=(GAMMA,), ridges=(RIDGE,), max_centres=CENTRES)
    return rounded(fit.predict(rows).select("run_id", "prediction"), "run_id")


# --- several outputs together ---

_ROUNDS = 20


def _sinkhorn_sql(rounds: int, epsilon: float, classes: int) -> str:
    """Potentials round by round, over every pair of a run and a member."""
    steps = []
    for k in range(rounds):
        before = f"g{k - 1}" if k else "(SELECT cls, j, 0.0 AS g FROM j0)"
        steps.append(f"f{k} AS MATERIALIZED (SELECT c.cls, c.i, -any_value(e) * ln(sum(exp((g - c) / e + lb))) AS f FROM pairs c JOIN {before} g ON g.cls = c.cls AND g.j = c.j GROUP BY c.cls, c.i)")
        steps.append(f"g{k} AS MATERIALIZED (SELECT c.cls, c.j, -any_value(e) * ln(sum(exp((f - c) / e + la))) AS g FROM pairs c JOIN f{k} f ON f.cls = c.cls AND f.i = c.i GROUP BY c.cls, c.j)")
    last = rounds - 1
    return f"""WITH s AS (SELECT s_suppkey AS i, s_nationkey::DOUBLE AS x1, (s_suppkey * 7 % 101)::DOUBLE AS x2, s_acctbal + 100 * s_nationkey AS y1, s_acctbal / 100 + 3 * (s_suppkey * 7 % 101) AS y2 FROM supplier),
z AS (SELECT i, x1, x2, (y1 - avg(y1) OVER ()) / stddev_pop(y1) OVER () AS a, (y2 - avg(y2) OVER ()) / stddev_pop(y2) OVER () AS b, count(*) OVER ()::DOUBLE AS n FROM s),
v AS (SELECT 2 * (var_samp(a) + var_samp(b)) AS v FROM z),
m AS (SELECT 'x1' AS param, i AS j, a, b, (row_number() OVER (ORDER BY x1, i) * {classes} - 1) // n::BIGINT AS class FROM z UNION ALL SELECT 'x2', i, a, b, (row_number() OVER (ORDER BY x2, i) * {classes} - 1) // n::BIGINT FROM z),
q AS (SELECT *, count(*) OVER (PARTITION BY param, class)::DOUBLE AS p, param || class AS cls FROM m), j0 AS (SELECT cls, j FROM q),
pairs AS MATERIALIZED (SELECT q.cls, z.i, q.j, pow(z.a - q.a, 2) + pow(z.b - q.b, 2) AS c, {epsilon} * v AS e, -ln(n) AS la, -ln(p) AS lb FROM q, z, v), {', '.join(steps)},
w AS (SELECT c.cls, sum(exp((f + g - c) / e + la + lb) * c) AS w FROM pairs c JOIN f{last} f ON f.cls = c.cls AND f.i = c.i JOIN g{last} g ON g.cls = c.cls AND g.j = c.j GROUP BY c.cls),
d AS (SELECT param, cls, any_value(p) AS p, pow(avg(a), 2) + pow(avg(b), 2) AS adv FROM q GROUP BY param, cls), n AS (SELECT any_value(n) AS n FROM z)
SELECT param, round(sum(p / n * w / v), 6) AS ot, round(sum(p / n * adv / v), 6) AS advective, round(sum(p / n * greatest(w - adv, 0) / v), 6) AS diffusive, round(2 * any_value(n) / (any_value(n) - 1) * sum(p / n * adv / v), 6) AS s1 FROM d JOIN w USING (cls), v, n GROUP BY param"""


@query("transport_joint", _sinkhorn_sql(_ROUNDS, 0.2, 4))
def transport_joint(spark, sf_dir):
    """Two outputs as one cloud: entropic plans after a set number of rounds."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run_id"), F.col("s_nationkey").cast("double").alias("x1"), (F.col("s_suppkey") * 7 % 101).cast("double").alias("x2"), F.col("s_acctbal"))
    y = F.array(F.struct(F.lit(1).alias("o"), (F.col("s_acctbal") + 100 * F.col("x1")).alias("y")), F.struct(F.lit(2).alias("o"), (F.col("s_acctbal") / 100 + 3 * F.col("x2")).alias("y")))
    outputs = s.select("run_id", F.explode(y).alias("s")).select("run_id", "s.*")
    p = Problem({"x1": Uniform(0, 25), "x2": Uniform(0, 101)})
    got = analyze("optimal_transport", p, outputs, s, slices=["o"], mode="multivariate", n_classes=4, epsilon=0.2, max_iter=_ROUNDS, tol=0.0)
    return rounded(got.table.drop("unconverged"), "param")
