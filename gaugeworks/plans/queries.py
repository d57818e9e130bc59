"""The registered queries of the library proper, each over whole tables, and SQL with the same rows."""

from __future__ import annotations

import math
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import normal_ppf_sql
from ..operators import design_based as db
from ..operators import given_data as gd
from ..operators import kernels
from ..operators import resampling as rs
from ..operators import surrogates as sg
from ..operators.analyze import analyze
from ..operators.frames import drop_invalid, long_inputs, ranked, zero_variance
from ..problem import Gaussian, Lognormal, Problem, Triangular, Uniform, Weibull
from ..sources import dependent, designs, files, models
from . import analyses  # noqa: F401  registers its queries
from .lineage import cut, fresh_path
from .tables import LINEITEM, NAMES, ORACLE_SQL, ORDERS, QUERIES, borgonovo_sql, classes_sql, lineitem_rows, model, model_sql, order_rows, pawn_sql, portable_sql, query, rounded, table, transport_sql

PI = math.pi


def frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(base_id, param, a, b, ab, ba)``: the first half of the orders, by key, is A and the second is B; an odd one is left."""
    outputs, layout, _ = _designed(spark, sf_dir)
    return db.pick_freeze(outputs, layout)


def _designed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outputs, layout and base points of the same design."""
    o = order_rows(spark, sf_dir)
    half = o.count() // 2
    placed = cut(ranked(o.withColumn("_all", F.lit(0)), ["_all"], ["run_id"]).drop("_all", "n"))
    a = placed.where(F.col("rank") < half).select(F.col("rank").alias("base_id"), *[F.col(c).alias("a_" + c) for c in NAMES])
    b = placed.where((F.col("rank") >= half) & (F.col("rank") < 2 * half)).select((F.col("rank") - half).alias("base_id"), *[F.col(c).alias("b_" + c) for c in NAMES])
    base = cut(a.join(b, "base_id"))
    runs, layout = designs.saltelli(base, NAMES)
    return runs.select("run_id", model(*map(F.col, NAMES)).alias("y")), layout, base


def _frozen_sql() -> str:
    pick = lambda side, j: [("b" if (k == j) == (side == "ab") else "a") + f".x{k}" for k in (1, 2, 3)]
    rows = " UNION ALL ".join(
        f"SELECT base_id, 'x{j}' AS param, {model_sql('a.x1', 'a.x2', 'a.x3')} AS a, {model_sql('b.x1', 'b.x2', 'b.x3')} AS b, {model_sql(*pick('ab', j))} AS ab, {model_sql(*pick('ba', j))} AS ba, a.x{j} AS ax, b.x{j} AS bx FROM p a JOIN q b USING (base_id)"
        for j in (1, 2, 3)
    )
    return f"""{ORDERS}, k AS (SELECT *, row_number() OVER (ORDER BY run_id) - 1 AS r, (SELECT count(*) // 2 FROM o) AS h FROM o),
p AS (SELECT r AS base_id, x1, x2, x3 FROM k WHERE r < h), q AS (SELECT r - h AS base_id, x1, x2, x3 FROM k WHERE r >= h AND r < 2 * h), f AS ({rows})"""


V = "(avg((a * a + b * b) / 2) - avg((a + b) / 2) * avg((a + b) / 2))"
_PAIR = lambda u, v: f"(avg({u} * {v}) - pow(avg(({u} + {v}) / 2), 2)) / (avg(({u} * {u} + {v} * {v}) / 2) - pow(avg(({u} + {v}) / 2), 2))"
SOBOL_SQL = {
    "saltelli-jansen": (f"avg(b * (ab - a)) / {V}", f"avg((a - ab) * (a - ab)) / 2 / {V}"),
    "jansen": (f"1 - avg((b - ab) * (b - ab)) / 2 / {V}", f"avg((a - ab) * (a - ab)) / 2 / {V}"),
    "mauntz-kucherenko": (f"avg(b * (ab - a)) / {V}", f"avg(a * (a - ab)) / {V}"),
    "janon-monod": (_PAIR("b", "ab"), f"1 - {_PAIR('a', 'ab')}"),
    "martinez": ("corr(b, ab)", "1 - corr(a, ab)"),
    "azzini-rosati": ("2 * sum((ab - a) * (b - ba)) / sum((a - b) * (a - b) + (ba - ab) * (ba - ab))", "sum((ab - a) * (ab - a) + (b - ba) * (b - ba)) / sum((a - b) * (a - b) + (ba - ab) * (ba - ab))"),
}

# --- estimators on designed runs ---

for _name in db.ESTIMATORS:
    QUERIES["sobol_" + _name.replace("-", "_")] = lambda spark, sf_dir, e=_name: rounded(db.sobol(frozen(spark, sf_dir), e), "param")
    ORACLE_SQL["sobol_" + _name.replace("-", "_")] = f"WITH {_frozen_sql()} SELECT param, round({SOBOL_SQL[_name][0]}, 6) AS s1, round({SOBOL_SQL[_name][1]}, 6) AS st, round({V}, 6) AS variance FROM f GROUP BY param"


@query("sobol_second_order", f"""WITH {_frozen_sql()}, s AS (SELECT param, avg(b * (ab - a)) / {V} AS s1 FROM f GROUP BY param)
SELECT x.param, y.param AS param_j, round((avg((x.ba * y.ab + y.ba * x.ab) / 2) - avg(x.a * x.b)) / (avg((x.a * x.a + x.b * x.b) / 2) - pow(avg((x.a + x.b) / 2), 2)) - any_value(i.s1) - any_value(j.s1), 6) AS s2
FROM f x JOIN f y ON x.base_id = y.base_id AND x.param < y.param JOIN s i ON i.param = x.param JOIN s j ON j.param = y.param GROUP BY x.param, y.param""")
def sobol_second_order(spark, sf_dir):
    return rounded(db.sobol_second(cut(frozen(spark, sf_dir))), "param", "param_j")


@query("sobol_standardised", f"""WITH {_frozen_sql()}, m AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM (SELECT unnest([a, b, ab, ba]) AS v FROM f)),
g AS (SELECT param, (a - m) / s AS a, (b - m) / s AS b, (ab - m) / s AS ab FROM f, m) SELECT param, round(avg(b * (ab - a)) / {V}, 6) AS s1, round(avg((a - ab) * (a - ab)) / 2 / {V}, 6) AS st, round({V}, 6) AS variance FROM g GROUP BY param""")
def sobol_standardised(spark, sf_dir):
    return rounded(db.sobol(db.standardised(cut(frozen(spark, sf_dir)), ["a", "b", "ab", "ba"])), "param")


def _effects(spark, sf_dir):
    """Radial effects: each base point's A, and A with one input from B."""
    o = order_rows(spark, sf_dir)
    half = o.count() // 2
    placed = cut(ranked(o.withColumn("_all", F.lit(0)), ["_all"], ["run_id"]).drop("_all", "n"))
    b = placed.where((F.col("rank") >= half) & (F.col("rank") < 2 * half)).select((F.col("rank") - half).alias("rank"), *[F.col(c).alias("b_" + c) for c in NAMES])
    both = placed.where(F.col("rank") < half).join(b, "rank")
    moved = lambda j: model(*[F.col(("b_" if k == j else "") + c) for k, c in enumerate(NAMES)])
    steps = F.explode(F.array(*[F.struct(F.lit(c).alias("param"), moved(j).alias("after"), (F.col("b_" + c) - F.col(c)).alias("delta")) for j, c in enumerate(NAMES)]))
    rows = both.select(F.col("rank").alias("traj_id"), model(*map(F.col, NAMES)).alias("before"), steps.alias("s"))
    return rows.select("traj_id", "s.param", ((F.col("s.after") - F.col("before")) / F.when(F.col("s.delta") != 0, F.col("s.delta"))).alias("ee")).where("ee is not null")


EE = "e AS (SELECT base_id AS traj_id, param, (ab - a) / (bx - ax) AS ee FROM f WHERE bx <> ax)"


@query("morris_radial", f"WITH {_frozen_sql()}, {EE} SELECT param, round(avg(ee), 6) AS mu, round(avg(abs(ee)), 6) AS mu_star, round(stddev_samp(ee), 6) AS sigma FROM e GROUP BY param")
def morris_radial(spark, sf_dir):
    return rounded(db.morris(_effects(spark, sf_dir)), "param")


@query("morris_bootstrap", f"""WITH {_frozen_sql()}, {EE}, n AS (SELECT count(*) AS n FROM p),
d AS (SELECT rep, ((({rs.M1} * (rep + 1) + {rs.M2} * (i + 1) + 7) % {rs.MODULUS}) * {rs.M1}) % {rs.MODULUS} % n AS traj_id FROM range(20) t(rep), n, (SELECT r AS i FROM k WHERE r < h)),
w AS (SELECT rep, traj_id, count(*) AS w FROM d GROUP BY ALL), m AS (SELECT rep, param, sum(w * abs(ee)) / sum(w) AS v FROM e JOIN w USING (traj_id) GROUP BY ALL)
SELECT param, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper FROM m GROUP BY param""")
def morris_bootstrap(spark, sf_dir):
    effects = cut(_effects(spark, sf_dir))
    units = spark.range(order_rows(spark, sf_dir).count() // 2).select(F.col("id").alias("unit"), F.col("id").alias("pos"))
    w = rs.weights(units, 20, 7, rs.portable)
    reps = effects.join(w, F.col("traj_id") == F.col("unit")).groupBy("rep", "param").agg((F.sum(F.col("w") * F.abs("ee")) / F.sum("w")).alias("v"))
    return rounded(rs.intervals(reps, ["param"], "v"), "param")


@query("kucherenko_blocks", f"""WITH {_frozen_sql()} SELECT param, round(covar_pop(a, ba) / var_pop(a), 6) AS s1, round(avg((a - ab) * (a - ab)) / 2 / var_pop(a), 6) AS st, round(var_pop(a), 6) AS variance FROM f GROUP BY param""")
def kucherenko_blocks(spark, sf_dir):
    rows = frozen(spark, sf_dir).select("param", F.col("a").alias("joint"), F.col("ba").alias("kept"), F.col("ab").alias("redrawn"))
    return rounded(db.kucherenko(cut(rows)), "param")


@query("dgsm_bounds", f"""WITH {ORDERS}, d AS (SELECT unnest([{{'param': 'x1', 'd': 2 * x1 + 0.5 * x3}}, {{'param': 'x2', 'd': x3 + 1}}, {{'param': 'x3', 'd': x2 + 0.5 * x1}}], recursive := true), {model_sql('x1', 'x2', 'x3')} AS y FROM o)
SELECT param, round(avg(d * d), 6) AS nu, round(avg(d), 6) AS mu, round({1 / PI**2!r} * avg(d * d) / var_pop(y), 6) AS upper_bound, round({1 / 12!r} * avg(d) * avg(d) / var_pop(y), 6) AS lower_bound, round(var_pop(y), 6) AS variance FROM d GROUP BY param""")
def dgsm_bounds(spark, sf_dir):
    x1, x2, x3 = map(F.col, NAMES)
    slope = F.explode(F.array(*[F.struct(F.lit(c).alias("param"), s.alias("d")) for c, s in zip(NAMES, (2 * x1 + 0.5 * x3, x3 + 1, x2 + 0.5 * x1))]))
    rows = order_rows(spark, sf_dir).select(slope.alias("s"), model(x1, x2, x3).alias("y")).select("s.*", "y")
    return rounded(db.dgsm(rows, dict.fromkeys(NAMES, db.uniform_poincare(0, 1)), dict.fromkeys(NAMES, 1 / 12)), "param")


def _scaled(u: str, j: int) -> str:
    """A unit coordinate on the range of the j-th input, then on that of the test model."""
    return f"(-pi() + 2 * pi() * (lo{j} + (hi{j} - lo{j}) * {u}))"


#: One row: the number of orders, the frequencies for curves of as many points, and the range of each input.
_RANGES = f"""{ORDERS}, r AS (SELECT count(*) AS n, (count(*) - 1) // 8 AS main, greatest(1, (count(*) - 1) // 64) AS top, {', '.join(f'min(x{j}) AS lo{j}, max(x{j}) AS hi{j}' for j in (1, 2, 3))} FROM o)"""


def _efast_sql() -> str:
    freq = lambda c, j: "main" if j == c else ("1", "top")[j - (j > c)]
    x = lambda c, j: _scaled(f"(0.5 + asin(sin({freq(c, j)} * (2 * pi() * t / n) + 0.3)) / pi())", j + 1)
    points = "(SELECT unnest(range(n)) AS t, * FROM r)"
    curves = " UNION ALL ".join(f"SELECT 'x{c + 1}' AS param, t, sin({x(c, 0)}) + 7 * pow(sin({x(c, 1)}), 2) + 0.1 * pow({x(c, 2)}, 4) * sin({x(c, 0)}) AS y FROM {points}" for c in range(3))
    return f"""WITH {_RANGES}, c AS ({curves}), s AS (SELECT param, avg(y) AS m, var_pop(y) AS v FROM c GROUP BY param),
k AS (SELECT DISTINCT k FROM (SELECT unnest(range(1, main // 2 + 1)) AS k FROM r UNION ALL SELECT unnest([main, 2 * main, 3 * main, 4 * main]) FROM r)),
w AS (SELECT param, k, avg((y - m) * cos(2 * pi() * ((k * t) % n) / n)) AS re, avg((y - m) * sin(2 * pi() * ((k * t) % n) / n)) AS im FROM c JOIN s USING (param), k, r GROUP BY param, k)
SELECT param, round(sum(CASE WHEN k % main = 0 THEN 2 * (re * re + im * im) ELSE 0 END) / any_value(v), 6) AS s1, round(1 - sum(CASE WHEN k <= main // 2 THEN 2 * (re * re + im * im) ELSE 0 END) / any_value(v), 6) AS st FROM w JOIN s USING (param), r GROUP BY param"""


@query("efast_ishigami", _efast_sql())
def efast_ishigami(spark, sf_dir):
    """Curves of as many points as there are orders, over the ranges of the orders' inputs."""
    o = order_rows(spark, sf_dir)
    r = o.agg(F.count("*").alias("n"), *[f(c).alias(k + c) for c in NAMES for k, f in (("lo", F.min), ("hi", F.max))]).first()
    curves, main = designs.efast_design(spark, NAMES, r.n, phases=[[0.3] * 3] * 3)
    xs = [-PI + 2 * PI * (r["lo" + c] + (r["hi" + c] - r["lo" + c]) * F.col("u_" + c)) for c in NAMES]
    return rounded(db.efast(curves.select("param", "t", "n", models.ishigami(*xs).alias("y")), main), "param")


# --- estimators on given data ---


@query("rank_lineitem", f"""WITH {LINEITEM}, p AS (SELECT param, y, avg(y) OVER w AS m, lead(y) OVER (PARTITION BY param ORDER BY x, run_id) AS nxt, first_value(y) OVER (PARTITION BY param ORDER BY x, run_id) AS fst FROM r WINDOW w AS (PARTITION BY param))
SELECT param, round(avg((y - m) * (coalesce(nxt, fst) - m)) / var_pop(y), 6) AS s1 FROM p GROUP BY param""")
def rank_lineitem(spark, sf_dir):
    return rounded(gd.rank_index(lineitem_rows(spark, sf_dir)), "param")


@query("class_index_lineitem", f"""WITH {classes_sql(16)}, c AS (SELECT param, class, count(*) AS c, avg(y) AS cm FROM k GROUP BY ALL), t AS (SELECT param, avg(y) AS m, var_pop(y) AS v, count(*) AS n FROM k GROUP BY param)
SELECT param, round(sum(c / n * (cm - m) * (cm - m)) / any_value(v), 6) AS s1 FROM c JOIN t USING (param) GROUP BY param""")
def class_index_lineitem(spark, sf_dir):
    return rounded(gd.class_index(lineitem_rows(spark, sf_dir), 16), "param")


@query("pawn_orders", f"""WITH {ORDERS}, r AS (SELECT param, u, y FROM (SELECT x1, x2, x3, {model_sql('x1', 'x2', 'x3')} AS y FROM o) UNPIVOT (u FOR param IN (x1, x2, x3))),
b AS (SELECT *, CASE WHEN u < 0 OR u > 1 THEN NULL ELSE {' + '.join(f'(u >= {k / 10!r})::INT' for k in range(1, 10))} END AS bin FROM r),
{pawn_sql("median")}""")
def pawn_orders(spark, sf_dir):
    rows = order_rows(spark, sf_dir).select(*NAMES, model(*map(F.col, NAMES)).alias("y"))
    return rounded(gd.pawn(long_inputs(rows, NAMES, keep=("y",)).withColumnRenamed("x", "u")), "param")


@query("borgonovo_lineitem", borgonovo_sql(classes_sql(10)))
def borgonovo_lineitem(spark, sf_dir):
    return rounded(gd.borgonovo(lineitem_rows(spark, sf_dir), 10), "param")


@query("transport_lineitem", transport_sql(classes_sql(10)))
def transport_lineitem(spark, sf_dir):
    return rounded(gd.transport(lineitem_rows(spark, sf_dir), 10), "param")


@query("hsic_suppliers", f"""WITH s AS (SELECT s_suppkey AS k, s_nationkey::DOUBLE AS x1, (s_suppkey * 7 % 101)::DOUBLE AS x2, s_acctbal + 100 * s_nationkey AS y FROM supplier),
o AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS p FROM s), r AS (SELECT p, param, x FROM o UNPIVOT (x FOR param IN (x1, x2, y))),
d AS (SELECT a.param, a.p AS i, b.p AS j, (a.x - b.x) * (a.x - b.x) AS d2 FROM r a JOIN r b ON a.param = b.param), n AS (SELECT count(*)::DOUBLE AS n FROM s),
z AS (SELECT param, d2, row_number() OVER (PARTITION BY param ORDER BY d2) AS rk, count(*) OVER (PARTITION BY param) AS c FROM d WHERE i < j AND d2 > 0), b AS (SELECT param, d2 AS s2 FROM z WHERE rk = (c + 1) // 2),
g AS (SELECT d.param, i, j, exp(-d2 / (2 * s2)) AS k FROM d JOIN b USING (param)),
c AS (SELECT param, i, j, k - avg(k) OVER (PARTITION BY param, i) - avg(k) OVER (PARTITION BY param, j) + avg(k) OVER (PARTITION BY param) AS k FROM g),
w AS (SELECT i, j, max(CASE WHEN param = 'x1' THEN k END) AS x1, max(CASE WHEN param = 'x2' THEN k END) AS x2, max(CASE WHEN param = 'y' THEN k END) AS y FROM c GROUP BY i, j),
t AS (SELECT sum(x1 * y) AS xy1, sum(x2 * y) AS xy2, sum(x1 * x1) AS xx1, sum(x2 * x2) AS xx2, sum(y * y) AS yy, sum((1 + x2) * y) AS o1, sum((1 + x1) * y) AS o2, sum((1 + x1) * (1 + x2) * y) AS f FROM w),
m AS (SELECT rep, p, row_number() OVER (PARTITION BY rep ORDER BY {portable_sql('rep', 'p', 5)}, p) - 1 AS q FROM o, range(20) e(rep)),
v AS (SELECT a.rep, sum(w.x1 * u.y) AS v1, sum(w.x2 * u.y) AS v2 FROM w JOIN m a ON a.p = w.i JOIN m b ON b.p = w.j AND a.rep = b.rep JOIN w u ON u.i = a.q AND u.j = b.q GROUP BY a.rep),
k AS (SELECT count(*) FILTER (WHERE v1 >= xy1) AS k1, count(*) FILTER (WHERE v2 >= xy2) AS k2 FROM v, t)
SELECT 'x1' AS param, round(xy1 / n / n, 6) AS hsic_raw, round(xy1 / sqrt(xx1 * yy), 6) AS r2, round(1 - o1 / f, 6) AS total, round((k1 + 1) / 21, 6) AS p_value FROM t, n, k
UNION ALL SELECT 'x2', round(xy2 / n / n, 6), round(xy2 / sqrt(xx2 * yy), 6), round(1 - o2 / f, 6), round((k2 + 1) / 21, 6) FROM t, n, k""")
def hsic_suppliers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("run_id"), F.col("s_nationkey").cast("double").alias("x1"), (F.col("s_suppkey") * 7 % 101).cast("double").alias("x2"), (F.col("s_acctbal") + 100 * F.col("s_nationkey")).alias("y"))
    return rounded(kernels.hsic(s, ["x1", "x2"], permutations=20, seed=5, draw=rs.portable), "param")


@query("irregular_events", """WITH r AS (SELECT event_id AS run_id, event_type AS channel, day(ts)::INT AS day, 'x' AS param, minute(ts) + second(ts) / 60 AS x, value AS y FROM events),
p AS (SELECT *, avg(y) OVER (PARTITION BY channel, day) AS m, lead(y) OVER w AS nxt, first_value(y) OVER w AS fst FROM r WINDOW w AS (PARTITION BY channel, day ORDER BY x, run_id))
SELECT channel, day, param, round(coalesce(avg((y - m) * (coalesce(nxt, fst) - m)) / nullif(var_pop(y), 0), 'nan'::DOUBLE), 6) AS s1 FROM p GROUP BY channel, day, param""")
def irregular_events(spark, sf_dir):
    """Each channel has a time grid of its own; both are keys."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("channel"), F.dayofmonth("ts").alias("day"), F.lit("x").alias("param"), (F.minute("ts") + F.second("ts") / 60).alias("x"), F.col("value").alias("y"))
    return rounded(gd.rank_index(rows, ["channel", "day"]), "channel", "day", "param")


@query("aggregate_outputs", """WITH r AS (SELECT vec_id, label::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS o, unnest(embedding)::DOUBLE AS y FROM embeddings),
c AS (SELECT o, x, count(*) AS c, avg(y) AS cm FROM r GROUP BY ALL), t AS (SELECT o, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM r GROUP BY o), s AS (SELECT o, sum(c / n * (cm - m) * (cm - m)) / any_value(v) AS s1, any_value(v) AS v FROM c JOIN t USING (o) GROUP BY o)
SELECT 'label' AS param, round(sum(v * s1) / sum(v), 6) AS s1 FROM s""")
def aggregate_outputs(spark, sf_dir):
    """First-order index of the label, a categorical input, on all 64 outputs, then one index for all."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("double").alias("x"), F.posexplode("embedding").alias("output_idx", "y")).withColumn("y", F.col("y").cast("double"))
    levels = e.groupBy("output_idx", "x").agg(F.count("*").alias("c"), F.avg("y").alias("cm"))
    whole = e.groupBy("output_idx").agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("variance"))
    per = levels.join(whole, "output_idx").groupBy("output_idx").agg((F.sum(F.col("c") / F.col("n") * F.pow(F.col("cm") - F.col("m"), F.lit(2.0))) / F.first("variance")).alias("s1"), F.first("variance").alias("variance"))
    return rounded(rs.aggregated(per.withColumn("param", F.lit("label")), ["s1"]), "param")


# --- sources, transforms and policies ---


def _sobol_sql(n: str, dims: int, chosen=None) -> str:
    """Points ``u_x1, ...``, as many as the whole number ``n`` of the table that is joined here says."""
    x = lambda d: "xor(" * 31 + f"(g & 1) * {designs.direction_numbers(d)[0]}" + "".join(f", ((g >> {k}) & 1) * {v})" for k, v in enumerate(designs.direction_numbers(d)) if k)
    return f"SELECT base_id, {', '.join(f'{x(d)} / 4294967296.0::DOUBLE AS u_x{d + 1}' for d in chosen or range(dims))} FROM (SELECT i AS base_id, xor(i, i >> 1) AS g FROM (SELECT unnest(range(({n}))) AS i))"


_RANGED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey"]


@query("sobol_points", f"WITH p AS ({_sobol_sql('SELECT count(*) FROM customer', 5)}), r AS (SELECT {', '.join(f'min({c})::DOUBLE AS lo{j}, max({c})::DOUBLE AS hi{j}' for j, c in enumerate(_RANGED, 1))} FROM lineitem) SELECT base_id, {', '.join(f'lo{j} + (hi{j} - lo{j}) * u_x{j} AS {c}' for j, c in enumerate(_RANGED, 1))} FROM p, r")
def sobol_points(spark, sf_dir):
    """A point for each customer, over the ranges of five columns."""
    r = table(spark, sf_dir, "lineitem").agg(*[f(F.col(c).cast("double")).alias(k + c) for c in _RANGED for k, f in (("lo", F.min), ("hi", F.max))]).first()
    p = Problem({c: Uniform(r["lo" + c], r["hi" + c]) for c in _RANGED})
    return p.transform(designs.sobol_points(spark, table(spark, sf_dir, "customer").count(), p.names))


@query("marginal_maps", f"""WITH {ORDERS} SELECT run_id, round(-2 + 5 * x2, 6) AS uniform, round(2 * pow(-ln(1 - greatest(x2, 1e-12)), 1 / 1.5::DOUBLE), 6) AS weibull,
round(CASE WHEN greatest(x2, 1e-12) < 0.25 THEN 4 * sqrt(greatest(x2, 1e-12) * 0.25) ELSE 4 - 4 * sqrt((1 - greatest(x2, 1e-12)) * 0.75) END, 6) AS triangular FROM o""")
def marginal_maps(spark, sf_dir):
    p = Problem({"uniform": Uniform(-2, 3), "weibull": Weibull(1.5, 2.0), "triangular": Triangular(0, 1, 4)})
    units = order_rows(spark, sf_dir).select("run_id", *[F.col("x2").alias("u_" + c) for c in p.names])
    return rounded(p.transform(units), "run_id")


@query("spearman_orders", f"""WITH {ORDERS}, k AS (SELECT {', '.join(f'rank() OVER (ORDER BY x{j}) + (count(*) OVER (PARTITION BY x{j}) - 1) / 2 AS r{j}' for j in (1, 2, 3))} FROM o)
SELECT 'x1' AS param, 'x2' AS param_j, round(corr(r1, r2), 6) AS rho FROM k UNION ALL SELECT 'x1', 'x3', round(corr(r1, r3), 6) FROM k UNION ALL SELECT 'x2', 'x3', round(corr(r2, r3), 6) FROM k""")
def spearman_orders(spark, sf_dir):
    r = designs.spearman(order_rows(spark, sf_dir), NAMES)
    rows = [(NAMES[i], NAMES[j], float(r[i, j])) for i in range(3) for j in range(i + 1, 3)]
    return rounded(spark.createDataFrame(rows, "param string, param_j string, rho double"), "param", "param_j")


RUN = "run_id"
_IMAN = np.array([[1, 0.7, 0], [0.7, 1, -0.3], [0, -0.3, 1.0]])


def _iman_sql(seed: int) -> str:
    low = np.linalg.cholesky(_IMAN)
    z = ", ".join(f"{normal_ppf_sql(f'(({portable_sql(str(d), RUN, seed)} + 0.5::DOUBLE) / {rs.MODULUS})')} AS z{d}" for d in range(3))
    score = ", ".join(" + ".join(f"{float(low[i, j])!r} * z{j}" for j in range(i + 1)) + f" AS s{i + 1}" for i in range(3))
    ranks = ", ".join(f"row_number() OVER (ORDER BY s{i}, run_id) AS r{i}" for i in (1, 2, 3))
    parts = ", ".join(f"v{i} AS (SELECT x{i}, row_number() OVER (ORDER BY x{i}, run_id) AS r{i} FROM o)" for i in (1, 2, 3))
    return f"WITH {ORDERS}, z AS (SELECT run_id, {z} FROM o), s AS (SELECT run_id, {score} FROM z), r AS (SELECT run_id, {ranks} FROM s), {parts} SELECT run_id, x1, x2, x3 FROM r JOIN v1 USING (r1) JOIN v2 USING (r2) JOIN v3 USING (r3)"


@query("iman_conover_orders", _iman_sql(5))
def iman_conover_orders(spark, sf_dir):
    return designs.iman_conover(order_rows(spark, sf_dir), NAMES, _IMAN, 5, portable=True).select("run_id", *NAMES)


@query("distinct_runs", "WITH k AS (SELECT l_quantity, l_discount, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY ALL) SELECT row_number() OVER (ORDER BY first, l_quantity, l_discount) - 1 AS run_id, l_quantity, l_discount FROM k")
def distinct_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return designs.distinct_runs(rows, ["l_quantity", "l_discount"], "pos")[0]


@query("aligned_runs", "SELECT o_custkey AS run_id, count(*) AS n, round(sum(o_totalprice), 2) AS y, round(any_value(c_acctbal), 2) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
def aligned_runs(spark, sf_dir):
    outputs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("y"))
    inputs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.round("c_acctbal", 2).alias("x")).join(outputs.select("run_id"), "run_id", "left_semi")
    return designs.aligned(inputs, outputs).select("run_id", "n", "y", "x")


@query("drop_failed_runs", "WITH e AS (SELECT user_id, event_type, CASE WHEN value < 2 THEN NULL ELSE value END AS y FROM events) SELECT event_type, count(*) AS n, round(avg(y), 6) AS mean FROM e WHERE user_id NOT IN (SELECT user_id FROM e WHERE y IS NULL) GROUP BY event_type")
def drop_failed_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.when(F.col("value") >= 2, F.col("value")).alias("y"))
    return rounded(drop_invalid(rows, ["user_id"], "drop").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("y").alias("mean")), "event_type")


# --- fitted surrogates ---


def _problem() -> Problem:
    return Problem({c: Uniform(0, 1.2) for c in NAMES})


def _modelled(spark, sf_dir):
    return order_rows(spark, sf_dir).select(*NAMES, model(*map(F.col, NAMES)).alias("y"))


#: The model is a polynomial, so that its terms over independent inputs are known: a variance for each set of inputs.
_V = {"x1": 0.28152, "x2": 0.3072, "x3": 0.0972, "x2*x3": 0.0144, "x1*x3": 0.0036}
_T = f"{sum(_V.values())!r}::DOUBLE"


def _known_sql(*fields: str) -> str:
    rows = []
    for c in NAMES:
        mine = {u: v for u, v in _V.items() if c in u.split("*")}
        value = {"s1": _V[c], "st": sum(mine.values()), "shapley": sum(v / len(u.split("*")) for u, v in mine.items())}
        rows.append(f"SELECT '{c}' AS param, " + ", ".join(f"round({value[f]!r} / {_T}, 6) AS {f}" for f in fields))
    return " UNION ALL ".join(rows)


@query("pce_orders", _known_sql("s1", "st", "shapley"))
def pce_orders(spark, sf_dir):
    fit = sg.pce(_modelled(spark, sf_dir), _problem(), order=2)
    return rounded(spark.createDataFrame(fit.indices()), "param")


@query("pce_second_order", " UNION ALL ".join(f"SELECT '{i}' AS param, '{j}' AS param_j, round({_V.get(f'{i}*{j}', 0.0)!r} / {_T}, 6) AS s2" for i, j in (("x1", "x2"), ("x1", "x3"), ("x2", "x3"))))
def pce_second_order(spark, sf_dir):
    return rounded(spark.createDataFrame(sg.pce(_modelled(spark, sf_dir), _problem(), order=2).second_order()), "param", "param_j")


@query("pce_predictions", f"WITH {ORDERS} SELECT run_id, x1, x2, x3, round({model_sql('x1', 'x2', 'x3')}, 9) AS prediction FROM o")
def pce_predictions(spark, sf_dir):
    return rounded(sg.pce(_modelled(spark, sf_dir), _problem(), order=2, check=False).predict(order_rows(spark, sf_dir)), "run_id", *NAMES, digits=9)


@query("hdmr_orders")
def hdmr_orders(spark, sf_dir):
    return spark.createDataFrame(sg.hdmr(_modelled(spark, sf_dir), _problem()).terms)


_FIT_SQL = f"WITH {ORDERS} SELECT count(*) AS n, round(avg({model_sql('x1', 'x2', 'x3')}), 3) AS mean, 1.0::DOUBLE AS explained FROM o"


def _explained(runs: DataFrame, digits: int) -> DataFrame:
    """How much of the output's variance predictions leave nothing of."""
    left = F.avg(F.pow(F.col("y") - F.col("prediction"), F.lit(2.0)))
    return runs.agg(F.count("*").alias("n"), F.round(F.avg("prediction"), 3).alias("mean"), F.round(1 - left / F.var_pop("y"), digits).alias("explained"))


@query("hdmr_fit", _FIT_SQL)
def hdmr_fit(spark, sf_dir):
    """The model's functions are splines, so that the fit leaves nothing of the output's variance."""
    runs = _modelled(spark, sf_dir)
    return _explained(sg.hdmr(runs, _problem(), most=2000, tol=1e-9).predict(runs), 3)


@query("shapley_orders", _known_sql("shapley"))
def shapley_orders(spark, sf_dir):
    fit = sg.pce(_modelled(spark, sf_dir), _problem(), order=2, check=False)
    return rounded(spark.createDataFrame(fit.indices()[["param", "shapley"]]), "param")


@query("vkoga_orders")
def vkoga_orders(spark, sf_dir):
    return sg.kernel_indices(sg.vkoga(_modelled(spark, sf_dir), _problem()), spark)


@query("vkoga_fit", _FIT_SQL)
def vkoga_fit(spark, sf_dir):
    """With gamma and ridge given, a smooth model is met in full to two digits."""
    runs = _modelled(spark, sf_dir)
    return _explained(sg.vkoga(runs, _problem(), gammas=(0.5,), ridges=(1e-10,), max_centres=60).predict(runs), 2)


_SETS = ["l_returnflag", "l_linestatus", "l_discount"]


@query("subset_shapley", f"""WITH r AS (SELECT {', '.join(_SETS)}, l_extendedprice * (1 - l_discount) AS y FROM lineitem), w AS (SELECT avg(y) AS m, var_pop(y) AS v, count(*) AS n FROM r),
g AS (SELECT 7 - (4 * grouping({_SETS[2]}) + 2 * grouping({_SETS[1]}) + grouping({_SETS[0]})) AS mask, count(*) AS k, avg(y) AS a FROM r GROUP BY CUBE ({', '.join(_SETS)})),
c AS (SELECT mask, sum(k * (a - m) * (a - m)) / any_value(n) / any_value(v) AS cost FROM g, w GROUP BY mask)
SELECT i::INT AS i, round(sum((CASE bit_count(c.mask) WHEN 1 THEN 1 ELSE 2 END) / 6.0::DOUBLE * (d.cost - c.cost)), 9) AS shapley FROM c, range(3) t(i), c d WHERE ((c.mask >> i) & 1) = 0 AND d.mask = c.mask + (1 << i) GROUP BY i""")
def subset_shapley(spark, sf_dir):
    """Shapley effects of three columns on revenue, from what every subset of them explains: one cube."""
    r = table(spark, sf_dir, "lineitem").select(*_SETS, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"))
    w = r.agg(F.avg("y").alias("m"), F.var_pop("y").alias("v"), F.count("*").alias("n"))
    mask = sum((F.lit(1 << i) * (1 - F.grouping(c).cast("int")) for i, c in enumerate(_SETS)), F.lit(0))
    g = r.cube(*_SETS).agg(mask.alias("mask"), F.count("*").alias("k"), F.avg("y").alias("a")).crossJoin(F.broadcast(w))  # one row
    cost = g.groupBy("mask").agg((F.sum(F.col("k") * (F.col("a") - F.col("m")) * (F.col("a") - F.col("m"))) / F.first("n") / F.first("v")).alias("cost"))
    return rounded(db.subset_effects(cost, 3), "i", digits=9)


_FITTED = "m AS (SELECT round(avg(ln(o_totalprice)), 6) AS mu, round(stddev_samp(ln(o_totalprice)), 6) AS sigma, count(*) AS n FROM orders), q AS (SELECT round(avg(c_acctbal), 4) AS mean, round(var_samp(c_acctbal), 4) AS var FROM customer)"


@query("monte_carlo_lognormal", f"WITH {_FITTED}, d AS (SELECT i, ({portable_sql('0', 'i', 3)} + 0.5::DOUBLE) / {rs.MODULUS} AS u, ({portable_sql('1', 'i', 3)} + 0.5::DOUBLE) / {rs.MODULUS} AS v FROM (SELECT unnest(range(n)) AS i FROM m)) SELECT i AS run_id, round(exp(mu + sigma * {normal_ppf_sql('u')}), 4) AS a, round(mean + sqrt(var) * {normal_ppf_sql('v')}, 4) AS b FROM d, m, q")
def monte_carlo_lognormal(spark, sf_dir):
    """Draws from distributions fitted to prices and balances, as many as there are orders."""
    price = F.log("o_totalprice")
    m = table(spark, sf_dir, "orders").agg(F.round(F.avg(price), 6).alias("mu"), F.round(F.stddev_samp(price), 6).alias("sigma"), F.count("*").alias("n")).first()
    q = table(spark, sf_dir, "customer").agg(F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.var_samp("c_acctbal"), 4).alias("var")).first()
    p = Problem({"a": Lognormal(m.mu, m.sigma), "b": Gaussian(q["mean"], q["var"])})
    return rounded(p.transform(designs.monte_carlo(spark, m.n, p.names, seed=3, portable=True)), "run_id", digits=4)


@query("sobol_streaming", f"""WITH r AS (SELECT event_type AS param, value AS a, value * (hour(ts) + 1) / 24 AS b, value * (25 - hour(ts)) / 24 AS ab FROM events)
SELECT param, count(*) AS n, round(avg(b * ab - a * b) / {V}, 6) AS s1, round(avg((a - ab) * (a - ab)) / 2 / {V}, 6) AS st, round({V}, 6) AS variance FROM r GROUP BY param""")
def sobol_streaming(spark, sf_dir):
    from ..streaming.moments import from_files

    return rounded(from_files(spark, f"{sf_dir}/events.parquet"), "param")


@query("sobol_daily", f"""WITH r AS (SELECT event_type AS param, date_trunc('day', ts)::TIMESTAMP AS start, value AS a, value * (hour(ts) + 1) / 24 AS b, value * (25 - hour(ts)) / 24 AS ab FROM events), w AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events)
SELECT param, start, count(*) AS n, round(avg(b * ab - a * b) / {V}, 6) AS s1, round(avg((a - ab) * (a - ab)) / 2 / {V}, 6) AS st, round({V}, 6) AS variance FROM r, w WHERE start + INTERVAL 1 DAY <= mark GROUP BY param, start""")
def sobol_daily(spark, sf_dir):
    """Indices of each day that the watermark has closed."""
    from ..streaming.moments import by_window

    return rounded(by_window(spark, f"{sf_dir}/events.parquet"), "param", "start")


# --- whole analyses: checks, intervals, designs for dependent inputs ---


def _boot_sql(point: str, rows: str, unit: str, fields: dict[str, str], n: str, replicates: int, seed: int) -> str:
    """Quantile intervals of ``fields`` (expressions of weighted means) over replicates drawn by the portable generator."""
    bounds = ", ".join(f"round(quantile_cont({f}, {q}), 6) AS {f}_{side}" for f in fields for side, q in (("lower", 0.025), ("upper", 0.975)))
    return f"""d AS (SELECT rep, {portable_sql('rep', 'i', seed)} % n AS pos FROM range({replicates}) t(rep), (SELECT {n} AS n), range(10000000) z(i) WHERE i < n), w AS (SELECT rep, pos AS {unit}, count(*) AS w FROM d GROUP BY ALL),
g AS (SELECT rep, param, {', '.join(f'{e} AS {f}' for f, e in fields.items())} FROM {rows} JOIN w USING ({unit}) GROUP BY rep, param), b AS (SELECT param, {bounds} FROM g GROUP BY param) SELECT p.*, b.* EXCLUDE (param) FROM ({point}) p JOIN b USING (param)"""


def _weighted(sql: str) -> str:
    """Means of an SQL text as weighted ones."""
    out, at = "", 0
    while (k := sql.find("avg(", at)) >= 0:
        depth, end = 1, k + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at:k] + f"(sum(w * ({_weighted(sql[k + 4 : end - 1])})) / sum(w))"
        at = end
    return out + sql[at:]


_SJ = SOBOL_SQL["saltelli-jansen"]


@query("sobol_intervals", f"WITH {_frozen_sql()}, " + _boot_sql(f"SELECT param, round({_SJ[0]}, 6) AS s1, round({_SJ[1]}, 6) AS st, round({V}, 6) AS variance FROM f GROUP BY param", "f", "base_id", {"s1": _weighted(_SJ[0]), "st": _weighted(_SJ[1])}, "(SELECT h FROM k LIMIT 1)", 20, 11))
def sobol_intervals(spark, sf_dir):
    outputs, layout, _ = _designed(spark, sf_dir)
    got = analyze("sobol", _problem(), outputs, layout=layout, n_bootstrap=20, seed=11, draw=rs.portable)
    return rounded(got.table, "param")


@query("morris_from_pick_freeze", ORACLE_SQL["morris_radial"])
def morris_from_pick_freeze(spark, sf_dir):
    """The blocks A and AB of an evaluated design are stars; their effects need no further runs."""
    outputs, layout, base = _designed(spark, sf_dir)
    return rounded(analyze("morris", _problem(), outputs, layout=designs.morris_steps(layout, base, NAMES)).table, "param")


@query("sobol_downsampled", f"WITH {_frozen_sql()} SELECT param, round({_SJ[0]}, 6) AS s1, round({_SJ[1]}, 6) AS st, round({V}, 6) AS variance FROM f WHERE base_id < 64 GROUP BY param")
def sobol_downsampled(spark, sf_dir):
    outputs, layout, _ = _designed(spark, sf_dir)
    fewer, used = designs.downsample(layout, 64, outputs)
    return rounded(analyze("sobol", _problem(), used, layout=fewer).table, "param")


@query("pawn_marginals", ORACLE_SQL["pawn_orders"].replace("SELECT x1, x2, x3, (x1", "SELECT x1 / 1.2 AS x1, x2 / 1.2 AS x2, x3 / 1.2 AS x3, (x1").replace("round(median(ks), 6)", "round(max(ks), 6)"))
def pawn_marginals(spark, sf_dir):
    """Bins on the scale of the declared distributions, inputs being uniform from 0 to 1.2."""
    rows = order_rows(spark, sf_dir)
    outputs = rows.select("run_id", model(*map(F.col, NAMES)).alias("y"))
    return rounded(analyze("pawn", _problem(), outputs, rows, statistic="max").table, "param")


@query("transport_dummy", transport_sql(f"{ORDERS}, r AS (SELECT 'dummy' AS param, run_id, {portable_sql('0', 'run_id', 9)}::DOUBLE AS x, {model_sql('x1', 'x2', 'x3')} AS y FROM o), k AS (SELECT param, x, y, (((row_number() OVER (PARTITION BY param ORDER BY x, run_id)) * 10 - 1) // count(*) OVER (PARTITION BY param))::INT AS class, count(*) OVER (PARTITION BY param) AS n FROM r)").replace("SELECT param, round(sum(p * w2) / (2 * any_value(v)), 6) AS ot,", "SELECT ot_dummy FROM (SELECT param, round(sum(p * w2) / (2 * any_value(v)), 6) AS ot_dummy,").replace("FROM e GROUP BY param", "FROM e GROUP BY param)"))
def transport_dummy(spark, sf_dir):
    rows = order_rows(spark, sf_dir).select("run_id", model(*map(F.col, NAMES)).alias("y"))
    return rounded(gd.dummy_transport(rows, 10, seed=9, draw=rs.portable))


@query("dgsm_differences", ORACLE_SQL["dgsm_bounds"])
def dgsm_differences(spark, sf_dir):
    """Slopes by central differences of the model's expression, which are exact for a quadratic one."""
    p = Problem({c: Uniform(-1, 3) for c in NAMES})
    rows = db.slopes(order_rows(spark, sf_dir), p, model, step=1e-2).drop("output_idx")
    return rounded(db.dgsm(rows, dict.fromkeys(NAMES, db.uniform_poincare(0, 1)), dict.fromkeys(NAMES, 1 / 12)), "param")


@query("dgsm_black_box", ORACLE_SQL["dgsm_bounds"])
def dgsm_black_box(spark, sf_dir):
    """The same slopes from a NumPy function of whole batches."""
    p = Problem({c: Uniform(-1, 3) for c in NAMES})
    rows = db.slopes_of(order_rows(spark, sf_dir), p, lambda x: model(x[:, 0], x[:, 1], x[:, 2]), step=1e-2).drop("output_idx")
    return rounded(db.dgsm(rows, dict.fromkeys(NAMES, db.uniform_poincare(0, 1)), dict.fromkeys(NAMES, 1 / 12)), "param")


@query("constant_outputs", "WITH e AS (SELECT event_type, CASE WHEN event_type < 'p' THEN 1.0 ELSE value END AS y FROM events) SELECT event_type, max(y) = min(y) AS flat FROM e GROUP BY event_type")
def constant_outputs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_type") < "p", 1.0).otherwise(F.col("value")).alias("y"))
    return zero_variance(rows, ["event_type"])


#: The dependence of three normal inputs, whose means and variances are those of the orders' inputs.
_DEPENDENCE = np.array([[1.0, 0.6, -0.2], [0.6, 1.0, 0.1], [-0.2, 0.1, 1.0]])
_NORMAL_SQL = f"{ORDERS}, r AS (SELECT {', '.join(f'round(avg(x{j}), 6) AS m{j}, sqrt(round(var_pop(x{j}), 6)) AS s{j}' for j in (1, 2, 3))} FROM o), h AS (SELECT (1::BIGINT << floor(log2(count(*)))::INT) AS n FROM customer)"


def _kucherenko_sql() -> str:
    """Closed and total indices of each set, from the same points, factors and conditional draws."""
    r, full = _DEPENDENCE, 7
    low = dependent.cholesky(r)
    line = lambda ws, cs: " + ".join(f"{float(w)!r} * {c}" for w, c in zip(ws, cs)) or "0.0"
    e = ", ".join(f"{normal_ppf_sql(f'greatest(u_x{i + 1}, 1e-12)')} AS {'e' if i < 3 else 'w'}{i % 3}" for i in range(6))
    z = ", ".join(f"{line(low[i, : i + 1], [f'e{j}' for j in range(i + 1)])} AS z{i}" for i in range(3))
    blocks = []
    for m in range(full):
        expr = {i: f"z{i}" for i in range(3)}
        if m:
            given = [i for i in range(3) if m >> i & 1]
            others, weights, factor = dependent.conditional(r, given)
            for a, i in enumerate(others):
                expr[i] = f"{line(weights[a], [f'z{j}' for j in given])} + {line(factor[a, : a + 1], [f'w{j}' for j in others])}"
        x = [f"(m{i + 1} + s{i + 1} * ({expr[i]}))" for i in range(3)]
        blocks.append(f"SELECT base_id, {m} AS mask, {model_sql(*x)} AS y FROM z, r")
    v = "(avg((j * j + y * y) / 2) - pow(avg((j + y) / 2), 2))"
    return f"""{_NORMAL_SQL}, p AS ({_sobol_sql('SELECT n FROM h', 6)}), e AS (SELECT base_id, {e} FROM p), z AS (SELECT *, {z} FROM e), y AS ({" UNION ALL ".join(blocks)}),
a AS (SELECT b.mask, b.y, j.y AS j FROM y b JOIN y j ON b.base_id = j.base_id AND j.mask = 0 WHERE b.mask > 0),
c AS (SELECT mask, (avg(j * y) - pow(avg((j + y) / 2), 2)) / {v} AS closed, avg((j - y) * (j - y)) / 2 / {v} AS t, {v} AS variance FROM a GROUP BY mask),
k AS (SELECT c.mask::INT AS mask, c.closed, o.t AS total, c.variance FROM c JOIN c o ON o.mask = {full} - c.mask UNION ALL SELECT {full}::INT, 1.0, 1.0, avg(variance) FROM c)"""


def _kucherenko(spark, sf_dir):
    """A design over inputs fitted to the orders, of the largest power of two points up to the number of customers."""
    r = order_rows(spark, sf_dir).agg(*[F.round(f(c), 6).alias(k + c) for c in NAMES for k, f in (("m", F.avg), ("v", F.var_pop))]).first()
    p = Problem({c: Gaussian(r["m" + c], r["v" + c]) for c in NAMES}, correlation=_DEPENDENCE)
    n = 1 << (table(spark, sf_dir, "customer").count().bit_length() - 1)
    runs = dependent.kucherenko_design(spark, p, n, subsets="all")
    outputs = runs.select("run_id", model(*map(F.col, NAMES)).alias("y"))
    return analyze("kucherenko", p, outputs, layout=runs)


@query("kucherenko_subsets", f"WITH {_kucherenko_sql()} SELECT mask, round(closed, 6) AS closed, round(total, 6) AS total, round(variance, 6) AS variance FROM k")
def kucherenko_subsets(spark, sf_dir):
    return rounded(_kucherenko(spark, sf_dir).table, "mask")


@query("kucherenko_shapley", f"WITH {_kucherenko_sql()}, c0 AS (SELECT mask, total FROM k UNION ALL SELECT 0::INT, 0.0) SELECT i::INT AS i, round(sum((CASE bit_count(c0.mask) WHEN 1 THEN 1 ELSE 2 END) / 6.0::DOUBLE * (d.total - c0.total)), 6) AS shapley FROM c0, range(3) t(i), c0 d WHERE ((c0.mask >> i) & 1) = 0 AND d.mask = c0.mask + (1 << i) GROUP BY i")
def kucherenko_shapley(spark, sf_dir):
    cost = _kucherenko(spark, sf_dir).table.select("mask", F.col("total").alias("cost")).unionByName(spark.createDataFrame([(0, 0.0)], "mask int, cost double"))
    return rounded(db.subset_effects(cost, 3), "i")


@query("model_values", f"""WITH {ORDERS} SELECT run_id, round(sin(x1) + 7 * pow(sin(x2), 2) + 0.1 * pow(x3, 4) * sin(x1), 6) AS ishigami, round(abs(4 * x1 - 2) * (abs(4 * x2 - 2) + 1) / 2 * (abs(4 * x3 - 2) + 4.5) / 5.5, 6) AS sobol_g, round(x1 + 2 * x2 + 3 * x3, 6) AS linear,
round(x1 + 0.5 * x2 + sin(x1) + 2 * sin(x2) + 0.25 * cos(x1) + cos(x2) + x1 * x1 + 3 * x1 * x2 + 0.5 * x2 * x2, 6) AS oakley FROM o""")
def model_values(spark, sf_dir):
    x = [F.col(c) for c in NAMES]
    oakley = models.oakley_ohagan(x[:2], (1, 0.5), (1, 2), (0.25, 1), np.array([[1.0, 2.0], [1.0, 0.5]]))
    return rounded(order_rows(spark, sf_dir).select("run_id", models.ishigami(*x).alias("ishigami"), models.sobol_g(x).alias("sobol_g"), models.linear(x).alias("linear"), oakley.alias("oakley")), "run_id")


@query("sobol_points_wide", f"WITH p AS ({_sobol_sql('SELECT count(*) FROM part', 40, range(36, 40))}), r AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT base_id, {', '.join(f'lo + (hi - lo) * u_x{d + 1} AS x{d + 1}' for d in range(36, 40))} FROM p, r")
def sobol_points_wide(spark, sf_dir):
    """A point for each part, over the range of prices, in dimensions beyond the published table, whose numbers follow from a rule; computed in Arrow batches."""
    r = table(spark, sf_dir, "part").agg(F.count("*").alias("n"), F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")).first()
    p = Problem({f"x{d + 1}": Uniform(r.lo, r.hi) for d in range(40)})
    return p.transform(designs.sobol_points(spark, r.n, p.names)).select("base_id", *p.names[36:])


# --- files ---

_ORDERS_SQL = f"WITH {ORDERS} SELECT run_id, x1, x2, x3 FROM o"


@query("csv_round_trip", _ORDERS_SQL)
def csv_round_trip(spark, sf_dir):
    path = fresh_path(spark, "runs")
    files.write_csv(order_rows(spark, sf_dir), path)
    return files.read_csv(spark, path)


@query("design_round_trip", _ORDERS_SQL)
def design_round_trip(spark, sf_dir):
    path = fresh_path(spark, "design")
    files.save_design(path, "runs", _problem(), {"runs": order_rows(spark, sf_dir)})
    problem, tables, _ = files.load_design(spark, path, "runs")
    return tables["runs"].select("run_id", *problem.names)


@query("timed_outputs", f"""WITH {ORDERS} SELECT run_id, output, time, y FROM (SELECT run_id, unnest([{{'output': 'flow', 'time': 0.0::DOUBLE, 'y': x1}}, {{'output': 'flow', 'time': 1.5::DOUBLE, 'y': x2}}, {{'output': 'heat', 'time': 0.0::DOUBLE, 'y': x1 + x3}}], recursive := true) FROM o)""")
def timed_outputs(spark, sf_dir):
    wide = order_rows(spark, sf_dir).select("run_id", F.col("x1").alias("flow@0"), F.col("x2").alias("flow@1.5"), (F.col("x1") + F.col("x3")).alias("heat"))
    return files.timed_outputs(wide, NAMES)


@query("long_result", f"WITH {_frozen_sql()}, r AS (SELECT param, {_SJ[0]} AS s1, {_SJ[1]} AS st FROM f GROUP BY param) SELECT 'sobol' AS method, param, field, round(value, 6) AS value, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper FROM r UNPIVOT (value FOR field IN (s1, st))")
def long_result(spark, sf_dir):
    outputs, layout, _ = _designed(spark, sf_dir)
    return rounded(analyze("sobol", _problem(), outputs, layout=layout).long(), "method", "param", "field")
