"""What the registered queries share: tables and the inputs drawn from them, their SQL, and the register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resampling as rs
from ..operators.frames import long_inputs

NAMES = ["x1", "x2", "x3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


# --- inputs that the queries read, and the same in SQL ---


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_id, param, x, y)``: quantity, price and discount against revenue; two of them have few values, so that most runs tie."""
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    rows = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("run_id"), *names, (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"))
    return long_inputs(rows, names, keep=("run_id", "y")).select("run_id", "param", "x", "y")


LINEITEM = """r AS (
  SELECT run_id, param, x, y FROM (SELECT (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS run_id, l_quantity, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) AS y FROM lineitem)
  UNPIVOT (x FOR param IN (l_quantity, l_extendedprice, l_discount)))"""


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_id, x1, x2, x3)`` from orders: price, customer and month, scaled to about 0..1."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), (F.col("o_totalprice") / 500000).alias("x1"), (F.col("o_custkey") % 1000 / 1000).alias("x2"), (F.month("o_orderdate") / 12).alias("x3"))


ORDERS = """o AS (SELECT o_orderkey AS run_id, o_totalprice / 500000 AS x1, (o_custkey % 1000) / 1000 AS x2, month(o_orderdate) / 12 AS x3 FROM orders)"""


def model(x1, x2, x3):
    """The queries' model."""
    return x1 * x1 + x2 * x3 + 0.5 * x1 * x3 + x2


def model_sql(a: str, b: str, c: str) -> str:
    return f"({a} * {a} + {b} * {c} + 0.5 * {a} * {c} + {b})"


def portable_sql(rep: str, i: str, seed: int) -> str:
    return f"(((({rs.M1} * ({rep} + 1) + {rs.M2} * ({i} + 1) + {seed}) % {rs.MODULUS}) * {rs.M1}) % {rs.MODULUS})"


def classes_sql(m: int) -> str:
    return f"{LINEITEM}, k AS (SELECT param, x, y, (((row_number() OVER (PARTITION BY param ORDER BY x, run_id)) * {m} - 1) // count(*) OVER (PARTITION BY param))::INT AS class, count(*) OVER (PARTITION BY param) AS n FROM r)"


def transport_sql(classes: str) -> str:
    """Costs by the coupling of quantiles itself, where the query takes differences of sums."""
    return f"""WITH {classes}, i AS (SELECT param, y, row_number() OVER (PARTITION BY param ORDER BY y) - 1 AS i, n FROM k), j AS (SELECT param, class, y AS cy, row_number() OVER (PARTITION BY param, class ORDER BY y) - 1 AS k, count(*) OVER (PARTITION BY param, class) AS c FROM k),
s AS (SELECT DISTINCT param, class, c FROM j), m AS (SELECT i.param, s.class, i, n, c, y, unnest([i * c // n, i * c // n + 1]) AS k FROM i JOIN s ON i.param = s.param),
w AS (SELECT m.param, m.class, any_value(m.n) AS n, any_value(m.c) AS c, sum(greatest(least((i + 1) * m.c, (m.k + 1) * n) - greatest(i * m.c, m.k * n), 0) / (n::DOUBLE * m.c) * (y - cy) * (y - cy)) AS w2 FROM m JOIN j ON m.param = j.param AND m.class = j.class AND m.k = j.k GROUP BY m.param, m.class),
t AS (SELECT param, avg(y) AS mean, var_samp(y) AS v FROM i GROUP BY param), q AS (SELECT param, class, avg(cy) AS cm FROM j GROUP BY ALL),
e AS (SELECT w.param, c / n AS p, w2, (cm - mean) * (cm - mean) AS adv, v, n FROM w JOIN q ON w.param = q.param AND w.class = q.class JOIN t ON w.param = t.param)
SELECT param, round(sum(p * w2) / (2 * any_value(v)), 6) AS ot, round(sum(p * adv) / (2 * any_value(v)), 6) AS advective, round(sum(p * greatest(w2 - adv, 0)) / (2 * any_value(v)), 6) AS diffusive, round(2 * any_value(n) / (any_value(n) - 1) * sum(p * adv) / (2 * any_value(v)), 6) AS s1 FROM e GROUP BY param"""


def borgonovo_sql(classes: str) -> str:
    """Delta and the first index of classes ``k (param, class, y)``, by whole kernel sums."""
    return f"""WITH {classes}, t AS (SELECT param, count(*) AS n, min(y) AS lo, max(y) AS hi, avg(y) AS m, var_pop(y) AS v, pow(0.75 * count(*), -0.2) * stddev_samp(y) AS h FROM k GROUP BY param),
c AS (SELECT k.param, class, count(*) AS c, avg(y) AS cm, pow(0.75 * count(*), -0.2) * coalesce(stddev_samp(y), 0) AS ch FROM k GROUP BY ALL),
d AS (SELECT c.param, class, c, cm, n, lo, hi, m, v, h, CASE WHEN ch < 0.01 * h THEN greatest(0.1 * h, (hi - lo) / 99) ELSE ch END AS ch FROM c JOIN t USING (param)),
s AS (SELECT d.param, d.class, g, sum(exp(-0.5 * pow((lo + g * (hi - lo) / 99 - y) / ch, 2))) AS own, sum(exp(-0.5 * pow((lo + g * (hi - lo) / 99 - y) / h, 2))) AS part FROM k JOIN d ON k.param = d.param AND k.class = d.class, range(100) q(g) GROUP BY ALL),
a AS (SELECT *, sum(part) OVER (PARTITION BY param, g) AS alls FROM s),
e AS (SELECT a.param, sum(c / (2 * n) * abs(alls / (n * h * sqrt(2 * pi())) - own / (c * ch * sqrt(2 * pi()))) * (CASE WHEN g IN (0, 99) THEN 0.5 ELSE 1 END) * (hi - lo) / 99) AS delta FROM a JOIN d ON a.param = d.param AND a.class = d.class GROUP BY a.param)
SELECT d.param, round(any_value(delta), 6) AS delta, round(sum(c / n * (cm - m) * (cm - m)) / any_value(v), 6) AS s1 FROM d JOIN e USING (param) GROUP BY d.param"""


def pawn_sql(summary: str) -> str:
    """Distances of bins ``b (param, bin, y)``, by ranks from both sides."""
    return f"""g AS (SELECT *, cume_dist() OVER (PARTITION BY param ORDER BY y) AS fa, cume_dist() OVER (PARTITION BY param, bin ORDER BY y) AS fb,
  (rank() OVER (PARTITION BY param ORDER BY y) - 1) / count(*) OVER (PARTITION BY param) AS ga, (rank() OVER (PARTITION BY param, bin ORDER BY y) - 1) / count(*) OVER (PARTITION BY param, bin) AS gb FROM b),
k AS (SELECT param, bin, max(greatest(abs(fa - fb), abs(ga - gb))) AS ks FROM g WHERE bin IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)
SELECT param, round({summary}(ks), 6) AS pawn, count(*)::INT AS n_bins FROM k GROUP BY param"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep
