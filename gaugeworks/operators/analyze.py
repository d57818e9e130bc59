"""One entry for all fourteen methods: checks, failed runs, warnings, the estimate, and intervals by resampling.

A result is a table with a row for each input and output slice; intervals are further columns. Replicates of designed
methods are weighted sums over the same rows, those of given-data methods the same estimator on the same partition of
the runs, placed anew by weights, with the replicate as one more slice, and those of fitted surrogates further fits.
"""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, kept
from ..problem import METHODS, Gaussian, Problem, gate, policy_for
from . import design_based as db
from . import given_data as gd
from . import joint, kernels, many, partition, resampling
from . import surrogates as sg
from .frames import drop_invalid, finite, ranked, warn_flat

FIELDS = {
    "sobol": ("s1", "st"), "efast": ("s1", "st"), "morris": ("mu", "mu_star", "sigma"), "kucherenko": ("closed", "total"), "borgonovo": ("delta", "s1"),
    "dgsm": ("nu", "mu", "upper_bound", "lower_bound"), "hdmr": ("s1", "st"), "hsic": ("r2", "total", "p_value", "hsic_raw"), "optimal_transport": ("ot", "advective", "diffusive", "s1"),
    "pawn": ("pawn",), "pce": ("s1", "st"), "rank": ("s1",), "shapley": ("shapley", "s1", "st"), "vkoga": ("s_tc", "s_tu", "s_u", "s_c", "s_iu"),
}
#: Methods that have no intervals, and those whose outputs must not be discrete.
NO_INTERVALS, DENSITIES = ("efast", "hsic"), ("borgonovo",)


@dataclass
class Result:
    """The indices of a method: ``table (*keys, fields, and <field>_lower, <field>_upper)``, where they came from, and what else was found."""

    method: str
    table: DataFrame
    keys: list[str]
    fields: tuple[str, ...]
    info: dict = field(default_factory=dict)
    replicates: DataFrame | None = None
    more: dict[str, object] = field(default_factory=dict)

    def long(self) -> DataFrame:
        """``(method, *keys, field, value, lower, upper)``."""
        null = F.lit(None).cast("double")
        has = lambda c: F.col(c).cast("double") if c in self.table.columns else null
        rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value"), has(f + "_lower").alias("lower"), has(f + "_upper").alias("upper")) for f in self.fields])
        return self.table.select(F.lit(self.method).alias("method"), *self.keys, F.explode(rows).alias("x")).select("method", *self.keys, "x.*")

    def to_pandas(self):
        """The tidy table, in order of its keys; it has one row for each input and slice."""
        return self.table.orderBy(*self.keys).toPandas()

    def shapley(self, cost: str = "total") -> Result:
        """Exact Shapley effects from the indices of every subset, ``total`` or ``closed`` ones; intervals need kept replicates."""
        if cost not in ("total", "closed"):
            raise ValueError("cost is total or closed")
        return self._allocated("shapley", lambda t, d, keys: db.subset_effects(t.select("mask", *keys, F.col(cost).alias("cost")), d, keys))

    def pme(self) -> Result:
        """Proportional marginal effects from the total indices of every subset."""
        return self._allocated("pme", lambda t, d, keys: db.subset_marginal_effects(t.select("mask", *keys, F.col("total").alias("cost")), d, keys))

    def _allocated(self, name: str, effects: Callable[[DataFrame, int, list[str]], DataFrame]) -> Result:
        names = self.info.get("inputs", [])
        keys = [k for k in self.keys if k != "mask"]
        if self.method != "kucherenko" or self.table.select("mask").distinct().count() < (1 << len(names)) - 1:
            raise ValueError("effects need the indices of every subset: a Kucherenko design with subsets='all'")

        def of(table: DataFrame, own: list[str]) -> DataFrame:
            empty = (table.select(*own).distinct() if own else table.sparkSession.range(1).select()).select(F.lit(0).alias("mask"), *own, F.lit(0.0).alias("closed"), F.lit(0.0).alias("total"))
            found = effects(table.select("mask", *own, "closed", "total").unionByName(empty), len(names), own)
            return found.select(F.element_at(F.array(*map(F.lit, names)), F.col("i").cast("int") + 1).alias("param"), *own, name)

        point = cut(of(self.table, keys))
        if self.replicates is not None:
            draws = cut(of(self.replicates, [*keys, "rep"]))
            point = with_intervals(point, draws, ["param", *keys], [name], self.info["level"], self.info["intervals"])
        return Result(f"kucherenko {name}", point, ["param", *keys], (name,), dict(self.info))

    def aggregate(self, by: str = "variance") -> DataFrame:
        """One row for each input over all slices (``resampling.aggregated``); intervals are left out."""
        if by == "variance" and "variance" not in self.table.columns:
            raise ValueError(f"{self.method} has no variances; weigh slices equally")
        if "lower" in "".join(self.table.columns):
            warnings.warn("intervals can't be aggregated without replicates and are left out", stacklevel=2)
        own = [k for k in self.keys if k in ("param", "mask")]
        return resampling.aggregated(self.table, self.fields, by, own)

    def summary(self, most: int = 20) -> str:
        """A short report as text."""
        rows = self.table.orderBy(*self.keys).limit(most).collect()
        head = f"{self.method}: " + ", ".join(f"{k}={v}" for k, v in self.info.items())
        show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
        return "\n".join([head, "  ".join(self.table.columns), *["  ".join(show(v) for v in r) for r in rows]])

    def write_csv(self, path: str) -> None:
        from ..sources.files import write_csv

        write_csv(self.long(), path)

    def write_json(self, path: str) -> None:
        """The long table with what it came from in each line."""
        self.long().withColumn("info", F.lit(json.dumps(self.info, default=str))).write.mode("overwrite").json(path)


def merged(results: dict[str, Result]) -> DataFrame:
    """Long tables of several channels, each with times of its own, as one with ``channel``."""
    out = None
    for name, r in results.items():
        one = r.long().withColumn("channel", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def subsamples(runs: DataFrame, share: float, replicates: int, seed: int, draw=resampling.hashed) -> tuple[DataFrame, int, float]:
    """``(rep, unit, w)`` of a share of the runs without replacement, their number, and the factor that their spread is to be scaled by."""
    placed = cut(units_of(runs, "run_id"))
    m, factor = resampling.subsample_scale(placed.count(), share)
    each = placed.select("unit", "pos", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    taken = ranked(each.withColumn("h", draw(F.col("rep"), F.col("pos"), seed)), ["rep"], ["h", "pos"], "k", "_n").where(F.col("k") < m)
    return cut(taken.select("rep", "unit", F.lit(1).cast("bigint").alias("w"))), m, factor


def units_of(rows: DataFrame, unit: str) -> DataFrame:
    """``(unit, pos)`` of the distinct units, in order."""
    return ranked(rows.select(F.lit(0).alias("_all"), F.col(unit).alias("unit")).distinct(), ["_all"], ["unit"], "pos", "_n").select("unit", "pos")


def with_intervals(point: DataFrame, draws: DataFrame, keys: Sequence[str], fields: Sequence[str], level: float, method: str, centre: bool = False, scale: float | None = None) -> DataFrame:
    """``point`` with ``<field>_lower`` and ``<field>_upper`` from replicates ``(*keys, rep, fields)``.

    With ``centre``, draws are moved so that their mean is the estimate. With ``scale``, as for subsamples, their spread around
    the estimate is scaled, and the interval also holds the one of draws moved to their mean. Draws without a
    value count as the estimate.
    """
    out = point
    for f in fields:
        both = draws.select(*keys, "rep", F.col(f).alias("_d")).join(point.select(*keys, F.col(f).alias("_p")), keys)
        both = both.withColumn("_d", F.when(F.isnan("_d") | F.col("_d").isNull(), F.col("_p")).otherwise(F.col("_d")))
        mean = both.groupBy(*keys).agg(F.avg("_d").alias("_m"))
        both = cut(both.join(mean, keys))
        kinds = [F.col("_p") + scale * (F.col("_d") - F.col("_p")), F.col("_p") + scale * (F.col("_d") - F.col("_m"))] if scale else [F.col("_d") - F.col("_m") + F.col("_p") if centre else F.col("_d")]
        parts = None
        for k in kinds:
            one = resampling.intervals(both.withColumn("_v", k), keys, "_v", level, method)
            parts = one if parts is None else parts.unionByName(one)
        hull = parts.groupBy(*keys).agg(F.min("lower").alias(f + "_lower"), F.max("upper").alias(f + "_upper"))
        out = out.join(hull, list(keys), "left")
    return out


def _checked(n_bootstrap: int, seed: int | None, level: float, ci: str, method: str) -> None:
    if n_bootstrap < 0 or not 0 < level < 1 or ci not in ("quantile", "gaussian"):
        raise ValueError("n_bootstrap is 0 or more, a level lies between 0 and 1, intervals are quantile or gaussian")
    if n_bootstrap and seed is None:
        raise ValueError("intervals need a seed")
    if n_bootstrap and method in NO_INTERVALS:
        raise ValueError(f"{method} has no intervals by resampling")


def _morris(effects: DataFrame, slices: Sequence[str], extra: Sequence[str] = (), w: str | None = None) -> DataFrame:
    if w is None:
        return db.morris(effects, slices, extra)
    mean, n = db.weighted(w), F.sum(w)
    ee = F.col("ee")
    spread = F.greatest(mean(ee * ee) - mean(ee) * mean(ee), F.lit(0.0)) * n / (n - 1)
    return effects.groupBy("param", *slices, *extra).agg(mean(ee).alias("mu"), mean(F.abs(ee)).alias("mu_star"), F.sqrt(spread).alias("sigma"))


def analyze(
    method: str, problem: Problem, outputs: DataFrame | str | None, inputs: DataFrame | None = None, layout: DataFrame | None = None, slices: Sequence[str] = (), on_invalid: str = "raise",
    n_bootstrap: int = 0, seed: int | None = None, level: float = 0.95, ci: str = "quantile", draw: Callable = resampling.hashed, keep: bool = False, **options,
) -> Result:
    """Indices of ``method`` (a key of ``METHODS``) from ``outputs (run_id, *slices, y)``, or of one output, a column of ``inputs`` that is named.

    ``layout`` is the design of designed methods: ``(base_id, block, param, run_id)`` for sobol, steps for morris, runs with
    ``base_id`` and ``mask`` for kucherenko, ``(param, t, n, run_id)`` for efast, slopes ``(run_id, param, d)`` for dgsm; with a model
    ``fn`` of matrices, dgsm needs ``inputs`` alone, and ``output_idx`` is its slice. ``inputs (run_id, <names>)`` are needed by the others. ``on_invalid`` says what happens to units of runs with an output that is null, NaN
    or infinite: ``raise``, ``propagate``, ``drop`` them, or ``skip`` the slices that hold one. Constant slices are warned of. With
    ``n_bootstrap``, intervals of ``level``; they need a ``seed``. Further options are the estimator's.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    known, slices = METHODS[method], list(slices)
    whole = None
    if isinstance(outputs, str):
        if slices:
            raise ValueError("an output that is named has no slices")
        whole = inputs.select("run_id", *[F.col(n) for n in problem.names], F.col(outputs).cast("double").alias("y"))
        outputs, inputs = whole.select("run_id", "y"), whole.drop("y")
    if method == "dgsm" and "fn" in options:
        found = cut(db.slopes_of(inputs.select("run_id", *problem.names), problem, options.pop("fn"), options.pop("step", 1e-4), options.pop("jac", None)))
        outputs, slices = found.where(F.col("param") == problem.names[0]).select("run_id", "output_idx", "y"), ["output_idx"]
        layout = found.drop("y")
    backend = options.get("backend", "pce") if method == "shapley" else method
    gate(problem, backend)
    policy = policy_for(method, on_invalid)
    _checked(n_bootstrap, seed, level, ci, method)
    if policy == "raise" and not outputs.where(~finite("y")).isEmpty():
        raise ValueError("outputs hold values that are not finite; choose another policy to go on")
    if policy == "skip":
        bad = outputs.where(~finite("y")).select(*slices).distinct()
        outputs = outputs.join(bad, slices, "left_anti") if slices else outputs
    flat = warn_flat(outputs, method, slices)
    info = {"method": method, "policy": policy, "constant_slices": flat, "n_bootstrap": n_bootstrap, "level": level if n_bootstrap else None, "intervals": ci if n_bootstrap else None, "seed": seed, "inputs": problem.names}
    fields, keys = FIELDS[method], ["param", *slices]
    if options.pop("standardize_outputs", False) if method in ("morris", "dgsm") else False:
        outputs, layout = _standardised(method, outputs, layout, slices)
    centre = scale = None
    more: dict[str, object] = {}

    def cleaned(rows: DataFrame, unit: str) -> DataFrame:
        rows = cut(rows)
        left = drop_invalid(rows, [unit], "drop", known.min_kept) if policy == "drop" else rows
        return left if left is rows else cut(left)

    def reps_of(rows: DataFrame, unit: str) -> DataFrame:
        return kept(resampling.weights(units_of(rows, unit), n_bootstrap, seed, draw))

    def by_weight(rows: DataFrame, unit: str, estimate: Callable[..., DataFrame]) -> tuple[DataFrame, DataFrame | None]:
        point = estimate(rows)
        if not n_bootstrap:
            return point, None
        drawn = kept(resampling.draws(units_of(rows, unit), n_bootstrap, seed, draw))
        each = rows.join(drawn, rows[unit] == drawn["unit"]).drop("unit").withColumn("rep", F.explode("reps")).drop("reps")
        return point, estimate(each.withColumn("w", F.lit(1)), extra=["rep"], w="w")

    def by_rows(estimate: Callable[[DataFrame, list[str]], DataFrame], planned: Callable[[DataFrame], partition.Partition], plain: Callable[[DataFrame], tuple[DataFrame, dict]] | None = None, drawn: Callable[[DataFrame], tuple[DataFrame, int | None]] | None = None, weighted: bool = False) -> tuple[DataFrame, DataFrame | None]:
        """Estimates on one partition of the runs, which all slices and replicates share.

        Where slices have runs of their own, each is partitioned by itself. One output without replicates, of an estimator that
        knows only classes, needs no partition that is shared (``plain``). Replicates of an estimator that takes weights (``weighted``)
        have a row for each run and class, not for each copy.
        """

        def again(shared: partition.Partition, own: DataFrame, these: DataFrame) -> DataFrame:
            if weighted:
                counts = kept(resampling.counts(units_of(these, "run_id"), n_bootstrap, seed, draw))
                return estimate(shared.weighted(shared.of(own), counts, slices, n_bootstrap), [*slices, "rep"])
            weights, size = drawn(these)
            placed = shared.replicated(weights, size) if shared.classes or size else partition.drawn(shared.table, weights)
            return estimate(own.join(placed, "run_id"), [*slices, "rep"])

        if plain and not slices and not n_bootstrap:
            met = whole if whole is not None else inputs.select("run_id", *problem.names).join(outputs.select("run_id", F.col("y").cast("double").alias("y")), "run_id")
            rows, more["levels"] = plain(kept(drop_invalid(met, ["run_id"], "drop", known.min_kept)) if policy == "drop" else met)
            return estimate(rows, slices), None
        rows = kept(cleaned(outputs.select("run_id", *slices, F.col("y").cast("double").alias("y")), "run_id"))
        runs = kept(rows.select("run_id").distinct())
        drawn = drawn or (lambda r: (reps_of(r, "run_id"), None))
        if _rectangular(rows, runs, slices):
            shared = planned(inputs.join(runs, "run_id", "left_semi"))
            more["levels"] = shared.levels
            point = estimate(shared.of(rows), slices)
            if not n_bootstrap:
                return point, None
            return point, again(shared, rows, runs)
        point = draws = None
        for s in rows.select(*slices).distinct().orderBy(*slices).collect():  # irregular slices are few: channels
            own = rows
            for c in slices:
                own = own.where(F.col(c).eqNullSafe(F.lit(s[c])))
            these = own.select("run_id").distinct()
            shared = planned(inputs.join(these, "run_id", "left_semi"))
            one = estimate(shared.of(own), slices)
            point = one if point is None else point.unionByName(one)
            if n_bootstrap:
                one = again(shared, own, these)
                draws = one if draws is None else draws.unionByName(one)
        return point, draws

    if method == "sobol":
        met = cleaned(layout.join(outputs, "run_id"), "base_id")
        rows = cut(db.units(met, slices))
        estimator = options.pop("estimator", db.ESTIMATORS[0])
        point, draws = by_weight(rows, "base_id", lambda r, extra=(), w=None: db.sobol(r, estimator, slices, extra, w))
        if options.pop("second", False):
            more["second"] = db.sobol_second(rows, estimator, slices)
    elif method == "morris":
        rows = db.elementary_effects(outputs.select("run_id", *slices, "y"), layout).withColumnRenamed("ee", "y")
        rows = cleaned(rows, "traj_id").withColumnRenamed("y", "ee")
        if (n := rows.select("traj_id").distinct().count()) < 10:
            warnings.warn(f"only {n} trajectories", stacklevel=2)
        point, draws = by_weight(rows, "traj_id", lambda r, extra=(), w=None: _morris(r, slices, extra, w))
    elif method == "kucherenko":
        from ..sources.dependent import kucherenko_pairs

        if not problem.dependent:
            warnings.warn("inputs are independent: a pick-freeze design needs fewer runs", stacklevel=2)
        good = cleaned(layout.select("run_id", "base_id").join(outputs, "run_id"), "base_id").select("base_id").distinct()
        rows = cut(kucherenko_pairs(layout.join(good, "base_id", "left_semi"), outputs, slices))
        keys = ["mask", *slices]
        point, draws = by_weight(rows, "base_id", lambda r, extra=(), w=None: db.kucherenko_subsets(r, len(problem.names), slices, extra, w))
    elif method == "efast":
        curves = layout.join(outputs, "run_id")
        more["zero_curves"] = db.zero_curves(curves, slices)
        point, draws = db.efast(curves, options.pop("omega"), options.pop("harmonics", 4), slices), None
    elif method == "dgsm":
        if not all(isinstance(m, Gaussian) and m.low is None and m.high is None for m in problem.inputs.values()):
            warnings.warn("the lower bound is proven for untruncated normal inputs only", stacklevel=2)
        rows = cleaned(layout.join(outputs, [c for c in ("run_id", *slices) if c in layout.columns]), "run_id")
        point, draws = by_weight(rows, "run_id", lambda r, extra=(), w=None: db.dgsm(r, db.poincare_constants(problem), problem.variances(), slices, extra, w))
    elif method == "rank":
        share = options.pop("share", 0.8)

        def taken(runs: DataFrame) -> tuple[DataFrame, int | None]:
            nonlocal scale
            w, size, scale = subsamples(runs, share, n_bootstrap, seed, draw)
            return w, size

        point, draws = by_rows(gd.rank_index, lambda r: partition.plan(problem, r, method=method), drawn=taken)
    elif method == "pawn":
        centre = True
        point, draws = by_rows(lambda r, s: gd.pawn(r, statistic=options.get("statistic", "median"), slices=s), lambda r: partition.plan_bins(problem, r, options.get("n_classes", 10), method=method), lambda r: partition.direct_bins(problem, r, options.get("n_classes", 10), method))
    elif method == "borgonovo":
        if not (few := gd.discrete_output(outputs, slices)).isEmpty():
            raise ValueError(f"the output is discrete in {few.count()} slices: it has no density")
        classes = options.get("n_classes") or gd.default_classes(outputs.select("run_id").distinct().count())
        ends = cut(outputs.where(finite("y")).groupBy(*slices).agg(F.min("y").cast("double").alias("lo"), F.max("y").cast("double").alias("hi"))) if n_bootstrap else None
        point, draws = by_rows(lambda r, s: gd.borgonovo(r, classes, options.get("grid_size", 100), s, options.get("degenerate_tol", 1e-2), options.get("bandwidth"), options.get("degenerate_bandwidth", "auto"), ends if "rep" in s else None), lambda r: partition.plan(problem, r, classes, method=method), lambda r: partition.direct(problem, r, classes, method))
        if options.get("bias_correct") and draws is not None:
            draws = cut(draws)
            mean = draws.groupBy(*keys).agg(F.avg("delta").alias("_m"))
            point = point.join(mean, keys).withColumn("delta", 2 * F.col("delta") - F.col("_m")).drop("_m")
    elif method == "optimal_transport" and options.get("mode", "univariate") != "univariate":
        point, draws, keys = _joint(problem, cleaned(outputs.select("run_id", *slices, F.col("y").cast("double").alias("y")), "run_id"), inputs, slices, n_bootstrap, reps_of, options)
        if n := point.agg(F.sum("unconverged")).first()[0]:
            warnings.warn(f"{n} entropic plans did not settle", stacklevel=2)
    elif method == "optimal_transport":
        classes = options.get("n_classes") or gd.transport_classes(outputs.select("run_id").distinct().count())
        point, draws = by_rows(lambda r, s: gd.transport(r, classes, s), lambda r: partition.plan(problem, r, classes, method=method), lambda r: partition.direct(problem, r, classes, method), weighted=True)
        if options.get("dummy"):
            point = _above_dummy(point, cleaned(outputs, "run_id"), problem, classes, slices, more["levels"], seed or 0, draw)
    elif method == "hsic":
        rows = problem.units(inputs).join(cleaned(outputs, "run_id"), "run_id")
        point, draws = _by_slice(rows, slices, lambda r: kernels.hsic(r, problem.names, "y", permutations=options.get("n_perms", 200), seed=seed or 0, bandwidth=options.get("bandwidth", 1.0), draw=draw)), None
    else:
        good = cut(cleaned(outputs.select("run_id", *slices, F.col("y").cast("double").alias("y")), "run_id"))
        rows = inputs.select("run_id", *problem.names).join(good, "run_id")
        w = reps_of(good, "run_id") if n_bootstrap else None
        many_fit = backend != "vkoga" and (slices or n_bootstrap) and _rectangular(good, good.select("run_id").distinct(), slices)
        point = draws = None
        if many_fit:
            both = cut(_fits(backend, method, problem, inputs.select("run_id", *problem.names), good, slices, w, n_bootstrap, options, more))
            point = both.where("rep = 0").drop("rep")
            draws = both.where("rep > 0").withColumn("rep", F.col("rep") - 1) if n_bootstrap else None
        if not (many_fit and slices):
            point = _by_slice(rows, slices, lambda r: _surrogate(backend, method, problem, r, options, more))
        if n_bootstrap and not many_fit:
            fixed = {**options, **({k: (getattr(more["fit"], k[:-1]),) for k in ("gammas", "ridges")} if method == "vkoga" else {})}
            for rep in range(n_bootstrap):
                again = rows.join(w.where(F.col("rep") == rep), rows["run_id"] == w["unit"]).drop("unit", "rep")
                one = _by_slice(again, slices, lambda r: _surrogate(backend, method, problem, r, {**fixed, "weight": "w", "check": False}, {})).withColumn("rep", F.lit(rep))
                draws = one if draws is None else draws.unionByName(one)
    point = cut(point)
    if n_bootstrap:
        draws = cut(draws)
        point = with_intervals(point, draws, keys, fields, level, ci, bool(centre), scale)
    if method == "dgsm" and point.where("upper_bound <= 1").isEmpty():
        warnings.warn("every upper bound is above 1 and says nothing", stacklevel=2)
    return Result(method, point, keys, fields, info, draws if keep else None, more)


def _standardised(method: str, outputs: DataFrame, layout: DataFrame, slices: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Outputs of each slice moved by their mean and divided by their population deviation; slopes with them. A constant slice is only moved."""
    stats = outputs.groupBy(*slices).agg(F.avg("y").alias("_m"), F.stddev_pop("y").alias("_s"))
    stats = cut(stats.withColumn("_s", F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)))
    met = lambda df: df.join(stats, list(slices)) if slices else df.crossJoin(F.broadcast(stats))  # noqa: E731  one row
    moved = met(outputs).withColumn("y", (F.col("y") - F.col("_m")) / F.col("_s")).drop("_m", "_s")
    return moved, met(layout).withColumn("d", F.col("d") / F.col("_s")).drop("_m", "_s") if method == "dgsm" else layout


def _joint(problem: Problem, outputs: DataFrame, inputs: DataFrame, slices: Sequence[str], n_bootstrap: int, reps_of: Callable, options: dict) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """Transport of several outputs together, its replicates, and the keys: all slices as one cloud (``multivariate``), or for each output the times (``trajectory``, along ``time``)."""
    mode, time = options["mode"], options.get("time", slices[0] if slices else None)
    if mode not in ("multivariate", "trajectory"):
        raise ValueError("mode is univariate, multivariate or trajectory")
    if mode == "trajectory" and time not in slices:
        raise ValueError("a trajectory needs the slice that is its time")
    keys, along = ([], slices) if mode == "multivariate" else ([c for c in slices if c != time], [time])
    runs = cut(outputs.select("run_id").distinct())
    if not _rectangular(outputs, runs, slices):
        raise ValueError("a cloud needs every output of every run")
    classes = options.get("n_classes") or gd.transport_classes(runs.count())
    shared = partition.plan(problem, inputs.join(runs, "run_id", "left_semi"), classes, method="optimal_transport")
    cloud = cut(joint.clouds(outputs, keys, along, options.get("standardize_outputs", True)))
    own = {a: options[b] for a, b in (("epsilon", "epsilon"), ("most", "max_iter"), ("tol", "tol"), ("plan", "plan")) if options.get(b) is not None}
    point, draws = joint.joint_transport(cloud, shared.table, keys, **own), None
    if n_bootstrap:
        w = reps_of(runs, "run_id")
        again = cloud.join(w, cloud["run_id"] == w["unit"]).drop("unit")
        draws = joint.joint_transport(again, shared.replicated(w), [*keys, "rep"], **own)
    if options.get("dummy"):
        raise ValueError("a floor is that of one output: take mode univariate")
    return point, draws, ["param", *keys]


def _rectangular(rows: DataFrame, runs: DataFrame, slices: Sequence[str]) -> bool:
    """Whether each slice has an output of every run."""
    if not slices:
        return True
    least = rows.groupBy(*slices).agg(F.count("*").alias("c")).agg(F.min("c")).first()[0]
    return least is None or least == runs.count()


def _above_dummy(point: DataFrame, rows: DataFrame, problem: Problem, classes: int, slices: Sequence[str], levels: dict[str, list[int]], seed: int, draw: Callable) -> DataFrame:
    """``point`` with ``ot_dummy`` and ``above_dummy``: one floor for all continuous inputs, one for each categorical input with its levels' sizes."""
    floors = None
    if ordered := [n for n in problem.names if n not in levels]:
        names = F.explode(F.array(*[F.lit(n) for n in ordered])).alias("param")
        floors = gd.dummy_transport(rows, classes, slices, seed, draw).select("*", names)
    if levels:
        own = gd.matched_dummies(rows, {n: [c for c in sizes if c] for n, sizes in levels.items()}, slices, seed, draw)
        floors = own if floors is None else floors.unionByName(own)
    out = point.join(floors, ["param", *slices])
    return out.withColumn("above_dummy", F.greatest(F.col("ot") - F.col("ot_dummy"), F.lit(0.0)))


def _by_slice(rows: DataFrame, slices: Sequence[str], fit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fit`` of each slice on its own, one after the other, with the slice's values."""
    if not slices:
        return fit(rows)
    out = None
    for s in rows.select(*slices).distinct().orderBy(*slices).collect():
        own = rows
        for c in slices:
            own = own.where(F.col(c).eqNullSafe(F.lit(s[c])))
        one = fit(own.drop(*slices)).select("*", *[F.lit(s[c]).alias(c) for c in slices])
        out = one if out is None else out.unionByName(one)
    return out


def _fits(backend: str, method: str, problem: Problem, inputs: DataFrame, outputs: DataFrame, slices: Sequence[str], weights: DataFrame | None, replicates: int, options: dict, more: dict) -> DataFrame:
    """``(rep, *slices, param, ...)``: fits of all slices, and of all replicates from 1 on, in one pass; what was fitted is kept in ``more``."""
    blocks, numbers, n = many.stacked(outputs, slices)
    rows = cut(many.with_weights(blocks.join(inputs, "run_id"), weights, replicates))
    own = {k: v for k, v in options.items() if k not in ("backend", "include_correlative", "check")}
    if backend == "hdmr":
        more["fits"] = fits = many.hdmr(rows, problem, n, **own)
        found = fits.shapley(options.get("include_correlative", False)) if method == "shapley" else fits.first()
        found = found.join(fits.quality.select("rep", "output_idx", "variance"), ["rep", "output_idx"])
    else:
        more["fits"] = fits = many.pce(rows, problem, n, **own)
        found = fits.indices()
    more["outputs"] = numbers
    return found.withColumnRenamed("output_idx", "_no").join(numbers, "_no").drop("_no")


def _surrogate(backend: str, method: str, problem: Problem, runs: DataFrame, options: dict, more: dict) -> DataFrame:
    """Indices from a fit, which is kept in ``more``."""
    spark = runs.sparkSession
    own = {k: v for k, v in options.items() if k not in ("backend", "include_correlative", "n_outer", "n_inner", "n_variance", "weight", "check")}
    w = options.get("weight")
    if backend == "vkoga":
        if w:
            runs = runs.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col(w).cast("int")))).drop("_i")
        more["fit"] = fit = sg.vkoga(runs, problem, **own)
        return sg.kernel_indices(fit, spark, *(options.get(k, v) for k, v in (("n_outer", 512), ("n_inner", 128), ("n_variance", 8192))))
    if backend == "hdmr":
        more["fit"] = fit = sg.hdmr(runs, problem, weight=w, **own)
        if method == "shapley":
            return spark.createDataFrame(fit.shapley(options.get("include_correlative", False)))
        return spark.createDataFrame(fit.first().merge(fit.totals(), on="param").assign(variance=math.nan))
    more["fit"] = fit = sg.pce(runs, problem, weight=w, check=options.get("check", True), **own)
    return spark.createDataFrame(fit.indices().assign(variance=fit.quality.get("variance", math.nan)))
