"""Quality classifier by hierarchical empirical Bayes.

A naive Bayes classifier over a document's form gives each document evidence, a log likelihood
ratio. Grouped sums of labels give each host, and each path below it, a rate of good documents;
documents without a label count with a fraction of their classifier's probability. A host's rate is
shrunk towards the global rate and a path's towards its host's, by Beta priors whose strengths come
from the spread between sites (method of moments): a site with few documents stays near its prior.
A document's posterior combines its path's rate, as prior, with its own evidence.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, restored, sheltered

ADDED = ("quality_p", "site_rate", "keep")
#: Buckets of each feature.
WIDTH = 12
#: What a document without a label counts, against one for a labelled one.
SOFT = 0.1
#: Most rows of the table of sites that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Range of a prior's strength, in documents.
STRENGTH = (2.0, 10_000.0)


def features(text: Column) -> dict[str, Column]:
    """Features of a text, each a bucket from 0 to ``WIDTH - 1``; null counts as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1))
    step = lambda share: F.least(F.lit(WIDTH - 1), F.ceil(share * (WIDTH - 1))).cast("int")
    log = lambda share: F.least(F.lit(WIDTH - 1), F.ceil(F.log2(1 + share * 2000))).cast("int")
    return {
        "capitals": step(F.regexp_count(t, F.lit(r"\p{Lu}")) / chars),
        "symbols": log(F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,;:'\-]")) / chars),
        "digits": log(F.regexp_count(t, F.lit(r"\p{N}")) / chars),
        "varied": step(F.size(F.array_distinct(words)) / n),
        "word": F.least(F.lit(WIDTH - 1), F.floor(chars / n)).cast("int"),
        "size": F.least(F.lit(WIDTH - 1), F.floor(F.log2(n))).cast("int"),
    }


NAMES = ("capitals", "symbols", "digits", "varied", "word", "size")


def fit(labelled: DataFrame) -> dict:
    """Naive Bayes from rows of features and ``y`` (0 or 1): log ratios for each feature's buckets, and the rate of ones.

    Counts are grouped sums over all rows; what reaches the driver is one number for each feature, bucket
    and class. A bucket's smoothing adds one document. Without a row of either class, ratios are 0 and the
    rate is 0.5 if there is no label at all.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in NAMES]))
    counts = {(r.f, r.b, r.y): r.c for r in labelled.select("y", pairs.alias("p")).groupBy("p.f", "p.b", "y").agg(F.count("*").alias("c")).collect()}
    total = {y: sum(c for (f, _, z), c in counts.items() if f == NAMES[0] and z == y) for y in (0, 1)}
    share = lambda f, b, y: (counts.get((f, b, y), 0) + 1) / (total[y] + WIDTH)
    ratios = {f: [math.log(share(f, b, 1) / share(f, b, 0)) if all(total.values()) else 0.0 for b in range(WIDTH)] for f in NAMES}
    return {"ratios": ratios, "rate": (total[1] + 0.5) / (total[0] + total[1] + 1)}


def evidence(model: dict, values: dict[str, Column]) -> Column:
    """The log likelihood ratio of good against bad for features."""
    parts = [F.element_at(F.array(*map(F.lit, model["ratios"][f])), values[f] + 1) for f in NAMES]
    return sum(parts[1:], parts[0])


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def strength(groups: DataFrame, prior: str | None = None, rate: float = 0.5) -> float:
    """Of the Beta prior over sites with ``n`` documents and ``k`` good ones, by moments: large if sites are alike.

    ``prior`` names a column with each site's prior mean; without it that is ``rate``.
    """
    m = F.col(prior) if prior else F.lit(rate)
    p, within = F.col("k") / F.col("n"), m * (1 - m)
    got = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(p - m, 2)).alias("spread"), F.sum(within).alias("noise"), F.sum(F.col("n") * within).alias("scale"), F.count("*").alias("c")
    ).first()
    if not got.c or not got.scale:
        return STRENGTH[0]
    # E[sum n (p - m)^2] = sum m(1-m) + tau * sum (n - 1) m(1-m), with tau = 1 / (strength + 1)
    tau = max(got.spread - got.noise, 0.0) / max(got.scale - got.noise, 1e-9)
    return min(max(1 / tau - 1, STRENGTH[0]), STRENGTH[1]) if tau > 0 else STRENGTH[1]


def sites(docs: DataFrame, levels: Sequence[str]) -> tuple[DataFrame, float]:
    """``(*levels, site_rate)`` from rows ``(*levels, y, p)``, and the global rate; levels go from the coarsest, such as host, path.

    ``y`` is a label or null, ``p`` the classifier's probability. A null at any level is a site of its own. Each
    level's rates are shrunk towards those of the level above, the first towards the global rate.
    """
    weight = F.when(F.col("y").isNotNull(), 1.0).otherwise(SOFT)
    good = F.when(F.col("y").isNotNull(), F.col("y").cast("double")).otherwise(F.col("p") * SOFT)
    tables = [cut(docs.groupBy(*levels).agg(F.sum(weight).alias("n"), F.sum(good).alias("k")))]
    for depth in range(len(levels) - 1, 0, -1):
        tables.insert(0, cut(tables[0].groupBy(*levels[:depth]).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))))
    total = tables[0].agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = ((total.k or 0.0) + 0.5) / ((total.n or 0.0) + 1.0)
    above = None
    for depth, table in enumerate(tables, 1):
        if above is None:
            table = table.withColumn("prior", F.lit(rate))
        else:
            named = above.toDF(*[f"a{i}" for i in range(depth - 1)], "prior")
            same = F.lit(True)
            for i in range(depth - 1):
                same = same & F.col(levels[i]).eqNullSafe(F.col(f"a{i}"))
            table = cut(table.join(named, same).drop(*[f"a{i}" for i in range(depth - 1)]))
        b = strength(table, prior="prior")
        above = cut(table.select(*levels[:depth], ((F.col("k") + b * F.col("prior")) / (F.col("n") + b)).alias("site_rate")))
    return above, rate


def url_levels(url: Column) -> list[Column]:
    """Host and first path folder of a URL, as levels for ``scored``; what is missing is null."""
    host = F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    return [host, F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)", 1), F.lit(""))]


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: Sequence[str | Column] = ("source", "lang"), label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``quality_p``, the posterior that a document is good, ``site_rate`` and ``keep``.

    ``levels`` are columns or expressions from the coarsest site to the finest: host and path (``url_levels``)
    where documents have a URL, else what stands for them. ``labels`` has ``id_col`` and ``label_col`` (0 or 1;
    other values and null are no label; an id that is labelled more than once has the least of its labels). All
    labelled documents are learnt from. Texts are read once and do not move between machines: only features
    and grouped sums do.

    Null text counts as an empty one; a null site is a site like any other, and so is one without
    a label. A null id is scored, and never labelled. Repeated rows are each scored. An empty table gives no
    rows, and without labels the classifier says nothing and all are kept. Columns of the three names are
    replaced; others pass through, whatever their names.
    """
    sites_ = [F.col(c) if isinstance(c, str) else c for c in levels]
    names = [f"site{i}" for i in range(len(sites_))]
    inner, name = sheltered(docs.withColumns({f"__{n}": c.cast("string") for n, c in zip(names, sites_)}), ADDED)
    inner = inner.withColumnsRenamed({name[f"__{n}"]: n for n in names})
    rows = inner.withColumns(features(F.col(name[text_col])))
    narrow = rows.select(F.col(name[id_col]).alias("id"), *names, *NAMES)
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    narrow = cut(narrow.join(known, "id", "left"))
    model = fit(narrow.where("y is not null"))
    own = {f: F.col(f) for f in NAMES}
    base = math.log(model["rate"] / (1 - model["rate"]))
    table, rate = sites(narrow.select(*names, "y", _sigmoid(evidence(model, own) + base).alias("p")), names)
    small = table.count() <= BROADCAST_ROWS
    table = table.toDF(*[f"of_{n}" for n in names], "site_rate")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"of_{n}"))
    out = rows.join(F.broadcast(table) if small else table, same, "left")
    out = out.withColumn("site_rate", F.coalesce("site_rate", F.lit(rate)))
    out = out.withColumn("quality_p", _sigmoid(_logit(F.col("site_rate")) + evidence(model, own)))
    return restored(out.withColumn("keep", F.col("quality_p") >= threshold), docs, ADDED)
