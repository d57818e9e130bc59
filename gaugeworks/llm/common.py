"""What the operators of this subpackage share: tables, lineage cuts and shelter for a caller's columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short rows (a few numbers each) that a partition of a table in few partitions holds.
HELD = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all of Spark runs in one
    process, as in tests, a temporary folder stands in; elsewhere an unset folder raises.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        kept = context._jsc.sc().getCheckpointDir()
        if not kept.isDefined() and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = kept.get() if kept.isDefined() else "file://" + tempfile.mkdtemp(prefix="gaugeworks-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """``df`` computed once and kept by ``checkpoint()`` in the shared folder; its lineage ends there.

    With ``parts``, it is written and read in no more partitions than that: Spark forgets how a table was dealt
    out once it is kept, and groups and joins without a shuffle only what it knows to be one partition.
    """
    shared_folder(df.sparkSession)
    return df.coalesce(parts).checkpoint().coalesce(parts) if parts else df.checkpoint()


def held(df: DataFrame) -> DataFrame:
    """``cut``, in no more partitions than its rows need (``HELD``).

    Few rows are then one partition, within which Spark groups and joins without a shuffle, and leave one file,
    not one for each of the session's shuffle partitions.
    """
    rows = cut(df)
    parts = needed(rows.count())
    return cut(rows, parts) if parts < partitions(df.sparkSession) else rows


def needed(rows: int) -> int:
    """Partitions that so many short rows need."""
    return max(1, -(-rows // HELD))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as compressed Parquet in the shared folder and read again.

    For what is too large to keep uncompressed, as ``checkpoint()`` does. The folder has a name of its
    own; whoever owns the shared folder clears it, as with files of ``checkpoint()``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sheltered(docs: DataFrame, added: Sequence[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names ``c0, c1, ...``, without columns named in ``added``, and the new name of each old one.

    An operator's own columns then clash with none of a caller's, and names with dots or back-ticks need no care.
    Of columns that share a name, the last is the one that the map gives.
    """
    gone = {c.lower() for c in added}
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in gone]
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select(*[f"c{i}" for i in kept])
    return inner, {docs.columns[i]: f"c{i}" for i in kept}


def restored(out: DataFrame, docs: DataFrame, added: Sequence[str]) -> DataFrame:
    """What ``sheltered`` renamed under its old names, then the columns ``added``."""
    gone = {c.lower() for c in added}
    kept = [(f"c{i}", c) for i, c in enumerate(docs.columns) if c.lower() not in gone]
    return out.select(*[c for c, _ in kept], *added).toDF(*[c for _, c in kept], *added)
