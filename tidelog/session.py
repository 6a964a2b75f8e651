"""Session settings that every operator relies on."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.sources.files import write_whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that is unset, as in local tests, a folder of this machine is made and used.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None or not os.path.isdir(own):
        own = shared_dir.own = tempfile.mkdtemp(prefix="tidelog-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder for one run under the shared one."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the shared folder: executors may be lost afterwards."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As `checkpoint`, with a Parquet table in the shared folder: for many rows, which it compresses."""
    path = f"{work_dir(df.sparkSession, 'table')}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes that every executor can hold beside its work.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a hint to broadcast it, if its bytes, counted, are few; else as it is, for a shuffled join.
    For frames that are cheap to count, such as aggregated or checkpointed ones. A value counts 16 bytes and its length."""
    var = (T.StringType, T.BinaryType, T.ArrayType, T.MapType)
    length = {f.name: F.octet_length(f.name) if isinstance(f.dataType, T.StringType | T.BinaryType) else 16 * F.size(f.name) for f in df.schema if isinstance(f.dataType, var)}
    size = sum((F.coalesce(n, F.lit(0)) for n in length.values()), F.lit(16 * len(df.columns))).cast("bigint")
    # counting stops at as many rows as there is room for
    few = df.select(size.alias("n")).limit(most // 16 + 1).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= most
    return df.hint("broadcast") if few else df


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors' Python workers, once per application, so that they need no
    installed copy of it."""
    context = spark.sparkContext
    if getattr(ship, "to", None) == context.applicationId:
        return
    root, archive = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    uri = f"{work_dir(spark, 'package')}/tidelog.zip"
    write_whole(uri, [archive.getvalue()])
    context.addPyFile(uri)
    ship.to = context.applicationId
