"""Session configuration and plan-level guards shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Most bytes that ``bounded_broadcast`` lets through.
BROADCAST_BYTES = 16 << 20


def get_spark(app: str = "cadence", cpus: int | str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local/cluster session with the settings every plan here assumes."""
    builder = SparkSession.builder.appName(app)
    if cpus is not None:
        builder = builder.master(f"local[{cpus}]")
    parts = shuffle_partitions or int(os.environ.get("CADENCE_SHUFFLE_PARTITIONS", "8"))
    spark = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CADENCE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and must be on shared storage.
    Only when it is unset (local tests) do we pick a fresh temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: checkpoints and "
                               "materialised tables must survive lost executors")
        path = tempfile.mkdtemp(prefix="cadence-ckpt-")  # local runs and tests only
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/cadence/{name}-{uuid.uuid4().hex[:12]}"


def bounded_broadcast(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows and ``max_bytes`` bytes.

    Both are measured over at most ``max_rows + 1`` rows (a cheap job; none for a
    ``local_table``).  Above either bound the frame is returned unhinted, so the
    planner uses a shuffle join (and AQE may still broadcast it if the
    materialised side turns out small).
    """
    size = getattr(df, "_cadence_size", None)
    if size is None:
        width = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
        size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if size[0] <= max_rows and size[1] <= max_bytes else df


def local_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A DataFrame from an in-memory list; its size is recorded so
    ``bounded_broadcast`` needs no job to prove the bound."""
    from pyspark.sql.types import _parse_datatype_string

    st = _parse_datatype_string(schema)
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, st.fields)])
               for row in rows]
    if structs:
        df = spark.range(1).select(F.inline(F.array(*structs)))
    else:
        df = spark.createDataFrame([], st)
    df._cadence_size = (len(rows), sum(len(str(v)) for row in rows for v in row))
    return df


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as a parquet table under the shared checkpoint folder
    (``spark.checkpoint.dir``) and read it back.

    For intermediate results that several branches of a plan reuse (the
    artist vectors every user is scored against): computed in one job,
    lineage cut, on shared storage so it survives lost executors (never a
    local checkpoint), and read back with real size statistics for AQE."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)  # the schema is known: no job reads it from a footer


def materialize_counted(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, dict]:
    """``materialize``, with aggregates over the rows (``rows`` and those given) that are taken
    while they are written, so that no second job reads the table for them."""
    from pyspark.sql import Observation

    seen = Observation()
    columns = [F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in metrics.items())]
    out = materialize(df.observe(seen, *columns), name)
    return out, seen.get


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The parquet table at ``path``, or None if nothing has been written there yet, or only
    partitioned writes without a row, which leave a folder without files and so without a schema.
    Any other failure to read it is raised.  With ``schema`` no file is opened to find it (a folder
    without files then is an empty table)."""
    from pyspark.errors import AnalysisException

    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
