"""Session settings, the shared work folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # What Python holds at once does not grow with the input: pages and texts may be long.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}

# Only effective before the session starts: call-site capture costs several round trips per column.
STARTUP = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

BROADCAST_ROWS = 200_000

_FALLBACK: dict[str, str] = {}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quotelab")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**SETTINGS, **STARTUP}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator relies on (UTC dates, AQE, Arrow)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see; taken from the session, a temporary one only on a local master without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _FALLBACK:
            _FALLBACK[application] = tempfile.mkdtemp(prefix="quotelab-")
        folder = _FALLBACK[application]
    return folder.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/quotelab-{application}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; never scans further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting; otherwise leave the join to AQE."""
    return F.broadcast(df) if fits(df, max_rows) else df


def left_join_spread(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, hopeless: Column, row: str
) -> DataFrame:
    """Left join where rows that can never match (``hopeless``: no key, blank key) are spread out.

    They would all hash to one task.  A second join key is 0 on every row that can match and a hash
    of ``row`` elsewhere; on the right it is derived from the key, so that it stays a hash key.
    """
    side = right.withColumn("_spread", F.pmod(F.xxhash64(right_key), F.lit(1)))
    spread = F.when(hopeless, F.pmod(F.xxhash64(row), F.lit(4096))).otherwise(0).cast("long")
    same = (F.col(left_key) == F.col(right_key)) & (F.col("_left_spread") == F.col("_spread"))
    joined = left.withColumn("_left_spread", spread).join(side, same, "left")
    return joined.drop("_left_spread", "_spread", right_key)
