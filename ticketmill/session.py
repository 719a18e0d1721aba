"""Session settings and the shared folder every job writes its working files to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where the split costs a further shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # State of streams lies in files beside the executor, not in its heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 4 << 20


def build_session(app: str = "ticketmill", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs rely on; cluster sizing is left to the submitter."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session somebody else started."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def bound_batches(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes: ten thousand rows, Spark's own bound, can be any size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared working folder, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a machine-local path
    would lose files together with the executor that wrote them.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if configured.startswith("file:") and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is a folder of one machine")
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ticketmill-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark)}/ticketmill/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write the rows below the shared folder and go on from the files.

    The files survive the loss of any executor, later steps read only the columns they need, and
    joins are planned on the sizes the files really have.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
