"""Session settings and lineage cuts shared by the pipelines."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Application id -> checkpoint folder that was handed to its context.
_in_use: dict[str, str] = {}


def build_session(app: str = "pairwave", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for.

    ``forceOptimizeSkewedJoin`` lets AQE split a skewed join even where the
    join's own partitioning would have been reused by the next operator.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Pinned frames are removed from the checkpoint folder once unused.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Call sites are recorded per column expression otherwise, which
        # takes longer than planning for tables of fifty columns.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, as named by the cluster.

    Only a local-mode session without the setting gets a folder of its own;
    on a cluster a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    if named is None:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="pairwave-checkpoint-")
    if _in_use.get(context.applicationId) != named:
        context.setCheckpointDir(named)
        _in_use[context.applicationId] = named
    return named


def pin(frame: DataFrame) -> DataFrame:
    """Materialise a frame that an iterative fit reads many times.

    A reliable checkpoint survives the loss of executors, so a Newton step
    never recomputes the joins that produced the frame.
    """
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)

