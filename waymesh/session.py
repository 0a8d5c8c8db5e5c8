"""Session settings and the one way this package cuts lineage.

Iterative jobs write each round as Parquet below the folder named by
``spark.checkpoint.dir`` and go on from the written table. A lost executor then
costs a task retry, never a recomputation of earlier rounds, and the optimiser
sees real sizes instead of a plan that doubles every round.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

#: Parquet files take up this many times their size as rows: what Spark's size check of broadcasts has to reckon with.
COMPRESSION = "16.0"
_FACTOR = "spark.sql.sources.fileCompressionFactor"
#: Shuffled bytes of one task. Sorted keys take up forty times as much in the sorts and windows that follow.
TASK_BYTES = "8m"
_TASK = "spark.sql.adaptive.advisoryPartitionSizeInBytes"

_local_scratch: dict[str, str] = {}


def build_session(app: str = "waymesh", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        _FACTOR: COMPRESSION,
        _TASK: TASK_BYTES,
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def sized_as_rows(spark: SparkSession) -> SparkSession:
    """``spark``, taking files for as large as their rows are, unless the session states a factor of its own.

    Spark takes a file's size for that of its rows. Sorted keys and repeated names shrink to a twentieth on disk, and
    a table that looks like 10 MB then fills the driver when it is broadcast. Joins that are truly small are still
    broadcast, once their shuffles have told their sizes. For the same reason tasks are given fewer shuffled bytes
    than Spark's default of 64 MB, which the sorts of one task would make gigabytes of.
    """
    if float(spark.conf.get(_FACTOR)) == 1.0:
        spark.conf.set(_FACTOR, COMPRESSION)
    if spark.conf.get(_TASK, None) is None:
        spark.conf.set(_TASK, TASK_BYTES)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a temporary folder: on a cluster no other executor could read it.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if root:
        return root
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = context.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="spark-waymesh-")
    return _local_scratch[app]


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = "/".join(
        [scratch_root(spark), "waymesh", spark.sparkContext.applicationId, f"{label}-{uuid.uuid4().hex}"]
    )
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._waymesh_path = path
    return written


def written(frames: list[DataFrame], schema: str) -> DataFrame:
    """Tables written by :func:`cut` as one, read where they lie."""
    spark = frames[0].sparkSession
    return spark.read.schema(schema).parquet(*[frame._waymesh_path for frame in frames])


def retire(*frames: DataFrame | None) -> None:
    """Delete tables written by :func:`cut` that no later step reads."""
    for frame in frames:
        path = getattr(frame, "_waymesh_path", None)
        if path is None:
            continue
        jvm = frame.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = frame.sparkSession._jsc.hadoopConfiguration()
        target.getFileSystem(conf).delete(target, True)


def together(*jobs: Callable):
    """Run independent jobs at the same time from separate threads, results in order.

    Rounds of one job leave executors idle while the next is planned; another job fills
    the gap.
    """
    with ThreadPoolExecutor(max_workers=len(jobs)) as crew:
        return [done.result() for done in [crew.submit(job) for job in jobs]]


class NotConverged(RuntimeError):
    """A round limit was reached; a partial answer is never returned."""
