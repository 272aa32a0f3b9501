"""Session construction and the shared scratch folder.

On a cluster the session is built by the caller; ``spark.checkpoint.dir`` then names a shared folder
(HDFS/S3/...) that every executor can reach.  Only when that setting is unset (local runs, tests) do we
pick a folder of our own.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "quarry",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """A session with the settings every operator assumes: UTC, AQE, Arrow, no UI."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # local runs read a few MB: let AQE keep small shuffles spread over the cores (operators
        # such as the n-gram metrics multiply rows after their raw-text shuffle)
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in local-mode Python workers (pandas UDFs pickle functions by
    module), once per application.

    On a cluster the deployment ships the package (``spark-submit --py-files`` or an installed
    wheel); nothing is done there.  In ``local[...]`` mode the package is zipped on the driver host
    and handed to ``addPyFile``.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a session without a local SparkContext (e.g. Spark Connect): nothing to ship
        return
    if not sc.master.startswith("local") or sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    zip_dir = tempfile.mkdtemp(prefix="quarry-pyfiles-")
    base = shutil.make_archive(os.path.join(zip_dir, "quarry"), "zip", os.path.dirname(pkg_dir), "quarry")
    sc.addPyFile(base)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the SparkContext's checkpoint directory when one is set (by
    ``spark.checkpoint.dir`` or ``setCheckpointDir``), else ``spark.checkpoint.dir``; only when the
    session names none and its master is ``local[...]`` is a local folder chosen (local runs, tests);
    on any other master that is an error."""
    try:
        sc = spark.sparkContext
    except Exception:  # no local SparkContext (e.g. Spark Connect): the server owns checkpointing
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    current = spark.conf.get(_CKPT_KEY, None)
    if not current:
        if sc is None or not sc.master.split("[")[0] == "local":
            raise ValueError(f"{_CKPT_KEY} is not set: name a folder that the driver and every executor share")
        current = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set(_CKPT_KEY, current)
    if sc is not None:
        sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder (never reused, never cleared)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/quarry/{name}-{uuid.uuid4().hex[:12]}"
