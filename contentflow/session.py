"""Session construction and the few settings the operators rely on."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "contentflow", cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A session for one machine. On a cluster the launcher supplies the master,
    memory, shuffle partitions and ``spark.checkpoint.dir`` instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", os.environ.get("CONTENTFLOW_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.contentflow.text.partitions", str(cpus))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> None:
    """Event times are stored without a zone and mean UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names and that every executor sees.

    Only a session that runs in one process (``local[...]``) may leave it unset; it then
    gets a scratch folder of its own. A cluster without the setting is refused, because
    a folder of the driver's machine would be invisible to the executors."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("contentflow.scratch", None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        configured = "file://" + tempfile.mkdtemp(prefix="contentflow-scratch-")
        spark.conf.set("contentflow.scratch", configured)
    return configured.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss because the data is in the
    shared folder, and stops plans of iterative operators from growing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet under a new name in the shared folder, and the folder it lies in, for tasks that
    read it block by block. Lineage ends there as with a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def landed_json(df: DataFrame, name: str, by: list[str] | None = None) -> str:
    """``df`` written as JSON lines under a new name in the shared folder, as a landing job would leave it; ``by`` makes folders."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.json(path)
    return path


def landed_text(df: DataFrame, name: str) -> str:
    """The lines of a frame with one text column, written as they are."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.text(path)
    return path


def give_back() -> None:
    """Returns freed memory to the system at the end of a Python task: a worker lives on for other tasks, and what its
    allocators keep would add up with that of the workers beside it."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no such call outside glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)
