"""Session settings, the shared scratch folder and durable tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("caselog")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_folders: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``, or the checkpoint folder set on the context.

    A local session without either gets a temporary folder, one per application. Any other master must name one:
    a machine-local folder would be invisible to the other executors.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is not None:
        return folder.rstrip("/")
    master = context.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder shared by all machines (master {master})")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="caselog-")
    return _local_folders[context.applicationId]


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes the files once nothing refers to them.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


class Workspace:
    """Intermediate tables of one operator: Parquet in the shared folder, removed when the block ends.

    Unlike a checkpoint the files keep their columns, so later reads prune them. What the block returns must not
    depend on its tables: end with ``durable`` or a written result.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/caselog-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def __enter__(self) -> Workspace:
        return self

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(written)] = path
        return written

    def drop(self, written: DataFrame) -> None:
        """Remove one table before the block ends; nothing may read it any more."""
        remove_folder(self.spark, self.paths.pop(id(written)))

    def __exit__(self, *_: object) -> None:
        remove_folder(self.spark, self.root)


def clean_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of results that are gone; by itself it does so when the driver's heap is full, which steps that leave it empty never make it."""
    gc.collect()
    spark._jvm.System.gc()


def remove_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
