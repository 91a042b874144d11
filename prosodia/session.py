"""Session helper: settings that suit the operators, left to the caller where already set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "prosodia", master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, narrowed to the columns asked for so that the scan reads nothing else."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


#: Tables of fewer bytes often are one row group, which one task reads; larger ones come in enough parts.
SMALL_BYTES = 1 << 28


def spread(frame: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """A small table dealt to all cores, for work that costs far more a row than moving it; a large one as it is."""
    size = frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    small = int(str(size)) < most
    return frame.repartition(frame.sparkSession.sparkContext.defaultParallelism) if small else frame


def once(frame: DataFrame) -> DataFrame:
    """A frame that several parts of one plan read, made once: a checkpoint in the folder that spark.checkpoint.dir names,
    which survives lost executors, or where it is unset a persisted frame, which is made again from its lineage."""
    return frame.checkpoint() if frame.sparkSession.conf.get("spark.checkpoint.dir", None) else frame.persist()
