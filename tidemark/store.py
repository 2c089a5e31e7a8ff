"""Tables in the folder of spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. If it is unset a temporary one is set in local mode, as in tests; on a cluster, whose
    executors could not reach it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the session may be gone when Python ends
        pass


#: With this, Spark deletes the files of a query's shuffles at its end, not when the driver's JVM happens to collect garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> None:
    """df as Parquet, of which nothing else is left on disk then."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, True)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(SHUFFLES_GO, before) if before is not None else conf.unset(SHUFFLES_GO)


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """df, written as Parquet in the shared folder and read back: lineage ends here, nothing is worked out twice and lost executors
    lose nothing. `.tidemark_path` of the result is its folder; it goes when Python ends, or earlier with drop()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    write(df, path)
    atexit.register(_drop_quietly, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tidemark_path = path
    return out


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of what the driver has. It comes with its size, so Spark itself sends a small one to all tasks and shuffles a large one."""
    kind = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) or [()] * len(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind), schema)
