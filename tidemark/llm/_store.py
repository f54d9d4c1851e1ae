"""Cutting lineage through the folder that all executors share, and what else several operators need of a session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where the session names none, one in the warehouse, which all executors share as well."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return sc.getCheckpointDir()


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers get at most ``rows`` rows at a time: the default of 10,000 and 64 MB ignores what is made of a text.
    Plans read this setting when they run, so it stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from :func:`materialize` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        home = shared_dir(spark).rstrip("/").rpartition("/")[2]
        for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"/{home}/t-" in top:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], base: str) -> str:
    """A column name that ``columns`` don't have, in whatever case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base
