"""Indexes of the test corpora, built once and kept for all queries that read them."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import embedding
from tidemark.operators.ann import IvfPq, IvfPqParams, ivf_params
from tidemark.operators.text_index import TextIndex
from tidemark.sources import versions


#: Changes when what is written changes, so that no query reads what an older version of this code kept.
FORMAT = 7


def base(spark: SparkSession) -> str:
    """A folder that all executors share."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_serving").rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder there."""
    return f"{base(spark)}/run-{uuid.uuid4().hex}"


def _home(spark: SparkSession, sf: str, table: str, kind: str) -> str:
    """A folder that all executors share; its name follows the files of the table, so that other files have another index."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(f"{sf}/{table}.parquet")
    fs = p.getFileSystem(conf)
    files = fs.listStatus(p)
    seen = sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in files)
    return f"{base(spark)}/index{FORMAT}-{kind}-{hashlib.sha256(chr(10).join(seen).encode()).hexdigest()[:24]}"


def text(spark: SparkSession, sf: str) -> TextIndex:
    """The documents' words, with /lang/source as category."""
    index = TextIndex(spark, _home(spark, sf, "documents", "text"))
    if versions.current(spark, index.path) is None:
        d = spark.read.parquet(f"{sf}/documents.parquet")
        index.write(d.select("doc_id", "text", F.concat(F.lit("/"), "lang", F.lit("/"), "source").alias("category")), "doc_id", "text")
    return index


def _kept(spark: SparkSession, home: str, make) -> DataFrame:
    name = versions.current(spark, home)
    if name is None:
        name = versions.new_name()
        make(f"{home}/{name}")
        versions.commit(spark, home, name)
    return spark.read.parquet(f"{home}/{name}")


def doc_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """id, vector: the documents' hashed vectors."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("id"), embedding.md5_embedding("text").alias("vector"))
    return _kept(spark, _home(spark, sf, "documents", "vectors"), lambda path: d.write.parquet(path))


def ivf(spark: SparkSession, sf: str, nlist: int | None = None) -> IvfPq:
    """The index of the embeddings table, with as many cells as its size asks for or as are given."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    home = _home(spark, sf, "embeddings", f"ivf{nlist or ''}")
    if versions.current(spark, home) is None:
        wanted = ivf_params(e.count(), 64)
        IvfPq.build(e, home, IvfPqParams(min(nlist or wanted.nlist, wanted.nlist), wanted.m))
    return IvfPq.load(spark, home)
