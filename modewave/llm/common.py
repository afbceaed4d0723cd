"""What the text operators share: reading tables, written intermediate tables, sizes, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that parts words; the same bytes at which ``bytes.split()`` parts.
SPACES = " \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table under ``sf_dir``, read by Spark only, so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a default only where it is unset and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        path = "/tmp/checkpoints/modewave"
    return path.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it again: lineage ends there, and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # the shuffle files of this one query go when it is written
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the folder behind a stashed table once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null text as empty, so that extra or clashing columns can't matter."""
    return df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def rows_and_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of text, of ``documents()`` output."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def spread(*cols: str) -> Column:
    """A hash of the columns, null-safe: rows with one id, or none, still spread by the others."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols])


def carried(df: DataFrame, *keep: str) -> DataFrame:
    """``rest``, a struct of all columns under their places (c0, c1, ...), and copies of some columns as k0, k1, ...: no name of a user's can clash."""
    cols = df.columns
    whole = df.toDF(*(f"c{i}" for i in range(len(cols))))
    return whole.select(F.struct(*whole.columns).alias("rest"), *(F.col(f"c{cols.index(c)}").alias(f"k{i}") for i, c in enumerate(keep)))


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` out of ``rest``, as they were."""
    return df.select(*(F.col(f"rest.c{i}").alias(c) for i, c in enumerate(like.columns))).to(like.schema)
