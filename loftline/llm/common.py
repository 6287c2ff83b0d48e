"""What the operators of this subpackage share: input columns, staged tables, ids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
WS = r"[\x20\x09-\x0D]"
#: A word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]"

#: Bytes of a row group of a staged table: what a task holds of it before it writes.
GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset a local master gets a new local folder; with any other master that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def staged(df: DataFrame, kind: str = "stage") -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, so a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, kind)
    df.write.option("parquet.block.size", GROUP).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.staged_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def unused(df: DataFrame, name: str) -> str:
    """name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def same(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    """Join condition on equal columns where null equals null."""
    found = left[columns[0]].eqNullSafe(right[columns[0]])
    for c in columns[1:]:
        found &= left[c].eqNullSafe(right[c])
    return found


def kept_rows(docs: DataFrame, decisions: DataFrame, digest: Column) -> DataFrame:
    """For deduplication: the rows of docs that decisions (doc_id, digest, kept) keeps, with the columns of docs.

    Only the ids of dropped rows are joined to docs.  Ids that several rows share are told apart by digest, which is
    computed for those rows alone; of rows with one id and one digest one stays.
    """
    decisions = staged(decisions.select("doc_id", "digest", "kept"), "decisions")
    shared = staged(decisions.groupBy("doc_id").count().where("count > 1").select("doc_id"), "shared")
    dropped = decisions.where("not kept").select("doc_id")
    if shared.isEmpty():
        return docs.join(dropped, same(docs, dropped, "doc_id"), "left_anti")
    single = docs.join(shared, same(docs, shared, "doc_id"), "left_anti")
    single = single.join(dropped, same(single, dropped, "doc_id"), "left_anti")
    name = unused(docs, "_digest")
    several = docs.join(shared, same(docs, shared, "doc_id"), "left_semi").withColumn(name, digest)
    stay = decisions.where("kept").select("doc_id", F.col("digest").alias(name)).distinct()
    several = several.join(stay, same(several, stay, "doc_id", name), "left_semi")
    return single.unionByName(several.dropDuplicates(["doc_id", name]).select(docs.columns))
