"""What the operators share: a shared folder for intermediate tables, and word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run without ASCII white space (bytes.split() uses the same six characters).
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\r\x0b\x0c"
#: A-Z only, so that words with other capital letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. Only a local session that names none
    gets one of its own in the machine's temporary folder; a cluster without the setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="sparkshelf-")
    spark.sparkContext._conf.set("spark.checkpoint.dir", own)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, and survives the loss of any
    executor. Unlike checkpoint(), it computes df once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table that written() made, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *wanted: str) -> str:
    """A column name that df does not have yet, for the first of the wanted names."""
    taken = {c.lower() for c in df.columns}
    name = wanted[0]
    while name.lower() in taken:
        name = f"_{name}"
    return name
