"""What the operators of this subpackage share: written intermediates, salted joins, words."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space (Java and RE2 read this alike).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: A comma or full stop and a blank, without an ASCII letter or digit, or a Latin letter beyond ASCII, before them.
#: The search goes from sign to sign and looks back there.
NO_WORD_BEFORE = re.compile(rb"[,.] (?<![0-9A-Za-z][,.] )(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][,.] )")

#: Tables of at most this many rows are broadcast; each row of those tables is under 1 KB.
BROADCAST_ROWS = 100_000
SALTS = 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets
    a temporary one; on a cluster that is an error, as executors would write to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a path through Spark's file systems, whatever their kind."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Folders of intermediates, one for each application, that are deleted when the driver ends.
_FOLDERS: set[str] = set()


def _clean_at_exit(spark: SparkSession, folder: str) -> None:
    # the driver ends anyway: a connection that is already closed leaves the folder to whoever owns the shared one
    with contextlib.suppress(Py4JError, OSError):
        _delete(spark, folder)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in this application's part of it, which is deleted when the driver ends."""
    folder = f"{shared_folder(spark)}/tessera-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_clean_at_exit, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written_to = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._written_to)


def salted_left_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, salts: int = SALTS) -> DataFrame:
    """big LEFT JOIN small on keys (small unique by keys), where a key may hold any share of big.

    Rows of big are dealt over ``salts`` copies of each key by ``spread``, so a hot key is read by that many tasks;
    small is repeated ``salts`` times. The join is a sort-merge join: estimates of a repeated table come from before the
    repetition, and would let it be broadcast at any size.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.hint("merge"), [*keys, "_salt"], "left").drop("_salt")


def lookup(big: DataFrame, small: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """big LEFT JOIN small on keys; small is broadcast if it is counted to be at most BROADCAST_ROWS rows."""
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, "left")
    return salted_left_join(big, small, keys, spread)


def id_text(column: str = "doc_id") -> Column:
    return F.col(column).cast("string")


def held_out(column: str = "doc_id") -> Column:
    """True for rows whose crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(id_text(column), F.lit("")).cast("binary")) % 5) == 0
