"""Tables of document parts that are replaced by document in one step: readers see all of a commit or nothing of it.

A table is a folder. ``parts/<uuid>`` holds the rows that a commit adds and ``parts/<uuid>.ids`` the documents that it
replaces, both Parquet; ``commits/<n>`` is a line of JSON that names them and makes version n. A commit file is created
only where none is, so of two writers one takes version n and the other the next; as a commit states whole documents, the
later one wins and nothing has to be written again. Parts that no commit names, of a writer that was lost, are never read.

A commit is renamed into place with the rule that nothing is replaced, as Spark's own streaming logs are: on HDFS that is
one step; on local disks only one process may write at a time. A token, such as a stream's batch, is committed once.
Nothing is deleted while it could be read: ``clean`` does that when the user says which versions no reader needs.

Rows have doc_id (null is a document too) and any other columns, the same in every commit.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Ids of replaced documents that may be broadcast, 16 bytes each.
BROADCAST_IDS = 1_000_000
#: Bytes of rows that a file of a compacted table is to hold.
FILE_BYTES = 128 << 20


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def commits(spark: SparkSession, table: str) -> list[dict]:
    """Commits in order of version; an empty list where there is no table."""
    fs, folder = _path(spark, f"{table}/commits")
    if not fs.exists(folder):
        return []
    found = sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())
    out = []
    for n in found:
        stream = fs.open(_path(spark, f"{table}/commits/{n}")[1])
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        out.append(json.loads(text) | {"version": n})
    return out


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """Rename unless the target exists."""
    jvm, (_, old), (_, new) = spark._jvm, _path(spark, source), _path(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    rules = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(context.makeQualified(old), context.makeQualified(new), rules)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e):
            raise
        return False
    return True


def _commit(spark: SparkSession, table: str, entry: dict, after: int | None = None) -> int | None:
    """Make entry the next version. With after, only if that is still the last version: else None."""
    fs, folder = _path(spark, f"{table}/commits")
    fs.mkdirs(folder)
    staged = f"{table}/commits/.{uuid.uuid4().hex}"
    out = fs.create(_path(spark, staged)[1], False)
    try:
        out.write(bytearray(json.dumps(entry).encode()))
    finally:
        out.close()
    found = None
    while True:
        before = commits(spark, table)
        last = before[-1]["version"] if before else 0
        again = [c["version"] for c in before if entry["token"] is not None and c["token"] == entry["token"]]
        if again or (after is not None and last != after):
            found = again[0] if again else None
            break
        if _rename(spark, staged, f"{table}/commits/{last + 1}"):
            return last + 1
    fs.delete(_path(spark, staged)[1], False)
    return found


def _stage(rows: DataFrame, table: str, ids: DataFrame | None, token: str | None, base: bool) -> dict:
    spark, name = rows.sparkSession, uuid.uuid4().hex
    path = f"{table}/parts/{name}"
    rows.write.parquet(path)
    own = spark.read.schema(rows.schema).parquet(path).select("doc_id")
    (own if ids is None else own.unionByName(ids.select("doc_id"))).distinct().write.parquet(f"{path}.ids")
    replaced = spark.read.schema(own.schema).parquet(f"{path}.ids").count()
    return {"part": name, "replaced": replaced, "schema": rows.schema.json(), "token": token, "base": base}


def replace(rows: DataFrame, table: str, ids: DataFrame | None = None, token: str | None = None) -> int:
    """All rows of the documents in rows, and of those in ids (doc_id), are replaced by rows; the version that shows it.

    A document that is in ids and not in rows is deleted. Rows of equal content are all kept. A token that was committed
    before changes nothing and gives its version.
    """
    spark = rows.sparkSession
    before = commits(spark, table)
    if token is not None and any(c["token"] == token for c in before):
        return next(c["version"] for c in before if c["token"] == token)
    if before and _shape(before[-1]) != [(f.name, f.dataType) for f in rows.schema]:
        raise ValueError(f"columns {rows.schema.simpleString()} are not those of {table}")
    return _commit(spark, table, _stage(rows, table, ids, token, False))


def _schema(commit: dict) -> StructType:
    return StructType.fromJson(json.loads(commit["schema"]))


def _shape(commit: dict) -> list:
    return [(f.name, f.dataType) for f in _schema(commit)]


def read(spark: SparkSession, table: str, version: int | None = None, name: str | None = None) -> DataFrame:
    """The table as of a version, the last one if none is given; commits made later are not seen by the frame.

    name adds a column with the version that wrote a row; after a compaction that is the compaction's.
    """
    seen = [c for c in commits(spark, table) if version is None or c["version"] <= version]
    if not seen or (version is not None and seen[-1]["version"] != version):
        raise ValueError(f"{table} has no version {version or 1}")
    schema = _schema(seen[-1])
    start = max((i for i, c in enumerate(seen) if c["base"]), default=0)
    live = seen[start:]
    rows = reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{table}/parts/{c['part']}").withColumn("_v", F.lit(c["version"])) for c in live])
    if len(live) > 1:
        key = StructType([f for f in schema if f.name == "doc_id"])
        ids = reduce(DataFrame.unionByName, [spark.read.schema(key).parquet(f"{table}/parts/{c['part']}.ids").withColumn("_last", F.lit(c["version"])) for c in live[1:]])
        last = ids.groupBy(F.col("doc_id").alias("_id")).agg(F.max("_last").alias("_last"))
        if sum(c["replaced"] for c in live[1:]) <= BROADCAST_IDS:
            last = F.broadcast(last)
        # at most one row an id: what a later commit replaced is dropped, everything else stays
        rows = rows.join(last, F.col("doc_id").eqNullSafe(F.col("_id")), "left").where(F.col("_v") >= F.coalesce("_last", F.lit(0)))
    return rows.select(*schema.names, *([F.col("_v").cast("long").alias(name)] if name else []))


def compact(spark: SparkSession, table: str) -> int | None:
    """Write the last version as one part, in ranges of ids and files of some FILE_BYTES; the version that this makes.

    Nothing is committed, and None is returned, if a writer committed meanwhile: what it wrote would be lost.
    """
    seen = commits(spark, table)
    last = seen[-1]["version"]
    rows = read(spark, table, last)
    start = max((i for i, c in enumerate(seen) if c["base"]), default=0)
    size = 0
    for c in seen[start:]:
        fs, path = _path(spark, f"{table}/parts/{c['part']}")
        size += fs.getContentSummary(path).getLength()
    # a document of any number of rows is dealt over ranges by the hash of its rows
    ordered = rows.repartitionByRange(max(1, -(-size // FILE_BYTES)), "doc_id", F.xxhash64(*rows.columns))
    return _commit(spark, table, _stage(ordered, table, None, None, True), last)


def clean(spark: SparkSession, table: str, version: int) -> int:
    """Delete the parts that only versions before ``version`` read; their number. Parts no commit names stay."""
    seen = commits(spark, table)
    start = max((i for i, c in enumerate(seen) if c["base"] and c["version"] <= version), default=0)
    gone = 0
    for c in seen[:start]:
        for part in (c["part"], f"{c['part']}.ids"):
            fs, path = _path(spark, f"{table}/parts/{part}")
            gone += bool(fs.delete(path, True))
    return gone


def write_stream(rows: DataFrame, table: str, checkpoint: str, name: str):
    """Replace the documents of each batch of a stream as one commit; a batch that is replayed is not committed again.

    name tells the streams that write to a table apart, and stays the same when a stream is started again.
    """

    def batch(part: DataFrame, number: int) -> None:
        replace(part, table, token=f"{name}:{number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
