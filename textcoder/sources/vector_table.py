"""Vector table on Parquet (S7-S11): fixed dimension and metric, idempotent upsert by id, versions.

Layout under the table folder::

    meta/                     one JSON row: dim, metric (what makes a folder a table)
    data/<writer>/points/     rows of one upsert (a delta), or all rows (a base): id, vector, payload, seq
    data/<writer>/rejects/    rows that the upsert refused, with the reason
    data/<writer>/status/     one row per upload batch: rows, rejected, first error
    claims/<version>          empty file, created exclusively: who creates it owns the version
    commits/<version>.json    what the version holds: its writer's folder, kind and counts

An upsert writes the incoming rows only, one per id (the last one wins), so its cost follows the change, not the table. A version is
the newest base at or before it, with the deltas since; a row of a delta replaces stored rows of its id. When the deltas since
the base hold more than ``COMPACT_SHARE`` of its rows, or are ``COMPACT_DELTAS`` in number, the upsert also writes a new base.
Re-running an upsert with the same points yields the same table.

Readers see what is committed and nothing else. Two writers can't make one version: the claim is an exclusive create, and who loses
takes the next version, which is sound as a delta does not depend on the version before it. (A compaction does; if another
writer commits first, it is dropped.) A writer that is lost between claim and commit leaves a version without content.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "l2")
META_SCHEMA = "dim int, metric string"
POINTS_SCHEMA = ("id string, vector array<float>, "
                 "payload struct<code:string,level:int,parent_code:string,text:string>, "
                 "seq bigint")
STATUS_SCHEMA = "batch_no int, rows bigint, rejected bigint, error string"
COMMIT_SCHEMA = "version int, kind string, folder string, rows bigint, rejected bigint"
COMPACT_SHARE = 0.5
COMPACT_DELTAS = 16
#: Vectors in memory that a task sorts, and of a written file (a scan split takes 32 files at most).
POINT_BYTES = 16 << 20
#: Ids of deltas that are broadcast to the stored rows.
BROADCAST_IDS = 1 << 16


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _claim(spark: SparkSession, path: str, version: int) -> bool:
    """Create the claim of a version; False if it exists."""
    at, fs = _file_system(spark, f"{path}/claims/{version:012d}")
    try:
        fs.create(at, False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def _commit(spark: SparkSession, path: str, record: dict, only: int | None = None) -> int | None:
    """Commit a record as the next free version; with ``only``, as that version or not at all (None)."""
    version = only if only is not None else (newest(spark, path) or 0) + 1 if commits(spark, path) is not None else 0
    while not _claim(spark, path, version):
        if only is not None:
            return None
        version += 1
    # Written aside and renamed, so that no reader meets half a record; the claim keeps the name free.
    text = json.dumps({"version": version, **record}) + "\n"
    aside, fs = _file_system(spark, f"{path}/aside-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(text.encode())
    out.close()
    to, _ = _file_system(spark, f"{path}/commits/{version:012d}.json")
    fs.mkdirs(to.getParent())
    if not fs.rename(aside, to):
        raise OSError(f"version {version} of {path} could not be committed")
    return version


def commits(spark: SparkSession, path: str) -> DataFrame | None:
    """A row per committed version; None if there is none."""
    try:
        return spark.read.schema(COMMIT_SCHEMA).json(f"{path}/commits")
    except AnalysisException:
        return None


def newest(spark: SparkSession, path: str) -> int | None:
    log = commits(spark, path)
    return None if log is None else log.agg(F.max("version")).first()[0]


def _parts(spark: SparkSession, path: str, version: int | None) -> tuple[str | None, list[str], int, int]:
    """(folder of the base, folders of the deltas since in order, rows of the base, rows of the deltas) of a version."""
    log = commits(spark, path)
    rows = [] if log is None else sorted(log.collect(), key=lambda r: r["version"])          # a row per version
    rows = [r for r in rows if version is None or r["version"] <= version]
    last = max((i for i, r in enumerate(rows) if r["kind"] in ("base", "empty")), default=-1)
    base = rows[last] if last >= 0 and rows[last]["kind"] == "base" else None
    deltas = [r for r in rows[last + 1:] if r["rows"]]
    return base and base["folder"], [r["folder"] for r in deltas], base["rows"] if base else 0, sum(r["rows"] for r in deltas)


def table_exists(spark: SparkSession, path: str) -> bool:
    """A vector table exists when its metadata can be read."""
    try:
        spark.read.schema(META_SCHEMA).json(f"{path}/meta")      # raises if the path is missing
        return True
    except AnalysisException:
        return False


def list_tables(spark: SparkSession, root: str) -> DataFrame:
    """Names of the vector tables directly under a folder, as ``(name)``.

    File paths come from the ``binaryFile`` source (only the ``path`` column is
    read); a table is a folder holding ``meta``."""
    try:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .load(root).select("path"))
    except AnalysisException:
        return spark.createDataFrame([], "name string")
    root_ = root.rstrip("/")
    name = F.regexp_extract("path", r"/([^/]+)/meta/[^/]+$", 1)
    return (files.where(F.col("path").contains("/meta/"))
            .where(F.col("path").contains(root_.split(":", 1)[-1]))
            .select(name.alias("name")).where(F.col("name") != "").distinct())


def create_or_replace(spark: SparkSession, path: str, dim: int, metric: str = "cosine") -> None:
    """An empty table with a fixed dim and metric; a table that exists is emptied by a further version."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if dim < 1:
        raise ValueError("dim must be positive")
    (spark.createDataFrame([(int(dim), metric)], META_SCHEMA)
     .coalesce(1).write.mode("overwrite").json(f"{path}/meta"))
    _commit(spark, path, {"kind": "empty", "folder": "", "rows": 0, "rejected": 0})


def table_meta(spark: SparkSession, path: str) -> tuple[int, str]:
    row = spark.read.schema(META_SCHEMA).json(f"{path}/meta").first()
    if row is None:
        raise FileNotFoundError(f"no vector table at {path}")
    return int(row["dim"]), row["metric"]


def current_version(spark: SparkSession, path: str) -> int | None:
    """Newest committed version."""
    return newest(spark, path)


def _file_rows(dim: int) -> int:
    """Points that a task holds, or a file that is written: zeros take no space in Parquet or a shuffle, but do in memory."""
    return max(1, POINT_BYTES // (4 * dim + 256))


def _dealt(rows: DataFrame, n_rows: int, dim: int, *keys: str) -> DataFrame:
    """``rows`` in partitions of bounded memory; as their number is given, Spark doesn't join them by their (compressed) bytes."""
    return rows.repartition(max(1, -(-n_rows // _file_rows(dim))), *keys)


def _latest(rows: DataFrame, order: str, n_rows: int, dim: int) -> DataFrame:
    """One row per id, the last by ``order`` (no two rows of an id have the same). It is chosen by ids alone, combined map-side; the
    rows with their vectors are dealt by id and order, so a hot id is spread, and a task sorts a bounded number of them."""
    last = rows.groupBy("id").agg(F.max(order).alias("_last")).withColumnRenamed("id", "_of")
    return (_dealt(rows, n_rows, dim, "id", order).join(last, (F.col("id") == F.col("_of")) & (F.col(order) == F.col("_last")), "left_semi")
            .select("id", "vector", "payload", "seq"))


def _points(spark: SparkSession, path: str, base: str | None, deltas: list[str], n_base: int, n_deltas: int) -> DataFrame:
    def read(folder: str) -> DataFrame:
        return spark.read.schema(POINTS_SCHEMA).parquet(f"{path}/data/{folder}/points")

    stored = read(base) if base else spark.createDataFrame([], POINTS_SCHEMA)
    if not deltas:
        return stored
    if len(deltas) == 1:
        changed = read(deltas[0])                       # one row per id as written
    else:
        changed = None
        for i, folder in enumerate(deltas):
            part = read(folder).withColumn("_at", F.lit(i))
            changed = part if changed is None else changed.unionByName(part)
        changed = _latest(changed, "_at", n_deltas, table_meta(spark, path)[0])
    if not base:
        return changed
    # Only ids of the deltas meet the base. Few ids are broadcast, and the stored vectors stay where they are.
    new = changed.select(F.col("id").alias("_new"))
    if n_deltas <= BROADCAST_IDS:
        new = F.broadcast(new)
    else:
        stored = _dealt(stored, n_base, table_meta(spark, path)[0], "id")
    return stored.join(new, F.col("id") == F.col("_new"), "left_anti").unionByName(changed)


def read_points(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Points ``(id, vector, payload)`` of a version (default: newest); empty before the first upsert."""
    return _points(spark, path, *_parts(spark, path, version)).select("id", "vector", "payload")


def refusal(dim: int):
    """Why a point is refused (null: it is not): null vector, wrong dimension, null id."""
    return (F.when(F.col("vector").isNull(), F.lit("null vector")).when(F.size("vector") != F.lit(dim), F.lit("wrong dimension"))
            .when(F.col("id").isNull(), F.lit("null id")))


def upsert(spark: SparkSession, path: str, points: DataFrame) -> DataFrame:
    """S8 + S9: insert or overwrite points by ``id``; returns a one-row report
    ``(version, n_rejected, n_rows)``. Rows whose vector is null or not of the
    table dimension go to the upsert's rejects, not to the table."""
    dim, _ = table_meta(spark, path)
    folder = uuid.uuid4().hex
    here = f"{path}/data/{folder}"
    # Embedding is the dear part: written once, then read for points, rejects and status.
    (points.select("id", F.col("vector").cast("array<float>").alias("vector"), "payload")
     .withColumn("seq", F.monotonically_increasing_id()).withColumn("batch_no", F.spark_partition_id())
     .withColumn("why", refusal(dim)).write.option("maxRecordsPerFile", _file_rows(dim)).parquet(f"{here}/staged"))
    incoming = spark.read.parquet(f"{here}/staged")
    _latest(incoming.where("why is null"), "seq", incoming.count(), dim).write.parquet(f"{here}/points")
    incoming.where("why is not null").write.parquet(f"{here}/rejects")
    # One status row per upload batch (a batch is an input partition):
    # rows received, rows refused and why, instead of a silently skipped batch.
    (incoming.groupBy("batch_no").agg(F.count(F.lit(1)).alias("rows"), F.count("why").alias("rejected"), F.max("why").alias("error"))
     .write.parquet(f"{here}/status"))
    n_new = spark.read.parquet(f"{here}/points").count()
    n_rej = spark.read.parquet(f"{here}/rejects").count()
    version = _commit(spark, path, {"kind": "delta", "folder": folder, "rows": n_new, "rejected": n_rej})
    n_rows = read_points(spark, path, version).select("id").count()
    _, deltas, n_base, n_deltas = _parts(spark, path, version)
    if len(deltas) >= COMPACT_DELTAS or (n_base and n_deltas > COMPACT_SHARE * n_base) or (not n_base and len(deltas) > 1):
        compact(spark, path)
    return spark.createDataFrame([(version, n_rej, n_rows)],
                                 "version int, n_rejected bigint, n_rows bigint")


def compact(spark: SparkSession, path: str) -> int | None:
    """Write the newest version as a base; its version, or None if another writer committed meanwhile."""
    at = newest(spark, path)
    folder = uuid.uuid4().hex
    _points(spark, path, *_parts(spark, path, at)).write.option("maxRecordsPerFile", _file_rows(table_meta(spark, path)[0])).parquet(f"{path}/data/{folder}/points")
    rows = spark.read.parquet(f"{path}/data/{folder}/points").count()
    return _commit(spark, path, {"kind": "base", "folder": folder, "rows": rows, "rejected": 0}, only=at + 1)


def _of_version(spark: SparkSession, path: str, version: int, what: str) -> DataFrame:
    log = commits(spark, path)
    row = log.where(F.col("version") == version).first() if log is not None else None
    if row is None or row["kind"] != "delta":
        raise ValueError(f"version {version} of {path} is no upsert")
    return spark.read.parquet(f"{path}/data/{row['folder']}/{what}")


def upload_status(spark: SparkSession, path: str, version: int) -> DataFrame:
    """``(batch_no, rows, rejected, error)`` of one upsert."""
    return _of_version(spark, path, version, "status")


def read_rejects(spark: SparkSession, path: str, version: int) -> DataFrame:
    """``(id, vector, payload, why)`` of the rows that one upsert refused."""
    return _of_version(spark, path, version, "rejects").select("id", "vector", "payload", "why")


def table_count(spark: SparkSession, path: str) -> int:
    """Exact number of points."""
    return read_points(spark, path).select("id").count()
