"""Exact dedup by stateful streaming (native).

Each document is reduced to a record: digest of the normalised text, number of code points, stable
identifier and content locator (hash of the file name, row in the file). The records are appended to a Parquet feed,
read by a Structured Streaming query that groups them by digest. Its keyed state lives in RocksDB on
disk, has no expiry, and holds for each digest the count and the record that stays. The state
table is then read back as a DataFrame, and the rows whose digest was hit look up their group.

With a ``state`` folder the state outlives the call: a later call feeds the files it brings (the stream reads only what is new),
and its rows are decided against everything fed before. The folder keeps the names of the files that were fed, so
that content can be read again through the locators; a call that is repeated after a loss feeds nothing twice.

A hit (a digest with several records) is checked on full bytes: the normalised texts of such a
digest, of this call and, through their locators, of earlier ones, must have equal minimum and maximum. Texts that share a digest but
differ are grouped by the whole text instead, so the result does not rest on the digest. Copies are combined map-side before the state
(an aggregation); the look-up and the byte check salt each digest, so no
task holds a group of copies. The feed is read in micro-batches of a bounded number of bytes.

Which row stays: the most code points in the original text, then the smallest identifier (null last),
then the first row by locator. Defined cases: null text counts as empty and equals an empty or blank
text; repeated rows, also of a frame that holds rows of a file several times, are copies of which one stays; an empty table
gives an empty result; a file that comes again with other files than before is an error; other columns
are passed on untouched and may have any name.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textcoder.llm.util import located, stored, without_spaces
from textcoder.session import work_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the stream's own session.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # Each of many small state partitions would otherwise reserve megabytes of disk for its logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_SALTS = 8


def normalised(text: Column) -> Column:
    return without_spaces(F.coalesce(text, F.lit("")))


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _order(points: str, ident: str, file: str, row: str) -> Column:
    return F.struct((-F.col(points)).alias("points"), F.col(ident).isNull().alias("no_id"), F.col(ident).alias("id"),
                    F.col(file).alias("file"), F.col(row).alias("row"))


def _folder(state: str | None, spark: SparkSession, rows: DataFrame) -> tuple[str, str]:
    """Folder of the state, and the part of its feed that holds the files of ``rows`` (named after them)."""
    if state is None:
        return work_dir(spark, "dedup-state"), "once"
    files = rows.select("__path").distinct().agg(F.sha2(F.array_join(F.array_sort(F.collect_list("__path")), "\n"), 256)).first()[0]
    return state.rstrip("/"), files[:32]


def _readable(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def keyed_state(folder: str, feed: DataFrame, batch_bytes: int, key_chars: int) -> DataFrame:
    """Run the stream over what is new in the feed; the whole state as (key, count, keep)."""
    spark = feed.sparkSession.newSession()
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.shuffle.partitions", feed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    log = f"{folder}/state-{key_chars}"
    records = (spark.readStream.schema(feed.schema).option("maxBytesPerTrigger", batch_bytes).parquet(f"{folder}/feed")
               .withColumn("key", F.substring("digest", 1, key_chars)))
    grouped = records.groupBy("key").agg(F.min(_order("points", "id", "file", "row")).alias("keep"),
                                         F.count(F.lit(1)).alias("count"))
    query = (grouped.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
             .option("checkpointLocation", log).start())
    query.awaitTermination()
    state = feed.sparkSession.read.format("statestore").load(log)
    return state.select(F.col("key.key").alias("key"), F.col("value.count").alias("count"),
                        F.col("value.min").alias("keep"))


def _fed(rows: DataFrame, text: str, ident: str, text_col: str, state: str | None) -> tuple[str, str, DataFrame]:
    """Add the records of ``rows`` to the feed, unless a run that was lost had done so; (folder, part, records of these rows)."""
    spark = rows.sparkSession
    folder, part = _folder(state, spark, rows)
    own = f"{folder}/feed/part={part}"
    if state is None or not _readable(spark, f"{folder}/files/part={part}"):
        if state is not None and _readable(spark, f"{folder}/files"):
            known = spark.read.parquet(f"{folder}/files").select(F.col("path").alias("known"))
            twice = rows.select("__path").distinct().join(known, F.col("__path") == F.col("known"), "left_semi")
            if not twice.isEmpty():
                raise ValueError(f"{twice.first()[0]} came with other files in an earlier feed; feed new files by themselves")
        slim = rows.select(digest(F.col(text)).alias("digest"), F.coalesce(F.length(text), F.lit(0)).alias("points"),
                           F.col(ident).alias("id"), F.col("__file").alias("file"), F.col("__row").alias("row"))
        slim.write.mode("overwrite").parquet(own)
        if state is not None:               # written after the feed: what is listed here was fed
            (rows.select(F.col("__file").alias("file"), F.col("__path").alias("path")).distinct()
             .withColumn("text", F.lit(text_col)).write.mode("overwrite").parquet(f"{folder}/files/part={part}"))
    return folder, part, spark.read.parquet(own)


def _earlier_texts(folder: str, part: str, hits: DataFrame, key_chars: int) -> DataFrame | None:
    """(key, norm, file, row) of earlier rows that share a digest with others, read again from their files by the stored locators."""
    spark = hits.sparkSession
    feed = (spark.read.parquet(f"{folder}/feed").filter(F.col("part") != part)
            .select(F.substring("digest", 1, key_chars).alias("key"), "file", "row").join(hits.select("hit").distinct(), F.col("key") == F.col("hit"))
            .drop("hit"))
    files = (spark.read.parquet(f"{folder}/files").filter(F.col("part") != part)
             .join(feed.select("file").distinct(), "file", "left_semi").select("path", "text").distinct().collect())     # file names only
    texts = None
    for column in sorted({f["text"] for f in files}):
        found = (spark.read.parquet(*[f["path"] for f in files if f["text"] == column])
                 .select(normalised(F.col(f"`{column}`")).alias("norm"), F.xxhash64("_metadata.file_path").alias("at_file"),
                         F.col("_metadata.row_index").alias("at_row")))
        found = found.join(feed, (F.col("file") == F.col("at_file")) & (F.col("row") == F.col("at_row"))).select("key", "norm", "file", "row")
        texts = found if texts is None else texts.union(found)
    return texts


def decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 16 << 30,
              key_chars: int = 64, state: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(located rows of ``df``, decision per locator: file, row, id, keep_id, group_size, kept, digest).

    ``key_chars`` shortens the state's key; any length gives the same result. ``state`` names a folder whose keyed state goes on
    from call to call: rows of ``df`` are then copies of what earlier calls have fed, too. Only then must ``df`` be rows of stored files.
    """
    rows = located(df)
    text, ident = f"in_{df.columns.index(text_col)}", f"in_{df.columns.index(id_col)}"
    folder, part, feed = _fed(rows, text, ident, text_col, state)
    if feed.isEmpty():
        return rows, feed.select("file", "row", "id", F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"),
                                 F.lit(True).alias("kept"), "digest")
    groups = keyed_state(folder, feed, batch_bytes, key_chars).filter("count > 1").withColumnRenamed("key", "hit")
    feed = feed.withColumn("key", F.substring("digest", 1, key_chars))
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    salt = F.pmod(F.xxhash64("file", "row"), F.lit(_SALTS)).cast("int")

    # Full bytes of every hit.
    texts = rows.select(F.substring(digest(F.col(text)), 1, key_chars).alias("key"), normalised(F.col(text)).alias("norm"),
                        F.col("__file").alias("file"), F.col("__row").alias("row"))
    hits = groups.select("hit", salts.alias("hit_salt"))
    met = texts.withColumn("salt", salt).join(hits, (F.col("key") == F.col("hit")) & (F.col("salt") == F.col("hit_salt")), "left_semi")
    earlier = _earlier_texts(folder, part, groups, key_chars) if state is not None else None
    if earlier is not None:
        met = met.unionByName(earlier.withColumn("salt", salt))
    spread = (met.groupBy("key", "salt").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
              .groupBy("key").agg(F.min("least").alias("least"), F.max("most").alias("most")))
    unequal, _ = stored(spread.filter("least <> most").select("key"), "dedup-unequal")

    def decided(own: DataFrame, groups: DataFrame, by: str) -> DataFrame:
        """Rows look up their group under a salt of their own, so that a large group is spread; a row without group stays."""
        at = groups.withColumnRenamed("hit", "group_key").withColumn("group_salt", salts)
        found = own.withColumn("salt", salt).join(at, (F.col(by) == F.col("group_key")) & (F.col("salt") == F.col("group_salt")), "left")
        alone = F.col("group_key").isNull()
        return found.select("file", "row", "id", F.when(alone, F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
                            F.coalesce("count", F.lit(1).cast("long")).alias("group_size"),
                            (alone | ((F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row")))).alias("kept"), "digest")

    if unequal.isEmpty():
        return rows, decided(feed, groups, "key")
    sound = decided(feed.join(unequal, "key", "left_anti"), groups, "key")
    apart = met.drop("salt").join(unequal, "key", "left_semi").select(F.col("file").alias("f"), F.col("row").alias("r"), "norm")
    whole_feed = feed if state is None else whole_record(feed.sparkSession, folder)
    apart = (apart.join(whole_feed.select("digest", "points", "id", "file", "row"), (F.col("f") == F.col("file")) & (F.col("r") == F.col("row"))))
    whole = apart.groupBy(F.col("norm").alias("hit")).agg(
        F.min(_order("points", "id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("count"))
    mine = apart.join(feed.select(F.col("file").alias("f2"), F.col("row").alias("r2")),
                      (F.col("file") == F.col("f2")) & (F.col("row") == F.col("r2")), "left_semi")
    return rows, sound.unionByName(decided(mine, whole, "norm"))


def whole_record(spark: SparkSession, folder: str) -> DataFrame:
    """All records that were ever fed to the state in a folder."""
    return spark.read.parquet(f"{folder}/feed").drop("part")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    _, found = decisions(df, id_col, text_col, **options)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay, with its columns."""
    rows, found = decisions(df, id_col, text_col, **options)
    gone = found.filter(~F.col("kept")).select(F.col("file").alias("__gone_file"), F.col("row").alias("__gone_row"))
    left = rows.join(gone, (F.col("__file") == F.col("__gone_file")) & (F.col("__row") == F.col("__gone_row")), "left_anti")
    return left.drop("__path", "__file", "__row").toDF(*df.columns)
