"""What several operators need: tables in the shared folder, checked broadcasts,
connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a dimension that may be broadcast: 200,000 narrow rows stay below some 20 MB.
BROADCAST_ROWS = 200_000
#: Pairs of a node beyond which it is a hub.
HUB = 256
#: Folders that materialise wrote and that are still there, by name.
_written: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a local one, but on a local master
    only: executors of a cluster do not see the driver's disk."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quirework-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Rows that hold whole texts go to Python 1,000 at a time, not 10,000, unless the session
    says otherwise: a batch is held several times over, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    This cuts the lineage: a lost executor costs the tasks since this table, not
    the passes before it. The folder goes at release, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quirework/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, where = _folder(spark, path)
    files.deleteOnExit(where)
    _written[path.rpartition("/")[2]] = path
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def release(*tables: DataFrame) -> None:
    """Deletes what materialise wrote for these tables, after its last use; no other files."""
    for table in tables:
        spark = table.sparkSession
        for name in {f.split("/")[-2] for f in table.inputFiles()} & set(_written):
            files, where = _folder(spark, _written.pop(name))
            files.delete(where, True)


def join_small(left: DataFrame, small: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """left joined with a dimension of so many rows: broadcast up to BROADCAST_ROWS,
    beyond them an ordinary join, whose large partitions adaptive execution splits."""
    return left.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def join_hubs(left: DataFrame, right: DataFrame, on: list[str], n: int, how: str = "inner") -> DataFrame:
    """left, of n rows, joined with right, which has one row for each key and in column pairs how
    many rows of left have it; pairs goes.

    Keys of more than HUB rows are joined by broadcast, the rest by key, so no task gets a
    hub's rows. HUB grows with n: less than BROADCAST_ROWS keys can have more.
    """
    most = max(HUB, -(-n // BROADCAST_ROWS))
    hubs = right.where(F.col("pairs") > most).drop("pairs")
    rest = right.where(F.col("pairs") <= most).drop("pairs")
    if not hubs.limit(1).count():
        return left.join(rest, on, how)
    marked = left.join(F.broadcast(hubs.withColumn("_hub", F.lit(True))), on, "left")
    others = marked.where("_hub is null").select(*left.columns).join(rest, on, how)
    return marked.where("_hub").drop("_hub").unionByName(others)


def _with_least(pairs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """pairs(u, v), n of them, with m, the smallest of each u and its partners; and the written
    table behind it."""
    low = materialise(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("pairs")), "least")
    return join_hubs(pairs, low, ["u"], n), low


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges(u long, v long): node, component (its smallest node).

    Alternating large-star and small-star rounds, each a join with the smallest partner; hubs
    are joined apart. A written table closes each round, and those it no longer needs go.
    Rounds grow with the square of the logarithm of the longest path at most, so 60 are out
    of reach; more would raise an error, not stop early. Self-loops and repeated edges do no
    harm; no edges give no rows.
    """
    flat = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    flat = materialise(flat, "edges")
    state = _fingerprint(flat)
    for _ in range(rounds):
        if not state[0]:
            break
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, low = _with_least(both, 2 * state[0])
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), "large")
        small, lower = _with_least(large, 2 * state[0])
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, flat = flat, materialise(small.select("e.*").where("u <> v").distinct(), "edges")
        release(before, large, low, lower)
        now = _fingerprint(flat)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = flat.select("v").distinct()
    return flat.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    n, h = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return n, int(h or 0)


def join_dimension(left: DataFrame, dim: DataFrame, key: str, rows: int) -> DataFrame:
    """left left-joined with a dimension that has one row for each key, null a key too."""
    marked = lambda d: d.withColumns({"_k": F.coalesce(key, F.lit("")), "_null": F.col(key).isNull()})
    return join_small(marked(left), marked(dim).drop(key), ["_k", "_null"], "left", rows).drop("_k", "_null")
