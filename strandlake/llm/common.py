"""What the operators share: durable cut points, connected components, input normalisation.

Contract for every operator: only the named columns of the input are read, so extra
columns (also ones with clashing names) do no harm; a null text counts as the empty text.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side is broadcast, after they have been summed up.
BROADCAST_BYTES = 24 << 20
#: Broadcasts that one side may be cut into before the other one is shuffled instead.
PIECES = 12
#: Edges up to which components are found in one partition, without shuffles.
FEW = 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is named."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandlake-"))
        current = sc._jsc.sc().getCheckpointDir()
    return named or current.get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the plan's lineage ends here and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already: nothing to delete with
        pass


_open: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder of that name for this run, below the shared one; deleted when the driver exits."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def spool(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back; deleted when the driver exits, or by ``scratch``."""
    spark = df.sparkSession
    path = scratch_path(spark, "spool")
    df.write.option("compression", "zstd").parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Inside, ``spool`` is for intermediate tables: all but the last one spooled are deleted at the end.

    So the block must end by spooling its result, which then depends on nothing else. Shuffle
    files of the finished plans go with the driver's next garbage collection, asked for here.
    """
    _open.append(paths := [])
    try:
        yield
    finally:
        _open.pop()
        for path in paths[:-1]:
            _delete(spark, path)
        if _open:
            _open[-1].extend(paths[-1:])
        release(spark)


def release(spark: SparkSession) -> None:
    """Asks for a collection on the driver, with which the shuffle files of finished plans go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of an Arrow batch, so that a worker never holds many long texts at once.

    Plans are run after they are made, so all operators ask for the same bounds.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def id_text(name: str = "doc_id") -> Column:
    """A long id as text: pandas would turn longs with a null among them into doubles."""
    return F.col(name).cast("long").cast("string").alias(name)


def id_again(df: DataFrame, name: str = "doc_id") -> DataFrame:
    return df.withColumn(name, F.col(name).cast("long"))


def _width(df: DataFrame) -> Column:
    """About how many bytes a row takes when it is broadcast."""
    fixed, sizes = 0, []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            sizes.append(F.octet_length(F.col(f.name)))
        elif kind in ("array", "map"):
            sizes.append(F.octet_length(F.to_json(F.struct(F.col(f.name)))))
        else:
            fixed += 32 if kind == "struct" else 8
    return sum((F.coalesce(x, F.lit(0)).cast("long") for x in sizes), F.lit(fixed + 16).cast("long"))


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is counted and measured to be small; else as it is (a shuffled join).

    Reads no more rows than could fit. ``df`` is made twice, so it should be cheap or spooled.
    """
    rows, size = df.select(_width(df).alias("w")).limit(most // 24 + 1).agg(F.count("*"), F.sum("w")).first()
    return F.broadcast(df) if rows <= most // 24 and (size or 0) <= most else df


def kept_by(df: DataFrame, side: DataFrame, on: str) -> DataFrame:
    """``df``'s rows whose ``on`` (not null) is in ``side(on)``, a spooled table; ``df`` isn't shuffled while ``side`` fits into a few broadcasts.

    A side that is too large for one broadcast is cut by hash; each cut reads ``df`` again and
    writes its rows. Beyond ``PIECES`` cuts both sides are shuffled.
    """
    size = side.agg(F.sum(_width(side))).first()[0] or 0
    pieces = -(-size // BROADCAST_BYTES)
    if pieces > PIECES:
        return df.join(side, on, "left_semi")
    if pieces < 2:
        return df.join(F.broadcast(side), on, "left_semi")
    of = F.pmod(F.xxhash64(on), F.lit(pieces))
    parts = [spool(df.where(of == i).join(F.broadcast(side.where(of == i)), on, "left_semi")) for i in range(pieces)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _united(edges: DataFrame) -> DataFrame:
    """``u, root`` of the nodes of few edges: in one task, each tree of nodes hangs below its smallest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := above.setdefault(x, x)) != x:
                above[x] = x = above[y]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(u), top(v)
                above[max(a, b)] = min(a, b)
        nodes = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["u", "root"])

    return edges.coalesce(1).mapInArrow(run, "u long, root long")


def components(edges: DataFrame, rounds: int = 60, python: bool = False) -> DataFrame:
    """Connected components of ``edges(u, v)`` (long ids): one row ``(u, root)`` per node that has an edge.

    Alternating large-star and small-star contraction: each round is two grouped minima and
    two joins on the node, the number of rows never grows beyond edges plus nodes, and nothing
    is gathered on the driver but a count and a checksum. Up to ``FEW`` edges stay in one partition,
    where ``python`` follows them in one pass, one job instead of two for each round. ``root`` is the smallest id.
    Self-loops are dropped; repeated edges count once; no edges give no rows.
    """

    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = one(e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        joined = both.join(lowest, both.u == lowest.n)
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = one(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lowest.select(F.col("n").alias("u"), F.col("m").alias("v"))))
        return out.where("u <> v").distinct()

    def mark(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    with scratch(spark):
        current = spool(edges.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct())
        seen = mark(current)
        if python and seen[0] <= FEW:
            return spool(_united(current))
        # rows of one partition need no shuffle to meet
        one = (lambda df: df.coalesce(1)) if seen[0] <= FEW else (lambda df: df)
        for _ in range(rounds):
            if not seen[0]:
                break
            current = spool(star(star(one(current), True), False))
            now = mark(one(current))
            if now == seen:
                break
            seen = now
            if seen[0] > FEW:
                release(spark)
        else:
            if seen[0]:
                raise RuntimeError("components did not converge")
    current = one(current)
    roots = current.select("u", F.col("v").alias("root"))
    return one(roots.unionAll(current.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()))
