"""What the operators of this subpackage share: cutting lineage, size-checked joins, words."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as a Java regular expression class body.
SPACE = r"\x20\x09-\x0D"
#: Tables below so many bytes are left in few tasks.
SPREAD_BYTES = 1 << 20
#: A side of a join is broadcast only if it was counted and has at most so many (narrow) rows.
BROADCAST_ROWS = 50_000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own.

    Raises on a cluster that names no such folder: a machine-local one would lose rows there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = jvm_dir.get() if jvm_dir.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="checkpoints-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: its lineage ends here and later reads are cheap.

    Lost executors cost nothing, because the files are not on their disks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path  # for `forget`
    return out


def mark() -> int:
    """Where `forget` starts."""
    return len(_written)


def forget(since: int, *keep: DataFrame | None) -> None:
    """Remove the tables that `cut` wrote since a mark, but those of `keep`. Nothing may read them any more."""
    kept = {getattr(x, "_cut", None) for x in keep}
    gone = [x for x in _written[since:] if x[1] not in kept]
    _written[since:] = [x for x in _written[since:] if x[1] in kept]
    for spark, path in gone:
        _delete(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """A table of files, dealt over all cores if its files are fewer than these; larger tables stay as they are.

    Parquet's row groups don't split, so a small table of one file would be one task's.
    """
    spark = df.sparkSession
    cores, most = spark.sparkContext.defaultParallelism, int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < SPREAD_BYTES or size >= cores * most or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def release() -> None:
    """Remove every table written by `cut`; also runs when the driver ends normally."""
    while _written:
        spark, path = _written.pop()
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM has gone already; the folder's owner cleans up
            return


def words(text: Column) -> Column:
    """The words of a text in order, as an array; null or blank: an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words as a long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def join_small(big: DataFrame, small: DataFrame, on: Column | list[str], how: str = "inner") -> DataFrame:
    """Join with a side that is usually small: broadcast once counted within BROADCAST_ROWS, else shuffled.

    `small` should be cheap to count (a table made by `cut`).
    """
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return big.join(F.broadcast(small) if few else small, on, how)


def trim() -> None:
    """Give back the memory that this Python worker has no use for: idle workers live on beside the next stage's."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed arrays
    if malloc_trim:
        malloc_trim(0)


def map_column(df: DataFrame, column: str, kind: str, make, outs: dict[str, str], keep: list[str] | None = None) -> DataFrame:  # noqa: ANN001
    """`df` with new columns made from one column over Arrow batches; columns named like new ones are replaced.

    make() is called once a task and gives a function from an Arrow array (of type `kind`) to pieces (rows taken,
    list of new arrays). keep: the columns to return besides the new ones; None: all. The column itself is sent once.
    """
    import pyarrow as pa

    kept = [c for c in (df.columns if keep is None else keep) if c not in outs]
    kinds = dict(df.dtypes)
    same = column in kept and kinds[column] == kind
    inner = df.select(*[F.col(c).alias(f"x{i}") for i, c in enumerate(kept)], *([] if same else [F.col(column).cast(kind).alias("c")]))
    at = kept.index(column) if same else len(kept)
    names = [*(f"x{i}" for i in range(len(kept))), *(f"y{i}" for i in range(len(outs)))]

    def run(batches):  # noqa: ANN001, ANN202
        fn = make()
        for b in batches:
            done = 0  # rows of the batch that are dealt with
            for rows, arrays in fn(b.column(at)):
                yield pa.RecordBatch.from_arrays([*b.slice(done, rows).columns[: len(kept)], *arrays], names)
                done += rows
        del fn
        pa.default_memory_pool().release_unused()  # idle workers live on beside the next stage's

    schema = ", ".join([*(f"x{i} {kinds[c]}" for i, c in enumerate(kept)), *(f"y{i} {k}" for i, k in enumerate(outs.values()))])
    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(kept)], *[F.col(f"y{i}").alias(c) for i, c in enumerate(outs)])
