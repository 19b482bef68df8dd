"""Small helpers shared by the corpus operators."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fintally.session import ensure_checkpoint_dir, scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def text_mark(col: str = "text") -> Column:
    """64-bit mark of a text. With doc_id it tells rows of one doc_id with different texts apart;
    rows alike in doc_id and text are one document to the operators that key by it."""
    return F.xxhash64(whole_text(col))


BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of at most BATCH_ROWS rows: Spark's own bound is made for
    short rows, and a worker would hold it several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str,
              start: Callable[[], object] | None = None) -> DataFrame:
    """mapInArrow with one call of ``fn`` per batch; ``start`` runs once per task and its result,
    if there is one, is the second argument."""
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start() if start else None
        for batch in batches:
            if batch.num_rows:
                out = fn(batch, state) if start else fn(batch)
                if out is not None and out.num_rows:
                    yield out
    return df.mapInArrow(run, schema)


def field(df: DataFrame, name: str, out: str | None = None) -> T.StructField:
    """The type that ``name`` has in ``df``, for an output schema."""
    return T.StructField(out or name, df.schema[name].dataType, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder and read from there: survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Written as a table in the shared folder and read from there: work behind it is done once, and
    lost executors don't undo it."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
