"""Transaction vectors on shared storage, partitioned by cell: searched and changed cell by cell.

A store is a folder with three tables:

* ``centres`` (cell, centre): fitted once, on a bounded sample;
* ``vectors`` (transaction_id, vector, merchant, category, amount, distance to the centre), a folder a cell;
* ``places`` (transaction_id, cell), a folder a hash bucket of the id: where a transaction's vector is.

A search reads only the folders of the cells that some query probes. A cell can hold nothing nearer to a
query than its centre's distance less the cell's radius, so with ``exact`` a second round reads the cells
that this bound cannot rule out, and the answer equals the exhaustive one; without it the answer is
approximate, with k neighbours whenever the store holds them. A batch of changes reads its
buckets of ``places``, then rewrites the folders of the cells it touches and no others; run again, it ends in
the same rows. The driver holds centres and one number each for cells and buckets.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fintally.operators import similarity as SI
from fintally.session import written

COLUMNS = ["transaction_id", "vector", "merchant", "category", "amount"]
#: Folders of ``places``.
BUCKETS = 64
#: Vectors of the cells that an exact search takes together.
PACK_ROWS = 4 * SI.BLOCK_ROWS

_VECTORS = T.StructType([
    T.StructField("transaction_id", T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("merchant", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("amount", T.DoubleType()), T.StructField("distance", T.DoubleType()), T.StructField("cell", T.IntegerType())])
_PLACES = "transaction_id long, cell int, bucket int"
_CENTRES = "cell int, centre array<double>"


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema({"vectors": _VECTORS, "places": _PLACES, "centres": _CENTRES}[name]).parquet(f"{path}/{name}")


def stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the store. (A folder that lost all its rows holds one without an id.)"""
    return _table(spark, path, "vectors").where("transaction_id IS NOT NULL")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["centre"] for r in _table(spark, path, "centres").orderBy("cell").collect()], np.float64)


def _bucket():
    return F.pmod(F.xxhash64("transaction_id"), F.lit(BUCKETS)).cast("int")


def _squares(vectors: pd.Series, centres: np.ndarray) -> np.ndarray:
    """Squared distances to all centres."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return np.maximum(np.einsum("vd,vd->v", x, x)[:, None] + np.einsum("cd,cd->c", centres, centres) - 2 * x @ centres.T, 0)


def placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vectors`` (with COLUMNS) with distance and cell."""
    def assign(batches):
        for pdf in batches:
            for part in SI.chunks(pdf, len(centres)):
                cell = _squares(part["vector"], centres).argmin(1)
                x = np.stack(part["vector"].to_numpy()).astype(np.float64)
                yield part.assign(distance=np.linalg.norm(x - centres[cell], axis=1), cell=cell.astype("int32"))
    return vectors.select(*[F.col(c).cast(_VECTORS[c].dataType) for c in COLUMNS]).mapInPandas(assign, _VECTORS)


def _replace(rows: DataFrame, by: str, path: str) -> None:
    """Replaces the folders that ``rows`` has; large ones are dealt to several tasks."""
    rows.hint("rebalance", by).write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def create_store(vectors: DataFrame, path: str, cell_rows: int = 1024, max_cells: int = 4096, sample_rows: int = 20_000) -> None:
    """A new store of ``vectors`` (COLUMNS, one row a transaction). Vectors without id or of no length are
    left out."""
    vectors = vectors.where(F.col("transaction_id").isNotNull() & (F.size("vector") > 0))
    cells = min(max_cells, max(1, -(-vectors.count() // cell_rows)))
    centres = SI.fit_centres(vectors, "vector", "transaction_id", cells, sample_rows)
    vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], _CENTRES).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    rows = written(placed(vectors, centres), "placed")
    _replace(rows, "cell", f"{path}/vectors")
    _replace(rows.select("transaction_id", "cell", _bucket().alias("bucket")), "bucket", f"{path}/places")


def change_store(spark: SparkSession, path: str, changes: DataFrame) -> list[int]:
    """Applies ``changes`` (transaction_id, seq, op, vector, category, merchant, amount; op 'put', 'delete' or
    'recategorize'; the largest seq of a transaction counts) and returns the cells rewritten."""
    columns = ["op", "vector", "category", "merchant", "amount"]
    last = changes.groupBy("transaction_id").agg(F.max_by(F.struct(*columns), "seq").alias("c")).select("transaction_id", "c.*")
    last = written(last.where(F.col("transaction_id").isNotNull() & ((F.col("op") != "put") | (F.size("vector") > 0))), "vector-changes")
    if stored_vectors(spark, path).isEmpty():
        create_store(last.where("op = 'put'").select(*COLUMNS), path)
        return []
    puts = written(placed(last.where("op = 'put'"), _centres(spark, path)), "vector-puts")
    buckets = [r[0] for r in last.select(_bucket()).distinct().collect()]  # at most BUCKETS numbers
    places = _table(spark, path, "places").where(F.col("bucket").isin(buckets))
    before = places.join(last.select("transaction_id"), "transaction_id", "left_semi").select("cell")
    cells = sorted(r["cell"] for r in before.unionByName(puts.select("cell")).distinct().collect())  # at most a number a centre
    op = last.select("transaction_id", "op", F.col("category").alias("__category"))
    kept = (stored_vectors(spark, path).where(F.col("cell").isin(cells)).join(op, "transaction_id", "left").where("op IS NULL OR op = 'recategorize'")
            .withColumn("category", F.when(F.col("op") == "recategorize", F.col("__category")).otherwise(F.col("category"))).select(*_VECTORS.names))
    marker = lambda numbers, schema, by: spark.createDataFrame([tuple(n if f == by else None for f in schema.names) for n in numbers], schema)
    _replace(written(kept.unionByName(puts).unionByName(marker(cells, _VECTORS, "cell")), "cells"), "cell", f"{path}/vectors")
    stay = places.join(op.where("op <> 'recategorize'"), "transaction_id", "left_anti").select("transaction_id", "cell", "bucket")
    moved = puts.select("transaction_id", "cell", _bucket().alias("bucket"))
    _replace(written(stay.unionByName(moved).unionByName(marker(buckets, places.schema, "bucket")), "places"), "bucket", f"{path}/places")
    return cells


def packed(sizes: np.ndarray, rows: int) -> np.ndarray:
    """A pack for each cell: neighbours in number share one as long as it has at most ``rows`` vectors."""
    pack, held, out = 0, 0, np.zeros(len(sizes), np.int32)
    for cell, n in enumerate(sizes.tolist()):
        if held and held + n > rows:
            pack, held = pack + 1, 0
        held, out[cell] = held + n, pack
    return out


def search_store(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, exclude_self: bool = False,
                 live: DataFrame | None = None, query_id: str = "query_id", vector: str = "vector", block_rows: int | None = None) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the ``k`` nearest vectors of each query by squared L2 distance, ties
    by id. ``live`` (transaction_id) leaves out vectors of other transactions.

    With ``exact`` cells are searched by packs of about ``block_rows`` vectors: a query is sent once to each pack that has a
    cell it needs, so queries that need most cells are not copied for each of them."""
    centres = _centres(spark, path)
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in stored_vectors(spark, path).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("r")).collect():
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["r"]
    need = int(k) + bool(exclude_self)
    block_rows = block_rows or (PACK_ROWS if exact else SI.BLOCK_ROWS)
    pack = packed(sizes, block_rows) if exact else np.arange(len(sizes), dtype=np.int32)
    held = {i: int(n) for i, n in enumerate(np.bincount(pack, sizes)) if n}

    def nearest_cells(square: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(square, axis=1, kind="stable")
        wanted = np.maximum(probes, (np.cumsum(sizes[order], axis=1) < need).sum(1) + 1)
        return [o[:n][sizes[o[:n]] > 0] for o, n in zip(order, wanted)]

    def first(batches):
        for pdf in batches:
            for part in SI.chunks(pdf, len(centres)):
                yield part.assign(cells=[np.unique(pack[c]).tolist() for c in nearest_cells(_squares(part["qv"], centres))])

    def further(batches):
        for pdf in batches:
            for part in SI.chunks(pdf, len(centres)):
                square = _squares(part["qv"], centres)
                # rounding only ever adds a cell
                may = (np.sqrt(square) - radii <= np.sqrt(part["reach"].to_numpy(float))[:, None] * (1 + 1e-9) + 1e-6) & (sizes > 0)
                cells = [np.setdiff1d(pack[row], pack[seen]).tolist() for row, seen in zip(may, nearest_cells(square))]
                yield part.drop(columns="reach").assign(cells=cells)

    q = queries.select(F.col(query_id).alias("qid"), F.col(vector).alias("qv"))
    asked_type = T.StructType([*q.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def found_in(asked: DataFrame) -> DataFrame:
        asked = written(asked, "asked")
        per_cell = {r["cell"]: r["count"] for r in asked.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()}
        base = stored_vectors(spark, path).where(F.col("cell").isin(np.flatnonzero(np.isin(pack, list(per_cell))).tolist()))
        if live is not None:
            base = base.join(live.select("transaction_id"), "transaction_id", "left_semi")
        number = F.element_at(F.array(*[F.lit(int(p)) for p in pack]), F.col("cell") + 1) if exact else F.col("cell")
        base = base.select(F.col("transaction_id").alias("bid"), F.col("vector").alias("bv"), number.alias("cell"))
        return SI.search_cells(asked, base, held, per_cell, k, exclude_self, block_rows)

    nearest = Window.partitionBy("qid").orderBy("dist", "bid")
    best = lambda rows: rows.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    found = found_in(q.mapInPandas(first, asked_type))
    if exact:
        found = written(best(found).drop("rank"), "near")
        reach = found.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("reach"))
        reached = q.join(reach, "qid", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
        found = found.unionByName(found_in(reached.mapInPandas(further, asked_type)))
    return best(found).select(F.col("qid").alias(query_id), "rank", F.col("bid").alias("neighbor_id"), F.col("dist").alias("distance"))
