import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

LEDGER_COLS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("date", T.DateType()),
    T.StructField("amount", T.DecimalType(18, 2)), T.StructField("merchant", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("category_id", T.LongType()),
    T.StructField("account_id", T.LongType()), T.StructField("is_recurring", T.BooleanType()),
    T.StructField("recurring_group_id", T.LongType()), T.StructField("is_anomaly", T.BooleanType()),
    T.StructField("is_split", T.BooleanType()),
])


def ledger(spark, rows):
    """rows: (id, 'YYYY-MM-DD', amount, merchant[, category_id[, description]])."""
    out = []
    for r in rows:
        rid, d, amt, m = r[:4]
        cat = r[4] if len(r) > 4 else None
        desc = r[5] if len(r) > 5 else None
        out.append((rid, dt.date.fromisoformat(d), Decimal(str(amt)), m, desc, cat, 1, False, None, False, False))
    return spark.createDataFrame(out, LEDGER_COLS)
