"""Goal state with many contributions of one time."""
import datetime as dt
from decimal import Decimal

import pytest

from fintally.operators import goals as GO


@pytest.mark.parametrize("target,want", [(9500, 9500), (3, 3), (4097, 4097), (12_000, None)])
def test_one_bulk_import_shares_one_time(spark, target, want):
    when = dt.datetime(2024, 1, 1)
    goals = spark.createDataFrame([(1, "g", Decimal(target))], "id long, name string, target_amount decimal(18,2)")
    rows = [(i, 1, Decimal(1), when) for i in range(1, 10_001)] + [(0, 1, Decimal(-1), when + dt.timedelta(minutes=1)), (20_000, 1, Decimal(5), when + dt.timedelta(days=1))]
    contributions = spark.createDataFrame(rows, "id long, goal_id long, amount decimal(18,2), created_at timestamp_ntz")
    state = GO.goal_state(goals, contributions).collect()[0]
    assert state["completing_contribution_id"] == want and state["current_amount"] == 10_004.0
