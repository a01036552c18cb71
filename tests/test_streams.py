"""Streams over tables in which rows repeat, values lack, and appends are of many files."""

import duckdb
import pytest

from turnlake.plans import catalog, streams
from turnlake.streaming import live as V

FOLDER = "/root/testdata/sf0.01"


def repeated_events(copies, nulls):
    """A database with the given events repeated under new ids, some of them without a value."""
    found = duckdb.connect()
    value = "CASE WHEN event_id % 13 <> 0 THEN value END" if nulls else "value"
    found.execute(f"CREATE TABLE events AS SELECT event_id + k * 1000000 AS event_id, ts, user_id, event_type, {value} AS value, props FROM '{FOLDER}/events.parquet', range({copies}) t(k)")
    return found


@pytest.mark.parametrize("nulls", [False, True])
def test_ties_with_the_mean_as_in_sql(nulls):
    found = repeated_events(6, nulls)
    over = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 95 PRECEDING AND CURRENT ROW)"
    rows, want = {}, {}
    for user, value, speaking in found.execute(f"SELECT user_id, value, value > avg(value) OVER {over} FROM events ORDER BY user_id, ts, event_id").fetchall():
        rows.setdefault(user, []).append(value)
        want.setdefault(user, []).append(speaking)
    for user, values in rows.items():
        cut = len(values) // 3
        assert list(V.decisions([], values)) == want[user]
        assert list(V.decisions(values[:cut][-95:], values[cut:])) == want[user][cut:]


def test_referee_against_its_sql(spark, tmp_path):
    found = repeated_events(6, True)
    found.execute(f"COPY (SELECT * FROM events WHERE user_id % 5 = 0) TO '{tmp_path}/events.parquet'")
    found.execute(f"DROP TABLE events; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    key = lambda r: (r[0], r[1])
    want = found.execute(catalog.oracle_sql()["stream_referee"]).fetchall()
    assert sorted(map(tuple, streams.stream_referee(spark, str(tmp_path)).select("user_id", "event_id", "speaking").collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("parts", [1, 5])
def test_batches_dont_grow_with_the_files_of_an_append(spark, parts):
    rows = spark.read.parquet(f"{FOLDER}/events.parquet").select("user_id", "ts", "event_id").repartition(parts)
    stream, _ = streams._arriving(spark, rows)
    batches = []
    out = V.shared_path(spark, "sizes")
    stream.writeStream.option("checkpointLocation", out).trigger(availableNow=True).foreachBatch(lambda batch, k: batches.append(batch.count())).start().awaitTermination()
    assert sum(batches) == 10_001 and len(batches) == 3
