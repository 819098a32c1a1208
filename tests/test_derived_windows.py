import duckdb

from __spark_entry__ import oracle_sql, queries


def test_a_fresh_weekly_reading_leaves_the_estimate_to_the_plan(spark, tmp_path):
    # Ids 0, 1, 12 and 24 are claude-code; error 1 reads the weekly window, a minute before the queries' now.
    rows = [(0, "2024-01-30 22:00:01", "view", 50_000.0), (12, "2024-01-28 09:00:00", "view", 70_000.0), (24, "2024-01-30 20:30:00", "click", 900.0),
        (1, "2024-01-30 23:59:00", "error", 50.0)]
    with duckdb.connect() as db:
        db.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
        db.executemany("insert into events values (?, ?, 7, ?, ?, '{\"k\": 3}')", rows)
        db.execute(f"copy events to '{tmp_path}/events.parquet'")
        for name in ("derived_windows_anti", "snapshot_windows"):
            have = sorted(map(tuple, queries()[name](spark, str(tmp_path)).collect()), key=repr)
            assert have == sorted(db.execute(oracle_sql()[name]).fetchall(), key=repr) and have, name
