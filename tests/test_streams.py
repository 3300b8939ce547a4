"""Streams over a table of many files that are not in time order."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from ledgerlens.operators import shared
from ledgerlens.plans.oracles import ORACLES
from ledgerlens.plans.queries import QUERIES
from ledgerlens.streaming import streams


@pytest.mark.parametrize("name", ["stream_label_join", "stream_doubt_escalations", "stream_open_doubts", "stream_closed_scores"])
def test_many_files_out_of_order(spark, data, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{data}/events.parquet'")
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for i in range(30):  # the oldest file holds the latest events
        path = folder / f"{i:02}.parquet"
        con.execute(f"copy (select * exclude part from (select *, ntile(30) over (order by ts desc, event_id) as part from events) where part = {i + 1}) to '{path}' (format parquet)")
        os.utime(path, (1_700_000_000 + 60 * i,) * 2)
    got, want = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name])
    names = want.columns
    tables = [r.tableName for r in spark.sql("show tables").collect()]
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(want.fetchall())
    assert not any(t.startswith(("labels_", "doubts_")) for t in tables)  # nothing is held on the driver


def _write(con, select: str, path) -> None:
    con.execute(f"copy ({select}) to '{path}' (format parquet)")


def test_turns_and_doubts_go_on_after_a_restart(spark, data, tmp_path):
    """Half of the rows, a stop, the other half: the state is that of all rows; a reset in the second half restarts counts of the first."""
    con = duckdb.connect()
    for name in ("events", "conversations"):
        con.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
        (tmp_path / f"{name}.parquet").mkdir()
    halves = {"conversations": ["turn < 2", "turn >= 2"], "events": ["event_id < (select max(event_id) / 2 from events)", "event_id >= (select max(event_id) / 2 from events)"]}
    paths = {name: shared.shared_path(spark, name) for name in halves}
    for n in range(2):
        for name, parts in halves.items():
            _write(con, f"select * from {name} where {parts[n]}", tmp_path / f"{name}.parquet" / f"{n}.parquet")
        c = streams.read_stream(spark, str(tmp_path), "conversations", 1).selectExpr("conv_id as session_id", "turn", "role", "text")
        turns = streams.drain(streams.track_turns(c), "turns", "update", paths["conversations"], True)
        e = streams.read_events(spark, str(tmp_path), 1).filter("event_type in ('error', 'click', 'purchase')")
        e = e.selectExpr("if(user_id % 2 = 0, 'module', 'entry') as kind", "user_id as key", "if(event_type = 'purchase', 'escalated', 'doubt') as type", "event_id as seq", "ts as at")
        doubts = streams.drain(streams.track_doubts(e, watermark="1 hour"), "doubts", "update", paths["events"], True)
    got = Counter((int(r["session_id"]), r["turn_no"], r["replies"], r["chars"]) for r in streams.latest(turns, ["session_id"]).collect())
    assert got == Counter(con.sql(f"select session_id, turn_no, replies, chars from ({ORACLES['stream_turn_sessions']})").fetchall())
    got = Counter((r["kind"], int(r["key"]), r["open"], r["due"]) for r in streams.latest(doubts, ["kind", "key"]).collect())
    assert got == Counter(con.sql(f"select kind, key, open, due from ({ORACLES['stream_open_doubts']})").fetchall())


def test_closed_windows_leave_the_state_and_come_once(spark, tmp_path):
    """120 days in 24 batches: no more windows are held than 30 days and the watermark span, whatever the length of the stream."""
    con = duckdb.connect()
    for i in range(24):
        path = tmp_path / f"{i:02}.parquet"
        _write(con, f"select timestamp '2024-01-01' + to_hours(6 * (x + {i} * 20)::int) as at, x % 3 as entry_id, 1.0::double as weight from range(20) t(x)", path)
        os.utime(path, (1_700_000_000 + 60 * i,) * 2)
    rows = spark.readStream.schema("at timestamp_ntz, entry_id long, weight double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "*.parquet"))
    held, seen = [], Counter()

    def put(batch, number):
        seen.update((r["window_end"], r["entry_id"]) for r in batch.collect())

    q = streams.stream_scores(rows).writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", shared.shared_path(spark, "closed")).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [s.numRowsTotal for x in q.recentProgress for s in x.stateOperators]
    assert max(seen.values()) == 1 and len({end for end, _ in seen}) > 80
    assert max(held[len(held) // 2 :]) <= 3 * 40 and max(held) <= 3 * 40
