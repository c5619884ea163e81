"""Streaming ledger: final tables equal batch; late, repeated and failed messages."""
import datetime as dt
import os
import random
import shutil
import tempfile
import time

import duckdb
from pyspark.sql import functions as F

from conftest import SF001
from moderata.functions.classes import CLASSES
from moderata.operators import actions as A
from moderata.operators import ledger as L
from moderata.operators.flow import process
from moderata.sources import files as FI
from moderata.sources import schemas
from moderata.sources import tables as TB
from moderata.streaming import ledger_stream as ST


def _rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def _work():
    base = tempfile.mkdtemp(prefix="moderata-stream-", dir="/tmp")
    os.makedirs(f"{base}/in")
    return base


def _run(spark, base, **options):
    messages = TB.chat_from_events(ST.event_source(spark, f"{base}/in", max_files_per_trigger=1))
    ST.run_to_end(ST.start_all(messages, base, **options))


READ = {"users": ST.current_users, "last": ST.current_last_messages,
        **{n: (lambda spark, base, n=n: ST.appended(spark, base, n)) for n in ("history", "actions", "quarantine")}}


def test_stream_equals_batch_under_replays_and_restart(spark):
    base = _work()
    cfg = FI.load_persona_config()
    per = FI.personas(spark, cfg)
    for name in ("a", "b"):  # a full replay
        shutil.copy(f"{SF001}/events.parquet", f"{base}/in/{name}.parquet")
    options = dict(personas=per, pool_all=cfg["user"]["all"], replies=FI.reply_lists(cfg))
    _run(spark, base, **options)
    flow = process(TB.chat_from_events(TB.table(spark, SF001, "events")), TB.fixture_scores)
    want = {"users": _rows(L.ledger(flow.scored)), "last": _rows(L.last_message(flow.scored)),
            "history": _rows(L.history(flow.scored)),
            "actions": _rows(A.actions(flow.scored, flow.routed, per, cfg["user"]["all"], **FI.reply_lists(cfg))),
            "quarantine": _rows(flow.quarantine.select(*[f.name for f in schemas.MESSAGE.fields]))}
    assert all(want.values())  # every output has rows
    assert {a[0] for a in want["actions"]} >= {"apology", "react"}
    for name, get in READ.items():
        assert _rows(get(spark, base)) == want[name], name
    # restart from the checkpoint with one more copy of the same messages
    shutil.copy(f"{SF001}/events.parquet", f"{base}/in/c.parquet")
    _run(spark, base, **options)
    for name, get in READ.items():
        assert _rows(get(spark, base)) == want[name], name


def test_late_files_in_any_order_count(spark):
    """A file 60 days late counts like any other, whatever the order of the files."""
    tables = []
    for order in (0, 1):
        base = _work()
        parts = [f"SELECT * FROM '{SF001}/events.parquet'"] + [
            f"""SELECT event_id + {k}000000000 AS event_id, ts - INTERVAL {60 * k} DAY AS ts, user_id, event_type, value, props
                FROM '{SF001}/events.parquet'""" for k in (1, 2)]
        random.Random(order).shuffle(parts)
        for k, q in enumerate(parts):
            duckdb.sql(f"COPY ({q}) TO '{base}/in/{k}.parquet' (FORMAT PARQUET)")
            time.sleep(1.1)  # the file source orders files by modification time
        _run(spark, base, outputs=("users", "last"))
        tables.append((_rows(ST.current_users(spark, base)), _rows(ST.current_last_messages(spark, base))))
        flow = process(TB.chat_from_events(spark.read.parquet(f"{base}/in")), TB.fixture_scores)
        assert tables[-1][0] == _rows(L.ledger(flow.scored))
        assert tables[-1][1] == _rows(L.last_message(flow.scored))
    assert tables[0] == tables[1]


def _event_files(spark, base, parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schemas.EVENTS).coalesce(1).write.parquet(f"{base}/in/{k}")
        time.sleep(1.1)


T0 = dt.datetime(2024, 1, 1)


def _event(i, user=1, minutes=0, text="hello there"):
    return (i, T0 + dt.timedelta(minutes=minutes), user, "chat", 0.0, text)


def plain_scores(messages):
    """Scores by the text: every class 0.9 in a message with "bad", else 0.1."""
    for c in CLASSES:
        messages = messages.withColumn(c, F.when(F.col("text").contains("bad"), 0.9).otherwise(0.1))
    return messages


def _run_plain(spark, base, outputs, **options):
    messages = TB.messages_from_events(ST.event_source(spark, f"{base}/in", max_files_per_trigger=1))
    queries = ST.start_all(messages, base, outputs, scorer=plain_scores, **options)
    ST.run_to_end(queries)
    return queries


def test_state_holds_one_row_a_key_and_an_id(spark):
    """State size: one counter row per user, one value per key, one entry per seen id."""
    base = _work()
    _event_files(spark, base, [[_event(1), _event(2, user=2, text="bad"), _event(3, minutes=5, text="newest")],
                               [_event(1), _event(4, minutes=2, text="late"), _event(5, user=2, minutes=1, text="bad again")],
                               [_event(2, user=2, text="bad"), _event(3, minutes=5, text="newest")]])
    queries = _run_plain(spark, base, ("users", "last"))
    users = {(r.author): (r.incidents, r.total_seen, r.toxic) for r in ST.current_users(spark, base).collect()}
    assert users == {1: (0, 3, 0), 2: (2, 2, 2)}
    last = {r.author: (r.message_id, r.text) for r in ST.current_last_messages(spark, base).collect()}
    assert last == {1: (3, "newest"), 2: (5, "bad again")}
    rows = {name: [s["numRowsTotal"] for s in q.lastProgress["stateOperators"]] for name, q in queries.items()}
    assert sorted(rows["users"]) == [2, 5]  # counters, seen ids
    assert sorted(rows["last"]) == [2, 5]


def test_seen_ids_with_a_time_to_live(spark):
    """Within its time an id counts once, after it again."""
    base = _work()
    _event_files(spark, base, [[_event(1), _event(1), _event(2)], [_event(2)]])
    _run_plain(spark, base, ("users",), seen_ttl_ms=3_600_000)
    assert [(r.author, r.total_seen) for r in ST.current_users(spark, base).collect()] == [(1, 2)]
    base = _work()
    _event_files(spark, base, [[_event(1)]])
    _run_plain(spark, base, ("users",), seen_ttl_ms=1)
    spark.createDataFrame([_event(1)], schemas.EVENTS).coalesce(1).write.parquet(f"{base}/in/again")
    _run_plain(spark, base, ("users",), seen_ttl_ms=1)
    assert [(r.author, r.total_seen) for r in ST.current_users(spark, base).collect()] == [(1, 2)]


def test_changed_rows_reach_a_sink_of_the_callers(spark):
    base, seen = _work(), {}
    _event_files(spark, base, [[_event(1), _event(2, user=2)], [_event(3)]])

    def upsert(rows, batch_id):
        seen.update({r["author"]: (batch_id, r["total_seen"]) for r in rows.collect()})
    _run_plain(spark, base, ("users",), changes=upsert)
    assert seen == {1: (1, 2), 2: (0, 1)}


def test_appended_tables_before_the_first_batch(spark):
    assert ST.appended(spark, _work(), "history").count() == 0


def test_a_delivery_of_many_files_is_one_micro_batch(spark, tmp_path):
    """The stream queries commit their state once a delivery, not once a file."""
    from moderata.plans import catalog as C
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i % 7, "view", 1.0, f"text {i}") for i in range(400)]
    events = spark.createDataFrame(rows, schemas.EVENTS).repartition(6)
    events.write.parquet(f"{tmp_path}/events.parquet")
    base = C._run_stream(spark, str(tmp_path), "last")
    done = [x for x in os.listdir(f"{base}/last/checkpoint/sources/0") if x.isdigit()]
    assert len(done) <= 3, done
    flow = process(TB.chat_from_events(TB.table(spark, str(tmp_path), "events")), TB.fixture_scores)
    assert _rows(ST.current_last_messages(spark, base)) == _rows(L.last_message(flow.scored))
    # the latest message is a state of Spark's own aggregation: no Python call per key
    assert "stateStoreSave" in open(f"{base}/last/checkpoint/state/0/_metadata/metadata").read()
