import random
from datetime import datetime, timedelta

import pytest

from brindle.streaming import stateful

BEGIN = datetime(2024, 5, 1)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    kept = spark.conf.get(name)
    spark.conf.set(name, stateful.ROCKSDB)
    yield
    spark.conf.set(name, kept)


def run(spark, tmp_path, build, schema, batches):
    """The rows of a stream that is stopped and started again from its checkpoint for each batch of input."""
    out = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = build(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).foreachBatch(lambda df, n: out.extend(df.collect())).start()
        query.awaitTermination()
    return out


def test_memory_of_conversations_over_restarts(spark, tmp_path, rocksdb):
    rng = random.Random(1)
    turns = []
    for c in range(6):
        at = BEGIN
        for t in range(25):
            at += timedelta(minutes=rng.choice([1, 5, 29, 30, 31, 90]))
            turns.append((c, t, at))
    turns.sort(key=lambda r: r[2])
    want, held = {}, {}
    for c, t, at in turns:
        before, memory = held.get(c, (at, []))
        memory = [] if at - before > timedelta(minutes=30) else memory
        held[c] = at, [*memory, t][-5:]
        want[c, t] = len(held[c][1]), ",".join(map(str, held[c][1]))
    third = len(turns) // 3
    rows = run(spark, tmp_path, stateful.conversation_memory, "conv_id bigint, turn bigint, ts timestamp", [turns[:third], turns[third : 2 * third], turns[2 * third :]])
    assert {(r.conv_id, r.turn): (r.held, r.recent) for r in rows} == want and len(rows) == len(want)


def test_stale_jobs_are_reclaimed_by_event_or_timer(spark, tmp_path, rocksdb):
    at = lambda m: BEGIN + timedelta(minutes=m)
    ms = lambda m: int((at(m) - datetime(1970, 1, 1)).total_seconds() * 1000)
    first = [(1, "pending", at(0)), (1, "running", at(1)), (2, "running", at(2)), (3, "running", at(3)), (3, "succeeded", at(33)), (4, "running", at(4))]
    second = [(1, "succeeded", at(40)), (4, "failed", at(34)), (9, "pending", at(41))]
    rows = run(spark, tmp_path, stateful.job_states, "job bigint, status string, at timestamp", [first, second, [(9, "running", at(300))], [(8, "pending", at(400))]])
    got = {}
    for r in rows:
        got.setdefault(r.job, []).append((r.ms, r.status, r.reclaimed))
    stale = lambda m: (ms(m) + 1_800_001, "pending", True)
    assert sorted(got[1]) == [(ms(0), "pending", False), (ms(1), "running", False), stale(1), (ms(40), "succeeded", False)]
    assert sorted(got[2]) == [(ms(2), "running", False), stale(2)]
    assert sorted(got[3]) == [(ms(3), "running", False), (ms(33), "succeeded", False)]
    assert sorted(got[4]) == [(ms(4), "running", False), (ms(34), "failed", False)]
    assert sorted(got[9]) == [(ms(41), "pending", False), (ms(300), "running", False), stale(300)]
