import datetime

import pytest
from pyspark.sql import functions as F

from textloom.streaming import events, state

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def rows(spark, *events_):
    t0 = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, t0 + datetime.timedelta(minutes=m), 1, kind, value) for k, m, kind, value in events_], SCHEMA)


def test_figures_go_on_from_the_checkpoint(spark, tmp_path):
    parts = [
        rows(spark, *((k, k, "hot", float(k)) for k in range(50)), (60, 1, "b", None), (61, 1, None, 5.0)),
        rows(spark, (100, 2, "hot", -3.0), (101, 2, "b", 2.0)), rows(spark), rows(spark, (200, 3, "b", 4.0)),
    ]
    found = state.replayed(spark, parts, str(tmp_path), lambda s: state.figures(s, "event_type", "value", "event_id"), SCHEMA)
    got = {r["key"]: r for r in state.summed(found).collect()}
    assert set(got) == {"hot", "b"}
    hot = [*map(float, range(50)), -3.0]
    assert (got["hot"]["n"], got["hot"]["total"], got["hot"]["least"], got["hot"]["most"]) == (51, sum(hot), -3.0, 49.0)
    assert got["hot"]["mean"] == pytest.approx(sum(hot) / 51)
    assert (got["b"]["n"], got["b"]["total"], got["b"]["deviation"]) == (2, 6.0, 1.0)
    of_b = state.end_state(found, "key", "salt").filter("key = 'b'").agg(F.sum("batches"), F.sum("means")).first()
    assert tuple(of_b) == (2, 6.0)  # two batches held one value each


def test_a_batch_that_runs_again_replaces_what_it_wrote(spark, tmp_path):
    parts = [rows(spark, (1, 0, "a", 1.0)), rows(spark, (2, 1, "a", 2.0))]
    state.replayed(spark, parts, str(tmp_path), lambda s: state.figures(s, "event_type", "value", "event_id"), SCHEMA)
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()  # as if the driver was lost before it had noted the last batch
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    result = state.figures(stream, "event_type", "value", "event_id")
    state.run_until_read(result, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    total = state.summed(state.batches_of(spark, str(tmp_path / "out"), result.schema)).first()
    assert (total["n"], total["total"]) == (2, 3.0)


def test_late_rows_reach_open_hours_alone(spark, tmp_path):
    parts = [rows(spark, (1, 10, "a", 1.0), (2, 200, "a", 2.0)), rows(spark, (3, 20, "a", 8.0), (4, 150, "a", 16.0), (5, 230, "a", 32.0))]
    found = state.replayed(spark, parts, str(tmp_path), lambda s: events.hourly(s, "1 hour"), SCHEMA)
    got = {r["start"].hour: (r["n"], r["total"]) for r in state.end_state(found, "start", "event_type").collect()}
    # The mark is 140 minutes after the first part: minute 20's hour is closed, minute 150's is not.
    assert got == {0: (1, 1.0), 2: (1, 16.0), 3: (2, 34.0)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
