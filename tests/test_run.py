import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.lsn import successor, to_lsn
from tidemark.operators.merge import supersede
from tidemark.operators.run import CdcRetentionExpiredError, SchemaChangedError, batches, capture_batch, state_at_lsn
from tidemark.operators.views import latest_image
from tidemark.plans.schema import conform, event_schema, row_schema
from tidemark.plans.spec import ColumnChanges, ColumnSpec, TableSpec
from tidemark.plans.state import RunState
from tidemark.sources.frames import stamped
from tidemark.streaming.capture import StateLog, capture_stream, parquet_sink

ID, AMOUNT = ColumnSpec("sale_id", "int", 10, 0), ColumnSpec("amount", "int")
SPEC = TableSpec("dbo", "sales", ["sale_id"], [ID, AMOUNT], [ID, AMOUNT], "dbo_sales")
T0 = datetime(2026, 8, 13, 12, 30)


class Stub:
    """A source that records the calls it gets. events: (position, key, operation)."""

    def __init__(self, spark, keys=(1, 2, 3), events=(), positions=(100,), floor=1, spec=SPEC, lead="int"):
        self.spark, self.keys, self.events, self.positions, self.floor, self.spec, self.lead = spark, list(keys), list(events), list(positions), floor, spec, lead
        self.calls, self.ticks, self.during_read = [], 0, None

    def connect(self):
        return self

    def close(self):
        pass

    def inspect(self, schema, table):
        self.calls.append("inspect")
        return self.spec

    def get_max_lsn(self):
        self.calls.append("max")
        return to_lsn(self.positions.pop(0) if len(self.positions) > 1 else self.positions[0])

    def get_min_lsn(self, instance):
        self.calls.append("min")
        return to_lsn(self.floor)

    def increment_lsn(self, lsn):
        return successor(lsn)

    def watermark(self):
        self.calls.append("watermark")
        self.ticks += 1
        return T0 + timedelta(seconds=self.ticks)

    def await_watermark(self, mark):
        self.calls.append(("await", mark))

    def read_table(self, spec, start_pk=None, end_pk=None, limit=0, ordered=True):
        self.calls.append(("table", start_pk, limit))
        keys = sorted(k for k in self.keys if start_pk is None or k >= start_pk)[: limit or None]
        rows = self.spark.createDataFrame([(k, 1) for k in keys], f"sale_id {self.lead}, amount int").orderBy("sale_id")
        if self.during_read:
            self.during_read()
        return rows

    def read_event_log(self, spec, from_lsn, to_lsn_, ordered=True):
        self.calls.append(("log", int.from_bytes(from_lsn, "big"), int.from_bytes(to_lsn_, "big")))
        found = [(to_lsn(p), to_lsn(p), op, b"\0", T0, k, 99) for p, k, op in self.events if from_lsn <= to_lsn(p) <= to_lsn_]
        return self.spark.createDataFrame(found, event_schema(spec)) if found else None

    def to_events(self, rows, spec, commit_timestamp):
        return stamped(rows, spec, commit_timestamp)

    def read_pk_range(self, spec):
        return None


def state(**more):
    return RunState(**{"spec": SPEC, "last_lsn": to_lsn(10), "last_inspect": datetime.now(UTC)} | more)


def run(src, own=None, **more):
    return capture_batch(src, "dbo", "sales", own, **more)


def brief(frame):
    return [(r.operation, r.sale_id) for r in frame.collect()]


# --- guards, before anything is read ---


@pytest.mark.parametrize("size", [0, -1])
def test_chunk_size_is_checked_first(spark, size):
    src = Stub(spark)
    with pytest.raises(ValueError, match="chunk_size"):
        run(src, chunk_size=size)
    assert src.calls == []


def test_state_of_another_table(spark):
    src = Stub(spark)
    with pytest.raises(ValueError, match="the state is of dbo.sales"):
        capture_batch(src, "dbo", "other", state())
    assert src.calls == []


def test_table_without_capture(spark):
    src = Stub(spark, spec=TableSpec("dbo", "sales", ["sale_id"], [ID], [ID]))
    for call in (lambda: run(src), lambda: state_at_lsn(src, "dbo", "sales", to_lsn(1)), lambda: run(src, state(), inspect_every=timedelta(0))):
        with pytest.raises(ValueError, match="no capture instance"):
            call()


def test_retention(spark):
    src = Stub(spark, floor=11)
    for own in (state(), state(dump_done=True)):
        with pytest.raises(CdcRetentionExpiredError):
            run(src, own)
    assert src.calls == ["min", "min"]
    src.floor = 10
    assert run(src, state(dump_done=True)).frame is None
    with pytest.raises(CdcRetentionExpiredError):
        state_at_lsn(src, "dbo", "sales", to_lsn(9))


def test_position_in_the_future_is_fine(spark):
    src = Stub(spark, positions=[5])
    own = state_at_lsn(src, "dbo", "sales", to_lsn(50))
    result = run(src, own)
    assert result.frame is None and result.state == own and own.dump_done
    assert not any(c[0] == "log" for c in src.calls)


@pytest.mark.parametrize(
    ("fresh", "message"),
    [
        (TableSpec("dbo", "sales", ["amount"], [ID, AMOUNT], [ID, AMOUNT], "x"), r"and is \(amount\)"),
        (TableSpec("dbo", "sales", ["sale_id"], [ID, AMOUNT], [ID], "x"), "removed: amount"),
        (TableSpec("dbo", "sales", ["sale_id"], [ID, AMOUNT], [ID, ColumnSpec("amount", "bigint")], "x"), "retyped: amount"),
    ],
)
def test_schema_change_stops_the_run(spark, fresh, message):
    with pytest.raises(SchemaChangedError, match=message):
        run(Stub(spark, spec=fresh), state(), inspect_every=timedelta(0))


def test_source_only_change_is_adopted(spark, caplog):
    wider = TableSpec("dbo", "sales", ["sale_id"], [ID, AMOUNT, ColumnSpec("note", "varchar")], [ID, AMOUNT], "dbo_sales")
    src = Stub(spark, spec=wider)
    found = run(src, state(dump_done=True), inspect_every=timedelta(0)).state
    assert found.spec == wider and "added: note" in caplog.text


def test_inspection_is_only_repeated_when_due(spark):
    src = Stub(spark)
    old = state(dump_done=True, last_inspect=datetime.now(UTC) - timedelta(days=2))
    run(src, old, inspect_every=None)
    run(src, state(dump_done=True))
    assert "inspect" not in src.calls
    assert run(src, old).state.last_inspect > old.last_inspect and src.calls.count("inspect") == 1


def test_column_changes():
    a, b, c = (ColumnSpec(n, "int") for n in "abc")
    assert str(ColumnChanges.between([a, b], [b, c])) == "added: c; removed: a"
    assert str(ColumnChanges.between([a, b], [b, a])) == "in another order" and str(ColumnChanges.between([a], [ColumnSpec("a", "bigint")])) == "retyped: a"
    assert not ColumnChanges.between([a, b], [a, ColumnSpec("b", "INT", computed_definition="x")]) and str(ColumnChanges()) == "unchanged"


# --- seeding ---


def test_seed_opens_at_the_present_or_the_floor(spark, caplog):
    assert run(Stub(spark, positions=[50, 60])).state.last_lsn == to_lsn(61)
    src = Stub(spark, positions=[50], floor=70)
    assert run(src).state.last_lsn == to_lsn(70)
    assert "full dump" in caplog.text


# --- batches ---


def test_order_of_a_dump_batch(spark):
    src = Stub(spark, events=[(20, 2, 4)])
    result = run(src, state(), chunk_size=5)
    assert src.calls == ["min", "watermark", ("table", None, 6), "watermark", ("await", T0 + timedelta(seconds=2)), "max", ("log", 10, 100)]
    assert brief(result.frame) == [(4, 2), (0, 1), (0, 3)] and result.frame.schema == event_schema(SPEC)
    assert {r.commit_timestamp for r in result.frame.where("operation = 0").collect()} == {T0 + timedelta(seconds=1)}
    assert result.state.dump_done and result.state.chunk_key == 4 and result.state.last_lsn == to_lsn(101)


def test_tail_batch_reads_the_log_alone(spark):
    src = Stub(spark, events=[(20, 2, 4), (15, 7, 1)])
    result = run(src, state(dump_done=True))
    assert src.calls == ["min", "max", ("log", 10, 100)] and brief(result.frame) == [(1, 7), (4, 2)]


def test_window_advances_when_empty_and_stands_at_the_end(spark):
    src = Stub(spark)
    first = run(src, state(dump_done=True))
    assert first.frame is None and first.state.last_lsn == to_lsn(101)
    second = run(src, first.state)
    assert second.state == first.state and src.calls.count("max") == 2 and sum(c[0] == "log" for c in src.calls) == 1


def test_closed_window(spark):
    src = Stub(spark, events=[(10, 1, 2), (100, 2, 2), (101, 3, 2)])
    assert brief(run(src, state(dump_done=True)).frame) == [(2, 1), (2, 2)]


def test_pages_by_rows_with_gaps(spark):
    src = Stub(spark, keys=[5, 1000, 10**6, 7, 2_000_000])
    own, seen = state(), []
    while not own.dump_done:
        result = run(src, own, chunk_size=2)
        own = result.state
        seen.append([r.sale_id for r in result.frame.collect()])
    assert seen == [[5, 7], [1000, 10**6], [2_000_000]] and own.chunk_key == 2_000_001


def test_exact_multiple_costs_an_empty_page(spark):
    src = Stub(spark, keys=[1, 2], events=[(20, 9, 4)], positions=[15, 30])
    first = run(src, state(), chunk_size=2)
    assert not first.state.dump_done and first.state.chunk_key == 3
    second = run(src, first.state, chunk_size=2)
    assert second.state.dump_done and second.state.chunk_key == 3 and brief(second.frame) == [(4, 9)]


def test_empty_table_drains_the_log(spark):
    assert run(Stub(spark, keys=[]), state()).frame is None
    assert brief(run(Stub(spark, keys=[], events=[(20, 1, 2)]), state()).frame) == [(2, 1)]


def test_size_may_change_between_calls(spark):
    src = Stub(spark, keys=range(1, 8))
    own = run(src, state(), chunk_size=2).state
    result = run(src, own, chunk_size=100)
    assert result.state.dump_done and [k for _, k in brief(result.frame)] == [3, 4, 5, 6, 7]


def test_wholly_superseded_page(spark):
    src = Stub(spark, keys=[1, 2], events=[(20, 1, 4), (21, 2, 1), (22, 2, 2)])
    assert brief(run(src, state()).frame) == [(4, 1), (1, 2), (2, 2)]


def test_repeated_leading_key_is_refused_inside_and_across_a_page(spark):
    with pytest.raises(ValueError, match="not unique within a chunk"):
        run(Stub(spark, keys=[1, 1, 2]), state())
    with pytest.raises(ValueError, match="not unique within a chunk"):
        run(Stub(spark, keys=[1, 1, 2]), state(), chunk_size=1)


def test_leading_key_must_be_an_integer(spark):
    for keys, kind in ((["a", "b"], "string"), ([True], "boolean")):
        with pytest.raises(TypeError, match="must be an integer"):
            run(Stub(spark, keys=keys, lead=kind), state())


def test_old_state_reads_the_same_batch(spark):
    src = Stub(spark, events=[(20, 2, 4)])
    own = state()
    first = run(src, own)
    src.ticks = 0  # the clock dates dump rows
    second = run(src, own)
    assert first.frame.collect() == second.frame.collect() and first.state == second.state


def test_handoff_neither_repeats_nor_skips(spark):
    src = Stub(spark, events=[(20, 2, 4), (101, 3, 4), (150, 1, 1)], positions=[100, 160])
    found = list(batches(src, "dbo", "sales", state()))
    assert [brief(r.frame) for r in found] == [[(4, 2), (0, 1), (0, 3)], [(4, 3), (1, 1)]]


def test_replay_beside_a_dump(spark):
    src = Stub(spark, events=[(5, 3, 4), (50, 9, 2)])
    own = state_at_lsn(src, "dbo", "sales", to_lsn(5), dump_done=False)
    assert brief(run(src, own).frame) == [(4, 3), (2, 9), (0, 1), (0, 2)]


def test_page_is_pinned_between_the_watermarks(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([(1, 1), (2, 1)], "sale_id int, amount int").write.parquet(path)
    src = Stub(spark)
    src.read_table = lambda spec, start_pk=None, end_pk=None, limit=0, ordered=True: spark.read.parquet(path).orderBy("sale_id")

    def late(mark):  # after the page was read, before the frame is used
        spark.createDataFrame([(1, 777)], "sale_id int, amount int").write.mode("overwrite").parquet(path)

    src.await_watermark = late
    frame = run(src, state()).frame
    assert [(r.sale_id, r.amount) for r in frame.collect()] == [(1, 1), (2, 1)]


# --- superseding ---


def test_supersede_by_the_whole_key(spark):
    spec = TableSpec("s", "t", ["a", "b"], [ColumnSpec("a", "int"), ColumnSpec("b", "int")], [ColumnSpec("a", "int"), ColumnSpec("b", "int")], "x")
    chunk = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a int, b int")
    window = spark.createDataFrame([(1, 2), (1, 2), (2, 9)], "a int, b int")
    assert sorted(tuple(r) for r in supersede(chunk, window, spec).collect()) == [(1, 1), (2, 1)]
    assert supersede(chunk, None, spec) is chunk and supersede(chunk, window.where("a = 2"), spec).count() == 3


# --- the whole: random writes during a dump, then the latest images are the table ---


@pytest.mark.parametrize("seed", range(2))
def test_latest_images_are_the_table(spark, seed):
    rng = random.Random(seed)
    table, log = {k: 0 for k in range(0, 40, 2)}, []
    src = Stub(spark)

    def write():
        for _ in range(rng.randint(0, 3)):
            key = rng.randrange(45)
            op = 1 if key in table and rng.random() < 0.4 else 4 if key in table else 2
            value = len(log) + 1
            log.append((100 + len(log), key, op, value))
            table.pop(key) if op == 1 else table.__setitem__(key, value)

    def read_table(spec, start_pk=None, end_pk=None, limit=0, ordered=True):
        write()
        keys = sorted(k for k in table if start_pk is None or k >= start_pk)[:limit]
        rows = spark.createDataFrame([(k, table[k]) for k in keys], row_schema(SPEC))
        write()
        return rows

    def read_event_log(spec, low, high, ordered=True):
        found = [(to_lsn(p), to_lsn(p), op, b"\0", T0, k, v) for p, k, op, v in log if low <= to_lsn(p) <= high]
        return conform(spark.createDataFrame(found, event_schema(spec)), event_schema(spec), "log") if found else None

    src.read_table, src.read_event_log, src.get_max_lsn = read_table, read_event_log, lambda: to_lsn(99 + len(log))
    frames = [r.frame for r in batches(src, "dbo", "sales", chunk_size=6)]
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionAll(f)
    assert {r.sale_id: r.amount for r in latest_image(whole, ["sale_id"]).collect()} == table


def test_latest_image_by_epoch(spark):
    rows = [(to_lsn(50), to_lsn(1), 4, b"", T0, 1, 5, 0), (to_lsn(0), to_lsn(0), 0, b"", T0, 1, 9, 1)]
    events = spark.createDataFrame(rows, event_schema(SPEC).add("epoch", "integer"))
    assert latest_image(events, ["sale_id"]).first().amount == 5 and latest_image(events, ["sale_id"], "epoch").first().amount == 9


# --- streaming ---


def test_stream_repeats_a_batch_with_the_same_rows(spark, tmp_path):
    src = Stub(spark, keys=range(1, 6), events=[(20, 2, 4)])
    states = StateLog(spark, str(tmp_path / "states"))
    spark.range(1).write.parquet(str(tmp_path / "in"))
    writer = capture_stream(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), src, "dbo", "sales", parquet_sink(str(tmp_path / "out")), states, state(), chunk_size=3)
    writer.option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    first = sorted(brief(spark.read.parquet(str(tmp_path / "out"))))
    assert first == [(0, 1), (0, 3), (4, 2)] and states.read(0).chunk_key == 4
    writer.option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(brief(spark.read.parquet(str(tmp_path / "out")))) == first
    assert states.read(1) is None


def test_frames_are_columns_of_the_event_schema(spark):
    frame = run(Stub(spark), state()).frame
    assert frame.select(F.col("start_lsn")).first()[0] == bytes(10) and frame.columns[:5] == ["start_lsn", "seqval", "operation", "update_mask", "commit_timestamp"]


def test_stream_without_the_state_before_stops(spark, tmp_path):
    src = Stub(spark, keys=range(1, 9))
    states = StateLog(spark, str(tmp_path / "states"))
    triggers = str(tmp_path / "in")

    def turn():
        spark.range(1).coalesce(1).write.mode("append").parquet(triggers)
        trigger = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(triggers)
        writer = capture_stream(trigger, src, "dbo", "sales", parquet_sink(str(tmp_path / "out")), states, chunk_size=2)
        writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    turn()
    (tmp_path / "states" / "state-0").rename(tmp_path / "gone")
    with pytest.raises(Exception, match="is missing"):
        turn()
    (tmp_path / "gone").rename(tmp_path / "states" / "state-0")
    turn()
    assert sorted(brief(spark.read.parquet(str(tmp_path / "out")))) [:4] == [(0, 1), (0, 2), (0, 3), (0, 4)]


def test_a_window_ends_where_it_was_first_said(spark, tmp_path):
    states = StateLog(spark, str(tmp_path / "states"))
    assert states.bound(3, to_lsn(50)) == to_lsn(50) and states.bound(3, to_lsn(90)) == to_lsn(50)
    src = Stub(spark, events=[(20, 2, 4), (60, 3, 4)], positions=[70])
    found = run(src, state(dump_done=True), bound=lambda high: states.bound(3, high))
    assert brief(found.frame) == [(4, 2)] and found.state.last_lsn == to_lsn(51)


def test_release_of_a_batch(spark):
    import os

    result = run(Stub(spark, events=[(20, 2, 4)]), state())
    folders = [p.removeprefix("file:") for p in result.pins]
    assert folders and all(map(os.path.exists, folders)) and result.frame.count() == 3
    result.release()
    assert not any(map(os.path.exists, folders))
    src = Stub(spark)
    src.read_event_log = lambda *a, **k: 1 / 0
    before = set(os.listdir(os.path.dirname(folders[0])))
    with pytest.raises(ZeroDivisionError):
        run(src, state())
    assert set(os.listdir(os.path.dirname(folders[0]))) == before
