from datetime import datetime

import pytest

from tidemark.functions.lsn import to_lsn
from tidemark.plans.spec import ColumnSpec, TableSpec
from tidemark.sources import frames
from tidemark.sources.base import build_source, check_floor, identifier
from tidemark.sources.frames import CapturedTable, FrameSource, page_end
from tidemark.sources.jdbc import JdbcSource, column_text, event_query, key_predicates, key_range_query, table_query, window_predicates

COLUMNS = [ColumnSpec("tenant_id", "int"), ColumnSpec("item_id", "int"), ColumnSpec("label", "nvarchar", 0, 0, "x")]
SPEC = TableSpec("dbo", "pages", ["tenant_id", "item_id"], COLUMNS, COLUMNS, "dbo_pages")


# --- text for servers ---


def test_page_text():
    assert table_query(SPEC) == "SELECT [tenant_id], [item_id], CAST(NULL AS nvarchar(max)) AS [label] FROM [dbo].[pages] ORDER BY [tenant_id], [item_id]"
    assert table_query(SPEC, 3, 9, 5).endswith("WHERE [tenant_id] >= 3 AND [tenant_id] < 9 ORDER BY [tenant_id], [item_id] OFFSET 0 ROWS FETCH NEXT 5 ROWS ONLY")
    assert table_query(SPEC, limit=5, pagination="top").startswith("SELECT TOP (5) [tenant_id]")
    assert "WHERE [tenant_id] < 9 ORDER" in table_query(SPEC, end_pk=9)


def test_event_and_range_text():
    assert event_query(SPEC, to_lsn(1), to_lsn(2)).endswith("FROM cdc.fn_cdc_get_all_changes_dbo_pages(0x00000000000000000001, 0x00000000000000000002, N'all')")
    assert key_range_query(SPEC) == "SELECT MIN([tenant_id]) AS [low], MAX([tenant_id]) AS [high] FROM [dbo].[pages]"


@pytest.mark.parametrize("args", [{"limit": -1}, {"start_pk": 5, "end_pk": 5}, {"start_pk": 6, "end_pk": 5}])
def test_page_arguments(args):
    with pytest.raises(ValueError):
        table_query(SPEC, **args)


@pytest.mark.parametrize("name", ["", "a b", "a;b", "x]", "é"])
def test_identifiers(name):
    with pytest.raises(ValueError, match="Invalid column name"):
        identifier(name, "column")


def test_specs_that_cannot_be_read():
    with pytest.raises(ValueError, match="no key"):
        table_query(TableSpec("s", "t", [], COLUMNS, COLUMNS))
    with pytest.raises(ValueError, match="no columns"):
        table_query(TableSpec("s", "t", ["a"], COLUMNS, []))
    with pytest.raises(ValueError, match="no capture instance"):
        event_query(TableSpec("s", "t", ["tenant_id"], COLUMNS, COLUMNS), to_lsn(1), to_lsn(2))


def test_options(spark):
    with pytest.raises(ValueError, match="pagination"):
        JdbcSource(spark, "jdbc:x", pagination="skip")
    own = build_source("mssql", spark, "jdbc:x", user="u", encrypt="no")
    assert own.options["encrypt"] == "false" and (own.timeout, own.poll, own.pagination) == (120.0, 1.0, "fetch")
    with own as entered:
        assert entered.connected
    assert not own.connected
    own.close()


def test_source_kinds():
    with pytest.raises(NotImplementedError):
        build_source("postgres")
    with pytest.raises(ValueError, match="unknown source kind"):
        build_source("oracle")


@pytest.mark.parametrize("floor", [None, b"", bytes(10)])
def test_floor(floor):
    with pytest.raises(ValueError):
        check_floor(floor, "x")


# --- frames ---


@pytest.fixture(scope="module")
def src(spark):
    rows = spark.createDataFrame([(t, i, f"t{t}i{i}") for t in (1, 2) for i in range(5, 0, -1)], "tenant_id int, item_id int, label string")
    log = spark.createDataFrame(
        [(to_lsn(n), to_lsn(s), op, b"\x01", datetime(2026, 1, 1, 0, 0, n % 60), 1, n, "new") for n, s, op in ((1, 1, 2), (2, 2, 3), (2, 3, 4), (300, 1, 1))],
        "`__$start_lsn` binary, `__$seqval` binary, `__$operation` int, `__$update_mask` binary, commit_timestamp timestamp_ntz, tenant_id int, item_id int, label string",
    )
    empty = spark.createDataFrame([], "code string")
    tables = {
        "dbo.pages": CapturedTable(rows, ["tenant_id", "item_id"], log, "dbo_pages"),
        "dbo.plain": CapturedTable(rows, ["tenant_id"]),
        "dbo.codes": CapturedTable(empty, ["code"]),
        "dbo.nokey": CapturedTable(rows, []),
        "dbo.none": CapturedTable(rows.limit(0), ["tenant_id"]),
        "dbo.drift": CapturedTable(rows.drop("label"), ["tenant_id"], log, "dbo_drift"),
    }
    return FrameSource(spark, tables, watermark_timeout=0.05, watermark_poll=0.01)


def test_inspect(src):
    found = src.inspect("dbo", "pages")
    assert found.pk_columns == ("tenant_id", "item_id") and found.business_columns == ("tenant_id", "item_id", "label") and found.capture_instance == "dbo_pages"
    assert src.inspect("dbo", "plain").capture_instance is None
    for table in ("nokey", "missing"):
        with pytest.raises(ValueError, match="does not have primary key"):
            src.inspect("dbo", table)
    with pytest.raises(ValueError, match="no longer in"):
        src.inspect("dbo", "drift")


def test_pages(src):
    spec = src.inspect("dbo", "pages")
    keys = lambda df: [(r.tenant_id, r.item_id) for r in df.collect()]
    assert keys(src.read_table(spec)) == [(t, i) for t in (1, 2) for i in range(1, 6)]
    assert keys(src.read_table(spec, limit=3)) == [(1, 1), (1, 2), (1, 3)]
    assert keys(src.read_table(spec, start_pk=1, end_pk=2)) == [(1, i) for i in range(1, 6)]
    none = src.read_table(spec, start_pk=9)
    assert none.collect() == [] and none.columns == ["tenant_id", "item_id", "label"]


def test_key_range(src):
    assert src.read_pk_range(src.inspect("dbo", "pages")) == (1, 2)
    assert src.read_pk_range(src.inspect("dbo", "none")) is None
    with pytest.raises(ValueError, match="not an integer"):
        src.read_pk_range(src.inspect("dbo", "codes"))


def test_log(src):
    spec = src.inspect("dbo", "pages")
    events = src.read_event_log(spec, to_lsn(1), to_lsn(2))
    assert [(int.from_bytes(r.start_lsn, "big"), r.operation) for r in events.collect()] == [(1, 2), (2, 4)]
    assert src.read_event_log(spec, to_lsn(3), to_lsn(299)) is None
    assert src.read_event_log(spec, to_lsn(300), to_lsn(300)).count() == 1
    assert src.get_max_lsn() == to_lsn(300) and src.get_min_lsn("dbo_pages") == to_lsn(1)


def test_stamping(src):
    spec = src.inspect("dbo", "pages")
    rows = src.to_events(src.read_table(spec, limit=2), spec, None).collect()
    assert [(bytes(r.start_lsn), bytes(r.seqval), r.operation, bytes(r.update_mask), r.commit_timestamp) for r in rows] == [(bytes(10), bytes(10), 0, b"\0", None)] * 2
    at = datetime(2026, 1, 2, 3, 4, 5, 678901)
    assert src.to_events(src.read_table(spec, limit=1), spec, at).first().commit_timestamp == at
    assert src.to_events(src.read_table(spec, start_pk=9), spec, at).count() == 0


def test_barrier(src, spark):
    mark = datetime(2026, 1, 1, 0, 0, 5)
    src.sessions = spark.createDataFrame([(1, datetime(2026, 1, 1), datetime(2026, 1, 1, 0, 0, 9), 0)], "session_id int, start_time timestamp_ntz, end_time timestamp_ntz, empty_scan_count int")
    with pytest.raises(TimeoutError):
        src.await_watermark(mark)
    src.sessions = None
    src.await_watermark(mark)


def test_page_end(spark):
    keys = spark.createDataFrame([(k,) for k in [-(1 << 62), -5, 0, 0, 3, 1 << 40, (1 << 62)]], "k long")
    assert [page_end(keys, "k", n) for n in (1, 3, 4, 7, 8)] == [(-(1 << 62), 1), (0, 1), (0, 2), (1 << 62, 1), None]


def test_large_pages_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(frames, "SORTED_PAGE", 2)
    rows = spark.range(0, 100, 7).select("id")
    columns = [ColumnSpec("id", "bigint")]
    spec = TableSpec("s", "t", ["id"], columns, columns)
    assert [r.id for r in frames.page(rows, spec, 10, None, 5).collect()] == [14, 21, 28, 35, 42]
    assert [r.id for r in frames.page(rows, spec, 80, None, 5).collect()] == [84, 91, 98]
    both = [ColumnSpec("a", "bigint"), ColumnSpec("b", "bigint")]
    pairs = spark.range(60).selectExpr("id div 20 AS a", "id % 20 AS b")
    for n in (3, 20, 33, 60, 99):  # the leading key repeats
        found = frames.page(pairs, TableSpec("s", "t", ["a", "b"], both, both), None, None, n).collect()
        assert [tuple(r) for r in found] == [(i // 20, i % 20) for i in range(min(n, 60))]


def test_a_limit_is_kept_where_the_leading_key_repeats(spark):
    both = [ColumnSpec("a", "bigint"), ColumnSpec("b", "bigint")]
    pairs = spark.range(250_000).selectExpr("id div 2 AS a", "id AS b")
    spec = TableSpec("s", "t", ["a", "b"], both, both)
    for n in (100_000, 100_001):
        assert frames.page(pairs, spec, None, None, n).count() == n


def test_large_pages_of_a_source_share_one_count_of_keys(spark, monkeypatch):
    monkeypatch.setattr(frames, "SORTED_PAGE", 2)
    monkeypatch.setattr(frames, "BINS", 4)
    held = {"rows": spark.range(0, 200, 3).select("id")}
    table = CapturedTable(held["rows"], ["id"])
    src = FrameSource(spark, {"s.t": table})
    spec = src.inspect("s", "t")
    read = lambda start, n, end=None: [r.id for r in src.read_table(spec, start, end, n).collect()]
    assert read(None, 5) == [0, 3, 6, 9, 12] and read(13, 60) == list(range(15, 195, 3)) and read(150, 30) == list(range(150, 200, 3)) and read(10, 9, 20) == [12, 15, 18]
    table.rows = table.rows.where("id < 40 OR id > 180")  # rows have gone since the count
    assert read(30, 10) == [30, 33, 36, 39, 183, 186, 189, 192, 195, 198]


def test_text_of_types():
    of = lambda *a, **k: column_text(ColumnSpec("c", *a), **k)
    assert of("int") == "[c]" and of("date", computed=True) == "CAST(NULL AS date) AS [c]" and of("decimal", 10, 2, computed=True) == "CAST(NULL AS decimal(10,2)) AS [c]"
    assert of("bit", computed=True) == "CAST(NULL AS bit) AS [c]" and of("image", computed=True) == "CAST(NULL AS varbinary(max)) AS [c]" and of("datetime2", 0, 3, computed=True) == "CAST(NULL AS datetime2(3)) AS [c]"
    assert of("time", 0, 7).startswith("DATEDIFF_BIG(NANOSECOND") and of("time", 0, 7, computed=True) == "CAST(NULL AS bigint) AS [c]"
    assert of("datetime2", 0, 6) == "[c]" and "% 1000 <> 0" in of("datetime2", 0, 7)


def test_reading_in_parts(spark):
    assert key_predicates(SPEC, 1, 10, 3) == ["[tenant_id] >= 1 AND [tenant_id] < 5", "[tenant_id] >= 5 AND [tenant_id] < 9", "[tenant_id] >= 9 AND [tenant_id] < 11"]
    assert window_predicates(to_lsn(1), to_lsn(3), 2) == [f"[start_lsn] >= 0x{a:020x} AND [start_lsn] <= 0x{b:020x}" for a, b in ((1, 2), (3, 3))]
    own = JdbcSource(spark, "jdbc:x", partitions=2)
    own.read_pk_range = lambda spec: (1, 9)
    assert own._key_ranges(SPEC, None, None) == ["[tenant_id] < 6", "[tenant_id] >= 6"] and own._key_ranges(SPEC, 20, None) == []
    with pytest.raises(ValueError, match="partitions"):
        JdbcSource(spark, "jdbc:x", partitions=0)
