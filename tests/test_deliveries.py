"""Deliveries in pieces, failed ones, several at once, and batches that run again."""

from datetime import datetime
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kontor.plans import streams
from kontor.streaming import deliveries as d
from kontor.streaming.listings import stream_listings

LISTING = "source_product_id string, content_hash string, price decimal(20,6), stock_status string, stock_qty int"
TABLE = f"supplier_id int, {LISTING}, disappeared_at timestamp"
ARRIVING = f"supplier_id int, run_id int, kind string, at timestamp, {LISTING}"


def row(supplier, run, hour, product, price, qty=1):
    return (supplier, run, d.ROW, datetime(2024, 1, 1, hour), product, f"{price}/{qty}", Decimal(price), "IN_STOCK", qty)


def mark(supplier, run, hour, kind=d.END, day=1):
    return (supplier, run, kind, datetime(2024, 1, day, hour), None, None, None, None, None)


TICK = [mark(None, None, 0, d.TICK, 9)]
FIRST = [row(1, 1, 1, "a", 10), row(1, 1, 1, "b", 20), row(1, 1, 2, "c", 30), row(1, 1, 2, "d", 40), row(2, 1, 1, "a", 5)]
ENDS = [mark(1, 1, 3), mark(2, 1, 3)]


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Tables of some rows: two partitions of state are enough."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def deliver(spark, tmp_path):
    """Loads of rows arrive one after another; what the table is in the end."""

    def run(loads, name="x", sink=None):
        source, sink = f"{tmp_path}/{name}/in", sink or d.Sink(f"{tmp_path}/{name}/table", TABLE)
        for load in loads:
            spark.createDataFrame(load, ARRIVING).coalesce(1).write.mode("append").parquet(source)
            query = d.stream_deliveries(stream_listings(spark, source, ARRIVING), sink, f"{tmp_path}/{name}/state", "at", "6 hours", shards=3)
            query.awaitTermination()
            assert query.exception() is None
        return sink

    return run


def shown(spark, sink):
    listings = {(r.supplier_id, r.source_product_id): (int(r.price), r.stock_status, r.disappeared_at) for r in sink.read(spark).collect()}
    prices = sorted((r.supplier_id, r.source_product_id, int(r.price), r.observed_at) for r in sink.read(spark, "prices").collect())
    stocks = sorted((r.supplier_id, r.source_product_id, r.stock_status, r.stock_qty) for r in sink.read(spark, "stocks").collect())
    return listings, prices, stocks


SECOND = [row(1, 2, 5, "a", 11), row(1, 2, 5, "b", 20), mark(1, 2, 6)]


def test_four_files_give_what_one_gives(spark, deliver):
    whole = shown(spark, deliver([FIRST + ENDS, SECOND + TICK], "one"))
    pieces = shown(spark, deliver([FIRST[:1], FIRST[1:2] + ENDS, FIRST[2:] + SECOND[2:], SECOND[:2] + TICK], "many"))
    assert whole == pieces
    listings, prices, stocks = whole
    end = datetime(2024, 1, 1, 6)
    assert listings == {
        (1, "a"): (11, "IN_STOCK", None), (1, "b"): (20, "IN_STOCK", None), (1, "c"): (30, "OUT_OF_STOCK", end), (1, "d"): (40, "OUT_OF_STOCK", end), (2, "a"): (5, "IN_STOCK", None),
    }
    assert [p[:3] for p in prices] == [(1, "a", 10), (1, "a", 11), (1, "b", 20), (1, "c", 30), (1, "d", 40), (2, "a", 5)] and len(stocks) == 5
    assert prices[1][3] == end


def test_failed_and_silent_runs_mark_nothing(spark, deliver):
    failed = [row(1, 2, 5, "a", 99), mark(1, 2, 6, d.FAILED)]
    silent = [row(2, 2, 5, "z", 99)]
    later = [row(1, 3, 8, "a", 12), row(1, 3, 8, "b", 20), row(1, 3, 8, "c", 30), row(1, 3, 8, "d", 40), mark(1, 3, 9)]
    listings, prices, _ = shown(spark, deliver([FIRST + ENDS, failed + silent, later + TICK, [mark(None, None, 0, d.TICK, 20)]]))
    assert {k: v[0] for k, v in listings.items()} == {(1, "a"): 12, (1, "b"): 20, (1, "c"): 30, (1, "d"): 40, (2, "a"): 5}
    assert all(v[2] is None for v in listings.values()) and not [p for p in prices if p[2] == 99]


def test_a_run_that_is_not_over_waits(spark, deliver):
    listings, prices, stocks = shown(spark, deliver([FIRST + ENDS[:1], [mark(None, None, 12, d.TICK)]]))
    assert {k[0] for k in listings} == {1} and len(prices) == 4 == len(stocks)


class Crash(Exception):
    pass


def released(spark, runs):
    """Rows as ``whole_deliveries`` hands them on: the rows of (run, hour of its end)."""
    rows = [(r[0], r[1], datetime(2024, 1, 1, end), *r[4:]) for run, end in runs for r in run]
    return spark.createDataFrame(rows, f"supplier_id int, run_id int, ended timestamp, {LISTING}")


@pytest.fixture(scope="module")
def batches(spark, few_partitions):
    third = [row(1, 3, 8, "c", 31), row(1, 3, 8, "a", 11)]
    return [released(spark, [(FIRST, 3)]), released(spark, [(SECOND[:2], 6), (third, 9)])]


@pytest.fixture(scope="module")
def want(spark, batches, tmp_path_factory):
    sink = d.Sink(str(tmp_path_factory.mktemp("want")), TABLE)
    sink.create(spark)
    for number, batch in enumerate(batches):
        sink.apply(batch, number, "s")
    return shown(spark, sink)


def test_runs_of_one_batch_follow_each_other(want):
    listings, prices, _ = want
    end = datetime(2024, 1, 1, 9)
    assert listings[1, "c"] == (31, "IN_STOCK", None) and listings[1, "b"] == (20, "OUT_OF_STOCK", end) and listings[1, "d"][2] == datetime(2024, 1, 1, 6)
    assert [(p[1], p[2]) for p in prices if p[3].hour > 3] == [("a", 11), ("c", 31)]


@pytest.mark.parametrize("where", ["staging", "staged", "listings", "prices", "stocks", "applied"])
def test_a_crash_anywhere_is_made_good(spark, batches, want, where, monkeypatch, tmp_path):
    crashed = []
    replace, note, stage = d.Sink._replace, d.Sink._note, d.Sink.stage

    def once(name, number=1):
        if where == name and number == 1 and not crashed:
            crashed.append(name)
            raise Crash

    def replacing(self, df, name):
        replace(self, df, name)
        once(name, 1 if name != "ledger" and df.select("supplier_id").distinct().count() == 1 else 0)

    def noting(self, spark, stream, number, step):
        once(step, number)
        note(self, spark, stream, number, step)

    def staging(self, batch, staged):
        whole = stage(self, batch, staged)
        once("staging", int(staged[-1]))
        return whole

    for name, f in (("_replace", replacing), ("_note", noting), ("stage", staging)):
        monkeypatch.setattr(d.Sink, name, f)
    sink = d.Sink(f"{tmp_path}/got", TABLE)
    sink.create(spark)
    for number, batch in enumerate(batches):
        try:
            sink.apply(batch, number, "s")
        except Crash:
            assert number == 1
            sink.apply(batch, number, "s")
        sink.apply(batch, number, "s")  # and once more
    assert crashed == [where] and shown(spark, sink) == want
    assert sink.steps(spark, "s", 1) == {"staged", "applied"} and sink.steps(spark, "s", 2) == set()


def test_streams_do_not_share_batch_numbers(spark, deliver, tmp_path):
    sink = deliver([FIRST + ENDS + TICK], "a")
    deliver([[row(3, 1, 1, "q", 7), mark(3, 1, 2), *TICK]], "b", sink=sink)
    assert {k[0] for k in shown(spark, sink)[0]} == {1, 2, 3} and d.stream_name("x") != d.stream_name("y")


class Held:
    """Stands in for a state of one key."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def appendList(self, values):
        self.value = (self.value or []) + values


class Handle:
    def __init__(self):
        self.states = {}

    def getListState(self, name, schema):
        return self.states.setdefault(name, Held())

    getValueState = getListState

    def registerTimer(self, at):
        pass

    deleteTimer = registerTimer


def test_state_holds_many_rows_in_one_element():
    gather, handle = d.Gather(1000), Handle()
    gather.init(handle)
    rows = [f'{{"n":{k}}}' for k in range(25_500)]
    frames = [pd.DataFrame({"kind": d.ROW, "at_ms": 5, "row": rows[k : k + 10_000]}) for k in range(0, len(rows), 10_000)]
    frames.append(pd.DataFrame({"kind": [d.END], "at_ms": [7], "row": [None]}))
    assert list(gather.handleInputRows((1, 1, 0), iter(frames), None)) == []
    assert len(handle.states["rows"].value) == 26
    out = list(gather.handleExpiredTimer((1, 1, 0), None, None))
    assert [line for f in out for lines in f["row"] for line in lines.split("\n")] == rows and len(out) == 3
    assert not handle.states["rows"].exists()


def test_line_breaks_in_a_row_are_no_ends_of_rows(spark, deliver):
    broken = [row(1, 1, 1, "a\nb\r\n", 10), row(1, 1, 1, "c", 20)]
    assert set(shown(spark, deliver([broken + ENDS[:1] + TICK], "broken"))[0]) == {(1, "a\nb\r\n"), (1, "c")}


def test_differences_are_worked_out_once_for_both_histories(spark, batches, tmp_path):
    sink, counter = d.Sink(f"{tmp_path}/once", TABLE), spark.sparkContext.accumulator(0)
    sink.create(spark)
    seen = F.udf(lambda price: counter.add(1) or price, "decimal(20,6)").asNondeterministic()
    real = d.diff_listings

    def counting(*sides):
        df = real(*sides)
        return df.withColumn("price", seen("price"))

    d.diff_listings = counting
    try:
        assert sink.stage(batches[0], f"{sink.path}/staged/s-0")
    finally:
        d.diff_listings = real
    assert counter.value == 5


def test_a_replay_does_not_go_through_the_state_again(spark, tmp_path, monkeypatch):
    held = []

    def apply(self, batch, number, stream):
        held.append((number, batch.storageLevel.useDisk))
        batch.write.format("noop").mode("overwrite").save()

    monkeypatch.setattr(d.Sink, "apply", apply)
    streams._delivered(spark, "/root/testdata/sf0.001", 2)
    assert held and all(disk for _, disk in held) and len(held) == 2 * len({n for n, _ in held})
