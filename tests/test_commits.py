"""The table with a commit log: readers during writes, repeats, compaction, pruned search for repeats, stateless live cells."""

import pytest
from pyspark.sql import functions as F

import table_inputs as E
from touchline.operators.decode import decode_envelopes
from touchline.operators.encode import publish_rows, storage_rows
from touchline.plans.match_metrics import minute_cells
from touchline.schema import MATCH_EVENTS
from touchline.sources import commits
from touchline.sources.topics import append_to_topic, read_topic_stream
from touchline.streaming.consumer import Outputs, start_consumer
from touchline.streaming.live import cell_deltas, counted_cells, fold_deltas, start_cell_deltas
from touchline.streaming.sinks import committed_match_events, committed_sink, distinct_match_events_sink

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return storage_rows(E.valid_events(spark, SF)).select(*MATCH_EVENTS.fieldNames()).cache()


@pytest.fixture()
def table(spark, tmp_path):
    return committed_match_events(spark, f"{tmp_path}/table")


def as_list(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_an_empty_table_and_an_empty_batch(table, rows):
    assert table.read().count() == 0 and table.version().number == 0
    table.append(rows.limit(0), "w", 0)
    assert table.read().count() == 0 and table.version().writers == {"w": 0}


def test_a_repeated_batch_changes_nothing(table, rows):
    first = table.append(rows, "w", 3)
    assert table.append(rows, "w", 3).number == first.number
    assert as_list(table.read()) == as_list(rows)
    # Another writer's batch of the same number is another batch.
    table.append(rows.limit(5), "v", 3)
    assert table.read().count() == rows.count() + 5


def test_a_reader_during_a_repeated_batch_sees_all_or_nothing(table, rows, monkeypatch):
    """The first try dies after its files are written; the second is watched at the moment before it publishes."""
    table.append(rows.filter("event_date < '2024-01-10'"), "w", 0)
    old = as_list(table.read())
    late = rows.filter("event_date >= '2024-01-10'")

    def die(change):
        raise ConnectionError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(table, "_publish", die)
        with pytest.raises(ConnectionError):
            table.append(late, "w", 1)
    assert as_list(table.read()) == old
    reader = table.read()
    seen = []
    publish = table._publish
    monkeypatch.setattr(table, "_publish", lambda change: (seen.append(as_list(table.read())), publish(change))[1])
    table.append(late, "w", 1)
    assert seen == [old] and as_list(reader) == old and as_list(table.read()) == as_list(rows)


def test_writers_that_publish_at_once_both_get_in(table, rows, monkeypatch):
    other = committed_match_events(rows.sparkSession, table.path)
    version, pending = table.version, [1]

    def raced(number=None):
        now = version(number)
        if pending and number is None and now.number == 1:
            pending.pop()
            other.append(rows.limit(7), "other", 0)
        return now

    table.append(rows.limit(3), "w", 0)
    monkeypatch.setattr(table, "version", raced)
    table.append(rows.limit(4), "w", 1)
    assert other.read().count() == 14 and other.version().writers == {"w": 1, "other": 0}


def test_listing_does_not_grow_with_batches(table, rows, monkeypatch):
    monkeypatch.setattr(commits, "KEEP_VERSIONS", 4)
    few = rows.limit(2)
    for batch in range(9):
        table.append(few, "w", batch)
    assert len(table.files.names("_log")) <= 4 + 2 and table.read().count() == 18
    with pytest.raises(Exception, match="v000000000001"):
        table.version(1)


def test_a_date_range_opens_its_own_files_only(table, rows):
    table.append(rows, "w", 0)
    part = table.read("2024-01-05", "2024-01-07")
    want = rows.filter("event_date between '2024-01-05' and '2024-01-07'")
    assert as_list(part) == as_list(want) and 0 < len(part.inputFiles()) < len(table.read().inputFiles())


def test_closed_dates_are_compacted_under_readers_and_writers(table, rows, monkeypatch):
    for batch in range(4):
        table.append(rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == batch), "w", batch)
    reader, before = table.read(), as_list(table.read())
    extra = rows.filter("event_date = '2024-01-05'").limit(3)
    publish, meanwhile = table._publish, [1]

    def interrupted(change):
        if meanwhile:
            meanwhile.pop()
            committed_match_events(rows.sparkSession, table.path).append(extra, "late", 0)
        return publish(change)

    monkeypatch.setattr(table, "_publish", interrupted)
    now = table.compact(before="2024-01-15")
    assert as_list(table.read()) == sorted(before + as_list(extra)) and as_list(reader) == before
    counts = {d: len(table.manifest(now, d)) for d in now.dates}
    assert all(n <= 2 for d, n in counts.items() if d < "2024-01-15")
    assert sum(n for d, n in counts.items() if d < "2024-01-15" and d != "2024-01-05") == sum(d < "2024-01-15" and d != "2024-01-05" for d in counts)
    assert any(n > 1 for d, n in counts.items() if d >= "2024-01-15")


def test_a_slower_compaction_leaves_the_faster_ones_result(table, rows, monkeypatch):
    for batch in range(3):
        table.append(rows.filter("event_date = '2024-01-05'"), "w", batch)
    publish, meanwhile = table._publish, [1]

    def interrupted(change):
        if meanwhile:
            meanwhile.pop()
            committed_match_events(rows.sparkSession, table.path).compact()
        return publish(change)

    monkeypatch.setattr(table, "_publish", interrupted)
    table.compact()
    assert table.read().count() == 3 * rows.filter("event_date = '2024-01-05'").count()


def test_vacuum_deletes_what_no_version_names(table, rows, monkeypatch):
    monkeypatch.setattr(commits, "KEEP_VERSIONS", 1)
    for batch in range(3):
        table.append(rows.limit(20), "w", batch)
    table.compact()
    before = as_list(table.read())
    assert table.vacuum(3600) == []
    dropped = table.vacuum(0)
    assert any(d.startswith("data/") for d in dropped) and as_list(table.read()) == before
    assert table.vacuum(0) == []


def test_repeats_are_searched_in_the_files_that_may_hold_them(table, rows):
    day = rows.filter("event_date between '2024-01-05' and '2024-01-08'")
    for batch in range(8):
        table.append_new(day.filter(F.pmod(F.xxhash64("event_id"), F.lit(8)) == batch), "w", batch)
    again = day.filter((F.pmod(F.xxhash64("event_id"), F.lit(8)) == 3) & (F.col("event_date") == "2024-01-06")).limit(2)
    version = table.version()
    found = table.holding(again, version)
    held = sum(len(table.manifest(version, d)) for d in version.dates)
    # The files of the date are eight; the two ids lie in one of them.
    assert 1 <= len(found) <= 3 < 8 <= held
    table.append_new(again.unionByName(again), "w", 8)
    assert as_list(table.read()) == as_list(day)


def test_files_no_larger_than_the_batch_are_read_without_their_filters(spark, table, rows, monkeypatch):
    monkeypatch.setattr(commits, "FEW_IDS", 0)
    half = rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0)
    table.append_new(half, "w", 0)
    version = table.version()
    # The filters lie in another folder than the files, so without them the search would fail if it asked one.
    for name in table.files.names("_log/ids"):
        table.files.delete(f"_log/ids/{name}")
    assert table.holding(rows, version) == sorted(f["path"] for d in version.dates for f in table.manifest(version, d))
    table.append_new(rows, "w", 1)
    assert as_list(table.read()) == as_list(rows)


@pytest.mark.parametrize("sink", [committed_sink, distinct_match_events_sink])
def test_a_batch_is_computed_once(spark, tmp_path, rows, sink):
    computed = spark.sparkContext.accumulator(0)

    def seen(event_id):
        computed.add(1)
        return event_id

    marked = rows.withColumn("event_id", F.udf(seen, "string").asNondeterministic()("event_id"))
    more = {"distinct": True} if sink is committed_sink else {}
    write = sink(f"{tmp_path}/table", writer="w", **more)
    for batch in range(3):
        write(marked, batch)
    assert computed.value == 3 * rows.count()


def test_of_unequal_repeats_the_least_is_kept(spark, table, rows):
    one = rows.limit(1)
    other = one.withColumn("match_id", F.concat(F.lit("a-"), "match_id"))
    table.append_new(one.unionByName(other).unionByName(one), "w", 0)
    kept = table.read().collect()
    assert len(kept) == 1 and kept[0]["match_id"] == min(one.first()["match_id"], other.first()["match_id"])


def published(spark, path, parts):
    rows = E.valid_events(spark, SF, "seq")
    for part in range(parts):
        append_to_topic(publish_rows(rows.filter(F.col("seq") % parts == part)), f"{path}/{parts - part}")


def test_a_stream_into_the_committed_table(spark, tmp_path, rows):
    published(spark, f"{tmp_path}/topic", 3)
    for checkpoint in ("a", "b"):
        topic = read_topic_stream(spark, f"{tmp_path}/topic", max_files_per_trigger=2)
        sink = committed_sink(f"{tmp_path}/table", distinct=True)
        start_consumer(topic, Outputs(sink), f"{tmp_path}/{checkpoint}", available_now=True).awaitTermination()
    assert as_list(committed_match_events(spark, f"{tmp_path}/table").read()) == as_list(rows)


def test_live_cells_without_state_count_late_events(spark, tmp_path, rows):
    # Every event comes twice, its second copy in another batch.
    published(spark, f"{tmp_path}/topic", 4)
    published(spark, f"{tmp_path}/topic/again", 2)
    events = decode_envelopes(read_topic_stream(spark, f"{tmp_path}/topic", max_files_per_trigger=1)).filter(~F.col("parse_error"))
    query = start_cell_deltas(events, f"{tmp_path}/cells", f"{tmp_path}/c", available_now=True)
    query.awaitTermination()
    assert len(query.recentProgress) >= 4 and all(not p.stateOperators for p in query.recentProgress)
    want = as_list(minute_cells(rows.unionAll(rows)))
    assert as_list(counted_cells(spark, f"{tmp_path}/cells")) == want
    stored = cell_deltas(spark, f"{tmp_path}/cells").read().count()
    fold_deltas(spark, f"{tmp_path}/cells")
    assert cell_deltas(spark, f"{tmp_path}/cells").read().count() == len(want) < stored
    assert as_list(counted_cells(spark, f"{tmp_path}/cells")) == want
