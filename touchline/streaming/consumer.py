"""Topic to match_events in micro-batches, with retry, dead-letter and audit outputs."""

from __future__ import annotations

import json
import logging
import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchline.functions.plans import observed
from touchline.operators.decode import decode_envelopes
from touchline.operators.encode import dead_letter_rows, retry_rows, storage_rows
from touchline.operators.routing import DEAD, LOST, RETRY, route_failed
from touchline.schema import BATCH_INTERVAL, MAX_RETRIES
from touchline.streaming.sinks import BatchSink, drop

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Outputs:
    """Where a consumer writes.  All but the table are optional.

    Rows that cannot be read need ``quarantine``, and rows of a failed batch that may not
    be tried again need ``dead``; without it the batch fails and comes again.  Either may
    be :func:`touchline.streaming.sinks.drop`, the choice to lose such rows, counted.
    """

    table: BatchSink
    retry: BatchSink | None = None
    dead: BatchSink | None = None
    audit: BatchSink | None = None
    quarantine: BatchSink | None = None


def consume_batch(
    topic: DataFrame, batch_id: int, outputs: Outputs, max_retries: int = MAX_RETRIES
) -> dict[str, int]:
    """Decode one micro-batch and store it, or route its rows when the store fails.

    Gives the number of rows by outcome.  Rows are counted on their way into the store.
    """
    started = time.monotonic()
    decoded, seen = decode_envelopes(topic), Observation()
    measures = {"parse_error": F.count_if("parse_error"), "success": F.count_if(~F.col("parse_error"))}
    events = decoded.observe(seen, *[m.alias(name) for name, m in measures.items()]).filter(~F.col("parse_error"))
    if _stored(storage_rows(events), batch_id, outputs):
        counts = observed(seen, decoded, **measures)
    else:
        counts = _route(decoded, batch_id, outputs, max_retries)
    if counts["parse_error"]:
        if outputs.quarantine is None:
            raise ValueError(f"{counts['parse_error']} rows of batch {batch_id} cannot be read and have no quarantine")
        log.warning("batch %s: %s rows cannot be read", batch_id, counts["parse_error"])
        # The event's timestamp has taken the place of the record time; a broken row has none.
        kept = [c for c in topic.columns if c != "timestamp"]
        outputs.quarantine(decoded.filter("parse_error").select(*kept), batch_id)
    if outputs.audit:
        outputs.audit(_audit_rows(topic, counts, time.monotonic() - started), batch_id)
    return {outcome: n for outcome, n in counts.items() if n}


def _stored(rows: DataFrame, batch_id: int, outputs: Outputs) -> bool:
    """Whether the batch is stored.  A fault of the query itself is no fault of the store."""
    try:
        outputs.table(rows, batch_id)
        return True
    except (AnalysisException, TypeError, AttributeError, NameError):
        raise
    except Exception:
        if outputs.retry is None and outputs.dead is None:
            raise
        log.warning("batch %s could not be stored; routing its rows", batch_id, exc_info=True)
        return False


def _route(decoded: DataFrame, batch_id: int, outputs: Outputs, max_retries: int) -> dict[str, int]:
    """Send each row to exactly one of retry and dead."""
    lossy = outputs.dead is drop
    routed = route_failed(decoded, max_retries, outputs.retry is not None, not lossy)
    routed = routed.withColumn("route", F.when(F.col("parse_error"), "parse_error").otherwise(F.col("route"))).persist()
    try:
        # At most three routes and the unreadable rows, so four rows reach the driver.
        counts = {r["route"]: r["n"] for r in routed.groupBy("route").agg(F.count("*").alias("n")).collect()}
        if counts.get(DEAD) and outputs.dead is None:
            raise ValueError(f"{counts[DEAD]} rows of batch {batch_id} may not be tried again and have no dead-letter output")
        return {"parse_error": 0, **_send(routed, counts, batch_id, outputs, LOST if lossy else DEAD)}
    finally:
        routed.unpersist()


def _send(routed: DataFrame, counts: dict[str, int], batch_id: int, outputs: Outputs, given_up: str) -> dict[str, int]:
    dead = routed.filter(F.col("route") == DEAD)
    if counts.get(RETRY):
        try:
            outputs.retry(retry_rows(routed.filter(F.col("route") == RETRY)), batch_id)
        except Exception:
            if outputs.dead is None:
                raise
            log.warning("retry rows of batch %s could not be written; giving them up", batch_id, exc_info=True)
            counts[given_up] = counts.get(given_up, 0) + counts.pop(RETRY)
            dead = routed.filter(F.col("route") != "parse_error")
    if counts.get(DEAD):
        # A failure here stops the query: the checkpoint has not moved, so nothing is lost.
        outputs.dead(dead_letter_rows(dead), batch_id)
    if counts.get(LOST):
        log.error("%s rows of batch %s are dropped", counts[LOST], batch_id)
    return counts


def _audit_rows(topic: DataFrame, counts: dict[str, int], seconds: float) -> DataFrame:
    rows = [(outcome, n, seconds) for outcome, n in counts.items() if n]
    return topic.sparkSession.createDataFrame(rows, "outcome string, rows bigint, duration_s double")


def start_consumer(
    topic: DataFrame, outputs: Outputs, checkpoint: str, max_retries: int = MAX_RETRIES, available_now: bool = False
) -> StreamingQuery:
    """Run :func:`consume_batch` over a topic stream.

    The checkpoint takes the place of committed offsets: it moves once the batch is
    stored or routed.  ``available_now`` drains what is there and stops.
    """
    writer = topic.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda rows, batch_id: consume_batch(rows, batch_id, outputs, max_retries)
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=BATCH_INTERVAL).start()


def live_lag(query: StreamingQuery) -> list[tuple[str, int, int]]:
    """(topic, partition, rows not yet consumed) of a running query's Kafka sources, from its latest progress."""
    # As JSON: the progress object keeps offsets in another spelling.
    progress = query.lastProgress
    return offsets_behind(json.loads(progress.json)) if progress else []


def offsets_behind(progress: dict) -> list[tuple[str, int, int]]:
    """(topic, partition, rows not yet consumed) of the Kafka sources in a progress report."""
    found = []
    for source in progress["sources"]:
        done, latest = (_offsets(source.get(name)) for name in ("endOffset", "latestOffset"))
        for topic, partitions in latest.items():
            read = done.get(topic, {})
            found += [(topic, int(p), offset - read.get(p, 0)) for p, offset in partitions.items()]
    return sorted(found)


def _offsets(told) -> dict:
    """Offsets by topic and partition; sources of other kinds tell theirs in other shapes, which give none."""
    return {t: p for t, p in told.items() if isinstance(p, dict)} if isinstance(told, dict) else {}


def stop_gracefully(query: StreamingQuery) -> None:
    """Process what has already arrived, then stop."""
    query.processAllAvailable()
    query.stop()
