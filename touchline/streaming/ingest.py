"""Raw documents to the event topic: validate, publish the accepted, keep the rejected."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchline.functions.plans import observed
from touchline.operators.decode import decode_documents
from touchline.operators.encode import publish_rows
from touchline.operators.validate import accepted, rejected, validate
from touchline.schema import BATCH_INTERVAL
from touchline.streaming.sinks import BatchSink

log = logging.getLogger(__name__)


def ingest_batch(raw: DataFrame, batch_id: int, events: BatchSink, rejects: BatchSink) -> dict[str, int]:
    """Publish a batch's valid documents and write the others with their error; the number of each.

    ``rejects`` may be :func:`touchline.streaming.sinks.drop`; rejected documents are
    counted all the same.
    """
    seen = Observation()
    validated = validate(decode_documents(raw))
    measures = {
        "accepted": F.count_if(F.isnull("error_message")),
        "rejected": F.count_if(F.isnotnull("error_message")),
    }
    counted = validated.observe(seen, *[m.alias(name) for name, m in measures.items()])
    events(publish_rows(accepted(counted)), batch_id)
    counts = observed(seen, validated, **measures)
    if counts["rejected"]:
        log.info("batch %s: %s documents rejected", batch_id, counts["rejected"])
        rejects(rejected(validated), batch_id)
    return counts


def start_ingest(
    raw: DataFrame, events: BatchSink, checkpoint: str, rejects: BatchSink, available_now: bool = False
) -> StreamingQuery:
    """Run :func:`ingest_batch` over a stream of JSON text."""
    writer = raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda rows, batch_id: ingest_batch(rows, batch_id, events, rejects)
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=BATCH_INTERVAL).start()
