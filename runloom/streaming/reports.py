"""Reports that keep up with a growing folder of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from runloom.plans.report import weekday_report
from runloom.sources import sinks


def refresh_report(trips: DataFrame, out_path: str, checkpoint: str,
                   every: str | None = "5 minutes", **columns: str) -> StreamingQuery:
    """Recompute the weekday report as files arrive, publishing each state of it as a version.

    The state is one row per weekday. ``every=None`` takes in what is there and stops. Readers use
    ``sinks.read_published`` and find a whole report at any time.
    """
    report = weekday_report(trips, **columns)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (report.writeStream.outputMode("complete").trigger(**trigger)
            .option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, batch_id: sinks.publish(batch, out_path, batch_id))
            .start())
