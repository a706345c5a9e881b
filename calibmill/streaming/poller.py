"""Incremental archiving: new snapshot files become archive rows once, one trigger a polling round."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from datetime import UTC, datetime
from logging.handlers import RotatingFileHandler

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from calibmill.operators.parsing import parse_snapshots
from calibmill.session import release, stage
from calibmill.sources.archive import MAX_HISTORY_DAYS, PollSource, check_history, historical_window, save_if_new


def ingest_files(spark: SparkSession, landing: str, archive: str, checkpoint: str, quarantine: str | None = None) -> None:
    """Read what is new in a landing folder of JSON files, append what the archive doesn't have, and stop.

    Exactly-once comes from the checkpoint (files) together with the anti-join (keys): a batch that is run again writes
    nothing twice. Snapshots with errors go to ``quarantine`` (the archive's path with '.quarantine' behind it if not given): path, error, body and
    the batch, a folder per batch, so that a batch that is run again replaces its own. Each batch is parsed once.
    """
    aside = quarantine or f"{archive.rstrip('/')}.quarantine"

    def write(batch: DataFrame, number: int) -> None:
        parsed = stage(parse_snapshots(batch.withColumn("raw", F.col("body"))).drop("qubits"))
        save_if_new(parsed.where("error is null and ts is not null").select("backend", "ts", "schema_version", F.col("raw").alias("body"), "path"), archive, arrival="path")
        bad = parsed.where("error is not null or ts is null")
        if not bad.isEmpty():
            bad.select("path", "error", F.col("raw").alias("body")).write.mode("overwrite").parquet(f"{aside}/batch={number}")

    files = spark.readStream.format("text").option("wholetext", "true").load(landing).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_levels(events: DataFrame, watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Mean value per event type and window of a stream of events (ts, event_type, value), late rows within the watermark counted."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "mean_value")


def keep_levels(levels: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write what each trigger changes of ``windowed_levels`` to ``folder`` (a part per batch) and stop when all there is has been read.

    In update mode the watermark lets go of windows that can't change any more, so the state stays bounded.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return levels.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_levels(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of every window and event type that ``keep_levels`` wrote."""
    rows = spark.read.parquet(folder)
    return rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "mean_value"), "batch").alias("_l")).select("window_start", "event_type", "_l.*")


def configure_logging(folder: str | None) -> logging.Logger:
    """A logger to stderr and, with a folder, to a file of 5 MB kept five times."""
    logger = logging.getLogger("calibmill.poller")
    logger.setLevel(logging.INFO)
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if folder:
        os.makedirs(folder, exist_ok=True)
        handlers.append(RotatingFileHandler(os.path.join(folder, "poller.log"), maxBytes=5_000_000, backupCount=5))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    logger.handlers = handlers
    return logger


def _parser() -> argparse.ArgumentParser:
    given = os.environ.get
    p = argparse.ArgumentParser(prog="calibmill-poll", description="Poll backends once and archive what is new.")
    p.add_argument("--backend", action="append", required=True)
    p.add_argument("--historical", nargs=3, metavar=("START", "END", "STEP_HOURS"), help="also poll the instants from START, before END")
    p.add_argument("--data-dir", default=given("CALIBMILL_DATA_DIR", "data/archive"))
    p.add_argument("--log-dir", default=given("CALIBMILL_LOG_DIR", "data/logs"))
    p.add_argument("--service", default=given("CALIBMILL_SERVICE", ""), help="module:callable of the service client")
    p.add_argument("--channel", default=given("CALIBMILL_CHANNEL", ""), help="handed to the service client, as are CALIBMILL_TOKEN and CALIBMILL_INSTANCE")
    p.add_argument("--max-historical-days", type=int, default=int(given("CALIBMILL_MAX_HISTORICAL_DAYS", str(MAX_HISTORY_DAYS))))
    p.add_argument("--retries", type=int, default=int(given("CALIBMILL_RETRIES", "3")))
    return p


def poll_once(spark: SparkSession, backends: list[str], archive: str, instants: list[datetime] | None = None, max_days: int = MAX_HISTORY_DAYS, **options: object) -> DataFrame:
    """One round: the current snapshot of every backend, and those of the instants; returns what the archive didn't have.

    Instants without a zone or too old raise before anything is asked of the service. options: those of ``PollSource``.
    """
    instants = instants or []
    check_history(instants, datetime.now(UTC), max_days)
    spark.dataSource.register(PollSource)
    given = {k: v for k, v in options.items() if v not in (None, "")}
    reader = spark.read.format("calibration_poll").options(backends=",".join(backends), instants=",".join(t.isoformat() for t in instants), current="true", **given)
    return save_if_new(reader.load(), archive)


def main(argv: list[str] | None = None) -> int:
    """0 if the round went through (nothing new included), 1 if it couldn't be planned or failed."""
    args = _parser().parse_args(argv)
    logger = configure_logging(args.log_dir)
    from calibmill.session import get_spark

    spark = get_spark("poller")
    try:
        instants: list[datetime] = []
        if args.historical:
            start, end = (datetime.fromisoformat(t.replace("Z", "+00:00")) for t in args.historical[:2])
            instants = [r["ts"].astimezone(UTC) for r in historical_window(spark, start, end, int(args.historical[2])).collect()]
        written = poll_once(spark, args.backend, args.data_dir, instants, args.max_historical_days, service=args.service, channel=args.channel, token=os.environ.get("CALIBMILL_TOKEN"), instance=os.environ.get("CALIBMILL_INSTANCE"), retries=args.retries)
        logger.info("archived %d snapshots", written.count())
    except Exception as problem:  # noqa: BLE001  the command's exit code tells
        logger.exception("the round failed: %s", problem)
        return 1
    finally:
        release(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
