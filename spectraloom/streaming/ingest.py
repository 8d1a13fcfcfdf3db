"""Incremental build of the catalogue from a stream of raw spectra."""

import json
import uuid

from pyspark.sql import functions as F

from ..operators.dedup import keep_first
from ..operators.joins import attach_metadata
from ..operators.select import clean_spectra, split_processed
from ..plans.preprocessing import preprocess_spectra, row_order
from ..session import handed_over
from ..sources.batches import batch_key, commit_batch, committed, existing_parquet, known_keys, write_batch, write_keys
from ..sources.tables import processed_schema

FAILURES = "filename string, agn_type int, skip_reason string, error string"


def _without(rows, names):
    return rows if names is None else rows.join(names, "filename", "left_anti")


def _written(spark, path, batch, schema):
    """What the batch has written to a table."""
    rows = existing_parquet(spark, f"{path}/batch={batch}", schema)
    return spark.createDataFrame([], schema) if rows is None else rows


def ingest_batch(batch, metadata, output, failures=None, limits=None, key=None, **options):
    """Process the spectra of one batch whose file name the catalogue does not have yet.

    Of several copies of a file name, in one class or both, the first that can be processed counts
    (by object, class, redshift, SNR and vector). File names without any go to `failures`, one row
    each, unless they are there already; a later copy may still succeed.

    Known names are left out before the kernel runs; only key buckets that the batch's names fall into
    are read for that. Catalogue and failures count from one commit, after both are written. A batch
    that is replayed under its `key` (a new one if not given) replaces what an earlier attempt left;
    under another key it adds nothing. One writer per catalogue is assumed.
    """
    spark = batch.sparkSession
    key = key or batch_key(uuid.uuid4().hex, 0)
    fresh = _without(batch, known_keys(spark, output, batch, key))
    good, failed = split_processed(handed_over(preprocess_spectra(fresh, **options), "ingested"))
    first = keep_first(good.drop("error"), "filename", row_order())
    catalogue = clean_spectra(attach_metadata(first, metadata), **(limits or {}))
    write_batch(catalogue, output, key, order=("agn_type", "snr"))
    write_keys(_written(spark, output, key, processed_schema()), output, key)
    if failures is not None:
        failed = _without(failed, good.select("filename").distinct())
        failed = _without(failed, known_keys(spark, failures, failed, key, log=output))
        one = keep_first(failed.select("filename", "agn_type", "error"), "filename", ["agn_type", "error"])
        log = one.select("filename", "agn_type", F.lit("preprocessing_failed").alias("skip_reason"), "error")
        write_batch(log, failures, key)
        write_keys(_written(spark, failures, key, FAILURES), failures, key)
    commit_batch(spark, output, key)


def streamed_catalogue(spark, output):
    """The catalogue as far as it is committed."""
    return committed(spark, output, processed_schema())


def streamed_failures(spark, output, failures):
    return committed(spark, failures, FAILURES, log=output)


def stream_id(spark, checkpoint):
    """The identity Spark gave the stream of a checkpoint folder; it survives restarts, a new folder has a new one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def stream_catalogue(spark, source, schema, metadata, output, checkpoint, limits=None, failures=None, **options):
    """A query over new Parquet files under `source`; processes what is there, then stops.

    A batch is known by its stream and number, so one that is replayed after a fault is the same batch.
    """
    raw = spark.readStream.schema(schema).parquet(source)
    if "filename" not in raw.columns:
        raw = raw.withColumn("filename", F.col("_metadata.file_name"))

    def ingest(batch, number):
        key = batch_key(stream_id(batch.sparkSession, checkpoint), number)
        ingest_batch(batch, metadata, output, failures, limits, key, **options)

    return raw.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
