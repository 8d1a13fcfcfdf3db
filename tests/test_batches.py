import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from spectraloom.operators.dedup import best_by_snr, brightest_per_class
from spectraloom.operators.joins import attach_metadata
from spectraloom.plans.preprocessing import build_catalogue, update_catalogue
from spectraloom.session import handed_over
from spectraloom.sources import batches
from spectraloom.sources.partitions import merge_partitioned, read_partitioned, write_partitioned
from spectraloom.streaming import ingest
from tests.test_catalogues import no_meta, raw
from tests.test_plans import plan


def empty_meta(spark):
    empty = build_catalogue(raw(spark, ["x"]), no_meta(spark), no_meta(spark))[0]
    return empty.select("agn_type", "filename", F.lit(0).alias("row_idx"), "OIII_VALID").limit(0)


def state(spark, out, failed):
    done = sorted(r.filename for r in ingest.streamed_catalogue(spark, out).collect())
    return done, sorted(r.filename for r in ingest.streamed_failures(spark, out, failed).collect())


def test_a_fault_between_the_two_writes_adds_nothing_twice(spark, tmp_path, monkeypatch):
    source, out, failed = (str(tmp_path / n) for n in ("in", "out", "failed"))
    meta, names = empty_meta(spark), [f"n{i}" for i in range(5)]
    raw(spark, names).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def run(checkpoint="c"):
        ingest.stream_catalogue(spark, source, schema, meta, out, str(tmp_path / checkpoint), failures=failed).awaitTermination()

    write, broken = batches.write_batch, [True]

    def faulty(df, path, *args, **kwargs):
        if path == failed and broken:
            broken.clear()
            raise RuntimeError("lost")
        return write(df, path, *args, **kwargs)

    monkeypatch.setattr(ingest, "write_batch", faulty)
    with pytest.raises(StreamingQueryException):
        run()
    assert spark.read.parquet(out).count() == 4 and state(spark, out, failed) == ([], [])
    run()  # the same batch again
    want = (["n0", "n1", "n2", "n4"], ["n3"])
    assert state(spark, out, failed) == want
    run("other")  # a stream that sees the same files under other batch names
    assert state(spark, out, failed) == want
    assert spark.read.parquet(out).count() == 4 and spark.read.parquet(failed).count() == 1


def test_a_batch_reads_only_its_key_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(2000).select(F.concat(F.lit("f"), "id").alias("filename"))
    for part in (0, 1):
        mine = rows.filter(F.crc32("filename") % 2 == part)
        batches.write_batch(mine, path, f"b-{part}")
        batches.write_keys(mine, path, f"b-{part}")
    batches.commit_batch(spark, path, "b-0")
    some = rows.filter("filename in ('f3', 'f4', 'f5')").unionByName(spark.createDataFrame([("new",), (None,)], "filename string"))
    keys = batches.known_keys(spark, path, some, "b-9")
    read = {f.split("/_keys/")[1].split("/")[0] for f in keys.inputFiles() if "/_keys/" in f}
    want = {f"bucket={r[0]}" for r in some.select(batches.key_bucket("filename")).distinct().collect() if r[0] is not None}
    assert read <= want and 0 < len(want) <= 5
    committed = {r.filename for r in rows.filter(F.crc32("filename") % 2 == 0).collect()}
    got = {r.filename for r in keys.collect()}
    assert {"f3", "f4", "f5"} & got == {"f3", "f4", "f5"} & committed and got <= committed
    assert batches.known_keys(spark, path, some, "b-0").count() == 0
    assert batches.known_keys(spark, str(tmp_path / "none"), some, "b-0") is None


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_merge_writes_only_partitions_that_gain_rows(spark, tmp_path):
    path = str(tmp_path / "p")
    old = spark.range(200).select(F.concat(F.lit("f"), "id").alias("filename"), F.lit("old").alias("v"))
    write_partitioned(old, path, partitions=16)
    before = files(path)
    new = spark.createDataFrame([("f1", "new"), ("f2", "new"), ("x", "new"), ("y", "new")], "filename string, v string")
    assert merge_partitioned(new, path) == 2
    gone = before - files(path)
    assert 0 < len(gone) <= 2 and len(before) > 10
    got = {r.filename: r.v for r in read_partitioned(spark, path).collect()}
    assert len(got) == 202 and got["f1"] == "old" and got["x"] == "new"
    after = files(path)
    assert merge_partitioned(new, path) == 0 and files(path) == after


def test_a_catalogue_is_updated_in_place(spark, tmp_path):
    path, names = str(tmp_path / "c"), [f"n{i}" for i in range(6)]
    write_partitioned(build_catalogue(raw(spark, names[:3]), no_meta(spark), no_meta(spark))[0], path)
    old = {r.filename: r.flux for r in read_partitioned(spark, path).collect()}
    new = raw(spark, names, shift=5.0)
    log = update_catalogue(new.union(new), no_meta(spark), no_meta(spark), path)
    got = {r.filename: r.flux for r in read_partitioned(spark, path).collect()}
    assert sorted(got) == ["n0", "n1", "n2", "n4", "n5"] and all(got[n] == old[n] for n in old)
    assert {r.filename for r in log.collect()} == {"n3"} and read_partitioned(spark, path).count() == 5


def wide(spark, n=400):
    flux = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda x: (x * F.col("id")).cast("double"))
    return spark.range(n).select(
        F.concat(F.lit("f"), "id").alias("filename"), (F.col("id") % 37).cast("string").alias("obj_id"),
        (F.col("id") % 2 + 1).cast("int").alias("agn_type"), (F.col("id") % 11).cast("double").alias("snr"), flux.alias("flux"),
    )


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def vectors_exchanged(df):
    """Exchanges with a vector among the columns below them, found in the tree of physical nodes."""
    found = []

    def visit(node):
        if "Exchange" in node.nodeName() and any(a.name() == "flux" for a in iterate(node.output())):
            found.append(node.nodeName())
        for child in iterate(node.children()):
            visit(child)

    visit(df._jdf.queryExecution().executedPlan())
    return found


def iterate(seq):
    return [seq.apply(i) for i in range(seq.size())]


def test_metadata_meets_bucketed_vectors_without_moving_them(spark, no_broadcast):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spectra = handed_over(wide(spark), "spectra", by=("agn_type", "filename"))
        meta = wide(spark).select("agn_type", "filename", F.col("snr").alias("line"), F.lit(0).alias("row_idx"))
        joined = attach_metadata(spectra, meta)
        assert vectors_exchanged(joined) == []
        assert vectors_exchanged(attach_metadata(wide(spark), meta)) != []
        assert sorted((r.filename, r.line, r.flux) for r in joined.collect()) == sorted((r.filename, r.snr, r.flux) for r in wide(spark).collect())
        objects = handed_over(wide(spark), "objects", by=("obj_id",))
        best = best_by_snr(objects, colocated=True)
        assert vectors_exchanged(best.select("obj_id", "flux")) == []
        assert sorted(best.collect()) == sorted(best_by_snr(wide(spark)).collect())
        # few winners are broadcast: only their rows, once found where they are read, come together
        few = plan(brightest_per_class(handed_over(wide(spark), "classes"))).split("== Physical Plan ==")[1]
        moved = [i for i, line in enumerate(few.splitlines()) if "Exchange hashpartitioning" in line]
        assert len(moved) == 1 and moved[0] < few.splitlines().index(next(x for x in few.splitlines() if "BroadcastHashJoin" in x))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_objects_without_a_name_are_one_group_in_buckets_too(spark):
    df = wide(spark, 60).withColumn("obj_id", F.when(F.col("snr") > 2, F.col("obj_id")))
    stored = handed_over(df, "objects", by=("obj_id",))
    assert sorted(best_by_snr(stored, colocated=True).collect(), key=str) == sorted(best_by_snr(df).collect(), key=str)
