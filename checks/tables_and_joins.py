"""De-duplication, metadata joins, existence tests, merges and file formats."""

from pyspark.sql import functions as F

from spectraloom.operators.dedup import best_by_snr, brightest_per_class, keep_first, keep_last
from spectraloom.operators.joins import attach_metadata, merge_keep_existing, not_present, pairs_with_files, with_errors
from spectraloom.operators.metrics import category_counts
from spectraloom.plans.pairs import resolve_pairs
from spectraloom.session import handed_over, scratch_path
from spectraloom.sources.results import read_run_results, write_catalogue, write_csv, write_json
from spectraloom.sources.tables import (
    PREDICTION_SCHEMA,
    read_catalogue,
    read_csv,
    read_manifest,
    read_spectra,
    read_survey_table,
)

from .registry import query, rnd, table

LINE_ORDER = ["l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity"]
RUNS_PER_FILE = 1000


@query(
    "first_row_per_key",
    """
    SELECT l_partkey, l_orderkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey
              ORDER BY l_orderkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) = 1
    """,
)
def first(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_partkey", *LINE_ORDER)
    return keep_first(df, "l_partkey", LINE_ORDER)


@query(
    "last_row_per_key",
    """
    SELECT l_partkey, l_orderkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey
              ORDER BY l_orderkey DESC, l_suppkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) = 1
    """,
)
def last(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_partkey", *LINE_ORDER)
    return keep_last(df, "l_partkey", LINE_ORDER)


@query(
    "best_row_per_object",
    """
    SELECT l_partkey, l_extendedprice, l_orderkey, l_suppkey, l_linenumber, l_quantity FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey
              ORDER BY l_extendedprice DESC, l_orderkey, l_suppkey, l_linenumber, l_quantity) = 1
    """,
)
def best(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_partkey", *LINE_ORDER)
    return best_by_snr(df, "l_partkey", "l_extendedprice", ["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity"])


@query(
    "first_copy_of_text",
    """
    SELECT md5(text) AS digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text
    """,
)
def text_copies(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(F.md5("text").alias("digest"), "doc_id", "source")
    return keep_first(df, "digest", "doc_id")


@query(
    "brightest_spectrum_per_class",
    """
    SELECT p_size % 2 + 1 AS agn_type, p_partkey, p_retailprice FROM part
    QUALIFY row_number() OVER (PARTITION BY p_size % 2 ORDER BY p_retailprice DESC, p_partkey) = 1
    """,
)
def brightest(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 2 + 1).alias("agn_type"), "p_partkey", "p_retailprice")
    return brightest_per_class(p, "agn_type", "p_retailprice", "p_partkey")


@query(
    "attached_metadata",
    """
    WITH meta AS (SELECT agn_type, filename, arg_max(quality, row_idx) AS quality, arg_max(toxic, row_idx) AS toxic
      FROM (SELECT doc_id % 2 + 1 AS agn_type, doc_id // 3 AS filename, quality, toxic, doc_id AS row_idx FROM labels)
      GROUP BY ALL)
    SELECT d.doc_id, d.agn_type, d.filename, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic
    FROM (SELECT doc_id, doc_id % 2 + 1 AS agn_type, doc_id // 3 AS filename FROM documents) d
    LEFT JOIN meta USING (agn_type, filename)
    """,
)
def metadata(spark, sf_dir):
    keys = [(F.col("doc_id") % 2 + 1).alias("agn_type"), F.floor(F.col("doc_id") / 3).alias("filename")]
    docs = table(spark, sf_dir, "documents").select("doc_id", *keys)
    meta = table(spark, sf_dir, "labels").select(
        *keys, F.col("quality").cast("double"), F.col("toxic").cast("double"), F.col("doc_id").alias("row_idx")
    )
    return attach_metadata(docs, meta)


BEST_VECTOR_SQL = """
    SELECT vec_id // 7 AS obj_id, vec_id, label, list_sum(list_transform(embedding, lambda x: round(x::DOUBLE * 1e6)))::BIGINT AS total
    FROM embeddings
    QUALIFY row_number() OVER (PARTITION BY vec_id // 7 ORDER BY label DESC, vec_id) = 1
"""


def best_vectors(spark, sf_dir, **how):
    """The best vector of each object; every tenth object has no name."""
    v = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 7).alias("obj_id"), F.col("vec_id").alias("filename"), F.col("label").cast("double").alias("snr"), "label", F.col("embedding").alias("flux")
    )
    if how:
        v = handed_over(v, "objects", by=("obj_id",))
    best = best_by_snr(v, **how)
    total = F.aggregate("flux", F.lit(0).cast("bigint"), lambda a, x: a + F.round(x.cast("double") * 1e6).cast("bigint"))
    return best.select("obj_id", F.col("filename").alias("vec_id"), "label", total.alias("total"))


@query("best_vector_per_object", BEST_VECTOR_SQL)
def best_vector(spark, sf_dir):
    return best_vectors(spark, sf_dir)


@query("best_vector_per_object_in_buckets", BEST_VECTOR_SQL)
def best_vector_in_buckets(spark, sf_dir):
    return best_vectors(spark, sf_dir, colocated=True)


@query(
    "targets_not_present",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def missing_targets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return not_present(o, c, "o_custkey")


def pair_manifest(spark, sf_dir):
    """conversations as pairs of two file names; labels gives the files that exist."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("sdssid"),
        (F.col("turn") / 10.0).alias("z"),
        F.concat(F.when(F.col("turn") % 4 == 0, "/new/").otherwise(""), F.lit("doc-"), F.col("conv_id")).alias(
            "specname_dr16"
        ),
        F.concat(F.lit("doc-"), F.col("conv_id") + F.col("turn")).alias("specname_sdssv"),
        (F.col("role") == "user").cast("int").alias("label"),
    )


PAIR_SQL = """
  m AS (SELECT conv_id * 100 + turn AS sdssid,
      CASE WHEN turn % 4 = 0 THEN '/new/doc-' || conv_id ELSE '/old/doc-' || conv_id END AS dr16_path,
      '/new/doc-' || (conv_id + turn) AS sdssv_path FROM conversations),
  files AS (SELECT '/old/doc-' || doc_id AS path FROM labels UNION SELECT '/new/doc-' || doc_id FROM labels),
  marked AS (SELECT m.*, dr16_path IN (SELECT path FROM files) AS a, sdssv_path IN (SELECT path FROM files) AS b FROM m)
"""


def listing(spark, sf_dir):
    ids = table(spark, sf_dir, "labels")
    folders = F.explode(F.array(F.lit("/old/doc-"), F.lit("/new/doc-")))
    return ids.select("doc_id", folders.alias("f")).select(F.concat("f", "doc_id").alias("path"))


@query("pairs_with_files", f"WITH {PAIR_SQL} SELECT sdssid, dr16_path, sdssv_path FROM marked WHERE a AND b")
def pairs_kept(spark, sf_dir):
    pairs = resolve_pairs(pair_manifest(spark, sf_dir), "/old", "/new")
    kept, _ = pairs_with_files(pairs, listing(spark, sf_dir))
    return kept.select("sdssid", "dr16_path", "sdssv_path")


@query(
    "pairs_skipped",
    f"""
    WITH {PAIR_SQL}
    SELECT sdssid, 'missing_file' AS skip_reason,
      CASE WHEN NOT a AND NOT b THEN 'dr16+sdssv' WHEN NOT a THEN 'dr16' ELSE 'sdssv' END AS missing_side
    FROM marked WHERE NOT (a AND b)
    """,
)
def pairs_skipped(spark, sf_dir):
    pairs = resolve_pairs(pair_manifest(spark, sf_dir), "/old", "/new")
    _, log = pairs_with_files(pairs, listing(spark, sf_dir))
    return log.select("sdssid", "skip_reason", "missing_side")


@query(
    "merged_catalogue",
    """
    WITH old AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    new AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
    SELECT o_custkey, o_orderkey, 'existing' AS origin, NULL::VARCHAR AS note FROM old
    UNION ALL SELECT o_custkey, o_orderkey, 'new', 'added' FROM new WHERE o_custkey NOT IN (SELECT o_custkey FROM old)
    """,
)
def merged(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    old = o.filter("o_orderstatus = 'F'").drop("o_orderstatus").withColumn("origin", F.lit("existing"))
    new = o.filter("o_orderstatus <> 'F'").drop("o_orderstatus")
    new = new.withColumns({"origin": F.lit("new"), "note": F.lit("added")})
    return merge_keep_existing(old, new, "o_custkey", "o_orderkey", "o_orderkey")


@query(
    "class_union",
    """
    SELECT c_custkey AS id, 1 AS agn_type, c_acctbal AS snr FROM customer
    UNION ALL SELECT s_suppkey, 2, s_acctbal FROM supplier
    """,
)
def union(spark, sf_dir):
    folder = scratch_path(spark, "spectra")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("snr"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("snr"))
    c.write.parquet(folder + "/type1")
    s.write.parquet(folder + "/type2")
    return read_spectra(spark, folder + "/type1", folder + "/type2").select("id", "agn_type", "snr")


@query(
    "results_with_errors",
    """
    SELECT doc_id, n_chars::DOUBLE AS n_chars, NULL::VARCHAR AS error FROM documents WHERE lang = 'en'
    UNION ALL SELECT doc_id, NULL, 'language ' || lang FROM documents WHERE lang <> 'en'
    """,
)
def errors(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    good = d.filter("lang = 'en'").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"))
    bad = d.filter("lang <> 'en'").select("doc_id", F.concat(F.lit("language "), "lang").alias("error"))
    return with_errors(good, bad)


@query("category_counts", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def categories(spark, sf_dir):
    return category_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


@query(
    "catalogue_written_and_read",
    "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_quantity >= 5 GROUP BY 1",
)
def stored(spark, sf_dir):
    path = scratch_path(spark, "catalogue")
    df = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 2 + 1).cast("int").alias("agn_type"), F.col("l_quantity").alias("snr"), "l_returnflag"
    )
    write_catalogue(df, path, partition_by_class=True)
    back = read_catalogue(spark, path, ["l_returnflag", "snr"]).filter("snr >= 5")
    return back.groupBy("l_returnflag").agg(F.count("*").alias("n"), rnd(F.sum("snr"), 2).alias("quantity"))


@query(
    "predictions_csv_written_and_read",
    """
    SELECT o_orderkey AS sdssid, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 500000 END AS z,
           (o_orderstatus = 'F')::INT AS true_label, o_totalprice / 500000 AS prob_change FROM orders
    """,
)
def predictions(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    prob = F.col("o_totalprice") / 500000
    none = F.lit(None).cast("string")
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sdssid"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(prob).alias("z"),
        *[none.alias(c) for c in ("specname_dr16", "specname_sdssv", "dr16_path", "sdssv_path")],
        (F.col("o_orderstatus") == "F").cast("int").alias("true_label"),
        prob.alias("prob_change"),
        *[F.lit(0).alias(c) for c in ("pred_label", "is_false_positive", "is_false_negative")],
        F.array(F.lit(1.0)).alias("vector"),
    )
    write_csv(df, path)
    back = read_csv(spark, path, PREDICTION_SCHEMA)
    return back.select("sdssid", "z", "true_label", "prob_change")


@query(
    "survey_table_read",
    "SELECT vec_id, label, CASE WHEN label <> 3 THEN label / 2.0 END::DOUBLE AS half FROM embeddings",
)
def survey(spark, sf_dir):
    path = scratch_path(spark, "survey")
    half = F.when(F.col("label") == 3, F.lit(float("nan"))).otherwise(F.col("label") / 2.0)
    table(spark, sf_dir, "embeddings").withColumn("half", half).write.parquet(path)
    return read_survey_table(spark, path)


@query(
    "manifest_read",
    """
    SELECT conv_id * 100 + turn AS sdssid, turn / 10.0::DOUBLE AS z, (role = 'user')::INT AS label FROM conversations
    """,
)
def manifest(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    pair_manifest(spark, sf_dir).write.parquet(path)
    return read_manifest(spark, path).select("sdssid", "z", "label")


@query(
    "run_results_documents",
    """
    SELECT 'run_' || s_suppkey AS run_name, s_nationkey / 100.0::DOUBLE AS focal_alpha, s_suppkey AS tn, s_nationkey::BIGINT AS fp,
           s_acctbal AS macro_f1, s_name AS model_path FROM supplier
    """,
)
def run_documents(spark, sf_dir):
    """Result documents over several lines, with fields of the full schema missing, in summaries of a sweep's runs."""
    path = scratch_path(spark, "documents")
    metrics = F.struct(
        F.col("s_acctbal").alias("macro_f1"),
        F.array(F.array("s_suppkey", F.col("s_nationkey").cast("bigint")), F.array(F.lit(0), F.lit(1))).alias("confusion_matrix"),
    )
    runs = table(spark, sf_dir, "supplier").select(
        F.struct(
            F.concat(F.lit("run_"), "s_suppkey").alias("run_name"), (F.col("s_nationkey") / 100.0).alias("focal_alpha"),
            metrics.alias("test_metrics"), F.col("s_name").alias("model_path"),
        ).alias("run")
    )
    # a file holds the array of up to RUNS_PER_FILE documents: opening a file each costs more than all else
    number = F.floor(F.monotonically_increasing_id() / RUNS_PER_FILE)
    files = runs.groupBy(number.alias("file")).agg(F.collect_list("run").alias("runs"))
    files.select(F.to_json("runs", {"pretty": "true"}).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    back = read_run_results(spark, path)
    cells = F.col("test_metrics.confusion_matrix")
    return back.select(
        "run_name", "focal_alpha", cells[0][0].alias("tn"), cells[0][1].alias("fp"), "test_metrics.macro_f1", "model_path"
    )


@query(
    "run_results_json",
    """
    SELECT 'run_' || p_partkey AS run_name, p_size / 100.0::DOUBLE AS focal_alpha, p_partkey AS tn, p_size::BIGINT AS fp,
           p_retailprice AS macro_f1 FROM part
    """,
)
def run_results(spark, sf_dir):
    path = scratch_path(spark, "runs")
    size = F.col("p_size")
    metrics = F.struct(
        F.col("p_retailprice").alias("macro_f1"),
        F.array(F.array("p_partkey", size.cast("bigint")), F.array(F.lit(0), F.lit(1))).alias("confusion_matrix"),
    )
    runs = table(spark, sf_dir, "part").select(
        F.concat(F.lit("run_"), "p_partkey").alias("run_name"),
        (size / 100.0).alias("focal_alpha"),
        metrics.alias("test_metrics"),
    )
    write_json(runs, path)
    schema = (
        "run_name string, focal_alpha double, test_metrics struct<macro_f1: double, "
        "confusion_matrix: array<array<bigint>>>"
    )
    back = read_run_results(spark, path, schema, multi_line=False)
    cells = F.col("test_metrics.confusion_matrix")
    return back.select(
        "run_name", "focal_alpha", cells[0][0].alias("tn"), cells[0][1].alias("fp"), "test_metrics.macro_f1"
    )
