"""Corpus cleaning in stages, each written as Parquet and read again by the next.

    quality rules -> line dedup -> near-duplicates -> secrets -> packing

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of `documents`; only the
last one returns pieces of packed windows. `run` applies them all.

* quality rules: rejected documents go;
* line dedup: blocks of lines that an earlier document has are cut; a document of which nothing is left
  goes, one that was blank before stays;
* near-duplicates (five words, similarity 0.8): the smallest id of each group stays;
* secrets: every span found is replaced by a mark;
* packing: windows of 2,048 tokens.

NULL ids, NULL texts, repeated rows and empty tables behave as the operators say.
"""

from pyspark.sql import functions as F

from spectraloom.llm import linededup, minhash, packing, quality, secrets
from spectraloom.llm.names import free_name
from spectraloom.session import scratch_path


def quality_rules(spark, docs, sf_dir):
    return quality.keep_good(docs)


def line_dedup(spark, docs, sf_dir):
    removed = free_name("_n_removed", docs.columns)
    cut = linededup.cut_shared_blocks(docs, removed=removed)
    left = (F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = cut.filter(left)
    if "n_chars" in cut.columns:
        n = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", n.cast(dict(docs.dtypes)["n_chars"]))
    return cut.drop(removed)


def near_dedup(spark, docs, sf_dir):
    """Documents that are the smallest of their group, and rows without an id.

    Rows that repeat an id are one document: they stay or go together.
    """
    gone = minhash.near_duplicates(docs, width=5, percent=80).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def secret_scans(spark, docs, sf_dir):
    found = free_name("_found", docs.columns)
    clean = secrets.redact_secrets(docs, found=found)
    if "n_chars" in clean.columns:
        n = F.when(F.col(found), F.length("text")).otherwise(F.col("n_chars"))
        clean = clean.withColumn("n_chars", n.cast(dict(docs.dtypes)["n_chars"]))
    return clean.drop(found)


def pack(spark, docs, sf_dir):
    import public_tokenizers  # needed by this stage alone

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: robust estimates, alignment and tokenizers are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`; what a stage returns is stored in the shared folder first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
