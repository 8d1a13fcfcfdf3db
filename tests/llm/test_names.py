from spectraloom.llm import linededup, pieces, secrets
from spectraloom.llm.names import free_name

SCHEMA = "doc_id bigint, text string, n_removed string, Has_Secret string, has_secret_ string, decoded int, ids binary"


def test_underscores_until_free():
    assert free_name("a", ["b"]) == "a" and free_name("a", ["A", "a_"]) == "a__"


def test_results_beside_columns_of_their_name(spark):
    rows = [(1, "password = hunter2hunter2", "x", "y", "z", 1, b"")]
    docs = spark.createDataFrame(rows, SCHEMA)
    cut = linededup.cut_shared_blocks(docs)
    assert cut.columns == [*docs.columns, "n_removed_"] and cut.select("n_removed", "n_removed_").first() == ("x", 0)
    clean = secrets.redact_secrets(docs)
    assert clean.columns == [*docs.columns, "has_secret__"] and clean.first()["has_secret__"] is True
    import public_tokenizers

    back = pieces.decode_pieces(docs.withColumn("ids", docs.ids.substr(1, 0).cast("binary")).withColumnRenamed("Has_Secret", "h"), public_tokenizers.path("piece_bpe_32k.model"))
    assert back.columns[-1] == "decoded_" and back.first()["decoded"] == 1
