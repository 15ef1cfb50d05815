import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, long, tied and repeated rows, and columns whose names clash with inner ones."""
    from pyspark.sql import functions as F

    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [
        (1, base), (2, base), (2, base), (3, base + " phi"), (4, None), (5, ""), (6, " \n\t"), (7, "one two"), (8, "one two"),
        (None, base), (None, "Mail me: jo@mail1.example.com or +1 (555) 555-0199 190.1.2.3 now"), (9, "word " * 60_000), (10, "x" * 1_300_000), (11, "été <|endoftext|> 日本 🙂 don't"),
        (12, "Card 4111111111111111 4111 1111 1111 1112, ip 10.0.0.256 10.0.0.25"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = ["node", "sig", "keys", "bucket", "shard", "slot", "_row", "weight", "key", "text_hash", "row", "k", "h", "id", "selected", "kept", "_text", "found", "n_chars"]
    return df.select("*", *(F.lit(1).alias(c) for c in clash))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark):
    from paths import SF

    return spark.read.parquet(f"{SF}/documents.parquet")
