import re

import pytest

SPACED = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i // 50}" for i in range(30_000))
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def words(text):
    return SPACED.findall(text or "")


def tokens(text):
    return ALNUM.findall((text or "").translate(LOW))


ROWS = [
    (1, f"{WORDS} first tail one", "en", "a"),
    (2, f"{WORDS} first tail one", "en", "a"),
    (2, f"{WORDS} first tail one", "en", "a"),
    (3, f"{WORDS} first tail two", "en", None),
    (4, None, "en", "a"),
    (5, "", None, "b"),
    (6, " \t\n\x0b", "fr", "b"),
    (7, LONG, "en", "c"),
    (8, f"{LONG} more", "en", "c"),
    (9, "one two", None, None),
    (10, "One two", "fr", "c"),
    (None, f"{WORDS} first tail one", "fr", "c"),
    (11, "é ü x   Ünïcode \U0001f600 MIT License", "fr", "c"),
    (12, "dup line\ndup line\n\nother\ndup line", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASH = ("kept", "base_failed", "size", "law", "shard", "slot", "domain", "copies", "n_tokens", "quality_stats", "own_tag", "emptied", "_id", "_key", "rest", "rid", "rtag", "own", "row.x", "text.a")


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark, edge):
    from pyspark.sql import functions as F

    return edge.withColumns({c: F.lit("own") for c in CLASH} | {"a map": F.create_map(F.lit("k"), F.col("doc_id"))})


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()
