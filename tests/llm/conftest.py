import random

import pytest

SF = "/root/testdata/sf0.001"
#: Columns of the operators' own results and inner tables; as extra input columns they must not matter.
CLASHING = "row key score size component_id shard fp start end kind copy_no host n_words blob mask".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    long = " ".join(rng.choices(words, k=30_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \t\n\x0b ", None, "a", 5), (None, "lost words of nobody", "en", "b", 20),
        (4, long, "en", "a", len(long)), (5, "same text twice over", "de", "b", 20), (6, "same text twice over", "de", "b", 20),
        (6, "same text twice over", "de", "b", 20), (7, "x" * 70_000, "en", None, 70_000), (8, "é ß 漢字 😀 ünïcode\x1cword\xa0here", "fr", "c", 25),
        (9, "one", "en", "a", 3), (None, None, None, None, None),
    ]
    for i in range(10, 60):
        text = " ".join(rng.choices(words, k=rng.randint(1, 200)))
        rows.append((i, text, "en", rng.choice("abc"), len(text)))
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows(), SCHEMA)
    return df.withColumns({c: F.lit("other") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
