from __future__ import annotations

import pytest
from pyspark.sql import functions as F

KIND = "doc_id long, text string, lang string, source string, n_chars long"
REPEAT = "This passage of more than one hundred bytes stands in several documents, and each but the first of them has to lose it. "
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i * i % 997} {WORDS[i % 90 : i % 90 + 9]}" for i in range(20_000))
    out = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "x", "en", None, 1), (5, "ñandú été 中文 😀", None, "s", 1), (6, REPEAT + "end one", "en", "s", 1),
        (7, "start two " + REPEAT, "en", "s", 1), (8, REPEAT * 3, "de", "s", 1), (9, WORDS * 3, "en", "s", 1), (10, WORDS * 3, "en", "t", 1), (11, WORDS * 3 + " once", "en", "s", 1), (12, long, "en", "s", 1),
        (13, long[:5000] + "!", "en", "s", 1), (14, "a" * 1000, "en", "s", 1), (15, "ab" * 400, "en", "s", 1), (16, "é" * 300, "fr", "s", 1), (17, "\x00\x01 odd \x1c bytes <|endoftext|> <|im_end|>", "en", "s", 1),
    ]
    return out


def clashing(df):
    """Extra columns with the names that operators use inside."""
    for c in ("row", "uid", "key", "kind", "q", "l", "print", "component_id", "entries", "gone", "bucket", "length", "ids", "kept", "words", "rank", "host", "fine", "coarse", "x1", "p", "nth", "kept_id"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def docs(spark):
    return clashing(spark.createDataFrame(rows(), KIND).repartition(3)).cache()


@pytest.fixture(scope="session")
def repeated(spark):
    """Null and repeated doc_ids, repeated rows."""
    some = rows()[5:11]
    return clashing(spark.createDataFrame([*some, *some, (None, REPEAT + "null one", "en", "s", 1), (None, REPEAT + "null two", None, None, 1), (6, "another text of six", "en", "s", 1)], KIND)).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
