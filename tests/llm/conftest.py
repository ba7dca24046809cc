"""Small tables with every awkward case: nulls in all columns, empty and very long texts, ties, repeated rows, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHING = ("key", "node", "kept", "bucket", "words", "body", "hash", "label", "bins", "host", "path", "row", "runs", "text_key", "place", "k", "d",
            "component_id", "spans", "ids", "gone_id", "gone_key", "linked_spans", "all_spans", "times")


def prose(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghijklmnop") + str(r.randrange(vocabulary)) for _ in range(n))


def awkward_rows():
    base = prose(120, 1)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base, "en", "s0", 1), (2, base, "en", "s0", 1), (3, " ".join(near), None, None, None), (4, None, "en", "s0", 0), (5, "", None, "s1", 0),
        (6, " \n\t ", "en", "s0", 4), (7, "one two three", "en", "s0", 3), (8, "one two three", "en", "s0", 3), (9, prose(20000, 2, 10 ** 6), "en", "s0", 5),
        (10, "repeat " * 300, "en", "s0", 5), (11, prose(80, 3), "en", "s0", 5), (11, prose(80, 3), "en", "s0", 5), (11, prose(90, 4), "fr", "s0", 5),
        (None, base, "en", "s0", 5), (None, prose(70, 5), None, None, None), (None, prose(70, 5), None, None, None), (None, None, None, None, None),
        (12, "Ünïcödé 🙂   x y " + prose(40, 6), "de", "s2", 7), (13, "a\nb\na\nb\n" + prose(50, 7), "en", "s0", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
