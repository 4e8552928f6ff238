import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        # names that the operators use inside
        T.StructField("n_words", T.StringType()),
        T.StructField("doc", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def texts(seed=3):
    """Texts with copies, near copies, shared passages, long, short, empty, blank and null ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(40)
    out = [None, "", " \n\t ", "one", "one two", "one\n\none", "  lead and trail  "]
    out += ["\n".join(prose(rng.randint(3, 30)) for _ in range(rng.randint(1, 6))) for _ in range(25)]
    base = "\n".join(prose(25) for _ in range(4))
    for _ in range(8):  # near copies: a few words differ
        w = base.split(" ")
        w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    out += [base] * 4
    out += [f"{prose(10)} {passage} {prose(9)}" for _ in range(6)]
    out += [prose(5000), "word " * 300, "x" * 5000, prose(15).upper() + "!! " + prose(10).upper()]
    out += [prose(30) + " ### $$$ %%% " * 40, "Released under the MIT License.\n" + prose(20)]
    return out


@pytest.fixture(scope="session")
def rows():
    return list(enumerate(texts()))


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "clash", "clash", "clash", "clash", len(t or "")) for k, t in rows], DOCS)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def repeated(spark, rows):
    """Rows that occur twice, and an id that is null."""
    out = frame(spark, rows[:20])
    return out.union(out).union(spark.createDataFrame([(None, "no id here", "en", None, None, None, None, 10)], DOCS))
