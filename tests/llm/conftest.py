import random

import pytest
from pyspark.sql import functions as F

CLASHES = ["a", "b", "key", "node", "component", "seeds", "kept", "n", "ids", "queue", "part", "own", "low", "row"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def make_rows():
    """Documents with every odd case: nulls, blanks, copies, near copies, shared passages, one long word."""
    r = random.Random(5)
    passage, long = words(r, 70), words(r, 400)
    texts = [words(r, r.randrange(20, 300)) for _ in range(40)]
    texts += [passage + " " + words(r, 30), words(r, 30) + "\n" + passage, passage, long, long + " end", "start " + long]
    near = long.split()
    for k in range(12):
        changed = list(near)
        changed[k * 20] = f"other{k}"
        texts.append(" ".join(changed))
    texts += [None, "", "   \n\t ", "one two three", "one two three", "x" * 5000, "é" * 300, "ab" * 300, "a\x0bb\x0cc d e"]
    texts += [texts[3]] * 6
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 5}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[3], None, None, None), (None, None, None, None, None), (5, "same id, other text", None, "hot", None)]
    return rows


ROWS = make_rows()


@pytest.fixture(scope="session")
def docs(spark):
    """The odd documents with further columns whose names clash with the operators' own."""
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return ROWS
