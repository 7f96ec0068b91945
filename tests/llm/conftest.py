import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="session")
def prose():
    """Documents with exact and near copies, shared passages, edge texts; ids in no order."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(400)] + ["Ünï", "漢字", "x<s>"]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [make(rng.randint(60, 160)) for _ in range(60)]
    for k in range(25):
        near = list(texts[k % 5])
        for _ in range(rng.randint(0, 8)):
            near[rng.randrange(len(near))] = rng.choice(words)
        texts.append(near)
    passage = make(45)
    for k in range(30, 50):
        at = rng.randrange(len(texts[k]))
        texts[k][at:at] = passage[rng.randrange(5) : rng.randint(30, 45)]
    texts += [texts[0]] * 3 + [make(1), make(2), make(2), make(3), make(19), make(20)]
    texts.append(make(10) * 6)
    joined = [(" " if k % 3 else "\n").join(t) for k, t in enumerate(texts)]
    joined += ["", None, " \t\n ", "one", "one", "  Two  spaces \x0b here ", "ONE"]
    ids = list(range(100, 100 + len(joined)))
    rng.shuffle(ids)
    return list(zip(ids, joined, strict=True))


@pytest.fixture
def docs(spark, prose):
    return spark.createDataFrame(prose, SCHEMA)


@pytest.fixture
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)
