import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use themselves
        T.StructField("id", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("text_hash", T.StringType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def rows_of(texts):
    """(doc_id, text) or (doc_id, text, lang, source) as full rows."""
    out = []
    for row in texts:
        doc_id, text, lang, source = (*row, "en", "a")[:4] if len(row) == 2 else row
        out.append((doc_id, text, lang, source, None if text is None else len(text), "x", None, 7, "h", True))
    return out


@pytest.fixture(scope="session")
def frame(spark):
    return lambda texts, parts=3: spark.createDataFrame(rows_of(texts), SCHEMA).repartition(parts)


@pytest.fixture(scope="session")
def corpus():
    """Texts with nulls, empty and long ones, exact and near copies, shared passages, and case changes."""
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["Été", "straße", "ñandú"]
    some = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passage, long = some(70), some(3000)
    base = some(120)
    texts = [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "one two"), (5, "One  TWO")]
    texts += [(10 + i, base) for i in range(12)]
    for i in range(15):
        changed = base.split()
        for _ in range(i % 5):
            changed[draw.randrange(len(changed))] = "changed"
        texts.append((40 + i, " ".join(changed)))
    texts += [(70 + i, f"{some(30)} {passage}\n{some(10)}") for i in range(10)]
    texts += [(90, long), (91, long), (92, long + " tail"), (93, f"{passage} {passage}")]
    texts += [(100 + i, some(draw.choice([5, 49, 50, 51, 200]))) for i in range(20)]
    return texts
