import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "k long, t long, n int, bucket int, words string, size long, shard int, o long, piece int, score double, spans string, start long, length long, number long, tokens string, key string, text_key string, mixture string, grp long, node long, c string, m long, items string, url string"


def _edge_rows():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    passage = prose(40)
    texts = [
        (1, None), (2, ""), (3, "   \n\t"), (4, "word"), (5, "two words"), (6, base), (7, base), (7, base), (8, " ".join(near)),
        (9, base), (10, prose(30) + " " + passage + " " + prose(30)), (11, prose(25) + " " + passage), (12, "12345 !!! ???"),
        (13, "ÄÖÜ éàè 漢字 😀 " * 5), (14, "x" * 5000), (15, "ab " * 3000), (16, prose(20000)), (None, prose(50)), (17, "password = abcdef123456 and bob.ray77@mail.example.com, again bob.ray77"),
        (18, "AKIA" + "A1B2C3D4E5F6G7H8" + " deadbeefdeadbeefdeadbeef01"), (19, "call +1 (212) 555-0100 or 212-555-0100; 10.0.0.1; 4111 1111 1111 1111"), (20, "a@b"), (21, "\x00\x01 control \x7f"), (8, "another text under an id that is taken " + prose(30)),
    ]
    return [(i, t, None if (i or 0) % 3 == 0 else "en", None if (i or 0) % 4 == 0 else f"s{(i or 0) % 3}", None) for i, t in texts]


@pytest.fixture(scope="session")
def edge_rows():
    return _edge_rows()


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """Nulls, empty and long texts, copies, repeated rows and ids, and columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows, SCHEMA).repartition(3)
    for field in EXTRA.split(", "):
        name, kind = field.split(" ")
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
