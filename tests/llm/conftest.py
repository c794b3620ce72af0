import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, size bigint, n_tokens string, spans string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every kind of trouble: nulls, empty and long texts, ties, repeated rows, columns whose names clash."""
    r = random.Random(5)
    words = ["the", "of", "and", "ing", "thtion", "ñandú", "Größe", "été", "password=abc123XYZ", "AKIA" + "Q7" * 9, "0123456789abcdef0123456789abcdef", "x.", "<|endoftext|>", "\U0001f600"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(k, text(r.randint(1, 60)), r.choice(["en", "de", None]), r.choice(["a", "b", "c", None])) for k in range(60)]
    rows += [(100, None, "en", "a"), (101, "", "en", "a"), (102, " \t\n", None, "b"), (103, "one", "de", "b"), (104, "one two", "de", "b"), (None, "no id here", "en", "c"), (None, None, None, None)]
    rows += [(105, text(30_000), "en", "a"), (106, "!" * 5000, "en", "a"), (107, "token: " + "a" * 3000, "en", "a"), (3, rows[3][1], rows[3][2], rows[3][3]), (3, rows[3][1], rows[3][2], rows[3][3])]
    rows += [(200 + k, rows[5][1], "en", "z") for k in range(30)]
    return spark.createDataFrame([(*x, len(x[1] or ""), "fp", 1, "n", "s") for x in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """200 documents of invented words with exact and near copies."""
    r = random.Random(9)
    vocabulary = ["".join(r.choice(["th", "er", "on", "an", "re", "in", "st"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 200))) for _ in range(150)]
    for k in range(50):
        base = texts[k % 10].split()
        if k % 2:
            base[r.randrange(len(base))] = "changed"
        texts.append(" ".join(base))
    return spark.createDataFrame([(k, t, "en", f"src{k % 5}", len(t)) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").cache()
