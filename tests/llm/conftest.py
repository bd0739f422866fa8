import random

import pytest

EXTRA = ", n long, h long, size long, key string, id long, g string, component long, words string, rank int, score double, copies long, bands string, digest string"


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, source): prose, exact and near copies, junk, personal data, odd and empty texts, ties, one long text."""
    rng = random.Random(5)
    words = ["".join(rng.choice(("an", "the", "or", "ion", "ed", "ing", "sh", "ou")) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(rng.randint(60, 140)) + ("\n" + prose(20)) * (i % 3), f"s{i % 4}") for i in range(40)]
    base = rows[3][1].split(" ")
    for k in range(6):  # near copies, and copies of a copy
        other = list(base)
        other[7 * k + 2] = f"changed{k}"
        rows.append((100 + k, " ".join(other), "s1"))
    rows += [(120 + k, rows[5][1], "s2") for k in range(5)]
    rows += [
        (200, None, "s1"), (201, "", None), (202, " \t\n ", "s3"), (203, "word", None), (204, "one two three four", "s0"), (205, "One TWO three four", "s0"),
        (206, "Is " * 80, "s1"), (207, " ".join("x*** y### z$$$".split() * 30), "s1"), (208, "ÉTÉ À la plage — naïve “quotes” Σ end İ " * 20, "s2"),
        (209, prose(9000), "s2"), (210, "a" * 300_000, "s3"), (211, "<|endoftext|> x <|startoftext|>" * 3, "s3"), (212, "line one\nline one\nline one\n" * 20, "s3"),
        (213, "call +1 (708) 555-4315 or (708) 555-4315, mail bob.12@mail5.example.com 10.0.0.1, 300.1.1.1, 4111111111111111, 4111111111111112", "s0"),
    ]
    rows += [rows[8], rows[8]]  # repeated rows
    rows.append((None, "no id here but some words", "s0"))
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with further columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, s, *[None] * 13) for i, t, s in corpus], "doc_id long, text string, source string" + EXTRA)
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
