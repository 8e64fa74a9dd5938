import pytest


def text(k, n=80, salt="w"):
    """n words that depend on k."""
    return " ".join(f"{salt}{(k * 7919 + i * i * 31 + i) % 9973}" for i in range(n))


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, shared passages, repeats, unusual characters, empty and null texts."""
    shared, hot = text(900, 45), "buy now " * 12
    out = [text(k) for k in range(12)]
    out += [text(1), text(1), text(2) + " tail", text(3).upper(), "", None, "   \t\n", "one", "one two", "a b c"]
    out += [f"{text(20 + k, 30)} {shared} {text(40 + k, 30)}" for k in range(6)]
    out += [hot * 3, hot * 3 + " end", "x\ny\nx\n\n z\nz\n#*$%&|<>", "é ü ñ — “q” 漢字 " * 30, "z" * 3000, "ab" * 900, "a\u00a0b\u2003c \x0b\x0c\x1c d" * 20]
    out += [shared, shared + " " + shared, (text(5) + "\n") * 3, "line one here\n" * 70]
    return [(3 * i + 1, t) for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names clash with those that operators use."""
    data = [(d, t, None if d % 5 == 0 else f"host{d % 3}", d, d, "x") for d, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, source string, n_words long, hash long, body string").repartition(3, "doc_id")


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="session")
def nulls(spark, docs):
    """Every column null, in rows that repeat."""
    return spark.createDataFrame([(None, None, None, None, None, None)] * 2 + [(None, text(1), None, None, None, None)] + [(7, text(2), "h", None, None, None)] * 2, docs.schema)
