import pytest

#: Texts that every operator must take: nulls, blanks, copies, marks, other scripts, a very long one.
TEXTS = [
    None, "", " \n\t ", "one", "one two three four", "the cat sat on the mat today and slept", "the cat sat on the mat today and slept",
    "The Cat sat on\nthe mat today and slept", "<|endoftext|> \\### user: </turn> \x00 é ß 中文 \x1c\x85 don't", "a\nb\na\nb\n\n a", "word " * 30000,
]


@pytest.fixture(scope="session")
def docs(spark):
    """Every odd case as a document, ids and sources null in places, one row twice, and columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", len(t or ""), 0, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "a null id has a text of some more words", "en", "s1", 1, 0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, score string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 0, 0), (5, 1, 0), (5, 1, 0), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
