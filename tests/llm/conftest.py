import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, line string, fp string, epoch string, key string, _gone string, _last string, _id string, _row string, _judged string, _HOST string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null in every column, empty and blank texts, repeated rows, ties, one long text, and columns with names used inside."""
    prose = "the quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree tonight"
    rows = [
        (1, prose + "\n" + "unter den linden steht ein haus\n\nlast line of one", "en", "src1"),
        (2, prose + "\n" + "unter den linden stand ein haus", "de", "src2"),
        (3, None, "en", "src1"),
        (4, "", "en", "src1"),
        (5, " \t\n ", None, None),
        (6, "12345 %%% ###", "en", "src3"),
        (7, prose, None, "src1"),
        (7, prose, None, "src1"),
        (8, "\n".join(f"word{i % 7} again and again number {i} here" for i in range(400)), "en", "src4"),
        (None, prose, "en", "src1"),
        (None, None, None, None),
        (9, "x" * 5000, "fr", "nosuffix"),
        (9, "another text under the same id with a few more words in it", "fr", "src5"),
        (10, "ü" * 40 + " ñandú 東京 \U0001f600 fin", "es", "src6"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "w", "l", "f", "e", "k", *"abcdef") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
