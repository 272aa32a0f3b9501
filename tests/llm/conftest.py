import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, `rank.x` int, kept string, " \
       "target string, epochs string, rid string, comp string, id string, c0 string, grp string"


def doc(i, text, lang="en", source="s"):
    """A row of documents with further columns whose names clash with the operators' own."""
    return (i, text, lang, source, None, "big", 7, "yes", "t", "e", "r", None, "x", "c", "g")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty and blank texts, a very long text, ties, repeated rows."""
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [doc(1, same), doc(1, same), doc(2, same.upper()), doc(3, None), doc(4, ""), doc(5, " \t\n"), doc(6, "word"),
            doc(None, same), doc(None, None, None, None), doc(7, "Der schöne Baum " * 20_000, "de", None),
            doc(8, "12 34 %% ##", None, "t"), doc(9, "The tree and the house", None, "t")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
