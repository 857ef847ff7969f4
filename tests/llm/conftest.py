"""Documents with everything that may go wrong."""

import pytest
from pyspark.sql import Row

LONG = "again and again the same words come back " * 900
LINE = "this passage of well over one hundred bytes stands in many documents of the corpus and has to be found in each of them. "


def tricky_rows():
    base = [
        (1, None), (2, ""), (3, ""), (4, "   \n\t"), (5, "word"), (6, "four words stand here"),
        (7, "the quick brown fox jumps over the lazy dog and runs away from the farm. " * 3),
        (8, "the quick brown fox jumps over the lazy dog and runs away from the farm. " * 3),
        (9, "The quick brown fox jumps over the lazy dog and runs away from the farm! " * 3),
        (9, "The quick brown fox jumps over the lazy dog and runs away from the farm! " * 3),
        (None, "a row without an id, which has words of its own to say about the weather today"),
        (None, "a row without an id, which has words of its own to say about the weather today"),
        (10, LONG), (11, "unlike start. " + LONG), (12, "émigré façade ñandú 你好 😀 ▁ x  y z"),
        (13, "head one " + LINE + "tail one"), (14, "another head " + LINE + "another tail"), (15, LINE + LINE),
        (16, "<0x0A> <unk> </s> &amp; | ## ||| !!!"),
    ]
    return [Row(doc_id=i, text=t, lang=None, source="s", n_chars=None, key="k", row=1, content=b"c", label=0, label_="x", kept=True) for i, t in base]


@pytest.fixture(scope="session")
def tricky(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, content binary, label int, label_ string, kept boolean"
    return spark.createDataFrame(tricky_rows(), shape)


@pytest.fixture(scope="session")
def nothing(tricky):
    return tricky.where("false")
