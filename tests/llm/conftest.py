import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use themselves.
CLASHING = DOCS + ", row string, ids string, decoded string, score double, lang_ string, size int, copies int, key int, id int, sha int, toxic int, spans int, kept int"


@pytest.fixture
def documents(spark):
    return lambda: spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows; clashing=True adds columns named like the operators' own."""
    def make(*rows, clashing=False):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "a", None) for r in rows]
        ddl = CLASHING if clashing else DOCS
        return spark.createDataFrame([r + (None,) * (ddl.count(",") - 4) for r in full], ddl)
    return make


#: Nulls, blanks, ties, repeats, a long word and a long text.
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "One two three four five six."), (5, "one two three four five six."), (5, "one two three four five six."),
       (None, "one two"), (6, "x" * 5000), (7, "word " * 6000), (8, "é 日本 ı\x00 end"), (9, "one two")]


@pytest.fixture
def odd():
    return list(ODD)
