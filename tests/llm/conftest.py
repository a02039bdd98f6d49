import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_llm import edited, prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, _key string"


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, short and long texts, copies, near copies, repeated rows, null ids and sources."""
    base = prose(1, 300)
    texts = [None, "", " \n\t ", "one", "two words", base, base, edited(base, 3, 2), edited(base, 4, 40), prose(9, 20_000)]
    texts += [prose(20 + k, 120) + "\n" + prose(7, 60) for k in range(12)]
    rows = [(k, t, "en", f"s{k % 4}" if k % 5 else None, len(t or ""), 1, "x") for k, t in enumerate(texts)]
    rows.append(rows[5])
    rows.append((None, "no id here " * 40, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same as a table, with columns that clash with names the operators use."""
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
