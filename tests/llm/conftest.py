from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, did int, pos string, fp string, h int, line string, host string"


@pytest.fixture
def make_docs(spark):
    """Documents with further columns whose names the operators use inside."""

    def make(*texts, ids=None, lang="en", source="s"):
        rows = []
        for i, text in enumerate(texts):
            key = ids[i] if ids else i
            rows.append((key, text, lang, source, None if text is None else len(text), 7, "p", "f", 1, "l", "x"))
        return spark.createDataFrame(rows, DOCS)

    return make
