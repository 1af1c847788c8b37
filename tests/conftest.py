from __future__ import annotations

import pytest

from gleanery.model import ARTICLE_SCHEMA
from gleanery.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.maxMetadataStringLength": "1000",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def make_articles(spark):
    """Article rows from partial dicts; id, url and collection date are filled in."""

    def make(*rows: dict):
        full = []
        for i, row in enumerate(rows, 1):
            base = dict.fromkeys(ARTICLE_SCHEMA.names)
            base.update(id=i, titre=f"A{i}", url=f"https://x/a{i}", source="dev.to", tags="[]")
            base["date_collecte"] = "2026-01-01T00:00:00.000Z"
            base.update(row)
            full.append(tuple(base[c] for c in ARTICLE_SCHEMA.names))
        return spark.createDataFrame(full, ARTICLE_SCHEMA)

    return make


def as_tuples(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]
