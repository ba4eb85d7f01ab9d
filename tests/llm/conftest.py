from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) with columns whose names operators use themselves."""

    def made(rows, **more):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, 7, "x", True) for r in rows]
        return spark.createDataFrame(full, DOCS + ", size long, digest string, kept boolean").withColumnsRenamed(more).repartition(3)

    return made


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes tables as a folder that queries read."""

    def written(**frames):
        place = tmp_path_factory.mktemp("tables")
        for name, df in frames.items():
            df.write.parquet(f"{place}/{name}.parquet")
        return str(place)

    return written
