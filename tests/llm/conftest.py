import duckdb
import pytest


@pytest.fixture(scope="session")
def documents(sf_dir):
    """(doc_id, text, lang, source) of the smallest documents table."""
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()
