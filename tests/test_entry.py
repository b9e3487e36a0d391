import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["bm25_filtered", "bm25_phrase", "filter_date_range", "cosine_knn", "rrf_fusion", "snapshot_diff", "rescan_stale_files", "session_coalesce", "rename_pairing", "feature_hash_embedding", "bm25_scan", "index_maintenance", "hybrid_search", "coalesced_batches", "fingerprint", "embedding_weights", "mutation_batch_documents", "retrieval_quality", "result_labels"]


def clean(v):
    if v is None or v != v:
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = entry.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    found = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    mine = sorted(([clean(r[c]) for c in columns] for r in got.collect()), key=str)
    theirs = sorted(([clean(dict(zip(names, r, strict=True))[c]) for c in columns] for r in found.fetchall()), key=str)
    assert mine == theirs and not any(isinstance(x, float) and math.isnan(x) for r in mine for x in r)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
