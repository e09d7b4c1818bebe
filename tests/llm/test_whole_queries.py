"""Queries on all rows of the smallest tables, against SQL and brute force."""

import hashlib

import pytest

from oracle import connect, same
from safespan.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    assert same(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLE[name]) > 0


def test_repeats_against_all_strings_of_fifty_bytes(spark):
    docs = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    first, want = {}, {}
    for key, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first.setdefault(t[i : i + 50], key) < key:
                gone[i : i + 50] = b"\x01" * 50
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        want[key] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op6_suffix_dedup(spark, SMALL).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 0
