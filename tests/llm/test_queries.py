"""The registered queries against their SQL, whole tables."""

from __future__ import annotations

import os

import pytest

from lorekeep.llm.queries import QUERIES, SQL
from tests.compare import connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_columns(spark, name):
    want = {
        "op1_decontamination": {"doc_id": "bigint", "item_id": "bigint", "edits": "int"},
        "op6_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op7_suffix_dedup": {"doc_id": "bigint", "start": "bigint", "n_words": "bigint", "earlier_doc_id": "bigint", "earlier_start": "bigint"},
        "op8_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
        "op10_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
        "op11_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op13_whitening": {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double", "deviation_text": "string"},
    }[name]
    df = QUERIES[name](spark, FOLDER)
    assert dict(df.dtypes) == want and df.count() > 0
