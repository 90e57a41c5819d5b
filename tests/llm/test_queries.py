import os

import pytest

from driftlab.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
TABLE = {"op1": "pages", "op5": "pages", "op8": "conversations", "op11": "embeddings", "op12": "embeddings"}
#: what the queries must return at least: column -> type
CONTRACT = {
    "op1": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op2": {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"},
    "op3": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op4": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op6": {"doc_id": "bigint", "contaminated": "boolean", "item_ids": "array<bigint>"},
    "op7": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op8": {"conv_id": "bigint", "turn": "bigint", "role": "string", "json": "string"},
    "op9": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op10": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op11": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
    "op12": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
    "op13": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
}


def test_one_query_for_each_operator():
    assert sorted(q.split("_")[0] for q in Q.queries()) == sorted(CONTRACT)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", Q.queries())
def test_whole_table_and_columns(spark, name):
    n = name.split("_")[0]
    out = Q.queries()[name](spark, SMALL)
    kinds = dict(out.dtypes)
    assert {c: kinds.get(c) for c in CONTRACT[n]} == CONTRACT[n]
    assert out.count() == spark.read.parquet(f"{SMALL}/{TABLE.get(n, 'documents')}.parquet").count()
