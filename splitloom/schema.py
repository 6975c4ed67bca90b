"""Canonical schemas. Attributes a corpus does not have are NULL."""

DOCUMENTS = (
    "doc_id BIGINT, corpus STRING, author STRING, language STRING, category STRING, "
    "genre STRING, topic STRING, title STRING, chunk INT, problem STRING, "
    "data_type STRING, text_path STRING, stanza STRING, text STRING"
)
SPLITS = "config_id STRING, split_id STRING, role STRING, doc_id BIGINT, target STRING"
FOLDS = "doc_id BIGINT, target STRING, fold BIGINT"
CONFIGS = (
    "config_id STRING, loader STRING, path STRING, domain STRING, test_domain STRING, "
    "train_values ARRAY<STRING>, test_values ARRAY<STRING>, problem STRING, "
    "test_language STRING, n_splits INT, max_targets INT, max_docs_per_target INT"
)
FILES = "path STRING, content BINARY"
