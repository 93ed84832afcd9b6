"""Declared schemas (as DDL) of every table that is read or written. Nothing is inferred."""

from __future__ import annotations

import re

RAW_LINE = "line STRING, file STRING, split_start BIGINT, row_in_split BIGINT"
PARSED_LINE = (
    "date STRING, time STRING, timestamp TIMESTAMP, block_id STRING, cluster_id INT, event_id INT"
)
BLOCK_LABEL = "BlockId STRING, Label STRING"
EVENT_TRACES = (
    "BlockId STRING, Label STRING, Type STRING, Features STRING, TimeInterval STRING, Latency DOUBLE"
)
TEMPLATES = "EventId STRING, EventTemplate STRING"
SEQUENCE = "block_id STRING, chunk BIGINT, sequence ARRAY<INT>"
WINDOW_ONE_STEP = "block_id STRING, start BIGINT, window ARRAY<INT>, target INT"
WINDOW_MANY = "block_id STRING, start BIGINT, window ARRAY<INT>, target ARRAY<INT>"
DATASET_META = (
    "target_mode STRING, window_size INT, stride INT, train_windows BIGINT, val_windows BIGINT, "
    "test_windows BIGINT, event_vocab_size INT, unknown_event_id INT, train_blocks BIGINT, "
    "val_blocks BIGINT, test_blocks BIGINT, val_anomaly_blocks BIGINT, test_anomaly_blocks BIGINT"
)
BLOCK_SCORE = (
    "block_id STRING, y_true INT, num_windows BIGINT, score DOUBLE, window_score_max DOUBLE, "
    "split STRING, strategy STRING"
)
MISS_SCORE = "block_id STRING, y_true INT, score DOUBLE, num_windows BIGINT, num_misses BIGINT"
METRICS = (
    "model STRING, threshold DOUBLE, f1 DOUBLE, precision DOUBLE, recall DOUBLE, fpr DOUBLE, "
    "average_precision DOUBLE, tn BIGINT, fp BIGINT, fn BIGINT, tp BIGINT"
)
THRESHOLDS = (
    "model STRING, strategy STRING, threshold_strategy STRING, threshold DOUBLE, validation_best_f1 DOUBLE"
)
RUN_HISTORY = (
    "epoch ARRAY<INT>, train_loss ARRAY<DOUBLE>, val_loss ARRAY<DOUBLE>, is_best ARRAY<BOOLEAN>, "
    "best_epoch INT, best_val_loss DOUBLE"
)
REQUEST_HISTORY = (
    "id BIGINT, profile_id BIGINT, created_at TIMESTAMP, block_id STRING, status_code INT, "
    "processing_ms DOUBLE, num_log_lines INT, num_events INT, num_windows INT, score DOUBLE, "
    "threshold DOUBLE, is_anomaly BOOLEAN, error_message STRING"
)
#: The stored password hash is left out on purpose, so it can never be read.
PROFILE = (
    "id BIGINT, email STRING, status STRING, role STRING, created_at TIMESTAMP, version INT"
)
REQUEST_LOG = (
    "request_id STRING, http_method STRING, http_path STRING, client_ip STRING, status_code INT, "
    "duration_ms DOUBLE, level STRING, service STRING, environment STRING"
)
RATE_RULE = "scope STRING, limit STRING, failure_mode STRING"
PREDICT_REQUEST = (
    "block_id STRING, log_lines ARRAY<STRING>, return_event_ids BOOLEAN, return_window_scores BOOLEAN"
)


def occurrence_schema(events: int) -> str:
    """Schema of the wide block-by-event count table for ``events`` event ids."""
    return ("BlockId STRING, Label STRING, Type STRING, " + ", ".join(f"E{i} INT" for i in range(1, events + 1)))


def event_columns(columns: list[str]) -> list[str]:
    """The per-event count columns among ``columns``, in numeric order."""
    return sorted((c for c in columns if re.fullmatch(r"E[0-9]+", c)), key=lambda c: int(c[1:]))
