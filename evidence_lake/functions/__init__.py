from .hashing import batch_digest, event_key, line_sha256, ordered_digest
from .jsonl import is_json_object, parse_error_payload
from .redaction import apply_rule, count_rule
from .ticks import tick_end_ns, tick_index, tick_start_ns
from .timestamps import parse_ts_ns

__all__ = [
    "apply_rule",
    "batch_digest",
    "count_rule",
    "event_key",
    "is_json_object",
    "line_sha256",
    "ordered_digest",
    "parse_error_payload",
    "parse_ts_ns",
    "tick_end_ns",
    "tick_index",
    "tick_start_ns",
]
