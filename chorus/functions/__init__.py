"""Column expressions (all JVM-side built-ins, usable inside whole-stage codegen)."""

from .text import words, strip_emoji, char_length, token_length  # noqa: F401
from .links import is_video_link, video_key  # noqa: F401
from .scalar import (  # noqa: F401
    argmax, decode_label, encode_label, engagement_rate, log_base, parse_iso_timestamp,
    report_round, correct_flag, sentiment_order,
)
