"""Column functions: every one returns a ``Column`` that stays inside the JVM."""

from .irt import inv_logit, irf, linear_predictor, monotonic
from .scalar import (
    PERCENTILE_BREAKS,
    case_when,
    extract_na,
    fmt_estimate,
    fmt_num,
    fmt_pct,
    if_else_na,
    normal_breaks,
    reverse_score,
    round_even,
    sentence_case,
    share_matching,
    title_case,
    to_bool,
    to_int,
    to_ts,
    wrap_text,
)

__all__ = [
    "PERCENTILE_BREAKS", "case_when", "extract_na", "fmt_estimate", "fmt_num", "fmt_pct",
    "if_else_na", "inv_logit", "irf", "linear_predictor", "monotonic", "normal_breaks",
    "reverse_score", "round_even", "sentence_case", "share_matching", "title_case", "to_bool",
    "to_int", "to_ts", "wrap_text",
]
