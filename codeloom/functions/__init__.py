"""Scalar column functions."""

from ..operators.graph import grade, is_entry, score_band, subsystem, top_directory
from ..operators.stats import any_word, capped, endpoint, fold_newlines, github_owner, is_pull, iso, line_range, overview_rank, role, route_methods, safe_name, slash_path, strip_location
from ..operators.text import contains_folded, line_count

__all__ = [
    "any_word", "capped", "contains_folded", "endpoint", "fold_newlines", "github_owner", "grade", "is_entry", "is_pull", "iso", "line_count", "line_range", "overview_rank", "role", "route_methods", "safe_name", "score_band", "slash_path", "strip_location", "subsystem", "top_directory",
]
