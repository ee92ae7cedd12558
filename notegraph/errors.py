"""Errors that callers can tell apart by code."""

from __future__ import annotations

# The error codes of the API.
CODES = frozenset(
    "repo_not_found doc_not_found version_not_found version_not_in_document slug_invalid path_invalid frontmatter_invalid "
    "filter_invalid link_config_invalid stale_prev create_conflict path_taken slug_taken forbidden payload_too_large "
    "semantic_unavailable precondition_required body_placeholder_suspected empty_append unknown_arg".split()
)


class EngineError(Exception):
    def __init__(self, code: str, message: str, **detail: object) -> None:
        assert code in CODES, code
        super().__init__(f"{code}: {message}")
        self.code, self.detail = code, detail


def filter_invalid(message: str, **detail: object) -> EngineError:
    return EngineError("filter_invalid", message, **detail)
