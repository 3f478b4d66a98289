"""Search and index parameters with their defaults and bounds."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    max_token_search_dist: int = 50
    max_linked_token_search_dist: int = 2
    max_fuzzy_edit_dist: int = 2
    results_per_doc: int = 50
    min_results_per_start: int = 5
    max_token_size: int = 500
    tokens_per_search_scope_level: int = 100
    samples_per_doc: int = 5
    snippet_min_tokens: int = 10
    snippet_max_lines: int = 2
    print_width: int = 80
    cache_limit: int = 10_000
    max_depth: int = 100
    scan_hidden: bool = False

    def __post_init__(self) -> None:
        for name in ("max_fuzzy_edit_dist", "snippet_min_tokens", "snippet_max_lines", "max_depth"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must be 0 or more")
        for name in ("max_token_search_dist", "max_linked_token_search_dist", "tokens_per_search_scope_level", "samples_per_doc", "print_width", "cache_limit", "max_token_size"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be 1 or more")


DEFAULTS = Params()
