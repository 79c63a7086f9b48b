"""Parameters of the pipeline stages; defaults are part of the semantics."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Selection:
    """Templates win over domains; both empty takes all pages."""

    templates: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    selection: Selection = field(default_factory=Selection)
    common_text_below: float = 0.50
    least_text_length: int = 3
    search_longest: int = 300
    strict_search: bool = False  # node texts must equal the page text instead of containing it
    use_ground_truth: bool = True
    topic_drop_from: int = 3
    least_predicate_freq: float = 0.10
    most_object_freq: float = 0.90
    predicates_per_object: int = 3
    least_redundancy: int = 3
    synonym_factor: float = 0.5
    redundancy_share: float = 0.21
    own_template_weight: float = 1.0
    duplicate_factor: float = 0.9
    middle_share: float = 0.9
    negatives_per_seed: int = 5
    crowd_pairs: int = 5
