"""Operating parameters with their clamps."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

_RANGES = {
    "max_outgoing_links": (1, None), "match_top_k": (1, 50), "min_doc_similarity": (0, 100), "min_passage_score": (0, 100),
    "both_direction_min": (0, 100), "rerank_budget": (1, 20), "rerank_pair_min": (0, 100), "rerank_anchor_min": (0, 100),
    "link_word_gap": (0, 20), "auto_min_confidence": (0, 100), "batch_size": (1, 100),
}


@dataclass(frozen=True)
class Settings:
    """Values out of range are clamped; an update without key keeps the old key."""

    provider: str = "offline"
    model: str = "hashed-64"
    api_key: str = ""
    max_outgoing_links: int = 2
    match_top_k: int = 8
    min_doc_similarity: int = 55
    min_passage_score: int = 55
    both_direction_min: int = 60
    avoid_reciprocal: bool = True
    use_ai_anchor: bool = False
    use_ai_rerank: bool = False
    rerank_budget: int = 8
    rerank_pair_min: int = 75
    rerank_anchor_min: int = 70
    bold_links: bool = True
    link_word_gap: int = 3
    auto_link_new: bool = True
    auto_insert: bool = True
    auto_min_confidence: int = 75
    batch_size: int = 20

    def __post_init__(self) -> None:
        for name, (low, high) in _RANGES.items():
            value = max(low, int(getattr(self, name)))
            object.__setattr__(self, name, value if high is None else min(high, value))

    def update(self, **values) -> Settings:
        if not str(values.get("api_key", "")).strip():
            values.pop("api_key", None)
        known = {f.name for f in fields(self)}
        return Settings(**asdict(self) | {k: v for k, v in values.items() if k in known})

    def public(self) -> dict:
        """All but the key, which is only said to be set or not."""
        out = asdict(self)
        return out | {"api_key_set": bool(out.pop("api_key"))}
