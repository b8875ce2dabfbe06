"""Retrieval regimes: declarative configurations that compile to DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Regime:
    """retriever: fts, vector, none or pooled; embed: plain or context."""

    key: str
    retriever: str
    embed: str | None = None
    min_weight: float | None = None
    alpha: float = 0.0
    beta: float = 0.0
    prompt_meta: bool = False
    explain_colors: bool = False
    expand: int = 0
    top_k: int = 12
    narrative_style: bool = False


# The nine regimes.
REGIMES = {
    r.key: r
    for r in (
        Regime("R0_baseline_fts", "fts"),
        Regime("R1_baseline_vector", "vector", "plain"),
        Regime("R2_weight_boost", "vector", "plain", alpha=0.6),
        Regime("R3_context_embed", "vector", "context"),
        Regime("R4_weight_filter", "vector", "plain", min_weight=1.0, alpha=0.6),
        Regime("R5_prompt_meta", "vector", "plain", alpha=0.6, prompt_meta=True, explain_colors=True),
        Regime("R6_full_metadata", "vector", "context", alpha=0.6, beta=0.25, prompt_meta=True, explain_colors=True, expand=3, top_k=16),
        Regime("R7_long_context", "none", min_weight=2.0, prompt_meta=True, explain_colors=True, top_k=400),
        Regime("R8_pooled_curated", "pooled", "context", alpha=0.6, beta=0.25, prompt_meta=True, explain_colors=True, expand=3, top_k=16),
    )
}
OVERRIDABLE = ("top_k", "min_weight", "narrative_style")


def resolve(key: str, overrides: dict | None = None) -> Regime:
    """A regime with the allowed overrides; None and other keys are passed over."""
    if key not in REGIMES:
        raise KeyError(f"unknown regime {key!r}")
    changes = {k: v for k, v in (overrides or {}).items() if k in OVERRIDABLE and v is not None}
    return replace(REGIMES[key], **changes)


def top_k_for_context(context_tokens: int, percent: float, avg_chars: float) -> int:
    """How many fragments fill a share of a model's window: 1 to 150, halves rounded up."""
    room = max(0.0, context_tokens * percent - 1200) / max(1.0, avg_chars / 4)
    return max(1, min(150, int(room + 0.5)))


def estimated_tokens(n: int, avg_chars: float) -> float:
    return n * avg_chars / 4
