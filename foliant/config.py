"""Settings of the chunkers and of the tree reduction. Raw arguments are kept and saved, derived values are properties."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

#: How a chunker runs. ``no_semantic`` and ``fixed_overlap`` have the same effect; ``greedy_sentence`` packs without overlap.
MODES = ("full", "no_semantic", "fixed_overlap", "no_overlap", "greedy_sentence", "large_overlap", "small_overlap")


@dataclass(frozen=True)
class ChunkConfig:
    max_tokens: int = 256
    min_tokens: int = 64
    overlap_tokens: int = 32
    semantic_weight: float = 0.7
    coherence_threshold: float = 0.6
    mode: str = "full"
    preserve_paragraphs: bool = True
    article_separator: str = r"\|\|\|"
    #: Whether a first sentence over the budget is preceded by an empty chunk.
    emit_empty_leading: bool = False

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")
        if not self.overlap_tokens < self.max_tokens:
            raise ValueError("overlap_tokens must be below max_tokens")
        if not self.min_tokens <= self.max_tokens:
            raise ValueError("min_tokens must not exceed max_tokens")

    @property
    def semantic(self) -> bool:
        return self.mode in ("full", "large_overlap", "small_overlap")

    @property
    def target(self) -> int:
        """Overlap in tokens that the mode asks for."""
        return {"no_overlap": 0, "large_overlap": 2 * self.overlap_tokens, "small_overlap": self.overlap_tokens // 2}.get(self.mode, self.overlap_tokens)

    def with_mode(self, mode: str) -> ChunkConfig:
        return replace(self, mode=mode)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> ChunkConfig:
        return cls(**json.loads(text))

    @property
    def digest(self) -> str:
        """The same for the same settings, in any run."""
        return hashlib.sha256(self.to_json().encode()).hexdigest()


@dataclass(frozen=True)
class ReduceConfig:
    chunk: ChunkConfig = ChunkConfig(max_tokens=1024, min_tokens=64, overlap_tokens=128, mode="greedy_sentence")
    budget: int = 1000
    specials: int = 1
    map_long: int = 256
    map_short: int = 128
    many_chunks: int = 5
    group_len: int = 256
    final_len: int = 512
    enough: int = 256
    max_layers: int = 5
