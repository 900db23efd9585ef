"""All tunable values of the pipeline in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PipelineConfig:
    """Parameters of the coordination pipeline; the defaults are fixed values of the data contract."""

    reviews_path: str | None = None  # the three paths are needed by the whole job only
    metadata_path: str | None = None
    output_path: str | None = None
    initial_bucket_hours: int = 24
    small_bucket_hours: int = 6
    oversized_group_limit: int = 100
    min_repeated_groups: int = 3
    min_text_length: int = 30  # declared for callers; no stage filters on it
    component_iterations: int = 20
    top_k: int = 20
    size_weight: float = 0.35
    density_weight: float = 0.35
    repetition_weight: float = 0.30
    size_saturation: float = 20.0
    repetition_saturation: float = 10.0
    label_mode: str = "bounded"  # bounded | converged | as_coded
    dedup_metadata: bool = False
    pair_block_size: int = 512  # members of a group that one pairing block holds
    pairs_per_round: int = 50_000_000  # pairs that are counted, and shuffled, at one time

    def __post_init__(self) -> None:
        if self.label_mode not in ("bounded", "converged", "as_coded"):
            raise ValueError(f"unknown label mode {self.label_mode!r}")
        if self.initial_bucket_hours <= 0 or self.small_bucket_hours <= 0:
            raise ValueError("bucket widths must be positive")
