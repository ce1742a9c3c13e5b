"""Parameters of the two analyses."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Classifier parameters."""

    max_clusters: int = 50
    min_cluster_size: int = 20
    max_features: int = 8000
    min_df: int = 3
    max_df: float = 0.7
    seed: int = 42
    restarts: int = 10
    max_iter: int = 300
    test_fraction: float = 0.2
    trees: int = 100
    max_depth: int = 15
    max_bins: int = 16
    memory_mb: int = 1024
    model_type: str = "random_forest"


@dataclass(frozen=True)
class AnalyzerConfig:
    """Analyzer parameters."""

    max_categories: int = 20
    initial_clusters: int = 30
    min_cluster_size: int = 20
    max_features: int = 3000
    min_df: int = 2
    max_df: float = 0.8
    seed: int = 42
    restarts: int = 10
    max_iter: int = 300
    min_similarity: float = 0.1
