"""Job settings: library defaults, the training command's defaults, and a production preset."""

from __future__ import annotations

from dataclasses import dataclass, field

# Event names, timestamp bounds and weights every consumer of the data relies on.
VALID_EVENTS = ("view", "addtocart", "transaction")
TARGET_EVENTS = ("addtocart", "transaction")
MIN_TIMESTAMP_MS = 1262304000000  # 2010-01-01T00:00:00Z
MAX_TIMESTAMP_MS = 1893456000000  # 2030-01-01T00:00:00Z
DAY_MS = 86_400_000


@dataclass(frozen=True)
class EventWeights:
    view: float = 1.0
    addtocart: float = 4.0
    transaction: float = 8.0


@dataclass(frozen=True)
class InteractionConfig:
    min_user_interactions: int = 32
    min_item_interactions: int = 32
    weights: EventWeights = field(default_factory=EventWeights)


@dataclass(frozen=True)
class AlsConfig:
    factors: int = 64
    iterations: int = 25
    regularization: float = 0.05
    alpha: float = 2.0
    seed: int = 42
    precision: str = "float64"  # of stored factors; sums are always of doubles
    block_mb: int = 64  # of factors that one task gathers at most, which bounds the ratings it takes on


@dataclass(frozen=True)
class RerankConfig:
    alpha: float = 0.7
    beta: float = 0.3
    adaptive: bool = True


@dataclass(frozen=True)
class EvalConfig:
    k: int = 5
    recall_k: int = 20
    ndcg_k: int = 10
    popular_k: int = 100


@dataclass(frozen=True)
class JobConfig:
    interactions: InteractionConfig = field(default_factory=InteractionConfig)
    als: AlsConfig = field(default_factory=AlsConfig)
    rerank: RerankConfig = field(default_factory=RerankConfig)
    evaluation: EvalConfig = field(default_factory=EvalConfig)
    test_size: float = 0.15


PRODUCTION = JobConfig(
    interactions=InteractionConfig(min_user_interactions=5, min_item_interactions=5),
    als=AlsConfig(factors=256, iterations=25, regularization=0.1, alpha=4.0, precision="float32"),
    rerank=RerankConfig(alpha=0.6, beta=0.4, adaptive=True),
)
