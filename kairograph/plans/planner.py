"""Choice between filtering before and after a vector search."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from kairograph.errors import SubgraphTooLarge

#: Bytes of an id (26 signs and a header of 24), and of a hit.
ID_BYTES = 26 + 24
ROW_BYTES = ID_BYTES + 4


class Strategy(Enum):
    PRE_FILTER = "pre_filter"
    POST_FILTER = "post_filter"


@dataclass(frozen=True)
class CostEstimate:
    strategy: Strategy
    candidates: int
    k_prime: int
    pre_filter_bytes: int
    post_filter_bytes: int


@dataclass(frozen=True)
class CostEstimator:
    """Prices both strategies in bytes; ``corpus`` vectors of ``vector_bytes`` each."""

    byte_budget: int | None
    corpus: int
    vector_bytes: int

    def k_prime(self, k: int, candidates: int) -> int:
        """How deep a search must go so that ``k`` hits can be expected to pass the filter."""
        if not candidates or not self.corpus:
            return k
        return min(max(k * self.corpus // candidates, k), max(self.corpus, k))

    def estimate(self, k: int, candidates: int) -> CostEstimate:
        ids = candidates * ID_BYTES
        if self.byte_budget is not None and ids > self.byte_budget:
            raise SubgraphTooLarge(n=ids, budget=self.byte_budget)
        depth = self.k_prime(k, candidates)
        row = self.vector_bytes + ROW_BYTES
        pre, post = candidates * row + ids, depth * row + ids
        return CostEstimate(Strategy.POST_FILTER if post <= pre else Strategy.PRE_FILTER, candidates, depth, pre, post)
