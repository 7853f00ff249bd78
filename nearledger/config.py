"""Constants and settings: normalisation, merchant risk, search."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from importlib import resources

DIMS = 14
K = 5
THRESHOLD_VOTES = 3  # 3 of 5 votes, a score of 0.6, is no longer approved
CODE_MAX = 10_001
BUCKETS = 16
MAX_PROBE = 512
DEFAULT_RISK = 0.5


@dataclass(frozen=True)
class Norm:
    max_amount: float
    max_installments: float
    amount_vs_avg_ratio: float
    max_minutes: float
    max_km: float
    max_tx_count_24h: float
    max_merchant_avg_amount: float


def load_constants(norm_json: str | None = None, risk_json: str | None = None) -> tuple[Norm, dict[str, float]]:
    """The constants, from JSON texts or from the packaged ones."""
    own = resources.files("nearledger") / "resources"
    norm = json.loads(norm_json or (own / "normalization.json").read_text())
    risk = json.loads(risk_json or (own / "merchant_risk.json").read_text())
    return Norm(**{k: float(v) for k, v in norm.items()}), {str(k): float(v) for k, v in risk.items()}


@dataclass(frozen=True)
class SearchConfig:
    """Probes of the cheap and the high pass, when to escalate, and a cap on rows scanned by the cheap pass (0: none).

    margin >= 0: escalate if the vote is within margin of the threshold; margin < 0: escalate if the k-th squared distance is at least radius.
    high_for_votes overrides nprobe_high for a cheap vote.
    """

    nprobe: int = 16
    nprobe_high: int = 192
    margin: int = 1
    radius: float = 0.98
    max_scan: int = 0
    high_for_votes: dict[int, int] = field(default_factory=dict)

    @staticmethod
    def clamp(n: int, nlist: int) -> int:
        return max(1, min(n, nlist, MAX_PROBE))

    def high(self, votes: int, nlist: int) -> int:
        n = self.high_for_votes.get(votes, 0) or self.nprobe_high
        return self.clamp(n, nlist) if n > 0 else 0

    @classmethod
    def from_options(cls, options: dict[str, str]) -> SearchConfig:
        """From text options; a value that is no number leaves the default."""
        values = {}
        for name, default in (("nprobe", 16), ("nprobe_high", 192), ("margin", 1), ("radius", 0.98), ("max_scan", 0)):
            try:
                values[name] = type(default)(options[name])
            except (KeyError, ValueError):
                values[name] = default
        return cls(**values)
