"""The scoring policy: weights that an organisation may override, checked as a whole."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Policy:
    # The policy's defaults.
    assessment_year: int = 2026
    earliest_year: int = 2030
    latest_year: int = 2035
    exposure: dict[str, float] = field(default_factory=lambda: {"http-route": 1.0, "listener": 1.0, "library-export": 0.6, "main": 0.3, "unreached": 0.3})
    liveness: dict[str, float] = field(default_factory=lambda: {"confirmed": 1.0, "configured": 0.7, "capable": 0.4})
    lifetime_cap: float = 25.0
    provider_interface: int = 40
    config_driven: int = 20
    negotiation: int = 15
    centralised: int = 15
    pqc_ready: int = 10
    base_years: float = 0.25
    years_per_point: float = 0.04
    default_lifetime: float = 5.0
    default_criticality: str = "medium"
    action_weeks: dict[str, float] = field(default_factory=lambda: {"rotate": 0.5, "enable": 0.5, "remove": 0.5, "review": 0.5, "upgrade": 1.0, "replace": 2.0})
    surface_effort: dict[str, float] = field(default_factory=lambda: {"source": 1.5, "binary": 2.0, "container": 1.2, "certificate": 1.0, "config": 0.6, "cloud": 0.8})
    agility_penalty: float = 2.0
    spread: float = 0.5
    criticality_effort: dict[str, float] = field(default_factory=lambda: {"low": 1.0, "medium": 1.0, "high": 1.25, "critical": 1.5})
    custody_effort: dict[str, float] = field(default_factory=lambda: {"pkcs11-token": 1.5, "tpm": 1.5, "cloud-hsm": 1.2, "cloud-kms": 0.8})
    wave_due: tuple[int, ...] = (2027, 2028, 2029)
    working_weeks: float = 46.0

    def __post_init__(self):
        if self.provider_interface + self.config_driven + self.negotiation + self.centralised + self.pqc_ready != 100:
            raise ValueError("the agility weights have to sum to 100")
        if self.latest_year < self.earliest_year:
            raise ValueError("the latest year lies before the earliest")
        if list(self.wave_due) != sorted(self.wave_due):
            raise ValueError("the waves' due years may not decrease")
        if any(not 0 <= v <= 1 for v in (*self.exposure.values(), *self.liveness.values())):
            raise ValueError("exposure and liveness weights lie between 0 and 1")
        if self.lifetime_cap <= 0:
            raise ValueError("the lifetime cap has to be positive")

    @classmethod
    def from_toml(cls, text: str) -> Policy:
        """Overrides of the defaults; unknown names are refused."""
        given = tomllib.loads(text)
        known = {f.name for f in fields(cls)}
        if unknown := set(given) - known:
            raise ValueError(f"unknown policy values: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


DEFAULT = Policy()
