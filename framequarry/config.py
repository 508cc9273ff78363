"""Every tunable as a frozen record, overrides by name=value, and a fingerprint of what a result was made with."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Stabilize:
    """Translation: working height, template rounds, when they have converged, agreement that a frame needs."""

    height: int = 600
    most_rounds: int = 5
    tolerance: float = 0.05
    least_ncc: float = 0.5


@dataclass(frozen=True)
class Nonrigid:
    """Patches and their distance in pixels of the frame, rounds, convergence."""

    patch: int = 64
    stride: int = 32
    most_rounds: int = 6
    tolerance: float = 0.02


@dataclass(frozen=True)
class Flow:
    """Speeds: shortest edge, lags and shifts of the correlation map, least peak."""

    least_length: int = 20
    most_lag: int = 12
    most_shift: int = 40
    least_peak: float = 0.08


@dataclass(frozen=True)
class Links:
    """Ends that may continue into each other."""

    reach: float = 12.0
    most_turn: float = 60.0
    most_width_ratio: float = 2.5


METHODS = {"translation": Stabilize(), "nonrigid": Nonrigid(), "flow": Flow(), "links": Links()}


def fingerprint(params) -> str:
    """Twelve digits that stand for a record's values, whatever their order."""
    return hashlib.sha256(json.dumps(asdict(params), sort_keys=True).encode()).hexdigest()[:12]


def overridden(params, settings: list[str]):
    """``params`` with name=value settings, each read as the field's type; unknown names are an error."""
    kinds = {f.name: type(getattr(params, f.name)) for f in fields(params)}
    change = {}
    for s in settings:
        name, _, raw = s.partition("=")
        if name not in kinds:
            raise KeyError(f"no setting {name!r}; there are {', '.join(kinds)}")
        change[name] = kinds[name](json.loads(raw)) if kinds[name] is not str else raw
    return replace(params, **change)
