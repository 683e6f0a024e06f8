"""Settings of a tracking run."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

import yaml


@dataclass(frozen=True)
class Config:
    """One run: what counts as an object, how objects are linked, which tracks are kept. Hours, pixels and kilometres."""

    ny: int
    nx: int
    feature_type: str = "threshold"
    identify: dict = field(default_factory=lambda: {"low": 0.0})
    least_pixels: float = 0
    othresh: float = 0.5
    timegap: float = 3.1
    least_times: int = 2
    pixel_km: float = 1.0
    main_times: int = 6
    main_area: float = 0.0
    attach_shorter: int = 6
    attach_per_time: int = 3


def load(path: str) -> Config:
    """A YAML file with keys of :class:`Config`; other keys are an error."""
    with open(path) as f:
        given = yaml.safe_load(f) or {}
    if unknown := set(given) - {f.name for f in fields(Config)}:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return Config(**given)
