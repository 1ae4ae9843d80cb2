"""Parameters: plain dataclasses whose values become literals of a plan."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field, fields, replace


@dataclass(frozen=True)
class GroupConfig:
    """How frames fall into scenes."""

    time_gap_seconds: float = 3.0
    scene_change_distance: int = 40
    no_time_hash_distance: int = 16
    max_group_size: int = 40


@dataclass(frozen=True)
class ScoreConfig:
    """Weights of the score and thresholds of the grades."""

    face_priority: bool = True
    trust_eye: float = 0.75
    trust_face: float = 0.60
    trust_af: float = 0.55
    trust_tile: float = 0.55
    trust_frame: float = 0.40
    penalty_face_defocus: float = 15.0
    bonus_focus_on_face: float = 5.0
    penalty_no_face: float = 10.0
    bonus_face: float = 20.0
    bonus_face_size: float = 0.0
    face_bonus_full_area: float = 0.03
    bonus_eye: float = 15.0
    penalty_eyes_closed: float = 20.0
    bonus_eyes_open: float = 10.0
    eyes_closed_below: float = 0.25
    penalty_highlight_clip: float = 1.0
    max_clipped_highlights: float = 0.25
    penalty_shadow_clip: float = 2.5
    max_clipped_shadows: float = 0.5
    penalty_extreme_luma: float = 15.0
    keep_above: float = 65.0
    target_keep_ratio: float | None = None
    keep_per_group: int = 1
    min_keep_score: float = 0.0
    reject_below: float = 15.0
    reject_percentile: float = 15.0
    reject_below_group_best: float = 10.0


@dataclass(frozen=True)
class AnalyzeConfig:
    """What a stored measurement depends on."""

    detect_long_edge: int = 1600
    noise_compensation: bool = True
    center_priority: bool = False
    af_roi_hint: bool = False
    demosaic_small_preview: bool = False


@dataclass(frozen=True)
class Config:
    analyze: AnalyzeConfig = field(default_factory=AnalyzeConfig)
    group: GroupConfig = field(default_factory=GroupConfig)
    score: ScoreConfig = field(default_factory=ScoreConfig)


def load(data: dict | None) -> Config:
    """A Config from nested dicts: unknown keys are dropped; a section that is no dict, or has a key its class refuses,
    takes its defaults."""
    sections = {}
    for f in fields(Config):
        kind = f.default_factory
        given = (data or {}).get(f.name)
        try:
            known = {x.name for x in fields(kind)}
            sections[f.name] = kind(**{k: v for k, v in given.items() if k in known})
        except (AttributeError, TypeError):
            sections[f.name] = kind()
    return Config(**sections)


def sanitise(config: ScoreConfig) -> ScoreConfig:
    """Non-finite numbers become defaults (the target ratio becomes none); percentile and full area are clipped."""
    if not isinstance(config, ScoreConfig):
        raise TypeError(f"ScoreConfig is needed, not {type(config).__name__}")
    bad = {
        f.name: None if f.name == "target_keep_ratio" else f.default
        for f in fields(config)
        if isinstance(getattr(config, f.name), float) and not math.isfinite(getattr(config, f.name))
    }
    config = replace(config, **bad)
    return replace(
        config,
        reject_percentile=min(100.0, max(0.0, config.reject_percentile)),
        face_bonus_full_area=min(0.5, max(0.001, config.face_bonus_full_area)),
    )


def params_key(config: AnalyzeConfig, algorithm: str = "1") -> str:
    """First 16 hex digits of the sha256 of the parameters; an option that is off leaves older keys as they were."""
    payload = asdict(config) | {"_algorithm": algorithm}
    if not payload["demosaic_small_preview"]:
        del payload["demosaic_small_preview"]
    return hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()[:16]
