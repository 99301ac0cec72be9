"""Engine options with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


# Defaults that results depend on.
@dataclass(frozen=True)
class Options:
    conf_detect: float = 0.10
    conf_blur: float = 0.15
    conf_sign: float = 0.6
    margin: float = 0.10
    padding: int = 12
    growth: float = 0.05
    interpolation_gap_s: float = 2.0
    max_jump: float = 20.0
    link_gap_s: float = 1.0
    link_distance: float = 1.0
    area_ratio: float = 4.0
    sign_length: int = 5
    smoothing: int = 5
    velocity_samples: int = 5
    padding_detections: int = 3
    padding_speed: float = 0.5
    merge_iou: float = 0.5
    merge_iomin: float = 0.8
    protected: float = 0.9
    max_leakage: float = 0.01
    max_exposure: int = 3
    fps: float = 24.0
    width: int = 1920
    height: int = 1080
    #: Width at which the frame closes sideways; none for a flat frame.
    wrap_width: float | None = None

    def __post_init__(self):
        if self.conf_detect > self.conf_blur:
            raise ValueError("conf_detect must not exceed conf_blur")

    @property
    def transient_window(self) -> int:
        return max(1, round(self.fps / 3))

    @property
    def interpolation_gap(self) -> int:
        return max(0, round(self.interpolation_gap_s * self.fps))

    @property
    def link_gap(self) -> int:
        return max(1, round(self.link_gap_s * self.fps))
