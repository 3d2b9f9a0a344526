"""Constants of the scorer, in one place."""

from __future__ import annotations

from dataclasses import dataclass, replace  # noqa: F401  (replace: callers derive variants)

#: Signals in their fixed order; higher is worse for all.
SIGNALS = ("sparc_state", "ldlj_state", "action_tv_ratio", "action_hf_energy", "idle_frac", "saturation_frac", "track_err")
RATIO_SIGNALS = ("sparc_state", "action_tv_ratio", "action_hf_energy", "track_err")
FRACTION_SIGNALS = ("idle_frac", "saturation_frac")


@dataclass(frozen=True)
class ScoreConfig:
    flag_z: float = 3.5
    reason_z: float = 3.0
    display_cap: float = 10.0
    rel_floor: float = 0.10
    abs_floor_ldlj: float = 0.5
    abs_floor_fraction: float = 0.03
    abs_floor_log_length: float = 0.1
    tv_den_frac: float = 0.5
    tv_mode: str = "split"  # or "net"
    idle_window_s: float = 0.5
    idle_eps_mult: float = 2.0
    idle_rest: float = 0.2
    idle_move: float = 0.5
    hard_saturation: float = 0.20
    gap_tolerance_s: float = 1e-4
    frozen_command: float = 0.01
    few_episodes: int = 10

    def idle_frames(self, fps: float) -> int:
        """Half-even rounding, at least one frame."""
        return max(1, round(self.idle_window_s * fps))

    def min_frames(self, fps: float) -> int:
        return self.idle_frames(fps) + 2

    def floors(self, signal: str) -> tuple[float, float]:
        """(relative to the median, absolute) floors of the spread in a robust z."""
        if signal == "ldlj_state":
            return 0.0, self.abs_floor_ldlj
        if signal == "length":
            return 0.0, self.abs_floor_log_length
        return (self.rel_floor, 0.0) if signal in RATIO_SIGNALS else (0.0, self.abs_floor_fraction)
