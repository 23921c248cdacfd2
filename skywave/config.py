"""Settings of the detectors. The defaults are fixed values: results are compared at them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FrontEnd:
    row_quantile: float = 0.25
    reference_quantile: float = 0.75
    smooth_sigma: float = 12.0
    max_boost_db: float = 12.0


@dataclass(frozen=True)
class Chunking:
    bandwidth_hz: float = 25e6
    overlap_hz: float = 6.25e6
    min_rows: int = 16
    fraction: float = 0.40
    overlap_fraction: float = 0.20


@dataclass(frozen=True)
class Grouping:
    bridge_f: int = 21
    bridge_t: int = 3
    min_size: int = 24
    min_f: int = 12
    min_t: int = 1
    min_density: float = 0.08
    continuity: float = 0.85


#: Grouping inside sub-bands and over the whole band of the coherent-power detector.
BAND_GROUPING = Grouping(bridge_f=33, bridge_t=5, min_size=24, min_f=18, min_t=2, min_density=0.06)


@dataclass(frozen=True)
class CoherentPower:
    coherence_weight: float = 0.55
    power_weight: float = 0.45
    support_quantile: float = 0.82
    mask_quantile: float = 0.92
    power_floor_quantile: float = 0.30
    box_f: int = 9
    box_t: int = 33
    scales: tuple[float, ...] = (0.8, 1.6, 3.2)
    min_component: int = 6
    seed_quantile: float = 0.72


@dataclass(frozen=True)
class PatchFusion:
    """Patch scores fused with power inside a sub-band."""

    power_gain: float = 0.25
    companion_floor: float = 0.30
    support_quantile: float = 0.70
    score_quantile: float = 0.85
    min_component: int = 6


@dataclass(frozen=True)
class LayeredFusion:
    """Patch score, power and texture layered by bands inside a sub-band; a second value holds where nothing speckles."""

    gate_floor: float = 0.25
    gap_floor: float = 0.10
    threshold: float = 0.20
    threshold_clean: float = 0.10
    min_component: int = 10
    min_component_clean: int = 2
    rescue_floor: float = 0.10
    rescue_gain: float = 2.0
    clean_speckle: float = 0.85
    strong_speckle: float = 0.20
    support_quantile: float = 0.70
    vote_component: int = 6
