"""Default parameters. The numbers are fixed values."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

CHANNELS = ("FBG1", "FBG2", "FBG3")
METHODS = ("peak", "threshold", "derivative", "change_point")
FILTERS = ("moving_average", "butterworth", "savitzky_golay", "median")
SERIES = ["dataset", "channel"]


@dataclass(frozen=True)
class Sampling:
    frequency: float = 50.0
    baseline_samples: int = 100


@dataclass(frozen=True)
class Filters:
    window: int = 5
    cutoff: float = 5.0
    order: int = 4
    savgol_window: int = 11
    savgol_order: int = 3


@dataclass(frozen=True)
class Detectors:
    baseline_samples: int = 100
    threshold_multiplier: float = 4.0
    derivative_multiplier: float = 3.0
    derivative_persistence: int = 2
    change_point_window: int = 20
    change_point_threshold: float = 3.0
    prominence_multiplier: float = 3.0
    peak_distance: int = 5
    peak_before: int = 10
    peak_after: int = 10
    min_samples: int = 3
    peak_gap: int = 5
    threshold_gap: int = 2
    derivative_gap: int = 2
    change_point_gap: int = 5
    match_tolerance: int = 5
    split_min_gap: int = 20


@dataclass(frozen=True)
class Refinement:
    noise_std: float = 2.0
    recovery_ratio: float = 0.20
    confirmation: int = 5


@dataclass(frozen=True)
class Rules:
    min_duration_samples: int = 3
    min_deviation_std: float = 5.0
    min_agreement: int = 2
    min_evidence: float = 0.30
    noise_like_methods: int = 1
    noise_like_std: float = 5.0
    flat_std: float = 1e-12
    end_margin: int = 10


#: For runs with one detector only.
PERMISSIVE = Rules(min_agreement=1, min_evidence=0.0, noise_like_methods=0)


@dataclass(frozen=True)
class Weights:
    peak: float = 0.30
    threshold: float = 0.30
    derivative: float = 0.25
    change_point: float = 0.15

    def normalised(self) -> dict[str, float]:
        w = asdict(self)
        total = sum(w.values())
        if min(w.values()) < 0 or total <= 0:
            raise ValueError("weights must not be negative, nor all zero")
        return {k: v / total for k, v in w.items()}


@dataclass(frozen=True)
class Spectral:
    """What is written as the configuration of a feature run."""

    remove_dc: bool = True
    window: str = "hann"
    min_fft_samples: int = 8
    rolloff: float = 0.85
    stft: bool = True
    min_stft_samples: int = 16
    stft_overlap: float = 0.5


@dataclass(frozen=True)
class Parameters:
    sampling: Sampling = field(default_factory=Sampling)
    filters: Filters = field(default_factory=Filters)
    detectors: Detectors = field(default_factory=Detectors)
    refinement: Refinement = field(default_factory=Refinement)
    rules: Rules = field(default_factory=Rules)
    weights: Weights = field(default_factory=Weights)
    spectral: Spectral = field(default_factory=Spectral)
