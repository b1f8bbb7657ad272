"""Weights and window lengths, worked out on the driver; the oldest row's weight comes first."""

from __future__ import annotations

import math


def linear(window: int) -> list[float]:
    return [float(i) for i in range(1, window + 1)]


def exponential(window: int, alpha: float = 0.1) -> list[float]:
    return [math.exp(-alpha * (window - 1 - i)) for i in range(window)]


def alma(window: int, offset: float = 0.85, sigma: float = 6.0) -> list[float]:
    """A Gaussian round offset * (window - 1), counted from the newest row, that sums to 1."""
    centre, spread = offset * (window - 1), window / sigma
    raw = [math.exp(-((i - centre) ** 2) / (2 * spread * spread)) for i in range(window)]
    return [x / sum(raw) for x in reversed(raw)]


def fibonacci(window: int, asc: bool = True) -> list[float]:
    raw = [1.0, 1.0]
    while len(raw) < window:
        raw.append(raw[-1] + raw[-2])
    raw = raw[:window]
    return [x / sum(raw) for x in (raw if asc else reversed(raw))]


def triangular(window: int) -> list[float]:
    """A ramp up to the middle and down again, that sums to 1."""
    raw = [float(min(i + 1, window - i)) for i in range(window)]
    return [x / sum(raw) for x in raw]


def custom(window: int, weights: list[float]) -> list[float]:
    if len(weights) != window:
        raise ValueError(f"{len(weights)} weights for a window of {window}")
    return [float(x) for x in weights]


def half_window(window: int) -> int:
    return window // 2


def sqrt_window(window: int) -> int:
    return math.isqrt(window)


GENERATORS = {"linear": linear, "exponential": exponential, "alma": alma, "fibonacci": fibonacci, "triangular": triangular, "custom": custom, "half_window": half_window, "sqrt_window": sqrt_window}


def generator(name: str):
    if name not in GENERATORS:
        raise KeyError(f"no generator {name!r}; there are {', '.join(sorted(GENERATORS))}")
    return GENERATORS[name]
