"""A small limited-memory BFGS minimiser for the models that are fitted on bounded samples."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = 100, memory: int = 8, tolerance: float = 1e-5) -> np.ndarray:
    """f gives value and gradient. Backtracking line search; deterministic."""
    x = start.astype(np.float64).copy()
    value, grad = f(x)
    past: deque = deque(maxlen=memory)
    for _ in range(rounds):
        direction = -grad
        stack = []
        for s, y, rho in reversed(past):
            a = rho * (s @ direction)
            direction -= a * y
            stack.append((s, y, rho, a))
        if past:
            s, y, _ = past[-1]
            direction *= (s @ y) / (y @ y)
        for s, y, rho, a in reversed(stack):
            direction += s * (a - rho * (y @ direction))
        slope = grad @ direction
        if slope >= 0:
            direction, slope = -grad, -(grad @ grad)
            past.clear()
        step = 1.0 if past else min(1.0, 1.0 / (np.abs(grad).sum() + 1e-12))
        for _ in range(30):
            new = x + step * direction
            new_value, new_grad = f(new)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - x, new_grad - grad
        if s @ y > 1e-12:
            past.append((s, y, 1.0 / (s @ y)))
        done = value - new_value < tolerance * max(1.0, abs(value)) * 0.01
        x, value, grad = new, new_value, new_grad
        if done:
            break
    return x
