"""Plane homographies: calibration from point pairs, trust, and rescaling to another frame size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

Point = tuple[float, float]
TRUSTED = 0.05


def _centred(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved to their centre and scaled to a mean distance of sqrt 2, as rows (x, y, 1), and the matrix that does it."""
    centre = points.mean(axis=0)
    scale = np.sqrt(2) / max(float(np.linalg.norm(points - centre, axis=1).mean()), 1e-12)
    move = np.array([[scale, 0, -scale * centre[0]], [0, scale, -scale * centre[1]], [0, 0, 1]])
    return np.column_stack((points, np.ones(len(points)))) @ move.T, move


def calibrate(image: Sequence[Point], world: Sequence[Point]) -> np.ndarray:
    """The 3x3 matrix from pixels to metres that fits four or more point pairs best, by singular values of centred points."""
    pixels, metres = np.asarray(image, float), np.asarray(world, float)
    if pixels.shape != metres.shape or len(pixels) < 4:
        raise ValueError("four point pairs at least")
    (p, from_pixels), (q, to_metres) = _centred(pixels), _centred(metres)
    zero = np.zeros_like(p)
    conditions = np.concatenate((np.hstack((p, zero, -q[:, :1] * p)), np.hstack((zero, p, -q[:, 1:2] * p))))
    h = np.linalg.inv(to_metres) @ np.linalg.svd(conditions)[2][-1].reshape(3, 3) @ from_pixels
    if abs(h[2, 2]) < 1e-12 * np.abs(h).max():
        raise ValueError("degenerate points")
    return h / h[2, 2]


def apply(h: np.ndarray, point: Point) -> Point:
    x, y, w = h @ np.array([*point, 1.0])
    return float(x / w), float(y / w)


def residual(h: np.ndarray, image: Sequence[Point], world: Sequence[Point]) -> float:
    """Largest error of a pair as a share of the points' extent."""
    extent = max(float(np.linalg.norm(np.subtract(a, b))) for a in world for b in world) or 1.0
    return max(float(np.linalg.norm(np.subtract(apply(h, p), q))) for p, q in zip(image, world, strict=True)) / extent


def trusted(h: np.ndarray, image: Sequence[Point], world: Sequence[Point]) -> bool:
    return residual(h, image, world) < TRUSTED


def for_frame(h: np.ndarray, calibrated: tuple[int, int], live: tuple[int, int]) -> np.ndarray:
    """The matrix for frames of another size; an error if their shape differs by more than 1 %."""
    (w0, h0), (w1, h1) = calibrated, live
    if abs((w1 / h1) / (w0 / h0) - 1) > 0.01:
        raise ValueError("frames of another shape")
    return h @ np.diag([w0 / w1, h0 / h1, 1.0])


def metres_per_pixel(h: np.ndarray, at: Point) -> float:
    """Local scale, probed one pixel to the right."""
    return float(np.linalg.norm(np.subtract(apply(h, (at[0] + 1, at[1])), apply(h, at))))
