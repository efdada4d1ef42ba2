"""Cameras: one as small matrices on the driver, handed to plans as literals; tables of them as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Camera:
    """A pinhole camera; forward and up need not be of unit length."""

    width: int
    height: int
    focal: float
    cx: float
    cy: float
    near: float = 0.1
    far: float = 1000.0
    position: tuple = (0.0, 0.0, 3.0)
    forward: tuple = (0.0, 0.0, -1.0)
    up: tuple = field(default=(0.0, 1.0, 0.0))

    @classmethod
    def default(cls, width: int, height: int, **more) -> Camera:
        return cls(width, height, 1.2 * max(width, height), width / 2, height / 2, **more)

    def axes(self) -> np.ndarray:
        """Rows: right, up and backward of a right-handed look-at."""
        back = -np.asarray(self.forward, float)
        back /= np.linalg.norm(back)
        right = np.cross(np.asarray(self.up, float), back)
        right /= np.linalg.norm(right)
        return np.stack([right, np.cross(back, right), back])

    def view(self) -> tuple[np.ndarray, np.ndarray]:
        """Rotation and translation of world to camera space, in which the scene lies at negative z."""
        r = self.axes()
        return r, -r @ np.asarray(self.position, float)

    def projection(self) -> np.ndarray:
        """Off-axis pinhole matrix for column vectors, depth -1 to 1."""
        w, h, n, f = self.width, self.height, self.near, self.far
        return np.array([
            [2 * self.focal / w, 0, 1 - 2 * self.cx / w, 0],
            [0, 2 * self.focal / h, 2 * self.cy / h - 1, 0],
            [0, 0, -(f + n) / (f - n), -2 * f * n / (f - n)],
            [0, 0, -1, 0],
        ])

    def fov_y(self) -> float:
        return 2 * np.arctan(self.height / (2 * self.focal))

    def mvp(self) -> np.ndarray:
        """World to clip space with depth 0 to 1, for column vectors."""
        view = np.eye(4)
        view[:3, :3], view[:3, 3] = self.view()
        return perspective(self.fov_y(), self.width / self.height, self.near, self.far) @ view

    def planes(self) -> np.ndarray:
        return frustum_planes(self.mvp())


def perspective(fov_y: float, aspect: float, near: float, far: float) -> np.ndarray:
    """Symmetric perspective for column vectors, depth 0 to 1, w = -z."""
    f = 1 / np.tan(fov_y / 2)
    return np.array([[f / aspect, 0, 0, 0], [0, f, 0, 0], [0, 0, far / (near - far), near * far / (near - far)], [0, 0, -1, 0]])


def frustum_planes(mvp: np.ndarray) -> np.ndarray:
    """Six planes (a, b, c, d), inside where positive, with unit normals: left, right, bottom, top, near, far."""
    rows = np.stack([mvp[3] + mvp[0], mvp[3] - mvp[0], mvp[3] + mvp[1], mvp[3] - mvp[1], mvp[2], mvp[3] - mvp[2]])
    return rows / np.linalg.norm(rows[:, :3], axis=1, keepdims=True)


def _cross(a: list, b: list) -> list:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _unit(a: list) -> list:
    n = F.sqrt(a[0] * a[0] + a[1] * a[1] + a[2] * a[2])
    return [x / n for x in a]


def view_columns(position: list[Column], forward: list[Column], up: tuple = (0.0, 1.0, 0.0)) -> tuple[list[list[Column]], list[Column]]:
    """Rotation and translation of world to camera space for a camera in every row."""
    back = _unit([-x for x in forward])
    right = _unit(_cross([F.lit(x) for x in up], back))
    r = [right, _cross(back, right), back]
    return r, [-(a * position[0] + b * position[1] + c * position[2]) for a, b, c in r]


def projection_columns(w: Column, h: Column, focal: Column, cx: Column, cy: Column, near: float = 0.1, far: float = 1000.0) -> list[list[Column]]:
    """Off-axis pinhole matrix for column vectors, depth -1 to 1, for a camera in every row."""
    zero, one = F.lit(0.0), F.lit(-1.0)
    return [
        [2 * focal / w, zero, 1 - 2 * cx / w, zero], [zero, 2 * focal / h, 2 * cy / h - 1, zero],
        [zero, zero, F.lit(-(far + near) / (far - near)), F.lit(-2 * far * near / (far - near))], [zero, zero, one, zero],
    ]


def perspective_columns(fov_y: Column, aspect: Column, near: float, far: float) -> list[list[Column]]:
    """Symmetric perspective for column vectors, depth 0 to 1, w = -z, for a camera in every row."""
    f, zero = 1 / F.tan(fov_y / 2), F.lit(0.0)
    return [[f / aspect, zero, zero, zero], [zero, f, zero, zero], [zero, zero, F.lit(far / (near - far)), F.lit(near * far / (near - far))], [zero, zero, F.lit(-1.0), zero]]


def orbit_columns(yaw: Column, pitch: Column, distance: Column, aspect: Column) -> list[list[Column]]:
    """World to clip space of a camera on a sphere that looks at the origin, 45 degrees of view, for every row."""
    eye = [distance * F.cos(pitch) * F.sin(yaw), distance * F.sin(pitch), distance * F.cos(pitch) * F.cos(yaw)]
    r, t = view_columns(eye, [-x for x in eye])
    view = [[*row, x] for row, x in zip(r, t)] + [[F.lit(0.0)] * 3 + [F.lit(1.0)]]
    p = perspective_columns(F.lit(np.pi / 4), aspect, 0.01, 100.0)
    return [[sum(p[i][k] * view[k][j] for k in range(4)) for j in range(4)] for i in range(4)]
