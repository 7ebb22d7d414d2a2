"""Three-dimensional transforms and clipping. Matrices are small and made on the driver; points are columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column


@dataclass(frozen=True)
class Camera:
    position: tuple[float, float, float] = (0.0, 0.0, 1.0)
    rotation: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 1.0)  # unit quaternion x, y, z, w
    fov: float = np.pi / 2
    width: int = 1000
    height: int = 1000
    near: float = 0.01
    far: float = 100.0

    @classmethod
    def looking(cls, eye, center, up, **more) -> Camera:
        """At eye, looking at center."""
        eye, center, up = (np.asarray(v, float) for v in (eye, center, up))
        z = (eye - center) / np.linalg.norm(eye - center)
        x = np.cross(up, z)
        x /= np.linalg.norm(x)
        return cls(tuple(eye), _quaternion(np.array([x, np.cross(z, x), z])), **more)

    def turned(self, axis: int, angle: float) -> Camera:
        """Turned about its own axis 0, 1 or 2; points turn the other way."""
        q = np.zeros(4)
        q[axis], q[3] = -np.sin(angle / 2), np.cos(angle / 2)
        r = np.asarray(self.rotation)
        xyz = q[3] * r[:3] + r[3] * q[:3] + np.cross(q[:3], r[:3])
        out = np.r_[xyz, q[3] * r[3] - q[:3] @ r[:3]]
        return replace(self, rotation=tuple(float(v) for v in out / np.linalg.norm(out)))

    def yaw(self, angle: float) -> Camera:
        return self.turned(1, angle)

    def pitch(self, angle: float) -> Camera:
        return self.turned(0, angle)

    def roll(self, angle: float) -> Camera:
        return self.turned(2, angle)

    def walk(self, distance: float) -> Camera:
        """Moved along the normal of the near plane, which faces the camera: backwards for positive distances."""
        return replace(self, position=tuple(float(v) for v in np.asarray(self.position) + distance * self.planes()[0, :3]))

    def view(self) -> np.ndarray:
        x, y, z, w = self.rotation
        r = np.eye(3) + 2 * np.array([
            [-y * y - z * z, x * y - w * z, x * z + w * y],
            [x * y + w * z, -x * x - z * z, y * z - w * x],
            [x * z - w * y, y * z + w * x, -x * x - y * y],
        ])
        out = np.eye(4)
        out[:3, :3], out[:3, 3] = r, -r @ np.array(self.position)
        return out

    def projection(self) -> np.ndarray:
        s = 1 / np.tan(self.fov / 2)
        depth = self.far - self.near
        out = np.zeros((4, 4))
        out[0, 0], out[1, 1] = s, s * self.width / self.height
        out[2, 2], out[2, 3], out[3, 2] = -(self.near + self.far) / depth, -2 * self.near * self.far / depth, -1
        return out

    def planes(self) -> np.ndarray:
        """Near, far, left, right, top, bottom with unit normals; points inside have distances <= 0."""
        clip = np.array([[0, 0, -1, -1], [0, 0, 1, -1], [-1, 0, 0, -1], [1, 0, 0, -1], [0, 1, 0, -1], [0, -1, 0, -1]], float)
        out = clip @ (self.projection() @ self.view())
        return out / np.linalg.norm(out[:, :3], axis=1, keepdims=True)


def _quaternion(r: np.ndarray) -> tuple[float, float, float, float]:
    """Of a rotation matrix: the eigenvector to the largest eigenvalue of a symmetric form of it."""
    k = np.array([
        [r[0, 0] - r[1, 1] - r[2, 2], r[1, 0] + r[0, 1], r[2, 0] + r[0, 2], r[2, 1] - r[1, 2]],
        [r[1, 0] + r[0, 1], r[1, 1] - r[0, 0] - r[2, 2], r[2, 1] + r[1, 2], r[0, 2] - r[2, 0]],
        [r[2, 0] + r[0, 2], r[2, 1] + r[1, 2], r[2, 2] - r[0, 0] - r[1, 1], r[1, 0] - r[0, 1]],
        [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], r.trace()],
    ]) / 3
    q = np.linalg.eigh(k)[1][:, -1]
    return tuple(float(v) for v in q * (1 if q[3] >= 0 else -1))


def _dot(row, cols: list[Column]) -> Column:
    out = F.lit(0.0)
    for k, c in zip(row, cols, strict=True):
        out = out + F.lit(float(k)) * c
    return out


def _point() -> list[Column]:
    return [F.col("x"), F.col("y"), F.col("z"), F.lit(1.0)]


def view_transform(points: DataFrame, camera: Camera) -> DataFrame:
    """x, y, z into the camera's coordinates."""
    m = camera.view()
    return points.withColumns({n: _dot(m[i], _point()) for i, n in enumerate("xyz")})


def projection_transform(points: DataFrame, camera: Camera) -> DataFrame:
    """x, y, z to homogeneous x, y, z, w."""
    m = camera.projection()
    return points.withColumns({n: _dot(m[i], _point()) for i, n in enumerate("xyzw")})


def perspective_division(points: DataFrame) -> DataFrame:
    return points.withColumns({n: F.col(n) / F.col("w") for n in "xyz"}).drop("w")


def frustum_distances(points: DataFrame, camera: Camera) -> DataFrame:
    """Add the signed distances to the six planes."""
    names = ("near", "far", "left", "right", "top", "bottom")
    return points.withColumns({f"d_{n}": _dot(p, _point()) for n, p in zip(names, camera.planes(), strict=True)})


#: A point this near to a plane, relative to the size of what is added up, lies on it, and so inside.
ON_PLANE = 1e-12


def clip_before(points: DataFrame, camera: Camera) -> DataFrame:
    """Points on the inner side of all six planes, or on them: a filter that Spark evaluates at the scan.

    The planes are rounded, so a distance that rounding explains counts as none.
    """
    keep = F.lit(True)
    for p in camera.planes():
        size = _dot(np.abs(p), [F.abs(c) for c in _point()])
        keep = keep & (_dot(p, _point()) <= ON_PLANE * size)
    return points.where(keep)


def clip_after(points: DataFrame) -> DataFrame:
    """Homogeneous points with -w <= x, y, z <= w."""
    return points.where(F.col("x").between(-F.col("w"), F.col("w")) & F.col("y").between(-F.col("w"), F.col("w")) & F.col("z").between(-F.col("w"), F.col("w")))
