"""Numeric operators without a built-in form: undistortion of points and homographies, as Pandas UDFs over batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_coefficients(k: list[list[float]], d: list[float], fisheye: bool) -> None:
    if np.shape(k) != (3, 3):
        raise ValueError("the camera matrix is 3x3")
    if len(d) not in ((4,) if fisheye else (4, 5, 8, 12, 14)):
        raise ValueError(f"{len(d)} distortion coefficients")
    if not (np.isfinite(np.asarray(k, float)).all() and np.isfinite(np.asarray(d, float)).all()):
        raise ValueError("camera matrix and coefficients are finite numbers")


def undistort_points(x: np.ndarray, y: np.ndarray, k: np.ndarray, d: np.ndarray, fisheye: bool, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """P24: ideal pixel places of distorted ones, with the same camera matrix; fixed-point rounds (pinhole), Newton steps on the angle (fisheye)."""
    u, v = (x - k[0, 2]) / k[0, 0], (y - k[1, 2]) / k[1, 1]
    if fisheye:
        r = np.hypot(u, v)
        theta = r.copy()
        for _ in range(rounds):
            t2 = theta**2
            f = theta * (1 + t2 * (d[0] + t2 * (d[1] + t2 * (d[2] + t2 * d[3])))) - r
            theta -= f / (1 + t2 * (3 * d[0] + t2 * (5 * d[1] + t2 * (7 * d[2] + t2 * 9 * d[3]))))
        scale = np.where(r > 1e-12, np.tan(theta) / np.maximum(r, 1e-12), 1.0)
        a, b = u * scale, v * scale
    else:
        c = np.zeros(8)
        c[: min(len(d), 8)] = d[:8]
        a, b = u.copy(), v.copy()
        for _ in range(rounds):
            r2 = a * a + b * b
            radial = (1 + r2 * (c[5] + r2 * (c[6] + r2 * c[7]))) / (1 + r2 * (c[0] + r2 * (c[1] + r2 * c[4])))
            a, b = (u - 2 * c[2] * a * b - c[3] * (r2 + 2 * a * a)) * radial, (v - c[2] * (r2 + 2 * b * b) - 2 * c[3] * a * b) * radial
    return a * k[0, 0] + k[0, 2], b * k[1, 1] + k[1, 2]


def undistorted(points: DataFrame, k: list[list[float]], d: list[float], fisheye: bool = False) -> DataFrame:
    """Adds (ux, uy) to points (x, y)."""
    check_coefficients(k, d, fisheye)
    kk, dd = np.array(k, float), np.array(d, float)

    @F.pandas_udf("ux double, uy double")
    def solve(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        a, b = undistort_points(x.to_numpy(float), y.to_numpy(float), kk, dd, fisheye)
        return pd.DataFrame({"ux": a, "uy": b})

    return points.withColumn("_u", solve("x", "y")).select("*", "_u.ux", "_u.uy").drop("_u")


def fit(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The homography through points, by the normalised linear system's smallest singular vector."""

    def unit(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, s = p.mean(0), np.sqrt(2) / max(np.linalg.norm(p - p.mean(0), axis=1).mean(), 1e-12)
        t = np.array([[s, 0, -s * m[0]], [0, s, -s * m[1]], [0, 0, 1]])
        return (p - m) * s, t

    (a, ta), (b, tb) = unit(src), unit(dst)
    rows = []
    for (x, y), (u, v) in zip(a, b, strict=True):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    singular, vt = np.linalg.svd(np.array(rows))[1:]
    if singular[7] < 1e-9:
        raise ValueError("the points are degenerate")
    h = np.linalg.inv(tb) @ vt[-1].reshape(3, 3) @ ta
    return h / h[2, 2]


def residuals(h: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    p = np.c_[src, np.ones(len(src))] @ h.T
    return np.linalg.norm(p[:, :2] / p[:, 2:] - dst, axis=1)


def solve_homography(src: np.ndarray, dst: np.ndarray, threshold: float = 5.0, trials: int = 200, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """V5: four points exactly; from five on the consensus of seeded samples, refitted on its inliers. Returns (matrix, inliers)."""
    if len(src) != len(dst) or len(src) < 4:
        raise ValueError("four pairs of points at least")
    if len(src) == 4:
        return fit(src, dst), np.ones(4, bool)
    rng, best = np.random.default_rng(seed), np.zeros(len(src), bool)
    for _ in range(trials):
        some = rng.choice(len(src), 4, replace=False)
        try:
            inside = residuals(fit(src[some], dst[some]), src, dst) <= threshold
        except (ValueError, np.linalg.LinAlgError):
            continue
        if inside.sum() > best.sum():
            best = inside
    if best.sum() < 4:
        raise ValueError("no consensus")
    return fit(src[best], dst[best]), best


def homographies(points: DataFrame) -> DataFrame:
    """(camera_id, h, mean_error, inliers, error) per camera from rows (camera_id, n, x, y, u, v); a camera's points are a few clicks."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        src, dst = pdf[["x", "y"]].to_numpy(float), pdf[["u", "v"]].to_numpy(float)
        try:
            h, inside = solve_homography(src, dst)
            row = (h.ravel().tolist(), float(residuals(h, src[inside], dst[inside]).mean()), int(inside.sum()), None)
        except (ValueError, np.linalg.LinAlgError) as e:
            row = (None, None, 0, str(e))
        return pd.DataFrame([(pdf["camera_id"].iloc[0], *row)], columns=["camera_id", "h", "mean_error", "inliers", "error"])

    return points.groupBy("camera_id").applyInPandas(solve, "camera_id long, h array<double>, mean_error double, inliers int, error string")
