"""Affine matrices: composition, rescaling, straight grids and conversion between conventions."""

from __future__ import annotations

import numpy as np


def rescaled(m: np.ndarray, applied: tuple[float, float, float]) -> np.ndarray:
    """World matrix of a grid with ``applied`` times as many cells, about the origin."""
    out = np.array(m, float)
    out[:3, :3] = out[:3, :3] / np.asarray(applied, float)
    return out


def corners(dims: tuple[int, int, int]) -> np.ndarray:
    """The eight corner cells, homogeneous, as columns."""
    return np.array([[x, y, z, 1] for x in (0, dims[0] - 1) for y in (0, dims[1] - 1) for z in (0, dims[2] - 1)], float).T


def straight_grid(m: np.ndarray, dims: tuple[int, int, int], keep_sizes: bool = False, padding: int = 1) -> tuple[np.ndarray, tuple[int, int, int]]:
    """Matrix and size of an axis-parallel grid over the padded bounding box, with the smallest cell size or the own ones."""
    m = np.asarray(m, float)
    sizes = np.linalg.norm(m[:3, :3], axis=0)
    world = (m @ corners(dims))[:3]
    size = sizes if keep_sizes else np.full(3, sizes.min())
    low, high = world.min(1) - padding * size, world.max(1) + padding * size
    out = np.diag([*size, 1.0])
    out[:3, 3] = low
    # A whole number of cells may come out a rounding error above itself.
    return out, tuple(int(np.ceil(v - 1e-9)) + 1 for v in (high - low) / size)


def composed(*chain: np.ndarray) -> np.ndarray:
    """One matrix for a chain applied in order, first to last."""
    out = np.eye(4)
    for m in chain:
        out = np.asarray(m, float) @ out
    return out


def index_map(target: np.ndarray, source: np.ndarray, world: np.ndarray | None = None) -> np.ndarray:
    """Target indices to source indices, through world space and an optional world transform."""
    w = np.eye(4) if world is None else np.asarray(world, float)
    # Rounded, so that a cell that falls on a cell is not beside it by a rounding error.
    return np.round(np.linalg.inv(np.asarray(source, float)) @ w @ np.asarray(target, float), 12)


def itk_from_flirt(m: np.ndarray, reference: np.ndarray, ref_sizes, source: np.ndarray, src_sizes) -> np.ndarray:
    """A scaled-mm registration matrix as an LPS world transform from reference to source.

    Scaled-mm space counts cells times their size, with x reversed where the determinant is positive.
    """
    def to_mm(a: np.ndarray, sizes) -> np.ndarray:
        s = np.diag([*np.asarray(sizes, float)[:3], 1.0])
        if np.linalg.det(np.asarray(a, float)[:3, :3]) > 0:
            flip = np.diag([-1.0, 1, 1, 1])
            flip[0, 3] = (np.asarray(sizes, float)[3] - 1) * s[0, 0]
            s = flip @ s
        return s

    lps = np.diag([-1.0, -1, 1, 1])
    tr = lps @ np.asarray(reference, float) @ np.linalg.inv(to_mm(reference, ref_sizes))
    ts = lps @ np.asarray(source, float) @ np.linalg.inv(to_mm(source, src_sizes))
    return ts @ np.linalg.inv(np.asarray(m, float)) @ np.linalg.inv(tr)


def itk_text(m: np.ndarray) -> str:
    """The text form of an affine transform: nine matrix entries, then three translations."""
    m = np.asarray(m, float)
    values = " ".join(f"{v:.12g}" for v in [*m[:3, :3].ravel(), *m[:3, 3]])
    return f"#Insight Transform File V1.0\n#Transform 0\nTransform: MatrixOffsetTransformBase_double_3_3\nParameters: {values}\nFixedParameters: 0 0 0\n"


def parse_itk(text: str) -> np.ndarray:
    """The matrix of :func:`itk_text`."""
    v = next(line.split(":", 1)[1].split() for line in text.splitlines() if line.startswith("Parameters:"))
    v = [float(x) for x in v]
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = np.reshape(v[:9], (3, 3)), v[9:12]
    return out
