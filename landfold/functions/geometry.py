"""Planar and spatial geometry as Column expressions (x east, y up, z south)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- local frame -----------------------------------------------------------

def to_local(easting, northing, origin_e: float, origin_n: float) -> tuple[Column, Column]:
    """Projected grid metres to the local frame: x = E - e0, z = n0 - N."""
    return col(easting) - F.lit(origin_e), F.lit(origin_n) - col(northing)


def from_local(x, z, origin_e: float, origin_n: float) -> tuple[Column, Column]:
    return col(x) + F.lit(origin_e), F.lit(origin_n) - col(z)


# --- vectors ---------------------------------------------------------------

def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Vec) -> Vec:
    """Unit vector; NULL components for a zero vector."""
    n = F.nullif(norm(a), F.lit(0.0))
    return a[0] / n, a[1] / n, a[2] / n


def basis(fx, fy, fz) -> list[Column]:
    """Right, up and forward of a view along (fx, fy, fz), as columns rx..rz, ux..uz, fx..fz; straight up or down has none."""
    f = normalise((col(fx), col(fy), col(fz)))
    r = normalise(cross(f, (F.lit(0.0), F.lit(1.0), F.lit(0.0))))
    return [c.alias(f"{n}{a}") for n, v in (("r", r), ("u", cross(r, f)), ("f", f)) for a, c in zip("xyz", v)]


def corners(prefix: str = "") -> tuple[Vec, Vec, Vec]:
    """The three corners of a triangle row with columns x1 y1 z1 .. z3."""
    return tuple(tuple(F.col(f"{prefix}{axis}{i}") for axis in "xyz") for i in (1, 2, 3))


def face_normal(prefix: str = "") -> Vec:
    a, b, c = corners(prefix)
    return cross(sub(b, a), sub(c, a))


def face_area(prefix: str = "") -> Column:
    return norm(face_normal(prefix)) / 2


def slope_degrees(unit_ny) -> Column:
    return F.degrees(F.acos(F.least(F.abs(col(unit_ny)), F.lit(1.0))))


def barycentric_xz(px: Column, pz: Column, prefix: str = "") -> tuple[Column, Column, Column]:
    """Weights of corners 2 and 3 in plan, and the height of the face plane; NULL if edge-on."""
    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = corners(prefix)
    den = (bx - ax) * (cz - az) - (bz - az) * (cx - ax)
    den = F.when(F.abs(den) >= 1e-14, den)
    dx, dz = px - ax, pz - az
    u = (dx * (cz - az) - dz * (cx - ax)) / den
    v = ((bx - ax) * dz - (bz - az) * dx) / den
    return u, v, ay + u * (by - ay) + v * (cy - ay)


# --- 4x4 column-major matrices ----------------------------------------------

def apply_matrix(m, x, y, z) -> Vec:
    m, x, y, z = col(m), col(x), col(y), col(z)
    return tuple(m[i] * x + m[i + 4] * y + m[i + 8] * z + m[i + 12] for i in range(3))


def multiply_matrix(a, b) -> Column:
    """a·b, both column-major arrays of sixteen doubles."""
    a, b = col(a), col(b)
    return F.array(*[
        a[r] * b[4 * c] + a[r + 4] * b[4 * c + 1] + a[r + 8] * b[4 * c + 2] + a[r + 12] * b[4 * c + 3]
        for c in range(4) for r in range(4)
    ])


# --- segments and boxes -----------------------------------------------------

def seg_dist_sq(px, pz, x1, z1, x2, z2) -> Column:
    """Squared distance from a point to a segment; a zero-length segment is its start."""
    px, pz, x1, z1, x2, z2 = map(col, (px, pz, x1, z1, x2, z2))
    dx, dz = x2 - x1, z2 - z1
    length = dx * dx + dz * dz
    t = ((px - x1) * dx + (pz - z1) * dz) / F.when(length == 0, F.lit(1.0)).otherwise(length)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ez = px - x1 - t * dx, pz - z1 - t * dz
    return ex * ex + ez * ez


def seg_dist(px, pz, x1, z1, x2, z2) -> Column:
    return F.sqrt(seg_dist_sq(px, pz, x1, z1, x2, z2))


def orient(ax, az, bx, bz, cx, cz) -> Column:
    return (bx - ax) * (cz - az) - (bz - az) * (cx - ax)


def seg_intersects(a: Sequence, b: Sequence) -> Column:
    """Do two segments (x1,z1,x2,z2) meet; touching and collinear overlap count."""
    ax, az, bx, bz = map(col, a)
    cx, cz, dx, dz = map(col, b)
    o1, o2 = orient(ax, az, bx, bz, cx, cz), orient(ax, az, bx, bz, dx, dz)
    o3, o4 = orient(cx, cz, dx, dz, ax, az), orient(cx, cz, dx, dz, bx, bz)

    def on(o, px, pz, x1, z1, x2, z2):
        return (
            (o == 0) & px.between(F.least(x1, x2), F.greatest(x1, x2))
            & pz.between(F.least(z1, z2), F.greatest(z1, z2))
        )

    proper = (F.signum(o1) * F.signum(o2) < 0) & (F.signum(o3) * F.signum(o4) < 0)
    return (
        proper
        | on(o1, cx, cz, ax, az, bx, bz) | on(o2, dx, dz, ax, az, bx, bz)
        | on(o3, ax, az, cx, cz, dx, dz) | on(o4, bx, bz, cx, cz, dx, dz)
    )


def seg_seg_dist_sq(a: Sequence, b: Sequence) -> Column:
    """Squared distance of two segments, 0 when they meet."""
    ends = F.least(
        seg_dist_sq(a[0], a[1], *b), seg_dist_sq(a[2], a[3], *b),
        seg_dist_sq(b[0], b[1], *a), seg_dist_sq(b[2], b[3], *a),
    )
    return F.when(seg_intersects(a, b), F.lit(0.0)).otherwise(ends)


def crosses_ray(px, pz, x1, z1, x2, z2) -> Column:
    """Does the eastward ray from the point cross the edge (half-open in z)?"""
    px, pz, x1, z1, x2, z2 = map(col, (px, pz, x1, z1, x2, z2))
    straddles = (z1 > pz) != (z2 > pz)
    return straddles & (px < (x2 - x1) * (pz - z1) / F.when(z2 != z1, z2 - z1) + x1)


def aabb_overlaps(a: Sequence, b: Sequence) -> Column:
    """Boxes as (min..., max...) of equal rank; touching counts."""
    a, b = list(map(col, a)), list(map(col, b))
    half = len(a) // 2
    test = F.lit(True)
    for i in range(half):
        test = test & (a[i] <= b[i + half]) & (b[i] <= a[i + half])
    return test


# --- rasters and lattices ---------------------------------------------------

def cell_of(value, size: float, origin: float = 0.0) -> Column:
    return F.floor((col(value) - F.lit(origin)) / F.lit(size)).cast("bigint")


def quantise(value, step: float) -> Column:
    """Nearest lattice index, ties to even."""
    return F.rint(col(value) / F.lit(step)).cast("bigint")


def slope_class(ny, roof: float = 0.85, wall: float = 0.25, ground: float = 0.6) -> Column:
    a = F.abs(col(ny))
    return (
        F.when(a >= roof, "roof").when(a >= ground, "ground").when(a <= wall, "wall").otherwise("slanted")
    )


def interp(x, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise-linear ramp, clamped at both ends; the knots may run up or down."""
    if xs[0] > xs[-1]:
        xs, ys = list(reversed(xs)), list(reversed(ys))
    x = col(x)
    out = F.when(x.isNull(), F.lit(None).cast("double")).when(x <= xs[0], F.lit(float(ys[0])))
    for (x0, y0), (x1, y1) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
        out = out.when(x < x1, F.lit(float(y0)) + (x - x0) * F.lit((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(float(ys[-1])))
