"""Hexagon cells: the published H3 grid as Columns.

A sphere is projected on the 20 faces of an icosahedron, each with a plane of hexagons. Resolution 0
has 122 cells (12 of them pentagons, round the vertices); each cell has seven children (pentagons six), told by a digit
from 0 to 6. An id packs resolution, base cell and digits in a BIGINT; ``hex_text`` gives the usual
text form. Odd resolutions ("class III") are turned by asin(sqrt(3/28)) against the even ones.

Planes use axial coordinates (q, r): q along the face's first axis, r along its second one, 120 degrees
further to the left. Digits 1 to 6 are steps k, j, j+k, i, i+k, i+j, where i = q, j = r and k = -(q + r).

Only the orientation of the icosahedron and the faces that cells on its edges and vertices are
counted to are fixed values. Neighbours of faces, numbers of base cells (by falling latitude),
their places on all faces and turns between faces follow from the geometry.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_RESOLUTION = 7  # edges of about 1.2 km
MAX_RESOLUTION = 15

# Latitude and longitude of each face's centre and the azimuth of its first axis, in radians.
FACES = [
    (0.803582649718989942, 1.248397419617396099, 5.619958268523939882),
    (1.307747883455638156, 2.536945009877921159, 5.760339081714187279),
    (1.054751253523952054, -1.347517358900396623, 0.780213654393430055),
    (0.600191595538186799, -0.450603909469755746, 0.430469363979999913),
    (0.491715428198773866, 0.401988202911306943, 6.130269123335111400),
    (0.172745327415618701, 1.678146885280433686, 2.692877706530642877),
    (0.605929321571350690, 2.953923329812411617, 2.982963003477243874),
    (0.427370518328979641, -1.888876200336285401, 3.532912002790141181),
    (-0.079066118549212831, -0.733429513380867741, 3.494305004259568154),
    (-0.230961644455383637, 0.506495587332349035, 3.003214169499538391),
    (0.079066118549212831, 2.408163140208925497, 5.930472956509811562),
    (0.230961644455383637, -2.635097066257444203, 0.138378484090254847),
    (-0.172745327415618701, -1.463445768309359553, 0.448714947059150361),
    (-0.605929321571350690, -0.187669323777381622, 0.158629650112549365),
    (-0.427370518328979641, 1.252716453253507838, 5.891865957979238535),
    (-0.600191595538186799, 2.690988744120037492, 2.711123289609793325),
    (-0.491715428198773866, -2.739604450678486295, 3.294508837434268316),
    (-0.803582649718989942, -1.893195233972397139, 3.804819692245439833),
    (-1.307747883455638156, -0.604647643711872080, 3.664438879055192436),
    (-1.054751253523952054, 1.794075294689396615, 2.361378999196363184),
]
# The face that a base cell on an edge or vertex of the icosahedron is counted to.
HOME_FACES = {
    1: 2, 4: 0, 5: 1, 11: 1, 13: 3, 14: 11, 19: 2, 22: 0, 24: 10, 28: 4, 30: 0, 35: 11, 38: 12, 39: 6, 40: 7, 43: 3,
    49: 14, 52: 10, 53: 4, 54: 12, 58: 13, 63: 6, 67: 5, 68: 16, 69: 8, 72: 7, 78: 15, 81: 14, 82: 13, 83: 5, 86: 9,
    91: 17, 93: 16, 97: 8, 99: 17, 102: 19, 107: 9, 108: 15, 110: 18, 116: 18, 117: 19, 120: 19,
}
#: Distance of neighbouring cells of resolution 0 on the plane of a face.
UNIT = (3 - math.sqrt(5)) / 2
TURN = math.asin(math.sqrt(3 / 28))

DIGITS = {(0, 0): 0, (-1, -1): 1, (0, 1): 2, (-1, 0): 3, (1, 0): 4, (0, -1): 5, (1, 1): 6}
STEPS = sorted(DIGITS, key=DIGITS.get)
CORNERS = [(2, 0), (0, 2), (-2, -2)]  # of a face, at resolution 0
EDGES = [(0, 1), (1, 2), (0, 2)]  # of a face, by its corners
BEYOND = [(1, 1), (-2, 1), (1, -2)]  # what of (q, r) exceeds 2 beyond each of these edges


def turned(q: int, r: int, times: int = 1) -> tuple[int, int]:
    """A place turned to the left by so many sixths."""
    for _ in range(times % 6):
        q, r = q - r, q
    return q, r


LEFT = [DIGITS[turned(*step)] for step in STEPS]


def frames() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre of each face and the directions of its plane's axes (x is the first axis, y is to its left)."""
    lat, lon, azimuth = np.array(FACES).T
    centre = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)
    north = np.stack([-np.sin(lat) * np.cos(lon), -np.sin(lat) * np.sin(lon), np.cos(lat)], 1)
    east = np.stack([-np.sin(lon), np.cos(lon), 0 * lon], 1)
    at = lambda a: np.cos(a)[:, None] * north + np.sin(a)[:, None] * east
    return centre, at(azimuth), at(azimuth - math.pi / 2)


CENTRE, X_AXIS, Y_AXIS = frames()


def on_sphere(face: int, q: float, r: float) -> np.ndarray:
    """The point of a place of resolution 0."""
    p = CENTRE[face] + UNIT * ((q - r / 2) * X_AXIS[face] + r * math.sqrt(3) / 2 * Y_AXIS[face])
    return p / np.linalg.norm(p)


def same(p: np.ndarray, q: np.ndarray) -> bool:
    return bool(np.linalg.norm(p - q) < 1e-6)


@cache
def neighbour(face: int, edge: int) -> tuple[int, int, tuple[int, int]]:
    """The face beyond an edge, turns to its axes, and the place (resolution 0) of its centre on this face's plane."""
    ends = [CORNERS[k] for k in EDGES[edge]]
    centre = (ends[0][0] + ends[1][0], ends[0][1] + ends[1][1])
    points = [on_sphere(face, *e) for e in ends]
    for other in range(20):
        for turns in range(6):
            moved = [turned(q - centre[0], r - centre[1], turns) for q, r in ends]
            if other != face and all(same(on_sphere(other, *m), p) for m, p in zip(moved, points)):
                return other, turns, centre
    raise AssertionError("every edge has a face beyond it")


@cache
def base_cells() -> list[np.ndarray]:
    """Centres of the cells of resolution 0, from north to south."""
    found: list[np.ndarray] = []
    for face in range(20):
        for place in [*STEPS, *CORNERS]:
            p = on_sphere(face, *place)
            if not any(same(p, f) for f in found):
                found.append(p)
    return sorted(found, key=lambda p: -p[2])


def base_cell(p: np.ndarray) -> int:
    return next(i for i, c in enumerate(base_cells()) if same(c, p))


@cache
def pentagons() -> frozenset[int]:
    return frozenset(base_cell(on_sphere(f, *c)) for f in range(20) for c in CORNERS)


@cache
def home(cell: int) -> tuple[int, int, int]:
    """Home face of a base cell and its place there."""
    at = [(f, *place) for f in range(20) for place in [*STEPS, *CORNERS] if same(on_sphere(f, *place), base_cells()[cell])]
    return next(p for p in at if p[0] == HOME_FACES.get(cell, at[0][0]))


#: The five digits round a pentagon, to the left: there is nothing in direction 1.
ROUND_PENTAGON = [3, 5, 4, 6, 2]


@cache
def placed(face: int, q: int, r: int) -> tuple[int, int]:
    """Base cell at a place of resolution 0 on the plane of a face, and turns to its home face's axes."""
    for edge, (a, b) in enumerate(BEYOND):
        if a * q + b * r > 2:
            other, turns, centre = neighbour(face, edge)
            cell, more = placed(other, *turned(q - centre[0], r - centre[1], turns))
            return cell, (turns + more) % 6
    cell = base_cell(on_sphere(face, q, r))
    own = home(cell)[0]
    if own == face:
        return cell, 0
    if cell not in pentagons():
        return cell, next(turns for e in range(3) for other, turns, _ in [neighbour(face, e)] if other == own)
    p = base_cells()[cell]
    flat = [CENTRE[f] - (CENTRE[f] @ p) * p for f in (own, face)]
    right = math.atan2(p @ np.cross(flat[1], flat[0]), flat[0] @ flat[1])  # how far the face lies to the right of the home face
    sector = -round(right / (2 * math.pi / 5)) % 5
    inward = DIGITS[-q // 2, -r // 2]
    return cell, (sector - ROUND_PENTAGON.index(inward)) % 5


def pentagon_turns(turns: int, lead: int, left_corner: bool) -> int:
    """Turns of all digits of a cell in a pentagon, by turns between faces and the first digit that isn't 0.

    Nothing lies in direction 1: that part belongs to the next one that exists, and turning passes over it.
    """
    if not lead:
        return 0
    total = 0
    if lead == 1:
        total = -1 if left_corner else 1
        lead = LEFT.index(lead) if left_corner else LEFT[lead]
    for _ in range(turns):
        lead, total = LEFT[lead], total + 1
        if lead == 1:
            lead, total = LEFT[lead], total + 1
    return total % 6


def _normal(q: int, r: int) -> bool:
    """Whether a place can occur at resolution 0: no coordinate beyond 2."""
    least = min(q, r, 0)
    return max(q - least, r - least, -least) <= 2


@cache
def base_table() -> list[int]:
    """By (face, q, r), q and r from -2 to 2: base cell + 128 * turns, + 1024 on a pentagon, + 2048 where that is the face's second corner."""

    def entry(face: int, q: int, r: int) -> int:
        if not _normal(q, r):
            return -1
        cell, turns = placed(face, q, r)
        return cell + 128 * turns + 1024 * (cell in pentagons()) + 2048 * ((q, r) == CORNERS[1])

    return [entry(f, q, r) for f in range(20) for q in range(-2, 3) for r in range(-2, 3)]


def _numbers(values, kind: str) -> Column:
    """A table as a constant array: one literal to write, which the optimizer turns into numbers once."""
    cast = float if kind == "double" else int
    return F.split(F.lit(",".join(repr(cast(v)) for v in values)), ",").cast(f"array<{kind}>")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _bits(cell: Column, place: int, mask: int) -> Column:
    return F.shiftright(cell, place).bitwiseAND(F.lit(mask)).cast("int")


def _digit(cell: Column, level: Column) -> Column:
    return F.call_function("shiftright", cell, (MAX_RESOLUTION - level) * 3).bitwiseAND(F.lit(7)).cast("int")


@cache
def _tables() -> dict[str, np.ndarray]:
    """What cells_of_points looks up. ``to_q`` and ``to_r``: directions whose products with a point, divided by that of the
    face's centre, are q and r in units of resolution 0; those of even resolutions, then those of odd ones."""
    to_r = [(math.cos(t) * Y_AXIS - math.sin(t) * X_AXIS) * 2 / math.sqrt(3) / UNIT for t in (0.0, TURN)]
    to_q = [(math.cos(t) * X_AXIS + math.sin(t) * Y_AXIS) / UNIT + r / 2 for t, r in zip((0.0, TURN), to_r)]
    return {
        "to_q": np.concatenate(to_q), "to_r": np.concatenate(to_r), "base": np.array(base_table()),
        "digit": np.array([DIGITS.get((a, b), 0) for a in (-1, 0, 1) for b in (-1, 0, 1)]),
        "special": np.array([pentagon_turns(t, lead, corner) for corner in (False, True) for t in range(6) for lead in range(7)]),
        "turned": np.array([DIGITS[turned(*step, t)] for t in range(6) for step in STEPS]),
    }


def cells_of_points(lat: np.ndarray, lon: np.ndarray, resolution: np.ndarray) -> np.ndarray:
    """Ids of the cells that hold points of the globe (degrees), at resolutions from 0 to MAX_RESOLUTION."""
    table = _tables()
    lat, lon, resolution = np.radians(lat), np.radians(lon), resolution.astype(np.int64)
    p = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)
    each = p @ CENTRE.T
    face = each.argmax(1)
    row, units = face + resolution % 2 * 20, math.sqrt(7) ** resolution.astype(float) / each.max(1)
    q, r = ((p * table[k][row]).sum(1) * units for k in ("to_q", "to_r"))
    a, b, c = np.rint(q - r), np.rint(r), np.rint(-q)
    off_a, off_b, off_c = np.abs(a - q + r), np.abs(b - r), np.abs(c + q)  # the one that is off most follows from the others
    worst_a = (off_a > off_b) & (off_a > off_c)
    worst_b = ~worst_a & (off_b > off_c)
    q, r = np.where(worst_a | worst_b, -c, a + b).astype(np.int64), np.where(worst_b, -a - c, b).astype(np.int64)
    digits = np.zeros((MAX_RESOLUTION + 1, len(q)), np.int64)
    lead = np.zeros(len(q), np.int64)
    for level in range(int(resolution.max(initial=0)), 0, -1):
        on, odd = level <= resolution, level % 2
        up_q, up_r = (3 * q - r, q + 2 * r) if odd else (2 * q + r, 3 * r - q)
        up_q, up_r = (2 * up_q + 7) // 14, (2 * up_r + 7) // 14
        dq = q - (2 * up_q + up_r if odd else 3 * up_q - up_r)
        dr = r - (3 * up_r - up_q if odd else up_q + 2 * up_r)
        digits[level] = np.where(on, table["digit"][np.where(on, dq * 3 + dr + 4, 4)], 0)
        lead = np.where(digits[level] > 0, digits[level], lead)
        q, r = np.where(on, up_q, q), np.where(on, up_r, r)
    entry = table["base"][face * 25 + (q + 2) * 5 + r + 2]
    turns = entry >> 7 & 7
    turns = np.where(entry >> 10 & 1 == 1, table["special"][(entry >> 11) * 42 + turns * 7 + lead], turns)
    one = np.int64(1)
    cell = (one << 59) + (resolution << 52) + ((entry & 127) << 45) + (one << (MAX_RESOLUTION - resolution) * 3) - 1
    for level in range(1, int(resolution.max(initial=0)) + 1):
        cell += np.where(level <= resolution, table["turned"][turns % 6 * 7 + digits[level]], 0) << (MAX_RESOLUTION - level) * 3
    return cell


def hex_cell(lat: Column, lon: Column, resolution: int | Column = DEFAULT_RESOLUTION) -> Column:
    """Id of the cell that holds a point (degrees); null where a coordinate is null, not finite or on no globe.

    A resolution in a column must be between 0 and MAX_RESOLUTION, else the id is null.
    """
    if not isinstance(resolution, Column):
        if not 0 <= resolution <= MAX_RESOLUTION:
            raise ValueError(f"resolution must be between 0 and {MAX_RESOLUTION}")
        resolution = F.lit(resolution)
    resolution = resolution.cast("int")
    # directions whose products with a point, divided by that of the face's centre, are q and r in units of resolution 0:
    # those of even resolutions, then those of odd ones
    to_r = [(math.cos(t) * Y_AXIS - math.sin(t) * X_AXIS) * 2 / math.sqrt(3) / UNIT for t in (0.0, TURN)]
    to_q = [(math.cos(t) * X_AXIS + math.sin(t) * Y_AXIS) / UNIT + r / 2 for t, r in zip((0.0, TURN), to_r)]
    to_q, to_r = np.concatenate(to_q), np.concatenate(to_r)
    lat, lon = lat.cast("double"), lon.cast("double")

    def product(p: Column, axes: np.ndarray, row: Column) -> Column:
        return sum(p[c] * F.get(_numbers(axes[:, k], "double"), row) for k, c in enumerate("xyz"))

    def nearest(p: Column) -> Column:
        each = F.array(*[sum(p[c] * float(v) for c, v in zip("xyz", axis)) for axis in CENTRE])
        best = lambda d: F.struct(F.array_max(d).alias("d"), (F.array_position(d, F.array_max(d)).cast("int") - 1).alias("face"))
        return _let(_let(each, best), lambda b: on_plane(p, b["d"], b["face"]))

    def on_plane(p: Column, d: Column, face: Column) -> Column:
        row, units = face + resolution % 2 * 20, F.pow(F.lit(math.sqrt(7)), resolution)
        q, r = product(p, to_q, row) / d * units, product(p, to_r, row) / d * units
        exact = F.struct((q - r).alias("a"), r.alias("b"), (-q).alias("c"))
        return _let(exact, lambda x: _let(F.struct(*[F.rint(x[c]).alias(c) for c in "abc"]), lambda n: address(x, n, face)))

    def address(x: Column, n: Column, face: Column) -> Column:
        off = {c: F.abs(n[c] - x[c]) for c in "abc"}  # the coordinate that is off most follows from the others
        worst_a = (off["a"] > off["b"]) & (off["a"] > off["c"])
        worst_b = ~worst_a & (off["b"] > off["c"])
        r = F.when(worst_b, -n["a"] - n["c"]).otherwise(n["b"])
        q = F.when(worst_a | worst_b, -n["c"]).otherwise(n["a"] + n["b"])
        start = F.struct(
            q.cast("long").alias("q"), r.cast("long").alias("r"), F.lit(0).cast("long").alias("digits"), F.lit(0).alias("lead")
        )
        levels = F.when(resolution > 0, F.sequence(resolution, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(levels, start, up, lambda s: packed(s, face))

    def up(s: Column, level: Column) -> Column:
        odd = level % 2 == 1
        q, r = s["q"], s["r"]
        parent = F.struct(
            F.floor((F.when(odd, q * 3 - r).otherwise(q * 2 + r) * 2 + 7) / 14).alias("q"),
            F.floor((F.when(odd, q + r * 2).otherwise(r * 3 - q) * 2 + 7) / 14).alias("r"),
        )

        def with_digit(p: Column) -> Column:
            dq = q - F.when(odd, p["q"] * 2 + p["r"]).otherwise(p["q"] * 3 - p["r"])
            dr = r - F.when(odd, p["r"] * 3 - p["q"]).otherwise(p["q"] + p["r"] * 2)
            known = [DIGITS.get((a, b), 0) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            digit = F.get(_numbers(known, "int"), (dq * 3 + dr + 4).cast("int"))
            shift = (MAX_RESOLUTION - level) * 3
            return _let(digit, lambda d: F.struct(
                p["q"].alias("q"), p["r"].alias("r"),
                (s["digits"] + F.call_function("shiftleft", d.cast("long"), shift)).alias("digits"),
                F.when(d != 0, d).otherwise(s["lead"]).alias("lead"),
            ))

        return _let(parent, with_digit)

    def packed(s: Column, face: Column) -> Column:
        entry = F.get(_numbers(base_table(), "int"), (face * 25 + (s["q"] + 2) * 5 + s["r"] + 2).cast("int"))
        special = [pentagon_turns(t, lead, corner) for corner in (False, True) for t in range(6) for lead in range(7)]
        unused = F.call_function("shiftleft", F.lit(1).cast("long"), (MAX_RESOLUTION - resolution) * 3) - 1
        head = F.lit(1 << 59) + F.shiftleft(resolution.cast("long"), 52) + unused

        def whole(e: Column) -> Column:
            turns = F.shiftright(e, 7).bitwiseAND(F.lit(7))
            in_pentagon = F.get(_numbers(special, "int"), F.shiftright(e, 11) * 42 + turns * 7 + s["lead"])
            by = F.when(F.shiftright(e, 10).bitwiseAND(F.lit(1)) == 1, in_pentagon).otherwise(turns)
            base = F.shiftleft(e.bitwiseAND(F.lit(127)).cast("long"), 45)
            return base + head + _let(by, lambda t: _turned_digits(s["digits"], t, resolution))

        return _let(entry, whole)

    rad_lat, rad_lon = F.radians(lat), F.radians(lon)
    p = F.struct(
        (F.cos(rad_lat) * F.cos(rad_lon)).alias("x"), (F.cos(rad_lat) * F.sin(rad_lon)).alias("y"), F.sin(rad_lat).alias("z")
    )
    known = lat.between(-90.0, 90.0) & lon.between(-360.0, 360.0) & resolution.between(0, MAX_RESOLUTION)
    return F.when(known, _let(p, nearest))


def hex_cell_by_batch(lat: Column, lon: Column, resolution: int | Column = DEFAULT_RESOLUTION) -> Column:
    """As :func:`hex_cell`, for whole tables: the address takes a dozen steps a level, and Arrow batches take them at once.
    For columns of the table alone, not for what other expressions work out: that is where hex_cell is at home."""
    if not isinstance(resolution, Column):
        if not 0 <= resolution <= MAX_RESOLUTION:
            raise ValueError(f"resolution must be between 0 and {MAX_RESOLUTION}")
        resolution = F.lit(resolution)

    def run(lat: pd.Series, lon: pd.Series, level: pd.Series) -> pd.Series:
        known = (lat.between(-90.0, 90.0) & lon.between(-360.0, 360.0) & level.between(0, MAX_RESOLUTION)).to_numpy()
        cells = pd.array(np.zeros(len(known), np.int64), "Int64")
        cells[known] = cells_of_points(*(v.to_numpy()[known] for v in (lat, lon, level)))
        cells[~known] = pd.NA
        return pd.Series(cells)

    return F.pandas_udf(run, "long")(lat.cast("double"), lon.cast("double"), resolution.cast("int"))


def _turned_digits(cell: Column, turns: Column, resolution: Column) -> Column:
    """The digits of a cell, turned to the left by so many sixths, packed at their places."""
    table = [DIGITS[turned(*step, t)] for t in range(6) for step in STEPS]

    def one(total: Column, level: Column) -> Column:
        digit = F.get(_numbers(table, "int"), F.pmod(turns, F.lit(6)) * 7 + _digit(cell, level))
        return total + F.call_function("shiftleft", digit.cast("long"), (MAX_RESOLUTION - level) * 3)

    levels = F.when(resolution > 0, F.sequence(F.lit(1), resolution)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(levels, F.lit(0).cast("long"), one)


def hex_text(cell: Column) -> Column:
    return F.lower(F.hex(cell))


def hex_from_text(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")


def hex_resolution(cell: Column) -> Column:
    return _bits(cell, 52, 15)


def hex_base_cell(cell: Column) -> Column:
    return _bits(cell, 45, 127)


def hex_is_pentagon(cell: Column) -> Column:
    """Pentagons have no digit but 0."""
    unused = F.call_function("shiftright", F.lit((1 << 45) - 1), hex_resolution(cell) * 3)
    return hex_base_cell(cell).isin(*sorted(pentagons())) & (cell.bitwiseAND(F.lit((1 << 45) - 1)) == unused)


def hex_parent(cell: Column, resolution: int) -> Column:
    """The cell of a coarser resolution that a cell belongs to; null if it is coarser itself."""
    free = (1 << (3 * (MAX_RESOLUTION - resolution))) - 1
    head = cell.bitwiseAND(F.lit(~(15 << 52))).bitwiseOR(F.lit(resolution << 52))
    return F.when(hex_resolution(cell) >= resolution, head.bitwiseOR(F.lit(free)))


def _face_place(cell: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a struct: face, q and r of a cell's centre in the plane of even resolution that is as fine or one finer, its
    ``scale`` (cells of that plane along one of resolution 0), whether the cell is of odd resolution and a pentagon."""
    homes = [home(c) for c in range(122)]
    by_base = lambda k: F.get(_numbers([h[k] for h in homes], "int"), hex_base_cell(cell))
    resolution = hex_resolution(cell)
    five = hex_base_cell(cell).isin(*sorted(pentagons()))
    levels = F.when(resolution > 0, F.sequence(F.lit(1), resolution)).otherwise(F.array().cast("array<int>"))
    lead = F.coalesce(F.get(F.filter(F.transform(levels, lambda v: _digit(cell, v)), lambda d: d > 0), F.lit(0)), F.lit(0))

    def walk(first: Column) -> Column:
        # round a pentagon, what lies in direction 5 goes on on the home face's plane in direction 1
        turns = F.when(five & (first == 5), F.lit(5)).otherwise(F.lit(0))
        own = F.struct(_turned_digits(cell, turns, resolution).alias("digits"))
        return _let(own, lambda o: F.aggregate(levels, start, lambda s, v: down(s, v, _digit(o["digits"], v)), lambda s: even(s, first)))

    start = F.struct(by_base(0).alias("face"), by_base(1).cast("long").alias("q"), by_base(2).cast("long").alias("r"))

    def down(s: Column, level: Column, digit: Column) -> Column:
        odd = level % 2 == 1
        q = F.when(odd, s["q"] * 2 + s["r"]).otherwise(s["q"] * 3 - s["r"]) + F.get(_numbers([x[0] for x in STEPS], "int"), digit)
        r = F.when(odd, s["r"] * 3 - s["q"]).otherwise(s["q"] + s["r"] * 2) + F.get(_numbers([x[1] for x in STEPS], "int"), digit)
        return F.struct(s["face"].alias("face"), q.cast("long").alias("q"), r.cast("long").alias("r"))

    def even(s: Column, first: Column) -> Column:
        odd = resolution % 2 == 1
        scale = F.pow(F.lit(7.0), F.floor((resolution + 1) / 2)).cast("long")
        q, r = F.when(odd, s["q"] * 3 - s["r"]).otherwise(s["q"]), F.when(odd, s["q"] + s["r"] * 2).otherwise(s["r"])
        placed_at = F.struct(s["face"].alias("face"), q.alias("q"), r.alias("r"), scale.alias("scale"))

        def own_face(x: Column) -> Column:
            # round a pentagon, what lies in direction 4 and beyond the edge of the missing direction turns about the corner
            beyond = x["q"] - x["r"] * 2 > x["scale"] * 2
            q, r = x["q"] - x["scale"] * 2, x["r"]
            apart = five & (first == 4) & beyond & (x["r"] < 0) & (x["q"] >= x["r"])
            again = F.struct(
                x["face"].alias("face"), F.when(apart, r + x["scale"] * 2).otherwise(x["q"]).alias("q"),
                F.when(apart, r - q).otherwise(x["r"]).alias("r"),
            )
            moved = F.aggregate(F.lit([1, 2, 3, 4]), again, lambda s, _: _onto_its_face(s, x["scale"] * 2))
            return _let(moved, lambda m: f(F.struct(
                m["face"].alias("face"), m["q"].alias("q"), m["r"].alias("r"), x["scale"].alias("scale"), odd.alias("odd"),
                hex_is_pentagon(cell).alias("five"),
            )))

        return _let(placed_at, own_face)

    return _let(lead, walk)


def _beyond(s: Column, edge: int) -> Column:
    a, b = BEYOND[edge]
    return s["q"] * a + s["r"] * b


def _turn_on_plane(q: Column, r: Column, turns: Column) -> tuple[Column, Column]:
    """A place turned by 0 to 5 sixths."""
    to = [(turned(1, 0, t), turned(0, 1, t)) for t in range(6)]
    part = lambda k, c: F.get(_numbers([x[k][c] for x in to], "int"), turns)
    return q * part(0, 0) + r * part(1, 0), q * part(0, 1) + r * part(1, 1)


def _across(s: Column, edge: Column, size: Column) -> Column:
    """A place on the plane of the face beyond an edge (0 to 2); ``size``: coordinate of a corner."""
    table = [neighbour(f, e) for f in range(20) for e in range(3)]
    by = lambda pick: F.get(_numbers([pick(t) for t in table], "int"), s["face"] * 3 + edge)
    q, r = s["q"] - by(lambda t: t[2][0]) * size / 2, s["r"] - by(lambda t: t[2][1]) * size / 2
    q, r = _turn_on_plane(q, r, by(lambda t: t[1]))
    return F.struct(by(lambda t: t[0]).alias("face"), q.alias("q"), r.alias("r"))


def _onto_its_face(s: Column, size: Column) -> Column:
    """A place on the plane of the next face if it lies beyond an edge of its own."""
    edge = F.when(_beyond(s, 0) > size, 0).when(_beyond(s, 1) > size, 1).when(_beyond(s, 2) > size, 2)

    def whole(x: Column) -> Column:
        return F.struct(x["face"].alias("face"), F.rint(x["q"]).cast("long").alias("q"), F.rint(x["r"]).cast("long").alias("r"))

    return _let(edge, lambda e: F.when(e.isNull(), whole(s)).otherwise(_let(_across(s, e, size), whole)))


def _on_globe(s: Column, scale: Column) -> Column:
    """lat and lon in degrees of a place; ``scale``: units along one of resolution 0."""
    axes = lambda values, k: F.get(_numbers(values[:, k], "double"), s["face"])
    x = (s["q"] - s["r"] / 2) / scale * UNIT
    y = s["r"] / scale * (UNIT * math.sqrt(3) / 2)
    p = F.struct(*[(axes(CENTRE, k) + x * axes(X_AXIS, k) + y * axes(Y_AXIS, k)).alias(c) for k, c in enumerate("xyz")])
    return _let(p, lambda v: F.struct(
        F.degrees(F.atan2(v["z"], F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]))).alias("lat"),
        F.degrees(F.atan2(v["y"], v["x"])).alias("lon"),
    ))


def hex_centre(cell: Column) -> Column:
    """lat and lon of a cell's centre, as a struct; null for null."""
    centre = _let(cell, lambda c: _face_place(c, lambda s: _on_globe(s, s["scale"])))
    return F.when(cell.isNotNull(), centre)


def hex_ring(cell: Column) -> Column:
    """Closed border of a cell as an array of [lon, lat] pairs.

    Corners come first to last to the left. Where the border of a cell of odd resolution crosses an edge of
    the icosahedron, the crossing is a point of its own, as lines bend there.
    """
    even = [(2, 1), (1, 2), (-1, 1), (-2, -1), (-1, -2), (1, -1)]
    odd = [(5, 4), (1, 5), (-4, 1), (-5, -4), (-1, -5), (4, -1)]  # in thirds of a unit, as the even ones

    def corners(s: Column) -> Column:
        def corner(k: Column) -> Column:
            q, r = (F.get(_numbers([v[c] for v in (*even, *odd)], "int"), k + F.when(s["odd"], 6).otherwise(0)) for c in (0, 1))
            at = F.struct(s["face"].alias("face"), (s["q"] * 3 + q).alias("q"), (s["r"] * 3 + r).alias("r"))
            return F.aggregate(F.lit([1, 2, 3, 4]), at, lambda x, _: _onto_its_face(x, s["scale"] * 6))

        numbers = F.when(s["five"], F.lit([0, 1, 2, 3, 4])).otherwise(F.lit([0, 1, 2, 3, 4, 5]))
        return _let(F.transform(numbers, corner), lambda c: joined(s, c))

    def joined(s: Column, c: Column) -> Column:
        size = s["scale"] * 6

        def edge_to(a: Column, b: Column) -> Column:
            """Number of the edge between two faces, on the first one's plane; -1 if they have none in common."""
            beyond = _numbers([neighbour(f, e)[0] for f in range(20) for e in range(3)], "int")
            return F.array_position(F.slice(beyond, a["face"] * 3 + 1, F.lit(3)), b["face"]).cast("int") - 1

        def crossing(a: Column, b: Column) -> Column:
            """The point where the line from a to b leaves a's face, if it does so between them."""
            edges = F.struct(edge_to(a, b).alias("out"), edge_to(b, a).alias("back"))
            return F.when(s["odd"] & (a["face"] != b["face"]), _let(edges, lambda e: F.when(e["out"] >= 0, meeting(a, b, e))))

        def meeting(a: Column, b: Column, edges: Column) -> Column:
            def out(x: Column) -> Column:
                return F.when(edges["out"] == 0, _beyond(x, 0)).when(edges["out"] == 1, _beyond(x, 1)).otherwise(_beyond(x, 2))

            def cut(far: Column) -> Column:
                share = (size - out(a)) / (out(far) - out(a))
                q, r = (a[c] + share * (far[c] - a[c]) for c in "qr")
                at = F.struct(a["face"].alias("face"), q.alias("q"), r.alias("r"))
                return F.when((share > 1e-9) & (share < 1 - 1e-9), _let(at, lambda x: _on_globe(x, s["scale"] * 3)))

            return _let(_across(b, edges["back"], size), cut)

        def side(k: Column) -> Column:
            a, b = F.get(c, k), F.get(c, F.pmod(k + 1, F.size(c)))
            return _let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.array(_on_globe(x["a"], s["scale"] * 3), crossing(x["a"], x["b"])))

        points = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.size(c) - 1), side)), lambda p: p.isNotNull())
        pairs = F.transform(points, lambda p: F.array(p["lon"], p["lat"]))
        return _let(pairs, lambda x: F.concat(x, F.slice(x, 1, 1)))

    return F.when(cell.isNotNull(), _let(cell, lambda c: _face_place(c, corners)))


def hex_feature(cell: Column, **properties: Column) -> Column:
    """GeoJSON feature text: the cell polygon with the given properties; the id is in text form."""
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(hex_text(cell).alias("cell"), *[c.alias(k) for k, c in properties.items()]).alias("properties"),
            F.struct(F.lit("Polygon").alias("type"), F.array(hex_ring(cell)).alias("coordinates")).alias("geometry"),
        ),
        {"ignoreNullFields": "false"},
    )
