"""Points to cells of the public hexagonal index and back, over arrays.

The index lies on an icosahedron. On the plane of each face a lattice of hexagons is refined by sevens, and a
cell's digits say which of its parent's seven children it is. Here positions on a face are complex numbers in units
of the coarsest lattice, and faces are joined by unfolding: two neighbours share an edge, so one turn and shift brings
the plane of one over the other's. What cell a place on a face belongs to, and how the digits turn on the way to
the cell's own face, is worked out from that once, and not kept as tables.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np

#: Fixed values of the public index: the centre of each face (latitude, longitude) and the azimuth of its first axis, in radians.
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
#: Fixed values of the public index: each base cell's own face, and its place there as steps along the three axes.
BASE_CELLS = [
    (1, "100"), (2, "110"), (1, "000"), (2, "100"), (0, "200"), (1, "110"), (1, "001"), (2, "000"), (0, "100"), (2, "010"),
    (1, "010"), (1, "011"), (3, "100"), (3, "110"), (11, "200"), (4, "100"), (0, "000"), (6, "010"), (0, "001"), (2, "011"),
    (7, "001"), (2, "001"), (0, "110"), (6, "001"), (10, "200"), (6, "000"), (3, "000"), (11, "100"), (4, "110"), (3, "010"),
    (0, "011"), (4, "000"), (5, "010"), (0, "010"), (7, "010"), (11, "110"), (7, "000"), (10, "100"), (12, "200"), (6, "101"),
    (7, "101"), (4, "001"), (3, "001"), (3, "011"), (4, "010"), (6, "100"), (11, "000"), (8, "001"), (5, "001"), (14, "200"),
    (5, "000"), (12, "100"), (10, "110"), (4, "011"), (12, "110"), (7, "100"), (11, "010"), (10, "000"), (13, "200"), (10, "001"),
    (11, "001"), (9, "010"), (8, "010"), (6, "200"), (8, "000"), (9, "001"), (14, "100"), (5, "101"), (16, "011"), (8, "101"),
    (5, "100"), (12, "000"), (7, "200"), (12, "010"), (10, "010"), (9, "000"), (13, "100"), (16, "001"), (15, "011"), (15, "010"),
    (16, "010"), (14, "110"), (13, "110"), (5, "200"), (8, "100"), (14, "000"), (9, "101"), (14, "001"), (17, "001"), (12, "001"),
    (16, "000"), (17, "011"), (15, "001"), (16, "101"), (9, "100"), (15, "000"), (13, "000"), (8, "200"), (13, "010"), (17, "101"),
    (19, "010"), (14, "010"), (19, "011"), (17, "010"), (13, "001"), (17, "000"), (16, "100"), (9, "200"), (15, "101"), (15, "100"),
    (18, "011"), (18, "001"), (19, "001"), (17, "100"), (19, "000"), (18, "010"), (18, "101"), (19, "200"), (19, "100"), (18, "000"),
    (19, "101"), (18, "100"),
]
#: The length of a step of the coarsest lattice on a face's plane, which touches the sphere's unit ball.
UNIT = 0.38196601125010500003
RESOLUTION = 14

#: The way a step along each axis goes, and that of each digit (4 for the first axis, 2 for the second, 1 for the third).
AXES = np.exp(2j * np.pi / 3 * np.arange(3))
STEPS = np.array([sum(a for a, bit in zip(AXES, (4, 2, 1)) if d & bit) for d in range(7)])
#: Digits in the order in which a turn by a sixth, against the clock, leads from one to the next.
CIRCLE = [4, 6, 2, 3, 1, 5]
#: turned[n, d]: digit d after n such turns.
TURNED = np.array([[0, *([0] * 6)] for _ in range(6)])
for _n in range(6):
    for _k, _d in enumerate(CIRCLE):
        TURNED[_n, _d] = CIRCLE[(_k + _n) % 6]
#: What a coarser step is in finer ones: by turns to one side and to the other.
_ODD, _EVEN = 2 - AXES[1], 3 + AXES[1]


def _unit(lat, lng) -> np.ndarray:
    return np.stack((np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)), -1)


CENTRES = np.array([f[:2] for f in FACES])
AZIMUTHS = np.array([f[2] for f in FACES])
POLES = _unit(CENTRES[:, 0], CENTRES[:, 1])


def to_face(lat: np.ndarray, lng: np.ndarray, face: np.ndarray) -> np.ndarray:
    """Where points, in radians, lie on the plane of a face."""
    lat0, lng0 = CENTRES[face, 0], CENTRES[face, 1]
    azimuth = np.arctan2(np.cos(lat) * np.sin(lng - lng0), np.cos(lat0) * np.sin(lat) - np.sin(lat0) * np.cos(lat) * np.cos(lng - lng0))
    square = ((_unit(lat, lng) - POLES[face]) ** 2).sum(-1)
    r = np.tan(np.arccos(np.clip(1 - square / 2, -1, 1))) / UNIT
    return r * np.exp(1j * (AZIMUTHS[face] - azimuth))


def from_face(z: np.ndarray, face: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of to_face."""
    lat0, lng0 = CENTRES[face, 0], CENTRES[face, 1]
    r, azimuth = np.arctan(np.abs(z) * UNIT), AZIMUTHS[face] - np.angle(z)
    sin = np.clip(np.sin(lat0) * np.cos(r) + np.cos(lat0) * np.sin(r) * np.cos(azimuth), -1, 1)
    lng = lng0 + np.arctan2(np.sin(azimuth) * np.sin(r), np.cos(lat0) * np.cos(r) - np.sin(lat0) * np.sin(r) * np.cos(azimuth))
    return np.arcsin(sin), (lng + np.pi) % (2 * np.pi) - np.pi


class Unfolding(NamedTuple):
    """For each face and each of its edges: the face beyond, and z -> turn ** n * z + shift, which brings this plane over that."""

    beyond: np.ndarray
    turns: np.ndarray
    shift: np.ndarray


SIXTH = np.exp(1j * np.pi / 3)
#: A face's corners on its plane; edge k lies between corners k and k + 1, and this way out of the face.
CORNERS = 2 * AXES
OUTWARD = SIXTH * AXES


@cache
def unfolding() -> Unfolding:
    corners = np.stack([np.stack(from_face(np.full(20, c), np.arange(20)), -1) for c in CORNERS], 1)
    places = _unit(corners[..., 0], corners[..., 1])
    beyond, turns, shift = np.zeros((20, 3), int), np.zeros((20, 3), int), np.zeros((20, 3), complex)
    for f in range(20):
        for k in range(3):
            ends = places[f, [k, (k + 1) % 3]]
            for g in range(20):
                at = [np.flatnonzero(places[g] @ e > 1 - 1e-9) for e in ends]
                if g != f and all(len(x) for x in at):
                    a, b = (CORNERS[x[0]] for x in at)
                    turn = (a - b) / (CORNERS[k] - CORNERS[(k + 1) % 3])
                    beyond[f, k], turns[f, k] = g, round(np.angle(turn) / (np.pi / 3)) % 6
                    shift[f, k] = a - SIXTH ** turns[f, k] * CORNERS[k]
    return Unfolding(beyond, turns, shift)


def _place(steps: str) -> complex:
    return complex(sum(int(n) * a for n, a in zip(steps, AXES)))


class Places(NamedTuple):
    """What lies at each place of each face's coarsest lattice: by (face, column, row) the base cell, the turns to its own face, and whether that lies across a pentagon's gap."""

    cell: np.ndarray
    turns: np.ndarray
    across: np.ndarray


#: Columns and rows of the coarsest lattice run from -3 to 3.
HALF = 3


def _column_row(z):
    """z as column + row * the second axis's way, both whole for places of a lattice."""
    row = np.imag(z) / np.imag(AXES[1])
    return np.real(z) + row / 2, row


def _whole(z):
    c, r = _column_row(z)
    return np.rint(c).astype(np.int64), np.rint(r).astype(np.int64)


@cache
def pentagons() -> np.ndarray:
    return np.array([steps == "200" for _, steps in BASE_CELLS])


def _turn_about(f: int, corner: int, clockwise: bool) -> int:
    """The edge of a face at a corner, the one that comes next in this sense seen from the corner."""
    return corner if clockwise else (corner + 2) % 3


@cache
def places() -> Places:
    u = unfolding()
    cell, turns, across = (np.full((20, 7, 7), v) for v in (-1, 0, 0))
    own = {(f, *(int(x) for x in _whole(_place(s)))): k for k, (f, s) in enumerate(BASE_CELLS)}

    def put(f: int, z: complex, k: int, n: int, gap: int = 0) -> None:
        c, r = (int(x) for x in _whole(z))
        if max(abs(c), abs(r)) <= HALF and cell[f, c + HALF, r + HALF] < 0:
            cell[f, c + HALF, r + HALF], turns[f, c + HALF, r + HALF], across[f, c + HALF, r + HALF] = k, n % 6, gap

    # Pentagons: around their corner, clockwise from their own face three faces, and one against the clock.
    for k, (home, steps) in enumerate(BASE_CELLS):
        if steps != "200":
            continue
        put(home, CORNERS[0], k, 0)
        for clockwise, count in ((True, 3), (False, 1)):
            f, z, n = home, CORNERS[0], 0
            for _ in range(count):
                edge = _turn_about(f, int(np.argmin(abs(CORNERS - z))), clockwise)
                n -= u.turns[f, edge]
                f, z = u.beyond[f, edge], SIXTH ** u.turns[f, edge] * z + u.shift[f, edge]
                put(f, z, k, n, 0 if clockwise else 1)
    # All others: on their own face, and on those that lie one edge away.
    for (f, c, r), k in own.items():
        if BASE_CELLS[k][1] != "200":
            z = c + r * AXES[1]
            put(f, z, k, 0)
            for edge in range(3):
                put(u.beyond[f, edge], SIXTH ** u.turns[f, edge] * z + u.shift[f, edge], k, -u.turns[f, edge])
    return Places(cell, turns, across)


def _nearest(z: np.ndarray) -> np.ndarray:
    """Column and row of the nearest place of the lattice, by rounding all three of its coordinates."""
    c, r = _column_row(z)
    q, s = c - r, -c
    rq, rr, rs = np.rint(q), np.rint(r), np.rint(s)
    dq, dr, ds = np.abs(rq - q), np.abs(rr - r), np.abs(rs - s)
    rq = np.where((dq > dr) & (dq > ds), -rr - rs, rq)
    rr = np.where((dr >= dq) & (dr > ds), -rq - rs, rr)
    return np.stack((rq + rr, rr)).astype(np.int64)


def _leading(digits: np.ndarray) -> np.ndarray:
    """The first digit that isn't 0, or 0."""
    first = np.argmax(digits > 0, 0)
    return digits[first, np.arange(digits.shape[1])]


#: The digit of a child by its column and row from its parent's centre.
_DIGIT = np.zeros((3, 3), np.int64)
for _d in range(7):
    _c, _r = (int(x) for x in _whole(STEPS[_d]))
    _DIGIT[_c + 1, _r + 1] = _d


def cell_at(lat: np.ndarray, lng: np.ndarray, resolution: int = RESOLUTION) -> np.ndarray:
    """The cells, as longs, that hold points in degrees."""
    lat, lng = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lng, float))
    # The nearest face, the first of several.
    face = np.argmin(np.stack([((_unit(lat, lng) - p) ** 2).sum(-1) for p in POLES]), 0)
    z = to_face(lat, lng, face) * np.sqrt(7) ** resolution
    if resolution % 2:
        z = z * np.exp(-1j * np.angle(_EVEN))
    c, r = _nearest(z)
    digits = np.zeros((resolution, len(lat)), np.int64)
    for level in range(resolution, 0, -1):
        # The parent's column and row, and its centre in those of its children.
        if level % 2:
            pc, pr = np.rint((3 * c - r) / 7).astype(np.int64), np.rint((c + 2 * r) / 7).astype(np.int64)
            dc, dr = c - (2 * pc + pr), r - (3 * pr - pc)
        else:
            pc, pr = np.rint((2 * c + r) / 7).astype(np.int64), np.rint((3 * r - c) / 7).astype(np.int64)
            dc, dr = c - (3 * pc - pr), r - (pc + 2 * pr)
        digits[level - 1] = _DIGIT[dc + 1, dr + 1]
        c, r = pc, pr
    p = places()
    at = (face, c + HALF, r + HALF)
    base, turns, across = p.cell[at], p.turns[at], p.across[at]
    digits = TURNED[turns, digits]
    # A pentagon has five sixths: what comes to lie in the gap, or across it, turns on by one.
    if resolution:
        first = _leading(digits)
        on = pentagons()[base] & ((first == 1) | (across == 1) & (first == 5))
        digits = np.where(on, TURNED[1][digits], digits)
    out = np.int64(1) << 59 | np.int64(resolution) << 52 | base.astype(np.int64) << 45
    for level in range(1, 16):
        out = out | ((digits[level - 1] if level <= resolution else np.int64(7)) << np.int64(3 * (15 - level)))
    return out


def centre_of(cell: np.ndarray, resolution: int = RESOLUTION) -> tuple[np.ndarray, np.ndarray]:
    """Degrees of latitude and longitude of the centres of cells of one resolution."""
    cell = np.asarray(cell, np.int64)
    base = cell >> 45 & 127
    digits = np.stack([cell >> np.int64(3 * (15 - level)) & 7 for level in range(1, resolution + 1)]) if resolution else np.zeros((0, len(cell)), np.int64)
    five = pentagons()[base]
    first = _leading(digits) if resolution else np.zeros(len(cell), np.int64)
    # Of a pentagon the last sixth but one is missing: what follows it is brought there, next to the own face.
    digits = np.where(five & (first == 5), TURNED[5][digits], digits)
    first = np.where(five & (first == 5), 1, first)
    face = np.array([f for f, _ in BASE_CELLS])[base]
    middle = np.array([_place(s) for _, s in BASE_CELLS])[base]
    c, r = _whole(middle)
    for level in range(1, resolution + 1):
        c, r = (2 * c + r, 3 * r - c) if level % 2 else (3 * c - r, c + 2 * r)
        dc, dr = _whole(STEPS[digits[level - 1]])
        c, r = c + dc, r + dr
    z = (c + r * AXES[1]) / np.sqrt(7) ** resolution
    if resolution % 2:
        z = z * np.exp(1j * np.angle(_EVEN))
    u = unfolding()

    def over(rows: np.ndarray, edge: np.ndarray) -> None:
        f = face[rows]
        face[rows], z[rows] = u.beyond[f, edge], SIXTH ** u.turns[f, edge] * z[rows] + u.shift[f, edge]
        middle[rows] = SIXTH ** u.turns[f, edge] * middle[rows] + u.shift[f, edge]

    # Around a pentagon, by the angle at its corner, which goes on past a whole turn's end; the own face is from 150 to 210 degrees.
    from_corner = z - middle
    towards = np.angle(STEPS[first], deg=True) % 360
    angle = towards + (np.angle(from_corner, deg=True) - towards + 180) % 360 - 180
    sixth = np.where(five & (np.abs(from_corner) > 1e-9), np.floor((angle - 150) / 60 + 1e-12), 0).astype(np.int64)
    for k in range(1, 5):
        for clockwise, rows in ((True, np.flatnonzero(sixth <= -k)), (False, np.flatnonzero(sixth >= k))):
            if len(rows):
                corner = np.argmin(np.abs(CORNERS[None, :] - middle[rows, None]), 1)
                over(rows, corner if clockwise else (corner + 2) % 3)
    # Others lie on their own face or over one edge.
    beyond = np.real(z[:, None] * np.conj(OUTWARD)[None, :]) - 1
    rows = np.flatnonzero(~five & (beyond.max(1) > 1e-9))
    if len(rows):
        over(rows, beyond[rows].argmax(1))
    lat, lng = from_face(z, face)
    return np.degrees(lat), np.degrees(lng)
