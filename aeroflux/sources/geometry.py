"""Geometry as text (WKT) and as bytes (WKB), read into and written from arrays of rings.

Rings are array<array<struct<x,y>>>; a polygon's are not closed, its shells run counterclockwise and its holes clockwise, whatever the source's order. The parts of a multi-part geometry lie one behind the other. Text is read and written by column functions; bytes by numpy over whole Arrow batches, whose steps follow the most parts and rings of one geometry, not the number of geometries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aeroflux.operators import rings as geo

RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
# WKB's numbers of geometries; the multi-part ones hold whole geometries of the simple ones.
KINDS = {1: "point", 2: "line", 3: "polygon", 4: "point", 5: "line", 6: "polygon"}
CODES = {"point": 4, "line": 5, "polygon": 6}
#: Bits of the extended form: heights, measures, a reference system's number.
HAS_Z, HAS_M, HAS_SRID = 0x80000000, 0x40000000, 0x20000000


# --- text ------------------------------------------------------------------------------------------------------------


def kind_of_wkt(text: Column) -> Column:
    """point, line or polygon; other kinds fail, null and empty texts are null."""
    word = F.upper(F.regexp_extract(text, r"^\s*(?:SRID=\d+;)?\s*(?:[Mm][Uu][Ll][Tt][Ii])?([A-Za-z]+)", 1))
    wrong = F.raise_error(F.concat(F.lit("no rings in "), word)).cast("string")
    return F.when(text.isNull() | (word == ""), F.lit(None).cast("string")).when(word == "POLYGON", "polygon").when(word == "LINESTRING", "line").when(word == "POINT", "point").otherwise(wrong)


def signed_area(ring: Column) -> Column:
    """Positive if the ring runs counterclockwise."""
    step = lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % F.size(ring))["y"] - F.get(ring, (i + 1) % F.size(ring))["x"] * F.get(ring, i)["y"]
    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), F.lit(0.0), lambda total, i: total + step(i)) / 2


def rings_of_wkt(text: Column) -> Column:
    """Rings of a POINT, LINESTRING, POLYGON or a MULTI of them; heights are ignored; EMPTY has none."""
    polygon = kind_of_wkt(text) == "polygon"

    def point(p: Column) -> Column:
        at = F.split(F.trim(F.regexp_replace(p, r"[()]", " ")), r"\s+")
        return F.struct(F.get(at, F.lit(0)).cast("double").alias("x"), F.get(at, F.lit(1)).cast("double").alias("y"))

    def ring(match: Column) -> Column:
        points = F.transform(F.split(match, ","), point)
        closed = (F.size(points) > 1) & (F.element_at(points, 1) == F.element_at(points, -1))
        open_ring = F.when(closed, F.slice(points, F.lit(1), F.size(points) - 1)).otherwise(points)
        shell = F.startswith(match, F.lit("(("))
        return F.when(polygon, F.when((signed_area(open_ring) >= 0) == shell, open_ring).otherwise(F.reverse(open_ring))).otherwise(points)

    # a ring with the parentheses before it: two or more open a polygon; points of a MULTIPOINT may have their own
    matches = F.regexp_extract_all(F.regexp_replace(text, r"\(\s+(?=\()", "("), F.lit(r"\(*\(\s*[^()]+\)"), F.lit(0))
    rings = F.transform(matches, ring)
    return F.when(kind_of_wkt(text) == "point", F.transform(F.flatten(rings), lambda p: F.array(p))).otherwise(rings)


def wkt(kind: Column, rings: Column) -> Column:
    """Text of rings: polygons are written as one POLYGON if only the first ring is a shell, else as a MULTIPOLYGON whose holes follow the shell before them."""
    number = lambda v: F.format_string("%s", v)
    point = lambda p: F.concat_ws(" ", number(p["x"]), number(p["y"]))
    line = lambda r: F.concat(F.lit("("), F.concat_ws(", ", F.transform(r, point)), F.lit(")"))
    closed = lambda r: line(F.concat(r, F.slice(r, 1, 1)))
    shells = F.size(F.filter(rings, lambda r: signed_area(r) >= 0))
    start = F.when(shells > 1, "MULTIPOLYGON (").otherwise("POLYGON ")
    each = F.transform(rings, lambda r, i: F.concat(F.when(i == 0, "(").when(signed_area(r) >= 0, "), (").otherwise(", "), closed(r)))
    polygon = F.concat(start, F.array_join(each, ""), F.when(shells > 1, "))").otherwise(")"))
    lines = F.when(F.size(rings) == 1, F.concat(F.lit("LINESTRING "), line(F.get(rings, F.lit(0))))).otherwise(F.concat(F.lit("MULTILINESTRING ("), F.concat_ws(", ", F.transform(rings, line)), F.lit(")")))
    points = F.flatten(rings)
    point_text = F.when(F.size(points) == 1, F.concat(F.lit("POINT "), line(points))).otherwise(F.concat(F.lit("MULTIPOINT ("), F.concat_ws(", ", F.transform(points, lambda p: line(F.array(p)))), F.lit(")")))
    empty = F.when(kind == "polygon", "POLYGON EMPTY").when(kind == "line", "LINESTRING EMPTY").otherwise("POINT EMPTY")
    return F.when(F.size(points) == 0, empty).when(kind == "polygon", polygon).when(kind == "line", lines).otherwise(point_text)


# --- bytes -----------------------------------------------------------------------------------------------------------


class _Bytes:
    """All geometries of a batch in one buffer, read at many places at once."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        self.start, self.end = offsets[:-1].copy(), offsets[1:]

    def _at(self, at: np.ndarray, size: int, big: np.ndarray) -> np.ndarray:
        if len(at) and int(at.max()) + size > len(self.data):
            raise ValueError("a geometry ends too early")
        found = self.data[at[:, None] + np.arange(size)]
        found[big] = found[big][:, ::-1]
        return np.ascontiguousarray(found)

    def unsigned(self, at: np.ndarray, big: np.ndarray) -> np.ndarray:
        return self._at(at, 4, big).view("<u4").ravel().astype(np.int64)

    def doubles(self, at: np.ndarray, big: np.ndarray) -> np.ndarray:
        return self._at(at, 8, big).view("<f8").ravel()

    def header(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(big-endian, kind's number, bytes of a point, where the body starts)."""
        big = self.data[at] == 0
        code = self.unsigned(at + 1, big)
        plain = code & 0x1FFFFFFF
        z, m = (code & HAS_Z > 0) | np.isin(plain // 1000, (1, 3)), (code & HAS_M > 0) | np.isin(plain // 1000, (2, 3))
        return big, plain % 1000, 16 + 8 * z + 8 * m, at + 5 + 4 * (code & HAS_SRID > 0)


def decoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind's number of each geometry, 0 if null; owner, size and shell of each ring; coordinates (n, 2) of all rings in order)."""
    source = _Bytes(column)
    rows = np.flatnonzero(np.asarray(column.is_valid()) & (source.end > source.start))
    kind = np.zeros(len(column), np.int64)
    big, code, stride, at = source.header(source.start[rows])
    if not np.isin(code, list(KINDS)).all():
        raise ValueError(f"no rings in geometry {int(code[~np.isin(code, list(KINDS))][0])}")
    kind[rows] = code
    multi = code >= 4
    count = np.ones(len(rows), np.int64)
    count[multi] = source.unsigned(at[multi], big[multi])
    at = at + 4 * multi
    found: list[tuple[np.ndarray, ...]] = []
    for part in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > part)
        if (inner := live[multi[live]]).size:
            big[inner], code[inner], stride[inner], at[inner] = source.header(at[inner])
        number = np.ones(len(live), np.int64)
        polygons = code[live] == 3
        number[polygons] = source.unsigned(at[live][polygons], big[live][polygons])
        at[live] += 4 * polygons
        for ring in range(int(number.max(initial=0))):
            here = live[number > ring]
            points = np.ones(len(here), np.int64)
            many = code[here] != 1
            points[many] = source.unsigned(at[here][many], big[here][many])
            at[here] += 4 * many
            found.append((rows[here], np.full(len(here), part), np.full(len(here), ring), points, at[here].copy(), stride[here].copy(), big[here].copy()))
            at[here] += points * stride[here]
    if not found:
        none = np.zeros(0, np.int64)
        return kind, none, none, none.astype(bool), np.zeros((0, 2))
    owner, part, ring, points, start, stride, big = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ring, part, owner))
    owner, ring, points, start, stride, big = (x[order] for x in (owner, ring, points, start, stride, big))
    inside = np.arange(points.sum()) - np.repeat(np.cumsum(points) - points, points)
    place, wide = np.repeat(start, points) + inside * np.repeat(stride, points), np.repeat(big, points)
    xy = np.column_stack([source.doubles(place, wide), source.doubles(place + 8, wide)])
    return kind, owner, points, ring == 0, xy


def arranged(kind: np.ndarray, owner: np.ndarray, size: np.ndarray, shell: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rings as the library holds them (owner, size, coordinates): polygons open and wound, points without a place left out."""
    polygon = np.isin(kind[owner], (3, 6))
    first = np.cumsum(size) - size
    some = size > 0
    last = np.maximum(first + size - 1, 0)
    closed = np.zeros(len(size), bool)
    pick = np.flatnonzero(some & polygon & (size > 1))
    closed[pick] = (xy[first[pick]] == xy[last[pick]]).all(axis=1)
    ring = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(ring)) - first[ring]
    keep = ~(closed[ring] & (inside == size[ring] - 1)) & ~np.isnan(xy).any(axis=1)
    ring, xy = ring[keep], xy[keep]
    size = np.bincount(ring, minlength=len(size))
    first = np.cumsum(size) - size
    following = np.arange(len(ring)) + 1
    ends = np.flatnonzero(size > 0)
    following[(first + size - 1)[ends]] = first[ends]
    doubled = np.zeros(len(size))
    if len(ring):
        cross = xy[:, 0] * xy[following, 1] - xy[following, 0] * xy[:, 1]
        doubled[ends] = np.add.reduceat(cross, first[ends])
    wrong = polygon & ((doubled >= 0) != shell)
    inside = np.arange(len(ring)) - first[ring]
    place = np.where(wrong[ring], first[ring] + size[ring] - 1 - inside, np.arange(len(ring)))
    return owner[ends], size[ends], xy[place]


def rings_array(rows: int, owner: np.ndarray, size: np.ndarray, xy: np.ndarray, valid: np.ndarray) -> pa.Array:
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
    rings = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), points)
    offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=rows))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rings, mask=pa.array(~valid))


def read_wkb(df: DataFrame, column: str = "geometry") -> DataFrame:
    """df with kind and rings of a column of WKB (either byte order, also the extended form) in place of it; null stays null, a broken geometry and one that has no rings fail."""
    others = [c for c in df.columns if c not in (column, "kind", "rings")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, *found = decoded(batch.column(column))
            owner, size, xy = arranged(kind, *found)
            name = pa.array([KINDS.get(k) for k in kind.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), name, rings_array(len(kind), owner, size, xy, kind > 0)], names=[*others, "kind", "rings"])

    schema = df.select(*others).schema.add("kind", "string")
    return df.select(*others, column).mapInArrow(run, schema.add("rings", RINGS))


def encoded(kinds: list[str | None], rings: geo.Rings) -> list[bytes | None]:
    """Little-endian WKB of rows' rings, as multi-part geometries; a polygon's holes follow the shell before them."""
    first = np.r_[0, np.cumsum(rings.n)]
    area = geo.areas(rings) if len(rings.x) else np.zeros(len(rings.n))
    out: list[bytes | None] = []
    of = np.searchsorted(rings.owner, np.arange(len(kinds) + 1))
    body = np.ascontiguousarray(np.column_stack([rings.x, rings.y]).astype("<f8"))
    whole = lambda *n: np.array(n, "<u4").tobytes()
    for row, kind in enumerate(kinds):
        if kind is None:
            out.append(None)
            continue
        parts: list[bytes] = []
        holes: list[list[bytes]] = []
        for ring in range(of[row], of[row + 1]):
            xy = body[first[ring] : first[ring + 1]]
            if kind == "point":
                parts += [b"\x01" + whole(1) + p.tobytes() for p in xy]
            elif kind == "line":
                parts.append(b"\x01" + whole(2, len(xy)) + xy.tobytes())
            else:
                text = whole(len(xy) + 1) + xy.tobytes() + xy[:1].tobytes()
                if area[ring] >= 0 or not holes:
                    holes.append([])
                holes[-1].append(text)
        if kind == "polygon":
            parts = [b"\x01" + whole(3, len(p)) + b"".join(p) for p in holes]
        out.append(b"\x01" + whole(CODES[kind], len(parts)) + b"".join(parts))
    return out


def write_wkb(df: DataFrame, name: str = "geometry") -> DataFrame:
    """df with its kind and rings as WKB."""
    others = [c for c in df.columns if c not in ("kind", "rings", name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [k if ok else None for k, ok in zip(batch.column("kind").to_pylist(), batch.column("rings").is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(encoded(kinds, geo.read(batch.column("rings"))), pa.binary())], names=[*others, name])

    return df.select(*others, "kind", "rings").mapInArrow(run, df.select(*others).schema.add(name, "binary"))
