"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized by integral images, written as NPY tiles with difference hashes.

``media_columns`` is the operator. It works row by row inside Arrow batches, so no shuffle is needed and a lost executor only repeats its own batches.

Defined results: null or undecodable media give null for every derived column and the reason in ``error``; an image of no pixels has no tiles and hash 0; rows that repeat give repeated results; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroflux.llm.common import prepare

#: Side of a tile in samples.
TILE_ROWS, TILE_COLS = 1024, 1024
#: Width of the image that carries a text's bytes.
PAYLOAD_WIDTH = 64

MEDIA_SCHEMA = "id long, height int, width int, channels int, dhash string, thumbnail binary, tiles array<struct<row:int,col:int,npy:binary>>, error string"


def encode_pgm(payload: bytes, width: int = PAYLOAD_WIDTH) -> bytes:
    """A binary grey map (P5) whose samples are the payload's bytes; the payload is a multiple of width."""
    return b"P5\n%d %d\n255\n" % (width, len(payload) // width) + payload


def _netpbm_header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The header's numbers and where the samples begin; '#' starts a comment up to the line's end."""
    numbers: list[int] = []
    at = 2
    while len(numbers) < fields:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        start = at
        while at < len(data) and data[at : at + 1].isdigit():
            at += 1
        if start == at:
            raise ValueError("broken netpbm header")
        numbers.append(int(data[start:at]))
    return numbers, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width, channels); 8-bit samples, or 16-bit where maxval is over 255."""
    kind = data[1:2]
    bitmap, colour, plain = kind in b"14", kind in b"36", kind in b"123"
    (width, height, *maxval), at = _netpbm_header(data, 2 if bitmap else 3)
    channels = 3 if colour else 1
    count = width * height * channels
    if maxval and not 0 < maxval[0] < 65536:
        raise ValueError("netpbm maxval out of range")
    if plain:
        body = b"\n".join(line.split(b"#")[0] for line in data[at - 1 :].split(b"\n"))
        if bitmap:
            digits = np.frombuffer(b"".join(body.split()), np.uint8)[:count] - np.uint8(48)
            if (digits > 1).any():
                raise ValueError("netpbm samples out of range")
            flat = (1 - digits) * 255
        else:
            flat = np.array(body.split()[:count], dtype=np.int64)
            if flat.size and (flat.min() < 0 or flat.max() > maxval[0]):
                raise ValueError("netpbm samples out of range")
            flat = flat.astype(np.uint8 if maxval[0] < 256 else np.uint16)
    elif bitmap:
        row_bytes = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row_bytes * height, at).reshape(height, row_bytes), axis=1)
        flat = ((1 - bits[:, :width]) * 255).astype(np.uint8).ravel()
    else:
        kind_of = np.uint8 if maxval[0] < 256 else np.dtype(">u2")
        flat = np.frombuffer(data, kind_of, count, at)
        flat = flat if maxval[0] < 256 else flat.astype(np.uint16)
        if flat.size and maxval[0] not in (255, 65535) and flat.max() > maxval[0]:
            raise ValueError("netpbm samples out of range")
    if flat.size < count:
        raise ValueError("netpbm samples are missing")
    return flat.reshape(height, width, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as (height, width, 3) in RGB order."""
    offset = int.from_bytes(data[10:14], "little")
    header = int.from_bytes(data[14:18], "little")
    width, signed_height = (int.from_bytes(data[i : i + 4], "little", signed=True) for i in (18, 22))
    bits, compression = int.from_bytes(data[28:30], "little"), int.from_bytes(data[30:34], "little")
    if bits not in (1, 4, 8, 24, 32) or compression not in (0, 3) or width < 0:
        raise ValueError("BMP form that is not supported")
    height, stride = abs(signed_height), (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * height, offset).reshape(height, stride)
    if bits >= 24:
        image = rows[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1]
    else:
        colours = int.from_bytes(data[46:50], "little") or 1 << bits
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
        if bits == 8:
            index = rows
        elif bits == 4:
            index = np.stack([rows >> 4, rows & 15], axis=2).reshape(height, -1)
        else:
            index = np.unpackbits(rows, axis=1)
        image = palette[index[:, :width]]
    return image[::-1] if signed_height > 0 else image


def decode(data: bytes) -> np.ndarray:
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return decode_netpbm(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each output cell's area, fractions of pixels included.

    The integral image is bilinear inside a pixel, so reading it between samples is exact. Only its rows next to a cell's edge are held, added up strip by strip, so that memory doesn't follow the image's height.
    """
    h, w = image.shape[:2]
    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    y0, x0 = np.minimum(ys.astype(int), h - 1), np.minimum(xs.astype(int), w - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    edges = np.unique(np.r_[0, y0, y0 + 1])
    strips = [np.add.reduce(image[a:b], axis=0, dtype=np.float64) for a, b in zip(edges[:-1], edges[1:])]
    integral = np.zeros((len(edges), w + 1))
    np.cumsum(np.cumsum(strips, axis=0), axis=1, out=integral[1:, 1:])
    low, high = np.searchsorted(edges, y0), np.searchsorted(edges, y0 + 1)
    rows = integral[low] * (1 - fy) + integral[high] * fy
    at = rows[:, x0] * (1 - fx) + rows[:, x0 + 1] * fx
    return (at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]) / ((h / height) * (w / width))


def grey(image: np.ndarray) -> np.ndarray:
    return image[:, :, 0] if image.shape[2] == 1 else image.astype(np.float64).mean(axis=2)


def dhash(image: np.ndarray) -> str:
    """64 bits: is a cell brighter than its left neighbour in an 8 x 9 area-resized grey image."""
    if image.size == 0:
        return "0" * 16
    small = np.round(area_resize(grey(image), 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def to_tiles(image: np.ndarray, rows: int = TILE_ROWS, cols: int = TILE_COLS) -> list[dict]:
    return [{"row": r, "col": c, "npy": npy(image[r : r + rows, c : c + cols])} for r in range(0, image.shape[0], rows) for c in range(0, image.shape[1], cols)]


def from_tiles(tiles: list[dict], height: int, width: int, channels: int) -> np.ndarray:
    """The image again, from the stored NPY bytes alone."""
    image = None
    for tile in tiles:
        part = np.lib.format.read_array(io.BytesIO(tile["npy"]), allow_pickle=False)
        if image is None:
            image = np.empty((height, width, channels), part.dtype)
        image[tile["row"] : tile["row"] + part.shape[0], tile["col"] : tile["col"] + part.shape[1]] = part
    return np.empty((height, width, channels), np.uint8) if image is None else image


def describe(data: bytes | None, side: int = 32) -> dict:
    """What the operator stores for one image."""
    empty = dict.fromkeys(("height", "width", "channels", "dhash", "thumbnail", "tiles"))
    if data is None:
        return empty | {"error": "null media"}
    try:
        image = decode(data)
    except (ValueError, IndexError, TypeError, OverflowError, MemoryError) as error:
        return empty | {"error": str(error) or type(error).__name__}
    height, width, channels = image.shape
    scale = 257 if image.dtype == np.uint16 else 1  # thumbnails have eight bits
    thumb = npy(np.round(area_resize(grey(image), side, side) / scale).astype(np.uint8)) if image.size else None
    return {"height": height, "width": width, "channels": channels, "dhash": dhash(image), "thumbnail": thumb, "tiles": to_tiles(image), "error": None}


def media_columns(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Decode every image of ``media_col``; see the module's text for nulls and broken images."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("dhash", pa.string()), ("thumbnail", pa.binary()), ("tiles", pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("npy", pa.binary())]))), ("error", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # large images: few at once
                ids, media = (column.slice(at, 64).to_pylist() for column in batch.columns)
                yield pa.RecordBatch.from_pylist([{"id": i} | describe(m) for i, m in zip(ids, media)], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, MEDIA_SCHEMA)


def padded(text: bytes) -> bytes:
    """Bytes 0 behind the text up to a multiple of 64 that isn't 0; a text of such a length stays as it is."""
    return text + bytes(-len(text) % PAYLOAD_WIDTH if text else PAYLOAD_WIDTH)


def text_media_digest(docs: DataFrame) -> DataFrame:
    """Each text's padded UTF-8 bytes as the samples of a grey map, stored as NPY tiles, read back and described.

    A null text is empty. The stored form is the tiles' NPY bytes one after another.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def digest(text: bytes | None) -> tuple:
        text = text or b""
        stored = describe(encode_pgm(padded(text)), side=8)
        back = from_tiles(stored["tiles"], stored["height"], stored["width"], stored["channels"])
        payload = back.tobytes()
        media = hashlib.sha256()
        for tile in stored["tiles"]:
            media.update(tile["npy"])
        return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAYLOAD_WIDTH:]), sum(len(t["npy"]) for t in stored["tiles"]), media.hexdigest(), dhash(back)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*[digest(x.as_py()) for x in batch.column(1)])) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
