"""Bytes of picture files to blue-green-red arrays, and why some can't be."""

from __future__ import annotations

import importlib.util
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions.columns import unused
from cardloom.functions.kernels import to_bgr

EXTENSIONS = (".bmp", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp")
EMPTY = "Received empty image data."
UNDECODABLE = "Could not decode the image. Supported formats: " + ", ".join(EXTENSIONS)
#: Spark's picture, and the reason where there is none.
IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
_BGR_MODE = 16
_PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class PictureError(ValueError):
    """A picture that can't be decoded; its message is for the record."""


def _png(data: bytes) -> np.ndarray | None:
    """Pictures of 8 or 16 bits a channel, or of a palette, without interlacing."""
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2] not in (8, 16) or head[3] not in _PNG_CHANNELS or head[6]:
        return None
    w, h, bits, colour = head[:4]
    n = _PNG_CHANNELS[colour]
    step = n * bits // 8
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)[: h * (w * step + 1)].reshape(h, w * step + 1)
    out = np.zeros((h, w * step), np.uint8)
    before = np.zeros(w * step, np.uint8)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 1:
            before = np.cumsum(line.reshape(w, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            before = line + before
        elif kind in (3, 4):
            before = _along(line, before, step, kind)
        else:
            before = line.copy()
        out[y] = before
    x = out.reshape(h, w, n, bits // 8)[..., 0]
    if colour == 3:
        if palette is None or int(x.max(initial=0)) >= len(palette):
            return None
        return palette[x[..., 0]][..., ::-1]
    return x[..., 0] if n < 3 else x[..., 2::-1]


def _along(line: np.ndarray, above: np.ndarray, step: int, kind: int) -> np.ndarray:
    """Lines whose bytes depend on those to the left: mean (3) and nearest of three (4)."""
    out = [0] * len(line)
    up = above.tolist()
    for i, v in enumerate(line.tolist()):
        a = out[i - step] if i >= step else 0
        if kind == 3:
            out[i] = (v + (a + up[i]) // 2) & 255
            continue
        b, c = up[i], up[i - step] if i >= step else 0
        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        out[i] = (v + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
    return np.array(out, np.uint8)


def _bmp(data: bytes) -> np.ndarray | None:
    """Pictures of 24 or 32 bits without compression."""
    start, w, h, bits, packing = (*struct.unpack("<I4xii", data[10:26]), *struct.unpack("<HI", data[28:34]))
    if bits not in (24, 32) or packing not in (0, 3) or w <= 0 or not h:
        return None
    line = (w * bits // 8 + 3) // 4 * 4
    x = np.frombuffer(data, np.uint8, abs(h) * line, start).reshape(abs(h), line)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[..., :3]
    return x[::-1] if h > 0 else x


def decode(data: bytes | None) -> np.ndarray:
    """A picture's blue-green-red bytes, or a PictureError. PNG and BMP by themselves, other formats where OpenCV is installed."""
    if not data:
        raise PictureError(EMPTY)
    found = None
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            found = _png(data)
        elif data[:2] == b"BM":
            found = _bmp(data)
    except (struct.error, ValueError, zlib.error, IndexError):
        found = None
    if found is None and importlib.util.find_spec("cv2"):
        import cv2

        found = cv2.imdecode(np.frombuffer(data, np.uint8), cv2.IMREAD_COLOR)
    if found is None or not found.size:
        raise PictureError(UNDECODABLE)
    return to_bgr(found)


def as_row(origin: str, data: bytes | None) -> tuple[tuple | None, str | None]:
    """(Spark's picture or None, error or None)."""
    try:
        x = decode(data)
    except PictureError as e:
        return None, str(e)
    return (origin, *x.shape[:2], 3, _BGR_MODE, x.tobytes()), None


def with_images(df: DataFrame, content: str, origin: str | None = None, image: str = "image", error: str = "error") -> DataFrame:
    """``df`` with ``image`` and ``error`` of a column of bytes, in one Arrow stage; null or empty bytes and what can't be decoded have an error, and no image."""

    @F.pandas_udf(f"image {IMAGE}, error string")
    def run(data: pd.Series, name: pd.Series) -> pd.DataFrame:
        rows = [as_row(n or "", d) for d, n in zip(data, name, strict=True)]
        return pd.DataFrame({"image": [None if i is None else dict(zip(("origin", "height", "width", "nChannels", "mode", "data"), i, strict=True)) for i, _ in rows], "error": [e for _, e in rows]})

    both = unused(df, "decoded")
    df = df.withColumn(both, run(F.col(content), F.col(origin).cast("string") if origin else F.lit("")))
    return df.withColumns({image: F.col(f"{both}.image"), error: F.col(f"{both}.error")}).drop(both)


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring files of at most so many bytes together, or one: (from, to)."""
    start, held = 0, 0
    for k, n in enumerate(sizes):
        if k > start and held + n > most:
            yield start, k
            start, held = k, 0
        held += n
    if sizes:
        yield start, len(sizes)
