"""Media columns: Netpbm and BMP decoding, area resizing by integral images, NPY tiles and difference hashes.

Images are bytes columns; a decoded image is a numpy array (height, width) or
(height, width, 3) of unsigned samples. Defined cases: null, empty, truncated
or foreign bytes decode to a null image with the reason in ``error`` and no
other row is touched; images of any size are decoded whole; comments in Netpbm
headers, 8- and 16-bit samples, bitmaps (P1, P4), plain formats (P1, P2, P3)
and 1-, 4-, 8- (palette), 16-, 24- and 32-bit uncompressed BMP, bottom-up or
top-down, with bit fields of any masks, are understood; samples are kept as they
are stored, with the image's maximum beside them, and tiles are scaled from that
to 8 bits; an empty table gives an empty result; repeated rows and equal bytes
give equal values; other columns pass through, but for those named as the made ones.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Samples in a row of a stored payload, and the unit that payloads are padded to.
UNIT, PAD = 576, 255
TILE = 8


class MediaError(ValueError):
    """Bytes that are not an image of a known form."""


# --- Netpbm -----------------------------------------------------------------


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """Numbers after the magic, and where the raster begins; comments run from # to the line's end."""
    found, at, end = [], 2, len(data)
    while len(found) < fields:
        while at < end and (data[at] in b" \t\r\n\v\f" or data[at] == 35):
            if data[at] == 35:
                while at < end and data[at] not in b"\r\n":
                    at += 1
            else:
                at += 1
        start = at
        while at < end and 48 <= data[at] <= 57:
            at += 1
        if at == start:
            raise MediaError("netpbm header ends early")
        found.append(int(data[start:at]))
    return found, at


def decode_netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """Samples of a P1 to P6 image and their maximum; bitmaps give 0 for black and 1 for white."""
    kind = data[1:2]
    if data[:1] != b"P" or kind not in b"123456" or not kind:
        raise MediaError("not netpbm")
    bitmap, channels = kind in b"14", 3 if kind in b"36" else 1
    numbers, at = _header(data, 2 if bitmap else 3)
    width, height, most = numbers[0], numbers[1], 1 if bitmap else numbers[2]
    if not (width and height and 0 < most < 65536):
        raise MediaError("netpbm size or maximum out of range")
    n = width * height * channels
    if kind == b"1":
        digits = bytes(c for c in data[at:] if c in b"01")
        if len(digits) < n:
            raise MediaError("netpbm raster ends early")
        out = 49 - np.frombuffer(digits[:n], np.uint8)
    elif kind in b"23":
        values = np.array(data[at:].split()[:n], np.int64)
        if values.size < n or values.max(initial=0) > most:
            raise MediaError("netpbm raster ends early or passes its maximum")
        out = values.astype(np.uint8 if most < 256 else np.uint16)
    elif kind == b"4":
        stride = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=at + 1)
        if raw.size < stride * height:
            raise MediaError("netpbm raster ends early")
        out = 1 - np.unpackbits(raw[: stride * height].reshape(height, stride), axis=1)[:, :width]
    else:
        kind_of = np.dtype(np.uint8) if most < 256 else np.dtype(">u2")
        raw = np.frombuffer(data, np.uint8, offset=at + 1) if len(data) > at + 1 else np.empty(0, np.uint8)
        if raw.size < n * kind_of.itemsize:
            raise MediaError("netpbm raster ends early")
        out = raw[: n * kind_of.itemsize].view(kind_of).astype(np.uint8 if most < 256 else np.uint16)
    if out.max(initial=0) > most:
        raise MediaError("netpbm sample passes its maximum")
    return out.reshape((height, width, 3) if channels == 3 else (height, width)), most


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 or P6 with 8-bit samples."""
    height, width = image.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if image.ndim == 3 else 5, width, height) + np.ascontiguousarray(image, np.uint8).tobytes()


# --- BMP --------------------------------------------------------------------


def _bit_fields(raw: np.ndarray, width: int, bits: int, masks: tuple[int, ...]) -> np.ndarray:
    """RGB samples, scaled to 8 bits, of pixels whose colours stand under three masks."""
    pixels = np.ascontiguousarray(raw[:, : width * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.int64)
    out = np.empty((raw.shape[0], width, 3), np.uint8)
    for k, mask in enumerate(masks):
        low = mask & -mask
        if not mask or (mask // low) & (mask // low + 1) or mask >> bits:
            raise MediaError("bmp mask is not one run of bits of a pixel")
        most = mask // low
        out[:, :, k] = ((pixels & mask) // low * 255 + most // 2) // most
    return out


def decode_bmp(data: bytes) -> np.ndarray:
    """RGB samples of 16-, 24- and 32-bit images, those of the palette for 1, 4 and 8 bits (grey palettes give two dimensions)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise MediaError("not bmp")
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if head < 40:
        raise MediaError("bmp header of an old form")
    width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    used = struct.unpack_from("<I", data, 46)[0]
    if width <= 0 or height == 0 or bits not in (1, 4, 8, 16, 24, 32) or packed not in (0, 3) or (packed == 3 and bits not in (16, 32)):
        raise MediaError("bmp of an unsupported form")
    stride = (width * bits + 31) // 32 * 4
    if len(data) < start + stride * abs(height):
        raise MediaError("bmp raster ends early")
    raw = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    raw = raw[::-1] if height > 0 else raw
    if packed == 3 or bits == 16:
        if packed == 3 and len(data) < 66:
            raise MediaError("bmp masks end early")
        return _bit_fields(raw, width, bits, struct.unpack_from("<3I", data, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F))
    if bits >= 24:
        return np.ascontiguousarray(raw[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1])
    colours = used or 1 << bits
    at = 14 + head
    if len(data) < at + 4 * colours:
        raise MediaError("bmp palette ends early")
    palette = np.frombuffer(data, np.uint8, 4 * colours, at).reshape(-1, 4)[:, 2::-1]
    if bits == 8:
        index = raw[:, :width]
    elif bits == 4:
        index = np.stack((raw >> 4, raw & 15), axis=2).reshape(abs(height), -1)[:, :width]
    else:
        index = np.unpackbits(raw, axis=1)[:, :width]
    if index.max(initial=0) >= colours:
        raise MediaError("bmp index outside its palette")
    out = palette[index]
    return np.ascontiguousarray(out[:, :, 0]) if (palette == palette[:, :1]).all() else np.ascontiguousarray(out)


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit bottom-up BMP of an RGB image, 8-bit grey palette BMP of a grey one."""
    height, width = image.shape[:2]
    image = np.asarray(image, np.uint8)
    grey = image.ndim == 2
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1).copy() if grey else np.empty((0, 4), np.uint8)
    palette[:, 3:] = 0
    line = image if grey else image[:, :, ::-1].reshape(height, -1)
    stride = (line.shape[1] + 3) // 4 * 4
    raster = np.zeros((height, stride), np.uint8)
    raster[:, : line.shape[1]] = line[::-1]
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + raster.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, raster.size, 2835, 2835, 256 if grey else 0, 0)
    return head + info + palette.tobytes() + raster.tobytes()


def decode(data: bytes | None) -> np.ndarray:
    """Image of Netpbm or BMP bytes."""
    return decode_scaled(data)[0]


def decode_scaled(data: bytes | None) -> tuple[np.ndarray, int]:
    """(image, maximum of its samples) of Netpbm or BMP bytes."""
    if not data:
        raise MediaError("no bytes")
    try:
        return (decode_bmp(data), 255) if data[:2] == b"BM" else decode_netpbm(data)
    except (struct.error, ValueError, IndexError, OverflowError) as e:
        raise e if isinstance(e, MediaError) else MediaError(str(e)) from e


# --- resizing, tiles, hashes ------------------------------------------------


def _axis_weights(size: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower index and fraction of the ``to`` + 1 borders along an axis."""
    border = np.arange(to + 1) * (size / to)
    low = np.minimum(border.astype(np.int64), size)
    return low, border - low


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas that the new samples cover, from an integral image with fractions at the borders.

    Of the integral image only the rows at borders are kept, so memory follows the width and not the height.
    """
    h, w = image.shape[:2]
    flat = image.reshape(h, w, -1)
    low, part = _axis_weights(h, height)
    high = np.minimum(low + 1, h)
    needed = np.unique(np.concatenate((low, high)))
    total = np.zeros((needed.size, w + 1, flat.shape[2]))
    sums, at = np.zeros((w, flat.shape[2])), 0
    for k, row in enumerate(needed):
        sums += flat[at:row].sum(axis=0, dtype=np.float64)
        np.cumsum(sums, axis=0, out=total[k, 1:])
        at = row
    low, high = np.searchsorted(needed, low), np.searchsorted(needed, high)
    rows = total[low] + (total[high] - total[low]) * part[:, None, None]
    low, part = _axis_weights(w, width)
    both = rows[:, low] + (rows[:, np.minimum(low + 1, w)] - rows[:, low]) * part[None, :, None]
    area = both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]
    out = area / (h / height * (w / width))
    return out.reshape((height, width) if image.ndim == 2 else (height, width, image.shape[2]))


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of an RGB image by the Rec. 601 weights; grey images as they are."""
    return image if image.ndim == 2 else image[:, :, :3] @ np.array([0.299, 0.587, 0.114])


def difference_hash(image: np.ndarray, size: int = TILE) -> str:
    """Hex of size * size bits: whether each sample of the (size, size + 1) area means is darker than its right neighbour."""
    small = np.round(area_resize(grey(image), size, size + 1), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def tile(image: np.ndarray, size: int = TILE, most: int = 255) -> bytes:
    """NPY bytes of the image area-resized to (size, size), its maximum scaled to 255 and rounded."""
    small = np.clip(np.rint(area_resize(image, size, size) * (255 / most)), 0, 255).astype(np.uint8)
    out = io.BytesIO()
    np.save(out, small, allow_pickle=False)
    return out.getvalue()


def read_tile(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


FEATURES = "width int, height int, channels int, maximum int, tile_npy binary, dhash string, error string"


def media_features(rows: DataFrame, data: str, size: int = TILE) -> DataFrame:
    """``rows`` without the bytes column, with width, height, channels, the samples' maximum, an NPY tile, the difference hash, and the reason where bytes do not decode."""
    common.small_batches(rows.sparkSession)

    def one(blob):
        try:
            image, most = decode_scaled(blob)
        except MediaError as e:
            return None, None, None, None, None, None, str(e)
        return image.shape[1], image.shape[0], 1 if image.ndim == 2 else image.shape[2], most, tile(image, size, most), difference_hash(image, size), None

    return _map(rows, data, one, FEATURES)


def _map(rows: DataFrame, column: str, one, made: str) -> DataFrame:
    """Rows with what ``one`` makes of a column in its place."""
    base, schema, finish = common.with_input(rows, column, made, keep=False)
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in made.split(", ")]

    def work(batches):
        for batch in batches:
            values = [one(v) for v in batch.columns[-1].to_pylist()]
            out = [pa.array([v[i] for v in values], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], schema.names)

    return finish(base.mapInArrow(work, schema))


# --- payloads stored as images ----------------------------------------------


def store_payload(data: bytes) -> tuple[bytes, bytes]:
    """(padded payload, image bytes that hold it): grey Netpbm, RGB Netpbm or 24-bit BMP by the payload's checksum."""
    payload = data + bytes([PAD]) * (-len(data) % UNIT if data else UNIT)
    samples = np.frombuffer(payload, np.uint8)
    form = zlib.crc32(payload) % 3
    if form == 0:
        return payload, encode_netpbm(samples.reshape(-1, UNIT // 24))
    image = samples.reshape(-1, UNIT // 24, 3)
    return payload, encode_netpbm(image) if form == 1 else encode_bmp(image)


def payload_features(text: str | None) -> tuple:
    """Stores the UTF-8 text as an image, decodes the stored bytes and describes them."""
    data = (text or "").encode()
    _, stored = store_payload(data)
    image, most = decode_scaled(stored)
    back, small = image.tobytes(), tile(image, most=most)
    feature = f"{'x'.join(map(str, image.shape))}:{difference_hash(image)}:{hashlib.sha256(small).hexdigest()[:16]}"
    return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, small


PAYLOAD = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_npy binary"


def text_media(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the features of each text stored as an image and read back, and its NPY tile; a null text is an empty one.

    feature: the image's shape, its difference hash, and the start of its tile's SHA-256.
    """
    common.small_batches(docs.sparkSession)
    return _map(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", payload_features, PAYLOAD)
