"""Media columns: decoders, resizing and payload round trips."""

import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from tidemark.llm import media

RNG = np.random.default_rng(4)


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (3, 2, 3), (9, 33, 3), (64, 31)])
def test_round_trips(shape):
    image = RNG.integers(0, 256, shape).astype(np.uint8)
    assert (media.decode(media.encode_netpbm(image)) == image).all()
    assert (media.decode(media.encode_bmp(image)) == image).all()


def test_netpbm_forms():
    assert media.decode(b"P1\n# c\n3 2\n101\n0 1 0").tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode(b"P4 3 2\n\xa0\x40").tolist() == [[0, 1, 0], [1, 0, 1]]
    assert media.decode(b"P2 #x\n2 1 9 4 9").tolist() == [[4, 9]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]


def test_bmp_top_down_and_palette():
    image = RNG.integers(0, 256, (3, 5, 3)).astype(np.uint8)
    data = bytearray(media.encode_bmp(image[::-1]))
    data[22:26] = (-3).to_bytes(4, "little", signed=True)
    assert (media.decode(bytes(data)) == image).all()


@pytest.mark.parametrize("bad", [None, b"", b"P5", b"P5 2 2 255\n\x00", b"P9 1 1 1\n0", b"BM" + b"\x00" * 60, b"GIF89a", b"P2 1 1 5 9", b"P5 0 4 255\n", b"BM"])
def test_bad_bytes_are_named(spark, bad):
    with pytest.raises(media.MediaError):
        media.decode(bad)
    row = media.media_features(spark.createDataFrame([(1, bad)], "id long, data binary"), "data").first()
    assert row.error and row.width is None and row.tile_npy is None


def test_area_resize_equals_brute_force():
    for h, w, th, tw in ((8, 8, 2, 2), (7, 5, 3, 2), (3, 3, 8, 9), (40, 24, 8, 9), (1, 1, 4, 4)):
        image = RNG.integers(0, 256, (h, w)).astype(float)
        want = np.zeros((th, tw))
        for a in range(th):
            for b in range(tw):
                y0, y1, x0, x1 = a * h / th, (a + 1) * h / th, b * w / tw, (b + 1) * w / tw
                area = total = 0.0
                for y in range(h):
                    for x in range(w):
                        part = max(0, min(y1, y + 1) - max(y0, y)) * max(0, min(x1, x + 1) - max(x0, x))
                        area += part
                        total += part * image[y, x]
                want[a, b] = total / area
        assert np.allclose(media.area_resize(image, th, tw), want)


def test_tiles_and_hashes():
    image = np.tile(np.arange(0, 180, 10, dtype=np.uint8), (16, 1))
    assert media.difference_hash(image) == "ff" * 8 and media.difference_hash(image[:, ::-1]) == "00" * 8
    assert media.read_tile(media.tile(image)).shape == (8, 8)


def areas(size, parts):
    """(parts, size): how much of each sample every part of an axis covers, to a sum of 1."""
    edges = [k * size / parts for k in range(parts + 1)]
    return np.array([[max(0.0, min(j + 1, edges[i + 1]) - max(j, edges[i])) for j in range(size)] for i in range(parts)]) * (parts / size)


def means(image, height, width):
    return np.einsum("ih,hwc,jw->ijc", areas(image.shape[0], height), image.astype(float), areas(image.shape[1], width))


def test_payloads(spark):
    texts = ["", "abc", "é" * 288, "x" * 576, "y" * 577, "\x00\U0001f600" * 4000, None, "abc"]
    docs = spark.createDataFrame([(k, t, "n") for k, t in enumerate(texts)], "doc_id long, text string, feature string")
    got = {r.doc_id: r for r in media.text_media(docs).collect()}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-32:])
        _, stored = media.store_payload(data)
        assert r.media_bytes == len(stored) and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        # The feature and the tile, from the padded bytes alone.
        samples = np.frombuffer(padded, np.uint8)
        image = samples.reshape(-1, 24, 1) if zlib.crc32(padded) % 3 == 0 else samples.reshape(-1, 24, 3)
        luma = image[:, :, 0] if image.shape[2] == 1 else image @ np.array([0.299, 0.587, 0.114])
        small = np.round(means(luma[:, :, None], media.TILE, media.TILE + 1)[:, :, 0], 6)
        bits = "".join("1" if small[i, j] < small[i, j + 1] else "0" for i in range(media.TILE) for j in range(media.TILE))
        shape = "x".join(map(str, image.shape[: 2 if image.shape[2] == 1 else 3]))
        tile = np.load(io.BytesIO(r.tile_npy))
        wanted = means(image, media.TILE, media.TILE).reshape(tile.shape)
        assert np.abs(tile - wanted).max() <= 0.5 + 1e-6 and tile.dtype == np.uint8
        assert r.feature == f"{shape}:{int(bits, 2):0{media.TILE**2 // 4}x}:{hashlib.sha256(r.tile_npy).hexdigest()[:16]}"
    assert got[1][1:] == got[7][1:] and got[0][1:] == got[6][1:]
    assert media.text_media(docs.where("doc_id > 99")).count() == 0


def test_tiles_of_every_depth_equal_brute_force():
    rng = np.random.default_rng(4)
    for most, form in ((1, "P4"), (15, "P5"), (255, "P5"), (1000, "P5"), (65535, "P5")):
        image = rng.integers(0, most + 1, (16, 24))
        if form == "P4":
            data = b"P4 24 16\n" + np.packbits(1 - image.astype(np.uint8), axis=1).tobytes()
        else:
            data = f"P5 24 16 {most}\n".encode() + image.astype("u1" if most < 256 else ">u2").tobytes()
        found, top = media.decode_scaled(data)
        assert top == most and (found == image).all()
        want = [[round(image[2 * i : 2 * i + 2, 3 * j : 3 * j + 3].mean() * 255 / most, 9) for j in range(8)] for i in range(8)]
        got = media.read_tile(media.tile(found, 8, top))
        assert np.abs(got - np.array(want)).max() <= 0.5 + 1e-6
    assert (media.read_tile(media.tile(*[media.decode_scaled(b"P1 2 1 00")[0], 8, 1])) == 255).all()
    with pytest.raises(media.MediaError):
        media.decode(b"P5 1 1 100\n\xff")


def bmp(bits, packed, masks, pixels, width, height):
    head = struct.pack("<2sIHHI", b"BM", 0, 0, 0, 54 + 4 * len(masks))
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, packed, 0, 0, 0, 0, 0)
    return head + info + struct.pack(f"<{len(masks)}I", *masks) + pixels


def test_bit_fields():
    red, green, blue = (0xFF, 0xFF00, 0xFF0000)
    data = bmp(32, 3, [red, green, blue], struct.pack("<2I", 0x0A141E, 0xFF), 2, 1)
    assert media.decode(data).tolist() == [[[0x1E, 0x14, 0x0A], [0xFF, 0, 0]]]
    data = bmp(16, 3, [0xF800, 0x7E0, 0x1F], struct.pack("<2H", 0xF800, 0x7FF), 2, 1)
    assert media.decode(data).tolist() == [[[255, 0, 0], [0, 255, 255]]]
    assert media.decode(bmp(16, 0, [], struct.pack("<2H", 0x7C00, 0x1F), 2, 1)).tolist() == [[[255, 0, 0], [0, 0, 255]]]
    for masks in ([0, 1, 2], [5, 0xFF00, 0xFF0000]):
        with pytest.raises(media.MediaError):
            media.decode(bmp(32, 3, masks, b"\0" * 8, 2, 1))
