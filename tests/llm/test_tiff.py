import hashlib
import struct
import zlib

import numpy as np
import pytest

from tests.conftest import SF
from webloom.llm import queries, tiff


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_round_trip(compression, order, tile):
    rng = np.random.default_rng(2)
    for dtype in ("u1", "<u2", "<u4", "<u8"):
        for predictor in (1, 2, 3):
            if predictor == 3 and dtype == "u1":  # the floating-point predictor is one of several bytes
                continue
            top = int(np.iinfo(dtype).max) // 2
            images = [rng.integers(0, top, (37, 70, 3), dtype=np.uint64).astype(dtype), (np.arange(50 * 41).reshape(50, 41).astype(np.uint64) // 9 % np.uint64(top)).astype(dtype), np.zeros((1, 1), dtype)]
            got = list(tiff.pages(tiff.encode(images, compression, predictor, 8, tile, order)))
            assert [p.number for p in got] == [0, 1, 2]
            for p, image in zip(got, images, strict=True):
                assert (p.height, p.width) == image.shape[:2] and p.pixels == image.tobytes()


def test_codecs():
    rng = np.random.default_rng(5)
    for data in (b"", b"a", b"aaa" * 300, bytes(rng.integers(0, 4, 70_000, dtype=np.uint8)), bytes(rng.integers(0, 256, 30_000, dtype=np.uint8))):
        assert tiff.unpack_bits(tiff.pack_bits(data)) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    # the worked example of the published format description
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


def test_pages_operator(spark):
    two = tiff.encode([np.ones((2, 3), np.uint8), np.full((1, 2), 7, np.uint16)])
    rows = [(1, two, "x", 5), (2, None, "y", 6), (3, b"", None, 7), (4, b"II*\0junk", "z", 8), (5, two[:-30], "w", 9), (1, two, "x", 5)]
    df = spark.createDataFrame(rows, "id long, media binary, feature string, width int")
    got = tiff.decode_pages(df).collect()
    assert sorted((r.id, r._page, r.feature) for r in got if r._page is not None and r.id == 1) == [(1, 0, "x"), (1, 0, "x"), (1, 1, "x"), (1, 1, "x")]
    assert all(any(r.id == i and r._error for r in got) for i in (2, 3, 4, 5))
    assert tiff.decode_pages(df.limit(0)).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op3_tiff_pages(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = tiff.payload(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id].encode()), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-64:])
        assert r.media_bytes > 0 and len(r.media_sha256) == 64 and r.feature


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "é" * 32), (4, "x" * 300_000), (4, "x" * 300_000), (None, "a"), (5, "yé" * 60_000)]
    media = tiff.store_texts(spark.createDataFrame([(*r, b"m") for r in rows], "doc_id long, text string, media binary"))
    pages = tiff.decode_pages(media.filter("doc_id = 4")).collect()
    assert sorted(r._page for r in pages) == sorted([*range(5)] * 2)
    got = tiff.read_texts(media).collect()
    assert sorted((str(r.doc_id), bytes(r.payload)) for r in got) == sorted((str(d), tiff.payload(t)) for d, t in rows)
    assert len({r.feature for r in got if r.doc_id == 4}) == 1 and [r.feature.count("|") for r in got if r.doc_id == 5] == [2]
    assert tiff.read_texts(tiff.store_texts(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_every_form_is_written():
    seen = {(p.compression, p.predictor) for i in range(300) for p in tiff.pages(tiff.file_of(tiff.payload(f"text {i} " * 9)))}
    assert seen == {(c, p) for c in (tiff.LZW, tiff.PACKBITS, tiff.DEFLATE, tiff.OLD_DEFLATE) for p in (1, 2)}


def file_with(fields, data=b"", order="<"):
    """One directory with the fields {tag: (kind, values)} behind the data."""
    out = bytearray(b"II" + struct.pack("<HI", 42, 8 + len(data)) + data) + struct.pack("<H", len(fields))
    extra_at, extra = 8 + len(data) + 2 + 12 * len(fields) + 4, b""
    for tag, (kind, values) in sorted(fields.items()):
        value = struct.pack(f"<{len(values)}{tiff.FIELD[kind]}", *values)
        if len(value) > 4:
            place, extra = extra_at + len(extra), extra + value
            value = struct.pack("<I", place)
        out += struct.pack("<HHI", tag, kind, len(values)) + value.ljust(4, b"\0")
    return bytes(out + b"\0\0\0\0" + extra)


def test_bits_below_a_byte():
    for bits, line in ((1, b"\xa5\x80"), (2, b"\x1b\xc0"), (4, b"\x12\x34\x50")):
        n = {1: 9, 2: 5, 4: 5}[bits]
        want = [[1, 0, 1, 0, 0, 1, 0, 1, 1], [0, 1, 2, 3, 3], [1, 2, 3, 4, 5]][[1, 2, 4].index(bits)]
        data = tiff.pack_bits(line * 2)
        f = {tiff.WIDTH: (4, (n,)), tiff.HEIGHT: (4, (2,)), tiff.BITS: (3, (bits,)), tiff.COMPRESSION: (3, (tiff.PACKBITS,)), tiff.STRIP_OFFSETS: (4, (8,)), tiff.ROWS_PER_STRIP: (4, (2,)), tiff.STRIP_COUNTS: (4, (len(data),))}
        (page,) = tiff.pages(file_with(f, data))
        assert page.bits == bits and list(page.pixels) == want * 2
        assert tiff.feature(page).startswith(f"{n}x2x1:{bits}:")


def broken():
    good = {tiff.WIDTH: (4, (4,)), tiff.HEIGHT: (4, (4,)), tiff.BITS: (3, (8,)), tiff.STRIP_OFFSETS: (4, (8,)), tiff.ROWS_PER_STRIP: (4, (4,)), tiff.STRIP_COUNTS: (4, (16,))}
    data = bytes(range(16))
    yield file_with({k: v for k, v in good.items() if k != tiff.STRIP_OFFSETS}, data)
    yield file_with({k: v for k, v in good.items() if k != tiff.STRIP_COUNTS}, data)
    for tag, values in ((tiff.ROWS_PER_STRIP, (0,)), (tiff.WIDTH, (0,)), (tiff.HEIGHT, (0,)), (tiff.WIDTH, ()), (tiff.STRIP_COUNTS, (16, 16)), (tiff.STRIP_OFFSETS, (9_999_999,)), (tiff.SAMPLES, (0,))):
        yield file_with(good | {tag: (good.get(tag, (3,))[0], values)}, data)
    yield file_with(good | {tiff.WIDTH: (4, (2**31,)), tiff.HEIGHT: (4, (2**31,))}, data)
    yield file_with(good | {tiff.TILE_OFFSETS: (4, (8,)), tiff.TILE_COUNTS: (4, (16,))}, data)
    yield file_with(good | {tiff.TILE_OFFSETS: (4, (8,)), tiff.TILE_COUNTS: (4, (16,)), tiff.TILE_WIDTH: (4, (0,)), tiff.TILE_HEIGHT: (4, (16,))}, data)
    for codec in (tiff.LZW, tiff.DEFLATE, 7):
        yield file_with(good | {tiff.COMPRESSION: (3, (codec,))}, data)
    yield file_with(good | {tiff.PREDICTOR: (3, (9,))}, data)
    yield file_with(good | {tiff.PREDICTOR: (3, (2,)), tiff.BITS: (3, (1,))}, data)


def test_damaged_files(spark):
    files = [*broken(), b"", b"II", b"II*\0", b"II*\0\xff\xff\xff\x7f", b"MM\0*\0\0\0\x08\xff\xff"]
    fine = file_with({tiff.WIDTH: (4, (4,)), tiff.HEIGHT: (4, (4,)), tiff.BITS: (3, (8,)), tiff.STRIP_OFFSETS: (4, (8,)), tiff.STRIP_COUNTS: (4, (16,))}, bytes(range(16)))
    files += [fine[:i] for i in range(len(fine))]
    rng = np.random.default_rng(8)
    whole = tiff.encode([rng.integers(0, 255, (30, 40), dtype=np.uint8)], tiff.LZW, 2, 8)
    for _ in range(300):
        b = bytearray(whole)
        for _ in range(3):
            b[rng.integers(len(b))] = rng.integers(256)
        files.append(bytes(b))
    got = tiff.decode_pages(spark.createDataFrame(list(enumerate(files)), "id long, media binary"), max_page=1 << 24).collect()
    assert {r.id for r in got} == set(range(len(files)))
    assert all(any(r._error for r in got if r.id == i) for i in range(len(list(broken())) + 5) if files[i] != fine)
    assert all((r._error is None) != (r._pixels is None) for r in got)
    assert [r._pixels for r in tiff.decode_pages(spark.createDataFrame([(fine,)], "media binary")).collect()] == [bytes(range(16))]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(tiff.file_of(tiff.payload("a")), 1, "x")], "media binary, _page long, _ERROR string")
    got = tiff.decode_pages(df)
    assert got.columns[:4] == ["_page", "_ERROR", "_page_", "_width"] and got.columns[-1] == "_error_"
    assert got.first()._page == 1 and got.first()._page_ == 0


@pytest.mark.parametrize("dtype", ["<f4", ">f8", "<f2", "i1", "<i2", ">i4"])
@pytest.mark.parametrize("predictor", [1, 2, 3])
def test_sample_formats(dtype, predictor):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 20, (8, 8)).astype(dtype)
    if predictor == 3 and x.dtype.itemsize == 1:
        return
    (page,) = tiff.pages(tiff.encode([x], tiff.DEFLATE, predictor))
    assert page.format == x.dtype.kind
    assert np.array_equal(np.frombuffer(page.pixels, dtype=x.dtype.newbyteorder("<")).reshape(8, 8), x)
    mean, deviation = map(float, tiff.feature(page).split(":")[2:4])
    assert mean == pytest.approx(float(x.astype("f8").mean()), abs=0.02) and deviation == pytest.approx(float(x.astype("f8").std()), abs=0.02)


def changed(data, tag, value):
    """The file with another value of a field of its only page, a 16-bit number in place."""
    at = struct.unpack_from("<I", data, 4)[0]
    out = bytearray(data)
    for i in range(struct.unpack_from("<H", data, at)[0]):
        if struct.unpack_from("<H", data, at + 2 + 12 * i)[0] == tag:
            struct.pack_into("<H", out, at + 10 + 12 * i, value)
            return bytes(out)
    raise KeyError(tag)


def test_fill_order_and_photometric():
    rows = np.frombuffer(b"\xb1\x0f\x80", dtype=np.uint8).reshape(1, 3)
    plain = tiff.encode([rows], tiff.NONE)
    turned = tiff.encode([np.frombuffer(rows.tobytes().translate(tiff.TURNED), dtype=np.uint8).reshape(1, 3)], tiff.NONE)
    turned = changed(changed(turned, tiff.PLANAR, 1), tiff.PHOTOMETRIC, 0)
    # the field of the planes makes room for the fill order
    at = turned.index(struct.pack("<HHIHH", tiff.PLANAR, 3, 1, 1, 0))
    turned = turned[:at] + struct.pack("<HHIHH", tiff.FILL_ORDER, 3, 1, 2, 0) + turned[at + 12 :]
    (page,), (other,) = tiff.pages(plain), tiff.pages(turned)
    assert page.pixels == other.pixels == rows.tobytes() and (page.photometric, other.photometric) == (1, 0)
    bad = turned.replace(struct.pack("<HHIHH", tiff.FILL_ORDER, 3, 1, 2, 0), struct.pack("<HHIHH", tiff.SAMPLE_FORMAT, 3, 1, 3, 0))
    with pytest.raises(tiff.TiffError, match="sample format"):
        list(tiff.pages(bad))


def test_query_against_a_plain_version(spark):
    """Every column of the query, from the stored files of the texts themselves."""
    got = {r.doc_id: r for r in queries.op3_tiff_pages(spark, SF).collect()}
    by_text = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        data = tiff.payload(r.text)
        media = tiff.file_of(data)
        parts = list(tiff.pages(media))
        assert b"".join(p.pixels for p in parts) == data
        want = (len((r.text or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), "|".join(map(tiff.feature, parts)))
        assert tuple(got[r.doc_id])[1:] == want
        assert by_text.setdefault(r.text, want) == want
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
