import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from benchlens.llm import gif_media as G

PALETTE = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])


def plain_stream(samples, size):
    """Codes without a growing table: a clear code before every sample."""
    bits = "".join(format(c, f"0{size + 1}b")[::-1] for s in samples for c in (1 << size, s)) + format((1 << size) + 1, f"0{size + 1}b")[::-1]
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


def image(samples, left, top, w, h, delay=0, disposal=0, transparent=None, interlaced=False, local=b""):
    s = plain_stream(samples, 2)
    control = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0"
    flags = (0x40 if interlaced else 0) | (0x81 if local else 0)
    return control + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + local + b"\x02" + bytes([len(s)]) + s + b"\0"


def gif(*images, w=2, h=2):
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + PALETTE + b"\x21\xfe\x02hi\0" + b"".join(images) + b"\x3b"


@pytest.mark.parametrize("n", [0, 1, 2, 5000, 60000])
def test_lzw_round_trip(n):
    rng = random.Random(n)
    for data in (bytes(n), bytes(rng.randrange(256) for _ in range(n)), (b"the quick brown fox " * n)[:n]):
        assert G.lzw_decode(G.lzw_encode(data), 8) == data


def test_late_clear_and_damage():
    data = b"abcab" * 3000
    assert G.lzw_decode(plain_stream(data, 8), 8) == data
    with pytest.raises(ValueError):
        G.lzw_decode(bytes([0xFF] * 20), 2)


def colours(frame):
    names = {(0, 0, 0, 255): "k", (255, 0, 0, 255): "r", (0, 255, 0, 255): "g", (0, 0, 255, 255): "b", (0, 0, 0, 0): "."}
    return "".join(names[tuple(p)] for p in frame.canvas.reshape(-1, 4).tolist())


def test_disposal_transparency_and_palettes():
    got = list(
        G.decode(
            gif(
                image([1, 1, 1, 1], 0, 0, 2, 2, delay=5),
                image([2, 0], 0, 0, 2, 1, disposal=2, transparent=0),
                image([3], 1, 1, 1, 1, disposal=3),
                image([1], 0, 1, 1, 1, local=bytes([9, 9, 9, 0, 0, 255, 0, 0, 0, 0, 0, 0])),
            )
        )
    )
    assert [colours(f) for f in got] == ["rrrr", "grrr", "..rb", "..br"]
    assert [f.delay_ms for f in got] == [50, 0, 0, 0]
    assert got[1].histogram()[0b001100] == 1 and sum(got[2].histogram()) == 2


def test_interlaced_rows():
    samples = [r % 4 for r in (0, 8, 4, 2, 6, 1, 3, 5, 7)]
    frame = next(G.decode(gif(image(samples, 0, 0, 1, 9, interlaced=True), w=1, h=9)))
    assert colours(frame) == "krgbkrgbk"


def test_stored_texts(spark, monkeypatch):
    monkeypatch.setattr(G, "MOST_ROWS", 50)
    long = "".join(random.Random(1).choice("abc é\n") for _ in range(9000))
    docs = [(1, None, 0), (2, "", 0), (3, "x" * 64, 0), (4, long, 0), (5, long, 0), (None, "\0é", 0)]
    got = {r.doc_id: r for r in G.store_texts(spark.createDataFrame(docs, "doc_id long, text string, feature int")).collect()}
    for d, t, _ in docs:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert tuple(got[d])[1:5] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert tuple(got[4])[1:] == tuple(got[5])[1:]
    assert G.store_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_frame_rows(spark):
    files = [(1, gif(image([1, 1, 1, 1], 0, 0, 2, 2, delay=5), image([2], 0, 0, 1, 1))), (2, None), (3, b"GIF89a"), (4, gif(image([1], 0, 0, 1, 1))[:-4]), (1, b"")]
    got = G.frames(spark.createDataFrame([(k, v, 1) for k, v in files], "id int, content binary, frame int"), "id", "content").collect()
    assert [(r.key, r.frame, r.start_ms) for r in got if r.error is None] == [(1, 0, 0), (1, 1, 50)]
    assert sorted(r.key for r in got if r.error) == [1, 2, 3, 4]
    assert np.frombuffer(got[0].rgba, np.uint8).reshape(2, 2, 4)[0, 0].tolist() == [255, 0, 0, 255]


def plain_decode(media):
    """Samples and colours of a stored GIF, code by code, by plain code; and its frames' times."""
    table = [tuple(media[13 + 3 * i : 16 + 3 * i]) for i in range(256)]
    at, samples, delays = 13 + 768, [], []
    while media[at] != 0x3B:
        if media[at] == 0x21:
            delays.append(struct.unpack_from("<H", media, at + 4)[0] * 10)
            at += 8
            continue
        w, h = struct.unpack_from("<HH", media, at + 5)
        at += 11
        stream = b""
        while media[at]:
            stream += media[at + 1 : at + 1 + media[at]]
            at += 1 + media[at]
        at += 1
        bits, place, width, own, last = int.from_bytes(stream, "little"), 0, 9, {}, None
        got = []
        while True:
            code = bits >> place & ((1 << width) - 1)
            place += width
            if code == 256:
                own, width, last = {i: bytes([i]) for i in range(256)} | {256: b"", 257: b""}, 9, None
                continue
            if code == 257:
                break
            entry = own[code] if code in own else last + last[:1]
            if last is not None and len(own) < 4096:
                own[len(own)] = last + entry[:1]
            got.append(entry)
            last = entry
            if len(own) >= 1 << width and width < 12:
                width += 1
        frame = b"".join(got)
        assert len(frame) == w * h
        samples.append(frame)
    return b"".join(samples), table, delays


def test_features_against_plain_decoding(spark):
    texts = ["", "abc", "été " * 300, "".join(random.Random(5).choice("abcdefgh \n") for _ in range(G.WIDTH * G.MOST_ROWS * 2 + 100))]
    got = {r.doc_id: r for r in G.store_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for d, text in enumerate(texts):
        raw = text.encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        media = G.encode(payload)
        assert (got[d].media_bytes, got[d].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        samples, table, delays = plain_decode(media)
        assert samples == payload and len(set(table)) == 256
        bins = [0] * 64
        for v in samples:
            r, g, b = table[v]
            bins[(r >> 6) * 16 + (g >> 6) * 4 + (b >> 6)] += 1
        assert got[d].feature == f"frames={len(delays)};ms={sum(delays)};histogram={','.join(map(str, bins))}"
    assert got[3].feature.startswith("frames=3;ms=300;")


def test_huge_screens_and_bombs_give_error_rows(spark):
    bomb = b"GIF89a" + struct.pack("<HHBBB", 65_535, 65_535, 0, 0, 0) + b"\x3b"
    wide = gif(image([1], 0, 0, 65_535, 65_535))
    long = G.lzw_encode(random.Random(1).randbytes(200_000))
    assert 10 <= len(G.lzw_decode(long, 8, 10)) < 20_000
    got = G.frames(spark.createDataFrame([(1, bomb), (2, wide), (3, gif(image([1, 1, 1, 1], 0, 0, 2, 2)))], "id int, content binary"), "id", "content").collect()
    assert sorted((r.key, r.error is None) for r in got) == [(1, False), (2, False), (3, True)]


def test_bands_are_the_rows_of_the_whole_screen(spark):
    rng = random.Random(4)
    files = []
    for _ in range(40):
        images = []
        for _ in range(rng.randrange(1, 5)):
            left, top, w, h = rng.randrange(6), rng.randrange(12), rng.randrange(1, 8), rng.randrange(1, 14)
            samples = [rng.randrange(4) for _ in range(w * h)]
            images.append(image(samples, left, top, w, h, rng.randrange(9), rng.randrange(4), rng.choice([None, 0, 3]), rng.random() < 0.5))
        files.append(gif(*images, w=7, h=13))
    # the third frame is damaged: two stay, whatever the bands
    files.append(gif(image([1] * 91, 0, 0, 7, 13), image([2] * 9, 2, 5, 3, 3), image([1], 0, 0, 7, 13), image([1], 0, 0, 1, 1), w=7, h=13))
    table = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "id int, content binary")
    whole = {(r.key, r.frame): r for r in G.frames(table, "id", "content").collect()}
    for pixels in (1, 7, 30):
        got = G.frames(table, "id", "content", pixels).collect()
        assert {(r.key, r.frame) for r in got} == set(whole)
        for (key, frame), want in whole.items():
            bands = sorted((r for r in got if (r.key, r.frame) == (key, frame)), key=lambda r: r.first_row or 0)
            assert {(r.start_ms, r.delay_ms, r.width, r.error) for r in bands} == {(want.start_ms, want.delay_ms, want.width, want.error)}
            if frame is not None:
                assert [r.first_row for r in bands] == list(range(0, 13, max(1, pixels // 7)))
                assert b"".join(r.rgba for r in bands) == want.rgba and want.first_row == 0
                assert np.sum([r.histogram for r in bands], 0).tolist() == want.histogram
            else:
                assert len(bands) == 1
    assert {f for k, f in whole if k == 40} == {0, 1, None}


def test_a_screen_beyond_one_band_is_decoded():
    w, h = 8192, 2100  # over 2 ** 24 pixels, of one colour in most rows
    samples = bytearray(w * h)
    samples[w * 2099 :] = bytes([7]) * w
    stream = G.lzw_encode(bytes(samples))
    media = b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + G._COLOURS.tobytes() + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08"
    media += b"".join(bytes([len(stream[k : k + 255])]) + stream[k : k + 255] for k in range(0, len(stream), 255)) + b"\0\x3b"
    bands = list(G.decode(media))
    assert [(f.number, f.first_row, f.canvas.shape) for f in bands] == [(0, 0, (2048, w, 4)), (0, 2048, (52, w, 4))]
    assert (bands[1].canvas[51] == [*G._COLOURS[7], 255]).all() and (bands[1].canvas[:51] == [0, 0, 0, 255]).all()
