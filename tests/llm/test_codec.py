"""The WebP codec: every transform, cache and reference, and damaged input."""

import numpy as np
import pytest

from courtflow.llm import vp8l


def image(kind, shape, rng):
    h, w = shape
    if kind == "noise":
        return rng.integers(0, 1 << 32, shape, dtype=np.uint32)
    if kind == "few":
        return rng.choice(rng.integers(0, 1 << 32, 5, dtype=np.uint32), shape)
    if kind == "two":
        return rng.choice(np.array([0xFF000000, 0xFFFFFFFF], np.uint32), shape)
    if kind == "one":
        return np.full(shape, 0x80123456, np.uint32)
    if kind == "grey":
        return np.uint32(0xFF000000) | rng.integers(0, 40, shape, dtype=np.uint32) * np.uint32(0x010101)
    y, x = np.mgrid[:h, :w]
    return (0xFF000000 | ((x * 3 + y) % 256) << 16 | ((x + y * 2) % 256) << 8 | ((x * y) // 7 % 256)).astype(np.uint32)


@pytest.mark.parametrize("kind", ["noise", "few", "two", "one", "grey", "smooth"])
@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (9, 1), (13, 17), (5, 40)])
def test_round_trips(kind, shape):
    rng = np.random.default_rng(1)
    a = image(kind, shape, rng)
    blocks = (-(-shape[0] // 4), -(-shape[1] // 4))
    factors = rng.integers(0, 1 << 24, blocks, dtype=np.uint32) | np.uint32(0xFF000000)
    options = [{}, {"green": True}, {"cache_bits": 3}, {"cache_bits": 10, "references": True}, {"references": True, "meta_bits": 2}, {"factors": factors}]
    options += [{"modes": np.full(blocks, m)} for m in range(14)]
    options.append({"modes": rng.integers(0, 14, blocks), "factors": factors, "green": True, "cache_bits": 5, "references": True, "meta_bits": 3})
    if len(np.unique(a)) <= 256:
        options += [{"palette": True}, {"palette": True, "references": True, "cache_bits": 2}]
    for o in options:
        assert (vp8l.decode(vp8l.encode(a, **o)) == a).all(), o


@pytest.mark.parametrize("kind", ["noise", "few", "two", "one", "grey", "smooth"])
@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (9, 1), (13, 17), (5, 40), (40, 192), (1030, 9)])
def test_best_round_trips(kind, shape):
    a = image(kind, shape, np.random.default_rng(3))
    assert (vp8l.decode(vp8l.encode_best(a)) == a).all()


def test_fast_and_slow_paths_agree():
    rng = np.random.default_rng(2)
    for kind in ("noise", "few", "grey", "smooth"):
        a = np.concatenate([image(kind, (30, 48), rng)] * 2)
        a = np.concatenate([a, a[5:25], a[1:2]])
        for o in ({}, {"cache_bits": 1}, {"cache_bits": 4, "references": True}, {"references": True, "green": True}):
            data = vp8l.encode(a, **o)
            fast, vp8l._fast_pixels, calls = vp8l._fast_pixels, lambda r, codes, bits, w, n: calls.append(1) or vp8l._pixels(r, [codes], None, 0, bits, w, n // w), []
            try:
                slow = vp8l.decode(data)
            finally:
                vp8l._fast_pixels = fast
            assert calls and (slow == a).all() and (vp8l.decode(data) == a).all()


def test_best_takes_what_is_small():
    """Each transform, the cache and references are written where they pay, and undone."""
    rng = np.random.default_rng(4)
    walk = np.cumsum(rng.integers(-2, 3, (60, 192, 3)), 1).astype(np.uint8)
    grey = np.repeat(rng.integers(0, 256, (60, 192, 1)), 3, 2).astype(np.uint8)
    few = rng.choice(np.array([[1, 2, 3], [7, 7, 7], [9, 0, 2]], np.uint8), (20, 192))
    words = rng.integers(0, 256, (60, 6, 3)).astype(np.uint8)
    text = words[rng.integers(0, 60, 32 * 60)].reshape(60, 192, 3)
    seen = {}
    for name, samples in (("walk", walk), ("grey", grey), ("few", few), ("text", text)):
        c = np.concatenate([samples[..., ::-1], np.full((*samples.shape[:2], 1), 255, np.uint8)], 2)
        argb = vp8l._packed(c)
        data = vp8l.encode_best(argb)
        calls, originals = [], {f: getattr(vp8l, f) for f in ("undo_predictor", "cross_colour", "undo_palette", "_resolved")}
        for f, g in originals.items():
            setattr(vp8l, f, lambda *x, f=f, g=g, **k: calls.append(f) or g(*x, **k))
        try:
            assert (vp8l.decode(data) == argb).all()
        finally:
            for f, g in originals.items():
                setattr(vp8l, f, g)
        seen[name] = set(calls)
    assert "undo_predictor" in seen["walk"] and "cross_colour" in seen["grey"] and "undo_palette" in seen["few"] and "_resolved" in seen["text"]


def test_format_facts():
    data = vp8l.encode_best(np.zeros((2, 3), np.uint32))
    assert data[:4] == b"RIFF" and int.from_bytes(data[4:8], "little") == len(data) - 8 and data[8:16] == b"WEBPVP8L" and data[20] == 0x2F
    assert int.from_bytes(data[21:25], "little") & 0x3FFF == 2 and int.from_bytes(data[21:25], "little") >> 14 & 0x3FFF == 1
    assert len(vp8l.NEAR) == 120 and len(set(vp8l.NEAR)) == 120
    assert [vp8l.prefix(v)[0] for v in (1, 2, 3, 4, 5, 7, 9, 4096)] == [0, 1, 2, 3, 4, 5, 6, 23]
    # a palette image written by hand: 1 x 1, one colour
    w = vp8l.Writer()
    w.write(0, 14), w.write(0, 14), w.write(0, 1), w.write(0, 3)
    w.write(0, 1)  # no transform
    w.write(0, 1), w.write(0, 1)  # no cache, one group
    for symbol in (7, 8, 9, 255, 0):
        w.write(1, 1), w.write(0, 1), w.write(1, 1), w.write(symbol, 8)
    assert vp8l.decode(vp8l._file(w)).tolist() == [[0xFF080709]]


def test_damage_is_noticed():
    data = vp8l.encode_best(np.random.default_rng(0).integers(0, 1 << 32, (3, 192), dtype=np.uint32))
    for bad in (b"", b"RIFF" + data[4:12] + b"VP8 " + data[16:], data[:40]):
        with pytest.raises((ValueError, IndexError)):
            vp8l.decode(bad)


def test_code_lengths_are_complete_and_bounded():
    for counts in ([1, 1], [0, 5, 0], [2**i for i in range(30)], list(range(200))):
        n = vp8l.code_lengths(np.array(counts), 15)
        assert n.max() <= 15 and ((n > 0) == (np.array(counts) > 0)).all()
        if (n > 0).sum() > 1:
            assert sum(2.0 ** -int(x) for x in n if x) == 1


def test_reading_takes_few_steps_of_python():
    """Lines run in the codec to read a document of 2.7 kB back, which is what its CPU seconds go by: 1,083 when codes of lengths were read in a loop."""
    import random
    import sys

    from courtflow.llm import media

    r = random.Random(7)
    words = ["".join(r.choices("etaoinshrdlucmfw", k=r.randint(2, 9))) for _ in range(400)]
    data = " ".join(r.choice(words) for _ in range(420)).encode()
    stored, run = media.store(media.padded(data)), []

    def line(frame, event, arg):
        run.append(event)
        return line

    media.load(stored, len(data))  # what is kept from call to call is there
    before = sys.gettrace()
    sys.settrace(lambda frame, event, arg: line if frame.f_code.co_filename == vp8l.__file__ else None)
    try:
        read = media.load(stored, len(data))
    finally:
        sys.settrace(before)
    assert read.tobytes() == media.padded(data) and run.count("line") < 950


def test_codes_of_lengths_are_read_as_written():
    rng = np.random.default_rng(6)
    for alphabet in (40, 256, 280, 280 + 128):
        for most in (2, 30, 5000):  # the longest go beyond the bits looked at first
            lengths = vp8l.code_lengths(rng.integers(0, most, alphabet), 15)
            w = vp8l.Writer()
            vp8l.write_code(w, lengths)
            r = vp8l.Reader(w.bytes() + b"\x55")
            code, want = vp8l.read_code(r, alphabet), vp8l.Code(lengths)
            assert r.at == w.bits and code.bits == want.bits and (code.table == want.table).all()


def test_repeated_lengths_are_read():
    """16 repeats the last length that wasn't 0, or 8 where there is none."""
    w, sizes = vp8l.Writer(), np.array([2 if n in (0, 7, 8, 16) else 0 for n in range(19)])
    codes = vp8l.canonical(sizes)
    w.write(0, 1), w.write(15, 4)
    for n in vp8l.CODE_LENGTH_ORDER:
        w.write(int(sizes[n]), 3)
    told = [(16, 3), (7, 0), (0, 0), *[(16, 3)] * 20, (16, 0), (8, 0), (8, 0)]
    w.write(1, 1), w.write(3, 3), w.write(len(told) - 2, 8)
    for symbol, more in told:
        w.write(int(codes[symbol]), 2)
        if symbol == 16:
            w.write(more, 2)
    lengths = np.zeros(256, np.int64)
    lengths[:133] = [8] * 6 + [7, 0] + [7] * 123 + [8] * 2
    r = vp8l.Reader(w.bytes() + bytes(8))
    assert (vp8l.read_code(r, 256).table == vp8l.Code(lengths).table).all() and r.at == w.bits


def test_prefix_codes_of_many_values():
    for values in (np.arange(1, 8193), np.array([1, 5, 8192, 8193, 70_000, 1 << 20])):
        assert list(zip(*(x.tolist() for x in vp8l._prefix_of(values)))) == [vp8l.prefix(v) for v in values.tolist()]
