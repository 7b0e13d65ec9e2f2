import numpy as np
import pytest

from tidewire.llm import progressive_jpeg as jpeg
from tidewire.llm.media import load, pad, read_media, store, to_media

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000, 50_000])
def test_exact_round_trip(n):
    raw = pad(RNG.integers(0, 256, n, dtype=np.uint8).tobytes())
    assert len(raw) % 576 == 0 and len(raw) > 0
    payload, rgb = load(store(raw))
    assert payload == raw and rgb.shape[2] == 3 and rgb.dtype == np.uint8


def test_array_paths_equal_bit_by_bit(monkeypatch):
    media = store(pad(RNG.integers(0, 256, 3000, dtype=np.uint8).tobytes()))
    fast, head = jpeg.decode(media)
    plain = jpeg._table.__wrapped__
    monkeypatch.setattr(jpeg, "_table", lambda spec: (plain(spec)[0], 0, None, None))
    monkeypatch.setattr(jpeg, "_refine_runs", lambda *a: False)
    slow, _ = jpeg.decode(media)
    assert all((a == b).all() for a, b in zip(fast, slow))
    assert head["width"] % 16 == 0


def test_general_scans_with_zeros_and_runs():
    """A grey file written here with zero runs, an end-of-band run, and new coefficients in the refinement."""
    coef = np.zeros((1, 3, 64), np.int32)
    coef[0, 0, [0, 3, 25]], coef[0, 1, 0], coef[0, 2, [0, 1]] = [40, -5, 1], -8, [7, 1]
    dc = bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9))
    symbols = [0x00, 0x10, 0x22, 0x01, 0xF0, 0x31, 0x51]
    ac = bytes([0, 0, 0, 7] + [0] * 12) + bytes(symbols)
    code = {s: f"{i:04b}" for i, s in enumerate(symbols)}

    def num(v):
        n = abs(v).bit_length()
        return f"{n:04b}" + (f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else "")

    def pack(bits):
        return jpeg._packed(np.array([int(b) for b in bits], np.uint8))

    halves = [20, -4, 3]
    first_dc = num(20) + num(-24) + num(7)
    refine_dc = "001"
    # first AC scan at Al=1: block 0 has -5 -> -2 at k=3 (run 2, size 2), then a run of 3 ended bands
    first_ac = code[0x22] + "01" + code[0x10] + "1"
    # refinement: block 0 corrects -5 (bit 1), +1 new at k=25: zeros 1,2 | 4..24 -> 23 zeros: ZRL takes 16, run 7 is not in
    # the table, so the coefficient is left out here and block 0 ends with its band
    refine_ac = code[0x00] + "1" + code[0x00] + code[0x01] + "1" + code[0x00]
    scan = lambda ss, se, a, body: jpeg._marker(jpeg.SOS, bytes([1, 1, 0, ss, se, a])) + body
    data = (
        b"\xff\xd8" + jpeg._marker(jpeg.DQT, b"\0" + bytes([1] * 64)) + jpeg._marker(jpeg.DHT, b"\0" + dc + b"\x10" + ac)
        + jpeg._marker(jpeg.SOF2, bytes([8, 0, 8, 0, 24, 1, 1, 0x11, 0]))
        + scan(0, 0, 1, pack(first_dc)) + scan(1, 63, 1, pack(first_ac)) + scan(0, 0, 0x10, pack(refine_dc)) + scan(1, 63, 0x10, pack(refine_ac)) + b"\xff\xd9"
    )
    got, head = jpeg.decode(data)
    coef[0, 0, 25] = 0
    assert (got[0] == coef).all() and [c >> 1 for c in coef[0, :, 0]] == halves
    assert jpeg.to_rgb(got, head).shape == (8, 24, 3)


def test_inverse_transform_is_orthonormal_and_flat_block_is_flat():
    m = jpeg._inverse()
    assert np.allclose(m @ m.T, np.eye(64))
    assert jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2] and sorted(jpeg.ZIGZAG) == list(range(64))
    grey = [np.zeros((1, 1, 64), np.int32)]
    grey[0][0, 0, 0] = 80
    rgb = jpeg.to_rgb(grey, {"height": 8, "width": 8, "quant": [np.ones(64, int)], "factors": [(1, 1)]})
    assert (rgb == 138).all()


def test_table(spark):
    rows = [(1, "abc", "m"), (1, "abc", "m"), (2, None, "m"), (3, "", "m"), (None, "é" * 4000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = read_media(to_media(df, "text", ["doc_id"]), ["doc_id", "n_bytes"]).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload) for r in got) == sorted((a or 0, len((t or "").encode()), pad((t or "").encode())) for a, t, _ in rows)
    assert all(len(r.rgb) == r.height * r.width * 3 for r in got)
    assert to_media(df.limit(0), "text", ["doc_id"]).count() == 0
