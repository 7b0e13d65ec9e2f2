"""A progressive JPEG codec in numpy.

Decoding takes any Huffman-coded progressive file of 8-bit samples: the scans of spectral selection (Ss..Se) and
successive approximation (Ah, Al) are accumulated into coefficient arrays, which are then dequantised, inverse-
transformed, chroma-upsampled and turned into RGB. A scan whose Huffman table gives every (code, magnitude) pair the same
total width is read with array operations; every other scan is read bit by bit.

Encoding writes such equal-width tables. Its coefficients are the caller's, so a payload put in them comes back exactly.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

# Fixed values of the format: the zigzag order of the 64 coefficients of a block.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else (i % 8))))
SOI, EOI, SOS, DQT, DHT, SOF2, DRI, COM = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xC2, 0xDD, 0xFE


@lru_cache(maxsize=1)
def _inverse() -> np.ndarray:
    """64 x 64: zigzag coefficients to the samples of a block."""
    x, u = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    c = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    full = np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)
    return np.ascontiguousarray(full[ZIGZAG])


# ---- Huffman tables


@lru_cache(maxsize=256)
def _table(spec: bytes) -> tuple[dict, int, np.ndarray | None, np.ndarray | None]:
    """Of a table's 16 counts and symbols: codes by (length, code); the common width or 0; with a width, the run and the
    value that each bit pattern of that width stands for (run -1: none)."""
    codes, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(spec[length - 1]):
            codes[length, code] = spec[at]
            code, at = code + 1, at + 1
        code <<= 1
    widths = {n + (s & 15) for (n, _), s in codes.items()}
    if len(widths) != 1 or (width := widths.pop()) > 16:
        return codes, 0, None, None
    run, value = np.full(1 << width, -1, np.int16), np.zeros(1 << width, np.int32)
    for (n, c), s in codes.items():
        size = s & 15
        bits = np.arange(1 << size)
        run[(c << size) : (c + 1) << size] = s >> 4
        value[(c << size) : (c + 1) << size] = np.where(bits >> max(size - 1, 0), bits, bits - (1 << size) + 1) if size else 0
    return codes, width, run, value


def equal_width_spec(sizes: range, width: int) -> bytes:
    """A table in which a magnitude of `size` bits has a code of width - size bits."""
    lengths = [0] * 16
    order = sorted(sizes, reverse=True)
    for s in order:
        lengths[width - s - 1] += 1
    return bytes(lengths) + bytes(order)


DC_SPEC = equal_width_spec(range(0, 9), 9)
AC_SPEC = equal_width_spec(range(1, 8), 8)
RUN_SPEC = bytes([0, 0, 0, 15] + [0] * 12) + bytes(i << 4 for i in range(15))  # end-of-band runs, 4 bits each


def _patterns(spec: bytes, low: int, high: int) -> np.ndarray:
    """The bit pattern of every value from low to high, at value - low."""
    _, width, run, value = _table(spec)
    out = np.zeros(high - low + 1, np.uint16)
    bits = np.flatnonzero((run == 0) & (value >= low) & (value <= high))
    out[value[bits] - low] = bits
    return out


class _Bits:
    """A bit reader over one entropy-coded segment without stuffing; past its end it reads ones."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist() + [1] * 64
        self.at = 0

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n]:
            v = v << 1 | b
        self.at += n
        return v

    def symbol(self, codes: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bits[self.at]
            self.at += 1
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("bad Huffman code")

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


# ---- scans


def _dc_first(bits, parts, tables, order, al):
    pred = [0] * len(parts)
    for c, b in order:
        pred[c] += bits.value(bits.symbol(tables[c]))
        parts[c][b, 0] = pred[c] << al


def _dc_refine(bits, parts, order, al):
    for c, b in order:
        parts[c][b, 0] |= bits.take(1) << al


def _ac_first(bits, blocks, codes, ids, ss, se, al):
    rest = 0
    for b in ids:
        if rest:
            rest -= 1
            continue
        k = ss
        while k <= se:
            s = bits.symbol(codes)
            run, size = s >> 4, s & 15
            if size:
                k += run
                blocks[b, k] = bits.value(size) * (1 << al)
                k += 1
            elif run == 15:
                k += 16
            else:
                rest = (1 << run) + bits.take(run) - 1
                break


def _ac_refine(bits, blocks, codes, ids, ss, se, al):
    step, rest = 1 << al, 0

    def correct(b, k):
        if bits.take(1):
            blocks[b, k] += step if blocks[b, k] > 0 else -step

    for b in ids:
        k = ss
        if not rest:
            while k <= se:
                s = bits.symbol(codes)
                run, new = s >> 4, 0
                if s & 15:
                    new = step if bits.take(1) else -step
                elif run < 15:
                    rest = (1 << run) + bits.take(run)
                    break
                while k <= se:
                    if blocks[b, k]:
                        correct(b, k)
                    elif run:
                        run -= 1
                    else:
                        blocks[b, k] = new
                        k += 1
                        break
                    k += 1
        if rest:
            for j in range(k, se + 1):
                if blocks[b, j]:
                    correct(b, j)
            rest -= 1


def _fixed(data: bytes, n: int, width: int) -> np.ndarray | None:
    """The first n numbers of `width` bits, or None if there are not as many."""
    if len(data) * 8 < n * width:
        return None
    if width == 8:
        return np.frombuffer(data, np.uint8, n)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    return bits[:, 0] if width == 1 else bits @ (1 << np.arange(width - 1, -1, -1))


def _refine_runs(data: bytes, blocks: np.ndarray, codes: dict, ss: int, se: int, al: int) -> bool:
    """A refinement in which no coefficient turns nonzero: end-of-band runs with one bit for each coefficient."""
    band = blocks[:, ss : se + 1]
    if not band.all():
        return False
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    at = done = 0
    got = np.empty(band.shape, np.int32)
    while done < len(band):
        head = _Bits(np.packbits(bits[at : at + 40]).tobytes())
        try:
            s = head.symbol(codes)
        except ValueError:
            return False
        if s & 15 or s >> 4 == 15:
            return False
        run = (1 << (s >> 4)) + head.take(s >> 4)
        at += head.at
        n = run * band.shape[1]
        if done + run > len(band) or at + n > len(bits):
            return False
        got[done : done + run] = bits[at : at + n].reshape(run, -1)
        at, done = at + n, done + run
    band += np.where(band > 0, got, -got) << al
    return True


def _segment_end(data: bytes, at: int) -> int:
    while True:
        at = data.index(b"\xff", at)
        if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2


class _Part:
    def __init__(self, ident, h, v, q):
        self.ident, self.h, self.v, self.q = ident, h, v, q


def decode(data: bytes) -> tuple[list[np.ndarray], dict]:
    """Coefficients by component, each (block rows, block columns, 64) in zigzag order, and what the headers say."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, quant, specs, comments, restart = 2, {}, {}, [], 0
    parts: list[_Part] = []
    height = width = 0
    while data[at + 1] != EOI:
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark == COM:
            comments.append(body)
        elif mark == DRI:
            restart = struct.unpack(">H", body)[0]
        elif mark == DQT:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide == 2 else np.uint8, 64, 1).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif mark == DHT:
            while body:
                n = 17 + sum(body[1:17])
                specs[body[0]] = bytes(body[1:n])
                body = body[n:]
        elif mark == SOF2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [_Part(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hm, vm = max(p.h for p in parts), max(p.v for p in parts)
            across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
            for p in parts:
                p.cols, p.rows = across * p.h, down * p.v
                p.own_cols, p.own_rows = -(-(-(-width * p.h // hm)) // 8), -(-(-(-height * p.v // vm)) // 8)
                p.blocks = np.zeros((p.rows * p.cols, 64), np.int32)
        elif mark == SOS:
            n = body[0]
            ids = [(next(p for p in parts if p.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            end = _segment_end(data, at)
            _scan(data[at:end], ids, specs, restart, (across, down), *body[1 + 2 * n : 3 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15)
            at = end
        elif 0xC0 <= mark <= 0xCF:
            raise ValueError("not a Huffman-coded progressive JPEG")
    head = {"height": height, "width": width, "comments": comments, "quant": [quant[p.q] for p in parts], "factors": [(p.h, p.v) for p in parts]}
    return [p.blocks.reshape(p.rows, p.cols, 64) for p in parts], head


@lru_cache(maxsize=64)
def _interleaved(across: int, down: int, factors: tuple) -> list[np.ndarray]:
    """For each component, its blocks by MCU: (MCUs, blocks of one MCU)."""
    y, x = np.divmod(np.arange(across * down), across)
    return [
        np.concatenate([((y * v + j) * across * h + x * h + i)[:, None] for j in range(v) for i in range(h)], 1) for h, v in factors
    ]


def _scan(raw: bytes, ids, specs, restart, grid, ss, se, ah, al) -> None:
    parts = [p.blocks for p, _ in ids]
    pieces = [raw]
    if restart:
        pieces, last = [], 0
        for i in range(len(raw) - 1):
            if raw[i] == 0xFF and 0xD0 <= raw[i + 1] <= 0xD7:
                pieces.append(raw[last:i])
                last = i + 2
        pieces.append(raw[last:])
    pieces = [x.replace(b"\xff\x00", b"\xff") for x in pieces]
    if len(ids) == 1:
        p = ids[0][0]
        own = (np.arange(p.own_rows)[:, None] * p.cols + np.arange(p.own_cols)).ravel()
        units = [own[:, None]]
    else:
        units = _interleaved(*grid, tuple((p.h, p.v) for p, _ in ids))
    total = len(units[0])
    step = restart or total
    kind = (ids[0][1] & 15) | 0x10 if ss else None
    for i, piece in enumerate(pieces):
        at = slice(i * step, min(total, (i + 1) * step))
        mine = [u[at] for u in units]
        if ss == 0:
            counts = [u.shape[1] for u in mine]
            if ah == 0:
                tables = [_table(specs[t >> 4]) for _, t in ids]
                wide = {t[1] for t in tables}
                if len(wide) == 1 and (w := wide.pop()) and (got := _fixed(piece, len(mine[0]) * sum(counts), w)) is not None:
                    got, k, good = got.reshape(-1, sum(counts)), 0, True
                    for u, t, n, c in zip(mine, tables, counts, parts):
                        good &= not t[2][got[:, k : k + n]].any()
                        c[u.ravel(), 0] = np.cumsum(t[3][got[:, k : k + n]].ravel()) << al
                        k += n
                    if good:
                        continue
                order = [(c, int(b)) for m in range(len(mine[0])) for c in range(len(mine)) for b in mine[c][m]]
                _dc_first(_Bits(piece), parts, [t[0] for t in tables], order, al)
            else:
                got = _fixed(piece, len(mine[0]) * sum(counts), 1)
                if got is None:
                    raise ValueError("short scan")
                got, k = got.reshape(-1, sum(counts)), 0
                for u, n, c in zip(mine, counts, parts):
                    c[u.ravel(), 0] |= got[:, k : k + n].ravel().astype(np.int32) << al
                    k += n
            continue
        blocks, own = parts[0], mine[0].ravel()
        codes, w, run, value = _table(specs[kind])
        if ah == 0:
            if w and (got := _fixed(piece, len(own) * (se - ss + 1), w)) is not None and not run[got].any() and value[got].all():
                blocks[own, ss : se + 1] = (value[got] * (1 << al)).reshape(len(own), -1)
            else:
                _ac_first(_Bits(piece), blocks, codes, own, ss, se, al)
        elif len(own) == len(blocks) and _refine_runs(piece, blocks, codes, ss, se, al):
            pass
        else:
            _ac_refine(_Bits(piece), blocks, codes, own, ss, se, al)


def to_rgb(coefficients: list[np.ndarray], head: dict) -> np.ndarray:
    """uint8 (height, width, 3): dequantised, inverse-transformed, chroma repeated up to full resolution, as RGB."""
    h, w = head["height"], head["width"]
    hm, vm = max(f[0] for f in head["factors"]), max(f[1] for f in head["factors"])
    planes = []
    for c, q, (fh, fv) in zip(coefficients, head["quant"], head["factors"]):
        rows, cols, _ = c.shape
        x = (c.reshape(-1, 64) * q).astype(np.float64) @ _inverse() + 128
        x = np.clip(np.rint(x), 0, 255).reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)
        planes.append(x.repeat(vm // fv, 0).repeat(hm // fh, 1)[:h, :w])
    if len(planes) == 1:
        planes = [planes[0], np.full((h, w), 128.0), np.full((h, w), 128.0)]
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


# ---- encoding


def _marker(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body


def _packed(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    return np.packbits(np.r_[bits, np.ones(pad, np.uint8)]).tobytes().replace(b"\xff", b"\xff\x00")


def _numbers(x: np.ndarray, width: int) -> np.ndarray:
    return (x.ravel()[:, None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8).ravel()


@lru_cache(maxsize=1)
def _head_tables() -> tuple[bytes, np.ndarray, np.ndarray]:
    tables = _marker(DQT, b"\0" + bytes([1] * 64)) + _marker(DHT, b"\0" + DC_SPEC + b"\x10" + AC_SPEC + b"\x11" + RUN_SPEC)
    return tables, _patterns(DC_SPEC, -255, 255), _patterns(AC_SPEC, -127, 127).astype(np.uint8)


def encode(y: np.ndarray, cb: np.ndarray, cr: np.ndarray, comment: bytes = b"") -> bytes:
    """A 4:2:0 progressive file of given zigzag coefficients, all of magnitude 2 to 129; y has (2r, 2c, 64), the others
    (r, c, 64). Two spectral bands at half precision, then one refinement."""
    rows, cols, _ = cb.shape
    tables, dc_codes, ac_codes = _head_tables()
    factors = ((2, 2), (1, 1), (1, 1))
    flat = [x.reshape(-1, 64) for x in (y, cb, cr)]
    units = _interleaved(cols, rows, factors)
    dc = [x[u.ravel(), 0] for x, u in zip(flat, units)]
    out = [b"\xff\xd8", _marker(COM, comment), tables]
    out.append(_marker(SOF2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    diffs = [np.diff(d >> 1, prepend=0).reshape(u.shape) for d, u in zip(dc, units)]
    out += [_marker(SOS, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 1])), _packed(_numbers(dc_codes[np.concatenate(diffs, 1) + 255], 9))]
    half = [ac_codes[(np.sign(x) * (np.abs(x) >> 1)) + 127] for x in flat]
    for ss, se in ((1, 5), (6, 63)):
        for i, x in enumerate(half):
            out += [_marker(SOS, bytes([1, i + 1, 0, ss, se, 1])), x[:, ss : se + 1].tobytes().replace(b"\xff", b"\xff\x00")]
    low = [(d & 1).reshape(u.shape) for d, u in zip(dc, units)]
    out += [_marker(SOS, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0x10])), _packed(np.concatenate(low, 1).astype(np.uint8).ravel())]
    for i, x in enumerate(flat):
        bits, odd = [], (np.abs(x[:, 1:]) & 1).astype(np.uint8)
        for at in range(0, len(x), 32767):
            part = odd[at : at + 32767]
            n = len(part).bit_length() - 1
            bits += [_numbers(np.array([n]), 4), _numbers(np.array([len(part) - (1 << n)]), n), part.ravel()]
        out += [_marker(SOS, bytes([1, i + 1, 1, 1, 63, 0x10])), _packed(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])
