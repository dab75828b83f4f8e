"""JPEG in numpy: a decoder of progressive and sequential Huffman streams, and a progressive encoder for fixtures.

The decoder accumulates every scan - spectral selection and successive approximation - into arrays of quantised
coefficients, one per component; only then are blocks dequantised and inverse-transformed, some rows of MCUs in one matrix
product, and chroma is brought to full resolution by repeating samples.  Beside the coefficients (4 bytes each, and only those that a scan reaches) and the
tensor itself, memory follows the width of an image.
"""

from __future__ import annotations

import functools
import re

import numpy as np

ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
_x = np.arange(8)
#: DCT[u, x]: basis u at sample x.
DCT = np.cos((2 * _x + 1) * _x[:, None] * np.pi / 16) / 2
DCT[0] /= np.sqrt(2)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


#: Pixels of the largest tensor that fits a binary value of Spark (2 GB).
MOST_PIXELS = (2**31 - 1) // 3


class BadJpeg(ValueError):
    """A stream that isn't a JPEG, or of a kind that isn't supported."""


@functools.lru_cache(256)
def lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits the length (above 8 bits) and symbol of the code that they begin with; 0 where there is none."""
    out, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            if code >> length:
                raise BadJpeg("Huffman codes run over")
            out[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out.tolist()


class _Bits:
    """Bits of one entropy-coded segment; past its end they are 0."""

    __slots__ = ("data", "at", "held", "n")

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def ended(self, short: int = 0) -> bool:
        """Whether more bits were taken than there are, less `short`."""
        return 8 * self.at - self.n > 8 * len(self.data) - short

    def _fill(self) -> None:
        more = self.data[self.at : self.at + 6]
        self.at += 6
        self.held = (self.held & (1 << self.n) - 1) << 48 | int.from_bytes(more, "big") << 8 * (6 - len(more))
        self.n += 48

    def take(self, k: int) -> int:
        if self.n < k:
            self._fill()
        self.n -= k
        return self.held >> self.n & (1 << k) - 1

    def symbol(self, table: list[int]) -> int:
        if self.n < 16:
            self._fill()
        e = table[self.held >> self.n - 16 & 0xFFFF]
        if not e:
            raise BadJpeg("no such Huffman code")
        self.n -= e >> 8
        return e & 255

    def value(self, k: int) -> int:
        v = self.take(k)
        return v if v >> k - 1 else v - (1 << k) + 1


class _Component:
    def __init__(self, ident: int, h: int, v: int, quant: int):
        self.id, self.h, self.v, self.quant, self.dc, self.ac, self.pred = ident, h, v, quant, 0, 0, 0


def _sequential(bits: _Bits, c: _Component, at: int, dc: list[int], ac: list[int]) -> None:
    coef = c.coef
    if t := bits.symbol(dc):
        c.pred += bits.value(t)
    coef[at] = c.pred
    k = 1
    while k < 64:
        rs = bits.symbol(ac)
        s = rs & 15
        if not s:
            if rs >> 4 < 15:
                break
            k += 16
            continue
        k += rs >> 4
        if k > 63:
            raise BadJpeg("coefficients run over")
        coef[at + k] = bits.value(s)
        k += 1


def _ac_first(bits: _Bits, coef: list[int], at: int, lo: int, hi: int, shift: int, table: list[int], run: int) -> int:
    if run:
        return run - 1
    k = lo
    while k <= hi:
        rs = bits.symbol(table)
        r, s = rs >> 4, rs & 15
        if not s:
            if r < 15:
                return (1 << r) - 1 + (bits.take(r) if r else 0)
            k += 16
            continue
        k += r
        if k > 63:
            raise BadJpeg("coefficients run over")
        coef[at + k] = bits.value(s) * (1 << shift)
        k += 1
    return 0


def _ac_refine(bits: _Bits, coef: list[int], at: int, lo: int, hi: int, shift: int, table: list[int], run: int) -> int:
    one, k = 1 << shift, lo
    if not run:
        while k <= hi:
            rs = bits.symbol(table)
            r, new = rs >> 4, 0
            if rs & 15:
                new = one if bits.take(1) else -one
            elif r < 15:
                run = (1 << r) + (bits.take(r) if r else 0)
                break
            while k <= hi:
                c = coef[at + k]
                if c:
                    if bits.take(1) and not abs(c) & one:
                        coef[at + k] = c + one if c > 0 else c - one
                elif r:
                    r -= 1
                else:
                    if new:
                        coef[at + k] = new
                    k += 1
                    break
                k += 1
    if run:
        while k <= hi:
            c = coef[at + k]
            if c and bits.take(1) and not abs(c) & one:
                coef[at + k] = c + one if c > 0 else c - one
            k += 1
        run -= 1
    return run


class Decoder:
    def __init__(self, data: bytes, most_pixels: int = MOST_PIXELS):
        self.data, self.most_pixels, self.quant, self.tables, self.comps = data, most_pixels, {}, {}, []
        self.interval, self.progressive, self.adobe, self.scanned = 0, False, None, False
        if data[:2] != b"\xff\xd8":
            raise BadJpeg("no start of image")
        at = 2
        while at + 4 <= len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            kind = data[at + 1]
            if kind in (0xFF, 0x00, 0x01) or 0xD0 <= kind <= 0xD8:
                at += 1 if kind == 0xFF else 2
                continue
            if kind == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if at + 2 + size > len(data):
                break  # cut short
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xDB:
                self._quant(body)
            elif kind == 0xC4:
                self._huffman(body)
            elif kind in (0xC0, 0xC1, 0xC2):
                self._frame(body, kind == 0xC2)
            elif 0xC3 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise BadJpeg("arithmetic, lossless and hierarchical streams aren't supported")
            elif kind == 0xDD:
                self.interval = int.from_bytes(body[:2], "big")
            elif kind == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.adobe = body[11]
            elif kind == 0xDA:
                end = at
                while (end := data.find(b"\xff", end)) >= 0 and end + 1 < len(data) and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                    end += 2
                end = len(data) if end < 0 else end
                self._scan(body, data[at:end])
                self.scanned = True
                at = end
        if not self.scanned:
            raise BadJpeg("no scan")

    def _quant(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, n = body[at] >> 4, body[at] & 15
            raw = np.frombuffer(body[at + 1 : at + 65 + 64 * wide], ">u2" if wide else np.uint8)
            if len(raw) < 64:
                raise BadJpeg("short quantisation table")
            self.quant[n], at = raw.astype(np.float64), at + 65 + 64 * wide

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at + 17 <= len(body):
            counts = body[at + 1 : at + 17]
            symbols = body[at + 17 : at + 17 + sum(counts)]
            if len(symbols) < sum(counts):
                raise BadJpeg("short Huffman table")
            self.tables[body[at]], at = lookup(counts, symbols), at + 17 + sum(counts)

    def _frame(self, body: bytes, progressive: bool) -> None:
        if self.comps or len(body) < 6 or body[0] != 8 or len(body) < 6 + 3 * body[5]:
            raise BadJpeg("a frame that isn't supported")
        self.progressive, self.height, self.width = progressive, int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        comps = [_Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        if not self.height or not self.width or len(comps) not in (1, 3) or any(not 1 <= c.h <= 4 or not 1 <= c.v <= 4 for c in comps):
            raise BadJpeg("a frame that isn't supported")
        self.h, self.v = max(c.h for c in comps), max(c.v for c in comps)
        self.mcus_x, self.mcus_y = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        if self.height * self.width > self.most_pixels:
            raise BadJpeg("a frame of too many pixels")
        for c in comps:
            c.width, c.height = -(-self.width * c.h // self.h), -(-self.height * c.v // self.v)
            c.stride, c.rows = self.mcus_x * c.h, self.mcus_y * c.v
            c.coef = memoryview(np.zeros(c.stride * c.rows * 64, np.int32))  # takes memory only where a scan writes
        self.comps = comps

    def _blocks(self, comps: list[_Component]):
        """(component, offset of the block's coefficients) of each MCU of a scan."""
        if len(comps) == 1:
            c = comps[0]
            for y in range(-(-c.height // 8)):
                for x in range(-(-c.width // 8)):
                    yield [(c, 64 * (y * c.stride + x))]
        else:
            for y in range(self.mcus_y):
                for x in range(self.mcus_x):
                    yield [(c, 64 * ((y * c.v + j) * c.stride + x * c.h + i)) for c in comps for j in range(c.v) for i in range(c.h)]

    def _scan(self, body: bytes, raw: bytes) -> None:
        n = body[0] if body else 0
        if not self.comps or len(body) < 4 + 2 * n or not 1 <= n <= len(self.comps):
            raise BadJpeg("a scan without a frame")
        by_id, comps = {c.id: c for c in self.comps}, []
        for i in range(n):
            c = by_id.get(body[1 + 2 * i])
            if c is None:
                raise BadJpeg("a scan of no component")
            c.dc, c.ac = self.tables.get(body[2 + 2 * i] >> 4), self.tables.get(body[2 + 2 * i] & 15 | 16)
            comps.append(c)
        lo, hi, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if self.progressive and (hi > 63 or lo > hi or (lo and n > 1)):
            raise BadJpeg("a scan that isn't supported")
        if not self.progressive and any(c.dc is None or c.ac is None for c in comps) or self.progressive and (comps[0].ac is None if lo else not high and any(c.dc is None for c in comps)):
            raise BadJpeg("a scan without a Huffman table")
        segments = iter(_RESTART.split(raw))
        bits, run, spent = _Bits(b""), 0, False
        for i, mcu in enumerate(self._blocks(comps)):
            if i == 0 or self.interval and i % self.interval == 0:
                segment = next(segments, None)
                if segment is None:
                    return
                bits, run, spent = _Bits(segment.replace(b"\xff\x00", b"\xff")), 0, False
                for c in comps:
                    c.pred = 0
            elif spent or not run and bits.ended():
                if not self.interval:
                    return
                continue  # the next segment may be whole
            try:
                for c, at in mcu:
                    if not self.progressive:
                        _sequential(bits, c, at, c.dc, c.ac)
                    elif lo:
                        run = (_ac_refine if high else _ac_first)(bits, c.coef, at, lo, hi, low, c.ac, run)
                    elif high:
                        if bits.take(1):
                            c.coef[at] |= 1 << low
                    else:
                        if t := bits.symbol(c.dc):
                            c.pred += bits.value(t)
                        c.coef[at] = c.pred * (1 << low)
            except BadJpeg:
                if not bits.ended(16):  # what is left may be padding, or the beginning of a code
                    raise
                spent, run = True, 0

    def coefficients(self) -> list[np.ndarray]:
        """Quantised coefficients of each component: rows of blocks, blocks, 64 in zigzag order."""
        return [np.asarray(c.coef).reshape(c.rows, c.stride, 64) for c in self.comps]

    def rgb(self) -> np.ndarray:
        """height x width x 3 bytes, some rows of MCUs at a time."""
        if any(c.quant not in self.quant for c in self.comps):
            raise BadJpeg("no quantisation table")
        out, coefs = np.empty((self.height, self.width, 3), np.uint8), self.coefficients()
        n = max(1, (1 << 16) // (8 * self.v * self.width))
        for y0 in range(0, self.height, 8 * self.v * n):
            rows = np.arange(y0, min(y0 + 8 * self.v * n, self.height))
            planes = []
            for c, coef in zip(self.comps, coefs, strict=True):
                first = y0 // (8 * self.v) * c.v
                strip = coef[first : first + c.v * n]
                natural = np.zeros(strip.shape)
                natural[:, :, ZIGZAG] = strip * self.quant[c.quant]
                blocks = DCT.T @ natural.reshape(*strip.shape[:2], 8, 8) @ DCT
                plane = np.clip(np.rint(blocks.transpose(0, 2, 1, 3).reshape(-1, c.stride * 8) + 128), 0, 255)
                planes.append(plane[(rows * c.v // self.v - 8 * first)[:, None], np.arange(self.width) * c.h // self.h])
            out[rows] = self._colours(planes)
        return out

    def _colours(self, planes: list[np.ndarray]) -> np.ndarray:
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, 2)
        if self.adobe == 0:
            return np.stack(planes, 2)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb], 2)), 0, 255)


def decode(data: bytes, most_pixels: int = MOST_PIXELS) -> np.ndarray:
    """RGB tensor (height, width, 3) of a JPEG; BadJpeg where it can't be decoded or has more than most_pixels."""
    try:
        return Decoder(data, most_pixels).rgb()
    except (IndexError, TypeError, ValueError, MemoryError) as e:
        raise BadJpeg("a broken stream") from e


# --- a progressive encoder, for fixtures and for columns of test media ---

#: Scans: components, first and last coefficient, bits known before, bits left out.
SCRIPT = [("012", 0, 0, 0, 1), ("0", 1, 5, 0, 2), ("2", 1, 63, 0, 1), ("1", 1, 63, 0, 1), ("0", 6, 63, 0, 2), ("0", 1, 63, 2, 1), ("012", 0, 0, 1, 0), ("2", 1, 63, 1, 0), ("1", 1, 63, 1, 0), ("0", 1, 63, 1, 0)]
_COUNTS = bytes([0] * 7 + [128, 128] + [0] * 7)
_CODES = [(c, 8) for c in range(128)] + [(256 + c, 9) for c in range(128)]


class _Writer:
    def __init__(self):
        self.held, self.n, self.run, self.pending = 0, 0, 0, []

    def put(self, value: int, bits: int) -> None:
        self.held, self.n = self.held << bits | value, self.n + bits

    def symbol(self, s: int) -> None:
        self.put(*_CODES[s])

    def number(self, v: int, size: int) -> None:
        self.put(v if v >= 0 else v + (1 << size) - 1, size)

    def end_run(self) -> None:
        if self.run:
            size = self.run.bit_length() - 1
            self.symbol(size << 4)
            self.put(self.run & (1 << size) - 1, size)
            self.run = 0
        for b in self.pending:
            self.put(b, 1)
        self.pending = []

    def done(self) -> bytes:
        self.end_run()
        pad = -self.n % 8
        return (self.held << pad | (1 << pad) - 1).to_bytes((self.n + pad) // 8, "big").replace(b"\xff", b"\xff\x00")


def _put_first(w: _Writer, block: list[int], lo: int, hi: int) -> None:
    r = 0
    for k in range(lo, hi + 1):
        v = block[k]
        if not v:
            r += 1
            continue
        w.end_run()
        while r > 15:
            w.symbol(0xF0)
            r -= 16
        size = abs(v).bit_length()
        w.symbol(r << 4 | size)
        w.number(v, size)
        r = 0
    if r:
        w.run += 1
        if w.run == 0x7FFF:
            w.end_run()


def _put_refine(w: _Writer, block: list[int], lo: int, hi: int) -> None:
    last, r, corrections = max([k for k in range(lo, hi + 1) if abs(block[k]) == 1], default=-1), 0, []
    for k in range(lo, hi + 1):
        v = abs(block[k])
        if not v:
            r += 1
            continue
        while r > 15 and k <= last:
            w.end_run()
            w.symbol(0xF0)
            r -= 16
            for b in corrections:
                w.put(b, 1)
            corrections = []
        if v > 1:
            corrections.append(v & 1)
            continue
        w.end_run()
        w.symbol(r << 4 | 1)
        w.put(int(block[k] > 0), 1)
        for b in corrections:
            w.put(b, 1)
        corrections, r = [], 0
    if r or corrections:
        w.run += 1
        w.pending += corrections
        if w.run == 0x7FFF or len(w.pending) > 900:
            w.end_run()


def quantised(rgb: np.ndarray, quant: np.ndarray, sub: int = 2) -> list[np.ndarray]:
    """Quantised coefficients of Y, Cb and Cr planes, chroma averaged over sub x sub samples; shaped as Decoder.coefficients gives them."""
    x = rgb.astype(float)
    y = x @ [0.299, 0.587, 0.114]
    planes = [y, (x[:, :, 2] - y) / 1.772 + 128, (x[:, :, 0] - y) / 1.402 + 128]
    mcu, out = 8 * sub, []
    for i, plane in enumerate(planes):
        plane = np.pad(plane, ((0, -plane.shape[0] % mcu), (0, -plane.shape[1] % mcu)), "edge")
        if i:
            plane = plane.reshape(plane.shape[0] // sub, sub, plane.shape[1] // sub, sub).mean((1, 3))
        blocks = (plane - 128).reshape(plane.shape[0] // 8, 8, plane.shape[1] // 8, 8).transpose(0, 2, 1, 3)
        out.append(np.rint((DCT @ blocks @ DCT.T).reshape(*blocks.shape[:2], 64)[:, :, ZIGZAG] / quant).astype(np.int64))
    return out


def encode(rgb: np.ndarray, quant: np.ndarray | None = None, sub: int = 2, script: list[tuple] = SCRIPT, interval: int = 0) -> bytes:
    """A progressive JPEG of an RGB tensor; each scan ends, every `interval` MCUs if that isn't 0, in a restart marker."""
    quant = np.full(64, 4) if quant is None else quant
    height, width = rgb.shape[:2]
    coefs = quantised(rgb, quant, sub)
    seg = lambda kind, body: bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body
    out = [b"\xff\xd8", seg(0xDB, b"\0" + bytes(quant.astype(np.uint8)))]
    frame = b"".join(bytes([i + 1, (sub << 4 | sub) if i == 0 else 0x11, 0]) for i in range(3))
    out.append(seg(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3]) + frame))
    table = _COUNTS + bytes(range(256))
    out += [seg(0xC4, b"\x00" + table), seg(0xC4, b"\x10" + table)]
    if interval:
        out.append(seg(0xDD, interval.to_bytes(2, "big")))
    size = [(-(-height // 8), -(-width // 8))] + [(-(-height // (8 * sub)), -(-width // (8 * sub)))] * 2
    for names, lo, hi, high, low in script:
        comps = [int(c) for c in names]
        out.append(seg(0xDA, bytes([len(comps), *(b for c in comps for b in (c + 1, 0)), lo, hi, high << 4 | low])))
        if len(comps) > 1:
            mcus = [[(c, y * (sub if c == 0 else 1) + j, x * (sub if c == 0 else 1) + i) for c in comps for j in range(sub if c == 0 else 1) for i in range(sub if c == 0 else 1)] for y in range(coefs[1].shape[0]) for x in range(coefs[1].shape[1])]
        else:
            mcus = [[(comps[0], y, x)] for y in range(size[comps[0]][0]) for x in range(size[comps[0]][1])]
        shifted = {c: (coefs[c] >> low if lo == 0 else np.sign(coefs[c]) * (np.abs(coefs[c]) >> low)).tolist() for c in comps}
        w, pred, marker = _Writer(), dict.fromkeys(comps, 0), 0
        for n, mcu in enumerate(mcus):
            if interval and n and n % interval == 0:
                out += [w.done(), bytes([0xFF, 0xD0 + marker % 8])]
                w, pred, marker = _Writer(), dict.fromkeys(comps, 0), marker + 1
            for c, y, x in mcu:
                block = shifted[c][y][x]
                if lo:
                    (_put_refine if high else _put_first)(w, block, lo, hi)
                elif high:
                    w.put(block[0] & 1, 1)
                else:
                    d, pred[c] = block[0] - pred[c], block[0]
                    w.symbol(abs(d).bit_length())
                    w.number(d, abs(d).bit_length())
        out.append(w.done())
    return b"".join([*out, b"\xff\xd9"])
