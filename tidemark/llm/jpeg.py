"""Progressive JPEG in numpy: a coder from coefficients to scans, and a decoder from scans to RGB.

Both work on a batch of images at once. A restart interval is a segment with no state from before
it, so the decoder moves through all segments of a kind in step: each step takes one symbol (or one
coefficient) of every segment. Scans accumulate into one coefficient array: spectral selection fills
ranges of coefficients, successive approximation adds one bit to what earlier scans left.

The decoder takes any progressive file with 8-bit samples, any tables, restart intervals (or none)
and sampling factors that divide the largest; the coder writes one layout (4:2:0, a restart interval of one unit).
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from dataclasses import dataclass, field
from functools import cache

import numpy as np


@cache
def zigzag() -> np.ndarray:
    """Natural index (8 * row + column) of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


_SCALE = 13


@cache
def inverse_matrix() -> np.ndarray:
    """From zigzag coefficients to samples, in integers times 2**_SCALE: sums stay exact in any order."""
    u = np.arange(8)
    basis = np.where(u == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16)
    full = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return np.rint(full[zigzag()] * (1 << _SCALE))


# ---- Huffman tables ----


@dataclass(frozen=True)
class Table:
    """Codes by symbol, and by the next 16 bits: length * 256 + symbol (0: no code)."""

    code: np.ndarray
    length: np.ndarray
    lookup: np.ndarray


@cache
def table_of(counts: bytes, symbols: bytes) -> Table:
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    lookup = np.zeros(1 << 16, np.uint16)
    value = at = 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            s = symbols[at]
            code[s], length[s] = value, bits
            lookup[value << (16 - bits) : (value + 1) << (16 - bits)] = bits * 256 + s
            value += 1
            at += 1
        value <<= 1
    return Table(code, length, lookup)


def _spec(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(v == b for v in lengths.values()) for b in range(1, 17)), bytes(symbols)


def _ac_lengths() -> dict[int, int]:
    """Short codes for short runs of zeros; a rule in place of a tuned table."""
    out = {0x00: 3, 0xF0: 8}
    for run in range(16):
        for size in range(1, 11):
            out[16 * run + size] = 4 if run == 0 and size <= 8 else 6 if run == 1 and size <= 8 else 10
        if 0 < run < 15:
            out[16 * run] = 10
    return out


DC_SPEC = _spec({s: 4 for s in range(12)})
AC_SPEC = _spec(_ac_lengths())
_SIZE = np.array([int(v).bit_length() for v in range(4096)], dtype=np.int64)


# ---- coder ----


@cache
def unit_order(wide: int, high: int) -> np.ndarray:
    """Of each block in unit order (four Y, Cb, Cr): its place among Y rows, Cb rows, Cr rows."""
    m = wide * high
    r, c = np.divmod(np.arange(m), wide)
    y = [(2 * r + (s >> 1)) * 2 * wide + 2 * c + (s & 1) for s in range(4)]
    return np.stack([*y, 4 * m + np.arange(m), 5 * m + np.arange(m)], axis=1).reshape(-1)


def _pack(seg: np.ndarray, n_seg: int, value: np.ndarray, bits: np.ndarray, where: np.ndarray, seg_bits: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all segments, each with stuffing and a restart marker, and where each ends.

    ``where`` is the bit of a value within its segment; ``order`` the number of a segment in its scan.
    """
    seg_bytes = (seg_bits + 7) // 8
    start = np.concatenate([[0], np.cumsum(seg_bytes)])
    pad = seg_bytes * 8 - seg_bits
    value = np.concatenate([value, (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1)])
    bits = np.concatenate([bits, pad])
    at = np.concatenate([start[seg] * 8 + where, start[:-1] * 8 + seg_bits])
    word, off = at >> 5, at & 31
    wide = value << (64 - off - bits).astype(np.uint64)
    n = int(start[-1]) // 4 + 2
    sums = np.bincount(word, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=n)
    sums[1:] += np.bincount(word, weights=(wide & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)[: len(sums) - 1]
    raw = sums.astype(np.uint32).astype(">u4").view(np.uint8)[: int(start[-1])]
    # a zero byte after each 0xFF, and two bytes of marker after each segment
    full = raw == 255
    extra = np.concatenate([[0], np.cumsum(full)])
    seg_of = np.repeat(np.arange(n_seg), seg_bytes)
    place = np.arange(len(raw)) + extra[:-1] + 2 * seg_of
    ends = start[1:] + extra[start[1:]] + 2 * np.arange(1, n_seg + 1)
    out = np.zeros(int(ends[-1]) if n_seg else 0, dtype=np.uint8)
    out[place] = raw
    out[ends - 2] = 255
    out[ends - 1] = 0xD0 + order % 8
    return out, ends


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = _SIZE[np.abs(v)]
    return np.where(v >= 0, v, v + (1 << size) - 1).astype(np.uint64), size


def _ac_first(blocks: np.ndarray, lo: int, hi: int, al: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    table, n, width = table_of(*AC_SPEC), len(blocks), hi - lo + 1
    v = np.ascontiguousarray(blocks[:, lo : hi + 1]).reshape(-1)
    if al:
        v = np.where(v >= 0, v >> al, -((-v) >> al))
    at = np.flatnonzero(v)
    row = at // width
    k = at - row * width
    v = v[at].astype(np.int64)
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    run = k - np.where(first, -1, np.concatenate([[0], k[:-1]])) - 1
    extra, size = _magnitude(v)
    zrl, sym = run >> 4, (run & 15) * 16 + size
    bits = table.length[sym] + size
    whole = bits + zrl * table.length[0xF0]
    cum = np.cumsum(whole)
    row_bits = np.bincount(row, weights=whole, minlength=n).astype(np.int64)
    row_start = np.concatenate([[0], np.cumsum(row_bits)])[:-1]
    where = cum - bits - row_start[row]
    value = (table.code[sym] << size.astype(np.uint64)) | extra
    last = np.full(n, -1)
    last[row] = k
    eob = np.flatnonzero(last < hi - lo)
    segs, values, lens, places = [row, eob], [value, np.full(len(eob), table.code[0])], [bits, np.full(len(eob), table.length[0])], [where, row_bits[eob]]
    row_bits[eob] += table.length[0]
    many = np.flatnonzero(zrl)
    if len(many):
        rep = np.repeat(many, zrl[many])
        nth = np.arange(len(rep)) - np.repeat(np.cumsum(zrl[many]) - zrl[many], zrl[many])
        segs.append(row[rep])
        values.append(np.full(len(rep), table.code[0xF0]))
        lens.append(np.full(len(rep), table.length[0xF0]))
        places.append(where[rep] - (zrl[rep] - nth) * table.length[0xF0])
    return _pack(np.concatenate(segs), n, np.concatenate(values), np.concatenate(lens), np.concatenate(places), row_bits, order)


def _ac_refine(blocks: np.ndarray, lo: int, hi: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last bit of coefficients ``lo`` to ``hi`` (fewer than 16 of them)."""
    table, n = table_of(*AC_SPEC), len(blocks)
    v = blocks[:, lo : hi + 1].astype(np.int64)
    mag = np.abs(v)
    pos, run, held, held_bits = (np.zeros(n, np.int64) for _ in range(4))
    segs, values, lens, places = [], [], [], []

    def emit(rows: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        segs.append(rows)
        values.append(value.astype(np.uint64))
        lens.append(bits)
        places.append(pos[rows].copy())
        pos[rows] += bits

    for k in range(hi - lo + 1):
        m = mag[:, k]
        old, new = m > 1, np.flatnonzero(m == 1)
        held = np.where(old, held * 2 + (m & 1), held)
        held_bits += old
        run += m == 0
        sym = run[new] * 16 + 1
        value = ((table.code[sym].astype(np.int64) * 2 + (v[new, k] > 0)) << held_bits[new]) | held[new]
        emit(new, value, table.length[sym] + 1 + held_bits[new])
        run[new] = held[new] = held_bits[new] = 0
    rest = np.flatnonzero((run > 0) | (held_bits > 0))
    emit(rest, (int(table.code[0]) << held_bits[rest]) | held[rest], table.length[0] + held_bits[rest])
    return _pack(np.concatenate(segs), n, np.concatenate(values), np.concatenate(lens), np.concatenate(places), pos, order)


def _dc(units: np.ndarray, refine: bool, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """DC values of units (n, 6): their high bits as differences, or their last bits."""
    table, n = table_of(*DC_SPEC), len(units)
    if refine:
        value, bits = (units & 1).astype(np.uint64), np.ones((n, 6), np.int64)
    else:
        v = units.astype(np.int64) >> 1
        v[:, 1:4] -= v[:, 0:3].copy()
        extra, size = _magnitude(v)
        value, bits = (table.code[size] << size.astype(np.uint64)) | extra, table.length[size] + size
    cum = np.cumsum(bits, axis=1)
    return _pack(np.repeat(np.arange(n), 6), n, value.reshape(-1), bits.reshape(-1), (cum - bits).reshape(-1), cum[:, -1], order)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


_SPLIT = 8  # Y coefficients up to here come in two approximations


def encode(units: list[np.ndarray], dims: list[tuple[int, int]], notes: list[bytes]) -> list[bytes]:
    """Files of images whose blocks (n * 6, 64, zigzag) are given in unit order; a note goes in each."""
    m = np.array([w * h for w, h in dims])
    planes = [np.empty_like(u) for u in units]
    for p, u, (w, h) in zip(planes, units, dims, strict=True):
        p[unit_order(w, h)] = u
    y = np.concatenate([p[: 4 * k] for p, k in zip(planes, m, strict=True)])
    cb = np.concatenate([p[4 * k : 5 * k] for p, k in zip(planes, m, strict=True)])
    cr = np.concatenate([p[5 * k :] for p, k in zip(planes, m, strict=True)])
    dc = np.concatenate(units)[:, 0].reshape(-1, 6)
    upto = np.concatenate([[0], np.cumsum(m)])
    one = np.arange(upto[-1]) - np.repeat(upto[:-1], m)
    four = np.arange(4 * upto[-1]) - np.repeat(4 * upto[:-1], 4 * m)
    all3, only = bytes([3, 1, 0, 2, 0, 3, 0]), lambda c: bytes([1, c, 0])
    scans = [
        (all3 + bytes([0, 0, 0x01]), _dc(dc, False, one), 1),
        (only(1) + bytes([1, _SPLIT, 0x01]), _ac_first(y, 1, _SPLIT, 1, four), 4),
        (only(2) + bytes([1, 63, 0x00]), _ac_first(cb, 1, 63, 0, one), 1),
        (only(3) + bytes([1, 63, 0x00]), _ac_first(cr, 1, 63, 0, one), 1),
        (only(1) + bytes([_SPLIT + 1, 63, 0x00]), _ac_first(y, _SPLIT + 1, 63, 0, four), 4),
        (only(1) + bytes([1, _SPLIT, 0x10]), _ac_refine(y, 1, _SPLIT, four), 4),
        (all3 + bytes([0, 0, 0x10]), _dc(dc, True, one), 1),
    ]
    heads = [_segment(0xDA, head) for head, _, _ in scans]
    cuts = [np.concatenate([[0], ends])[upto * per].tolist() for _, (_, ends), per in scans]
    data = [raw.tobytes() for _, (raw, _), _ in scans]
    tables = _segment(0xDB, bytes([0]) + bytes([1]) * 64) + _segment(0xC4, bytes([0x00]) + DC_SPEC[0] + DC_SPEC[1] + bytes([0x10]) + AC_SPEC[0] + AC_SPEC[1]) + _segment(0xDD, struct.pack(">H", 1))
    out = []
    for i, ((w, h), note) in enumerate(zip(dims, notes, strict=True)):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        parts = [b"\xff\xd8", _segment(0xFE, note), tables, frame]
        for head, cut, raw in zip(heads, cuts, data, strict=True):
            parts += [head, raw[cut[i] : cut[i + 1] - 2]]  # no restart marker after the last segment
        out.append(b"".join(parts) + b"\xff\xd9")
    return out


# ---- decoder ----


@dataclass
class Image:
    """What the headers of a file say, and where its blocks stand in the batch's coefficient array."""

    note: bytes = b""
    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # component id, h, v, quantiser
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    grids: list[tuple[int, int, int]] = field(default_factory=list)  # first block, rows and columns of blocks (padded)


@cache
def _raster(rows: int, cols: int, wide: int) -> np.ndarray:
    return (np.arange(rows)[:, None] * wide + np.arange(cols)[None, :]).reshape(-1)


@cache
def _interleaved(shapes: tuple[tuple[int, int, int, int], ...], down: int, across: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each unit, and the component of each block in a unit. shapes: first block, columns, h, v."""
    cols, parts = [], []
    r, c = np.divmod(np.arange(down * across), across)
    for i, (first, wide, h, v) in enumerate(shapes):
        for dy in range(v):
            for dx in range(h):
                cols.append(first + (r * v + dy) * wide + c * h + dx)
                parts.append(i)
    return np.stack(cols, axis=1).reshape(-1), np.array(parts)


_ALONE = np.zeros(1, dtype=np.int64)


class _Bits:
    """The entropy-coded bytes of a batch, without stuffing, and a reader at many places at once."""

    def __init__(self, raw: np.ndarray, upto: np.ndarray):
        self.raw = np.concatenate([raw, np.zeros(16, np.uint8)])
        self.words = np.ndarray((len(self.raw) - 7,), dtype=">u8", buffer=self.raw.data, strides=(1,))
        self.limit = len(raw)

    def window(self, pos: np.ndarray) -> np.ndarray:
        w = self.words[np.minimum(pos >> 3, self.limit)].astype(np.uint64)
        return w << (pos & 7).astype(np.uint64)


def _take(window: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The first ``bits`` bits of a window; 0 bits give 0."""
    return ((window >> np.uint64(1)) >> (63 - bits).astype(np.uint64)).astype(np.int64)


def _extend(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (v < (1 << np.maximum(size - 1, 0))), v - (1 << size) + 1, v)


@dataclass
class _Group:
    """The scans of one kind; ``scans`` has what holds for a whole scan, ``gather`` lists its segments."""

    #: first byte, first of its restart markers, segments, blocks a segment, approximation, and for AC: range and table
    scans: list[tuple[int, ...]] = field(default_factory=list)
    layouts: list[np.ndarray] = field(default_factory=list)
    shifts: list[int] = field(default_factory=list)  # first block of the scan's image or component
    units: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # DC: component and table by block of a unit

    def gather(self, restarts: np.ndarray, removed: np.ndarray) -> tuple[np.ndarray, ...]:
        """By segment: first bit, first entry in the list of blocks, number of blocks; the list of blocks; its scan's row."""
        rows = np.array(self.scans)
        lens = np.array([len(x) for x in self.layouts])
        blocks = np.concatenate(self.layouts) + np.repeat(self.shifts, lens)
        scan = np.repeat(np.arange(len(rows)), rows[:, 2])
        nth = np.arange(len(scan)) - np.repeat(np.cumsum(rows[:, 2]) - rows[:, 2], rows[:, 2])
        begins = rows[scan, 0]
        later = nth > 0
        begins[later] = restarts[rows[scan[later], 1] + nth[later] - 1] + 2
        firsts = nth * rows[scan, 3]
        return (begins - removed[begins]) * 8, (np.cumsum(lens) - lens)[scan] + firsts, np.minimum(rows[scan, 3], lens[scan] - firsts), blocks, scan, rows


def decode(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Headers, and the accumulated coefficients of all images (blocks, 64) in zigzag order."""
    joined = np.frombuffer(b"".join(files) + b"\0\0", dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in files])])
    flags = np.flatnonzero(joined[:-1] == 255)
    after = joined[flags + 1]
    stuffed = flags[after == 0]
    drop = np.zeros(len(joined), bool)
    drop[stuffed + 1] = True
    removed = np.concatenate([[0], np.cumsum(drop)])
    bits = _Bits(joined[~drop], removed)
    restarts = flags[(after >= 0xD0) & (after <= 0xD7)]
    markers = flags[(after >= 0xC0) & ~((after >= 0xD0) & (after <= 0xD7))]
    restart_list, marker_list = restarts.tolist(), markers.tolist()
    groups = {kind: _Group() for kind in ("dc first", "dc refine", "ac first", "ac refine")}
    lookups: list[np.ndarray] = []
    known: dict[int, int] = {}
    images, total = [], 0
    for i, data in enumerate(files):
        image, at, start = Image(), 2, int(offsets[i])
        tables: dict[int, int] = {}
        interval = 0
        while True:
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                image.note = body
            elif marker == 0xDB:
                while body:
                    step = 129 if body[0] >> 4 else 65
                    image.quant[body[0] & 15] = np.frombuffer(body[1:step], ">u2" if step == 129 else np.uint8).astype(np.int64)
                    body = body[step:]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    table = table_of(body[1:17], body[17 : 17 + n])
                    if id(table) not in known:
                        known[id(table)] = len(lookups)
                        lookups.append(table.lookup)
                    tables[body[0]] = known[id(table)]
                    body = body[17 + n :]
            elif marker == 0xDD:
                interval = int.from_bytes(body, "big")
            elif marker == 0xC2:
                _, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
                image.parts = [(body[6 + 3 * j], body[7 + 3 * j] >> 4, body[7 + 3 * j] & 15, body[8 + 3 * j]) for j in range(n)]
                hm, vm = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
                across, down = -(-image.width // (8 * hm)), -(-image.height // (8 * vm))
                for _, h, v, _ in image.parts:
                    image.grids.append((total, down * v, across * h))
                    total += down * v * across * h
            elif marker == 0xDA:
                n = body[0]
                chosen = [next(j for j, p in enumerate(image.parts) if p[0] == body[1 + 2 * k]) for k in range(n)]
                ids = [body[2 + 2 * k] for k in range(n)]
                lo, hi, approx = body[1 + 2 * n : 4 + 2 * n]
                ah, al = approx >> 4, approx & 15
                here = start + at
                stop = marker_list[bisect_left(marker_list, here)]
                first, last = bisect_left(restart_list, here), bisect_left(restart_list, stop)
                group = groups[("dc " if lo == 0 else "ac ") + ("refine" if ah else "first")]
                if n > 1:
                    low = image.grids[chosen[0]][0]
                    blocks, which = _interleaved(tuple((image.grids[j][0] - low, image.grids[j][2], image.parts[j][1], image.parts[j][2]) for j in chosen), down, across)
                    per = len(which)
                else:
                    j = chosen[0]
                    low = image.grids[j][0]
                    rows = -(--(-image.height * image.parts[j][2] // vm) // 8)
                    cols = -(--(-image.width * image.parts[j][1] // hm) // 8)
                    blocks, which, per = _raster(rows, cols, image.grids[j][2]), _ALONE, 1
                step = interval * per if interval else len(blocks)
                if last - first + 1 != -(-len(blocks) // step):
                    raise ValueError("a scan has another number of restart intervals than its size asks for")
                group.layouts.append(blocks)
                group.shifts.append(low)
                group.scans.append((here, first, last - first + 1, step, al, lo, hi, tables[16 + (ids[0] & 15)] if lo else per))
                if lo == 0:
                    group.units.append((which, np.array([tables.get(t >> 4, 0) for t in ids])[which]))
                at = stop - start
        images.append(image)
    coefs = np.zeros((total, 64), dtype=np.int32)
    lookup = np.concatenate(lookups) if lookups else np.zeros(1 << 16, np.uint16)
    for kind, run in (("dc first", _dc_first), ("ac first", _ac_first_scan), ("dc refine", _dc_refine), ("ac refine", _ac_refine_scan)):
        if groups[kind].scans:
            run(groups[kind], groups[kind].gather(restarts, removed), bits, lookup, coefs)
    return images, coefs


def _symbol(bits: _Bits, pos: np.ndarray, table: np.ndarray, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    window = bits.window(pos)
    found = lookup[table + (window >> np.uint64(48)).astype(np.int64)].astype(np.int64)
    return window, found >> 8, found & 255


def _dc_first(group: _Group, segments: tuple, bits: _Bits, lookup: np.ndarray, coefs: np.ndarray) -> None:
    pos, base, count, blocks, scan, rows = segments
    al, per = rows[scan, 4], rows[scan, 7]
    start = (np.cumsum(rows[:, 7]) - rows[:, 7])[scan]
    which = np.concatenate([w for w, _ in group.units])
    used = np.concatenate([t for _, t in group.units]) * 65536
    before = np.zeros((len(pos), int(which.max()) + 1), dtype=np.int64)
    live = np.arange(len(pos))
    for k in range(int(count.max())):
        live = live[count[live] > k]
        at = start[live] + k % per[live]
        window, length, size = _symbol(bits, pos[live], used[at], lookup)
        diff = _extend(_take(window << length.astype(np.uint64), size), size)
        before[live, which[at]] += diff
        coefs[blocks[base[live] + k], 0] = before[live, which[at]] << al[live]
        pos[live] += length + size


def _dc_refine(group: _Group, segments: tuple, bits: _Bits, lookup: np.ndarray, coefs: np.ndarray) -> None:
    pos, base, count, blocks, scan, rows = segments
    al, live = rows[scan, 4], np.arange(len(pos))
    for k in range(int(count.max())):
        live = live[count[live] > k]
        coefs[blocks[base[live] + k], 0] |= (bits.window(pos[live] + k) >> np.uint64(63)).astype(np.int32) << al[live].astype(np.int32)


def _ac_first_scan(group: _Group, segments: tuple, bits: _Bits, lookup: np.ndarray, coefs: np.ndarray) -> None:
    pos, base, count, blocks, scan, rows = segments
    al, lo, hi, table = (rows[scan, j] for j in range(4, 8))
    table = table * 65536
    left, k = count.copy(), lo.copy()
    flat = coefs.reshape(-1)
    while len(pos):
        window, length, sym = _symbol(bits, pos, table, lookup)
        run, size = sym >> 4, sym & 15
        window <<= length.astype(np.uint64)
        zero = size == 0
        amount = np.where(zero & (run < 15), run, size)
        v = _take(window, amount)
        pos += length + amount
        k += run
        put = np.flatnonzero(~zero & (k <= hi))
        flat[blocks[base[put]] * 64 + k[put]] = _extend(v[put], size[put]) << al[put]
        k += 1
        ended = zero & (run < 15)
        done = ended | (k > hi)
        if done.any():
            move = np.where(ended, (1 << np.where(ended, run, 0)) + v, 1)[done]
            base[done] += move
            left[done] -= move
            k[done] = lo[done]
            keep = left > 0
            if not keep.all():
                pos, base, left, k, al, lo, hi, table = (x[keep] for x in (pos, base, left, k, al, lo, hi, table))


def _ac_refine_scan(group: _Group, segments: tuple, bits: _Bits, lookup: np.ndarray, coefs: np.ndarray) -> None:
    pos, base, left, blocks, scan, rows = segments
    al, lo, hi, table = (rows[scan, j] for j in range(4, 8))
    table = table * 65536
    k = lo.copy()
    run, value, eob = (np.zeros(len(pos), np.int64) for _ in range(3))
    asks = np.ones(len(pos), bool)  # next comes a symbol
    flat = coefs.reshape(-1)
    while len(pos):
        need = np.flatnonzero(asks)
        if len(need):
            window, length, sym = _symbol(bits, pos[need], table[need], lookup)
            r, size = sym >> 4, sym & 15
            window <<= length.astype(np.uint64)
            ends = (size == 0) & (r < 15)
            amount = np.where(ends, r, size)
            v = _take(window, amount)
            pos[need] += length + amount
            eob[need] = np.where(ends, (1 << np.where(ends, r, 0)) + v, 0)
            run[need] = r
            value[need] = np.where(size > 0, np.where(v > 0, 1, -1) << al[need], 0)
            asks[need] = False
        cell = blocks[base] * 64 + k
        now = flat[cell].astype(np.int64)
        old = now != 0
        bit = (bits.window(pos) >> np.uint64(63)).astype(np.int64)
        step = 1 << al
        fix = old & (bit > 0) & ((np.abs(now) & step) == 0)
        flat[cell[fix]] += (np.sign(now) * step)[fix].astype(np.int32)
        pos += old
        free = ~old & (eob == 0)
        placed = free & (run == 0)
        flat[cell[placed]] = value[placed]
        asks |= placed
        run -= free & ~placed
        k += 1
        done = k > hi
        if done.any():
            k[done] = lo[done]
            base[done] += 1
            left[done] -= 1
            asks[done] = True
            stays = done & (eob > 0)
            eob[stays] -= 1
            asks[stays] = eob[stays] == 0
            keep = left > 0
            if not keep.all():
                pos, base, left, k, al, lo, hi, table, run, value, eob, asks = (x[keep] for x in (pos, base, left, k, al, lo, hi, table, run, value, eob, asks))


def samples(images: list[Image], coefs: np.ndarray) -> np.ndarray:
    """Blocks of 8-bit samples, natural order: dequantised and inverse-transformed."""
    scaled = coefs.astype(np.float64)
    for image in images:
        for (first, rows, cols), (_, _, _, q) in zip(image.grids, image.parts, strict=True):
            if (image.quant[q] != 1).any():
                scaled[first : first + rows * cols] *= image.quant[q]
    out = scaled @ inverse_matrix()
    out += (128 << _SCALE) + (1 << (_SCALE - 1))
    out *= 1.0 / (1 << _SCALE)  # a power of two: exact
    np.floor(out, out=out)
    return np.clip(out, 0, 255, out=out).astype(np.uint8)


def rgb(image: Image, blocks: np.ndarray) -> np.ndarray:
    """The image's full-resolution RGB tensor (height, width, 3); chroma is repeated to full size."""
    hm, vm = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
    planes = []
    for (first, rows, cols), (_, h, v, _) in zip(image.grids, image.parts, strict=True):
        plane = blocks[first : first + rows * cols].reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        if v < vm:
            plane = plane.repeat(vm // v, axis=0)
        if h < hm:
            plane = plane.repeat(hm // h, axis=1)
        planes.append(plane[: image.height, : image.width].astype(np.int32))
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    out = np.empty((*planes[0].shape, 3), dtype=np.uint8)
    # the usual weights of red, green and blue, times 2**16
    out[:, :, 0] = np.clip((y + 91881 * cr + 32768) >> 16, 0, 255)
    out[:, :, 1] = np.clip((y - 22554 * cb - 46802 * cr + 32768) >> 16, 0, 255)
    out[:, :, 2] = np.clip((y + 116130 * cb + 32768) >> 16, 0, 255)
    return out
