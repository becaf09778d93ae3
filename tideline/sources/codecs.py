"""Byte codecs of archive blocks, on numpy arrays of whole numbers or doubles."""

from __future__ import annotations

import struct

import numpy as np

VARINT, BITPACK, RLE, RLE_DOD, DOD, DICT, FIXED64, XOR, FRAME = 1, 2, 3, 4, 5, 6, 7, 8, 9
SAFE = 1 << 53


class ArchiveError(ValueError):
    """Bytes that aren't a whole, consistent archive."""


def whole(x: np.ndarray) -> bool:
    """Whether doubles survive as integers: finite, integral, within 2^53, no negative zero."""
    return bool(np.isfinite(x).all() and (np.abs(x) < SAFE).all() and (x == np.floor(x)).all() and not (np.signbit(x) & (x == 0)).any())


def zigzag(v: np.ndarray) -> np.ndarray:
    return np.where(v >= 0, v * 2, -v * 2 - 1).astype(np.uint64)


def unzigzag(u: np.ndarray) -> np.ndarray:
    half = (u >> np.uint64(1)).astype(np.int64)
    return np.where(u & np.uint64(1), -half - 1, half)


def varint(v: np.ndarray) -> bytes:
    """Zigzag, seven bits a byte, the lowest first."""
    u = zigzag(np.asarray(v, np.int64))
    if not len(u):
        return b""
    groups = np.stack([(u >> np.uint64(7 * k)).astype(np.uint64) for k in range(8)], axis=1)
    used = np.maximum(1, (groups > 0).sum(axis=1))
    low = (groups & np.uint64(0x7F)).astype(np.uint8)
    place = np.arange(8)[None, :]
    low |= np.where(place < used[:, None] - 1, 0x80, 0).astype(np.uint8)
    return low[place < used[:, None]].tobytes()


def unvarint(data: bytes, count: int | None = None) -> tuple[np.ndarray, int]:
    """(values, bytes read); all of data, or count values."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 0x80)
    if count is not None:
        if len(ends) < count:
            raise ArchiveError("a varint is cut off")
        ends = ends[:count]
    elif len(b) and (not len(ends) or ends[-1] != len(b) - 1):
        raise ArchiveError("a varint is cut off")
    if not len(ends):
        return np.zeros(0, np.int64), 0
    starts = np.concatenate([[0], ends[:-1] + 1])
    if (ends - starts).max() > 7:
        raise ArchiveError("a varint is too long")
    read = int(ends[-1]) + 1
    place = np.arange(read) - np.repeat(starts, ends - starts + 1)
    parts = (b[:read] & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64)
    return unzigzag(np.add.reduceat(parts, starts)), read


def bits(u: np.ndarray, width: int) -> bytes:
    """Lowest bit first, value after value."""
    flat = ((u[:, None] >> np.arange(width, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(flat.reshape(-1), bitorder="little").tobytes()


def unbits(data: bytes, count: int, width: int) -> np.ndarray:
    if len(data) * 8 < count * width:
        raise ArchiveError("packed bits are cut off")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:count * width].reshape(count, width)
    return (flat.astype(np.uint64) << np.arange(width, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)


def bitpack(v: np.ndarray) -> bytes:
    u = zigzag(np.asarray(v, np.int64))
    if not len(u):
        return b""
    width = max(1, int(u.max()).bit_length())
    return bytes([width]) + bits(u, width)


def unbitpack(data: bytes, count: int) -> np.ndarray:
    return unzigzag(unbits(data[1:], count, data[0])) if data else np.zeros(0, np.int64)


def run_pairs(v: np.ndarray, most: int = 255) -> np.ndarray:
    """count, value, count, value ... with runs of at most ``most``."""
    v = np.asarray(v, np.int64)
    if not len(v):
        return v
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    new |= (np.arange(len(v)) - first) % most == 0
    at = np.flatnonzero(new)
    return np.stack([np.diff(np.append(at, len(v))), v[at]], axis=1).reshape(-1)


def rle(v: np.ndarray) -> bytes:
    return varint(run_pairs(v))


def unrle(data: bytes) -> np.ndarray:
    pairs, _ = unvarint(data)
    if len(pairs) % 2 or (pairs[::2] < 0).any():
        raise ArchiveError("runs don't pair up")
    return np.repeat(pairs[1::2], pairs[::2])


def frame(v: np.ndarray) -> bytes:
    v = np.asarray(v, np.int64)
    if not len(v):
        return b""
    low = int(v.min())
    rest = (v - low).astype(np.uint64)
    width = int(rest.max()).bit_length()
    return varint(np.array([low])) + bytes([width]) + (bits(rest, width) if width else b"")


def unframe(data: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.int64)
    low, at = unvarint(data, 1)
    if at >= len(data) or data[at] > 53:
        raise ArchiveError("a frame has no width")
    width = data[at]
    return int(low[0]) + (unbits(data[at + 1:], count, width).astype(np.int64) if width else np.zeros(count, np.int64))


#: Values that a ring of recent ones holds.
RING = 256


class Ring:
    """The last distinct values by first use, the oldest overwritten; shared by the blocks of a segment."""

    def __init__(self):
        self.held: list[int] = []
        self.place: dict[int, int] = {}
        self.next = 0

    def put(self, value: int) -> None:
        if len(self.held) < RING:
            self.place[value] = len(self.held)
            self.held.append(value)
            return
        if self.place.get(self.held[self.next]) == self.next:
            del self.place[self.held[self.next]]
        self.held[self.next], self.place[value] = value, self.next
        self.next = (self.next + 1) % RING


def ring(v: np.ndarray, known: Ring) -> bytes:
    """A value in the ring as its place, an odd number; another as twice its zigzag form, and into the ring."""
    out = []
    for x, z in zip(np.asarray(v, np.int64).tolist(), zigzag(np.asarray(v, np.int64)).tolist()):
        if (at := known.place.get(x)) is not None:
            out.append(2 * at + 1)
        else:
            out.append(2 * z)
            known.put(x)
    return varint(np.array(out, np.int64))


def unring(data: bytes, known: Ring) -> np.ndarray:
    out = []
    for r in unvarint(data)[0].tolist():
        if r & 1:
            if r >> 1 >= len(known.held):
                raise ArchiveError("a place outside the ring")
            out.append(known.held[r >> 1])
        else:
            out.append(int(unzigzag(np.array([r >> 1], np.uint64))[0]))
            known.put(out[-1])
    return np.array(out, np.int64)


def fixed(x: np.ndarray) -> bytes:
    return np.asarray(x, "<f8").tobytes()


def unfixed(data: bytes, count: int) -> np.ndarray:
    if len(data) != 8 * count:
        raise ArchiveError("fixed payload has another length")
    return np.frombuffer(data, "<f8").astype(np.float64)


def unxor(data: bytes, count: int) -> np.ndarray:
    """First value whole; then a bit 0 for an equal one, or 1, leading (6), trailing (6) and
    length - 1 (6) of the changed bits, and these."""
    if not count:
        return np.zeros(0)
    if len(data) < 8:
        raise ArchiveError("float payload is cut off")
    last = struct.unpack("<Q", data[:8])[0]
    stream, total, at, out = int.from_bytes(data[8:], "little"), 8 * (len(data) - 8), 0, [last]

    def take(n):
        nonlocal at
        if at + n > total:
            raise ArchiveError("float payload is cut off")
        found = (stream >> at) & ((1 << n) - 1)
        at += n
        return found

    for _ in range(count - 1):
        if take(1):
            take(6)
            shift, n = take(6), take(6) + 1
            last ^= take(n) << shift
        out.append(last)
    return np.array(out, "<u8").view("<f8").astype(np.float64)


def xor(x: np.ndarray) -> bytes:
    u = np.asarray(x, "<f8").view("<u8").tolist()
    if not u:
        return b""
    stream = at = 0
    for before, now in zip(u, u[1:]):
        d = before ^ now
        if d == 0:
            at += 1
            continue
        lead, trail = 64 - d.bit_length(), (d & -d).bit_length() - 1
        n = 64 - lead - trail
        piece = 1 | lead << 1 | trail << 7 | (n - 1) << 13 | (d >> trail) << 19
        stream |= piece << at
        at += 19 + n
    return struct.pack("<Q", u[0]) + stream.to_bytes((at + 7) // 8, "little")


def decode(codec: int, data: bytes, count: int) -> np.ndarray:
    """The block's values; their number must be the manifest's."""
    if codec in (VARINT, DOD):
        v, read = unvarint(data)
        del read
    elif codec == BITPACK:
        v = unbitpack(data, count)
    elif codec in (RLE, RLE_DOD):
        v = unrle(data)
    elif codec == FRAME:
        v = unframe(data, count)
    elif codec == FIXED64:
        v = unfixed(data, count)
    elif codec == XOR:
        v = unxor(data, count)
    else:
        raise ArchiveError(f"unknown codec {codec}")
    if len(v) != count:
        raise ArchiveError("a block has another number of values than its manifest says")
    return v


def smallest(v: np.ndarray, candidates: tuple[int, ...]) -> tuple[int, bytes]:
    """The codec of the fewest bytes, the first of equals."""
    made = {VARINT: varint, DOD: varint, BITPACK: bitpack, RLE: rle, RLE_DOD: rle, FRAME: frame}
    tried = [(c, made[c](v)) for c in candidates]
    return min(tried, key=lambda x: len(x[1]))
