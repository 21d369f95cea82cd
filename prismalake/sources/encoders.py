"""8-bit images as PNG and baseline JPEG files, in NumPy."""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np

# The luminance and chrominance quantisation tables that the JPEG standard gives as examples (Annex K).
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMINANCE = [
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
]

# Diagonals of an 8 x 8 block, walked in alternating directions.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))
_k = np.arange(8)
COSINES = np.cos((2 * _k + 1) * _k[:, None] * np.pi / 16) * np.where(_k[:, None] == 0, np.sqrt(1 / 8), 0.5)


def png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """A PNG file of 8-bit grey, colour or colour with alpha."""
    kind = {1: 0, 3: 2, 4: 6}[channels]
    lines = b"".join(b"\0" + data[i : i + width * channels] for i in range(0, len(data), width * channels))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def _lengths(counts: np.ndarray) -> dict[int, int]:
    """Huffman code lengths of at most 16 bits of the symbols that occur; one code stays free (all ones is forbidden)."""
    while True:
        heap = [(1, -1, {-1: 0})] + [(int(counts[s]), int(s), {int(s): 0}) for s in np.flatnonzero(counts)]
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), {s: n + 1 for s, n in (a[2] | b[2]).items()}))
        found = heap[0][2]
        if max(found.values()) <= 16:
            del found[-1]  # merged first, so one of the longest
            return found
        counts = (counts + 1) // 2


def _table(counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table as JPEG stores it, and the code and length of each symbol."""
    lengths = _lengths(counts)
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, before = 0, 0
    codes, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s in order:
        code <<= lengths[s] - before
        before = lengths[s]
        codes[s], size[s] = code, before
        code += 1
    return bytes(np.bincount([lengths[s] for s in order], minlength=17)[1:].tolist()) + bytes(order), codes, size


def _magnitude(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of bits of each value and the bits that stand for it."""
    size = np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    return size, np.where(v < 0, v + (1 << size) - 1, v)


def _packed(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Bits one after another, filled with ones; a zero byte follows each byte of ones."""
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(sizes)), sizes)
    bits = (values[of] >> (ends[of] - 1 - np.arange(len(of)))) & 1
    bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.int64)]).astype(np.uint8)
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0")


def jpeg(height: int, width: int, channels: int, data: bytes, quality: int = 90) -> bytes:
    """A baseline JPEG file of 8-bit grey or colour (without subsampling), with Huffman tables of its own."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    if channels == 3:
        r, g, b = np.moveaxis(x, 2, 0)
        y = 0.299 * r + 0.587 * g + 0.114 * b
        x = np.stack([y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402], 2)
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip((np.array(t) * scale + 50) // 100, 1, 255).astype(int) for t in (LUMINANCE, CHROMINANCE)][: 1 + (channels == 3)]
    x = np.pad(x, [(0, -height % 8), (0, -width % 8), (0, 0)], mode="edge") - 128
    h, w = x.shape[0] // 8, x.shape[1] // 8
    blocks = x.reshape(h, 8, w, 8, channels).transpose(0, 2, 4, 1, 3)
    table_of = np.array([0, 1, 1][:channels])
    coded = (COSINES @ blocks @ COSINES.T).reshape(h * w, channels, 64) / np.array(tables)[table_of]
    coded = np.rint(coded).astype(np.int64)[:, :, ZIGZAG]
    differences = np.diff(coded[:, :, 0], axis=0, prepend=0).ravel()
    chroma = np.tile(table_of, h * w)
    rest = coded.reshape(-1, 64)[:, 1:]
    n = len(rest)
    row, at = np.nonzero(rest)
    previous = np.where(np.diff(row, prepend=-1) != 0, -1, np.concatenate([[-1], at[:-1]]))
    run = at - previous - 1
    size, bits = _magnitude(rest[row, at])
    dc_size, dc_bits = _magnitude(differences)
    last = np.full(n, -1)
    last[row] = at
    open_ = np.flatnonzero(last < 62)
    long = np.repeat(np.arange(len(row)), run // 16)
    # Entries: first values, runs of sixteen zeros, values, ends of blocks; put in the order of the file.
    row_of = np.concatenate([np.arange(n), row[long], row, open_])
    place = np.concatenate([np.full(n, -2), 2 * at[long], 2 * at + 1, np.full(len(open_), 200)])
    symbol = np.concatenate([dc_size, np.full(len(long), 0xF0), (run % 16) * 16 + size, np.zeros(len(open_), np.int64)])
    extra = np.concatenate([dc_bits, np.zeros(len(long), np.int64), bits, np.zeros(len(open_), np.int64)])
    extra_size = np.concatenate([dc_size, np.zeros(len(long), np.int64), size, np.zeros(len(open_), np.int64)])
    kind = 2 * chroma[row_of] + (place >= 0)  # table of each entry: first values and others, of luminance and chrominance
    order = np.lexsort([place, row_of])
    values, sizes, stored = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64), []
    for k in range(2 * len(tables)):
        own = kind == k
        head, codes, lengths = _table(np.bincount(symbol[own], minlength=256))
        values[own] = codes[symbol[own]] << extra_size[own] | extra[own]
        sizes[own] = lengths[symbol[own]] + extra_size[own]
        stored.append(bytes([(k % 2) << 4 | k // 2]) + head)
    part = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    frame = struct.pack(">BHHB", 8, height, width, channels) + b"".join(bytes([c + 1, 0x11, int(table_of[c])]) for c in range(channels))
    scan = bytes([channels]) + b"".join(bytes([c + 1, 0x11 * int(table_of[c])]) for c in range(channels)) + b"\0\x3f\0"
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    out += b"".join(part(0xDB, bytes([k]) + bytes(t[ZIGZAG].tolist())) for k, t in enumerate(tables))
    out += part(0xC0, frame) + b"".join(part(0xC4, t) for t in stored) + part(0xDA, scan)
    return out + _packed(values[order], sizes[order]) + b"\xff\xd9"
