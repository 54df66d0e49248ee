"""Numeric helpers over batches of bytes: numpy and the standard library only."""

from __future__ import annotations

import unicodedata

import numpy as np

M32 = 0xFFFFFFFF


def fletcher64_words(words: np.ndarray) -> np.ndarray:
    """The check sum of each row of little-endian 32-bit words (uint32, rows of at most 16384 words).

    s1 is the sum of the words, s2 the sum of the running sums, both modulo 2**32 - 1; the last words of the result make
    the whole add up to zero. The words of the stored sum, the first two, are summed last.
    """
    w = words.astype(np.uint64)
    w = np.concatenate((w[:, 2:], w[:, :2]), axis=1)
    n = w.shape[1]
    weights = np.arange(n, 0, -1, dtype=np.uint64)
    s1 = w.sum(axis=1, dtype=np.uint64) % np.uint64(M32)
    s2 = (w * weights % np.uint64(M32)).sum(axis=1, dtype=np.uint64) % np.uint64(M32)
    return (s2 << np.uint64(32)) | s1


def fletcher64_sums(words: np.ndarray) -> np.ndarray:
    """(rows, 2): s1 and s2 of the words in order."""
    w = words.astype(np.uint64)
    weights = np.arange(w.shape[1], 0, -1, dtype=np.uint64)
    s1 = w.sum(axis=1, dtype=np.uint64) % np.uint64(M32)
    s2 = (w * weights % np.uint64(M32)).sum(axis=1, dtype=np.uint64) % np.uint64(M32)
    return np.stack([s1, s2], axis=1)


def valid_blocks(blocks: np.ndarray) -> np.ndarray:
    """Whether each row of bytes holds its own check sum in its first 8: neither 0 nor all ones, and the whole sums to zero."""
    words = blocks.view("<u4")
    stored = blocks[:, :8].copy().view("<u8")[:, 0]
    plain = (stored != 0) & (stored != np.uint64(0xFFFFFFFFFFFFFFFF))
    return plain & (fletcher64_words(words) == 0)


def checksum_for(block: bytes) -> bytes:
    """The 8 bytes that make a block valid, given what follows them."""
    words = np.frombuffer(block[8:], "<u4").reshape(1, -1)
    s1, s2 = (int(x) for x in fletcher64_sums(words)[0])
    low = M32 - (s1 + s2) % M32
    high = M32 - (s1 + low) % M32
    return low.to_bytes(4, "little") + high.to_bytes(4, "little")


def _crc_table(polynomial: int) -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(polynomial), c >> 1).astype(np.uint32)
    return c


_CRC32C = _crc_table(0x82F63B78)


def crc32c(data: bytes, start: int = M32) -> int:
    """CRC-32C without a final exclusive or."""
    c = start
    for b in data:
        c = int(_CRC32C[(c ^ b) & 0xFF]) ^ (c >> 8)
    return c


def name_hash(name: str, fold: bool = False) -> int:
    """22 bits of the CRC-32C of a name's decomposed code points, shifted by 10, with the length in bytes and a NUL below."""
    form = unicodedata.normalize("NFD", name)
    if fold:
        form = unicodedata.normalize("NFD", form.casefold())
    return (crc32c(form.encode("utf-32-le", "surrogatepass")) & 0x3FFFFF) << 10 | (len(name.encode()) + 1) & 0x3FF


def set_bits(bitmap: np.ndarray, count: int | None = None) -> np.ndarray:
    """The places of the set bits, least significant bit of each byte first, below count."""
    bits = np.unpackbits(bitmap, bitorder="little")
    return np.flatnonzero(bits[:count])
