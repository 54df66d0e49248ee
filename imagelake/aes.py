"""AES-128 in XTS mode over arrays of sectors: numpy tables, no per-byte Python."""

from __future__ import annotations

import numpy as np


def _field() -> tuple[np.ndarray, np.ndarray]:
    """The S-box and its inverse, from inverses in GF(2**8) and the affine map."""
    exp, log, x = [0] * 255, [0] * 256, 1
    for i in range(255):
        exp[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
    box = np.zeros(256, np.uint8)
    for v in range(256):
        b = exp[-log[v] % 255] if v else 0
        s = 0x63
        for shift in range(5):
            s ^= (b << shift | b >> (8 - shift)) & 0xFF
        box[v] = s
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256)
    return box, back


def _times(factor: int) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for v in range(256):
        a, b, p = v, factor, 0
        while b:
            p ^= a if b & 1 else 0
            a = (a << 1) ^ (0x11B if a & 0x80 else 0)
            b >>= 1
        out[v] = p
    return out


BOX, UNBOX = _field()
TIMES = {f: _times(f) for f in (2, 3, 9, 11, 13, 14)}
#: Where each byte comes from when rows are shifted, and back; a block's bytes are columns of four.
SHIFT = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])
UNSHIFT = np.argsort(SHIFT)


def expand(key: bytes) -> np.ndarray:
    """(11, 16) round keys of a 16-byte key."""
    words = [list(key[i : i + 4]) for i in range(0, 16, 4)]
    constant = 1
    for i in range(4, 44):
        t = list(words[-1])
        if i % 4 == 0:
            t = [int(BOX[b]) for b in t[1:] + t[:1]]
            t[0] ^= constant
            constant = (constant << 1) ^ (0x11B if constant & 0x80 else 0)
        words.append([a ^ b for a, b in zip(words[i - 4], t, strict=True)])
    return np.array(words, np.uint8).reshape(11, 16)


def _mix(state: np.ndarray, factors: tuple[int, int, int, int]) -> np.ndarray:
    s = state.reshape(-1, 4, 4)
    turned = [np.roll(s, -k, axis=2) for k in range(4)]
    out = np.zeros_like(s)
    for f, t in zip(factors, turned, strict=True):
        out ^= TIMES[f][t] if f > 1 else t
    return out.reshape(-1, 16)


def encrypt(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    s = blocks ^ keys[0]
    for r in range(1, 11):
        s = BOX[s][:, SHIFT]
        s = (_mix(s, (2, 3, 1, 1)) if r < 10 else s) ^ keys[r]
    return s


def decrypt(blocks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    s = blocks ^ keys[10]
    for r in range(9, -1, -1):
        s = UNBOX[s[:, UNSHIFT]] ^ keys[r]
        if r:
            s = _mix(s, (14, 11, 13, 9))
    return s


def xts(sectors: np.ndarray, units: np.ndarray, key: bytes, backward: bool) -> np.ndarray:
    """(sectors, bytes) with unit numbers: the first half of key is for the data, the second for the tweaks."""
    first, second = expand(key[:16]), expand(key[16:32])
    n, size = sectors.shape
    tweak = np.zeros((n, 16), np.uint8)
    tweak[:, :8] = units.astype("<u8").view(np.uint8).reshape(n, 8)
    tweak = encrypt(tweak, second)
    every = np.empty((n, size // 16, 16), np.uint8)
    for i in range(size // 16):
        every[:, i] = tweak
        carry = tweak >> 7
        tweak = (tweak << 1).astype(np.uint8)
        tweak[:, 1:] |= carry[:, :-1]
        tweak[:, 0] ^= carry[:, 15] * np.uint8(0x87)
    flat = every.reshape(-1, 16)
    work = decrypt if backward else encrypt
    return (work(sectors.reshape(-1, 16) ^ flat, first) ^ flat).reshape(n, size)
