"""Writes nodes and blocks of a minimal image, from the offsets in imagelake.layouts."""

from imagelake.kernels import checksum_for, name_hash


def le(x: int, n: int) -> bytes:
    return (x % (1 << (8 * n))).to_bytes(n, "little")


def seal(body: bytearray) -> bytes:
    body[:8] = checksum_for(bytes(body))
    return bytes(body)


def header(oid: int, xid: int, kind: int, subtype: int = 0) -> bytes:
    return bytes(8) + le(oid, 8) + le(xid, 8) + le(kind, 4) + le(subtype, 4)


def node(oid, xid, subtype, records, root=True, leaf=True, fixed=None, size=4096) -> bytes:
    """A node of (key, val) records; val None is a missing value; fixed: (key size, value size)."""
    flags = (1 if root else 0) | (2 if leaf else 0) | (4 if fixed else 0)
    entry = 4 if fixed else 8
    keys = b"".join(k for k, _ in records)
    end = size - (40 if root else 0)
    body = bytearray(size)
    body[:32] = header(oid, xid, 2 if root else 3, subtype)
    body[32:40] = le(flags, 2) + le(0 if leaf else 1, 2) + le(len(records), 4)
    body[40:44] = le(0, 2) + le(entry * len(records), 2)
    at, back = 0, 0
    for i, (k, v) in enumerate(records):
        if v is not None:
            back += len(v)
            body[end - back : end - back + len(v)] = v
        place = 0xFFFF if v is None else back
        toc = le(at, 2) + le(place, 2) if fixed else le(at, 2) + le(len(k), 2) + le(place, 2) + le(len(v or b""), 2)
        body[56 + entry * i : 56 + entry * (i + 1)] = toc
        at += len(k)
    start = 56 + entry * len(records)
    body[start : start + len(keys)] = keys
    if root:
        body[end:] = le(0, 4) + le(size, 4) + le(fixed[0] if fixed else 0, 4) + le(fixed[1] if fixed else 0, 4) + le(0, 8) + le(len(records), 8) + le(1, 8)
    return seal(body)


def key(oid: int, kind: int, rest: bytes = b"") -> bytes:
    return le(oid | kind << 60, 8) + rest


def xfields(fields: dict[int, bytes]) -> bytes:
    head = le(len(fields), 2) + le(0, 2) + b"".join(bytes([k, 0]) + le(len(v), 2) for k, v in fields.items())
    return head + b"".join(v.ljust(-(-len(v) // 8) * 8, b"\0") for v in fields.values())


def inode(ino, parent, private, mode, size=None, children=1, name="x", flags=0, bsd=0) -> tuple[bytes, bytes]:
    val = le(parent, 8) + le(private, 8) + le(10**18, 8) * 4 + le(flags, 8) + le(children, 4) + le(0, 4) + le(0, 4) + le(bsd, 4) + le(501, 4) + le(20, 4) + le(mode, 2) + le(0, 2) + le(0, 8)
    extra = {4: name.encode() + b"\0"} | ({8: le(size, 8) + le(8192, 8) + le(0, 24)} if size is not None else {})
    return key(ino, 3), val + xfields(extra)


def dir_rec(parent, name, child, kind, sibling=None) -> tuple[bytes, bytes]:
    return key(parent, 9, le(name_hash(name), 4) + name.encode() + b"\0"), le(child, 8) + le(5, 8) + le(kind, 2) + (xfields({1: le(sibling, 8)}) if sibling else b"")


def xattr(ino, name, data=None, stream=None) -> tuple[bytes, bytes]:
    body = data if data is not None else le(stream[0], 8) + le(stream[1], 8) + le(4096, 8) + bytes(24)
    return key(ino, 4, le(len(name) + 1, 2) + name.encode() + b"\0"), le(2 if data is not None else 1, 2) + le(len(body), 2) + body


def extent(file_id, logical, length, block) -> tuple[bytes, bytes]:
    return key(file_id, 8, le(logical, 8)), le(length, 8) + le(block, 8) + le(0, 8)
