"""Scalar functions over flag words, packed keys, times, identifiers and names. All run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_MASK = 0x0FFFFFFFFFFFFFFF
LENGTH_MASK = 0x00FFFFFFFFFFFFFF

#: Directory-entry file types, as mode bits >> 12.
FILE_TYPES = {1: "fifo", 2: "character device", 4: "directory", 6: "block device", 8: "regular", 10: "symlink", 12: "socket", 14: "whiteout"}
#: Volume role bits; above 0x20 the role is a number in the upper bits.
VOLUME_ROLE_BITS = {1: "System", 2: "User", 4: "Recovery", 8: "VM", 16: "Preboot", 32: "Installer"}
VOLUME_ROLES = {1: "Data", 2: "Baseband", 3: "Update", 4: "Xart", 5: "Hardware", 6: "Backup", 7: "Reserved-7", 8: "Reserved-8", 9: "Enterprise", 10: "Reserved-10", 11: "Prelogin"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag_names(value: Column | str, table: dict[int, str]) -> Column:
    """The names of the set bits in the table's order, joined by ', '; null stays null."""
    v = _col(value).cast("long")
    names = [F.when(v.bitwiseAND(F.lit(bit).cast("long")) != 0, F.lit(name)) for bit, name in table.items()]
    return F.when(v.isNotNull(), F.concat_ws(", ", *names))


def enum_name(value: Column | str, table: dict[int, str], default: str = "") -> Column:
    """The name of an exact value, else default."""
    pairs = [x for key, name in table.items() for x in (F.lit(key).cast("long"), F.lit(name))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(value).cast("long")), F.lit(default))


def role_names(role: Column | str) -> Column:
    """Roles up to 0x20 are a set of bits, larger ones a number in the bits from 6 on; no role has a name too, unknown numbers none."""
    r = _col(role).cast("long")
    return F.when(r == 0, "No specific role").when(r <= 0x20, flag_names(r, VOLUME_ROLE_BITS)).otherwise(enum_name(F.shiftright(r, 6), VOLUME_ROLES))


def _div(a: Column, b: int) -> Column:
    """Integer division of longs."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def ns_to_timestamp(ns: Column | str) -> Column:
    """Nanoseconds since the epoch as a timestamp; what is below a microsecond is cut off downwards."""
    n = _col(ns)
    return F.timestamp_micros(_div(n - F.pmod(n, F.lit(1000).cast("long")), 1000))


def ns_to_string(ns: Column | str) -> Column:
    """YYYY-MM-DD HH:MM:SS.nnnnnnnnn; the session's time zone must be UTC."""
    n = _col(ns)
    rest = F.pmod(n, F.lit(1_000_000_000).cast("long"))
    return F.concat(F.date_format(F.timestamp_seconds(_div(n - rest, 1_000_000_000)), "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad(rest.cast("string"), 9, "0"))


def hex_string(data: Column | str) -> Column:
    """Upper-case hexadecimal digits."""
    return F.hex(_col(data))


def _dashed(h: Column) -> Column:
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def uuid_string(data: Column | str) -> Column:
    """16 bytes as 8-4-4-4-12 upper-case digits in byte order; null for another length."""
    d = _col(data)
    return F.when(F.octet_length(d) == 16, _dashed(F.hex(d)))


def guid_string(data: Column | str) -> Column:
    """16 bytes as a GUID: the first three groups are little-endian."""
    d = _col(data)
    h = F.hex(d)
    order = (7, 5, 3, 1, 11, 9, 15, 13)
    swapped = F.concat(*[F.substring(h, at, 2) for at in order], F.substring(h, 17, 16))
    return F.when(F.octet_length(d) == 16, _dashed(swapped))


def code_points(text: Column | str) -> Column:
    """The code points of a string as array<int>; empty for an empty one."""
    t = _col(text)
    return F.when(F.length(t) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(t, ""), lambda c: F.ascii(c)))


def compare_names(a: Column | str, b: Column | str, fold: bool = False) -> Column:
    """-1, 0 or 1: names by their bytes, or with fold by their lower-case forms."""
    x, y = _col(a), _col(b)
    if fold:
        x, y = F.lower(x), F.lower(y)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def mode_type(mode: Column | str) -> Column:
    """The file type in a mode's upper four bits."""
    return enum_name(F.shiftrightunsigned(_col(mode).cast("long"), 12).bitwiseAND(F.lit(15).cast("long")), FILE_TYPES)


def entry_mode(flags: Column | str) -> Column:
    """The mode bits of a directory entry's type nibble."""
    return F.shiftleft(_col(flags).cast("long").bitwiseAND(F.lit(15).cast("long")), 12)


def _and(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(mask).cast("long"))


def key_id(key: Column | str) -> Column:
    """The low 60 bits of a packed key: the object's id."""
    return _and(_col(key), ID_MASK)


def key_type(key: Column | str) -> Column:
    """The upper 4 bits of a packed key, whatever its sign."""
    return F.shiftrightunsigned(_col(key), 60).cast("int")


def packed_key(oid: Column | str, kind: Column | str) -> Column:
    return F.shiftleft(_col(kind).cast("long"), 60).bitwiseOR(_and(_col(oid), ID_MASK))


def length_of(word: Column | str) -> Column:
    """The low 56 bits of a length with flags."""
    return _and(_col(word), LENGTH_MASK)


def flags_of(word: Column | str) -> Column:
    """The upper 8 bits of a length with flags."""
    return F.shiftrightunsigned(_col(word), 56).cast("int")


def extent_length(word: Column | str) -> Column:
    """The low 60 bits of a length with a kind."""
    return key_id(word)


def extent_kind(word: Column | str) -> Column:
    return key_type(word)


def name_length(word: Column | str) -> Column:
    """The low 10 bits of a name word; they count the NUL."""
    return _and(_col(word).cast("long"), 0x3FF).cast("int")


def name_hash(word: Column | str) -> Column:
    """The upper 22 bits of a 32-bit name word."""
    return F.shiftrightunsigned(_and(_col(word).cast("long"), 0xFFFFFFFF), 10).cast("int")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
