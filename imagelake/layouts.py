"""Where the fields of on-disk structures lie. All numbers are little-endian; a field ends where the next begins."""

from __future__ import annotations

import numpy as np

#: Struct, size, then field@offset. Fields of 1, 2, 4 or 8 bytes are numbers, others are bytes.
TEXT = """
object 32 cksum@0 oid@8 xid@16 o_type@24 o_subtype@28
node 56 flags@32 level@34 nkeys@36 table_off@40 table_len@42 free_off@44 free_len@46 kfree_off@48 kfree_len@50 vfree_off@52 vfree_len@54
node_info 40 bt_flags@0 node_size@4 key_size@8 val_size@12 longest_key@16 longest_val@20 key_count@24 node_count@32
container 1408 magic@32 block_size@36 block_count@40 features@48 ro_features@56 incompat@64 uuid@72 next_oid@88 next_xid@96 desc_blocks@104 data_blocks@108 desc_base@112 data_base@120 desc_next@128 data_next@132 desc_index@136 desc_len@140 data_index@144 data_len@148 spaceman_oid@152 omap_oid@160 reaper_oid@168 test_type@176 max_file_systems@180 fs_oids@184 counters@984
volume 1056 magic@32 fs_index@36 features@40 ro_features@48 incompat@56 unmount_time@64 reserve@72 quota@80 alloc_count@88 meta_crypto@96 root_tree_type@116 extentref_type@120 snap_meta_type@124 omap_oid@128 root_tree_oid@136 extentref_oid@144 snap_meta_oid@152 revert_xid@160 revert_oid@168 next_obj_id@176 num_files@184 num_dirs@192 num_symlinks@200 num_other@208 num_snapshots@216 blocks_alloced@224 blocks_freed@232 uuid@240 last_mod@256 fs_flags@264 formatted_by@272 modified_by@320 name@704 next_doc_id@960 role@964 reserved@966
object_map 88 om_flags@32 snap_count@36 tree_type@40 snap_tree_type@44 tree_oid@48 snap_tree_oid@56 newest_snap@64 revert_min@72 revert_max@80
checkpoint_map 40 cpm_flags@32 cpm_count@36
mapping 40 type@0 subtype@4 size@8 pad@12 fs_oid@16 oid@24 paddr@32
space_manager 2520 block_size@32 blocks_per_chunk@36 chunks_per_cib@40 cibs_per_cab@44 devices@48 sm_flags@144 tx_multiplier@148
device 48 block_count@0 chunk_count@8 cib_count@16 cab_count@20 free_count@24 addr_offset@32 reserved@36
chunk_block 40 cib_index@32 chunk_info_count@36
chunk 32 xid@0 addr@8 block_count@16 free_count@20 bitmap_addr@24
address_block 40 cab_index@32 cib_count@36
omap_key 16 oid@0 xid@8
omap_val 16 flags@0 size@4 paddr@8
inode 92 parent_id@0 private_id@8 create_ns@16 mod_ns@24 change_ns@32 access_ns@40 internal_flags@48 nchildren_nlink@56 protection_class@60 write_gen@64 bsd_flags@68 uid@72 gid@76 mode@80 pad1@82 uncompressed_size@84
dir_rec 18 file_id@0 date_added_ns@8 flags@16
xattr 4 flags@0 data_len@2
stream 48 stream_id@0 stream_size@8 stream_alloced@16 crypto_id@24 written@32 read@40
file_extent 24 len_and_flags@0 phys_block@8 crypto_id@16
phys_extent 20 len_and_kind@0 owning_obj@8 refcnt@16
sibling 10 parent_id@0 name_len@8
sibling_map 8 file_id@0
snapshot 50 extentref_oid@0 sblock_paddr@8 create_ns@16 change_ns@24 inum@32 extentref_type@40 flags@44 name_len@48
snap_name 8 snap_xid@0
omap_snapshot 16 snap_flags@0 pad@4 snap_oid@8
crypto_state 24 refcnt@0 major_version@4 minor_version@6 cpflags@8 persistent_class@12 key_os_version@16 key_revision@20 key_len@22
file_hash 3 hashed_len@0 hash_size@2
free_count 8 count@0
dstream_id 4 refcnt@0
dir_stats 32 num_children@0 total_size@8 chained_key@16 gen_count@24
sealed_key 16 private_id@0 logical_addr@8
sealed_val 16 len_and_flags@0 phys_block@8
"""


def _parse() -> dict[str, tuple[int, list[tuple[str, int, int]]]]:
    out = {}
    for line in TEXT.strip().splitlines():
        name, size, *fields = line.split()
        at = [(f.split("@")[0], int(f.split("@")[1])) for f in fields]
        ends = [a for _, a in at[1:]] + [int(size)]
        out[name] = (int(size), [(f, a, e - a) for (f, a), e in zip(at, ends, strict=True)])
    return out


LAYOUTS = _parse()


def numbers(rows: list[bytes | None], layout: str, start: int = 0) -> dict[str, np.ndarray]:
    """The number fields of many structs at once, as int64 (a set top bit makes them negative); short rows end in zeros."""
    size, fields = LAYOUTS[layout]
    raw = b"".join((r or b"")[start : start + size].ljust(size, b"\0") for r in rows)
    table = np.frombuffer(raw, np.uint8).reshape(len(rows), size)
    return {name: table[:, at : at + n].copy().view(f"<u{n}")[:, 0].astype(np.int64) for name, at, n in fields if n in (1, 2, 4, 8)}
