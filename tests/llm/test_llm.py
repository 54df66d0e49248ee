"""The operators on awkward rows: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns; and against brute force."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from imagelake.llm import bpe, embedding_dedup, exact_dedup, langid, line_dedup, near_dedup, packing, pii, quality, sharding
from imagelake.llm.queries import packing_tokenizer
from imagelake.llm.shared import connected_components

WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n=120):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


BASE = prose(1)
LONG = "x" * 200_000
ROWS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE.replace(" ", "  \n")), (4, BASE + " tail"), (5, None), (6, ""), (7, " \t\n"), (8, LONG), (9, prose(2)),
    (None, prose(3)), (None, BASE), (10, "one two"), (11, "One TWO"), (12, "é😀 " * 50), (13, prose(4) + "\n" + BASE), (14, "!!! 123"),
]
EXTRA = "row string, text_key string, id string, key string, n string, removed string, band string, rep string, spans string, ids string, start string, v string"


@pytest.fixture(scope="module")
def docs(spark):
    extra = ["x"] * len(EXTRA.split(", "))
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, len(t or ""), *extra) for k, (i, t) in enumerate(ROWS)], f"doc_id long, text string, lang string, n_chars long, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id > 1000")


def test_exact_dedup(docs, none):
    same = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    found = exact_dedup.exact_dedup(docs).collect()
    assert len(found) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(same(t), []).append(i)
    want = []
    for i, t in ROWS:
        ids = [x for x in groups[same(t)] if x is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(groups[same(t)]), i is not None and i == keep, hashlib.sha256(same(t).encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, want))
    assert exact_dedup.exact_dedup(none).count() == 0


def test_chunks_follow_the_content():
    text = np.frombuffer(prose(5, 5000).encode(), np.uint8)
    a = exact_dedup.cut_points(text, 8)
    b = exact_dedup.cut_points(np.concatenate((text[:0], np.frombuffer(b"something in front ", np.uint8), text)), 8) - 19
    assert len(a) > 50 and len(set(a.tolist()) - set(b.tolist())) <= 2


def test_sharding(spark, docs, none):
    found = sharding.shard_documents(docs).collect()
    assert len(found) == len(ROWS) and sharding.shard_documents(none).count() == 0
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = sorted((r.size, r.text_crc32) for r in found)
    assert sizes == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in ROWS)
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shard_documents(many, slot_buckets=16)
    counts = [r["count"] for r in rows.groupBy("shard").count().collect()]
    assert len(counts) == 16 and max(counts) < 1.2 * min(counts)
    moved = rows.where("grown_shard <> shard").count()
    assert rows.where("grown_shard <> shard and grown_shard <> 16").isEmpty() and abs(moved - 20_000 / 17) < 200


def test_a_further_shard_is_what_a_larger_tree_gives(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    grown = {r.doc_id: r.grown_shard for r in sharding.shard_documents(ids, 16).collect()}
    assert grown == {r.doc_id: r.shard for r in sharding.shard_documents(ids, 17).collect()}
    own = [sharding.Shard(i, "r", f"k{i}") for i in range(3)]
    assert {r.grown_shard for r in sharding.shard_documents(ids, tree=own).collect()} == {0, 1, 2, 3}


def test_weights_and_confined_movement(spark):
    tree = [sharding.Shard(i, f"r{i // 2}", "k", 1.0 + (i == 3)) for i in range(4)]
    heavier = [sharding.Shard(x.shard, x.region, x.rack, 4.0 if x.shard == 3 else x.weight) for x in tree]
    rows = spark.range(20_000).select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), heavier).alias("b")).collect()
    share = [sum(r.a == i for r in rows) / len(rows) for i in range(4)]
    assert np.allclose(share, [0.2, 0.2, 0.2, 0.4], atol=0.02)
    # nothing moves inside the region whose weights stay
    assert all(r.b == r.a or r.b // 2 == 1 for r in rows)


def test_bpe_round_trip(docs, none):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokenizer = bpe.tokenizer_of_ranks(ranks, public_tokenizers.PATTERN)
    encoded = bpe.bpe_encode(docs, tokenizer, offsets=True)
    found = encoded.collect()
    want = {(i, t or ""): reference.encode_ordinary(t or "") for i, t in ROWS}
    assert sorted(map(repr, ((r.doc_id, r.ids) for r in found))) == sorted(map(repr, ((i, want[i, t or ""]) for i, t in ROWS)))
    for r in bpe.bpe_decode(encoded, tokenizer).collect():
        assert bytes(r.decoded).decode() in {t or "" for _, t in ROWS} and r.whole
    text = "é😀 " * 50
    starts = next(r.starts for r in found if r.doc_id == 12)
    spelled = [reference.decode_single_token_bytes(i) for i in want[12, text]]
    at, places = 0, []
    for s in spelled:
        places.append(len(text.encode()[: at + 1].decode("utf-8", "ignore")) - (0 if (text.encode()[at] & 0xC0) == 0x80 else 0))
        at += len(s)
    characters = np.cumsum([(b & 0xC0) != 0x80 for b in text.encode()]) - 1
    assert starts == [int(characters[sum(map(len, spelled[:k]))]) for k in range(len(spelled))]
    half = docs.sparkSession.createDataFrame([(1, want[12, text][:1])], "doc_id long, ids array<int>")
    assert bpe.bpe_decode(half, tokenizer).first().decoded == spelled[0]
    assert bpe.bpe_encode(none, tokenizer).count() == 0


def test_encoder_equals_library_on_odd_texts():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.PieceEncoder(packing_tokenizer(), cache_pieces=50)
    import pyarrow as pa

    random = np.random.default_rng(0)
    alphabet = list("ab'sté1. \n\t 　 \x1c\r-") + ["  ", "don't", "😀", "<|endoftext|>"]
    texts = ["".join(random.choice(alphabet, random.integers(0, 40))) for _ in range(400)]
    ids, at = encoder.encode(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [reference.encode_ordinary(t) for t in texts]


def test_packing(docs, none):
    rows = packing.pack_powers_of_two(docs, packing_tokenizer(), longest=64, with_ids=True).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows))) and packing.pack_powers_of_two(none, packing_tokenizer()).count() == 0
    assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and len(r.ids) == r.length and r.offset == 0 for r in rows)
    by_length = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert by_length == sorted(by_length, reverse=True)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    pieces = sorted((r.start, r.length) for r in rows if r.doc_id == 9)
    assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) == next(r.doc_tokens for r in rows if r.doc_id == 9)
    assert [(r.length, r.ids) for r in rows if r.doc_id == 5] == [(1, [1])]
    row, start, length = packing.pieces_of(np.array([2048 * 2 + 5, 1, 3]), 2048)
    assert row.tolist() == [0, 0, 0, 0, 1, 2, 2] and start.tolist() == [0, 2048, 4096, 4100, 0, 0, 2] and length.tolist() == [2048, 2048, 4, 1, 1, 2, 1]
    # ids against the library, joined over the pieces of each row
    library = Tokenizer.from_str(packing_tokenizer())
    library.encode_special_tokens = True
    want = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids) + (1,) for _, t in ROWS)
    few = docs.sparkSession.createDataFrame([(k, t) for k, (_, t) in enumerate(ROWS)], "doc_id long, text string")
    by = {}
    for r in packing.pack_powers_of_two(few, packing_tokenizer(), longest=64, with_ids=True).collect():
        by.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert sorted(tuple(i for _, ids in sorted(x) for i in ids) for x in by.values()) == want
    assert sum(r.length for r in rows if r.doc_id is None) == sum(len(w) for w, (i, _) in zip([tuple(library.encode(t or "", add_special_tokens=False).ids) + (1,) for _, t in ROWS], ROWS) if i is None)


def shingles(text, size):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components_of(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("small,block", [(50, 500), (1, 7)])
def test_near_dedup_equals_brute_force(spark, small, block):
    random = np.random.default_rng(7)
    texts = {}
    for i in range(150):
        w = prose(i % 12, 80).split()
        for _ in range(random.integers(0, 4)):
            w[random.integers(len(w))] = "edit" + str(random.integers(99))
        texts[i + 5] = " ".join(w)
    sets = {i: shingles(t, 3) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components_of(sets, links)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = near_dedup.near_dedup(df, shingle=3, percent=85, small=small, block=block).collect()
    assert {r.doc_id: r.component_id for r in found} == want and all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(sets[r.doc_id]) for r in found)


def test_near_dedup_awkward(docs, none):
    found = near_dedup.near_dedup(docs, shingle=3, percent=85)
    assert found.count() == len(ROWS) and near_dedup.near_dedup(none).count() == 0
    by = {r.doc_id: r for r in found.collect() if r.doc_id is not None}
    assert all(by[i].component_id == 1 for i in (1, 2, 3, 4)) and by[11].component_id == 10
    assert all(by[i].component_id == i and by[i].n_shingles == 0 and by[i].kept for i in (5, 6, 7)) and by[8].n_shingles == 1
    assert all(not r.kept and r.component_id is None for r in found.collect() if r.doc_id is None)


def test_line_dedup_equals_brute_force(spark, docs, none):
    random = np.random.default_rng(2)
    texts = {}
    for i in range(60):
        lines = []
        for _ in range(random.integers(1, 5)):
            w = prose(random.integers(15), random.integers(1, 30)).split()
            if random.random() < 0.5:
                w[random.integers(len(w))] = "New"
            lines.append(" ".join(w) if random.random() < 0.9 else "")
        texts[i] = "\n".join(lines)
    seen, want = [], {}
    for i, t in texts.items():
        kept = []
        for k, line in enumerate(t.split("\n")):
            s = set(line.lower().split())
            if s and any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                want.setdefault(i, []).append(k)
            else:
                kept.append(line)
            if s:
                seen.append(s)
        texts[i] = (t, "\n".join(kept))
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    found = line_dedup.line_dedup(df).collect()
    assert {r.doc_id: r.removed for r in found if r.removed} == want
    assert all(r.text == texts[r.doc_id][1] and r.n_lines == texts[r.doc_id][0].count("\n") + 1 for r in found)
    rows = line_dedup.line_dedup(docs, carry=("row", "removed", "lang"))
    assert rows.count() == len(ROWS) and rows.columns[-3:] == ["row", "removed", "lang"] and line_dedup.line_dedup(none).count() == 0
    by = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert by[5].text is None and by[5].n_lines == 0 and by[6].text == "" and by[6].n_lines == 1 and by[1].n_removed == by[2].n_removed == 1


def test_line_dedup_plans_stay_small(docs, monkeypatch):
    """No plan spells out the rarity table, which the driver would then hold once for every description of a plan."""
    plans, cut = [], line_dedup.cut
    monkeypatch.setattr(line_dedup, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    line_dedup.line_dedup(docs)
    assert plans and max(map(len, plans)) < 100_000


def test_line_dedup_first_pairs_leave_out_what_differs(spark):
    """Lines that share a rare word and nothing else make no pairs; a line's words that no other line has aren't in its prefix."""
    random = np.random.default_rng(5)
    lines = [" ".join(["rare", *(f"u{i}x{k}" for k in range(3)), *random.choice(WORDS, 30)]) for i in range(40)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lines, lines[0] + " more"])], "doc_id long, text string")
    made, first = [], line_dedup._first_pairs
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(line_dedup, "_first_pairs", lambda classes, percent: made.append((classes.collect(), first(classes, percent).count())) or first(classes, percent))
        found = line_dedup.line_dedup(df).where("n_removed > 0").collect()
    assert [r.doc_id for r in found] == [40]
    classes, pairs = made[0]
    assert pairs <= 4, pairs
    assert all(len(r.prefix) < -(-r.n // 5) for r in classes if r["first"].row in range(1, 40))



def test_embeddings_equal_brute_force(spark):
    random = np.random.default_rng(0)
    x = random.normal(size=(300, 20))
    x[50:120] = x[10] + random.normal(size=(70, 20)) * 0.1
    x[200:210] = x[5]
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    odd = [(900, None), (901, []), (902, [0.0] * 20), (903, [float("nan")] * 20), (904, [float("inf")] * 20), (905, [1.0] * 3), (906, [1.0] * 3), (None, [1.0] * 3), (907, [None, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.95
    links = [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b]
    want = components_of(range(300), links)
    found = {r.vec_id: r for r in embedding_dedup.embedding_dedup(df, block=40).collect()}
    assert len(found) == len(rows) + len(odd)
    assert all(found[i].component_id == want[i] and found[i].n_links == near[i].sum() - 1 for i in range(300))
    assert all(found[i].n_links == 0 and found[i].kept for i in (900, 901, 902, 903, 904, 907))
    assert found[906].component_id == 905 and found[905].n_links == 1 and found[None].component_id is None
    assert embedding_dedup.embedding_dedup(df.where("vec_id > 5000")).count() == 0


def test_pii(spark, docs, none):
    texts = [f"please write to user{i}@mail.com for the account now" for i in range(6)] + [f"please write to AB-{i}8812x for the account now" for i in range(3)]
    texts += ["the number 778812x is fine here", "+1 (663) 555-6869 é 4111 1111 1111 1111 😀 1.2.3.4.5.6.7.8 300.1.1.1 4111111111111112", None, "", "1" * 30_000, "a@b.c_d@e.f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.s for r in pii.pii(df).select("doc_id", pii.joined(F.col("spans")).alias("s")).collect()}
    assert found[0] == "email:16:30" and found[6] == "id:16:25" and found[9] == ""
    assert found[10] == "phone:0:17,card:20:39,ip:42:49,ip:50:57"
    assert found[11] == found[12] == found[13] == "" and found[14] == "email:0:5,email:5:11"
    masked = {r.doc_id: r.text for r in pii.mask_documents(df).collect()}
    assert masked[6] == "please write to <ID> for the account now" and masked[11] is None and masked[9] == texts[9]
    assert pii.pii(docs).count() == len(ROWS) and pii.pii(none).count() == 0
    assert pii.mask_documents(docs).columns == docs.columns and pii.mask_documents(docs).count() == len(ROWS)


def test_pii_identifier_beside_a_card(spark):
    """What else a text holds doesn't refute a token, and contexts reach over other matches."""
    seeds = [f"please write to user{i}@mail.com for the account now" for i in range(6)]
    card, line = "4111 1111 1111 1111", "please write to AB-88125x for the account now"
    texts = [*seeds, line, f"{line} {card}", f"{card[:-1]}2 {line}", f"{'é😀 ' * 700}{line} {card}", "reach +1 88125-x77 soon", "please write to 4111111111111112 for the account now"]
    # the words before the second address are the first one's
    texts += [f"copy to a{i}@b.com box{i}@c.com end" for i in range(4)] + ["copy to a0@b.com AB-77125x end"] * 3 + [f"reach +1 u{i}@d.com soon" for i in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.s for r in pii.pii(df, support=1).select("doc_id", pii.joined(F.col("spans")).alias("s")).collect()}
    assert found[6] == "id:16:25" and found[7] == "id:16:25,card:46:65" and found[8] == "id:36:45"
    assert found[9] == "id:2116:2125,card:2146:2165" and found[10] == "id:9:18" and found[11] == ""
    assert found[16] == "email:8:16,id:17:26"
    n, text = 300, "".join(f"é{i} 123456 \n" for i in range(300))
    row = spark.createDataFrame([(text,)], "text string").select(pii.with_context(F.col("text"), F.transform(pii.find(F.col("text"), "123456"), lambda m: m.withField("seed", F.lit(False)))).alias("m")).first()
    assert len(row.m) == n and all((m.left, m.right) == (text[max(0, m.start - 48) : m.start], text[m.end : m.end + 48]) and text[m.start : m.end] == "123456" for m in row.m)


def test_pii_discoveries_support_further_patterns(spark):
    """Identifiers beside seeds support a pattern that no seed is near; a pattern of unknown tokens stays untrusted."""
    names = [f"AB-{i}8812x" for i in range(4)]
    texts = [f"please write to user{i}@mail.com for the account now" for i in range(8)] + [f"please write to {n} for the account now" for n in names]
    texts += [f"badge of holder {n} expires" for n in names] + ["badge of holder QQ-90013z expires"] + [f"part no {i}77{i}1-a in stock" for i in range(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.s for r in pii.pii(df).select("doc_id", pii.joined(F.col("spans")).alias("s")).collect()}
    assert all(found[i] == "id:16:25" for i in range(8, 17))
    assert all(found[i] == "" for i in range(17, 26))
    one_hop = {r.doc_id: r.s for r in pii.pii(df, rounds=2).select("doc_id", pii.joined(F.col("spans")).alias("s")).collect()}
    assert one_hop[8] == "id:16:25" and one_hop[16] == ""


def test_pii_base_spans_are_the_plain_expressions(spark):
    """Base spans of random texts against Python's re and the contract's own expressions."""
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, value):
        digits = [int(c) for c in value if c.isdigit()]
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    draw = np.random.default_rng(5)
    parts = ["4111 1111 1111 1111", "5500-0000-0000-0004", "+1 (663) 555-6869", "a.b@c.de", "10.0.0.255", "256.1.1.1", "é", "😀", " ", "  ", "\n", ".", "@", "-", "+", "x1", "0", "12", "..", "word"]
    texts = ["".join(draw.choice(parts, 14)) for _ in range(600)]
    want = []
    for text in texts:
        spans = sorted((m.start(), rank, m.end(), kind) for rank, (kind, e) in enumerate(plain.items()) for m in re.finditer(e, text) if good(kind, m[0]))
        want.append(",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = F.filter("spans", lambda s: s["kind"] != pii.EXTRA)
    found = {r.doc_id: r.s for r in pii.pii(df).select("doc_id", pii.joined(base).alias("s")).collect()}
    assert [found[i] for i in range(600)] == want and sum(map(len, want)) > 5000


def test_quality(spark, docs, none):
    rows = [(i, (prose(i, 60) if i % 3 else prose(i, 60).upper().replace(" ", "!! ")), 0, int(i % 3 > 0)) for i in range(300)]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] < 200] + [(None, 1), (7, None), (9999, 1)], "doc_id long, quality int")
    machine = quality.learn_quality(df, labels)
    found = {r.doc_id: r.score for r in quality.score_quality(df, machine).collect()}
    assert np.mean([(found[r[0]] >= 0.5) == r[3] for r in rows[200:]]) > 0.95
    scores = [r.score for r in quality.score_quality(docs, machine).collect()]
    assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores) and quality.score_quality(none, machine).count() == 0
    blank = quality.learn_quality(df, labels.where("doc_id > 5000"))
    assert {r.score for r in quality.score_quality(df, blank).collect()} == {0.5}


def test_pairwise_identity():
    random = np.random.default_rng(1)
    fm = quality.FactorisationMachine(0.3, random.normal(size=9).astype(np.float32), random.normal(size=(9, 4)).astype(np.float32), 3)
    ids, x = np.array([1, 4, 7]), np.array([0.5, -1.0, 2.0], np.float32)
    want = 0.3 + (fm.w[ids] * x).sum() + sum(fm.v[ids[a]] @ fm.v[ids[b]] * x[a] * x[b] for a in range(3) for b in range(a + 1, 3))
    assert np.isclose(fm.margin(ids, x, np.array([0, 3]))[0][0], want, atol=1e-4)


def test_language(spark, docs, none):
    english, german = "the and of to with that this from have were " * 12, "der die und nicht ist mit eine von sich auf " * 12
    train = spark.createDataFrame([(1, english, "en"), (2, german, "de"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    model = langid.LanguageModel.learn(train)
    asked = spark.createDataFrame([(1, english), (2, german), (3, english * 3 + german), (4, None), (5, "12 !!"), (6, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in langid.identify(asked, model).collect()}
    assert [found[i].lang_pred for i in range(1, 7)] == ["en", "de", "en", "und", "und", "und"]
    assert set(found[3].languages) == {"en", "de"} and 0.6 < found[3].score < 0.9 and set(found[1].languages) == {"en"}
    rows = langid.identify(docs, model, carry=("id", "lang"))
    assert rows.count() == len(ROWS) and rows.columns[-2:] == ["id", "lang"] and langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(asked, langid.LanguageModel.learn(none)).collect()} == {"und"}


def test_language_rows_dont_depend_on_their_neighbours():
    texts = ["hello", "hi yo", "", "a", "\u00e9t\u00e9 " * 300, "hi yo"]
    alone = [langid.gram_buckets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 15).tolist() if t else [] for t in texts]
    for order in (range(6), [5, 4, 3, 2, 1, 0], [2, 3, 1, 0, 4, 5]):
        data = np.frombuffer("".join(texts[i] for i in order).encode(), np.uint8)
        at = np.cumsum([0] + [len(texts[i].encode()) for i in order])
        found = langid.gram_buckets(data, at, 15).tolist()
        assert [found[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == [alone[i] for i in order]
    table = np.random.default_rng(0).random((1 << 15, 3)).astype(np.float32)
    buckets = np.arange(1000) * 7
    begins = np.arange(0, 1000, 64)
    assert np.allclose(langid._segment_sums(table, buckets, begins, 3), np.add.reduceat(table[buckets], begins, axis=0), rtol=1e-4)


def test_language_stage_keeps_mixed_and_unknown(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    words = {"en": "the and of to with that this from have were ", "de": "der die und nicht ist mit eine von sich auf ", "fr": "les une dans pour que est sur pas vous avec "}
    mixed = words["en"] * 16 + words["de"] * 12 + words["fr"] * 12
    rows = [(i, w * 12, lang) for i, (lang, w) in enumerate(words.items())] + [(3, mixed, None), (4, None, None), (5, "12 !!", "en"), (6, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixture = langid.identify(df.where("doc_id = 3"), langid.LanguageModel.learn(df)).first()
    assert set(mixture.languages) == set(words) and mixture.score < 0.5
    found = corpus_pipeline.language_stage(spark, df, "")
    assert found.columns == df.columns and {r.doc_id: r.text for r in found.collect()} == {i: t for i, t, _ in rows[:4]}
    # no language is known
    bare = df.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_stage(spark, bare, "").count() == len(rows)
    # a language of that name isn't a rejection
    unnamed = df.withColumn("lang", F.lit("und"))
    assert sorted(r.doc_id for r in corpus_pipeline.language_stage(spark, unnamed, "").collect()) == [0, 1, 2, 3]


def test_components(spark):
    random = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    want = components_of({x for e in edges for x in e}, edges)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(want[k] == v for k, v in found.items()) and all(k in found for e in edges for k in e if e[0] != e[1])


def test_pieces_end_to_end_keep_their_ids():
    """Pieces that go end to end through the tokenizer, those that can't, and texts around the cache's restarts."""
    import pyarrow as pa

    spec = packing_tokenizer()
    plain, encoder, handed = Tokenizer.from_str(spec), bpe.PieceEncoder(spec, cache_pieces=40), []
    plain.encode_special_tokens = True

    class Watched:
        def encode_batch_fast(self, texts, **how):
            handed.extend(texts)
            return plain.encode_batch_fast(texts, **how)

    encoder.tokenizer = Watched()
    texts = ["it's o'clock, don't 12.5 x", "a b\tc d\n\ne  f", " \u00fcber stra\u00dfe \u4f60\u597d \u3000x e\u0301t\u00e9", "<|endoftext|> end <|endoftext|>", "", " ", "q " * 300 + "z", "\u00a0a \u00a0 b\u00a0", "\U0001f600 \U0001f600\U0001f601 \x1c y"]
    for some in (texts, texts[::-1], [f"w{i} v{i}, u{i}." for i in range(60)]):
        ids, first = encoder.encode(pa.array(some, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [plain.encode(x, add_special_tokens=False).ids for x in some]
    assert any(" v1, u1. v2," in x for x in handed), handed[-3:]  # nothing between them


def test_line_feeds_are_pieces_of_their_own():
    """A word before a line feed and the one behind it are no piece together, of which there would be one for each pair."""
    import pyarrow as pa

    spec = packing_tokenizer()
    plain, encoder = Tokenizer.from_str(spec), bpe.PieceEncoder(spec)
    texts = pa.array(["a b\nc d.\nc e", "", "f\ng", "h"], pa.large_string())
    pieces, at = encoder.pieces(texts)
    assert pieces.to_pylist() == ["a", " b", "\n", "c", " d.", "\n", "c", " e", "", "f", "\n", "g", "h"] and at.tolist() == [0, 8, 9, 12, 13]
    ids, first = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [plain.encode(x, add_special_tokens=False).ids for x in texts.to_pylist()]
