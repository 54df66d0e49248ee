"""Line deduplication by an exact set-similarity join, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagelake.llm.shared import broadcast_if_small, cut, discard

NO_ID = -(1 << 63)
SIGNATURE = ("s0", "s1", "s2", "s3")
SENT = {"s1": 48, "s2": 160, "s3": 160}  # the words from which a set has these parts of its signature
LONG = 64  # sets of so many words send the parities of half their words and s1 through the join, the others those of all


def _placed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(row, text_key, text): row and text_key stand for the document."""
    text = F.col(text_column).cast("string")
    return docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("row"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def tokens(line: Column) -> Column:
    """The words of a line in lower case; ASCII white space parts them."""
    lower = F.lower(line)
    odd = [F.contains(line, F.lit(c)) for c in "\t\x0b\x0c\r"]
    plain = F.when(odd[0] | odd[1] | odd[2] | odd[3], F.translate(lower, "\t\x0b\x0c\r", "    ")).otherwise(lower)
    return F.split(plain, " ")


def rarity_table(docs: DataFrame, text_column: str, bits: int) -> DataFrame:
    """One row (rarity array<tinyint>) with a number for each of 2**bits hash buckets of words: six times the logarithm of the words counted there, at most 127.

    It is 0 only where one word was counted once, which no other line can share. Counts cover all words of all documents.
    The driver gets one number per bucket, at every size of the input. As a table of one row it is read by a scalar subquery; a literal
    would be written out in every description of a plan.
    """
    text = F.replace(F.col(text_column).cast("string"), F.lit("\n"), F.lit(" "))
    bucket = F.shiftrightunsigned(F.xxhash64("word"), 64 - bits).cast("int")
    words = docs.select(F.explode(tokens(text)).alias("word")).where("word <> ''")
    found = words.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    scaled = F.least(F.lit(127), F.floor(6 * F.log("n"))).cast("tinyint")
    counted = cut(found.select("bucket", scaled.alias("rank")))
    bucket, rank = (c.to_numpy() for c in counted.toArrow().columns)
    discard(counted)
    table = np.ones(1 << bits, np.int8)
    table[bucket] = rank
    one = pa.table({"rarity": pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), pa.array(table))})
    return docs.sparkSession.createDataFrame(one, "rarity array<tinyint>")


def ordered_tokens(line: Column, rarity: Column, bits: int) -> Column:
    """A line's distinct words as numbers, the rarest first: the bucket's rarity in the top byte, then 56 bits of hash."""

    def number(h: Column) -> Column:
        rank = F.get(rarity, F.shiftrightunsigned(h, 64 - bits).cast("int"))
        return F.shiftleft(rank.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    return F.sort_array(F.array_distinct(F.transform(F.transform(F.array_remove(tokens(line), ""), lambda word: F.xxhash64(word)), number)))


def signature(words: str) -> list[Column]:
    """Four numbers of 64 bits, each bit the parity of the words that hash to it: s0 of all words, s1 of a half, s2 and s3 of a quarter of that and of the other half.

    Small sets have zero for the later ones, see SENT. Two sets differ in as many words as their signatures in bits, or more; see differing_bits.
    """
    long = lambda n: F.lit(n).cast("long")
    flip = lambda bits, w: bits.bitwiseXOR(F.call_function("shiftleft", long(1), w.bitwiseAND(long(63)).cast("int")))

    def part(name: str, mask: int, marks: int) -> Column:
        bits = F.aggregate(words, long(0), lambda bits, w: F.when(w.bitwiseAND(long(mask)) == marks, flip(bits, w)).otherwise(bits))
        return F.when(F.size(words) >= SENT[name], bits).otherwise(long(0)).alias(name)

    return [F.aggregate(words, long(0), flip).alias("s0"), part("s1", 64, 64), part("s2", 192, 192), part("s3", 192, 128)]


def differing_bits(mine: Callable[[str], Column], other: Callable[[str], Column]) -> Column:
    """A lower bound of the words that two sets differ in, from all of their sizes n and signatures."""
    s0, s1, s2, s3 = (mine(c).bitwiseXOR(other(c)) for c in SIGNATURE)
    ones, least = F.bit_count, F.least(mine("n"), other("n"))
    rest = s0.bitwiseXOR(s1)
    quarters = ones(s2) + ones(s1.bitwiseXOR(s2)) + ones(s3) + ones(rest.bitwiseXOR(s3))
    return F.when(least >= SENT["s2"], quarters).when(least >= SENT["s1"], ones(s1) + ones(rest)).otherwise(ones(s0))


def _line_rows(docs: DataFrame, id_column: str, text_column: str, rarity: DataFrame, bits: int, percent: int) -> DataFrame:
    """(row, text_key, line_no, n, set, s0 to s3, skipped, prefix) of each line with a word.

    set is a 64-bit hash of the set of words, s0 to s3 its signature. prefix holds the words among which a similar set of
    any length has one, without the first ones, skipped of them, that no other line has; sets too small to differ from a similar one have none.
    """
    n = F.col("n")
    prefix_size = F.when(n * (100 - percent) >= percent, n - F.ceil(F.lit(percent) * n / 100) + 1).otherwise(0)
    lines = _placed(docs, id_column, text_column).select("row", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.where(F.btrim("line", F.lit(" \t\x0b\x0c\r")) != "").select("row", "text_key", "line_no", "line", rarity.scalar().alias("rarity"))
    lines = lines.select("row", "text_key", "line_no", ordered_tokens(F.col("line"), F.col("rarity"), bits).alias("words"))
    lines = lines.select("row", "text_key", "line_no", F.size("words").alias("n"), F.xxhash64("words").alias("set"), *signature("words"), "words")
    lines = lines.select("row", "text_key", "line_no", "n", "set", *SIGNATURE, F.slice("words", 1, prefix_size.cast("int")).alias("prefix"))
    shared = F.filter("prefix", lambda w: w >= F.lit(1 << 56))
    return lines.select("row", "text_key", "line_no", "n", "set", *SIGNATURE, F.size("prefix").alias("skipped"), shared.alias("prefix")).withColumn("skipped", F.col("skipped") - F.size("prefix"))


def _sets_of(docs: DataFrame, id_column: str, text_column: str, rarity: DataFrame, bits: int, wanted: DataFrame) -> DataFrame:
    """(class, words array<long>) of the lines in wanted (class, row, text_key, line_no): their whole sets."""
    asked = wanted.groupBy("row", "text_key").agg(F.collect_list(F.struct("line_no", "class")).alias("asked"))
    found = _placed(docs, id_column, text_column).join(broadcast_if_small(asked, wanted.count(), 40), ["row", "text_key"])
    # the array around the lines has them made once for all places
    lines = F.transform(F.array(F.split("text", "\n", -1)), lambda each: F.transform("asked", lambda a: F.struct(a["class"].alias("class"), F.get(each, a["line_no"]).alias("line"))))
    found = found.select(F.explode(F.element_at(lines, 1)).alias("found")).select("found.class", "found.line", rarity.scalar().alias("rarity"))
    return found.select("class", ordered_tokens(F.col("line"), F.col("rarity"), bits).alias("words"))


def line_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 80, rarity_bits: int = 21, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes every line that is similar to an earlier line of any document.

    A line is the set of its lower-case words; two lines are similar if their Jaccard similarity is percent / 100 or
    more. Earlier means a smaller doc_id, then a smaller place in the text. The join is exact: a line's words are
    ordered by rarity over the whole corpus, similar lines share a word in their prefixes, lengths and positions
    and bit signatures sieve the pairs, and the rest is verified on full sets. Words are compared by 56 bits of hash and the
    rarity of their bucket; equal sets are one class, told apart by 128 bits and their size. Each class first meets
    the earliest class of each of its rarest words and its length; those that find no match there meet all
    earlier ones of the words of their prefixes and fitting lengths.

    Returns (doc_id, n_lines, n_removed, removed array<int>, text): removed holds places from 0, text is what is left, its
    lines joined again. Lines without a word are never removed. A null text has no lines and stays null; an empty one has
    one. A null doc_id counts as the earliest. Rows that repeat a doc_id and its text get the same result and
    don't remove each other's lines. An empty table gives no rows. Columns named in carry follow as they
    are; others are not read.
    """
    removed = cut(removed_lines(docs, id_column, text_column, percent, rarity_bits))
    size = removed.agg(F.count("*"), F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()
    text = F.col(text_column).cast("string")
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long")
    keyed = docs.select(F.col(id_column).alias("id"), text.alias("text"), n_lines.alias("n_lines"), F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("row"), F.xxhash64(text).alias("text_key"), *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)])
    lines = F.split("text", "\n", -1)
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    left = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains(gone, i)), "\n")
    return keyed.join(broadcast_if_small(removed, size[0], 64 + 4 * size[1] // max(1, size[0])), ["row", "text_key"], "left").select(
        F.col("id").alias(id_column),
        "n_lines",
        F.size(gone).cast("long").alias("n_removed"),
        gone.alias("removed"),
        F.when(F.size(gone) == 0, F.col("text")).otherwise(left).alias("text"),
        *[F.col(f"carried_{k}").alias(c) for k, c in enumerate(carry)],
    )


def removed_lines(docs: DataFrame, id_column: str, text_column: str, percent: int, rarity_bits: int) -> DataFrame:
    """(row, text_key, removed array<int>) of the documents that lose lines."""
    rarity = rarity_table(docs, text_column, rarity_bits)
    lines = cut(_line_rows(docs, id_column, text_column, rarity, rarity_bits, percent))
    at, same = F.struct("row", "text_key", "line_no"), ["set", "s0", "n"]
    # a class is a set; its first line stands for it, and its number is short and its own
    classes = lines.groupBy(*same).agg(F.min(at).alias("first"), F.count("*").alias("copies"), *[F.any_value(c).alias(c) for c in (*SIGNATURE[1:], "skipped", "prefix")])
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))
    places = cut(lines.select("row", "text_key", "line_no", *same))
    discard(lines)
    tried = cut(_first_pairs(classes, percent))
    matched = _later(docs, id_column, text_column, rarity, rarity_bits, tried, classes, percent)
    rest = cut(_unmatched_pairs(classes, tried, matched, percent))
    late = matched.union(_later(docs, id_column, text_column, rarity, rarity_bits, rest, classes, percent, matched)).withColumn("late", F.lit(True))
    losing = cut(classes.select("class", *same, "first", "copies").join(late, "class", "left").where("copies > 1 or late").select(*same, "first", "late"))
    discard(tried, rest, classes)
    return (
        places.join(broadcast_if_small(losing, losing.count(), 80), same)
        .where(F.col("late").isNotNull() | (F.col("first") != at))
        .groupBy("row", "text_key")
        .agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    )


def _fits(percent: int, n_a: Column, pos_a: Column, n_b: Column, pos_b: Column) -> Column:
    """Length filter, and positional filter: this word and what follows it must suffice for the overlap."""
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * (1 + F.least(n_a - pos_a - 1, n_b - pos_b - 1)) >= percent * (n_a + n_b))


def _length_class(size: Column, percent: int) -> Column:
    """Lengths of similar sets lie in one length class or in neighbouring ones, half of them in one."""
    return F.floor(F.log(size.cast("double")) / math.log(max(100 / percent, 1.01) ** 2)).cast("int")


def _length_class_of(size: int, percent: int) -> int:
    return math.floor(math.log(size) / math.log(max(100 / percent, 1.01) ** 2))


def _folded(bits: Column) -> Column:
    """A signature of 46 bits out of one of 64."""
    return bits.bitwiseXOR(F.shiftrightunsigned(bits, 46)).bitwiseAND(F.lit((1 << 46) - 1))


def _first_pairs(classes: DataFrame, percent: int, heads: int = 3, pivots: int = 4) -> DataFrame:
    """(a, b): each class with some early ones of each of its rarest words and its length class, where the two fit.

    A word's classes are dealt to as many parts as pivots; the earliest of each part is one. Pairs whose s0 differ too much
    are left out at once. Large groups of near copies find
    their match here, in at most so many pairs a member.
    """
    rows = classes.where(F.size("prefix") > 0).select("class", F.col("first.row").alias("row"), "n", "s0", "skipped", F.posexplode(F.slice("prefix", 1, heads)).alias("pos", "token"))
    rows = rows.select(F.xxhash64("token", _length_class(F.col("n"), percent)).alias("key"), "class", "row", "s0", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR((F.col("skipped") + F.col("pos")).cast("long")).alias("at"))
    size, place = (lambda c: F.shiftrightunsigned(c, 32).cast("int")), (lambda c: c.bitwiseAND(F.lit((1 << 31) - 1).cast("long")).cast("int"))
    part = F.pmod(F.xxhash64("class"), F.lit(pivots))
    # numbers only, for which Spark aggregates without sorting
    earliest = [[F.min_by(F.when(part == k, F.col(c)), F.when(part == k, F.col("row"))).alias(f"{c}_{k}") for c in ("class", "at", "s0")] for k in range(pivots)]
    early = rows.groupBy("key").agg(*[c for pair in earliest for c in pair], F.count("*").alias("size")).where("size > 1").drop("size")
    pivot = F.explode(F.array(*[F.struct(*[F.col(f"{c}_{k}").alias(c) for c in ("class", "at", "s0")]) for k in range(pivots)]))
    pairs = rows.join(early, "key").select("class", "at", "s0", pivot.alias("pivot")).where("class <> pivot.class")
    apart = F.bit_count(F.col("s0").bitwiseXOR(F.col("pivot.s0")))
    pairs = pairs.where((100 + percent) * apart <= (100 - percent) * (size(F.col("at")) + size(F.col("pivot.at"))))
    pairs = pairs.where(_fits(percent, size(F.col("at")), place(F.col("at")), size(F.col("pivot.at")), place(F.col("pivot.at"))))
    return pairs.select(F.least("class", "pivot.class").alias("a"), F.greatest("class", "pivot.class").alias("b")).distinct()


def _unmatched_pairs(classes: DataFrame, tried: DataFrame, matched: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of classes, not both matched, that share a word of their prefixes and fit.

    A class probes with its whole prefix at its own length class. It is indexed with the shorter prefix that suffices to
    meet sets as long or longer, at the length classes these can have. Matched classes needn't meet each other: they
    probe under keys of their own, where the unmatched ones are indexed as far as matched ones look there. A very frequent
    word's pairs are spread by Spark's skew join.
    """
    done = broadcast_if_small(matched.withColumn("done", F.lit(1)), matched.count(), 16)
    n, pos = F.col("n"), F.col("pos")
    sets = classes.where(F.size("prefix") > 0).join(done, "class", "left").select("class", "n", F.coalesce("done", F.lit(0)).alias("done"), "skipped", "prefix", *SIGNATURE)
    probe = sets.withColumn("length", _length_class(n, percent)).select("class", "n", "done", *SIGNATURE, "length", "skipped", F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("skipped") + F.col("pos"))
    shorter = F.slice("prefix", 1, F.greatest(F.lit(0), n - F.ceil(F.lit(2 * percent) * n / (100 + percent)) + 1 - F.col("skipped")).cast("int"))
    lengths = F.sequence(_length_class(n, percent), _length_class(F.floor(n * 100 / percent), percent))
    index = sets.select("class", "n", "done", *SIGNATURE, F.explode(lengths).alias("length"), "skipped", shorter.alias("shorter")).select("class", "n", "done", *SIGNATURE, "length", "skipped", F.posexplode("shorter").alias("pos", "token")).withColumn("pos", F.col("skipped") + F.col("pos"))
    key = lambda turn: F.xxhash64("token", "length", turn).alias("key")
    # a bit for the keys asked for, in 2**18 words at most: some keys share bits, which lets more of the index through
    word, bit = F.shiftrightunsigned("key", 46).alias("word"), F.col("key").bitwiseAND(F.lit(63).cast("long")).cast("int")
    asked = probe.where("done = 1").select(key(F.lit(1)))
    asked = cut(asked.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")))

    def asked_for(rows: DataFrame) -> DataFrame:
        found = rows.join(F.broadcast(asked), F.shiftrightunsigned("key", 46) == F.col("word"))
        return found.where(F.call_function("shiftrightunsigned", F.col("bits"), bit).bitwiseAND(F.lit(1).cast("long")) == 1).select(*rows.columns)

    def met(some: Column, sent: list[Column | str]) -> DataFrame:
        """Pairs of rows of one key, those of the index with o_ before their names."""
        own = probe.where(some).select(key(F.col("done")), "class", *sent)
        at = lambda rows, done: rows.where(some).select(key(F.lit(done)), "class", *sent)
        others = at(index, 0).union(asked_for(at(index.where("done = 0"), 1)))
        return own.join(others.toDF("key", *[f"o_{c}" for c in others.columns[1:]]), "key").where("class <> o_class")

    def fit(size: Column, place: Column, o_size: Column, o_place: Column, apart: Column) -> Column:
        once = (o_size < size) | ((o_size == size) & (F.col("o_class") < F.col("class")))
        return once & ((100 + percent) * apart <= (100 - percent) * (size + o_size)) & _fits(percent, size, place, o_size, o_place)

    # in the lower length classes size, position and 46 bits of a signature travel as one number
    low = F.col("length") < _length_class_of(min(900, 25000 // max(1, 100 - percent)), percent)
    packed = F.shiftleft(n.cast("long"), 54).bitwiseOR(F.shiftleft(pos.cast("long"), 46)).bitwiseOR(_folded(F.when(n < LONG, F.col("s0")).otherwise(F.col("s0").bitwiseXOR(F.col("s1"))))).alias("packed")
    size, place = (lambda c: F.shiftrightunsigned(c, 54).cast("int")), (lambda c: F.shiftrightunsigned(c, 46).bitwiseAND(F.lit(0xFF).cast("long")).cast("int"))
    mine, other = F.col("packed"), F.col("o_packed")
    head = F.bit_count(mine.bitwiseXOR(other).bitwiseAND(F.lit((1 << 46) - 1)))
    sent = [F.col(c).bitwiseXOR(F.col(f"o_{c}")) for c in SENT]
    half = F.when((F.col("s1") != 0) & (F.col("o_s1") != 0), F.bit_count(sent[0])).otherwise(0)
    parts = F.bit_count(sent[1]) + F.bit_count(sent[0].bitwiseXOR(sent[1])) + F.bit_count(sent[2])
    least, most = F.least(size(mine), size(other)), F.greatest(size(mine), size(other))
    apart = F.when(least >= SENT["s2"], F.greatest(parts, head + half)).when(least >= LONG, head + half).when(most < LONG, F.greatest(head, half)).otherwise(half)
    rows = met(low, [packed, *SENT])
    found = rows.where(fit(size(mine), place(mine), size(other), place(other), apart)).select("class", "o_class")
    rows = met(~low, [n, pos, *map(F.col, SIGNATURE)])
    found = found.union(rows.where(fit(n, pos, F.col("o_n"), F.col("o_pos"), differing_bits(F.col, lambda c: F.col(f"o_{c}")))).select("class", "o_class"))
    pairs = found.select(F.least("class", "o_class").alias("a"), F.greatest("class", "o_class").alias("b")).distinct()
    return pairs.join(broadcast_if_small(tried, tried.count(), 24), ["a", "b"], "left_anti")


def _later(docs: DataFrame, id_column: str, text_column: str, rarity: DataFrame, bits: int, pairs: DataFrame, classes: DataFrame, percent: int, matched: DataFrame | None = None) -> DataFrame:
    """(class): the later class of each of the pairs (a, b) that is similar on full sets; classes matched before aren't looked at again.

    Only the lines that stand for the pairs' classes are ordered again.
    """
    of = lambda k: classes.select(F.col("class").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", *SIGNATURE)])
    apart = differing_bits(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b"))
    n_pairs = pairs.count()
    near = broadcast_if_small(broadcast_if_small(pairs, n_pairs, 16).join(of("a"), "a"), n_pairs, 56).join(of("b"), "b").where((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    near = cut(near.select("a", "b", "n_a", "n_b"))
    ids = cut(near.select(F.col("a").alias("class")).union(near.select(F.col("b").alias("class"))).distinct())
    wanted = cut(classes.select("class", "first").join(broadcast_if_small(ids, ids.count(), 16), "class", "left_semi"))
    n_wanted = wanted.count()
    first = lambda k: broadcast_if_small(wanted.select(F.col("class").alias(k), F.col("first").alias(f"first_{k}")), n_wanted, 40)
    near = near.join(first("a"), "a").join(first("b"), "b").withColumn("class", F.when(F.col("first_a") > F.col("first_b"), F.col("a")).otherwise(F.col("b"))).drop("first_a", "first_b")
    if matched is not None:
        near = near.join(broadcast_if_small(matched, matched.count(), 16), "class", "left_anti")
    # equal rows give a class several times
    sets = cut(_sets_of(docs, id_column, text_column, rarity, bits, wanted.select("class", "first.*")).dropDuplicates(["class"]))
    get = lambda k: sets.select(F.col("class").alias(k), F.col("words").alias(f"{k}_words"))
    both = F.size(F.array_intersect("a_words", "b_words"))
    good = near.join(get("a"), "a").join(get("b"), "b").where((100 + percent) * both >= percent * (F.col("n_a") + F.col("n_b")))
    late = cut(good.select("class").distinct())
    discard(ids, wanted, sets)
    return late
