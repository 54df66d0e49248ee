"""Personal data by bootstrapped contextual extraction, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imagelake.llm.shared import broadcast_if_small, cut

KINDS = ("email", "ip", "card", "phone")
EXTRA = "id"  # what the patterns discover
_LOCAL = "[A-Za-z0-9._%+-]"
#: What each kind's expression finds, leftmost and without overlaps, is what the plain one finds:
#:   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+    ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#:   card  [0-9]([\x20-]?[0-9])+                                phone \+[0-9][\x20().0-9-]+[0-9]
#: Possessive parts keep the time linear and the stack flat: a match starts where a run of its characters does, or
#: right behind the match before.
EXPRESSIONS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts that can hold a valid match of the kind: a cheap test before the expression runs.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": "+"}
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
#: Tokens that could be identifiers: 6 to 64 letters, digits, _ or -, at least four of them digits.
IDENTIFIER = r"(?<![A-Za-z0-9_-])(?=(?:[A-Za-z_-]*+[0-9]){4})[A-Za-z0-9_-]{6,64}+(?![A-Za-z0-9_-])"
CONTEXT = 48  # characters on each side in which the words of a pattern are looked for
_BLOCK = 1024  # characters of the pieces of a text in which a place is looked up; not below CONTEXT
_EMPTY = "array<struct<start:int,end:int,value:string>>"


def _running(numbers: Column) -> Column:
    """The running sums, by blocks of about the square root of the length, so that long arrays stay cheap."""
    plain = lambda a: F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    m = F.ceil(F.sqrt(F.size(numbers) + F.lit(1))).cast("int")
    inner = F.transform(F.sequence(F.lit(0), m), lambda i: plain(F.slice(numbers, i * m + 1, m)))
    base = plain(F.transform(inner, lambda x: F.element_at(x, -1)))
    return F.flatten(F.transform(F.arrays_zip(inner.alias("a"), F.slice(base, 1, m + 1).alias("b")), lambda z: F.transform(F.slice(z["a"], 2, F.size(z["a"]) - 1), lambda y: y + z["b"])))


def find(text: Column, expression: str) -> Column:
    """All matches as structs: start, end (code points, end exclusive), value.

    The pieces between matches and the matches themselves add up to the places.
    """
    pattern = F.lit(expression)
    rows = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"), F.split(text, expression, -1).alias("piece"))
    # the last piece has no match behind it; its length doesn't count
    steps = F.transform(rows, lambda r: F.struct(F.coalesce(r["value"], F.lit("")).alias("value"), (F.length(r["piece"]) + F.length(F.coalesce(r["value"], F.lit("")))).alias("n")))
    with_ends = F.arrays_zip(steps.alias("s"), _running(F.transform(steps, lambda s: s["n"])).alias("end"))
    return F.transform(
        F.slice(with_ends, 1, F.size(steps) - 1),
        lambda z: F.struct((z["end"] - F.length(z["s"]["value"])).alias("start"), z["end"].alias("end"), z["s"]["value"].alias("value")),
    )


def with_context(text: Column, matches: Column) -> Column:
    """The matches (start, end, value, seed) with left and right, the CONTEXT characters of the whole text on each side.

    A place is looked up in the piece of the text that holds it and the one next to it, so that long texts stay cheap.
    """
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    div = lambda at: F.call_function("div", at, F.lit(_BLOCK)).cast("int")
    block = lambda b, i: F.coalesce(F.get(b, i), F.lit(""))

    def one(b: Column, m: Column) -> Column:
        first, last = div(m["start"]), div(m["end"])
        before = F.concat(block(b, first - 1), F.left(block(b, first), m["start"] - first * _BLOCK))
        after = F.concat(F.substring(block(b, last), m["end"] - last * _BLOCK + 1, F.lit(_BLOCK)), block(b, last + 1))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), m["seed"].alias("seed"), F.right(before, F.lit(CONTEXT)).alias("left"), F.left(after, F.lit(CONTEXT)).alias("right"))

    # the array around blocks has them made once for all matches
    return F.element_at(F.transform(F.array(blocks), lambda b: F.transform(matches, lambda m: one(b, m))), 1)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    numbers = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _card_long(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(14, 19)


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": F.when(_card_long(value), luhn(digits)).otherwise(False),
        "phone": F.length(digits).between(10, 15),
    }[kind]


def _matches(text: Column, kind: str) -> Column:
    hint = _HINTS[kind]
    there = F.contains(text, F.lit(hint)) if len(hint) == 1 else text.rlike(hint)
    return F.when(there, find(text, EXPRESSIONS[kind])).otherwise(F.array().cast(_EMPTY))


def base_matches(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text_key, text, email, ip, card, phone, numbers): the valid matches of each kind, and all numbers as long as a card's."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    found = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    found = found.withColumn("numbers", F.filter(_matches(F.col("text"), "card"), lambda m: _card_long(m["value"])))
    keep = lambda kind: F.filter("numbers" if kind == "card" else _matches(F.col("text"), kind), lambda m: valid(kind, m["value"]))
    return found.withColumns({kind: keep(kind) for kind in KINDS})


def _words(context: Column) -> Column:
    return F.filter(F.split(F.lower(context), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def patterns_of(left: Column, right: Column) -> Column:
    """The lexical patterns of a place: its two words on the left, and one word on each side."""
    before, after = _words(left), _words(right)
    two = F.when(F.size(before) >= 2, F.concat_ws(" ", F.element_at(before, -2), F.element_at(before, -1), F.lit("_")))
    around = F.when((F.size(before) >= 1) & (F.size(after) >= 1), F.concat_ws(" ", F.element_at(before, -1), F.lit("_"), F.element_at(after, 1)))
    return F.array_compact(F.array(two, around))


def _with_contexts(found: DataFrame) -> DataFrame:
    """(id, text_key, base, contexts): base spans, and the places of seeds and of tokens that could be identifiers.

    Tokens that touch a seed, or a number as long as a card's that fails its check, are no candidates. What refutes a
    token lies in its own place: the rest of the text doesn't matter. Nothing is filtered here: a filter would be pushed
    below the columns it reads and have every expression run once more.
    """
    text = F.col("text")
    span = lambda i, kind: F.transform(kind, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))
    base = F.concat(*[span(i, kind) for i, kind in enumerate(KINDS)])
    tokens = F.when(text.rlike(r"(?:[0-9][A-Za-z_-]*+){4}"), find(text, IDENTIFIER)).otherwise(F.array().cast(_EMPTY))
    seeds = F.concat(*KINDS)
    rows = found.select("id", "text_key", "text", base.alias("base"), seeds.alias("seeds"), F.concat(seeds, "numbers").alias("refuted"), tokens.alias("tokens"))
    others = F.filter("tokens", lambda t: ~F.exists("refuted", lambda r: (r["start"] < t["end"]) & (t["start"] < r["end"])))
    marked = lambda matches, seed: F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), F.lit(seed).alias("seed")))
    rows = rows.select("id", "text_key", "text", "base", F.concat(marked(F.col("seeds"), True), marked(others, False)).alias("places"))
    instance = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["seed"].alias("seed"), F.xxhash64(F.lower(m["value"])).alias("instance"), patterns_of(m["left"], m["right"]).alias("patterns"))
    contexts = F.when(F.size("places") > 0, F.transform(with_context(text, F.col("places")), instance))
    return rows.select("id", "text_key", "base", contexts.alias("contexts"))


def trusted_patterns(contexts: DataFrame, rounds: int, confidence: float, support: int) -> DataFrame:
    """(pattern): those whose score reaches confidence, with at least `support` different supporters behind it.

    Patterns and instances form a graph. A seed scores 1, another instance as much as its best pattern, or 0 while it has none. In
    each round, the patterns with enough supporters score the mean of all their instances, then all instances are
    scored anew. Supporters are seeds, and from the second round on instances that have reached the confidence: what one
    pattern discovers supports the next, which no seed need be near.
    """
    edges = contexts.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    edges = cut(edges)
    # a pattern of fewer instances than supporters asked for never has enough
    edges = edges.join(edges.groupBy("pattern").count().where(F.col("count") >= support).select("pattern"), "pattern")
    edges = cut(edges)
    scores = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for step in range(rounds):
        scored = edges.join(scores, "instance").groupBy("pattern").agg(F.avg("score").alias("confidence"), F.count(F.when(F.col("score") >= confidence, 1)).alias("supporters")).where(F.col("supporters") >= support)
        if step < rounds - 1:
            best = F.max(F.when(F.col("seed"), 1.0).otherwise(F.coalesce("confidence", F.lit(0.0))))
            scores = edges.join(scored, "pattern", "left").groupBy("instance").agg(best.alias("score"))
    return scored.where(F.col("confidence") >= confidence).select("pattern")


def pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = 5, confidence: float = 0.6, support: int = 3) -> DataFrame:
    """Personal data in each whole text: (doc_id, spans array<struct<start, end, kind>>), a row for each input row.

    Emails, IP addresses, card and phone numbers that pass their checks are the base spans, and the seeds of a bootstrap: the
    words around them make patterns, patterns and the identifier-like tokens they surround are scored in rounds over
    the whole corpus, and tokens in the place that a trusted pattern marks become spans of kind `id`. Tokens found so
    support further patterns in the next round. Such a token never touches a base span, nor a number of 14 to 19 digits
    that fails its check. Spans are sorted by start, then by kind in the order email, ip, card, phone,
    id; places are code points, ends exclusive.

    A null or empty text has no spans. Rows that repeat a doc_id and a text have the same spans; a null doc_id is a key
    like others. An empty table gives no rows. Other columns are not read.
    """
    rows = cut(_with_contexts(base_matches(docs, id_column, text_column)))
    contexts = rows.select("id", "text_key", F.explode("contexts").alias("c")).select("id", "text_key", "c.*")
    trusted = trusted_patterns(contexts, rounds, confidence, support)
    candidates = contexts.where(~F.col("seed")).select("id", "text_key", "start", "end", F.explode("patterns").alias("pattern"))
    added = candidates.join(trusted, "pattern", "left_semi").select(F.coalesce("id", F.lit(0)).alias("key"), F.col("id").isNull().alias("no_id"), "text_key", F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit(EXTRA).alias("kind")).alias("span"))
    added = added.groupBy("key", "no_id", "text_key").agg(F.collect_set("span").alias("added"))
    keyed = rows.select("id", "text_key", "base", F.coalesce("id", F.lit(0)).alias("key"), F.col("id").isNull().alias("no_id"))
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))))
    return keyed.join(added, ["key", "no_id", "text_key"], "left").select(F.col("id").alias(id_column), "text_key", F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with <KIND> in place of each span; where spans overlap, the one that starts first names both."""
    out = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"), s["end"].alias("at"))
        ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(out["out"], F.substring(text, out["at"] + 1, F.length(text))))


def mask_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """docs with every span of pii() masked in the text; all other columns stay, a null text stays null."""
    found = pii(docs, id_column, text_column, **settings).where(F.size("spans") > 0).dropDuplicates([id_column, "text_key"])
    found = cut(found.select(F.col(id_column).alias("_pii_id"), F.col("text_key").alias("_pii_key"), F.col("spans").alias("_pii_spans")))
    n = found.agg(F.count("*"), F.coalesce(F.sum(F.size("_pii_spans")), F.lit(0))).first()
    found = broadcast_if_small(found, n[0] + n[1], 64)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    keyed = docs.withColumn("_own_key", F.xxhash64(text))
    same = F.col(id_column).cast("long").eqNullSafe(F.col("_pii_id")) & (F.col("_own_key") == F.col("_pii_key"))
    out = keyed.join(found, same, "left").withColumn(text_column, F.when(F.col("_pii_spans").isNull(), F.col(text_column)).otherwise(masked(text, F.col("_pii_spans"))))
    return out.select(*[F.col(c) for c in docs.columns])
