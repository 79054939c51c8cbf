"""Line dedup by an exact set-similarity join: rare tokens first, prefixes, positions, lengths.

DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.common import broadcast_if_small, settled

#: Token hashes are counted in this many buckets: a fixed table, whatever the vocabulary.
BUCKETS = 1 << 16
BLANK = r"[ \t-\r]+"
HASH_BITS = 57
#: The first tokens of a line that look for its group of near copies.
LEADING = 6
#: Lengths of a class, in which a token has an earliest and a most copied line, differ by this factor.
CLASS = 1.06


def _split(text: Column) -> Column:
    """The words, with empty ones among them. Few texts have white space other than spaces, and only they need a regular expression."""
    odd = F.lit(False)
    for c in "\t\n\x0b\f\r":
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.split(text, BLANK)).otherwise(F.split(text, " "))


def rarity_classes(docs: DataFrame) -> Column:
    """How often the tokens of each hash bucket occur in all texts: an array of classes from 0 (rare)
    to 63."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("t"))
    tokens = lines.select(F.explode(_split(F.col("t"))).alias("w")).where("w <> ''")
    counted = tokens.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).count()
    classes = ["0"] * BUCKETS
    for row in counted.collect():  # at most BUCKETS rows
        classes[row["b"]] = str(min(63, int(1.5 * math.log2(row["count"] + 1))))
    # One text that Spark folds into a constant array.
    return F.split(F.lit(",".join(classes)), ",").cast("array<tinyint>")


def _codes(content: Column, classes: Column) -> Column:
    """The set of tokens of a line, rare ones first: rarity class above 57 bits of the token's hash."""
    words = F.array_distinct(F.transform(F.array_remove(_split(content), ""), lambda w: F.xxhash64(w)))
    rare = lambda h: F.get(classes, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("long")
    code = lambda h: F.shiftleft(rare(h), HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS))
    return F.sort_array(F.transform(words, code))


def _parity(codes: Column) -> Column:
    """64 bits, each the parity of the tokens that hash to it: sets differ by at least as many tokens
    as their parities differ by bits."""
    one = F.lit(1).cast("long")
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(
        F.call_function("shiftleft", one, c.bitwiseAND(F.lit(63)).cast("int"))
    ))


def _second_parity(codes: Column) -> Column:
    """The same of half of the tokens."""
    return _parity(F.filter(codes, lambda c: c.bitwiseAND(F.lit(64)) != 0))


def line_table(docs: DataFrame, classes: Column, threshold: float) -> DataFrame:
    """(doc, text_hash, line, key, n, parity, second, prefix) of every line that has tokens.

    `doc` is the id, the largest long if null. `key` tells the set of tokens, `prefix` holds
    its first tokens in the common order: sets as similar as the threshold share one.
    """
    n = F.size("codes")
    prefix = n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    # The lines and their codes are made once each: a generator stands between them and their uses.
    return (
        docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"),
            F.xxhash64("text").alias("text_hash"),
            F.posexplode(F.split("text", "\n")).alias("line", "content"),
        )
        .select("doc", "text_hash", "line", F.explode(F.array(_codes(F.col("content"), classes))).alias("codes"))
        .where(n > 0)
        .select(
            "doc", "text_hash", "line", F.xxhash64("codes").alias("key"), n.alias("n"), _parity(F.col("codes")).alias("parity"),
            _second_parity(F.col("codes")).alias("second"),
            F.slice("codes", F.lit(1), prefix).alias("prefix"),
        )
    )


def _place(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}doc"), F.col(f"{prefix}line"))


LINE = ("doc", "line", "n", "parity")
#: A token of a prefix as it is shuffled, in few columns: `where` is the line and a mark, `at` is n and
#: the token's place i, `first` and `second` are the parities of the two halves of the tokens.
TOKEN = ("doc", "where", "at", "first", "second")
LOW = 0xFFFFFFFF


def _tokens(rows: DataFrame, mark: Column, most: int | None = None) -> DataFrame:
    """(token, TOKEN, more) of the first tokens of each line, all of the prefix by default; `mark` is a boolean."""
    prefix = F.col("prefix") if most is None else F.slice("prefix", 1, most)
    exploded = rows.select(
        "doc", (F.col("line").cast("long") * 2 + mark.cast("long")).alias("where"), F.col("n").cast("long").alias("n"),
        F.col("parity").bitwiseXOR(F.col("second")).alias("first"), "second", *(["c"] if most else []), F.posexplode(prefix).alias("i", "code"),
    )
    at = F.shiftleft("n", 32).bitwiseOR(F.col("i").cast("long") + 1).alias("at")
    return exploded.select(
        F.hash("code").alias("token"), "doc", "where", at, "first", "second", *(["c"] if most else [])
    ).repartition("token")


def _candidates(pairs: DataFrame, threshold: float, asks: Column, every: bool) -> DataFrame:
    """Pairs of a line and an earlier one (b_...) with the same token in their prefixes, once each,
    that could differ as little as their signatures and the places of the token do.

    With `every`, `pairs` holds every token that the prefixes share, and a pair has to pass at the first:
    what stands before it is in one of the lines only. Otherwise it may be any of them.
    """
    n, m = F.shiftright("at", 32), F.shiftright("b_at", 32)
    i, j = F.col("at").bitwiseAND(F.lit(LOW)), F.col("b_at").bitwiseAND(F.lit(LOW))
    line, b_line = F.shiftright("where", 1), F.shiftright("b_where", 1)
    # Sets of n and m tokens are similar if they differ by at most this share of n + m.
    most = (n + m) * F.lit((1 - threshold) / (1 + threshold) + 1e-12)
    apart = F.bit_count(F.col("first").bitwiseXOR(F.col("b_first"))) + F.bit_count(F.col("second").bitwiseXOR(F.col("b_second")))
    before = i + j - 2 if every else F.abs(i - j)
    # What rules out most comes first. No part has columns of one side only: it would be pushed below
    # the exchange of that side, and both sides have to stay the same exchange.
    possible = pairs.where(
        (apart <= most)
        & (before + F.abs((n - i) - (m - j)) <= most)
        & ((F.col("b_doc") < F.col("doc")) | ((F.col("b_doc") == F.col("doc")) & (b_line < line)))
        & asks
    )
    return possible.select(
        "doc", line.cast("int").alias("line"), n.cast("int").alias("n"), F.col("first").bitwiseXOR(F.col("second")).alias("parity"),
        "b_doc", b_line.cast("int").alias("b_line"), m.cast("int").alias("b_n"),
        F.col("b_first").bitwiseXOR(F.col("b_second")).alias("b_parity"),
    ).distinct()


def _words_at(docs: DataFrame, needed: DataFrame, classes: Column) -> DataFrame:
    """`needed` (doc, line, n, parity) with the words there; another text there is not taken."""
    needed = settled(needed)
    here = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), "text")
    wanted = broadcast_if_small(settled(needed.select("doc").distinct()), 8)
    lines = here.join(wanted, "doc", "left_semi").select("doc", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    found = (
        lines.join(broadcast_if_small(needed, 40), ["doc", "line"])
        .select(*LINE, F.explode(F.array(F.array_remove(F.array_distinct(_split(F.col("t"))), ""))).alias("words"))
        .where(F.size("words") == F.col("n"))
    )
    coded = F.array_distinct(F.transform("words", lambda w: F.shiftrightunsigned(F.xxhash64(w), 64 - HASH_BITS)))
    return found.where(_parity(coded) == F.col("parity"))


def _verified(docs: DataFrame, candidates: DataFrame, classes: Column, threshold: float) -> DataFrame:
    """(doc, line, n, parity): the lines of `candidates` similar, word by word, to an earlier partner."""
    pairs = settled(candidates)
    others = pairs.select(*(F.col(f"b_{c}").alias(c) for c in LINE))
    words = settled(_words_at(docs, pairs.select(*LINE).unionByName(others).distinct(), classes))
    other = words.select(*(F.col(c).alias(f"b_{c}") for c in LINE), F.col("words").alias("b_words"))
    joined = pairs.join(words, list(LINE)).join(other, [f"b_{c}" for c in LINE])
    shared = F.size(F.array_intersect("words", "b_words"))
    similar = shared / (F.col("n") + F.col("b_n") - shared) >= F.lit(threshold)
    return settled(joined.where(similar).select(*LINE).distinct())


def removed_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc, text_hash, lines): the positions of the lines to remove from each document that has any.

    A line goes if an earlier line, by doc_id and then position, has a set of words whose Jaccard
    similarity with its own is at least `threshold`, whether or not that one goes itself.
    """
    classes = rarity_classes(docs)
    table = settled(line_table(docs, classes, threshold))
    copies = settled(
        table.groupBy("key").agg(F.count("*").alias("c"), F.min(_place()).alias("first")).where("c > 1")
        .select("key", "c", F.col("first.doc").alias("first_doc"), F.col("first.line").alias("first_line"))
    )
    # One line stands for all that have its set: the earliest.
    later = (F.col("doc") > F.col("first_doc")) | (
        (F.col("doc") == F.col("first_doc")) & (F.col("line") > F.col("first_line"))
    )
    stands = table.join(broadcast_if_small(copies, 48), "key", "left").where(~F.coalesce(later, F.lit(False)))
    stands = stands.withColumn("c", F.coalesce("c", F.lit(1)))

    # First against the earliest and the most copied line that have a leading token and a like length:
    # that settles most of a group of near copies without pairing its members.
    tokens = _tokens(stands, F.lit(False), LEADING)
    heads = (
        tokens.groupBy("token", F.floor(F.log(F.shiftright("at", 32)) / math.log(CLASS)).alias("length"))
        .agg(
            F.count("*").alias("lines"), F.min(F.struct(*TOKEN)).alias("earliest"),
            F.max(F.struct("c", F.struct(*TOKEN).alias("t")))["t"].alias("copied"),
        )
        .where("lines > 1")
        .select("token", F.explode(F.array_distinct(F.array("earliest", "copied"))).alias("b"))
        .select("token", *(F.col(f"b.{x}").alias(f"b_{x}") for x in TOKEN))
    )
    once = _verified(docs, _candidates(tokens.join(heads, "token"), threshold, (F.col("c") > 0) | (F.col("b_where") < 0), False), classes, threshold)
    # Then what is left against all earlier lines of its tokens.
    settled_once = once.withColumn("done", F.lit(True))
    marked = _tokens(stands.join(broadcast_if_small(settled_once, 32), list(LINE), "left"), F.col("done").isNotNull())
    earlier = marked.select("token", *(F.col(x).alias(f"b_{x}") for x in TOKEN))
    asks = (F.col("where").bitwiseAND(F.lit(1)) == 0) | (F.col("b_where") < 0)
    again = _verified(docs, _candidates(marked.join(earlier, "token"), threshold, asks, True), classes, threshold)
    similar = once.unionByName(again).distinct().withColumn("similar", F.lit(True))
    found = stands.select("key", *LINE).join(broadcast_if_small(settled(similar), 32), list(LINE)).select("key", "similar").distinct()
    gone = settled(copies.join(found, "key", "full"))
    hit = table.select("key", "doc", "text_hash", "line").join(broadcast_if_small(gone, 56), "key")
    return settled(
        hit.where(F.coalesce("similar", F.lit(False)) | later)
        .groupBy("doc", "text_hash")
        .agg(F.array_distinct(F.collect_list("line")).alias("lines"))
    )


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """`docs` without the lines that are similar to an earlier line, and (n_lines, n_removed).

    Lines end at a line feed; tokens are what stands between white space, as written, each once.
    Lines without tokens are never removed and match nothing. A document all of whose lines go has
    an empty text; a null text stays null, with no lines. `n_chars`, if there, follows a changed text.
    Rows without a doc_id come after all others, in one place: their equal positions are not
    ordered and do not remove each other; neither do rows that repeat a doc_id, position by position.
    Sets of tokens are told apart by a 64-bit hash; similar sets are verified on their words.
    """
    lines = removed_lines(docs, threshold)
    named = lines.select(F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("lines").alias("__gone"))
    here = (F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)) == F.col("__doc")) & (
        F.xxhash64("text") == F.col("__hash")
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    text = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    changed = F.col("__gone").isNotNull()
    out = (
        docs.withColumn("__lines", F.split("text", "\n"))
        .join(broadcast_if_small(named, 64), here, "left")
        .withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")))
        .withColumn("n_removed", F.when(changed, F.size("__gone")).otherwise(0))
        .withColumn("text", F.when(changed, text).otherwise(F.col("text")))
    )
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop("__doc", "__hash", "__gone", "__lines")
