"""SimHash fingerprints of texts, and all fingerprints within a Hamming radius.

A term is a run of TERM consecutive words (all words, where there are fewer); its weight is how
often the text has it. A term's hash has BITS bits; each votes with the weight for its bit of
the fingerprint, a set one for 1 and an unset one for 0, and the majority decides. A text
without words has all bits 0. Votes are sums over exploded terms: two bits of a hash are added
in one long, 32 places apart, so a text may have 2^31 terms.

``within`` compares by permuted block tables. A fingerprint is cut into blocks; two that differ
in ``radius`` bits at most agree in all but ``radius`` blocks, so there is a table for every
choice of the other blocks, keyed by what they hold. A pair is taken from the first of the tables in which it
meets. Only DataFrame functions are used.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dexspark.llm.common import materialise

TERM, BITS = 5, 64
#: Words are separated by these.
SPACE = r"[\x20\x09-\x0D]+"
#: Bits of a fingerprint may differ in which ``within`` finds, and the blocks of its tables.
RADIUS, BLOCKS = 3, 4
ID = ["id", "key"]


def vote(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows without text but with its fingerprint, print; equal rows become one.

    A term is a struct of the hashes of its words; a short text has one, with nulls behind.
    """
    own = [c for c in rows.columns if c != text]
    hashed = rows.select(*own, F.transform(F.array_remove(F.split(text, SPACE), ""), lambda word: F.xxhash64(word)).alias("_words"))
    count = F.greatest(F.size("_words") - (TERM - 1), F.lit(1))
    names = [f"_w{k}" for k in range(TERM)]
    runs = F.arrays_zip(*[F.slice("_words", F.lit(1 + k), count).alias(name) for k, name in enumerate(names)])
    terms = hashed.select(*own, F.inline_outer(runs).alias(*names)).select(*own, F.when(F.col("_w0").isNotNull(), F.xxhash64(*names)).alias("_term"))
    sums = [F.sum(F.shiftrightunsigned("_term", k).bitwiseAND(1 << 32 | 1)).alias(f"_{k}") for k in range(32)]
    counted = terms.groupBy(*own).agg(F.count("_term").alias("_n"), *sums)
    votes = counted.select(*own, "_n", F.array(*[F.coalesce(f"_{k}", F.lit(0)) for k in range(32)]).alias("_votes"))
    # a difference is negative, and so has its top bit set, where more than half of the votes are for 1
    low, high = (f"shiftleft(shiftrightunsigned(_n - 2 * {ones}, 63), a.k + {at})" for ones, at in (("(s & 4294967295)", 0), ("shiftrightunsigned(s, 32)", 32)))
    step = f"(a, s) -> named_struct('k', a.k + 1, 'bits', a.bits | {low} | {high})"
    return votes.select(*own, F.expr(f"aggregate(_votes, named_struct('k', 0, 'bits', 0L), {step}, a -> a.bits)").alias("print"))


def text_of(print_: str) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(print_), 16, F.lit("0")))


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def likeness(a: str, b: str) -> Column:
    """Share of equal bits."""
    return 1 - differing(a, b) / BITS


def named(docs: DataFrame) -> DataFrame:
    """(id, key, none, n_chars, text): documents under keys that are never null; texts that are null are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    none = F.col("doc_id").isNull()
    return own.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text", none).alias("key"), none.alias("none"), F.length("text").cast("long").alias("n_chars"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, key, none, n_chars, print), a row for each doc_id and text; id is 0 and none true where doc_id is null."""
    return vote(named(docs))


def in_order(rows: DataFrame) -> DataFrame:
    """Adds the row before (before_*: id, key, n_chars) and the fingerprint of the one after (next_print), by falling doc_id in a ring.

    Rows without a doc_id come last, those that share one in the order of key. Rows are dealt by
    range; a range is ordered by itself, and then its ends meet the ranges beside it: a row a range.
    """
    order = [F.col("none"), F.desc("id"), F.col("key")]
    spark = rows.sparkSession
    dealt = materialise(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id()))
    place = Window.partitionBy("part").orderBy(*order)
    before, after = F.struct("id", "key", "n_chars"), F.struct("print")
    linked = dealt.withColumns({"_before": F.lag(before).over(place), "_next": F.lead(after).over(place)})
    ends = linked.groupBy("part").agg(F.max(F.when(F.col("_next").isNull(), before)).alias("last"), F.max(F.when(F.col("_before").isNull(), after)).alias("first"))
    ring = Window.orderBy("part")  # a row a range
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(ring), F.last("last").over(whole)).alias("_last"), F.coalesce(F.lead("first").over(ring), F.first("first").over(whole)).alias("_first"))
    joined = linked.join(ends, "part").withColumns({"_before": F.coalesce("_before", "_last"), "_next": F.coalesce("_next", "_first")})
    own = [c for c in rows.columns]
    return joined.select(*own, *[F.col(f"_before.{c}").alias(f"before_{c}") for c in ("id", "key", "n_chars")], F.col("_next.print").alias("next_print"))


def beside_edited(docs: DataFrame, every: int = 50) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near) of every document.

    In the edited text the last floor(n_chars / 2) code points are replaced by the first as many, or all,
    of the next document by falling doc_id; the last one is followed by the first. near_* are the shares
    of equal bits with the edited text's and the next document's fingerprint.

    Null texts are empty ones, and an empty text has all bits 0. Rows with a null doc_id come after
    all others; rows that share a doc_id but not the text are documents of their own, in the order
    of a hash of their text. Repeated rows (equal doc_id and text) are one document and give one
    row. A single document is followed by itself. Texts of any length are taken whole; an empty table
    gives no rows. Other columns, whatever their names, are not looked at.
    n_near is set where doc_id is divisible by ``every``: how many other documents have a fingerprint within RADIUS.
    """
    prints = materialise(fingerprints(docs))
    links = in_order(prints).join(near_counts(prints, every), ID, "left")
    texts = named(docs).select(*ID, "text")
    held = texts.join(links, ID).dropDuplicates(ID)
    heads = held.select(F.col("before_id").alias("id"), F.col("before_key").alias("key"), F.expr("substring(text, 1, cast(before_n_chars div 2 as int))").alias("head"))
    edited = held.join(heads, ID).withColumn("text", F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 2 as int))"), "head"))
    own = edited.select(*ID, "none", "n_chars", F.col("print").alias("own_print"), "next_print", "n_near", F.sha2("text", 256).alias("edited_sha256"), "text")
    return vote(own).select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        text_of("own_print").alias("fingerprint"),
        text_of("print").alias("edited_fingerprint"),
        likeness("own_print", "print").alias("near_edited"),
        likeness("own_print", "next_print").alias("near_next"),
        "n_near",
    )


def table_keys(print_: Column, radius: int, blocks: int) -> list[Column]:
    """A key for each table: a hash of the blocks that a pair must share in it."""
    size = BITS // blocks
    if BITS % blocks or radius >= blocks:
        raise ValueError("blocks must divide 64 and be more than the radius")

    def block(n: int) -> Column:
        return print_ if blocks == 1 else F.shiftrightunsigned(print_, n * size).bitwiseAND((1 << size) - 1)

    return [F.xxhash64(*map(block, shared)) for shared in combinations(range(blocks), blocks - radius)]


def within(asked: DataFrame, held: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(print, near, bits): for each distinct asked fingerprint all held ones that differ in ``radius`` bits at most.

    blocks, more than the radius, trades tables for longer keys: there are blocks over radius tables, each keyed
    by (blocks - radius) / blocks of the bits. Rows with a null print take no part.
    """

    def keyed(rows: DataFrame, name: str, keys: str) -> DataFrame:
        own = rows.select(F.col("print").cast("long").alias(name)).dropna().distinct()
        return own.withColumn(keys, F.array(*table_keys(F.col(name), radius, blocks))).select(name, keys, F.posexplode(keys).alias(f"{keys}_table", f"{keys}_at"))

    a, b = keyed(asked, "print", "a"), keyed(held, "near", "b")
    bits = differing("print", "near")
    first = F.coalesce(*[F.when(F.get("a", F.lit(t)) == F.get("b", F.lit(t)), t) for t in range(comb(blocks, radius))])
    met = a.join(b, (F.col("a_table") == F.col("b_table")) & (F.col("a_at") == F.col("b_at")) & (bits <= radius) & (first == F.col("a_table")))
    return met.select("print", "near", bits.alias("bits"))


def near_counts(prints: DataFrame, every: int, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(id, key, n_near): for documents whose id is divisible by ``every``, how many others have a fingerprint within the radius."""
    asked = prints.filter(~F.col("none") & (F.col("id") % every == 0)).select(*ID, "print")
    sizes = prints.groupBy(F.col("print").alias("near")).agg(F.count("*").alias("_size"))
    counted = within(asked, prints, radius, blocks).join(sizes, "near").groupBy("print").agg((F.sum("_size") - 1).alias("n_near"))
    return asked.join(counted, "print").select(*ID, "n_near")
