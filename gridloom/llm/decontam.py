"""Benchmark decontamination by spaced seeds, in DataFrame operations alone.

Tokens are runs of letters and digits, lower case. An item of n tokens is found
in a document where, laid token on token, some stretch of STRETCH tokens (or
the whole item, where it is shorter) has at most a fifth of its tokens replaced.
Two fixed masks each take five of up to nine token positions and ignore the
rest. Between them they hit every such stretch of LEAST tokens or more,
whichever tokens are replaced (tests enumerate the cases). An item under LEAST
tokens of which k may be replaced has k + 1 masks, each of every (k + 1)-th
position: k tokens can't spoil them all. So hashing masked tokens of items and
documents and joining the hashes loses no occurrence. Every hit is verified by
laying the item's tokens on the document's.

Items and their hashes are written to the shared folder and broadcast only where
their bytes, which are summed, are within BROADCAST_BYTES; beyond it the same
joins shuffle. Texts are read in blocks of tokens: rows with one hash each hold a
place, no tokens; the distinct alignments of hits are written, and meet the one
block of the text that covers them. So memory and rows grow with a text's
tokens, however long it is or often it repeats itself.

Null and empty texts have no tokens and are clean; so are all documents when
the benchmark is empty. Items without tokens match nothing; items with equal
texts count one by one. Documents are told apart by doc_id (null is a value)
and text; equal rows share a verdict. Further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch

MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 7, 8))
STRETCH, LEAST = 16, 11
#: Tokens of a text that are hashed or verified in one row.
BLOCK = 1024
BROADCAST_BYTES = 32 << 20


def tokens(text: str) -> Column:
    return F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")


def allowed(n: Column) -> Column:
    """Tokens that may be replaced in a stretch of n."""
    return F.floor(n / 5).cast("int")


def masked(mask: tuple[int, ...] | range, number: int, at: Column) -> Column:
    """Hash of the masked tokens, by their own hashes h, from a place on."""
    return F.xxhash64(F.lit(number), *[F.get("h", at + k) for k in mask])


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of items of n tokens, n under LEAST."""
    return [tuple(range(k, n, n // 5 + 1)) for k in range(n // 5 + 1)]


def seeds(items: DataFrame) -> DataFrame:
    """item, at and the hash of each mask at each position of each item (item, t, n)."""
    items = items.select("item", "n", F.transform("t", lambda x: F.xxhash64(x)).alias("h"))
    at = lambda mask, k: F.transform(F.sequence(F.lit(0), F.col("n") - 1 - mask[-1]), lambda i: masked(mask, k, i))
    long = items.filter(F.col("n") >= LEAST)
    parts = [long.select("item", F.posexplode(at(mask, k)).alias("at", "hash")) for k, mask in enumerate(MASKS)]
    hashes = F.array().cast("array<bigint>")
    for n in range(1, LEAST):
        hashes = F.when(F.col("n") == n, F.array(*[masked(m, 100 * n + k, F.lit(0)) for k, m in enumerate(short_masks(n))])).otherwise(hashes)
    short = items.filter(F.col("n") < LEAST).select("item", F.lit(0).alias("at"), F.explode(hashes).alias("hash"))
    return parts[0].unionByName(parts[1]).unionByName(short)


def blocks(docs: DataFrame, text: str, size: int, more: int) -> DataFrame:
    """doc_id, print, block and t: the tokens from block * size on, size of them and some more, which the next block has too."""
    rows = docs.select("doc_id", F.xxhash64(text).alias("print"), tokens(text).alias("t"))
    last = F.floor((F.size("t") - 1) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(b.alias("block"), F.slice("t", b * size + 1, F.lit(size + more)).alias("t")))
    return rows.select("doc_id", "print", F.explode(cut).alias("b")).select("doc_id", "print", "b.block", "b.t")


def places(docs: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """doc_id, print, at and hash: every mask's hash at every token; sizes are those of the short items."""
    cut = blocks(docs, text, BLOCK, LEAST).select("doc_id", "print", "block", F.transform("t", lambda x: F.xxhash64(x)).alias("h"))
    masks = [(m, k) for k, m in enumerate(MASKS)] + [(m, 100 * n + k) for n in sizes for k, m in enumerate(short_masks(n))]
    own = F.sequence(F.lit(0), F.least(F.size("h"), F.lit(BLOCK)) - 1)
    hashes = F.transform(own, lambda i: F.array(*[masked(m, k, i) for m, k in masks]))
    rows = cut.select("doc_id", "print", "block", F.posexplode(hashes).alias("i", "hashes"))
    return rows.select("doc_id", "print", (F.col("block") * BLOCK + F.col("i")).alias("at"), F.explode("hashes").alias("hash"))


def hits(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, print (of the text), item, item_id and equal tokens, for each item found in a document."""
    scratch = Scratch(docs.sparkSession)
    cut = items.select("item_id", F.filter(tokens("text"), lambda x: x != "").alias("t")).withColumn("n", F.size("t")).filter("n > 0")
    own = scratch.put(cut.select(F.monotonically_increasing_id().alias("item"), "*"), "items")
    of = scratch.put(seeds(own), "seeds")
    sizes = [r["n"] for r in own.filter(F.col("n") < LEAST).select("n").distinct().collect()]
    held = own.agg(F.sum(40 + 16 * F.col("n") + F.octet_length(F.array_join("t", " "))).cast("long")).first()[0] or 0
    longest = own.agg(F.max("n")).first()[0] or 1
    few = max(held, 40 * of.count()) <= BROADCAST_BYTES
    laid = own.select("item", "item_id", F.col("t").alias("item_t"), F.col("n").alias("item_n"))
    of = of.select("hash", F.col("at").alias("item_at"), "item")
    of, laid = (F.broadcast(of), F.broadcast(laid)) if few else (of, laid)
    hit = places(docs, text, sizes).join(of, "hash").select("doc_id", "print", "item", (F.col("at") - F.col("item_at")).alias("begin")).distinct()
    size = max(BLOCK, longest)
    found = scratch.put(hit.withColumn("block", F.greatest(F.lit(0), F.floor(F.col("begin") / size).cast("int"))), "hits")
    found = (F.broadcast(found) if 64 * found.count() <= BROADCAST_BYTES else found.hint("merge")).alias("h")
    laid_on = blocks(docs, text, size, longest).alias("b")
    same = F.col("h.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("h.print") == F.col("b.print")) & (F.col("h.block") == F.col("b.block"))
    aligned = laid_on.join(found, same).select("h.*", "b.t", (F.col("h.begin") - F.col("h.block") * size).alias("at")).join(laid, "item")
    equal = F.transform("item_t", lambda x, i: F.coalesce(F.get("t", F.col("at") + i) == x, F.lit(False)))
    stretch = F.least(F.lit(STRETCH), F.col("item_n"))
    candidate = aligned.select("doc_id", "print", "item", "item_id", "begin", equal.alias("equal"), stretch.alias("stretch"), (stretch - allowed(stretch)).alias("need"))
    candidate = candidate.filter(F.size(F.filter("equal", lambda x: x)) >= F.col("need"))
    good = F.exists(
        F.sequence(F.lit(1), F.size("equal") - F.col("stretch") + 1),
        lambda s: F.size(F.filter(F.slice("equal", s, F.col("stretch")), lambda x: x)) >= F.col("need"),
    )
    verified = candidate.filter(good).select("*", F.size(F.filter("equal", lambda x: x)).alias("matched"))
    return verified.groupBy("doc_id", "print", "item", "item_id").agg(F.max("matched").cast("long").alias("matched"))


def judged(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """Every document with contaminated, n_items and item_ids (sorted)."""
    of = hits(docs, items, text).groupBy("doc_id", "print").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("item_id")).alias("ids"))
    kind = of.schema["ids"].dataType
    d, o = docs.select("doc_id", F.xxhash64(text).alias("print")).alias("d"), of.alias("o")
    both = d.join(o, F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.print") == F.col("o.print")), "left")
    return both.select("d.doc_id", F.col("o.n").isNotNull().alias("contaminated"), F.coalesce("o.n", F.lit(0)).cast("long").alias("n_items"), F.coalesce("o.ids", F.array().cast(kind)).alias("item_ids"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents in which no item was found, with all their columns."""
    of = hits(docs, items, text).select("doc_id", "print").distinct().alias("o")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("r")).alias("d")
    same = F.col("d.r.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.xxhash64(F.col("d.r")[text]) == F.col("o.print"))
    return rows.join(of, same, "left_anti").select("d.r.*")
