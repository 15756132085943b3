"""Deletion of repeated runs of lines, in DataFrame operations alone.

Lines are ids in a sequence for each document (blank lines take no part). The
suffixes that start at repeated lines are put in order by distributed prefix
doubling: rank 0 orders line ids, and the rank for 2**(k+1) lines orders pairs
of the rank for 2**k lines and the ranks of the suffix 2**k lines on. Ranks are
dealt by range, sorted and numbered in place. A suffix whose prefix is unique
keeps its ranks and leaves, so each round holds repeated prefixes alone, and
doubling ends at the longest repeat. A suffix that meets its document's end or a
line without a copy leaves likewise: no prefix beyond that is repeated.

Sorted by all their ranks the suffixes are the suffix array. Neighbours that
share k + 1 ranks have 2**k lines in common; the rest of the common prefix comes
from the ranks of the places behind those lines, in ever shorter steps, so
lengths are exact. Neighbours with at least q lines in common form an interval
that holds all copies of a run of q lines. From each line that opens a run of
min_words words, forwards or counted back from the run's end, the interval of
that run is taken; the first copy in order of doc_id and line stays and the
others go. So exactly the lines go that lie in some run of at least min_words
words of which an earlier copy exists. maximal_runs reports the longest runs.

Order is doc_id (nulls first), a hash of the text, line. Of rows equal in both
doc_id and text one is first, and the others lose all their lines if the text
has min_words words. Words are parted by single spaces. Null texts stay null,
empty ones empty. A document without deletion keeps its text to the byte; else
its kept lines, blank ones included, are joined by newlines. An empty table
gives an empty result. Columns of other names pass through; n_lines,
n_filled and n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import Scratch, shuffle_partitions

MIN_WORDS = 5
BLANK = " \t\r\x0b\x0c"
PLACE = ["doc_id", "print", "at"]
DOC = ["doc_id", "print"]


def lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def filled(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK)) != ""


def bare(text: str) -> Column:
    return F.filter(lines(text), filled)


def words(line: Column) -> Column:
    line = F.btrim(line, F.lit(BLANK))
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def sequence(docs: DataFrame, text: str, min_words: int) -> DataFrame:
    """A row a line: its place among the filled lines (at) and among all (pos), the 128 bits of its id, and the lines it needs forwards and backwards for min_words words (null: too few)."""
    numbered = F.transform(lines(text), lambda x, i: F.struct(x.alias("line"), i.alias("pos")))
    rows = docs.select("doc_id", F.xxhash64(text).alias("print"), F.filter(numbered, lambda s: filled(s["line"])).alias("x")).withColumn("w", F.transform("x", lambda s: words(s["line"])))
    places = rows.select("*", F.explode_outer(F.sequence(F.lit(0), F.size("x") - 1)).alias("at")).filter((F.col("at") >= 0) & (F.col("at") < F.size("x")))

    def need(sign: int) -> Column:
        total, out = F.lit(0), F.lit(None).cast("int")
        sums = []
        for k in range(min_words):
            at = F.col("at") + sign * k
            total = total + F.when(at >= 0, F.get("w", at))
            sums.append(total)
        for k in reversed(range(min_words)):
            out = F.when(sums[k] >= min_words, F.lit(k + 1)).otherwise(out)
        return out

    line = F.get("x", F.col("at"))["line"]
    return places.select("doc_id", "print", "at", F.get("x", F.col("at"))["pos"].alias("pos"), F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"), need(1).alias("ahead"), need(-1).alias("back"))


def ranked(classes: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """Number distinct keys in their order: dealt by range and sorted, row numbers ascend with partition and place."""
    return classes.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id())


def same_place(a: str, b: str, shift: int = 0) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.print") == F.col(f"{b}.print")) & (F.col(f"{a}.at") + shift == F.col(f"{b}.at"))


def shared_ranks(x: Column, y: Column) -> Column:
    """How many ranks two suffixes share; the last rank of each is that with which it left."""
    least = F.least(F.size(x), F.size(y)) - 1
    differ = F.array_position(F.transform(F.sequence(F.lit(0), least - 1), lambda i: F.get(x, i) == F.get(y, i)), False)
    return F.when(x.isNull() | y.isNull(), 0).otherwise(F.when(differ > 0, differ - 1).otherwise(least)).cast("int")


def sure(c: str) -> Column:
    """The lines that c shared ranks stand for."""
    return F.when(F.col(c) > 0, F.call_function("shiftleft", F.lit(1), F.col(c) - 1)).otherwise(0)


def suffix_array(first: DataFrame, scratch: Scratch) -> DataFrame:
    """Places in the order of their suffixes (rank, part of the table), with their ranks, from places and the ranks of their lines."""
    parts = shuffle_partitions(scratch.spark)
    live, left, size, made = first.select(*PLACE, F.array("rank").alias("ranks")), [], 1, []
    while not live.isEmpty():
        every = live.withColumn("live", F.lit(True))
        for table in left:
            every = every.unionByName(table.withColumn("live", F.lit(False)))
        # No place is met size lines on before the line of that number.
        both = live.alias("x").join(every.filter(F.col("at") >= size).alias("y"), same_place("x", "y", size), "left")
        pairs = scratch.put(both.select("x.*", F.element_at("x.ranks", -1).alias("r"), F.col("y.ranks").alias("s"), "y.live"), f"pairs{size}")
        ended = pairs.filter("s IS NULL").select(*PLACE, F.concat("ranks", F.array(F.lit(-1).cast("long"))).alias("ranks"), F.lit(False).alias("live"))
        pairs = pairs.filter("s IS NOT NULL")
        classes = scratch.put(ranked(pairs.groupBy("r", "s").agg((F.max("live") & (F.count("*") > 1)).alias("more")), ["r", "s"], parts), f"rank{size}")
        named = pairs.drop("live").join(classes, ["r", "s"]).select(*PLACE, F.concat("ranks", F.array("rank")).alias("ranks"), F.col("more").alias("live"))
        named = scratch.put(named.unionByName(ended), f"ranks{size}")
        scratch.drop(f"pairs{size}", f"rank{size}")
        made.append(f"ranks{size}")
        live, size = named.filter("live").drop("live"), 2 * size
        left.append(named.filter("NOT live").drop("live"))
    every = live
    for table in left:
        every = every.unionByName(table)
    array = scratch.put(ranked(every, ["ranks", *PLACE], parts).withColumn("part", F.call_function("shiftright", F.col("rank"), F.lit(33))), "array")
    scratch.drop(*made)
    return array


def common_prefixes(array: DataFrame, scratch: Scratch) -> DataFrame:
    """rank, part, place, the place before it in the array (before) and the lines that both have in common (height)."""
    here = F.struct(*PLACE, "ranks")
    ends = array.groupBy("part").agg(F.max_by(here, "rank").alias("end"))
    # A row for each part of the table.
    ends = ends.select("part", F.lag("end").over(W.orderBy("part")).alias("end"))
    before = F.coalesce(F.lag(here).over(W.partitionBy("part").orderBy("rank")), "end")
    near = array.join(F.broadcast(ends), "part").withColumn("y", before).withColumn("c", shared_ranks(F.col("ranks"), F.col("y.ranks")))
    near = scratch.put(near.select("rank", "part", *PLACE, F.struct(*[F.col(f"y.{c}") for c in PLACE]).alias("before"), "c"), "near")
    # Two ranks stand for two lines, so no place before the third is asked for.
    behind = array.filter("at > 1")
    step, found, k = near.filter("c > 1").select("rank", *PLACE, "before", sure("c").alias("height")), [], 0
    while not step.isEmpty():
        on = lambda at, side: F.col(f"{at}doc_id").eqNullSafe(F.col(f"{side}.doc_id")) & (F.col(f"{at}print") == F.col(f"{side}.print")) & (F.col(f"{at}at") + F.col("w.height") == F.col(f"{side}.at"))
        both = step.alias("w").join(behind.alias("x"), on("w.", "x"), "left").join(behind.alias("y"), on("w.before.", "y"), "left")
        both = both.select("w.*", shared_ranks(F.col("x.ranks"), F.col("y.ranks")).alias("c"))
        both = scratch.put(both.withColumn("height", F.col("height") + sure("c")), f"step{k}")
        found.append(both.filter("c < 2").select("rank", "height"))
        step, k = both.filter("c > 1").drop("c"), k + 1
    exact = near.filter("c < 2").select("rank", F.col("c").alias("height"))
    for more in found:
        exact = exact.unionByName(more)
    heights = scratch.put(near.drop("c").join(exact, "rank"), "heights")
    scratch.drop("near", *[f"step{i}" for i in range(k)])
    return heights


def intervals(heights: DataFrame, runs: DataFrame, most: int) -> DataFrame:
    """The runs (place, q lines, at most most) with the place in the array at which the interval of their copies begins."""
    asked = runs.groupBy(*PLACE).agg(F.collect_set("q").alias("qs")).alias("r")
    opens = [F.when(F.col("height") < q, F.col("rank")) for q in range(1, most + 1)]
    # Intervals may begin in an earlier part of the table: a row for each part.
    lasts = heights.groupBy("part").agg(*[F.max(x).alias(f"b{q}") for q, x in enumerate(opens)])
    past = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    lasts = lasts.select("part", F.array(*[F.max(f"b{q}").over(past) for q in range(most)]).alias("past"))
    inside = W.partitionBy("part").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    begun = heights.select("part", *PLACE, F.array(*[F.last(x, ignorenulls=True).over(inside) for x in opens]).alias("begun")).alias("h")
    both = begun.join(asked, same_place("h", "r")).select("h.*", "r.qs").join(F.broadcast(lasts), "part")
    q = F.col("q") - 1
    return both.select("*", F.explode("qs").alias("q")).select(*PLACE, "q", F.coalesce(F.get("begun", q), F.get("past", q)).alias("interval"))


def repeated_lines(docs: DataFrame, scratch: Scratch, text: str, min_words: int) -> DataFrame:
    """The lines (as of sequence) that occur again, with the rank of their id."""
    seq = scratch.put(sequence(docs, text, min_words), "lines")
    classes = scratch.put(ranked(seq.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), ["a", "b"], shuffle_partitions(docs.sparkSession)), "rank")
    lines = scratch.put(seq.join(classes, ["a", "b"]).drop("a", "b").dropDuplicates(PLACE), "repeats")
    scratch.drop("lines", "rank")
    return lines


def maximal_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, line (from 0), n_lines: from each line the longest run of lines that occurs again anywhere, where it isn't the rest of a run that began a line before.

    n_lines counts lines that aren't blank. Runs of fewer than min_words words are left out.
    """
    scratch = Scratch(docs.sparkSession)
    lines = repeated_lines(docs, scratch, text, min_words)
    heights = common_prefixes(suffix_array(lines.select(*PLACE, "rank"), scratch), scratch).filter("height > 0")
    sides = heights.select(*PLACE, "height").unionByName(heights.select("before.*", "height"))
    longest = sides.groupBy(*PLACE).agg(F.max("height").alias("n_lines"))
    order = W.partitionBy(*DOC).orderBy("at")
    rest = (F.lag("at").over(order) == F.col("at") - 1) & (F.lag("n_lines").over(order) == F.col("n_lines") + 1)
    kept = longest.withColumn("rest", F.coalesce(rest, F.lit(False))).filter("NOT rest").alias("k")
    return kept.join(lines.alias("l"), same_place("k", "l")).filter("l.ahead <= k.n_lines").select("k.doc_id", F.col("l.pos").alias("line"), "k.n_lines")


def repeated(docs: DataFrame, scratch: Scratch, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, print, n_gone, and gone: the lines that go as bits, 64 lines a number."""
    lines = repeated_lines(docs, scratch, text, min_words)
    heights = common_prefixes(suffix_array(lines.select(*PLACE, "rank"), scratch), scratch)
    ahead = lines.filter("ahead IS NOT NULL").select(*PLACE, F.col("ahead").alias("q"))
    back = lines.filter("back IS NOT NULL").select(*DOC, (F.col("at") - F.col("back") + 1).alias("at"), F.col("back").alias("q"))
    copies = scratch.put(intervals(heights, ahead.unionByName(back), min_words), "intervals")
    scratch.drop("array", "heights")
    firsts = scratch.put(copies.groupBy("q", "interval").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "firsts")
    later = copies.join(firsts, ["q", "interval"]).filter(~F.struct(*PLACE).eqNullSafe(F.col("first")))
    covered = later.select(*DOC, F.explode(F.sequence("at", F.col("at") + F.col("q") - 1)).alias("at")).alias("c")
    every = covered.join(lines.alias("s"), same_place("c", "s")).select("c.doc_id", "c.print", "s.pos")
    word = F.floor(F.col("pos") / 64).cast("int")
    parts_ = every.groupBy(*DOC, word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))).alias("bits"))
    lists = parts_.groupBy(*DOC).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"), F.max("word").alias("last"), F.sum(F.bit_count("bits")).alias("n_gone"))
    return lists.select(*DOC, F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long"))).alias("gone"), "n_gone")


def deduplicated(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All documents with their columns, the text without its repeated lines, n_lines, n_filled (lines that aren't blank) and n_removed."""
    scratch = Scratch(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("n_lines", "n_filled", "n_removed")]
    found = scratch.put(repeated(docs, scratch, text, min_words), "gone")
    left = docs.select(F.struct(*[F.col(c) for c in keep]).alias("r"), "doc_id", F.xxhash64(text).alias("print"), F.col(text).alias("text")).alias("d")
    both = left.join(found.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.print") == F.col("g.print")), "left").select("d.*", "g.gone", F.col("g.n_gone").alias("n"))
    copy = both.withColumn("row", F.row_number().over(W.partitionBy("doc_id", "print").orderBy("doc_id")))
    again = (F.col("row") > 1) & (F.aggregate(bare("text"), F.lit(0), lambda s, x: s + words(x)) >= min_words)
    # Lambdas refer to columns of the join alone: an expression in them would be worked out anew for each line.
    stays = F.filter(lines("text"), lambda x, i: F.call_function("shiftright", F.coalesce(F.get("gone", F.floor(i / 64).cast("int")), F.lit(0).cast("long")), (i % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 0)
    blank = F.filter(lines("text"), lambda x: ~filled(x))
    shorter = F.when(again, F.array_join(blank, "\n")).when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    count = lambda c: F.when(F.col("text").isNull(), 0).otherwise(F.size(c)).cast("long")
    removed = F.when(again, F.size(bare("text")).cast("long")).otherwise(F.coalesce("n", F.lit(0)))
    return copy.select(*[shorter.alias(c) if c == text else F.col("r")[c].alias(c) for c in keep], count(lines("text")).alias("n_lines"), count(bare("text")).alias("n_filled"), removed.alias("n_removed"))
