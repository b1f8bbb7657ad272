"""Removal of repeated runs of lines, by a suffix array over line ids (DataFrame functions only).

A text is the sequence of its lines.  Lines that occur once can be in no repeated run; the others
get an id, and positions number them in (id, text hash, line) order, so that a run of them, which
lines that occur once or the text's ends cut off, has consecutive positions.

Suffix array.  The suffixes of all runs are sorted by distributed prefix doubling: a suffix starts
with the rank of its first ``HEAD`` lines; in round k the rank of its first HEAD 2^(k+1) lines follows
from those of two neighbouring halves, until it is told from all others or its run has ended.  A
suffix keeps the ranks of all its rounds, its path: paths compare as the suffixes do.

Common prefixes.  Neighbours in the suffix array whose paths agree in c ranks share HEAD 2^(c-1)
lines; what follows these is compared in the same way, until a line differs or a run ends.  That
gives the longest common prefix of each suffix with its neighbours, and so the LCP intervals.

Deletion.  A run counts if it has at least ``min_words`` words.  Every line of such a run lies in a
window of least length with that many words, which starts or ends at a line of the run; a window
repeats if it is no longer than a common prefix of its suffix, and then its LCP interval is named
by its lines, or by the ranks of its first and last HEAD 2^k lines.  The interval's first member in
order keeps its lines, the windows of later members are deleted; overlapping windows make up the
maximal runs.

What is shuffled: hashes of all lines once (counted before the shuffle), then only rows of
repeated lines; and the documents once, to be joined with their deleted ranges.  Rows of a line or
an interval that holds a large share of all stay where they are (``join_hot``).

Nulls and empty texts: a null text has no lines and stays null; an empty one has one empty line.
A null id sorts first.  Repeated rows (same id, same text) are one document: both keep the same
lines.  Very long texts: one document's repeated lines are sorted in one task.  Ties: see the
order above.  Empty tables: an empty result.  Extra columns pass through untouched, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import free_names, join_hot, stored

MIN_WORDS = 10
#: Lines that the first ranks are made of.
HEAD = 32
_SPACE = r"[\x20\x09-\x0D]+"
INFO = ("lines_before", "lines_deleted", "ranges_deleted")


def _ranked(keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds a rank that follows the order of ``by``: partitions are ranges, rows in them sorted."""
    return stored(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()), "ranks")


def positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Repeated lines: id, th (hash of the text), i (line), p (position), run (its first position),
    left (lines of the run from here on), w (words), through (words of the run up to here), r."""
    lines = (
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("i", "line"))
        .select("id", "th", "i", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(7)).alias("h2"), F.size(F.filter(F.split("line", _SPACE), lambda w: w != "")).alias("w"))
    )
    often = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = _ranked(often, ["h1", "h2"], "r")
    at = stored(join_hot(lines, often, ["h1", "h2"], "n").select("id", "th", "i", "w", "r").distinct(), "repeated")
    doc, along = Window.partitionBy("id", "th").orderBy("i"), Window.partitionBy("id", "th", "g").orderBy("i")
    # a document lies in one partition, so neither window shuffles again
    laid = at.repartitionByRange("id", "th").withColumn("g", F.col("i") - F.row_number().over(doc))
    laid = laid.withColumns({"k": F.row_number().over(along), "left": F.count(F.lit(1)).over(Window.partitionBy("id", "th", "g")), "through": F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, 0))})
    ahead = F.collect_list("r").over(along.rowsBetween(0, HEAD - 1))
    laid = laid.withColumn("head", ahead).sortWithinPartitions("id", "th", "i").withColumn("p", F.monotonically_increasing_id())
    return stored(laid.select("id", "th", "i", "p", (F.col("p") - F.col("k") + 1).alias("run"), (F.col("left") - F.col("k") + 1).cast("int").alias("left"), "w", "through", "head"), "positions")


def suffix_paths(at: DataFrame) -> DataFrame:
    """p, left, head (the first HEAD lines) and path (the ranks of all rounds) of every suffix."""
    names = _ranked(at.groupBy("head").agg(F.count(F.lit(1)).alias("n")), ["head"], "next")
    made = join_hot(at.select("p", "left", "head"), names, ["head"], "n")
    still = lambda step: (F.col("n") > 1) & (F.col("left") > step)
    made = stored(made.select("p", "left", "head", F.array("next").alias("path"), still(HEAD).alias("open")), "doubled")
    done, step = [], HEAD
    while True:
        done.append(made.where("not open").drop("open"))
        active = made.where("open").drop("open")
        if active.isEmpty():
            break
        every = active.select("p", "path")
        for d in done:
            every = every.unionByName(d.select("p", "path"))
        every = every.select(F.col("p").alias("x"), F.col("path").alias("q"))
        # an active suffix has more than ``step`` lines, so its second half is there
        pairs = active.withColumn("x", F.col("p") + step).join(every, "x").select("p", "left", "head", "path", "q", F.element_at("path", -1).alias("r"))
        pairs = stored(pairs, "pairs")
        names = _ranked(pairs.groupBy("r", "q").agg(F.count(F.lit(1)).alias("n")), ["r", "q"], "next")
        made = join_hot(pairs, names, ["r", "q"], "n")
        step *= 2
        made = stored(made.select("p", "left", "head", F.concat("path", F.array("next")).alias("path"), still(step).alias("open")), "doubled")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out if len(done) == 1 else stored(out, "paths")


def suffix_array(paths: DataFrame) -> DataFrame:
    """The suffixes in order, equal ones once: at (place, rising with the order, with gaps), size and
    last (of the path: they name it), p (the first), n (how many), left, path, head; and of the one
    before it: before (p), its path, head and left (before_...)."""
    spark = paths.sparkSession
    each = paths.groupBy(F.size("path").alias("size"), F.element_at("path", -1).alias("last")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("p", "left", "path", "head")).alias("x")).select("size", "last", "n", "x.*")
    each = stored(each, "suffixes")
    order = stored(each.repartitionByRange("path").sortWithinPartitions("path").withColumns({"at": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "order")
    # a row a partition: where its first suffix stands, and which was the last one before it
    own = F.struct("p", "left", "path", "head")
    ends = order.groupBy("part").agg(F.min("at").alias("at"), F.max_by(own, "at").alias("end")).orderBy("part").collect()
    firsts = [(b.at, a.end) for a, b in zip(ends, ends[1:])]
    firsts = F.broadcast(spark.createDataFrame(firsts, "at long, end struct<p:long,left:int,path:array<bigint>,head:array<bigint>>"))
    lagged = order.withColumn("prior", F.lag(own).over(Window.partitionBy("part").orderBy("at"))).join(firsts, "at", "left").withColumn("prior", F.coalesce("prior", "end"))
    return lagged.drop("end", "part").select("*", F.col("prior.p").alias("before"), *[F.col(f"prior.{c}").alias(f"before_{c}") for c in ("left", "path", "head")]).drop("prior")


def common_prefixes(array: DataFrame, paths: DataFrame) -> DataFrame:
    """p, before and lcp (lines) of neighbours in the suffix array."""
    agree = lambda x, y: F.expr(f"aggregate(sequence(1, least(size({x}), size({y}))), 0, (c, i) -> if(c = i - 1 and element_at({x}, i) = element_at({y}, i), i, c))")
    one, two = paths.selectExpr("p as a", "path as x", "left as u", "head as f"), paths.selectExpr("p as b", "path as y", "left as v", "head as g")
    met = array.where("before is not null").selectExpr("p", "before", "p as a", "before as b", "0 as lcp", "path as x", "left as u", "head as f", "before_path as y", "before_left as v", "before_head as g")
    out = None
    while True:
        met = met.withColumn("c", agree("x", "y"))
        # equal paths: the same lines to the end of both runs; no rank in common: within the heads
        jump = F.when(F.col("x") == F.col("y"), F.col("u")).when(F.col("c") > 0, F.expr(f"cast(shiftleft({HEAD}, c - 1) as int)")).otherwise(agree("f", "g"))
        met = met.withColumn("jump", jump).withColumn("open", (F.col("c") > 0) & (F.least("u", "v") > F.col("jump")))
        met = stored(met.select("p", "before", (F.col("a") + F.col("jump")).alias("a"), (F.col("b") + F.col("jump")).alias("b"), (F.col("lcp") + F.col("jump")).alias("lcp"), "open"), "lcp")
        settled = met.where("not open").select("p", "before", "lcp")
        out = settled if out is None else out.unionByName(settled)
        todo = met.where("open").drop("open")
        if todo.isEmpty():
            return out
        met = todo.join(one, "a").join(two, "b")


def _windows(at: DataFrame, min_words: int) -> DataFrame:
    """(run, s, m): for each suffix the least run of repeated lines with min_words words that
    starts at it, and for each line the least that ends at it.

    With running word counts, a run from s to e counts if before(s) + min_words <= through(e).
    Starts and ends are put in one order by these keys; the partner of each is its neighbour of
    the other kind.
    """
    both = at.select(
        "run", "p",
        F.explode(F.array(F.struct((F.col("through") - F.col("w") + min_words).alias("key"), F.lit(0).alias("kind")), F.struct(F.col("through").alias("key"), F.lit(1).alias("kind")))).alias("x"),
    ).select("run", "p", "x.key", "x.kind")
    order = Window.partitionBy("run").orderBy("key", "kind", "p")
    back = Window.partitionBy("run").orderBy(F.desc("key"), F.desc("kind"), F.desc("p"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    end_after = F.last(F.when(F.col("kind") == 1, F.col("p")), ignorenulls=True).over(upto(back))
    start_before = F.last(F.when(F.col("kind") == 0, F.col("p")), ignorenulls=True).over(upto(order))
    found = both.select("run", F.when(F.col("kind") == 0, F.col("p")).otherwise(start_before).alias("s"), F.when(F.col("kind") == 1, F.col("p")).otherwise(end_after).alias("e"))
    return found.where("s is not null and e is not null and e >= s").select("run", "s", (F.col("e") - F.col("s") + 1).cast("int").alias("m")).distinct()


def repeated_ranges(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with deletions: id, th (hash of the text) and ranges, a sorted array of
    (first, last) line numbers to delete."""
    at = positions(docs, id_col, text_col)
    paths = suffix_paths(at)
    array = stored(suffix_array(paths), "array")
    lcp = common_prefixes(array, paths)
    # the longest prefix that a suffix shares with any other: with a neighbour, or all of it if it has equals
    shared = lcp.select("p", "lcp").unionByName(lcp.select(F.col("before").alias("p"), "lcp")).groupBy("p").agg(F.max("lcp").alias("lcp"))
    shared = array.select("size", "last", "n", "p").join(shared, "p", "left").select("size", "last", "n", F.coalesce("lcp", F.lit(0)).alias("lcp"))

    asked = _windows(at, min_words).join(paths.withColumnRenamed("p", "s"), "s").withColumns({"size": F.size("path"), "last": F.element_at("path", -1)})
    asked = join_hot(asked, stored(shared, "shared"), ["size", "last"], "n").where("m <= lcp or n > 1 and m <= left").select("run", "s", "m", "path", "head")
    asked = stored(asked, "asked")
    few = asked.where(F.col("m") <= HEAD).select("run", "s", "m", F.slice("head", F.lit(1), F.col("m")).alias("name"))
    many = asked.where(F.col("m") > HEAD).withColumn("k", F.floor(F.log2((F.col("m") + F.lit(0.5)) / HEAD)).cast("int"))
    many = many.select("run", "s", "m", "k", F.element_at("path", F.col("k") + 1).alias("ra"), (F.col("s") + F.col("m") - F.expr(f"cast(shiftleft({HEAD}, k) as int)")).alias("e"))
    many = many.join(paths.select(F.col("p").alias("e"), "path"), "e").select("run", "s", "m", F.array("ra", F.element_at("path", F.col("k") + 1)).alias("name"))
    named = stored(few.unionByName(many), "named")
    first = stored(named.groupBy("m", "name").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first")), "intervals")
    later = join_hot(named, first, ["m", "name"], "n").where("s <> first")

    # overlapping windows become maximal runs: a running count of windows begun and ended
    ends = later.select("run", F.explode(F.array(F.struct(F.col("s").alias("p"), F.lit(1).alias("d")), F.struct((F.col("s") + F.col("m")).alias("p"), F.lit(-1).alias("d")))).alias("x"))
    steps = ends.groupBy("run", "x.p").agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy("run").orderBy("p")
    runs = steps.select("run", "p", F.lead("p").over(w).alias("q"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("open")).where("open > 0")
    whose = at.where("p = run").select("run", "id", "th", "i")
    line = lambda p: (F.col("i") + F.col(p) - F.col("run")).cast("int")
    ranges = runs.join(whose, "run").select("id", "th", F.struct(line("p").alias("first"), (line("q") - 1).alias("last")).alias("x"))
    return ranges.groupBy("id", "th").agg(F.sort_array(F.collect_list("x")).alias("ranges"))


def info_columns(docs: DataFrame) -> list[str]:
    """Names of the columns that ``delete_runs`` adds: those of INFO, numbered where docs has them."""
    taken = {c.lower() for c in docs.columns}
    return [free_names(docs, c)[0] if c in taken else c for c in INFO]


def delete_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its columns, the text without later copies, and three more columns (see
    ``info_columns``): lines_before, lines_deleted, ranges_deleted."""
    info = info_columns(docs)
    of, th, ranges = free_names(docs, "run_id", "run_text", "run_ranges")
    found = repeated_ranges(docs, min_words, id_col, text_col).select(F.col("id").alias(of), F.col("th").alias(th), F.col("ranges").alias(ranges))
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col(of)) & (F.xxhash64(text_col) == F.col(th)), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.exists(F.col(ranges), lambda r: (i >= r["first"]) & (i <= r["last"])))
    gone = F.aggregate(F.coalesce(ranges, F.expr("cast(array() as array<struct<first:int,last:int>>)")), F.lit(0), lambda n, r: n + (r["last"] - r["first"] + 1).cast("int"))
    text: Column = F.when(F.col(ranges).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    own = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*own, F.coalesce(F.size(lines), F.lit(0)).alias(info[0]), gone.alias(info[1]), F.col(ranges).alias(info[2]))
