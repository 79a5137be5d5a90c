"""Line dedup: repeated runs of lines, found by a suffix array over line-ID sequences.

Only lines found twice or more can be part of a repeated run, so the sequences are those
lines, cut where a line is unique.  Everything is DataFrame operations:

* `doubled` builds the ranks of all suffixes by their first 1, 2, 4, ... lines.  A round
  joins each suffix's rank with the one 2^k lines on, counts the distinct pairs (pre-
  aggregated), and numbers them by running counts: first over stretches of the second
  rank, then inside a stretch, so no window holds a whole hot group.  A class of two or
  more suffixes is an interval of the suffix array whose common prefix is at least 2^k
  lines; suffixes alone in their class leave.
* `previous` finds, for every suffix, the longest prefix that an earlier suffix has too:
  going down the powers of two, a suffix moves into the interval of its prefix 2^k lines
  longer if it isn't the first one there.  The first one goes along to stand for the
  earlier copy and stays behind as well, so no interval loses its earliest member.
* A prefix of at least `min_words` words is a later copy, and its lines are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.shared import cut
from .common import WORD

#: Stretches that a rank range is cut into.
STRETCHES = 4096


def _identity(key: str, text: str) -> list[Column]:
    """A document: null keys last, then the key, then its text."""
    return [F.col(key).isNull().alias("nul"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("key"),
            F.xxhash64(F.col(text)).alias("hash")]


DOC = ["nul", "key", "hash"]


def line_ids(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(document, seq, line, id_a, id_b, words): the lines with a word, in order.  `line`
    counts all lines, `seq` those with a word; the two hashes are a 128-bit line ID."""
    parts = F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    worded = F.filter(parts, lambda p: p["x"].rlike(r"[^\x20\x09-\x0D]"))
    one = docs.where(F.col(text).isNotNull()).select(*_identity(key, text), F.col(text).alias("text")).withColumn("parts", worded)
    flat = one.select(*DOC, F.posexplode("parts").alias("seq", "p"))
    return flat.select(*DOC, "seq", "p.line", F.xxhash64("p.x").alias("id_a"), F.xxhash64(F.lit(1), F.col("p.x")).alias("id_b"),
                       F.regexp_count("p.x", F.lit(WORD)).alias("words"))


def repeated_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The lines of `line_ids` that are found twice or more, with their rank: the number of
    such lines with a smaller ID."""
    lines = cut(line_ids(docs, key, text).distinct(), "lines")
    classes = lines.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = cut(classes.withColumn("stretch", F.shiftright("id_a", 52)), "classes")
    ranked = _numbered(classes, [], "stretch", ["id_a", "id_b"])
    return cut(lines.join(ranked.select("id_a", "id_b", F.col("smaller").alias("rank")), ["id_a", "id_b"])
               .select(*DOC, "seq", "line", "words", "rank"), "repeated")


def _numbered(classes: DataFrame, group: list[str], stretch: str, order: list[str]) -> DataFrame:
    """`classes` with `smaller`: the members (n) of the classes before it in its group."""
    sums = classes.groupBy(*group, stretch).agg(F.sum("n").alias("m"))
    earlier = Window.partitionBy(*group).orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, stretch, F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*group, stretch).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (classes.join(starts, [*group, stretch]).withColumn("smaller", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .drop("start"))


def doubled(first: DataFrame) -> list[DataFrame]:
    """Ranks by the first 1, 2, 4, ... lines: (document, seq, rank) of the suffixes whose
    class has two or more members.  Suffixes of one class share the rank; ranks order
    suffixes as their line ranks do."""
    levels = [first.select(*DOC, "seq", "rank")]
    total = levels[0].count()
    while total:
        now = levels[-1]
        ahead = now.select(*DOC, (F.col("seq") - (1 << (len(levels) - 1))).alias("seq"), F.col("rank").alias("next"))
        pairs = now.join(ahead, [*DOC, "seq"])
        classes = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n"))
        classes = cut(classes.withColumn("stretch", F.floor(F.col("next") * STRETCHES / total)), "pairs")
        ranked = _numbered(classes, ["rank"], "stretch", ["next"]).where("n > 1")
        level = cut(pairs.join(ranked.select("rank", "next", (F.col("rank") + F.col("smaller")).alias("new")), ["rank", "next"])
                    .select(*DOC, "seq", F.col("new").alias("rank")), "level")
        if level.isEmpty():
            break
        levels.append(level)
    return levels


def previous(levels: list[DataFrame]) -> DataFrame:
    """(document, seq, length): the longest prefix that a suffix of an earlier place shares."""
    place = F.struct(*DOC, "seq")
    state = levels[0].select(*DOC, "seq", F.lit(0).alias("length"), F.lit(None).cast(
        "struct<nul:boolean,key:bigint,hash:bigint,seq:int>").alias("leader"), F.lit(True).alias("seeks"))
    for k in reversed(range(len(levels))):
        ahead = levels[k].select(*DOC, F.col("seq").alias("end"), "rank")
        tried = state.withColumn("end", F.col("seq") + F.col("length")).join(ahead, [*DOC, "end"], "left").drop("end")
        tried = cut(tried.withColumn("place", place), "tried")
        able = tried.where("rank is not null")
        group = able.groupBy("length", "leader", "rank").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
        group = group.select(F.col("length").alias("l"), F.col("leader").alias("d"), F.col("rank").alias("r"), "low")
        joined = tried.join(group, F.expr("length = l and leader <=> d and rank = r"), "left").drop("l", "d", "r")
        moves = F.coalesce(F.col("place") > F.col("low"), F.lit(False))
        leads = F.coalesce(F.col("place") == F.col("low"), F.lit(False))
        longer = (F.col("length") + (1 << k)).alias("length")
        here = F.struct("length", "leader", "seeks")
        there = F.struct(longer, F.col("low").alias("leader"), F.lit(True).alias("seeks"))
        support = F.struct(longer, F.col("low").alias("leader"), F.lit(False).alias("seeks"))
        after = F.when(moves & F.col("seeks"), F.array(there)).when(leads, F.array(here, support)).otherwise(F.array(here))
        state = cut(joined.select(*DOC, "seq", F.explode(after).alias("s")).select(*DOC, "seq", "s.*"), "state")
    return state.where("seeks and length > 0").select(*DOC, "seq", "length")


def later_copies(docs: DataFrame, min_words: int, key: str, text: str) -> DataFrame:
    """(document, lines): numbers of the lines that are part of a later copy."""
    lines = repeated_lines(docs, key, text)
    found = previous(doubled(lines))
    upto = Window.partitionBy(*DOC).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    known = cut(lines.select(*DOC, "seq", "line", "words", F.sum("words").over(upto).alias("upto")), "known")
    ends = known.select(*DOC, F.col("seq").alias("last"), F.col("upto").alias("run_end"))
    runs = (found.join(known.select(*DOC, "seq", (F.col("upto") - F.col("words")).alias("run_start")), [*DOC, "seq"])
            .withColumn("last", F.col("seq") + F.col("length") - 1).join(ends, [*DOC, "last"])
            .where(F.col("run_end") - F.col("run_start") >= min_words).select(*DOC, "seq", "last"))
    reach = F.max("last").over(upto)
    covered = known.join(runs, [*DOC, "seq"], "left").withColumn("reach", reach).where("reach >= seq")
    return covered.groupBy(*DOC).agg(F.collect_list("line").alias("lines"))


def without_repeats(docs: DataFrame, min_words: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the lines that belong to a later copy of a run of lines with at least
    `min_words` words in all, and with `n_removed`, their number.

    The first copy, by key (null last), then text, then line, stays.  Lines are compared as
    they are; lines without a word are no part of runs and stay.  Null texts stay null;
    rows of equal key and text are one document and lose the same lines; an empty table
    gives an empty table; other columns are carried along."""
    gone = later_copies(docs, min_words, key, text).select(*(F.col(c).alias("_run_" + c) for c in DOC), F.col("lines").alias("_run_lines"))
    own = dict(zip(("_own_nul", "_own_key", "_own_hash"), _identity(key, text)))
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains("_run_lines", i))
    joined = docs.withColumns(own).join(gone, F.expr("_own_nul = _run_nul and _own_key = _run_key and _own_hash = _run_hash"), "left")
    cleaned = F.when(F.col("_run_lines").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    return (joined.withColumn(text, cleaned).withColumn("n_removed", F.coalesce(F.size("_run_lines"), F.lit(0)))
            .select(*[F.col(f"`{c}`") for c in docs.columns if c != "n_removed"], "n_removed"))
