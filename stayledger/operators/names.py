"""Which booking names can mean which stay names, and how well.

Works on the distinct names of both sides.  A full booking name must agree with a full
stay name in surname *and* first name, so those pairs are found through the two small
vocabularies of surnames and first names: a booking name is rewritten to the surnames and
first names it may stand for, and meets stay names by equality.  A hot surname therefore
never pairs up everybody who carries it.  Names lacking a part (a bare surname above all)
have no such gate; their whole variants are matched instead.

`score_all_names` scores every pair of names.  Matching needs less: a name can only mean another
if both are there on one night.  Nights of a name are bitmaps, one BIGINT for 64 days.  Names meet within blocks of such words, which bounds the strings
compared to those of one time; pairs are then kept if two bitmaps share a bit, so the result
holds exactly the pairs with a common night, however long the blocks are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..functions.similarity import ratio, reached, similar_pairs, spread
from ..plans.shared import cut
from ..settings import Settings


#: Days of a bitmap, and bitmaps of a block in which names meet; results don't depend on either.
WORD_DAYS, BLOCK_WORDS = 64, 8


def word_of(day: Column) -> Column:
    return F.floor(F.unix_date(day) / WORD_DAYS)


def night_words(spans: DataFrame) -> DataFrame:
    """(name, words): bitmaps of the nights of the spans (name, from_day, to_day), as an array of (word, nights).

    A span has one row per 64 days, so a stay of years is a few dozen rows.
    """
    lo, hi = (F.pmod(F.unix_date(d) - F.col("word") * WORD_DAYS, F.lit(WORD_DAYS)).cast("int") for d in ("from_day", "to_day"))
    first = F.when(word_of(F.col("from_day")) == F.col("word"), lo).otherwise(0)
    last = F.when(word_of(F.col("to_day")) == F.col("word"), hi).otherwise(WORD_DAYS - 1)
    bits = F.expr("shiftleft(shiftrightunsigned(-1L, 63 - (last - first)), first)")
    words = spans.withColumn("word", F.explode(F.sequence(word_of(F.col("from_day")), word_of(F.col("to_day")))))
    words = (words.select("name", "word", first.alias("first"), last.alias("last")).withColumn("bits", bits)
             .groupBy("name", "word").agg(F.bit_or("bits").alias("nights")))
    return words.groupBy("name").agg(F.collect_list(F.struct("word", "nights")).alias("words"))


def _with_features(names: DataFrame) -> DataFrame:
    """Everything the score needs of a name, beside what is there."""
    k = F.col("name")
    df = names.select("*", T.surname(k).alias("_surname"), T.first_name(k).alias("_first"))
    return df.select(
        *names.columns,
        T.sort_tokens(F.col("_surname")).alias("surname"),
        T.sort_tokens(F.col("_first")).alias("first"),
        T.is_bare(k).alias("bare"),
        F.transform(T.name_variants(k), T.sort_tokens).alias("texts"),
        T.sort_tokens(T.strip(F.substring_index(k, ",", 1))).alias("short"),
        F.coalesce((F.col("_surname") != "") & (F.col("_first") != ""), F.lit(False)).alias("complete"))


def best_score(component_score: int) -> Column:
    """F24-F26 over the features of a stay name (s_) and of a booking name (b_).

    Both gates are open for a bare booking name, and each where a part is missing.
    """
    def agree(part: str) -> str:
        a, b = "s_" + part, "b_" + part
        return f"(b_bare OR {a} IS NULL OR {b} IS NULL OR {ratio(a, b)} >= {component_score})"

    texts = "if(b_bare AND s_short <> '', concat(s_texts, array(s_short)), s_texts)"
    scores = f"flatten(transform({texts}, x1 -> transform(b_texts, x2 -> {ratio('x1', 'x2')})))"
    return F.expr(f"if({agree('surname')} AND {agree('first')}, coalesce(array_max({scores}), 0D), 0D)")


def _forms(names: DataFrame, as_: str, settings: Settings, kinds: dict[str, tuple[str, Column]]) -> DataFrame:
    """The strings names may be found by, once each: kind, the similarity it needs, and the blocks it is in."""
    least = {"surname": settings.component_score, "first": settings.component_score}

    def structs(kind: str, what: str, when: Column) -> Column:
        need = least.get(kind, settings.accept_score)
        return F.when(when, F.transform(F.expr(what), lambda t: F.struct(F.lit(kind).alias("kind"), F.lit(need).alias("least"), t.alias(as_))))

    forms = F.flatten(F.array_compact(F.array(*[structs(kind, *how) for kind, how in kinds.items()])))
    return (names.select("blocks", F.inline(forms)).withColumn("block", F.explode("blocks"))
            .groupBy("kind", "least", as_).agg(F.collect_set("block").alias("blocks")))


TEXTS, STAY_TEXTS = "array_distinct(texts)", "array_distinct(concat(texts, array(short)))"


def name_pairs(stays: DataFrame, bookings: DataFrame, settings: Settings) -> DataFrame:
    """(booking_name, stay_name) that may be alike, of those that are there in one block: names with `blocks` and features."""
    whole, part = F.col("complete"), ~F.col("complete")
    own = {"surname": ("array(surname)", whole), "first": ("array(first)", whole)}
    left = _forms(stays, "a", settings, own | {"any": (STAY_TEXTS, F.lit(True)), "partial": (STAY_TEXTS, part)})
    right = _forms(bookings, "b", settings, own | {"any": (TEXTS, part), "partial": (TEXTS, whole)})
    right = right.join(left.select("kind").distinct(), "kind", "left_semi")  # mostly, no stay lacks a part
    alike = cut(similar_pairs(left, right, "least", ("kind", "least"), "blocks").select("kind", "a", "b"), "alike_forms")

    def of(kind: str, a: str, b: str) -> DataFrame:
        return alike.where(F.col("kind") == kind).select(F.col("a").alias(a), F.col("b").alias(b))

    s = stays.select(F.col("name").alias("stay_name"), "texts", "short", "complete", F.col("surname").alias("s_surname"),
                     F.col("first").alias("s_first"), F.explode("blocks").alias("block"))
    b = bookings.select(F.col("name").alias("booking_name"), "texts", "complete", F.col("surname").alias("b_surname"),
                        F.col("first").alias("b_first"), F.explode("blocks").alias("block"))
    full = (b.where("complete").select("booking_name", "block", "b_surname", "b_first")
            .join(of("surname", "s_surname", "b_surname"), "b_surname").join(of("first", "s_first", "b_first"), "b_first")
            .join(s.where("complete").select("stay_name", "block", "s_surname", "s_first"), ["block", "s_surname", "s_first"]))

    def by_text(kind: str, bookings: DataFrame, stays: DataFrame) -> DataFrame:
        """Pairs with an incomplete name on either side: whole variants are alike."""
        bt = bookings.select("booking_name", "block", F.explode(F.expr(TEXTS)).alias("b"))
        st = stays.select("stay_name", "block", F.explode(F.expr(STAY_TEXTS)).alias("a"))
        return bt.join(of(kind, "a", "b"), "b").join(st, ["block", "a"])

    found = [full, by_text("any", b.where(part), s), by_text("partial", b.where(whole), s.where(part))]
    pairs = [df.select("booking_name", "stay_name") for df in found]
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct()


def score_names(stay_spans: DataFrame, booking_spans: DataFrame, settings: Settings, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(booking_name, stay_name, score) for exactly the pairs that share a night and reach the
    acceptance score.

    Both sides are spans of nights, (name, from_day, to_day).
    """
    sides = [night_words(spans).withColumn("side", F.lit(side)) for side, spans in (("stay", stay_spans), ("booking", booking_spans))]
    blocks = F.array_distinct(F.transform("words", lambda w: F.floor(w["word"] / block_words)))
    names = cut(_with_features(sides[0].unionByName(sides[1]).withColumn("blocks", blocks)), "names")
    stays, bookings = names.where("side = 'stay'"), names.where("side = 'booking'")
    pairs = name_pairs(stays, bookings, settings)
    s = stays.select(F.col("name").alias("stay_name"), F.inline("words").alias("word", "s_nights"))
    b = bookings.select(F.col("name").alias("booking_name"), F.inline("words").alias("word", "b_nights"))
    together = (pairs.join(b, "booking_name").join(s, ["stay_name", "word"])
                .where("(s_nights & b_nights) <> 0").select("booking_name", "stay_name").distinct())
    return _scored(together, stays, bookings, settings)


def score_all_names(stay_names: DataFrame, booking_names: DataFrame, settings: Settings) -> DataFrame:
    """(booking_name, stay_name, score) for all pairs that reach the acceptance score, whenever they are there.

    Both sides are distinct names, (name).
    """
    sides = [names.select("name").withColumn("side", F.lit(side)) for side, names in (("stay", stay_names), ("booking", booking_names))]
    names = cut(_with_features(sides[0].unionByName(sides[1]).withColumn("blocks", F.array(F.lit(0)))), "all_names")
    stays, bookings = names.where("side = 'stay'"), names.where("side = 'booking'")
    return _scored(name_pairs(stays, bookings, settings), stays, bookings, settings)


def _scored(pairs: DataFrame, stays: DataFrame, bookings: DataFrame, settings: Settings) -> DataFrame:
    features = ["surname", "first", "bare", "texts", "short"]
    known = spread(pairs, "booking_name", "stay_name")
    for side, key, prefix in ((stays, "stay_name", "s_"), (bookings, "booking_name", "b_")):
        known = known.join(side.select(F.col("name").alias(key), *[F.col(f).alias(prefix + f) for f in features]), key)
    return known.select("booking_name", "stay_name", reached(best_score(settings.component_score), F.lit(settings.accept_score)).alias("score"))
