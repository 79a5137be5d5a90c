"""token-sort similarity, and a lossless equi-join form of "similar strings".

Similarity of two token-sorted strings is ``100 * (1 - indel / (l1 + l2))`` with
``indel = l1 + l2 - 2 * LCS``.  Spark has no LCS, but the bit-parallel recurrence of
Hyyro (2004) is one ``aggregate()`` over the characters of the second string, so the
kernel stays inside the JVM:

    v <- (v + (v & m)) | (v - (v & m))        m = positions of the character in string 1

and LCS is the number of zero bits left in ``v``.  A BIGINT carries 62 positions; where both
strings are longer, ``v`` is an array of such words and the sum's carry runs through them.

The functions return Spark SQL text: nested lambdas read better that way, and one
``expr`` is parsed at once.  ``transform(array(x), y -> ...)[0]`` names a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORD_BITS = 62


def _characters(a: str) -> str:
    return f"filter(split({a}, ''), ch -> ch <> '')"


def _bit_lcs(a: str, b: str) -> str:
    positions = ("aggregate(ca, named_struct('mask', 0L, 'bit', 1L), "
                 "(s, x) -> named_struct('mask', if(x = cb, s.mask | s.bit, s.mask), 'bit', s.bit * 2L), "
                 "s -> s.mask)")
    return (f"length({a}) - cast(bit_count("
            f"transform(array(shiftleft(1L, length({a})) - 1L), full -> "
            f"transform(array({_characters(a)}), ca -> "
            f"aggregate({_characters(b)}, full, (v, cb) -> "
            f"transform(array(v & {positions}), u -> ((v + u) | (v - u)) & full)[0]))[0])[0]) AS INT)")


def _long_lcs(a: str, b: str) -> str:
    full = (1 << WORD_BITS) - 1
    positions = ("aggregate(word.chars, named_struct('mask', 0L, 'bit', 1L), "
                 "(s, x) -> named_struct('mask', if(x = cb, s.mask | s.bit, s.mask), 'bit', s.bit * 2L), s -> s.mask)")
    words = (f"transform(sequence(0, (length({a}) - 1) DIV {WORD_BITS}), w -> named_struct("
             f"'chars', slice(ca, w * {WORD_BITS} + 1, {WORD_BITS}), 'left', if((w + 1) * {WORD_BITS} <= length({a}), {full}L, "
             f"shiftleft(1L, length({a}) - w * {WORD_BITS}) - 1L)))")
    # one word: u = v & m, total = v + u + carry, v <- (total | v - u) within the word's bits
    step = (f"transform(array(word.left & {positions}), u -> transform(array(named_struct('u', u, 'total', word.left + u + s.carry)), t -> "
            f"named_struct('words', concat(s.words, array(named_struct('chars', word.chars, 'left', (t.total & {full}L) | (word.left - t.u)))), "
            f"'carry', shiftright(t.total, {WORD_BITS})))[0])[0]")
    return (f"length({a}) - transform(array({_characters(a)}), ca -> transform(array({words}), start -> aggregate("
            f"aggregate({_characters(b)}, start, (ws, cb) -> aggregate(ws, named_struct('words', slice(ws, 1, 0), 'carry', 0L), "
            f"(s, word) -> {step}, s -> s.words)), 0, (n, word) -> n + CAST(bit_count(word.left & "
            f"shiftleft(1L, size(word.chars)) - 1L) AS INT)))[0])[0]")


def lcs_length(a: str, b: str) -> str:
    return (f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 WHEN {a} = {b} THEN length({a}) "
            f"WHEN length({a}) <= {WORD_BITS} THEN {_bit_lcs(a, b)} "
            f"WHEN length({b}) <= {WORD_BITS} THEN {_bit_lcs(b, a)} "
            f"ELSE {_long_lcs(a, b)} END")


def ratio(a: str, b: str) -> str:
    """0-100 similarity of two token-sorted strings; two empty strings are equal."""
    return (f"if({a} = {b}, 100D, 100D * (1D - (length({a}) + length({b}) - 2 * ({lcs_length(a, b)}))"
            f" / greatest(length({a}) + length({b}), 1)))")


def may_reach(a: str, b: str, score: int | str) -> str:
    """Cheap necessary condition: levenshtein never exceeds the indel distance."""
    return f"levenshtein({a}, {b}) * 100 <= (length({a}) + length({b})) * (100 - {score})"


# --- candidate keys ------------------------------------------------------------------
#
# Similar strings of lengths l1 and l2 are at most k inserts and deletes apart, so they have a
# common subsequence of t characters, u = l1 - t of the first and v = l2 - t of the second left
# out.  Two kinds of keys, by the two lengths alone; an equi-join on them loses no pair:
#
# * u and v of 2 at most, or 3 in strings of 10 at most, as with most names: what remains of a string
#   after all ways to leave out u (v) characters.  Equal remains are a common subsequence, so nothing
#   else shares a key, and a piece that many names have is never a key by itself.
# * else: cut the first string into k + 1 segments; one of them survives untouched and is found
#   in the second, shifted by no more than the edits before it allow (Li et al., PASS-JOIN, 2011).

#: Characters left out of either string, up to which what remains are the keys; in strings of FEW characters, one more.
LEFT_OUT, FEW = 2, 10


def _with_edits(l1: str, l2: str, score: int | str, body: str) -> str:
    """`body` with k = the largest indel distance that still reaches the score; it has the
    parity of l1 + l2 and is at least their difference."""
    most = f"CAST(floor(({l1} + {l2}) * (100 - {score}) / 100) AS INT)"
    return (f"transform(array({most}), m -> transform(array(m - pmod(m + {l1} + {l2}, 2)), k -> "
            f"if(k >= abs({l1} - {l2}), {body}, NULL))[0])[0]")


def _partner_lengths(length: str, score: int | str) -> str:
    return (f"sequence(greatest(CAST(floor({length} * {score} / (200 - {score})) AS INT), 1), "
            f"CAST(ceil({length} * (200 - {score}) / {score}) AS INT))")


def _start(i: str, length: str) -> str:
    return f"CAST(floor(({i}) * {length} / (k + 1)) AS INT)"


def _remains(text: str, score: int | str) -> str:
    """Array of arrays: the text with 0, 1, ... characters left out, as far as it may have a
    partner that needs them; none does where its own length allows for more."""
    shorter = ("array_distinct(flatten(transform(element_at(found, -1), w -> if(length(w) = 0, array(w), "
               "transform(sequence(1, length(w)), i -> concat(substring(w, 1, i - 1), substring(w, i + 1)))))))")
    levels = f"if(length({text}) <= {FEW}, {LEFT_OUT + 1}, if(length({text}) * (100 - {score}) < {100 * (LEFT_OUT + 1)}, {LEFT_OUT}, 0))"
    return f"aggregate(slice(sequence(1, {LEFT_OUT + 1}), 1, {levels}), array(array({text})), (found, n) -> concat(found, array({shorter})))"


def _keys(text: str, score: int | str, l1: str, l2: str, own: str, partner: str, segments: str) -> str:
    """Keys of `text` for every length of a partner: remains or segments."""
    short = f"(k + abs({l1} - {l2})) DIV 2 <= if(greatest({l1}, {l2}) <= {FEW}, {LEFT_OUT + 1}, {LEFT_OUT})"
    rest = f"element_at(remains, CAST((k + {own} - {partner}) DIV 2 AS INT) + 1)"
    body = f"if({short}, transform({rest}, w -> xxhash64({l1}, {l2}, -1, w)), {segments})"
    lengths = _partner_lengths(f"length({text})", score)
    per_length = f"transform({lengths}, {partner} -> {_with_edits(l1, l2, score, body)})"
    return (f"transform(array({_remains(text, score)}), remains -> "
            f"array_distinct(flatten(filter({per_length}, x -> x IS NOT NULL))))[0]")


def indexed_keys(text: str, score: int | str) -> str:
    l1 = f"length({text})"
    segment = f"substring({text}, {_start('i', l1)} + 1, {_start('i + 1', l1)} - {_start('i', l1)})"
    return _keys(text, score, l1, "l2", l1, "l2", f"transform(sequence(0, k), i -> xxhash64({l1}, l2, i, {segment}))")


def probe_keys(text: str, score: int | str) -> str:
    l2 = f"length({text})"
    placed = (f"transform(sequence(greatest(g.start - (k - {l2} + l1) DIV 2, 0), "
              f"greatest(least(g.start + (k + {l2} - l1) DIV 2, {l2} - g.size), "
              f"greatest(g.start - (k - {l2} + l1) DIV 2, 0))), "
              f"p -> xxhash64(l1, {l2}, i, substring({text}, CAST(p AS INT) + 1, g.size)))")
    segment = f"named_struct('start', {_start('i', 'l1')}, 'size', {_start('i + 1', 'l1')} - {_start('i', 'l1')})"
    segments = f"flatten(transform(sequence(0, k), i -> transform(array({segment}), g -> {placed})[0]))"
    return _keys(text, score, "l1", l2, l2, "l1", segments)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal rows to all shuffle partitions: few bytes, but much work a row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def reached(value: Column, least: Column) -> Column:
    """Rows with at least `least`, and the value: a generator, as a filter would be evaluated apart and do the work twice."""
    return F.explode(F.filter(F.array(value), lambda x: x >= least))


def candidate_pairs(left: DataFrame, right: DataFrame, score: int | str, keys: tuple[str, ...] = ("kind",),
                    within: str | None = None) -> DataFrame:
    """Distinct pairs (*keys, a, b) of equal `keys` that share a key where similar strings do.

    `within` names an array column: only strings with a common element meet.  Keys are made
    once per string.
    """
    held = [within] if within else []

    def keyed(strings: DataFrame, text: str, made: str) -> DataFrame:
        own = spread(strings.where(f"{text} <> ''"), *keys, text).select(*keys, text, *held, F.explode(F.expr(made)).alias("seg"))
        return own.withColumn(within, F.explode(within)) if within else own

    l, r = keyed(left, "a", indexed_keys("a", score)), keyed(right, "b", probe_keys("b", score))
    return l.join(r, [*held, *keys, "seg"]).select(*keys, "a", "b").distinct()


def similar_pairs(left: DataFrame, right: DataFrame, score: int | str, keys: tuple[str, ...] = ("kind",),
                  within: str | None = None) -> DataFrame:
    """Pairs (*keys, a, b) of token-sorted strings whose similarity reaches `score`.

    ``left`` has the columns ``*keys, a`` and ``right`` ``*keys, b``, every string once; only strings
    of equal keys that meet (see `candidate_pairs`) are compared.  `score` is a number or names one
    of the keys.  Levenshtein (code-generated) rejects most of what shares a key and is not alike,
    and only the rest pays for the exact score.
    """
    pairs = spread(candidate_pairs(left, right, score, keys, within).where(may_reach("a", "b", score)), *keys, "a", "b")
    return pairs.select(*keys, "a", "b", reached(F.expr(ratio("a", "b")), F.expr(score) if isinstance(score, str) else F.lit(score)).alias("ratio"))
