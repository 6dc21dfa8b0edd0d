"""Spelling variants of words, found with PartEnum signatures of their letters.

A word's letters with their counts are a set of (letter, how manieth): a
binary vector.  One inserted or deleted letter changes that vector in one
place, a replaced letter in two.  The vector's places are dealt to PARTS parts
by a hash; whatever the change touches, one choice of the untouched parts is
equal in both words.  A signature is the letters in such a choice, and words
are joined on equal signatures and verified.  To words of one length belong
choices that leave out two of PARTS parts, to words of neighbouring lengths
choices that leave out one of PARTS_OF_ONE.  A change also leaves the front or
the back half of the shorter word in place, so the half is part of the
signature, which keeps rearranged letters out of the comparison.  The search
is exact: the signatures miss no pair.

Words are maximal runs of RUN in the whole text with A-Z in lower case.  Every
occurrence is counted, repeated rows as often as they stand there; a null text
has none, a null id reads as the empty string where misspellings are planted.
Words of equal count are ordered by code point.  An empty table gives no rows.
Texts are never shuffled, and words are counted before they are; columns are
taken by name, so further columns never clash.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.llm.columns import let, named, whole
from shopgrain.sources.shared import materialize

RUN = r"[A-Za-zÀ-ÿ]+"
PARTS = 5
PARTS_OF_ONE = 3
MIN_LENGTH = 7
MIN_COUNT = 2
#: A word's form is at least this many times as frequent.
FACTOR = 10
#: One in so many distinct words of a document is misspelt on purpose.
PLANTED = 31

WORDS_PER_TASK = 20_000
#: Words of more code points are compared without the built-in distance.
LONG = 256

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, least: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id (as text), run: every run of at least ``least`` code points, A-Z in lower case."""
    found = F.regexp_extract_all(F.translate(whole(named(text_column)), _UPPER, _LOWER), F.lit(RUN), F.lit(0))
    return docs.select(
        F.coalesce(named(id_column).cast("string"), F.lit("")).alias("doc_id"),
        F.explode(F.filter(found, lambda w: F.char_length(w) >= least)).alias("run"),
    )


def misspelt(doc_id: Column, run: Column, one_in: int = PLANTED) -> Column:
    """The run, without one letter where the digest of id and run says so."""
    def cut(h: Column) -> Column:
        at = (h % F.char_length(run)).cast("int")
        shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
        return F.when(h % one_in == 0, shorter).otherwise(run)

    return let(F.crc32(F.encode(F.concat(doc_id, F.lit(":"), run), "UTF-8")), cut)


def word_counts(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    counted = words.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= min_count)


def part_digests(word: Column, parts: int) -> Column:
    """For each part the exclusive or of the digests of the (letter, how manieth) that are dealt to it.

    Equal letters stand together in the sorted word, so one walk numbers them,
    in time that grows with the word.
    """
    none = F.lit(0).cast("long")
    start = F.struct(F.lit("").alias("c"), F.lit(0).alias("nth"), *[none.alias(f"part{q}") for q in range(parts)])

    def step(s: Column, c: Column) -> Column:
        def add(at: Column) -> Column:
            part = F.pmod(at["digest"], F.lit(parts))
            return F.struct(c.alias("c"), at["nth"].alias("nth"), *[
                F.when(part == q, s[f"part{q}"].bitwiseXOR(at["digest"])).otherwise(s[f"part{q}"]).alias(f"part{q}")
                for q in range(parts)
            ])

        nth = F.when(s["c"] == c, s["nth"] + 1).otherwise(F.lit(0))
        return let(let(nth, lambda n: F.struct(n.alias("nth"), F.xxhash64(c, n).alias("digest"))), add)

    return F.aggregate(F.array_sort(F.split(word, "")), start, step)


def signatures(words: DataFrame, parts: int, left_out: int, shorter: Column) -> DataFrame:
    """word, n, signature: for both halves, one for each choice of ``left_out`` of ``parts`` parts.

    ``shorter`` is the length of the shorter word of the pairs looked for.
    """
    half = F.floor(shorter / 2).cast("int")
    rest = (shorter - half).cast("int")
    rows = words.withColumns({
        "length": shorter.cast("int"), "dealt": part_digests(F.col("word"), parts),
        "front": F.substring(F.col("word"), F.lit(1), half),
        "back": F.substring(F.col("word"), F.char_length("word") - rest + 1, rest),
    })
    keys = [
        F.xxhash64(F.lit(f"{side} {out}"), "length", side, *[f"dealt.part{q}" for q in range(parts) if q not in out])
        for side in ("front", "back") for out in combinations(range(parts), left_out)
    ]
    return rows.select("word", "n", F.explode(F.array(*keys)).alias("signature"))


def one_edit(word: Column, other: Column) -> Column:
    """Whether the words, ``other`` not shorter, differ by one inserted, deleted or replaced code point.

    The built-in distance takes time by the square of the length, so words
    over LONG are compared letter by letter: what follows the first difference
    has to be equal.
    """
    def compared(first: Column) -> Column:
        behind = first + (F.char_length(word) == F.char_length(other)).cast("int")
        rest, other_rest = F.substring(word, behind, F.char_length(word)), F.substring(other, first + 1, F.char_length(other))
        return (first > 0) & (rest == other_rest)

    unequal = F.zip_with(F.split(word, ""), F.split(other, ""), lambda a, b: ~a.eqNullSafe(b))
    slow = let(F.array_position(unequal, True).cast("int"), compared)
    return F.when(F.char_length(other) <= LONG, F.levenshtein(word, other, 1) == 1).otherwise(
        (F.char_length(other) - F.char_length(word) <= 1) & slow
    )


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n of all pairs one edit apart, each pair once; ``words`` has word (distinct) and n."""
    length = F.char_length("word")
    # The words are few bytes and many signatures, so they are spread by number.
    words = words.repartition(max(1, ceil(words.count() / WORDS_PER_TASK)), "word")
    same, short, long = (
        signatures(words, PARTS, 2, length), signatures(words, PARTS_OF_ONE, 1, length),
        signatures(words, PARTS_OF_ONE, 1, length - 1),
    )

    def met(left: DataFrame, right: DataFrame, more: Column | None = None) -> DataFrame:
        # Both sides are renamed, so that a join of signatures with themselves shuffles them once.
        left, right = (
            side.select(F.col("word").alias(word), F.col("n").alias(n), "signature")
            for side, word, n in ((left, "a", "a_n"), (right, "b", "b_n"))
        )
        near = one_edit(F.col("a"), F.col("b"))
        rows = left.hint("merge").join(right, "signature").filter(near if more is None else more & near)
        return rows.select("a", "a_n", "b", "b_n")

    found = met(same, same, F.col("a") < F.col("b")).unionByName(met(short, long)).distinct()
    return found.toDF("word", "n", "other", "other_n")


def with_forms(words: DataFrame, pairs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n: its most frequent near word, where that is ``factor`` times as frequent."""
    both = pairs.unionByName(pairs.select(
        F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"),
    ))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"),
    )
    rows = words.join(best, "word", "left").withColumn("found", -F.col("best.less") >= F.col("n") * factor)
    return rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("found"), F.col("best.other")).alias("form"), F.when(F.col("found"), -F.col("best.less")).alias("form_n"),
    )


def with_roots(rows: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``rows`` with root, the end of the way from word to form to its form.

    A form is ``factor`` times as frequent, so a way is no longer than the
    logarithm of the largest count, and each round doubles what is known of it.
    """
    links = materialize(rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    most = rows.agg(F.max("n")).first()[0] or 1
    for _ in range(ceil(log2(max(1.0, log(most, factor) + 1)))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialize(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return rows.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of counted words (word, n)."""
    words = materialize(words)
    pairs = materialize(near_pairs(words))
    return with_roots(materialize(with_forms(words, pairs))).select("word", "form", "root", "n", "n_near", "form_n")


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Spelling variants among the words of documents with planted misspellings; the result of :func:`grouped`."""
    found = runs(docs, MIN_LENGTH, id_column, text_column)
    return grouped(word_counts(found.select(misspelt(F.col("doc_id"), F.col("run")).alias("word"))))
