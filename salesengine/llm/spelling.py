"""Spelling variants: words a few edits apart, found by pivotal grams.

A word's *grams* are its pairs of neighbouring code points, each with its
place.  Grams are ranked by how many words have them, rare ones first.  A
word's *prefix* holds its ``2 * edits + 1`` first grams in that order, with all
further places of the last of them; its *pivots* are ``edits + 1`` disjoint
grams of the prefix whose words are fewest, chosen by dynamic programming.

``edits`` edits leave at least one pivot of either word whole, so of two near
words the one whose prefix ends earlier in the ranking has a pivot in the
other's prefix.  Pivots are looked up among prefixes by an equi-join on gram,
place and length: the edits before a gram move its place, those after it make
up the rest of the difference in length, which leaves few places to look at
(five for one edit).  A single edit leaves the word as it was up to the gram or
from it on, so for one edit that part is in the join key, too.  Candidates are
verified by their edit distance.

Forms: a word's form is its near word with the most occurrences (ties: the
first in code-point order) if that has at least ``ratio`` times its own, and its
root is where following forms ends.  Occurrences grow by ``ratio`` with every
step, so chains are short; they're followed by doubling.

Everything is a join or an aggregate of words; a gram is two of the 90 letters
that words are made of, so the ranking has 8,100 rows at most and is broadcast.

Defined cases: null and empty texts have no words; a null id counts as empty in
the place that an id changes; repeated rows count again; an empty table
gives an empty frame; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesengine.session import reliable_checkpoint

#: A letter of a word: ASCII letters and U+00C0 to U+00FF.
LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5


def runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id (string) and run: every maximal run of letters of at least ``min_length``, A-Z lower-cased."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({LETTERS}{{{min_length},}})"), F.lit(1))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(found).alias("run"))
    return rows.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def misspelt(every: int = 199) -> Column:
    """``run`` of ``runs``; in one of ``every`` (document, run) pairs without one of its code points, both told by a checksum of the pair."""
    h = F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return F.when(h % every == 0, cut).otherwise(F.col("run"))


def counted(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the words (column ``word``) that are long and frequent enough."""
    return words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _grams() -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.struct(i.alias("at"), F.substring("word", i, F.lit(2)).alias("gram")))


def pivots(prefix: list[tuple[int, int]], wanted: int) -> list[int]:
    """Places of ``wanted`` disjoint grams of least total weight, from (place, weight) pairs in order of place.

    ``best[k]`` has, for the grams up to the current one, the least weight of k disjoint grams and their places.
    """
    best: list[list[tuple[int, tuple[int, ...]] | None]] = []
    for i, (at, weight) in enumerate(prefix):
        free = i - 1
        while free >= 0 and prefix[free][0] > at - 2:  # grams that share a code point with this one
            free -= 1
        row: list[tuple[int, tuple[int, ...]] | None] = [(0, ())]
        for k in range(1, wanted + 1):
            before = (0, ()) if k == 1 else best[free][k - 1] if free >= 0 else None
            options = [best[i - 1][k]] if i else []
            if before is not None:
                options.append((before[0] + weight, (*before[1], at)))
            row.append(min((x for x in options if x is not None), default=None))
        best.append(row)
    return list(best[-1][wanted][1])


_SIGNATURES = "word string, n long, length int, last int, gram int, at int, pivot boolean"


def _signatures(edits: int):
    """Prefix grams of each word, by their rank; ``last`` is the rank that its prefix ends with."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("length", pa.int32()), ("last", pa.int32()), ("gram", pa.int32()), ("at", pa.int32()), ("pivot", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for word, n, grams in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "grams")), strict=True):
                ranked = sorted((g["rank"], g["at"], g["words"]) for g in grams)
                last = ranked[2 * edits][0]
                prefix = sorted((at, words, rank) for rank, at, words in ranked if rank <= last)
                chosen = set(pivots([(at, words) for at, words, _ in prefix], edits + 1))
                out += [(word, n, len(grams) + 1, last, rank, at, at in chosen) for at, _, rank in prefix]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)
    return run


def near(words: DataFrame, edits: int = 1) -> DataFrame:
    """word, n, other, other_n: every ordered pair of different words at most ``edits`` apart.

    ``words``: distinct words (word, n) of at least ``2 * edits + 2`` code points, so that each has a whole prefix.
    """
    grams = words.select("word", "n", F.explode(_grams()).alias("g")).select("word", "n", "g.*")
    held = grams.select("word", "gram").distinct().groupBy("gram").agg(F.count("*").alias("words"))
    # a row for each of the letter pairs, 8,100 at most: one task ranks them, and they fit any broadcast
    ranking = held.select("gram", "words", F.expr("row_number() OVER (ORDER BY words, gram)").alias("rank"))
    ranked = grams.join(F.broadcast(ranking), "gram").groupBy("word", "n").agg(F.collect_list(F.struct("rank", "at", "words")).alias("grams"))
    signed = reliable_checkpoint(ranked.mapInArrow(_signatures(edits), _SIGNATURES))

    start = F.substring("word", F.lit(1), F.col("at") + 1)
    rest = F.substring("word", F.col("at"), F.col("length"))
    sides = [(True, start), (False, rest)] if edits == 1 else [(True, F.lit(""))]
    moves = [(by, longer, first) for longer in range(-edits, edits + 1) for by in range(-edits, edits + 1) for first, _ in sides
             if abs(by) + abs(longer - by) <= edits and (edits > 1 or not (by if first else longer - by))]

    def each(options, *names):
        return F.explode(F.array(*(F.struct(*(x.alias(n) if isinstance(x, Column) else F.lit(x).alias(n) for x, n in zip(o, names, strict=True))) for o in options)))

    asked = signed.where("pivot").select("*", start.alias("start"), rest.alias("rest"), each(moves, "by", "longer", "first").alias("m"))
    same = F.when(F.col("m.first"), F.col("start")).otherwise(F.col("rest")) if edits == 1 else F.lit("")
    asked = asked.select(
        F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("last").alias("a_last"), "gram",
        (F.col("at") + F.col("m.by")).alias("at"), (F.col("length") + F.col("m.longer")).alias("length"), F.col("m.first").alias("first"), same.alias("same"))
    found = signed.select("*", each(sides, "first", "same").alias("m")).select(
        F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("last").alias("b_last"), "gram", "at", "length", F.col("m.first").alias("first"), F.col("m.same").alias("same"))
    pairs = asked.join(found, ["gram", "at", "length", "first", "same"]).where((F.col("a_last") <= F.col("b_last")) & (F.col("a") != F.col("b")))
    pairs = pairs.where(F.levenshtein("a", "b", edits) >= 0).select("a", "a_n", "b", "b_n")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    return both.distinct().select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))


def grouped(words: DataFrame, edits: int = 1, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root for every row of ``words`` (word, n)."""
    words = reliable_checkpoint(words)
    first = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    beside = near(words, edits).groupBy("word").agg(F.count("*").alias("n_near"), first.alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    out = reliable_checkpoint(words.join(beside, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    links = reliable_checkpoint(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:  # each round doubles the steps that a link stands for
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = reliable_checkpoint(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        links = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            break
    return out.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
