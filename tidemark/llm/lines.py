"""Removal of repeated line runs by a suffix array of line ids (operator 1).

Suffixes of the documents' line-id sequences are ranked by prefix doubling: a
suffix's rank at length 2k is the place of (rank at k, rank at k of the suffix k
lines on) in the order of such pairs.  Suffixes that are alone with their first
k lines drop out, since no longer prefix of theirs repeats; a document's last
lines drop out when k lines no longer fit.  All suffixes of one rank at length k
are an interval of the suffix array whose longest common prefix has k lines at
least.

These intervals are then narrowed, from the greatest power of two down, to those
of exact longest common prefixes: the members of an interval whose next lines have
one rank too are an interval of so many lines more.  They leave the wider interval,
all but the first of them (by document id, then line), which stands for them there:
what any other member has in common with one of them, it has in common with all.
In the end each suffix is a later copy in one interval at most, and that interval's
prefix is the longest that an earlier place has too.  Of these runs those are maximal
that the run one line before doesn't hold.  Lines of maximal runs of ``min_lines``
lines or more go; with ``long_words``, so do single lines of that many words that an
earlier place has.

Lines are compared whole, by two 64-bit hashes.  Rank pairs are counted before
they are shuffled; ranks come from a sort by range.  Each level is a table in the
shared folder, and levels shrink with the suffixes that still repeat.

* null text: no lines, returned as null; empty text: one empty line
* repeated ids: rows of one id keep their own lines, and count as later copies in
  the order of their text's hash; exactly equal rows of one id are one document that
  was delivered twice, so neither is a copy of the other, and each gets the result
* runs may overlap themselves: of a line repeated n times in a row the first stays
* an empty table: no rows; very long texts: one row a line, the list of a document's
  removed lines is put together by one task
* other columns are kept, whatever their names, but for the three that are added
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import stored, unused

MIN_LINES = 2
PLACE = ("id", "row", "line")


def suffixes(docs: DataFrame, id_col: str, text_col: str, long_words: int | None = None) -> DataFrame:
    """``(id, row, line, high, low, long)``: a row for each line, its id two hashes; ``row`` tells texts of one id apart."""
    texts = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("row"), docs[text_col].alias("text"))

    def enough(x: Column) -> Column:  # n words have 2 n - 1 characters at least
        if long_words is None:
            return F.lit(False)
        return F.when(F.length(x) >= 2 * long_words - 1, F.size(F.array_remove(F.split(x, r"\s+"), "")) >= long_words).otherwise(F.lit(False))

    ids = F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("high"), F.xxhash64(F.lit(7), x).alias("low"), enough(x).alias("long")))
    return texts.filter("text is not null").select("id", "row", F.posexplode(ids).alias("line", "x")).select("id", "row", "line", "x.high", "x.low", "x.long")


def _ranked(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Pairs that occur twice at least, with their place among all such and their first position."""
    return stored(
        pairs.groupBy(a, b).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).filter("n > 1").sort(a, b).select(a, b, F.monotonically_increasing_id().alias("rank"), "first"),
        name,
    )


def _at(left: DataFrame, right: DataFrame, line: Column) -> Column:
    """Whether ``right`` (id2, row2, line2) is the place of ``left`` with ``line``."""
    return left["id"].eqNullSafe(right["id2"]) & (left["row"] == right["row2"]) & (line == right["line2"])


def _places(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{c}2") for c in PLACE), *more)


def suffix_levels(lines: DataFrame) -> list[DataFrame]:
    """For k = 1, 2, 4, ..., the suffixes whose first k lines repeat: ``(id, row, line, rank, later)``, the first level with ``long`` too.

    ``later`` is whether an earlier place has the same k lines.
    """
    later = (F.struct(*PLACE) > F.col("first")).alias("later")
    ranks = _ranked(lines, "high", "low", "line-ranks")
    levels = [stored(lines.join(ranks, ["high", "low"]).select(*PLACE, "rank", later, "long"), "suffixes")]
    k = 1
    while True:
        now = levels[-1]
        ahead = _places(now.withColumn("line", F.col("line") - k), F.col("rank").alias("next"))
        pairs = now.join(ahead, _at(now, ahead, now["line"])).select(*PLACE, F.col("rank").alias("before"), "next")
        ranks = _ranked(pairs, "before", "next", "pair-ranks")
        onward = stored(pairs.join(ranks, ["before", "next"]).select(*PLACE, "rank", later), "suffixes")
        if onward.isEmpty():
            return levels
        levels.append(onward)
        k *= 2


def _narrowed(members: DataFrame, level: DataFrame, k: int, mark: int) -> DataFrame:
    """Members of intervals after those that have the next k lines in common have moved to intervals of their own."""
    ahead = _places(level, F.col("rank").alias("next"))
    asked = members.join(ahead, _at(members, ahead, members["line"] + members["prefix"]), "left").drop("id2", "row2", "line2")
    found = asked.filter("next is not null").groupBy("mark", "interval", "next").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).filter("n > 1")
    inner = stored(found.select("mark", "interval", "next", "first", F.monotonically_increasing_id().alias("inner")), "intervals")
    joined = asked.join(inner, ["mark", "interval", "next"], "left")
    moves, leads = F.col("inner").isNotNull(), F.struct(*PLACE) == F.col("first")
    old = F.struct("mark", "interval", "prefix", "later")
    new = F.struct(F.lit(mark).alias("mark"), F.col("inner").alias("interval"), (F.col("prefix") + k).alias("prefix"), (~leads).alias("later"))
    both = F.array_compact(F.array(F.when(~moves | leads, old), F.when(moves, new)))
    return stored(joined.select(*PLACE, F.explode(both).alias("x")).select(*PLACE, "x.*"), "members")


def longest_common_prefixes(levels: list[DataFrame], least: int) -> DataFrame | None:
    """``(id, row, line, k)``: places with the exact number of lines, ``least`` or more, that an earlier place has too."""
    members, mark = None, 0
    for j in range(len(levels) - 1, -1, -1):
        if members is not None:
            members = _narrowed(members, levels[j], 1 << j, mark)
            mark += 1
        if 2 << j > least:
            own = levels[j].select(*PLACE, F.lit(mark).alias("mark"), F.col("rank").alias("interval"), F.lit(1 << j).alias("prefix"), "later")
            if j + 1 < len(levels):  # a later copy of twice as many lines is in an interval of its own already
                above = _places(levels[j + 1].filter("later"))
                own = own.join(above, _at(own, above, own["line"]), "left_anti")
            members = own if members is None else members.unionByName(own)
            mark += 1
    return None if members is None else members.filter(F.col("later") & (F.col("prefix") >= least)).select(*PLACE, F.col("prefix").alias("k"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """``(id, row, line, k)``: the maximal runs of k lines from ``line`` on that an earlier place has too, k at least min_lines, or 1 for long lines."""
    levels = suffix_levels(stored(suffixes(docs, id_col, text_col, long_words).distinct(), "lines"))
    runs = longest_common_prefixes(levels, min_lines)
    one = levels[0].filter(F.col("later") & F.col("long")).select(*PLACE, F.lit(1).alias("k"))
    runs = one if runs is None else runs if long_words is None else runs.unionByName(one)
    end = F.col("line") + F.col("k")
    before = Window.partitionBy("id", "row").orderBy("line", F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("reached", F.max(end).over(before)).filter(F.col("reached").isNull() | (F.col("reached") < end)).drop("reached")


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """``docs`` with the lines that stay in ``text_col``, and ``n_lines, n_removed, longest_run`` after its columns.

    Columns of ``docs`` with these three names are replaced; ``longest_run`` is
    the longest maximal run that the row repeats from an earlier place.
    """
    runs = repeated_runs(docs, id_col, text_col, min_lines, long_words)
    key, hashed, gone_col, longest = unused([*docs.columns, "n_lines", "n_removed", "longest_run"], "key", "hash", "gone", "longest")
    spans = F.collect_list(F.sequence(F.col("line"), F.col("line") + F.col("k") - 1))
    gone = runs.groupBy("id", "row").agg(F.array_distinct(F.flatten(spans)).alias(gone_col), F.max("k").alias(longest))
    gone = gone.select(F.col("id").alias(key), F.col("row").alias(hashed), gone_col, longest)
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone[key]) & (F.xxhash64(docs[text_col]) == gone[hashed]), "left")
    text = F.col(f"`{text_col}`")
    split = F.split(text, "\n")
    flags = F.coalesce(gone_col, F.array().cast("array<int>"))
    kept = F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), flags)), lambda i: F.get(split, i))
    marks = {
        "n_lines": F.when(text.isNull(), F.lit(0)).otherwise(F.size(split)),
        "n_removed": F.size(flags),
        "longest_run": F.coalesce(longest, F.lit(0)),
    }
    own = [F.when(F.col(gone_col).isNull(), text).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in marks]
    return joined.select(*own, *(v.alias(k) for k, v in marks.items()))
