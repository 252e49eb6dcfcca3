"""Repeated line runs, found by prefix doubling over line ids; later copies are deleted. DataFrame operations only.

Every line of the corpus is a position, every suffix of a document's line sequence starts at one. Prefix
doubling names the first 2**k lines of all suffixes: two suffixes have the same name where their longest common
prefix is at least 2**k lines. A round joins the names of the first half and of the second half; positions
whose name nobody shares are dropped, for no longer prefix of theirs can be shared either, so rounds get small quickly. The
name of any length m is the pair of two overlapping names of the power of two below. Names are 128 bits
computed from the lines themselves (two 64-bit hashes), which saves the exchange of ranks; their order stands for the order of
the suffix array, and the positions of one name are an interval of it with a longest common prefix of m or more.

A run of lines counts as a repetition if it has ``min_lines`` lines or ``min_words`` words. Common prefixes matter that are just enough:
that would not be without their last line, or not without their first one. Every longer repeated run is covered by
such ones inside it, line by line, so doubling can end at ``min_lines``. In every interval the least position (by doc_id, then
line) is the first copy and stays; the lines of all others are deleted, and where they touch or overlap they form the maximal
repeated runs.

Defined cases: a null text has no lines and stays null; an empty text is one empty line; a text of which all lines are deleted becomes
empty; rows with equal doc_id and equal text count as one document and are treated alike; null doc_ids come first and count as one
document only if their texts agree, too; lines that repeat within a document are copies like others;
an empty table gives an empty result; extra columns are carried untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import BLANKS, BLANK_CLASS, fresh, stored

DOC = ["d", "t"]


def _doc_key(doc_id: str, text: str) -> list[Column]:
    return [
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(2**63))).alias("d"),
        F.xxhash64(F.col(f"`{text}`")).alias("t"),
    ]


def positions(docs: DataFrame, doc_id: str, text: str, min_lines: int, min_words: int) -> DataFrame:
    """(d, t, i, a, b, m): document key, line number, line id (a, b), and the lengths that matter from this line on:
    runs that are enough, but no longer are without their first or without their last line."""
    lines = docs.select(*_doc_key(doc_id, text), F.split(F.col(f"`{text}`"), "\n").alias("lines"))
    counted = lines.withColumn(
        "lines", F.transform("lines", lambda line: F.struct(line.alias("line"), _words_in(line).alias("w")))
    )

    def at(own: Column, i: Column) -> Column:
        """What a line is, worked out inside the row, so that exploded rows do not each drag all lines along."""

        def words(start: int, n: int) -> Column:
            """Words of n lines from ``start`` lines ahead on; null where the text ends before."""
            return sum((F.get("lines", i + start + k)["w"] for k in range(1, n)), F.get("lines", i + start)["w"])

        lengths = []
        for n in range(1, min_lines + 1):
            enough = words(0, n).isNotNull() & (F.lit(n == min_lines) | (words(0, n) >= min_words))
            shorter = (words(0, n - 1) < min_words) | (words(1, n - 1) < min_words) if n > 1 else F.lit(True)
            lengths.append(F.when(enough & shorter, n))
        m = F.filter(F.array(*lengths), lambda x: x.isNotNull())
        return F.struct(i.alias("i"), F.xxhash64(own["line"]).alias("a"), F.xxhash64(F.lit(7), own["line"]).alias("b"), m.alias("m"))

    return counted.select("d", "t", F.explode(F.transform("lines", at)).alias("p")).select("d", "t", "p.*")


def _words_in(line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(BLANKS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, BLANK_CLASS + "+")))


def _shared(named: DataFrame) -> DataFrame:
    """The positions whose name occurs more than once."""
    names = stored(named.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"))
    return stored(named.join(names, ["a", "b"], "left_semi").select("d", "t", "i", "a", "b", "m"))


def _joined(names: DataFrame, ahead: int) -> DataFrame:
    """Names of a prefix and of the one ``ahead`` lines later, as one name."""
    later = names.select("d", "t", (F.col("i") - ahead).alias("i"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    both = names.join(later, ["d", "t", "i"])
    return both.select("d", "t", "i", F.xxhash64("a", "a2").alias("a"), F.xxhash64("b", "b2").alias("b"), "m")


def later_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = 4, min_words: int = 50) -> DataFrame:
    """(d, t, i, m): m lines from line i of document (d, t) on are a copy of lines at an earlier position."""
    names = stored(positions(docs, doc_id, text, min_lines, min_words).distinct())

    def of_length(named: DataFrame, m: int) -> DataFrame:
        return named.where(F.array_contains("m", m)).withColumn("m", F.lit(m))

    prefixes: list[DataFrame] = []
    length = 1
    while True:
        names = _shared(names)
        prefixes.append(of_length(names, length))
        for m in range(length + 1, min(2 * length, min_lines + 1)):
            # overlapping names are shorter than m, so equal names of both halves mean equal prefixes of m lines
            prefixes.append(of_length(_joined(names, m - length), m))
        if 2 * length > min_lines:
            break
        names, length = _joined(names, length), 2 * length
    found = prefixes[0]
    for more in prefixes[1:]:
        found = found.unionByName(more)
    found = stored(found)
    place = F.struct("d", "t", "i")
    firsts = stored(found.groupBy("m", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return found.join(firsts, ["m", "a", "b"]).where(place > F.col("first")).select("d", "t", "i", "m")


def delete_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = 4, min_words: int = 50, facts: str | None = None) -> DataFrame:
    """``docs`` without the lines of later copies; all other columns as they are.

    With ``facts`` a struct column of that name is added: n_lines, n_deleted and n_runs of the text."""
    deleted = later_copies(docs, doc_id, text, min_lines, min_words)
    row, gone, lines = (fresh(docs, c) for c in ("_row", "_gone", "_lines"))  # names of results may refer to none of these
    lines_of = deleted.select("d", "t", F.explode(F.sequence("i", F.col("i") + F.col("m") - 1)).alias("i"))
    left_out = lines_of.groupBy("d", "t").agg(F.sort_array(F.collect_set("i")).alias(gone))  # at most the lines of a document
    keyed = docs.select(F.struct("*").alias(row), *_doc_key(doc_id, text)).join(left_out, DOC, "left")
    split = keyed.select(row, gone, F.split(F.col(row)[text], "\n").alias(lines))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    new_text = F.when(F.col(gone).isNull(), F.col(row)[text]).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    )
    none = F.array().cast("array<int>")
    runs = F.size(F.filter(F.coalesce(gone, none), lambda x, k: (k == 0) | (F.get(gone, k - 1) != x - 1)))
    counts = F.struct(
        F.when(F.col(row)[text].isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.size(F.coalesce(gone, none)).cast("long").alias("n_deleted"),
        runs.cast("long").alias("n_runs"),
    )
    columns = [new_text.alias(c) if c == text else F.col(row)[c].alias(c) for c in docs.columns]
    return split.select(*columns, *([counts.alias(facts)] if facts else []))
