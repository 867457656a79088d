"""Line deduplication by winnowing over line hashes.

Blank lines aside, a run is a sequence of consecutive lines.  A line goes if it lies in a
run of at least ``MIN_WORDS`` words that occurred before: in a document with a smaller id
or earlier in its own.  Lines count as equal when they agree but for white space.

1. A window is the shortest run of at least ``MIN_WORDS`` words that starts at a line.
   The smallest line hash of each window is its fingerprint.  Two equal runs of that many
   words hold an equal window, and so the same fingerprint.
2. Fingerprints are joined by position: those found at one position only are dropped, and
   with them every window they stand for.
3. From each position left, the match is extended both ways: to the windows that end and
   that start at each line of the runs around it.  Every line of a repeated run lies in
   one of these, so that joining them by content finds the whole repeated run.
4. The first occurrence of each stays, and the lines of all later ones go.
5. Where a single line is a run (``MIN_WORDS`` is 1), this is done twice: with windows of
   ``PASSAGE_LINES`` lines, of which winnowing looks up the smallest hash, for repeated
   passages, and with windows that shrink to one line for the lines that these leave.  A line
   that went occurred before, so the first occurrence of every line is among those left.

All of it is DataFrame operations.  A frequent line meets partial aggregates, never pairs.
Null texts stay null and empty ones empty.  Rows that repeat an id and a text are one
document and are treated alike; rows without an id come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.chunking import let
from lexweave.llm.mixing import word_count
from lexweave.llm.tables import SPACE
from lexweave.storage import materialize

# A line that is not blank has a word, so that a single repeated line is a run.
MIN_WORDS = 1
PASSAGE_LINES = 4


def _normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, SPACE, " "))


def _lines(docs: DataFrame) -> DataFrame:
    """doc, at (number of the line), hash and words of every line that is not blank."""
    return (
        docs.select("doc", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .select("doc", "at", _normalised(F.col("line")).alias("line"))
        .where("line <> ''")
        .select(
            "doc", "at", F.xxhash64("line").alias("hash"), word_count(F.col("line")).alias("words")
        )
        .repartition("doc")
        .dropDuplicates(["doc", "at"])
    )


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """Of every line the shortest runs of enough words that start and that end there.

    Both are arrays (hash, at); null where the document has too few words left.  No line
    here is without words, so that a run is at most ``min_words`` lines long.
    """
    order = Window.partitionBy("doc").orderBy("at")
    near = F.struct("at", "hash", "through", (F.col("through") - F.col("words")).alias("until"))
    around = lines.withColumn("through", F.sum("words").over(order)).select(
        "doc",
        "at",
        F.collect_list(near).over(order.rowsBetween(0, min_words - 1)).alias("after"),
        F.collect_list(near).over(order.rowsBetween(1 - min_words, 0)).alias("before"),
        (F.col("through") - F.col("words")).alias("until"),
        "through",
    )
    # The lines short of the one with which the words suffice.
    short = F.size(F.filter("after", lambda x: x["through"] - F.col("until") < min_words))
    short_back = F.size(F.filter("before", lambda x: F.col("through") - x["until"] < min_words))

    def run(items: str, start: Column, length: Column) -> Column:
        return F.transform(
            F.slice(F.col(items), start, length),
            lambda x: F.struct(x["hash"].alias("hash"), x["at"].alias("at")),
        )

    counted = around.withColumn("short", short).withColumn("short_back", short_back)
    return counted.select(
        "doc",
        "at",
        F.when(
            F.col("short") < F.size("after"), run("after", F.lit(1), F.col("short") + 1)
        ).alias("start_here"),
        F.when(
            F.col("short_back") < F.size("before"),
            run("before", F.size("before") - F.col("short_back"), F.col("short_back") + 1),
        ).alias("end_here"),
    )


def _repeated(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc, at) of the lines of later runs of enough words."""
    runs = materialize(_windows(lines, min_words), "line-windows")
    run = F.explode(
        F.filter(
            F.array_distinct(F.array("start_here", "end_here")), lambda x: x.isNotNull()
        )
    )
    winnowed = (
        runs.where("start_here is not null")
        .select("doc", F.array_min("start_here").alias("least"))
        .select("doc", "least.at", F.col("least.hash").alias("fingerprint"))
        .distinct()
    )
    shared = (
        winnowed.groupBy("fingerprint")
        .agg(F.count("*").alias("positions"))
        .where("positions > 1")
        .select("fingerprint")
    )
    # A run is looked up by the fingerprint of the window at its first line, which it holds.
    extended = materialize(
        runs.select("doc", run.alias("run"))
        .select(
            "doc",
            F.get(F.col("run"), F.lit(0))["at"].alias("first"),
            F.transform("run", lambda x: x["at"]).alias("places"),
            F.xxhash64(F.transform("run", lambda x: x["hash"])).alias("content"),
            F.size("run").alias("lines"),
            F.get(F.col("run"), F.lit(0))["at"].alias("at"),
        )
        .join(
            runs.where("start_here is not null").select(
                "doc", "at", F.array_min("start_here")["hash"].alias("fingerprint")
            ),
            ["doc", "at"],
        )
        .join(shared, "fingerprint", "left_semi")
        .select("doc", "first", "places", "content", "lines")
        .distinct(),
        "line-runs",
    )
    original = (
        extended.groupBy("content", "lines")
        .agg(F.min(F.struct("doc", "first")).alias("original"), F.count("*").alias("times"))
        .where("times > 1")
        .drop("times")
    )
    return (
        extended.join(original, ["content", "lines"])
        .where(F.struct("doc", "first") != F.col("original"))
        .select("doc", F.explode("places").alias("at"))
        .distinct()
    )


def repeated_passages(lines: DataFrame) -> DataFrame:
    """(doc, at) of the lines of later runs of at least ``PASSAGE_LINES`` lines."""
    return _repeated(lines.withColumn("words", F.lit(1)), PASSAGE_LINES)


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, at) of the lines to delete; ``docs`` has doc, which orders it, and text."""
    lines = _lines(docs)
    if min_words > 1:
        return _repeated(lines, min_words)
    lines = materialize(lines, "lines")
    gone = materialize(repeated_passages(lines), "passages")
    left = lines.join(gone, ["doc", "at"], "left_anti")
    return gone.unionByName(_repeated(left, min_words))


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """doc_id, text without repeated runs, n_lines and n_removed of every row.

    Blank lines stay.
    """
    doc = F.struct(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash")
    )
    docs = df.select(doc.alias("doc"), F.col(text_col).alias("text"))
    distinct = docs.where("text is not null").select("doc", "text")
    gone = (
        repeated_lines(distinct, min_words)
        .groupBy(F.col("doc").alias("of"))
        .agg(F.collect_set("at").alias("gone"))
    )
    same = F.col("doc.id").eqNullSafe(F.col("of.id")) & (
        F.col("doc.text_hash") == F.col("of.text_hash")
    )
    lines = F.split("text", "\n")
    left = let(
        lines,
        lambda all_lines: F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone")),
            lambda i: F.get(all_lines, i),
        ),
    )
    return docs.join(gone, same, "left").select(
        F.col("doc.id").alias("doc_id"),
        F.when(F.col("gone").isNull(), F.col("text"))
        .otherwise(F.array_join(left, "\n"))
        .alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
    )
