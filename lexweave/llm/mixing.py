"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; every document of it should be taken
``target / source size`` times, which is a whole number of copies and a fractional
probability of one more.  Pairs of documents transfer probability mass, weighted by their
words, until one of the two is decided; the other goes on.  The words expected of a source
are thus kept exactly but for the last document.  Pairs are folded within buckets of
documents, and what each bucket leaves undecided is folded again in a tree of ``FAN``.

Everything is DataFrame operations, and chance comes from hashes of ids, so that reruns
agree.  Null texts have no words.  Rows that share a source and an id are one unit and
are taken equally often.  Sources of no words have the target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.chunking import let
from lexweave.llm.tables import WORD
from lexweave.operators.rows import small_side
from lexweave.storage import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
FAN = 64
SEED = 20_011
MAX_BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, number, source_size and target of each source of (source, size).

    The excess over a cap is shared out again by weight until none is above; that ends at
    one level ``words = weight * level`` for all sources below their cap, the largest of
    the levels found by capping the sources in the order of cap by weight.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    by_cap = Window.orderBy("ratio", "number")
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
        .withColumn("number", F.row_number().over(by_name))
        .withColumn("weight", F.get(weights, (F.col("number") - 1) % len(WEIGHTS)))
        .withColumn("cap", F.col("source_size") * float(MOST_COPIES))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(Window.partitionBy()) * SHARE)
        .withColumn(
            "capped_before",
            F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"),
        )
        .withColumn(
            "weight_left",
            F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)),
        )
        .withColumn(
            "level",
            F.max((F.col("wanted") - F.col("capped_before")) / F.col("weight_left")).over(
                Window.partitionBy()
            ),
        )
        .select(
            "source",
            "number",
            "rows",
            "source_size",
            F.least("cap", F.col("weight") * F.col("level")).alias("target"),
        )
    )


def _uniform(*keys: Column) -> Column:
    """A number of [0, 1) that depends on nothing but the keys."""
    return F.pmod(F.xxhash64(F.lit(SEED), *keys), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _pair(i: Column, j: Column) -> Column:
    """One of two open units is decided; struct of that one's id and bit, and the other."""
    ratio = j["words"] / i["words"]
    return let(
        F.struct(
            ratio.alias("ratio"),
            F.least(1 - i["p"], j["p"] * ratio).alias("up"),
            F.least(i["p"], (1 - j["p"]) * ratio).alias("down"),
            _uniform(i["id"], j["id"]).alias("u"),
        ),
        lambda s: let(
            F.struct(
                (s["u"] * (s["up"] + s["down"]) < s["down"]).alias("raised"), s["ratio"].alias("ratio")
            ),
            lambda s: let(
                F.struct(
                    F.when(s["raised"], 1 - i["p"] <= j["p"] * s["ratio"])
                    .otherwise(i["p"] <= (1 - j["p"]) * s["ratio"])
                    .alias("first"),
                    s["raised"].alias("raised"),
                    s["ratio"].alias("ratio"),
                ),
                lambda s: let(
                    F.struct(
                        (s["first"] == s["raised"]).cast("int").alias("bit"),
                        s["first"].alias("first"),
                        s["ratio"].alias("ratio"),
                    ),
                    lambda s: F.struct(
                        F.struct(
                            F.when(s["first"], i["id"]).otherwise(j["id"]).alias("id"),
                            s["bit"].alias("bit"),
                        ).alias("decided"),
                        F.struct(
                            F.when(s["first"], j["id"]).otherwise(i["id"]).alias("id"),
                            F.when(s["first"], j["words"]).otherwise(i["words"]).alias("words"),
                            F.greatest(
                                F.lit(0.0),
                                F.least(
                                    F.lit(1.0),
                                    F.when(
                                        s["first"], j["p"] + (i["p"] - s["bit"]) / s["ratio"]
                                    ).otherwise(i["p"] + (j["p"] - s["bit"]) * s["ratio"]),
                                ),
                            ).alias("p"),
                        ).alias("open"),
                    ),
                ),
            ),
        ),
    )


def _fold(units: Column) -> Column:
    """Units of an array paired one after the other: what is decided and the one left open."""
    unit = "struct<id:bigint,words:double,p:double>"
    start = F.struct(
        F.array().cast("array<struct<id:bigint,bit:int>>").alias("decided"),
        F.get(units, F.lit(0)).cast(unit).alias("open"),
    )
    return F.aggregate(
        F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))),
        start,
        lambda acc, x: let(
            _pair(acc["open"], x),
            lambda s: F.struct(
                F.concat(acc["decided"], F.array(s["decided"])).alias("decided"),
                s["open"].alias("open"),
            ),
        ),
    )


def _rounded(units: DataFrame) -> DataFrame:
    """(number, id, bit) for units (number, bucket, id, words, p); buckets are FAN-ary."""
    level, decided = units, None
    while True:
        order = F.xxhash64(F.lit(SEED), F.col("id"))
        folded = materialize(
            level.groupBy("number", "bucket")
            .agg(
                F.array_sort(
                    F.collect_list(F.struct(order.alias("order"), "id", "words", "p"))
                ).alias("units")
            )
            .select(
                "number",
                "bucket",
                _fold(
                    F.transform(
                        "units",
                        lambda x: F.struct(
                            x["id"].alias("id"), x["words"].alias("words"), x["p"].alias("p")
                        ),
                    )
                ).alias("folded"),
            )
            .select("number", "bucket", "folded.decided", "folded.open"),
            "rounding",
        )
        done = folded.select("number", F.inline("decided"))
        decided = done if decided is None else decided.unionByName(done)
        level = folded.select(
            "number", F.floor(F.col("bucket") / FAN).cast("long").alias("bucket"), "open.*"
        )
        if not folded.agg(F.max("bucket")).head()[0]:
            last = level.select(
                "number", "id", (_uniform(F.col("id")) < F.col("p")).cast("int").alias("bit")
            )
            return decided.unionByName(last)


def mixed_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row."""
    sized = materialize(
        df.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
        ),
        "sizes",
    )
    targets = small_side(source_targets(sized), "targets", MAX_BROADCAST_SOURCES)
    # Sources meet by number, so that a null one is like any other.
    named = sized.alias("d").join(
        targets.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = named.select(
        "doc_id", "source", "number", "rows", "size", "source_size", "target", rate.alias("rate")
    ).withColumn("whole", F.floor("rate").cast("long"))
    units = (
        rated.where((F.col("size") > 0) & (F.col("rate") > F.col("whole")))
        .groupBy("number", "doc_id")
        .agg(
            F.sum("size").cast("double").alias("words"),
            F.first(F.col("rate") - F.col("whole")).alias("p"),
            F.first("rows").alias("rows"),
        )
        .select(
            "number",
            F.pmod(
                F.xxhash64(F.lit(SEED + 1), F.col("doc_id")),
                F.ceil(F.col("rows") / FAN).cast("long"),
            ).alias("bucket"),
            F.col("doc_id").alias("id"),
            "words",
            "p",
        )
    )
    bits = _rounded(units).select(
        F.col("number").alias("of"), F.col("id").alias("unit"), "bit"
    )
    copies = F.col("whole") + F.coalesce("bit", F.lit(0))
    return rated.join(
        bits,
        (F.col("number") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("unit")),
        "left",
    ).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixed_rows(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    copies = (
        mixed_copies(df, id_col, text_col, source_col)
        .where("copies > 0")
        .select("doc_id", "source", (F.col("size") > 0).alias("words"), "copies")
        .distinct()
    )
    # A row travels as a struct, so that its columns' names meet no others.
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("own_id"),
        F.col(f"`{source_col}`").cast("string").alias("own_source"),
        (word_count(F.col(f"`{text_col}`")) > 0).alias("own_words"),
    )
    same = (
        F.col("own_id").eqNullSafe(F.col("doc_id"))
        & F.col("own_source").eqNullSafe(F.col("source"))
        & (F.col("own_words") == F.col("words"))
    )
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return rows.join(copies, same).select("row", each).select("row.*")
