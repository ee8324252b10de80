"""Multi-party perspective rotation: a dialogue once for every participant, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelf.session import materialize

#: Turns that one rendered row covers: longer dialogues go on in further rows, so no row gathers without bound.
SEGMENT_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The role that sets the scene and is nobody's part.
SCENE = "system"


def _escaped(text: Column) -> Column:
    """Marker strings in a text are spaced out, so that no text can begin or end a turn."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<| im_start |>")), F.lit(CLOSE), F.lit("<| im_end |>"))


def _ranked(said: DataFrame) -> DataFrame:
    """``said`` (c, t, r, x) with the place ``n`` of each turn in its dialogue, from 0.

    Turns are range-partitioned by dialogue and order, so a dialogue of very many turns spreads; they
    are numbered within a partition, and the counts of the partitions before, a row each, are added.
    """
    placed = materialize(said.repartitionByRange("c", "t", "r", F.substring("x", 1, 32)).withColumn("part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("part", "c").orderBy(F.col("t").asc_nulls_first(), "r", "x")) - 1
    counts = placed.groupBy("c", "part").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("c").alias("bc"), F.col("part").alias("bp"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    met = placed.withColumn("inside", inside).join(before, F.col("c").eqNullSafe(F.col("bc")) & (F.col("part") == F.col("bp")))
    return met.select("c", "t", "r", "x", (F.col("before") + F.col("inside")).alias("n"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           size: int = SEGMENT_TURNS) -> DataFrame:
    """conv, segment, speaker, n_turns, rendered and masks, a row per participant and ``size`` turns.

    The speaker's turns are rendered as the assistant's, those of the others as users of their
    name; the scene role stays what it is. ``masks`` are the [start, end) code points of the
    speaker's words with their closing marker: what a model is trained on.

    Turns follow their number (nulls first), ties role and text; the first ``size`` of them are segment 0, whatever
    their numbers. A row repeated in all four columns is one turn; a null role speaks as "unknown", a null text is empty; a null
    conversation is one of its own. A dialogue without participants gives no rows.
    """
    said = turns.select(F.col(conv).alias("c"), F.col(turn).cast("long").alias("t"), F.coalesce(F.col(role), F.lit("unknown")).alias("r"),
                        F.coalesce(F.col(text), F.lit("")).alias("x")).distinct()
    rows = _ranked(said).withColumn("g", F.floor(F.col("n") / size).cast("long"))
    parts = rows.groupBy("c", "g").agg(F.array_sort(F.collect_list(F.struct("n", "r", "x"))).alias("turns"))
    speakers = rows.where(F.col("r") != SCENE).select("c", F.col("r").alias("speaker")).distinct()
    joined = parts.alias("p").join(speakers.alias("s"), F.col("p.c").eqNullSafe(F.col("s.c"))).select("p.c", "g", "speaker", "turns")

    def opening(t: Column) -> Column:
        name = (F.when(t["r"] == F.col("speaker"), F.lit("assistant")).when(t["r"] == SCENE, F.lit(SCENE))
                .otherwise(F.concat(F.lit("user name="), _escaped(t["r"]))))
        return F.concat(F.lit(OPEN), name, F.lit("\n"))

    shown = joined.withColumn("shown", F.transform("turns", lambda t: F.struct(
        (t["r"] == F.col("speaker")).alias("own"), opening(t).alias("head"), F.concat(_escaped(t["x"]), F.lit(CLOSE)).alias("body"))))
    sized = shown.withColumn("sizes", F.transform("shown", lambda s: F.struct(
        s["own"].alias("own"), F.length(s["head"]).alias("head"), F.length(s["body"]).alias("body"))))

    def start(i: Column) -> Column:
        """Characters before the body of the i-th turn: every turn ends with a line break."""
        return F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda n, s: n + s["head"] + s["body"] + 1) + F.get("sizes", i)["head"]

    spans = F.filter(F.transform("sizes", lambda s, i: F.struct(s["own"].alias("own"), start(i).alias("start"), (start(i) + s["body"]).alias("end"))),
                     lambda s: s["own"])
    return sized.select(
        F.col("c").alias(conv), F.col("g").alias("segment"), "speaker", F.size("turns").cast("long").alias("n_turns"),
        F.concat(F.array_join(F.transform("shown", lambda s: F.concat(s["head"], s["body"])), "\n"), F.lit("\n")).alias("rendered"),
        F.transform(spans, lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))).alias("masks"))
