"""What changed between full snapshots: validity intervals by gaps and islands, read as change events.

Every record (source, key) of a sequence of snapshots is a row per snapshot that has it, with a hash of
its content. Along the snapshots' order its rows fall into islands: a new island begins where the record
was missing from the snapshot before (a gap) or where its content differs in substance. An island is a
validity interval; its start without a neighbour before is an addition, its end without a neighbour behind
a removal, and the adjacency of two islands a change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibmill.operators import entries as E
from calibmill.operators.units import convert_entries
from calibmill.session import stage

#: Numbers that differ by more than this share of the larger are a change.
TOLERANCE = 1e-5


def same(state: str = "state", number: str = "number", before: str = "_before") -> F.Column:
    """Whether a record equals the one before in substance: equal hashes, else equal states with numbers in tolerance.

    No hash of a rounded number decides whether two numbers lie within a tolerance of each other, so unequal hashes are followed
    by the comparison itself.
    """
    b = lambda f: F.col(f"{before}.{f}")
    close = F.abs(F.col(number) - b("number")) <= TOLERANCE * F.greatest(F.abs(F.col(number)), F.abs(b("number")))
    return (F.col("_hash") == b("hash")) | ((F.col(state) == b("state")) & ((F.col(state) != E.IS_NUMBER) | F.coalesce(close, F.lit(False))))


def islands(records: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``records`` with their island number.

    records: the key columns, ``idx`` (order of the snapshot), ``last_idx`` (of the sequence's last one), ``state``, ``number``
    and whatever else. Content is compared with the row before, so an island may drift by less than the tolerance a step.
    Of rows that repeat a record of one snapshot the first by state and number counts.
    """
    along = Window.partitionBy(*key).orderBy("idx", "state", "number")
    once = records.withColumn("_again", F.coalesce(F.lag("idx").over(along) == F.col("idx"), F.lit(False))).where("not _again").drop("_again")
    marked = once.withColumn("_hash", F.xxhash64("state", "number")).withColumn("_before", F.lag(F.struct("idx", "state", "number", F.col("_hash").alias("hash"))).over(along))
    opens = ~(F.coalesce(F.col("_before.idx") == F.col("idx") - 1, F.lit(False)) & same())
    return marked.withColumn("island", F.sum(opens.cast("int")).over(along)).drop("_before", "_hash")


def validity(records: DataFrame, key: list[str]) -> DataFrame:
    """Validity intervals: key, island, from_idx, to_idx, state, number (as at its start), last_idx.

    A record's rows lie together after its window, so nothing more is shuffled.
    """
    return islands(records, key).groupBy(*key, "island").agg(F.min("idx").alias("from_idx"), F.max("idx").alias("to_idx"), F.min_by("state", "idx").alias("state"), F.min_by("number", "idx").alias("number"), F.max("last_idx").alias("last_idx"))


def changes(records: DataFrame, key: list[str]) -> DataFrame:
    """(key, idx, change_kind) of every addition, removal and change; ``idx`` is that of the later snapshot.

    Read off the validity intervals: a start right behind the interval before is a change, another start an addition, an
    end with nothing right behind it a removal. The first snapshot of a sequence has nothing before it and gives no events.
    """
    along = Window.partitionBy(*key).orderBy("from_idx")
    spans = validity(records, key).withColumns({"_ended": F.lag("to_idx").over(along), "_next": F.lead("from_idx").over(along)})
    adjacent = F.coalesce(F.col("_ended") == F.col("from_idx") - 1, F.lit(False))
    event = lambda at, kind: F.struct(at.alias("idx"), kind.alias("change_kind"))
    start = F.when(F.col("from_idx") > 0, event(F.col("from_idx"), F.when(adjacent, "changed").otherwise("added")))
    followed = F.coalesce(F.col("_next") == F.col("to_idx") + 1, F.lit(False))
    end = F.when((F.col("to_idx") < F.col("last_idx")) & ~followed, event(F.col("to_idx") + 1, F.lit("removed")))
    return spans.select(*key, F.explode(F.array_compact(F.array(start, end))).alias("_e")).select(*key, "_e.idx", "_e.change_kind")


def archive_records(parsed: DataFrame, backends: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The records (backend, campaign, qubit, field) of every file in a sequence (``files``, made here if not given), with
    values in common units."""
    files = E.sequences(parsed.where("kind = 'file'")) if files is None else files
    values = convert_entries(parsed, backends).select("archive_id", "qubit", "field", "state", F.when(F.col("state") == E.IS_NUMBER, F.col("common")).alias("number"))
    return values.join(files.drop("ts"), "archive_id").drop("archive_id")


def found_changes(parsed: DataFrame, backends: DataFrame) -> DataFrame:
    """(archive_id, qubit, field, change_kind) for each pair of consecutive readable files of a sequence.

    Null, NaN and number exchanged, or numbers apart by more than ``TOLERANCE`` in common units, are changes. Spelling,
    order, dates and layout are not compared. A value that is neither (a text without a number) is a state of its own.
    """
    key = ["backend", "campaign", "qubit", "field"]
    placed = stage(E.sequences(parsed.where("kind = 'file'")))
    events = changes(archive_records(parsed, backends, placed), key)
    files = placed.select("archive_id", F.col("backend").alias("_b"), F.col("campaign").alias("_c"), F.col("idx").alias("_i"))
    at = (events["backend"] == files["_b"]) & events["campaign"].eqNullSafe(files["_c"]) & (events["idx"] == files["_i"])
    return events.join(files, at).select("archive_id", "qubit", "field", "change_kind")
