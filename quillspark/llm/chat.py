"""Chat formatting with cumulative-snapshot collapse (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import cut, numbered, running

SPAN = 256
#: A conversation: whether its id is null, and the id (0 for null).
KEY = ["_none", "conv_id"]


def render(role: Column, text: Column) -> Column:
    """One turn between start and end marks."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def placed_turns(turns: DataFrame) -> DataFrame:
    """KEY, pos (1 for a conversation's first turn), role, text and two hashes t1, t2 of these three, of each turn.

    Turns go by number, role and text. They are counted in blocks of SPAN turn numbers, and blocks are added up; a block
    with more than four times as many rows (null, negative or repeated numbers) is counted over ranges of its order.
    """
    block = F.greatest(F.lit(0), F.shiftright("turn", 8))
    blocked, order = turns.withColumn("_b", block), ["turn", "role", "text"]
    counts = cut(blocked.groupBy(*KEY, "_b").agg(F.count("*").alias("_n")))
    crowded = counts.where(F.col("_n") > 4 * SPAN).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*KEY, "_b").orderBy(*order))
    if crowded.limit(1).count():
        at = [*KEY, "_b"]
        crowd = numbered(blocked.join(crowded, at), [*at, *order], "_at")
        crowd = crowd.join(crowd.groupBy(*at).agg(F.min("_at").alias("_from")), at).withColumn("_in", F.col("_at") - F.col("_from") + 1)
        blocked = blocked.join(crowded, at, "left_anti").withColumn("_in", inside).unionByName(crowd.drop("_at", "_from"))
    else:
        blocked = blocked.withColumn("_in", inside)
    top = (counts.agg(F.max("_b")).first()[0] or 0) + 1
    if top > 1:
        ahead = running(counts, KEY, "_b", {"_ahead": ("_n", F.sum, 0)}, top).select(*KEY, "_b", "_ahead")
        blocked = blocked.join(ahead, [*KEY, "_b"])
    else:
        blocked = blocked.withColumn("_ahead", F.lit(0))
    rows = blocked.select(*KEY, (F.col("_ahead") + F.col("_in")).cast("long").alias("pos"), "role", "text")
    return cut(rows.withColumns({"t1": F.xxhash64("pos", "role", "text"), "t2": F.xxhash64(F.lit("second"), "text", "role", "pos")}))


def rolling_prefixes(placed: DataFrame) -> DataFrame:
    """KEY, pos, t1, t2 and the hashes p1, p2 of all turns up to and with each.

    A prefix's hash is the exclusive-or of its turns' hashes, each of which covers position, role and text; so it rolls on
    over blocks of SPAN positions, and a conversation of any length never meets in one task.
    """
    hashes = placed.select(*KEY, "pos", "t1", "t2", F.shiftright(F.col("pos") - 1, 8).alias("_b"))
    upto = Window.partitionBy(*KEY, "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashes.withColumns({f"p{i}": F.bit_xor(f"t{i}").over(upto) for i in (1, 2)})
    top = hashes.agg(F.max("_b")).first()[0] or 0
    if top:
        sums = hashes.groupBy(*KEY, "_b").agg(*[F.bit_xor(f"t{i}").alias(f"s{i}") for i in (1, 2)])
        ahead = running(sums, KEY, "_b", {f"a{i}": (f"s{i}", F.bit_xor, 0) for i in (1, 2)}, top + 1).select(*KEY, "_b", "a1", "a2")
        rolled = rolled.join(ahead, [*KEY, "_b"]).withColumns({f"p{i}": F.col(f"p{i}").bitwiseXOR(F.col(f"a{i}")) for i in (1, 2)})
    return rolled.select(*KEY, "pos", "t1", "t2", "p1", "p2")


def collapse_snapshots(placed: DataFrame) -> DataFrame:
    """KEY, n_turns, n_copies of the maximal conversations among placed turns.

    A conversation whose turns all begin another, longer one is dropped; of equal ones the lowest conv_id stays, null last.
    Turns are compared by role and text in their order, not by number, so that gaps in the numbers make no difference.
    """
    prefixes = rolling_prefixes(placed)
    whole = placed.groupBy(*KEY).agg(F.count("*").alias("n_turns"), F.bit_xor("t1").alias("p1"), F.bit_xor("t2").alias("p2"))
    whole = whole.groupBy("p1", "p2", "n_turns").agg(F.min(F.struct(*KEY)).alias("first"), F.count("*").alias("n_copies"))
    reached = prefixes.groupBy("p1", "p2", F.col("pos").alias("n_turns")).agg(F.count("*").alias("_reached"))
    kept = whole.join(reached, ["p1", "p2", "n_turns"]).where("_reached = n_copies")  # else a longer one goes on from here
    return kept.select("first.*", "n_turns", "n_copies")


def format_chats(conversations: DataFrame) -> DataFrame:
    """The maximal conversations, rendered: conv_id, part, n_turns, n_copies, chat.

    part counts rows of up to 256 turns of a conversation from 0; nearly all have one. Null roles and texts count as empty,
    a null turn as turn 0; rows with a null conv_id are one conversation, whose conv_id stays null. Repeated rows are turns
    of their own; extra columns are ignored; an empty table gives an empty result.
    """
    id_, named = F.col("conv_id").cast("long"), [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    turns = conversations.select(id_.isNull().alias("_none"), F.coalesce(id_, F.lit(0)).alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), *named)
    placed = placed_turns(turns)
    rows = placed.drop("t1", "t2").join(collapse_snapshots(placed), KEY).withColumn("part", F.shiftright(F.col("pos") - 1, 8))
    piece = F.struct("pos", render(F.col("role"), F.col("text")).alias("piece"))
    chats = rows.groupBy(*KEY, "part", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(piece)).alias("_pieces"))
    return chats.select(F.when(~F.col("_none"), F.col("conv_id")).alias("conv_id"), "part", "n_turns", "n_copies", F.array_join("_pieces.piece", "").alias("chat"))
