"""Mixing sources to target weights by a low-discrepancy schedule.

The schedule has 2**k slots.  Slot i draws the van der Corput point of i (its k
bits reversed, over 2**k), which the sources' cumulative shares map to a source;
a source's slots get ranks in order.  Each source's documents, shuffled by hash,
form one stream of words, cut into blocks of equal length (to a word, where the
length is no whole number); the slot of rank r takes block r, going round the
stream again where the slots outnumber its blocks.  A source is taken as far as
its slots reach, which is its target give or take a block.

A source has at least LEAST_SLOTS blocks (or a word in each) and none is longer
than MOST_WORDS, so there are at most 2 (total / MOST_WORDS + LEAST_SLOTS sources)
slots, however small a source is.  The points of an interval are those of the
cells of width 2**-k that begin in it: slots are counted out from the plan, each
once, and no point is searched for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, column, meet, unfold, with_row, word_count, words

LEAST_SLOTS, MOST_WORDS = 1024, 4096
CHUNK_BITS = 16
UNIT_BITS = 16
UNIT = 1 << UNIT_BITS
#: Masks of the swaps that reverse 64 bits.
SWAPS = ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF))


def targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """sid, source, size, rows -> also weight and target (words), one row per source.

    A target is its weight's share of all words, at most `cap` times the
    source's size; the excess is shared again by weight.  That fixed point is
    min(cap size, weight level) for the one level that uses up all words, which
    prefix sums in the order of size / weight give.
    """
    everything = Window.orderBy(F.lit(1)).partitionBy()
    rows = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    rows = rows.withColumns({"most": F.lit(cap) * F.col("size"), "total": F.sum("size").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    line = Window.partitionBy().orderBy(F.col("most") / F.col("weight"), "sid")
    before, onward = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.withColumns({"level": level, "k": F.row_number().over(line)})
    fits = F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("k"))
    rows = rows.withColumn("first", F.min(fits).over(Window.partitionBy()))
    rows = rows.withColumn("level", F.max(F.when(F.col("k") == F.col("first"), F.col("level"))).over(Window.partitionBy()))
    return rows.select("sid", "source", "size", "rows", "weight", F.least("most", F.col("weight") * F.col("level")).alias("target"))


def reversed_bits(x: Column, bits: int) -> Column:
    """The lowest `bits` bits of a number below 2**bits, in reverse."""
    for n, mask in SWAPS:
        x = F.shiftleft(x.bitwiseAND(F.lit(mask)), n).bitwiseOR(F.shiftrightunsigned(x, n).bitwiseAND(F.lit(mask)))
    x = F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32))
    return F.shiftrightunsigned(x, 64 - bits) if bits else F.lit(0).cast("long")


def schedule(plan: DataFrame, bits: int) -> DataFrame:
    """sid, rank, slot of all 2**bits slots, from plan (sid, low, high: the cells [low, high) of 2**bits whose points are the source's)."""
    size = 1 << CHUNK_BITS
    spans = plan.where("low < high").select("sid", "low", "high", F.explode(F.sequence(F.shiftright("low", CHUNK_BITS), F.shiftright(F.col("high") - 1, CHUNK_BITS))).alias("g"))
    spans = spans.repartition(max(1, min(4096, 1 << max(0, bits - CHUNK_BITS))), "sid", "g")
    cells = F.sequence(F.greatest("low", F.col("g") * size), F.least(F.col("high"), (F.col("g") + 1) * size) - 1)
    met = spans.select("sid", F.explode(cells).alias("cell")).select("sid", reversed_bits(F.col("cell"), bits).alias("slot")).withColumn("chunk", F.shiftright("slot", CHUNK_BITS))
    counts = met.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("sid", "chunk", offset.alias("before"))
    within = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    return met.withColumn("within", within).join(counts, ["sid", "chunk"]).select("sid", (F.col("before") + F.col("within")).alias("rank"), "slot")


def edge(rank: Column) -> Column:
    """How many words of its source's stream lie before the block of a rank."""
    return F.shiftright(rank * F.col("block"), UNIT_BITS)


def planned(sources: DataFrame) -> tuple[DataFrame, int]:
    """targets() rows with block (its length in 1/UNIT words), low and high (cells of the schedule), and how many bits a slot has.

    A source with a target gets target / block slots' worth of the points, where
    block is at first its target over LEAST_SLOTS, from 1 to MOST_WORDS; all
    blocks then shrink alike, to half at most, so that the slots are a power of two.
    """
    first = F.greatest(F.lit(1.0), F.least(F.lit(float(MOST_WORDS)), F.col("target") / LEAST_SLOTS))
    share = sources.withColumn("share", F.when(F.col("target") > 0, F.col("target") / first).otherwise(0.0))
    total = share.agg(F.sum("share")).first()[0] or 0.0
    bits = max(0, math.ceil(math.log2(total))) if total > 0 else 0
    scale = (1 << bits) / total if total > 0 else 0.0
    line = Window.partitionBy().orderBy("sid")
    ends = share.withColumn("end", F.sum("share").over(line.rowsBetween(Window.unboundedPreceding, 0)) * scale)
    ends = ends.withColumns({"low": F.coalesce(F.lag("end").over(line), F.lit(0.0)), "last": F.lead("sid").over(line).isNull()})
    cell = lambda x: F.least(F.ceil(F.round(x, 6)), F.lit(1 << bits))
    high = F.when(F.col("last"), F.lit(1 << bits if total > 0 else 0)).otherwise(cell(F.col("end")))
    block = F.when(F.col("share") > 0, F.round(F.col("target") / (F.col("share") * scale) * UNIT)).otherwise(F.lit(UNIT))
    return ends.select("sid", "source", "size", "rows", "weight", "target", block.cast("long").alias("block"), cell(F.col("low")).cast("long").alias("low"), high.cast("long").alias("high")), bits


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, buckets: int = 1024) -> DataFrame:
    """What the mix takes of each row: id, th (hash of its text), rh (hash of the whole row), source, size, source_size, target, taken, first_slot and turns.

    size: words of the text (null: 0).  Sources in order of code points, null
    last, have the weights in turn; see targets().  taken: words in the blocks
    that the source's slots take, repeats counted, at most `cap` times the size;
    over a source they are its target give or take a block (planned()).  turns:
    (slot, words) for each time round, slot being where in the schedule it
    begins; first_slot the first of them, null for a row of which nothing is
    taken.  The order is by hash of id and text, so reruns agree; repeated rows
    take their turns one after the other.  Rows without words take nothing; an
    empty table gives an empty table.  Positions in a source are summed in
    `buckets` parts, so a large source fills no task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows = docs.select(
        column(id_col).alias("id"), column(source_col).cast("string").alias("source"), word_count(column(text_col)).alias("size"),
        F.xxhash64(column(text_col)).alias("th"), row_hash(docs).alias("rh"),
    )
    rows = rows.withColumns({"h": F.xxhash64("id", "th"), "key": F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))})
    rows = scratch.put(rows, "sizes")
    named = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("size"), F.count("*").alias("rows"))
    named = named.withColumn("sid", F.row_number().over(Window.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1)
    plan, bits = planned(scratch.put(targets(named, weights, float(cap)), "targets"))
    plan = scratch.put(plan.withColumn("reach", F.least(edge(F.col("high") - F.col("low")), cap * F.col("size"))), "plan")
    timed = schedule(plan, bits)

    few = plan.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "sid", F.col("size").alias("source_size"), "target", "block", "reach", "rows")
    placed = meet(rows, few, ["key"], "rows").withColumn("part", F.pmod("h", F.lit(buckets)))
    parts = placed.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    parts = parts.select("sid", "part", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sid", "part").orderBy("h", "id", "th", "rh").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("run", F.sum("size").over(inside)).join(parts, ["sid", "part"])
    placed = scratch.put(placed.withColumn("at", F.col("before") + F.col("run") - F.col("size")).drop("before", "run", "part", "key"), "placed")
    turns = placed.where("size > 0").select("sid", "at", "size", "block", "reach", "source_size", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("turn"))
    turns = turns.withColumn("start", F.col("turn") * F.col("source_size") + F.col("at")).where(F.col("start") < F.col("reach"))
    turns = turns.withColumn("end", F.least(F.col("start") + F.col("size"), F.col("reach")))
    ranks = F.sequence(F.greatest(F.floor(F.col("start") * UNIT / F.col("block")) - 1, F.lit(0)), F.floor(F.col("end") * UNIT / F.col("block")) + 1)
    blocks = turns.withColumn("rank", F.explode(ranks)).withColumn("n", F.least(F.col("end"), edge(F.col("rank") + 1)) - F.greatest(F.col("start"), edge(F.col("rank")))).where("n > 0")
    got = blocks.select("sid", "at", "turn", "rank", "n").join(timed, ["sid", "rank"]).groupBy("sid", "at", "turn").agg(F.min("slot").alias("slot"), F.sum("n").alias("words"))
    got = got.groupBy("sid", "at").agg(F.sort_array(F.collect_list(F.struct("slot", "words"))).alias("turns"))
    out = placed.join(got.withColumn("some", F.lit(1)), (placed["sid"] == got["sid"]) & (placed["at"] == got["at"]) & (placed["size"] > 0), "left")
    taken = F.aggregate("turns", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return out.select(
        placed["id"].alias(id_col), "th", "rh", "source", placed["size"], "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), F.get("turns", F.lit(0))["slot"].alias("first_slot"), "turns",
    )


def row_hash(docs: DataFrame) -> Column:
    """A hash of all of a row's columns that can be hashed (maps can't)."""
    return F.xxhash64(F.lit(0), *[column(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()])


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as documents: each row as often as it is taken whole, then once with the first words of what is left over.

    Columns are the input's; a text taken in part is those words joined by
    spaces.  n_chars, where the input has it, follows the text.  The rows of a
    partition stand in the order of their slots, so each file that is written
    follows the schedule.  Rows are told apart by all their columns; rows alike
    in all of them come as often as the mix takes them together.  Null and empty
    texts are not taken; an empty table gives an empty table.
    """
    taken = mix(docs, id_col, text_col, source_col, **options).where("taken > 0")
    taken = taken.groupBy(column(id_col).alias("i"), F.col("th").alias("t"), F.col("rh").alias("r")).agg(F.first("size").alias("n"), F.flatten(F.collect_list("turns")).alias("turns"))
    rows = with_row(docs.withColumn("__rh", row_hash(docs)), __id=id_col, __text=text_col, __rh="__rh").withColumn("__th", F.xxhash64("__text"))
    rows = rows.drop(f"__in{len(docs.columns)}").dropDuplicates(["__id", "__th", "__rh"])
    rows = rows.join(taken, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__th") == F.col("t")) & (F.col("__rh") == F.col("r")))
    rows = rows.withColumn("turn", F.explode("turns")).sortWithinPartitions("turn.slot", "__id", "__th")
    take = F.col("turn.words")
    text = F.when(take == F.col("n"), F.col("__text")).otherwise(F.array_join(F.slice(words(F.col("__text")), F.lit(1), take.cast("int")), " "))
    new = {text_col: text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return unfold(rows, docs.columns, **new)
