"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a hashed order, are cut into blocks of `block_rows`. With exact rational weight w of a total of 1,
block j of a source is released at slot floor(j / w) and due at ceil((j + 1) / w); one slot takes one block, and earliest
deadline first over the released blocks meets every deadline, so that before any slot each source that has rows left is less
than one block away from its target. The driver schedules the blocks that exist, over the whole length of the schedule. Unless `block_rows` is given,
a block has LEAST_ROWS rows, and more where there would be over MAX_BLOCKS blocks: what is scheduled and broadcast has the bound of 8 MB, and 8 bytes
for each source. The sources themselves are counted on the driver. Slots of sources that have run out stay empty; every row is kept.

Ranks inside a source are exact without gathering a source in one task: rows are dealt to ranges of the hashed order,
ranges are counted, and a row's rank is its range's offset plus its place in the range.

A null source is a source of its own. Where weights are given, a source without one, or with 0, gets no slot: its rows have null slot and position.
Nulls, empty and very long texts are moved as they are and never looked into but for a hash. Rows that tie in the hashed order go by doc_id, then
by the hash of their text; repeated rows each get a place of their own, in any order, since nothing tells them apart. Sources that are due at
the same slot go by name. An empty table gives an empty result. All input columns are carried in the struct `doc`, so that no name can clash.
"""

import heapq
from array import array
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.session import parts

#: Blocks in a schedule at most, about: what the driver schedules and broadcasts is 8 bytes for each.
MAX_BLOCKS = 1 << 20
#: Rows in a block at least.
LEAST_ROWS = 16
#: What is added to the columns of a document.
ADDED = ("src_rank", "block", "slot", "position")
#: Slots in one row of the broadcast schedule.
SLOTS_A_ROW = 1024


def place_blocks(weights: dict, blocks: dict) -> dict:
    """Slots of each source's blocks, earliest deadline first among released blocks, in exact arithmetic."""
    names = sorted(weights, key=str)
    exact = [Fraction(weights[s]) for s in names]
    total = sum(exact)
    every = [(x.numerator, x.denominator) for x in (total / w for w in exact)]  # slots from one block to the next
    release = lambda k, j: j * every[k][0] // every[k][1]
    due = lambda k, j: -(-(j + 1) * every[k][0] // every[k][1])
    waiting = [(0, k, 0) for k, s in enumerate(names) if blocks[s]]
    ready: list = []
    out = [array("q") for _ in names]
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due(k, j), k, j))
        _, k, j = heapq.heappop(ready)
        out[k].append(slot)
        if j + 1 < blocks[names[k]]:
            heapq.heappush(waiting, (release(k, j + 1), k, j + 1))
        slot += 1
    return dict(zip(names, out, strict=True))


def rows_a_block(rows: int) -> int:
    """Rows of a block, so that there are MAX_BLOCKS blocks at most besides the last one of each source."""
    return max(LEAST_ROWS, -(-rows // MAX_BLOCKS))


def scheduled(docs: DataFrame, weights: dict | None = None, block_rows: int | None = None, power: float = 0.5) -> DataFrame:
    """doc (all columns of docs), src_rank, block, slot and position; weights default to source size to the power `power`."""
    spark = docs.sparkSession
    counts = {r[0]: r[1] for r in docs.groupBy("source").count().collect()}
    n_rows, types = sum(counts.values()), docs.schema["source"].dataType
    block_rows = block_rows or rows_a_block(n_rows)
    target = {s: n**power if weights is None else weights.get(s, 0) for s, n in counts.items()}
    placed = place_blocks({s: w for s, w in target.items() if w > 0}, {s: -(-n // block_rows) for s, n in counts.items()})
    plan = [(s, at // SLOTS_A_ROW, slots[at : at + SLOTS_A_ROW].tolist()) for s, slots in placed.items() for at in range(0, len(slots), SLOTS_A_ROW)]
    slots = spark.createDataFrame(plan, T.StructType([T.StructField("s", types), T.StructField("k", T.LongType()), T.StructField("at", T.ArrayType(T.LongType()))]))
    rows_a_range = max(256, n_rows // (4 * parts(spark)))
    facts = spark.createDataFrame([(s, -(-n // rows_a_range)) for s, n in counts.items()], T.StructType([T.StructField("s", types), T.StructField("ranges", T.IntegerType())]))
    of = lambda a, b: a["source"].eqNullSafe(b["s"])
    order = F.pmod(F.xxhash64(F.lit("order"), "doc_id"), F.lit(1 << 40))
    tie = F.xxhash64(*[c for c in docs.columns if c == "text"], F.lit(0))
    d = docs.select(F.struct("*").alias("doc"), "source", order.alias("o"), tie.alias("tie"))
    d = d.join(F.broadcast(facts), of(d, facts)).drop("s")
    d = d.withColumn("range", F.floor(F.col("o") * F.col("ranges") / F.lit(1 << 40)).cast("int"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (d.groupBy("source", "range").agg(F.count("*").alias("n")).select(
        F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    d = d.withColumn("within", F.row_number().over(Window.partitionBy("source", "range").orderBy("o", "doc.doc_id", "tie")) - 1)
    d = d.join(F.broadcast(offsets), of(d, offsets) & (d["range"] == offsets["r"])).drop("s", "r")
    d = d.withColumn("src_rank", (F.col("before") + F.col("within")).cast("bigint"))
    d = d.withColumn("block", F.floor(F.col("src_rank") / block_rows).cast("bigint"))
    d = d.join(F.broadcast(slots), of(d, slots) & (F.floor(d["block"] / SLOTS_A_ROW) == slots["k"]), "left")
    d = d.withColumn("slot", F.get("at", (F.col("block") % SLOTS_A_ROW).cast("int")))
    return d.select("doc", "src_rank", "block", "slot", (F.col("slot") * block_rows + F.col("src_rank") % block_rows).alias("position"))


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """The columns of docs, and those that are added, in place of input columns of their names."""
    d = scheduled(docs, **how)
    return d.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in ADDED], *ADDED)
