"""Mixing sources to target weights by pivotal dependent rounding, with
DataFrame and SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD_PATTERN, settled

MAX_BROADCAST_SOURCES = 50_000
REPEAT_BLOCK = 1000


def source_targets(sized: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """One row per source: ``source, n, source_size, target``.

    Sources in code-point order, null last, get the weights in turn, repeating.
    Targets share the sum of all sizes by weight; none exceeds ``cap`` times its
    source's size and the excess is shared again by weight among the others.
    That fixed point is a water level: with sources ordered by cap/weight, the
    capped ones are a prefix, found with one running sum.  The windows run over
    the table of sources, which has a row per source, not per document.
    """
    table = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), turn.cast("int")))
    table = table.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("weight"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    room = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    load = F.sum("weight").over(Window.orderBy(F.col("ratio").desc(), F.col("source").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    table = table.withColumn("level", room / load).withColumn("capped", F.col("ratio") <= F.col("level"))
    # The level that holds is the one of the first source that isn't capped.
    level = F.min_by("level", F.when(~F.col("capped"), F.col("ratio"))).over(whole)
    return table.select("source", "n", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(level * F.col("weight")).alias("target"))


def _uniform(*keys: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def _pivot(seed: int, level: int):
    """The fold of one group: the state holds the one fractional row so far and
    the rows already decided; each step lets that row and the next exchange
    words until one of the two has probability 0 or 1."""

    def step(state: Column, row: Column) -> Column:
        a, b = state["open"], row
        wa, wb = a["size"].cast("double"), b["size"].cast("double")
        up, down = F.least(wa * (1 - a["p"]), wb * b["p"]), F.least(wa * a["p"], wb * (1 - b["p"]))
        rises = _uniform(F.lit(seed), F.lit(level), a["h"], b["h"]) * (up + down) < down

        def put(x: Column, p: Column) -> Column:
            return F.struct(x["order"].alias("order"), x["h"].alias("h"), x["doc"].alias("doc"), x["size"].alias("size"), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p"))

        a_first, b_first = wa * (1 - a["p"]) <= wb * b["p"], wa * a["p"] <= wb * (1 - b["p"])
        closed = F.when(rises, F.when(a_first, put(a, F.lit(1.0))).otherwise(put(b, F.lit(0.0)))).otherwise(F.when(b_first, put(a, F.lit(0.0))).otherwise(put(b, F.lit(1.0))))
        opened = F.when(rises, F.when(a_first, put(b, b["p"] - up / wb)).otherwise(put(a, a["p"] + up / wa))).otherwise(F.when(b_first, put(b, b["p"] + down / wb)).otherwise(put(a, a["p"] - down / wa)))
        return F.when(a.isNull(), F.struct(put(row, row["p"]).alias("open"), state["done"].alias("done"))).otherwise(
            F.struct(opened.alias("open"), F.concat(state["done"], F.array(closed)).alias("done"))
        )

    return step


def _numbered(counted: DataFrame) -> DataFrame:
    """``doc, source, size, nth``: each row of ``counted`` as often as its ``times``
    says, numbered from 1.  Many repeats are dealt out in blocks first, so that no
    task writes out all of them."""
    keep = ["doc", "source", "size"]
    few = counted.filter(F.col("times") <= REPEAT_BLOCK).select(*keep, F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"))
    blocks = counted.filter(F.col("times") > REPEAT_BLOCK).select(*keep, "times", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEAT_BLOCK))).alias("block"))
    first, last = F.col("block") * REPEAT_BLOCK + 1, F.least((F.col("block") + 1) * REPEAT_BLOCK, F.col("times"))
    many = blocks.repartition("doc", "block").select(*keep, F.explode(F.sequence(first, last)).alias("nth"))
    return few.unionByName(many)


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    cap: float = 3,
    fanout: int = 64,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words of each document the mix takes:
    ``id, size, source_size, target, taken``, a row per input row.

    A document's expected copies are target/source_size.  The whole part is
    taken; the fraction is decided by pivotal rounding.  Within groups of about
    ``fanout`` documents of one source, two fractional documents exchange
    expected words (so the group's expected total stays exact) until one of
    them is taken or not; at most one fractional document per group goes on
    to the next level of a reduction tree, whose depth is log_fanout of the
    largest source.  A source ends within one document's size of its target.
    All draws are hashes of ids and ``seed``, so reruns agree.  Groups are dealt
    by a hash of id within the source: a source with any share of the rows is
    spread over as many groups as its rows need.

    size is the number of ``[^\\x20\\x09-\\x0D]+`` in the text, 0 for null.
    Documents of size 0 take 0.  A null source is a source, last in order.
    Repeated rows count one by one.  An empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = settled(docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), size.alias("size")), "mix-sizes")
    targets = settled(source_targets(sized, weights, cap), "mix-targets")
    n_sources, largest = targets.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    # The count is checked: a few short rows go to all tasks, more are joined by a shuffle.
    side = F.broadcast(targets) if n_sources <= MAX_BROADCAST_SOURCES else targets
    # Rows that repeat id, source and size get a number, so that a group stays small whatever repeats.
    numbered = sized.groupBy("doc", "source", "size").agg(F.count("*").alias("times"))
    numbered = _numbered(numbered)
    rows = numbered.join(side.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    rows = rows.withColumn("share", share).withColumn("base", F.floor("share").cast("long"))
    rows = rows.withColumn("p", F.col("share") - F.col("base")).withColumn("h", F.xxhash64(F.lit(seed), "doc", "nth"))
    info = ["source", "source_size", "target", "base"]
    by = ["source", "source_size", "target", "base", "n"]
    fractional = (F.col("p") > 0) & (F.col("size") > 0)
    final = rows.filter(~fractional).select("doc", "size", *info[1:], F.lit(0.0).alias("p"))
    row_type = f"struct<order:bigint,h:bigint,doc:{docs.schema[id_col].dataType.simpleString()},size:bigint,p:double>"
    empty = F.struct(F.lit(None).cast(row_type).alias("open"), F.array().cast(f"array<{row_type}>").alias("done"))
    buckets = F.greatest(F.ceil(F.col("n") / fanout).cast("long"), F.lit(1))
    level_rows = rows.filter(fractional).select(*by, F.pmod("h", buckets).alias("bucket"), F.struct((-F.col("size")).alias("order"), "h", "doc", "size", "p").alias("row"))
    depth = max(1, math.ceil(math.log(max(largest, 2), fanout)) + 1)
    for level in range(depth):
        groups = level_rows.groupBy(*by, "bucket").agg(F.array_sort(F.collect_list("row")).alias("rows"))
        folded = groups.select(*by, "bucket", F.aggregate("rows", empty, _pivot(seed, level)).alias("state"))
        folded = settled(folded, f"mix-level-{level}")
        done = folded.select(*by, F.explode("state.done").alias("row"))
        final = final.unionByName(done.select("row.doc", "row.size", *info[1:], "row.p"))
        level_rows = folded.select(*by, F.floor(F.col("bucket") / fanout).alias("bucket"), F.col("state.open").alias("row"))
    last = F.when(_uniform(F.lit(seed), F.lit(-1), F.col("row.h")) < F.col("row.p"), 1.0).otherwise(0.0)
    final = final.unionByName(level_rows.select("row.doc", "row.size", *info[1:], last.alias("p")))
    taken = ((F.col("base") + F.col("p").cast("long")) * F.col("size")).cast("long")
    return final.select(F.col("doc").alias("id"), "size", F.col("source_size").cast("long").alias("source_size"), F.col("target"), taken.alias("taken"))
