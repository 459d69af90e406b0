"""What the two substring operators share: windows are dealt by anchors that
depend on their content alone, so equal windows always meet.

A window is a run of ``size`` units (bytes or words).  Every window has one
anchor inside it, chosen by its content; neighbouring windows with the same
anchor form a range.  Equal windows have equal anchors at equal offsets:
a range whose anchor occurs once in the corpus holds no repeat and is done.
Ranges that are equal as a whole are repeats throughout.  What is left, ranges
that share an anchor but differ, is resolved window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, settled

# A key with more different ranges than this is resolved by its windows' fingerprints, which no single task gathers.
HOT_RANGES = 4096
SPAN = "array<struct<at:int,n:int>>"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, h, text``: rows are told apart by id and a hash of the text, so that
    rows that repeat an id with another text don't mix."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.hash(text).alias("h"), text.alias("text"))


def _on(left: DataFrame, right: DataFrame):
    return left["id"].eqNullSafe(right["_id"]) & (left["h"] == right["_h"])


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "_id").withColumnRenamed("h", "_h")


def ranges_of(anchor: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, number of windows) of the runs of windows with one anchor
    place in one document; ``anchor`` is -1 where there is no window."""
    if len(anchor) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(anchor)))
    real = anchor[first] >= 0
    return first[real], n[real]


def repeated_spans(
    source: DataFrame,
    anchors: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    emit: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    resolve: Callable[[DataFrame], DataFrame],
    emit_schema: str,
    name: str,
) -> DataFrame:
    """``id, h, spans`` of the documents that have repeated windows: spans are
    runs (first window, number of windows).

    ``anchors`` turns (id, h, text) into rows (key, print, id, h, at, n): the
    anchor's name, a fingerprint of the whole range, and the range.  ``emit``
    turns (id, h, text, wanted) into what ``resolve`` needs of the wanted
    ranges; ``resolve`` returns (id, h, at, n) of repeated runs.
    """
    kind = source.schema["id"].dataType.simpleString()
    schema = f"key long, print long, id {kind}, h int, at int, n int"
    found = source.mapInArrow(anchors, schema)
    # Partial counts: a name that every document has is one row per task here.  They are
    # written, so that the join below deals out both sides anew and Spark can split a large key.
    keys = found.groupBy("key").agg(F.count("*").alias("times"), F.min("print").alias("lo"), F.max("print").alias("hi")).filter("times > 1").select("key", "times", (F.col("lo") == F.col("hi")).alias("same"))
    keys = settled(keys, f"{name}-keys")
    shared = settled(found.join(keys, "key"), f"{name}-shared")
    discard(keys)
    whole = shared.filter("same").select("id", "h", "at", "n")
    mixed = shared.filter("NOT same").select("key", "print", "id", "h", "at", "n", "times")
    groups = settled(mixed.groupBy("key", "print").agg(F.count("*").alias("copies"), F.min(F.struct("id", "h", "at")).alias("first")), f"{name}-groups")
    mixed = settled(mixed.join(groups, ["key", "print"]), f"{name}-mixed")
    discard(groups)
    whole = whole.unionByName(mixed.filter("copies > 1").select("id", "h", "at", "n"))
    # One range of each group of equal ones stands for it; groups of one get their result.
    stand = mixed.filter(F.struct("id", "h", "at") == F.col("first")) if kind != "void" else mixed
    different = stand.groupBy("key").agg(F.count("*").alias("ranges"))
    stand = stand.join(different, "key").select("id", "h", F.struct("key", "at", "n", (F.col("copies") == 1).alias("ask"), (F.col("ranges") > HOT_RANGES).alias("hot")).alias("range"))
    wanted = _renamed(stand.groupBy("id", "h").agg(F.collect_list("range").alias("wanted")))
    texts = source.join(wanted, _on(source, wanted)).select("id", "h", "text", "wanted")
    part = resolve(texts.mapInArrow(emit, emit_schema.replace("ID", kind)))
    return whole.unionByName(part).groupBy("id", "h").agg(F.collect_list(F.struct("at", "n")).cast(SPAN).alias("spans"))


def with_spans(source: DataFrame, spans: DataFrame) -> DataFrame:
    """``id, h, text, spans`` of all documents."""
    spans = _renamed(spans)
    return source.join(spans, _on(source, spans), "left").select("id", "h", "text", "spans")


def counted(prints: DataFrame) -> DataFrame:
    """Of windows ``(id, h, at, p, q, ask)``: ``id, h, at, n`` of those asked about
    whose two 64-bit fingerprints occur more than once."""
    times = prints.groupBy("p", "q").agg(F.count("*").alias("times")).filter("times > 1").select("p", "q")
    return prints.filter("ask").join(times, ["p", "q"]).select("id", "h", "at", F.lit(1).alias("n"))


def covered(spans: list[dict] | None, size: int, length: int) -> np.ndarray:
    """Which units of a document are covered by a repeated window."""
    edge = np.zeros(length + 1, np.int32)
    for s in spans or ():
        edge[s["at"]] += 1
        edge[min(s["at"] + s["n"] - 1 + size, length)] -= 1
    return np.cumsum(edge[:-1]) > 0
