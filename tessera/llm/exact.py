"""Exact deduplication by progressive refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, discard, settled, text_key, with_text_key

PREFIX_CHARS = 64
# Key tables up to this many rows (at most some 150 bytes each) go to all tasks; larger ones are joined by a shuffle.
MAX_BROADCAST_KEYS = 200_000


def _side(df: DataFrame) -> DataFrame:
    """A settled table of keys, as a side of a join that fits its counted size."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_KEYS else df


def _normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES.decode(), "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, digest``.

    Texts are equal when identical after deleting every space, tab, LF, VT, FF
    and CR.  Rows are refined in three rounds: by normalised length, then by a
    hash of the first 64 normalised characters, then by SHA-256 of the whole
    text; only rows that share their key with another row enter the next round,
    and only survivors of the second have their content read again.  With
    ``digest_all`` (for callers that report every digest) the digests are
    written in the first pass; the rounds still decide who is compared.
    All of it is built-in functions.

    In a group the row with the most code points in its original text stays,
    then the smallest id (null ids first).  A null text counts as empty; empty
    texts form one group; rows that repeat an id and a text share a decision;
    an empty table gives an empty result.  Columns other than id and text are
    not read, so their names don't matter.  ``digest`` is null for rows that
    dropped out of the refinement unless ``digest_all``.
    """
    return _decided(docs, id_col, text_col, digest_all).select("id", "keep_id", "group_size", "kept", "digest")


def _decided(docs: DataFrame, id_col: str, text_col: str, digest_all: bool) -> DataFrame:
    """The rows of ``exact_dedup`` with ``h`` and ``keep_h``, the text keys of the
    row and of the one that stays: ids may be null or repeat with other texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("h"), F.length(text).cast("long").alias("n_chars"), _normalised(F.col(text_col)).alias("text"))
    source = source.select("id", "h", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64(F.substring("text", 1, PREFIX_CHARS)).alias("prefix"), "text")
    digest = F.sha2(F.encode("text", "UTF-8"), 256).alias("digest")
    narrow = ["id", "h", "n_chars", "n_bytes", "prefix"]
    rows = settled(source.select(*narrow, digest) if digest_all else source.select(*narrow, F.lit(None).cast("string").alias("digest")), "exact-rows")

    # Partial counts: a length or prefix of any share of the rows is a row per task in the exchange.
    lengths = settled(rows.groupBy("n_bytes").agg(F.count("*").alias("n")).filter("n > 1").select("n_bytes"), "exact-lengths")
    heads = rows.join(_side(lengths), "n_bytes", "left_semi").groupBy("n_bytes", "prefix").agg(F.count("*").alias("n")).filter("n > 1")
    heads = settled(heads.select("n_bytes", "prefix"), "exact-heads")
    side = _side(heads)
    discard(lengths)
    if digest_all:
        alive = rows.join(side, ["n_bytes", "prefix"], "left_semi").select("id", "h", "n_chars", "digest")
    else:
        alive = source.join(side, ["n_bytes", "prefix"], "left_semi").select("id", "h", "n_chars", digest)
        alive = settled(alive, "exact-digests")
    alone = rows.join(side, ["n_bytes", "prefix"], "left_anti").select("id", "h", F.col("h").alias("keep_h"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")

    # Groups are written before the join, so that Spark deals out both of its sides anew and can split a large group.
    groups = alive.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("id").alias("i"), F.col("h").alias("h"))).alias("best")).filter("n > 1")
    groups = settled(groups.select("digest", "n", F.col("best.i").alias("best"), F.col("best.h").alias("best_h")), "exact-groups")
    grouped = F.col("n").isNotNull()
    met = alive.join(_side(groups), "digest", "left").select(
        "id",
        "h",
        F.when(grouped, F.col("best_h")).otherwise(F.col("h")).alias("keep_h"),
        F.when(grouped, F.col("best")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (~grouped | F.col("id").eqNullSafe(F.col("best"))).alias("kept"),
        "digest",
    )
    return met.unionByName(alone)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without exact copies, all columns kept.

    Rows that repeat the kept row's id and text are reduced to one as well.
    """
    stays = _decided(docs, id_col, text_col, False).filter("kept AND h = keep_h").select(F.col("id").alias("_stays"), F.col("h").alias("_stays_h")).distinct()
    rows, h = with_text_key(docs, text_col)
    kept = rows.join(stays, rows[id_col].eqNullSafe(stays["_stays"]) & (rows[h] == stays["_stays_h"]), "left_semi")
    return kept.dropDuplicates([id_col, h]).drop(h)


def normalised(text: str | None) -> str:
    """The text that is compared, for brute-force checks."""
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
