"""URL filters: listed host and path rules, and association rules mined from labelled URLs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL = "label="


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL: each label of its host, the words of labels
    that have several, its path segments, and its query keys."""

    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))

    labels = F.split(host, r"\.")
    words = F.array_except(F.split(host, r"[.\-_0-9]+"), labels)
    segments = F.split(F.lower(path), "/")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(tagged("host:", labels), tagged("word:", words), tagged("path:", segments), tagged("key:", keys)))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule ``(verdict, host, path)`` that fits, or null.

    A rule fits its host and all subdomains if the path starts with its own;
    the longest text wins (ties: the earlier in code-point order)."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _frequent(labelled: DataFrame, least: float) -> dict[str, str]:
    """Each token of at least ``least`` rows, and the first of the tokens that
    stand in exactly the same rows: those count as one item, so that tokens which
    always come together don't multiply the combinations.  Rows are told apart by
    their tokens; equal sums of their hashes (and equal counts) mean equal rows."""
    row = F.xxhash64(F.array_sort("tokens")).cast("decimal(38,0)")
    counted = labelled.select(F.explode("tokens").alias("token"), row.alias("row")).groupBy("token").agg(F.count("*").alias("n"), F.sum("row").alias("rows")).filter(F.col("n") >= least)
    first: dict[tuple, str] = {}
    rows = sorted(counted.collect(), key=lambda r: r.token)  # bounded by the support: tokens per row / min_support
    return {r.token: first.setdefault((r.n, r.rows), r.token) for r in rows}


def mine_rules(labelled: DataFrame, min_support: float = 0.001, min_confidence: float = 0.9, min_rows: int = 20) -> list[tuple[frozenset[str], str, float, float]]:
    """Rules ``(tokens, label, confidence, support)`` mined by FP-growth from
    rows ``(tokens array<string>, label string)``; all labelled rows are read.

    Tokens below the least support (``min_support`` of the rows, and
    ``min_rows`` rows) are left out before mining.  Kept are rules of any length
    whose confidence is at least ``min_confidence`` and above that of every
    shorter rule for the same label inside them; a body that never occurs
    without one more token (it isn't closed) says nothing about rows without
    that token and gives no rule of its own.  What reaches the driver is
    bounded by the support, whatever the number of rows: at most
    1/min_support tokens per token of a row, and combinations of them.
    """
    labelled = labelled.filter("label IS NOT NULL AND tokens IS NOT NULL").select(F.array_distinct("tokens").alias("tokens"), "label")
    total = labelled.count()
    if total == 0:
        return []
    floor = max(min_support, min(1.0, min_rows / total))
    item = _frequent(labelled, floor * total)
    together: dict[str, set[str]] = {}
    for token, own in item.items():
        together.setdefault(own, set()).add(token)

    @F.arrow_udf("array<string>")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sorted({item[t] for t in row if t in item}) for row in batch.to_pylist()], pa.list_(pa.string()))

    items = labelled.select(F.concat(known("tokens"), F.array(F.concat(F.lit(LABEL), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=floor, minConfidence=min_confidence, numPartitions=items.sparkSession.sparkContext.defaultParallelism).fit(items)
    count = {frozenset(r["items"]): r["freq"] for r in model.freqItemsets.collect()}
    closed = set(count)
    for whole in count:
        closed -= {whole - {i} for i in whole if not i.startswith(LABEL) and count.get(whole - {i}) == count[whole]}
    rules: dict[tuple[str, frozenset], tuple[float, float]] = {}
    inside: dict[tuple[str, frozenset], float] = {}  # the best confidence of a rule in any part of a body
    for whole in sorted(count, key=lambda s: (len(s), sorted(s))):
        labels = [i for i in whole if i.startswith(LABEL)]
        body = whole - set(labels)
        if len(labels) != 1 or not body:
            continue
        label, confidence = labels[0][len(LABEL) :], count[whole] / count[body]
        below = max((inside.get((label, body - {i}), 0.0) for i in body), default=0.0)
        if body in closed and confidence >= min_confidence and confidence > below:
            rules[label, body] = (confidence, count[whole] / total)
            below = confidence
        inside[label, body] = below
    return [(frozenset().union(*(together[i] for i in body)), label, c, s) for (label, body), (c, s) in rules.items()]


def match_rules(tokens: Column, rules: list[tuple[frozenset[str], str, float, float]]) -> Column:
    """struct<label, confidence, rule> of the best rule that a token array holds, or null.

    Each rule is filed in an inverted index under its rarest token (the one in
    fewest rules); only rules filed under a token of the row are tested.  The
    highest confidence wins, then support, then the larger rule, then the text.
    """
    uses: dict[str, int] = {}
    for body, *_ in rules:
        for t in body:
            uses[t] = uses.get(t, 0) + 1
    index: dict[str, list] = {}
    for rank, (body, label, confidence, _) in enumerate(sorted(rules, key=lambda r: (-r[2], -r[3], -len(r[0]), sorted(r[0]), r[1]))):
        index.setdefault(min(body, key=lambda t: (uses[t], t)), []).append((rank, body, label, confidence, " ".join(sorted(body))))
    kind = pa.struct([("label", pa.string()), ("confidence", pa.float64()), ("rule", pa.string())])

    @F.arrow_udf("label string, confidence double, rule string")
    def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                have, won = set(row or ()), None
                for t in have:
                    for rule in index.get(t, ()):
                        if (won is None or rule[0] < won[0]) and rule[1] <= have:
                            won = rule
                out.append(None if won is None else {"label": won[2], "confidence": won[3], "rule": won[4]})
            yield pa.array(out, kind)

    return best(tokens)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url", labels: DataFrame | None = None, **mining) -> DataFrame:
    """``id, host, path, rule, verdict, confidence, mined_rule`` of every URL.

    The listed rules decide first.  Elsewhere the verdict is that of the best
    association rule mined from the labels, or ``default`` where none holds.
    ``labels`` has ``url, label``; without it the URLs that a listed rule
    decides are the labelled ones.  A null URL, or one without ``://``, has an
    empty host and path, fits no rule and gets the default unless a mined rule
    holds; without labels nothing is mined.  Repeated rows are judged one by one.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path")))
    if labels is None:
        known = rows.select("tokens", F.col("listed.verdict").alias("label"))
    else:
        known = labels.select("url", "label").select(url_tokens(F.col("url"), host, path).alias("tokens"), "label")
    mined = mine_rules(known, **mining)
    rows = rows.withColumn("mined", match_rules(F.col("tokens"), mined))
    return rows.select(
        "id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", "mined.label", F.lit(default)).alias("verdict"),
        F.col("mined.confidence").alias("confidence"), F.col("mined.rule").alias("mined_rule"),
    )


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of one URL, for brute-force checks."""
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
