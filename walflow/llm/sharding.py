"""Sharding [native]: a k-d tree over row metadata, split at distributed weighted medians.

Law ``bytes``: every leaf holds nearly the same number of bytes. The points of the tree
are the groups of equal texts, so a group never spans two leaves. A point's dimensions
are its metadata: source and lang (as CRC-32 of the group's least value; null counts as
empty), size and number of characters; last come two hashes of the text, which can always
be cut fairly. A node splits along its widest dimension (its range against the whole
table's) at the weighted median, until leaves are down to the target bytes: the
whole divided by the shards or, with `leaf_bytes`, at most those. Where a heavy value of
the widest dimension makes its halves differ by more than ``SLACK``, the dimension that
cuts best is taken.

All nodes' medians along all dimensions are found together: a pass counts the bytes in
``BINS`` equal bins of each current range, the bin that holds the median becomes the
next range, until ranges are single values. Only these histograms, at most nodes x
dimensions x BINS rows whatever the input, reach the driver.

A group with more bytes than a whole leaf cannot stay together under this law: its rows
are dealt over further points in turn, and `group_split` says so.

The layout follows from the rows alone, not from the session's settings. Defined cases:
a null text counts no bytes plus 1, CRC-32 of nothing (0); repeated rows are separate
rows of one group; null doc_ids sort first; an empty table gives an empty result; extra
columns are ignored, and source and lang may be missing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from walflow.llm.common import save

BINS = 2048
SLACK = 0.02
METADATA, HASHES = ("source", "lang", "size", "chars"), ("text_crc32", "mixed")
DIMS = METADATA + HASHES
#: Rows per part in which rows of a shard or of a split group are numbered.
PART_ROWS = 50_000


def _medians(points: DataFrame, nodes: dict[tuple[int, str], tuple[int, int, float]]) -> dict[tuple[int, str], tuple[int, float]]:
    """For (node, dimension) -> (least, most, bytes): (the cut, the bytes up to it). Rows with value <= cut go left."""
    state = {k: (lo, hi, 0.0) for k, (lo, hi, _) in nodes.items()}
    out: dict[tuple[int, str], tuple[int, float]] = {}
    while state:
        step = {k: max(1, math.ceil((hi - lo + 1) / BINS)) for k, (lo, hi, _) in state.items()}
        bins = []
        for d in sorted({d for _, d in state}):
            cases = " ".join(f"WHEN node = {n} AND {d} BETWEEN {lo} AND {hi} THEN ({d} - {lo}) DIV {step[n, d]}" for (n, e), (lo, hi, _) in state.items() if e == d)
            bins.append(f"named_struct('d', '{d}', 'bin', CASE {cases} END)")
        rows = points.select("node", "weight", F.expr(f"explode(array({', '.join(bins)})) AS x")).where("x.bin IS NOT NULL")
        found: dict[tuple[int, str], list[tuple[int, float]]] = {}
        for r in rows.groupBy("node", "x.d", "x.bin").agg(F.sum("weight").alias("w")).collect():
            found.setdefault((r.node, r.d), []).append((r.bin, r.w))
        for k in list(state):
            lo, _, below = state[k]
            counts, s, half = sorted(found[k]), step[k], nodes[k][2] / 2
            for b, w in counts:
                if below + w >= half or (b, w) == counts[-1]:
                    break
                below += w
            if s == 1:  # a single value: cut before or after it, whichever is nearer to half
                cut = lo + b
                out[k] = (cut - 1, below) if half - below < below + w - half and below > 0 else (cut, below + w)
                del state[k]
            else:
                state[k] = (lo + b * s, lo + (b + 1) * s - 1, below)
    return out


def shard_points(points: DataFrame, shards: int) -> DataFrame:
    """Adds `shard` to points (the dimensions and weight)."""
    levels = round(math.log2(shards))
    if 2**levels != shards:
        raise ValueError("the number of shards must be a power of two")
    ends = [f(d).alias(f"{d}_{e}") for d in DIMS for f, e in ((F.min, "lo"), (F.max, "hi"))]
    points = points.withColumn("node", F.lit(0))
    whole: dict[str, int] | None = None
    for _ in range(levels):
        stats = points.groupBy("node").agg(F.sum("weight").alias("w"), *ends).collect()
        if not stats:
            break
        whole = whole or {d: max(1, stats[0][f"{d}_hi"] - stats[0][f"{d}_lo"]) for d in DIMS}
        todo = {(r.node, d): (r[f"{d}_lo"], r[f"{d}_hi"], float(r.w)) for r in stats for d in DIMS}
        found = _medians(points, todo)
        cuts: dict[int, tuple[str, int]] = {}
        for r in stats:
            order = sorted(DIMS, key=lambda d: (d in HASHES, -(r[f"{d}_hi"] - r[f"{d}_lo"]) / whole[d]))
            off = {d: abs(found[r.node, d][1] / float(r.w) - 0.5) for d in order}
            chosen = next((d for d in order if off[d] <= SLACK / 2), min(order, key=off.get))
            cuts[r.node] = (chosen, found[r.node, chosen][0])
        right = F.coalesce(*[F.when((F.col("node") == n) & (F.col(d) > F.lit(int(cut))), F.lit(1)) for n, (d, cut) in cuts.items()], F.lit(0))
        points = points.withColumn("node", F.col("node") * 2 + right)
    return points.withColumn("shard", F.col("node"))


def shard_documents(docs: DataFrame, shards: int = 16, leaf_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and group_split for every row of docs (doc_id, text, source, lang)."""
    code = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) if c in docs.columns else F.lit(0).cast("long")
    rows = docs.select(
        F.col("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
        F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"), code("source").alias("source"), code("lang").alias("lang"),
    )
    rows = save(rows, "shard-rows")
    keys = ["text_crc32", "size"]
    groups = rows.groupBy(*keys).agg(F.sum("size").alias("weight"), *[F.min(c).alias(c) for c in ("chars", "source", "lang")])
    facts = rows.agg(F.sum("size").alias("total"), F.count("*").alias("n")).first()
    total = facts.total or 0
    if leaf_bytes:
        shards = 1 << max(0, math.ceil(math.log2(max(1, total) / leaf_bytes)))
    leaf = max(1.0, total / shards)
    pieces = F.greatest(F.lit(1), F.ceil(4 * F.col("weight") / leaf) * (F.col("weight") > leaf).cast("long"))
    points = (
        groups.withColumn("pieces", pieces.cast("long")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        .withColumn("weight", F.col("weight") / F.col("pieces")).withColumn("mixed", F.shiftrightunsigned(F.xxhash64(*keys, "piece"), 32))
    )
    points = save(points, "shard-points")
    placed = shard_points(points, shards).select(*keys, "piece", "pieces", "shard")
    # A group over a leaf's size has several points; its rows choose among them by doc_id.
    large = placed.where("pieces > 1").groupBy(*keys).agg(F.max("pieces").alias("n"), F.array_sort(F.collect_list(F.struct("piece", "shard"))).alias("at"))
    small = placed.where("pieces = 1").select(*keys, "shard")
    found = rows.join(small, keys, "left").join(F.broadcast(large), keys, "left")  # at most `shards` groups outweigh a leaf
    parts = max(1, -(-facts.n // PART_ROWS))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    turn = F.row_number().over(Window.partitionBy(*keys, part).orderBy("doc_id")) + part  # round robin, so pieces are as equal as planned
    hot = found.where("n is not null").withColumn("shard", F.col("at")[F.pmod(turn, F.col("n")).cast("int")]["shard"])
    out = found.where("n is null").unionByName(hot).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("n").isNotNull().alias("group_split"))
    # Gapless slots without one task a shard: number the rows of each part, then add what earlier parts hold.
    out = save(out.withColumn("part", part), "shard-placed")
    sums = out.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        out.withColumn("k", F.row_number().over(within)).join(sums, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_split")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
