"""K-d tree sharding: leaves of near-equal bytes, cut at distributed weighted medians.

Each row has a weight (its bytes) and a coordinate in each metadata dimension. A node that is to
become k leaves is cut along its widest dimension so that its halves have floor(k/2) and ceil(k/2)
leaves' share of the weight, until every node is one leaf. The number of leaves is given, or is the
total weight over the target bytes.

A coordinate is a 62-bit integer: 31 bits of the value's place between the least and greatest one,
then 31 bits of a hash of the row, so that equal values (one source with a third of all rows) can
be cut anywhere. Medians come from histograms of the weight that Spark adds up and cuts: one small
job per refinement for all nodes of a level at once, until the cut is exact to ``tolerance`` of a leaf
or no other cut would part the rows differently. A row carries the node that it is in; each level moves
it by a join with the level's table of cuts, so plans don't grow with the tree. The driver sees one row
per node and refinement, and the table of cuts is broadcast up to ``BROADCAST_NODES`` nodes. Texts are
read once, to measure them, and never shuffled.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Table, fresh

_HASH_BITS = 31


#: The largest table of nodes (some 50 bytes each) that is broadcast; beyond it, rows and nodes meet in a shuffle.
BROADCAST_NODES = 200_000


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, lang, source): one narrow row per document; a null text weighs ``overhead``."""
    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    extra = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), *extra)


#: Metadata dimensions: any order of the values will do for a tree, so names take a hash's order.
DIMENSIONS = {
    "doc_id": lambda: F.coalesce(F.col("doc_id"), F.lit(0)).cast("double"),
    "size": lambda: F.log("size"),
    "lang": lambda: F.crc32(F.coalesce("lang", F.lit("")).cast("binary")).cast("double"),
    "source": lambda: F.crc32(F.coalesce("source", F.lit("")).cast("binary")).cast("double"),
}


def _nodes(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A table of a level's nodes."""
    df = spark.createDataFrame(pa.table(columns))
    return F.broadcast(df) if len(columns["node"]) <= BROADCAST_NODES else df


def kd_leaves(spark: SparkSession, rows: DataFrame, n_dims: int, leaves: int, bins: int = 1024, tolerance: float = 0.0005) -> DataFrame:
    """``rows`` (size, c0 .. c{n-1} and others) with ``node``, the leaf of each row from 0, as a written table.

    A node goes by its first leaf: what is left of a cut keeps the number, the rest takes a new one.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    c = F.get(F.array(*[F.col(f"c{i}") for i in range(n_dims)]), F.col("dim").cast("int"))
    now = Table(spark, rows.withColumn("node", F.lit(0).cast("long")), "nodes")
    width = {0: leaves}  # the leaves that a node is to become
    while level := {k: n for k, n in width.items() if n > 1}:
        ends = [f(f"c{i}").alias(f"{k}{i}") for i in range(n_dims) for k, f in (("lo", F.min), ("hi", F.max))]
        state = {}
        for r in now.df.join(_nodes(spark, {"node": list(level)}), "node").groupBy("node").agg(F.sum("size").alias("w"), *ends).collect():
            n, dim = level[r["node"]], max(range(n_dims), key=lambda i: r[f"hi{i}"] - r[f"lo{i}"])
            state[r["node"]] = {"dim": dim, "lo": r[f"lo{dim}"], "hi": r[f"hi{dim}"] + 1, "need": r["w"] * (n // 2) / n}
        if not state:
            break  # no row is left to part
        while live := {k: s for k, s in state.items() if "cut" not in s}:
            for s in live.values():
                s["step"] = max(1, -(-(s["hi"] - s["lo"]) // bins))
            at = _nodes(spark, {"node": list(live), **{x: [s[x] for s in live.values()] for x in ("dim", "lo", "hi", "step", "need")}})
            inside = now.df.join(at, "node").withColumn("c", c).where("c >= lo AND c < hi").withColumn("bin", F.expr("(c - lo) div step"))
            hist = inside.groupBy("node", "bin").agg(F.sum("size").alias("w"), F.first("need").alias("need"), (F.min("c") == F.max("c")).alias("one"))
            run = F.sum("w").over(W.partitionBy("node").orderBy("bin"))
            crossing = {r["node"]: r for r in hist.withColumn("run", run).where("run >= need AND run - w < need").collect()}
            for k, s in live.items():
                r = crossing.get(k)
                if r is None:
                    s["cut"] = s["hi"]
                    continue
                before, over = s["need"] - (r["run"] - r["w"]), r["run"] - s["need"]
                lo = s["lo"] + r["bin"] * s["step"]
                if s["step"] == 1 or r["one"] or min(before, over) <= tolerance * total / leaves:
                    s["cut"] = lo if before <= over else lo + s["step"]
                s["lo"], s["hi"], s["need"] = lo, lo + s["step"], before
        cuts = _nodes(spark, {"node": list(state), "dim": [s["dim"] for s in state.values()], "cut": [s["cut"] for s in state.values()], "right": [k + level[k] // 2 for k in state]})
        stays = F.col("right").isNull() | (c < F.col("cut"))
        moved = now.df.join(cuts, "node", "left").select(*rows.columns, F.when(stays, F.col("node")).otherwise(F.col("right")).alias("node"))
        last, now = now, Table(spark, moved, "nodes")
        last.drop()
        width = {k: n for old, m in width.items() for k, n in (((old, m // 2), (old + m // 2, m - m // 2)) if m > 1 else ((old, m),))}
    return now.df


def kd_shards(spark: SparkSession, docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", rows_per_slice: int = 50_000) -> DataFrame:
    """(doc_id, size, text_crc32, lang, source, shard, slot) for every row of ``docs``.

    Give ``shards``, or ``target_bytes`` for ceil(total / target) of them. ``slot`` counts a shard's
    rows from 0 without gaps; it is numbered by slices of a shard, so no task holds a whole shard.
    Null ids and texts are measured like others (a null text as empty); identical rows are told apart by
    their place in the measured table, so any cut can part them. A very long text is one row of a great weight, and its shard is larger by it. An
    empty table gives an empty result.
    """
    base = Table(spark, measure(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "measured").df
    ranges = base.agg(F.count("*").alias("n"), F.sum("size").alias("w"), *[f(d()).alias(f"{k}_{name}") for name, d in DIMENSIONS.items() for k, f in (("lo", F.min), ("hi", F.max))]).first()
    leaves = shards or max(1, math.ceil((ranges["w"] or 0) / (target_bytes or 1)))
    tie = F.xxhash64("doc_id", "text_crc32", "size", "row")
    coords = []
    for i, (name, d) in enumerate(DIMENSIONS.items()):
        lo, hi = ranges[f"lo_{name}"] or 0.0, ranges[f"hi_{name}"] or 0.0
        place = F.lit(0.0) if hi <= lo else (d() - F.lit(lo)) / F.lit(hi - lo)
        value = F.least(F.floor(place * F.lit(float(1 << _HASH_BITS))), F.lit((1 << _HASH_BITS) - 1)).cast("long")
        low = F.call_function("shiftrightunsigned", F.xxhash64(F.lit(i), tie), F.lit(64 - _HASH_BITS))
        coords.append((F.call_function("shiftleft", value, F.lit(_HASH_BITS)) + low).alias(f"c{i}"))
    rows = kd_leaves(spark, base.select("*", *coords), len(coords), leaves)
    slices = max(1, math.ceil((ranges["n"] or 0) / leaves / rows_per_slice))
    part = F.pmod(F.xxhash64(F.lit("slice"), tie), F.lit(slices)).cast("int")
    placed = rows.select(*base.columns, F.col("node").cast("int").alias("shard"), part.alias("slice"))
    counts = placed.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "slice", (F.sum("n").over(W.partitionBy("shard").orderBy("slice")) - F.col("n")).alias("start"))
    order = W.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size", "row")
    return placed.withColumn("rn", F.row_number().over(order)).join(starts, ["shard", "slice"]).select(*[c for c in base.columns if c != "row"], "shard", (F.col("start") + F.col("rn") - 1).cast("long").alias("slot"))


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int = 8) -> None:
    """Write ``docs`` as ``shard=K`` folders; a shard is written by up to ``parts`` tasks. Ids have to be unique."""
    shard = fresh(docs, "shard")
    placed = kd_shards(spark, docs, shards, target_bytes, id_col, text_col).select(F.col("doc_id").alias("_kd_id"), F.col("shard").alias(shard))
    out = docs.join(placed, F.col(id_col).eqNullSafe(F.col("_kd_id"))).drop("_kd_id")
    out.repartition(shard, F.pmod(F.xxhash64(id_col), F.lit(parts))).write.partitionBy(shard).parquet(path)
