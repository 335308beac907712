"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.llm.shared import SPACE, stored, text_or_empty

#: Rows that one packing task places at most, about; a constant, so that a document's lot does not depend on the cluster.
LOT_ROWS = 20_000


def place(loads: np.ndarray, shards: int, residual: np.ndarray | None = None, totals: np.ndarray | None = None, aligned: bool = False) -> np.ndarray:
    """Shard of each group, in the given order: the one whose residual capacity has the highest dot product with the group.

    Loads are divided by the total of their dimension, so that each shard's capacity is
    1/shards in every dimension, unless `residual` says what is left of it; a shard filled beyond a capacity
    has a negative residue. `residual` is updated, and `totals` replace those of the loads.
    With `aligned` the direction of a residue counts and not its length, which is what unequal capacities need.
    Ties go to the lowest shard. The rule alone lets a large residue in one dimension attract
    groups into a shard that is full in another, so a group goes to shards that hold it in
    every dimension as long as there is one."""
    totals = loads.sum(axis=0) if totals is None else totals
    share = loads / np.where(totals > 0, totals, 1.0)
    residual = np.full((shards, loads.shape[1]), 1.0 / shards) if residual is None else residual
    out = np.empty(len(share), np.int32)
    for k, v in enumerate(share):
        fits = (residual >= v).all(axis=1)
        score = residual @ v
        if aligned:
            score = score / np.maximum(np.sqrt((residual ** 2).sum(axis=1)), 1e-12)
        if fits.any():
            score = np.where(fits, score, -np.inf)
        else:       # none holds it: the largest residue in the scarcest dimension
            score = (residual - v).min(axis=1)
        out[k] = best = int(score.argmax())
        residual[best] -= v
    return out


def sharded(docs: DataFrame, shards: int = 8, lot_rows: int = LOT_ROWS) -> DataFrame:
    """Rows (doc_id, size, tokens, text_crc32, group, shard, slot).

    size is the UTF-8 length plus one and tokens the number of words; null text counts as
    empty. Equal texts form a group, told apart by a 256-bit digest, and a group stays in one
    shard unless it is larger than a shard, when it is first split by a hash of doc_id. Groups above a
    64th of a lot of about `lot_rows` rows are few; they are placed first, by their sums and over the
    whole table. All others are dealt by their digest into lots, and every lot is packed on its own into what
    the large groups have left of the shards, largest groups first, so no task sees more than a
    lot. Slots number the rows of each shard from 0 in lot order. Repeated rows are placed each."""
    text = text_or_empty()
    data = F.encode(text, "UTF-8")
    words = F.size(F.array_remove(F.split(text, SPACE), ""))
    rows = stored(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), words.cast("long").alias("tokens"),
                              F.crc32(data).alias("text_crc32"), F.unhex(F.sha2(data, 256)).alias("group")), "sizes")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "tokens")] + [F.count(F.lit(1)).alias("n")]
    totals = np.array(rows.agg(*sums).first(), float)
    lots = max(1, -(-int(totals[2]) // lot_rows))
    share = F.greatest(*(F.col(c) / F.lit(max(t, 1.0)) for c, t in zip(("size", "tokens", "n"), totals)))
    large = rows.groupBy("group").agg(*sums).withColumn("share", share).filter(F.col("share") > 1 / (64 * lots))
    # a group beyond a shard is split into quarters of a shard, about
    pieces = F.when(F.col("share") > 1 / shards, F.least("n", F.ceil(F.col("share") * (4 * shards)))).otherwise(F.lit(1)).cast("long")
    large = stored(large.select("group", pieces.alias("pieces")), "large")
    part = F.pmod(F.xxhash64("doc_id"), F.col("pieces"))
    units = rows.join(F.broadcast(large), "group").groupBy("group", part.alias("part")).agg(*sums).collect()
    units.sort(key=lambda u: (-max(x / max(t, 1.0) for x, t in zip(u[2:], totals)), bytes(u[0]), u[1]))
    residual = np.full((shards, 3), 1.0 / shards)
    loads = np.array([u[2:] for u in units], float).reshape(len(units), 3)
    fixed = list(zip((u[0] for u in units), (u[1] for u in units), place(loads, shards, residual, totals).tolist()))
    fixed = docs.sparkSession.createDataFrame(fixed, "group binary, part long, fixed int")
    rest = np.maximum(totals - loads.sum(axis=0), 0)
    # what is left of the shards, as shares of what the lots hold
    residual, unequal = residual * totals / np.where(rest > 0, rest, 1.0), bool(units)
    rows = rows.join(F.broadcast(large), "group", "left").withColumn("part", F.coalesce(part, F.lit(0).cast("long"))).drop("pieces")
    rows = rows.join(F.broadcast(fixed), ["group", "part"], "left")
    # rows of placed groups only need slots and go to any lot
    rows = rows.withColumn("lot", F.pmod(F.when(F.col("fixed").isNull(), F.xxhash64("group")).otherwise(F.xxhash64("doc_id", "group")), F.lit(lots)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["group", "part", "doc_id", "text_crc32"], kind="stable").reset_index(drop=True)
        pdf["shard"] = pdf["fixed"].fillna(-1).astype("int32")
        free = pdf["shard"].to_numpy() < 0
        if free.any():
            own = pdf[free]
            key = own.groupby("group", sort=False).ngroup().to_numpy()
            n = key.max() + 1
            loads = np.stack([np.bincount(key, own["size"], n), np.bincount(key, own["tokens"], n), np.bincount(key, minlength=n)], axis=1)
            weight = (loads / np.maximum(loads.sum(axis=0), 1)).max(axis=1)
            order = np.argsort(-weight, kind="stable")
            # lots are turned against each other, so that what ties leave to low shards does not add up
            turned = (np.arange(shards) + int(pdf["lot"].iloc[0])) % shards
            group_shard = np.empty(n, np.int32)
            group_shard[order] = turned[place(loads[order], shards, residual[turned], aligned=unequal)]
            pdf.loc[free, "shard"] = group_shard[key]
        pdf["rank"] = pdf.groupby("shard").cumcount()
        return pdf[["doc_id", "size", "tokens", "text_crc32", "group", "lot", "shard", "rank"]]

    id_type = docs.schema["doc_id"].dataType.simpleString()
    packed = stored(rows.groupBy("lot").applyInPandas(
        pack, f"doc_id {id_type}, size long, tokens long, text_crc32 long, group binary, lot long, shard int, rank long"), "packed")
    counts = packed.groupBy("shard", "lot").agg(F.count(F.lit(1)).alias("n"))      # a row per lot and shard
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return packed.join(before, ["shard", "lot"]).select("doc_id", "size", "tokens", "text_crc32", "group", "shard",
                                                        (F.col("before") + F.col("rank")).alias("slot"))
