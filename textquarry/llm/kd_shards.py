"""Shards of near-equal bytes as the leaves of a k-d tree over the metadata.

A node that has to give ``n`` shards is cut in two along its widest dimension,
at the point where ``n // 2`` of ``n`` parts of its bytes lie below. All nodes of
a level are cut together: the weighted quantiles come from histograms of 65 536
bins, refined until a bin holds a single key, so no node is gathered or sorted.
A cut falls between two keys; keys end in a hash of the id, which orders rows
that are alike in the dimension (one source may hold a third of all rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import filled
from textquarry.session import materialise

BIN_BITS = 16
TIE_BITS = 32
KEY_BITS = BIN_BITS + TIE_BITS
DIMENSIONS = ("length", "lang", "source")


def _cell(value: Column) -> Column:
    return F.xxhash64(value).bitwiseAND(F.lit((1 << BIN_BITS) - 1))


def metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(row, doc_id, size, text_crc32, one key per dimension); the only pass over the texts."""
    text = F.col(f"`{text_col}`").cast("string")
    label = {"lang": lang_col, "source": source_col}
    narrow = materialise(docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        (F.octet_length(filled(text)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(filled(text)).alias("text_crc32"),
        *(_cell(F.col(f"`{name}`").cast("string") if name in docs.columns else F.lit(None))
          .alias(kind) for kind, name in label.items())), "metadata")
    low, high = narrow.select(F.min(F.log("size")), F.max(F.log("size"))).first()
    spread = (high - low) if low is not None and high > low else 1.0
    top = (1 << BIN_BITS) - 1
    length = ((F.log("size") - F.lit(low or 0.0)) / F.lit(spread) * F.lit(top)).cast("long")
    tie = F.xxhash64("doc_id", "row").bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    keyed = narrow.withColumn("length", length)
    return materialise(keyed.select(
        "row", "doc_id", "size", "text_crc32", F.lit(0).alias("node"),
        *((F.shiftleft(F.col(kind), TIE_BITS) + tie).alias(kind) for kind in DIMENSIONS)), "keys")


def _of_dimension(dimension: Column) -> Column:
    key = F.col(DIMENSIONS[0])
    for number, kind in enumerate(DIMENSIONS[1:], start=1):
        key = F.when(dimension == number, F.col(kind)).otherwise(key)
    return key


def _widest(points: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, parts, dim, target): what to cut, along which dimension, and the bytes below."""
    ranges = [F.shiftright(F.max(k) - F.min(k), TIE_BITS) for k in DIMENSIONS]
    width = F.greatest(*(F.col(f"w{i}") for i in range(len(DIMENSIONS))))
    dimension = F.lit(len(DIMENSIONS) - 1)
    for number in reversed(range(len(DIMENSIONS) - 1)):
        dimension = F.when(F.col(f"w{number}") == width, number).otherwise(dimension)
    sums = points.groupBy("node").agg(F.sum("size").alias("bytes"),
                                      *(r.alias(f"w{i}") for i, r in enumerate(ranges)))
    return sums.join(F.broadcast(parts), "node").select(
        "node", "parts", dimension.alias("dim"),
        (F.col("bytes") * F.floor(F.col("parts") / 2) / F.col("parts")).alias("target"))


def _cuts(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, parts, dim, cut): keys below ``cut`` go left."""
    search = wanted.withColumns({"lo": F.lit(0).cast("long"), "below": F.lit(0).cast("long")})
    for step in range(-(-KEY_BITS // BIN_BITS)):
        shift = max(0, KEY_BITS - BIN_BITS * (step + 1))
        near = points.join(F.broadcast(search), "node").withColumn("key", _of_dimension(F.col("dim")))
        inside = near.withColumn("bin", F.shiftright(F.col("key") - F.col("lo"), shift)).where(
            (F.col("bin") >= 0) & (F.col("bin") < (1 << BIN_BITS)))
        histogram = inside.groupBy("node", "parts", "dim", "target", "lo", "below", "bin").agg(
            F.sum("size").alias("weight"))
        order = Window.partitionBy("node").orderBy("bin")
        running = histogram.withColumn("through", F.col("below") + F.sum("weight").over(
            order.rowsBetween(Window.unboundedPreceding, 0)))
        # the first bin that reaches the target; the last one always does
        hit = running.where(F.col("through") >= F.col("target")).groupBy(
            "node", "parts", "dim", "target").agg(
            F.min(F.struct("bin", "through", "weight", "lo")).alias("hit"))
        start = F.col("hit.lo") + F.shiftleft(F.col("hit.bin"), shift)
        search = materialise(hit.select(
            "node", "parts", "dim", "target", start.alias("lo"),
            (F.col("hit.through") - F.col("hit.weight")).alias("below"),
            F.col("hit.through").alias("through")), "cuts")
        if shift:
            search = search.drop("through")
    nearer = (F.col("target") - F.col("below")) < (F.col("through") - F.col("target"))
    return search.select("node", "parts", "dim",
                         F.when(nearer, F.col("lo")).otherwise(F.col("lo") + 1).alias("cut"))


def kd_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
              lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document with its shard, 0 to ``shards - 1``, and its place in it.

    Sizes of the shards differ by about the size of a document at most times the
    depth of the tree. Null texts have size 8; null languages and sources are
    values of their own, and absent columns count as null. Rows with null or
    repeated ids are placed like others. An empty table gives no rows.
    Columns: doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    spark = docs.sparkSession
    points = metadata(docs, id_col, text_col, lang_col, source_col)
    open_nodes = [(0, shards)]
    first_shard = {0: 0}
    done: dict[int, int] = {}
    while open_nodes:
        for node, parts in open_nodes:
            if parts == 1:
                done[node] = first_shard[node]
        open_nodes = [(n, p) for n, p in open_nodes if p > 1]
        if not open_nodes:
            break
        # at most ``shards`` rows
        wanted = spark.createDataFrame(open_nodes, "node int, parts int")
        cuts = _cuts(points, materialise(_widest(points, wanted), "nodes"))
        right = (F.col("cut").isNotNull()
                 & (_of_dimension(F.col("dim")) >= F.col("cut")))
        number = F.when(F.col("cut").isNull(), F.col("node")).otherwise(
            F.col("node") * 2 + 1 + right.cast("int")).alias("node")
        points = materialise(points.join(F.broadcast(cuts), "node", "left").select(
            "row", "doc_id", "size", "text_crc32", number, *DIMENSIONS), "level")
        halves = []
        for node, parts in open_nodes:
            left = parts // 2
            first_shard[2 * node + 1] = first_shard[node]
            first_shard[2 * node + 2] = first_shard[node] + left
            halves += [(2 * node + 1, left), (2 * node + 2, parts - left)]
        open_nodes = halves
    leaves = spark.createDataFrame(sorted(done.items()), "node int, shard int")
    place = Window.partitionBy("shard").orderBy(F.col("doc_id").asc_nulls_last(), "row")
    return points.join(F.broadcast(leaves), "node").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.row_number().over(place) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
