"""Merkle manifest of a dataset: a leaf per row, a tree per group, a tree of the groups.

Nodes of a level are numbered. Every node meets the other nodes of its run by
equijoins of the level with itself on computed sibling indices: the lowest bit
flipped where a run has two nodes, the other slots of the run otherwise. Each node
then knows what stands left and right of it; the rows in slot zero emit the
parents. The levels, each shorter by the arity, are joined down again to give
every row its proof, which :func:`fold` runs over any presented leaf.

Numbers come from one range-partitioned sort: no window spans a group, so a group
may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import sql_crc32
from textquarry.session import materialise

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ABSENT = "-"
_STEP = "array<struct<left:string,right:string>>"
#: monotonically_increasing_id counts within a partition in this many low bits.
_ROW_BITS = 33


def hashed(*parts: Column | str) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(values: list[Column]) -> Column:
    """The digest of a row: per value its length in bytes, a colon and the value; null is a dash."""
    texts = [value.cast("string") for value in values]
    return hashed(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit(ABSENT))
                    for t in texts])


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def by_group(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (part, group, ...) with the columns of ``known`` (group, ...).

    A group may hold any share of the rows, so they meet over parts and groups.
    """
    spans = rows.select("part", "group").distinct().join(known, "group")
    return rows.join(spans, ["part", "group"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows (group, ...) with their ``part`` of the sort, ``idx`` from 0 in their group and
    ``n``, the size of the group, stored."""
    placed = materialise(
        rows.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
        .withColumn("place", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("part", F.shiftright("place", _ROW_BITS))
    # one row per partition of the sort
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(placed.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")))
    position = F.col("start") + F.col("place").bitwiseAND((1 << _ROW_BITS) - 1)
    groups = placed.groupBy("group").agg(F.min("place").alias("place"), F.count("*").alias("n")).withColumn(
        "part", F.shiftright("place", _ROW_BITS)).join(starts, "part").select("group", "n", position.alias("head"))
    return materialise(
        by_group(placed, groups).join(starts, "part").withColumn("idx", position - F.col("head"))
        .drop("place", "start", "head"), "numbered")


def _with_siblings(level: DataFrame, arity: int) -> DataFrame:
    """Every node with the digests left and right of it in its run."""
    slot = F.pmod(F.col("idx"), F.lit(arity))
    found = level
    for step in range(1, arity):
        index = F.col("idx").bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else (
            F.col("idx") - slot + F.pmod(slot + step, F.lit(arity)))
        beside = level.select("group", F.col("idx").alias(f"at_{step}"), F.col("hash").alias(f"hash_{step}"))
        found = found.withColumn(f"at_{step}", index).join(beside, ["group", f"at_{step}"], "left")
    others = F.filter(F.array_sort(F.array(*[
        F.struct(F.col(f"at_{step}").alias("at"), F.col(f"hash_{step}").alias("hash"))
        for step in range(1, arity)])), lambda o: o["hash"].isNotNull())

    def side(keep) -> Column:
        return F.array_join(F.transform(F.filter(others, keep), lambda o: o["hash"]), "")

    return found.select("group", "idx", "n", "hash", side(lambda o: o["at"] < F.col("idx")).alias("left"),
                        side(lambda o: o["at"] > F.col("idx")).alias("right"))


def trees(leaves: DataFrame, arity: int = ARITY) -> tuple[DataFrame, DataFrame]:
    """The tree over the leaves (group, idx, n, hash) of each group.

    Returns (group, subroot), and (group, idx, path) with the steps of each leaf's
    proof; a group of one leaf is its own root and has no steps, hence no row there.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    level, levels = leaves.select("group", "idx", "n", "hash"), []
    roots = level.where("n = 1")
    while most > 1:
        joined = materialise(_with_siblings(level.where("n > 1"), arity), "level")
        levels.append(joined)
        level = joined.where(F.pmod("idx", F.lit(arity)) == 0).select(
            "group", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            hashed("left", "hash", "right").alias("hash"))
        roots = roots.union(level.where("n = 1"))
        most = -(-most // arity)
    step = F.array(F.struct("left", "right")).cast(_STEP)
    paths = None
    for joined in reversed(levels):
        steps = joined.select("group", "idx", step.alias("path"))
        if paths is not None:
            above = paths.select("group", F.col("idx").alias("up"), F.col("path").alias("more"))
            steps = steps.withColumn("up", F.expr(f"idx div {arity}")).join(above, ["group", "up"], "left") \
                .select("group", "idx", F.concat("path", F.coalesce("more", F.array().cast(_STEP))).alias("path"))
        paths = steps
    if paths is None:
        paths = leaves.select("group", "idx", F.array().cast(_STEP).alias("path")).where("false")
    return materialise(roots.select("group", F.col("hash").alias("subroot")), "subroots"), paths


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "source",
             id_col: str = "doc_id", arity: int = ARITY, presented: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` with its place in the dataset's Merkle tree.

    Leaves of a group ascend by id (null first; rows that repeat an id by their
    digest, and rows alike in all fields are interchangeable). While a level has
    several nodes, each run of ``arity`` of them, the last one shorter, becomes
    their digest. The roots of the groups (null first, then bytewise) are the leaves
    of the last tree. Null and empty fields differ; an empty table gives no rows.
    Columns beside ``fields`` are ignored.

    Columns: doc_id, leaf, presented, subroot, root, proof (array of left, right from
    the leaf up). ``presented`` is a further digest per row, computed from the columns
    of ``docs``, to hold against the proof; by default the leaf.
    """
    leaf = leaf_digest([F.col(f"`{name}`") for name in fields])
    group = F.col(f"`{group_col}`").cast("string")
    rows = materialise(docs.select(
        # null before any text, and never lost in a join
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("group"),
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), leaf.alias("hash"),
        (leaf if presented is None else presented).alias("presented")), "leaves")
    leaves = numbered(rows, ["doc_id", "hash"])
    subroots, paths = trees(leaves, arity)
    listed = numbered(subroots.select(F.lit("").alias("group"), F.col("group").alias("member"),
                                      F.col("subroot").alias("hash")), ["member"])
    root, upper = trees(listed, arity)
    whole = root.select(F.col("subroot").alias("root")).scalar()
    tops = materialise(listed.join(upper, ["group", "idx"], "left").select(
        F.col("member").alias("group"), F.col("hash").alias("subroot"),
        F.coalesce("path", F.array().cast(_STEP)).alias("upper"), whole.alias("root")), "tops")
    found = by_group(leaves.join(paths, ["group", "idx"], "left"), tops)
    return found.select(
        "doc_id", F.col("hash").alias("leaf"), "presented", "subroot", "root",
        F.concat(F.coalesce("path", F.array().cast(_STEP)), "upper").alias("proof"))


def proof_digest(proof: Column) -> Column:
    """All siblings of a proof, level by level and left to right, as one digest."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def verified(rows: DataFrame) -> DataFrame:
    """Rows of :func:`manifest` with what their presented digest folds to, and whether that is the root."""
    return rows.withColumn("folded_root", fold(F.col("presented"), F.col("proof"))).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def tampered(fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf of a row whose text lost its line ends, for every second id by CRC-32."""
    changed = F.when(F.crc32(F.col("doc_id").cast("long").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    return leaf_digest([F.coalesce(changed, F.col("text")) if name == "text" else F.col(name) for name in fields])


def _sql_tree(name: str, source: str, group: str) -> str:
    """Recursive counterpart of :func:`trees`: (grp, lvl, idx, h, n) of every node."""
    return f"""{name} AS (SELECT {group} AS grp, 0 AS lvl, idx, h, n FROM {source} UNION ALL
  SELECT grp, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3
  FROM {name} WHERE n > 1 GROUP BY grp, lvl, idx // 3, n)"""


def _sql_steps(source: str, tree: str, group: str, level: str) -> str:
    at = "(p.idx // (3 ** u.lvl)::BIGINT)"
    return f"""SELECT p.leaf_grp, p.leaf_idx, {level} AS lvl,
    coalesce(string_agg(CASE WHEN u.idx < {at} THEN u.h END, '' ORDER BY u.idx), '') AS l,
    coalesce(string_agg(CASE WHEN u.idx > {at} THEN u.h END, '' ORDER BY u.idx), '') AS r
  FROM {source} p JOIN {tree} u ON u.grp = {group} AND u.n > 1 AND u.idx // 3 = {at} // 3 GROUP BY ALL"""


def _sql_leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


# DuckDB counterpart of the op11 query over ``documents``.
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS grp, {_sql_leaf("text")} AS h,
    CASE WHEN {sql_crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")}
         ELSE {_sql_leaf("text")} END AS presented FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx,
  count(*) OVER (PARTITION BY grp) AS n FROM d),
{_sql_tree("low", "placed", "grp")},
subs AS (SELECT grp AS member, h, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n
  FROM low WHERE n = 1),
{_sql_tree("high", "subs", "''")},
leaves AS (SELECT grp AS leaf_grp, idx AS leaf_idx, idx FROM placed),
members AS (SELECT p.grp AS leaf_grp, p.idx AS leaf_idx, s.idx FROM placed p JOIN subs s ON s.member = p.grp),
steps AS (SELECT leaf_grp, leaf_idx, l, r, row_number() OVER (PARTITION BY leaf_grp, leaf_idx ORDER BY lvl) AS k FROM (
  {_sql_steps("leaves", "low", "p.leaf_grp", "u.lvl")} UNION ALL
  {_sql_steps("members", "high", "''", "u.lvl + 1000")})),
proofs AS (SELECT leaf_grp, leaf_idx, sha256(string_agg(l || r, '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY ALL),
folds AS (SELECT grp, idx, 1 AS k, presented AS h FROM placed UNION ALL
  SELECT f.grp, f.idx, f.k + 1, sha256(s.l || f.h || s.r) FROM folds f
  JOIN steps s ON s.leaf_grp = f.grp AND s.leaf_idx = f.idx AND s.k = f.k),
folded AS (SELECT grp, idx, arg_max(h, k) AS folded_root FROM folds GROUP BY ALL)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, t.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256,
  f.folded_root, f.folded_root = t.h AS verified
FROM placed p JOIN subs s ON s.member = p.grp JOIN high t ON t.n = 1
JOIN folded f ON f.grp = p.grp AND f.idx = p.idx
LEFT JOIN proofs q ON q.leaf_grp = p.grp AND q.leaf_idx = p.idx"""
