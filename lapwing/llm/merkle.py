"""Merkle manifest of a table: a leaf per row, a tree per language, a root over the trees, a witness for every leaf.

Nodes are appended in order to open runs of eight, one run per level. A subtree that joins a run takes the siblings to
its left as a partial witness; each sibling that completes later extends it; the run that fills up is the next node of
the level above. A subtree's piece of witness is shared by all leaves below it.

Tasks append aligned blocks of 4,096 leaves, whole subtrees of four levels. The roots of the blocks of a language are
further appends, dealt to tasks in the same way, until one node remains; so are the subroots of the languages. A
manifest keeps its leaves and block roots: rows that come later reopen the last block of a language only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lapwing.session import stage

ARITY = 8
LEVELS = 4
BLOCK = ARITY**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text: bytes | bytearray) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


@dataclass(eq=False)
class Subtree:
    """A complete subtree of an open run: its root, the siblings known so far, and where it went."""

    digest: bytes
    before: bytes = b""
    after: bytearray = field(default_factory=bytearray)
    above: Subtree | None = None

    def witness(self) -> Iterator[tuple[bytes, bytes]]:
        """(siblings to the left, siblings to the right) of this node and of each node above it, from below."""
        at = self
        while at.above is not None:
            yield at.before, bytes(at.after)
            at = at.above


class Appender:
    """Open runs of one tree, by level. `levels` is the height to reach, None for as many as leave a single node."""

    def __init__(self, levels: int | None):
        self.levels, self.runs = levels, []

    def append(self, node: Subtree, level: int = 0) -> None:
        if level == len(self.runs):
            self.runs.append([])
        run = self.runs[level]
        node.before = b"".join(x.digest for x in run)
        for sibling in run:
            sibling.after += node.digest
        run.append(node)
        if len(run) == ARITY and level != self.levels:
            self.complete(level)

    def complete(self, level: int) -> None:
        run = self.runs[level]
        parent = Subtree(sha(b"".join(x.digest for x in run)))
        for x in run:
            x.above = parent
        self.runs[level] = []
        self.append(parent, level + 1)

    def close(self) -> Subtree:
        """The root. Runs that are not full are completed from below."""
        level = 0
        while level != self.levels:
            higher = any(self.runs[level + 1 :])
            if self.levels is None and not higher and len(self.runs[level]) == 1:
                break
            if self.runs[level]:
                self.complete(level)
            level += 1
        return self.runs[level][0]


def folded(digest: bytes, witness: list[tuple[bytes, bytes]]) -> bytes:
    for before, after in witness:
        digest = sha(before + digest + after)
    return digest


def leaf(columns: dict[str, Column]) -> Column:
    """sha256 over the columns, each as its UTF-8 byte count, a colon and its value, or `-` if null."""
    values = [c.cast("string") for c in columns.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, tampered): tampering lower-cases A-Z of the text where 3 divides the crc32 of the id."""
    own = {c: F.col(c) for c in COLUMNS}
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.when(chosen, lower).otherwise(F.col("text"))
    return docs.select("lang", F.col("doc_id").cast("bigint").alias("doc_id"), leaf(own).alias("leaf"), leaf(own | {"text": text}).alias("tampered"))


def numbered(rows: DataFrame, group: str, order: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """Add `idx`, the place of a row in its group (after the `size` rows that `sizes` says the group has), and `total`.

    Rows are dealt by range and written with their place in their part; one small row for each part of a group gives
    the offsets, so that no task needs a whole group.
    """
    placed = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = stage(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "placed")
    parts = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = W.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("_before", before).withColumn("total", F.sum("_n").over(whole))
    if sizes is not None:
        old = sizes.select(F.col(group).alias("_g"), F.col("size").alias("_old"))
        parts = parts.join(old, F.col(group).eqNullSafe(F.col("_g")), "left").fillna(0, ["_old"])
        parts = parts.withColumn("_before", F.col("_before") + F.col("_old")).withColumn("total", F.col("total") + F.col("_old"))
    parts = parts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (F.col("_before") - F.col("_first")).alias("_shift"), "total")
    joined = placed.join(parts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("idx"), "total")


def in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / BLOCK).cast("bigint"))


def appended(rows: dict) -> tuple[list[int], list[Subtree], Subtree]:
    """Append the nodes of one block: their order, their subtrees and the block's root."""
    order = sorted(range(len(rows["idx"])), key=rows["idx"].__getitem__)
    nodes = [Subtree(rows["node"][i].encode()) for i in order]
    tree = Appender(None if rows["total"][0] <= BLOCK else LEVELS)
    for node in nodes:
        tree.append(node)
    return order, nodes, tree.close()


def block_roots(nodes: DataFrame) -> DataFrame:
    """Roots of the blocks of nodes (grp, idx, node, total): (grp, idx, node, total), one level of blocks further up."""

    def root(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        _, _, top = appended(rows)
        out = {"grp": rows["grp"][:1], "idx": rows["block"][:1], "node": [top.digest.decode()], "total": [-(-rows["total"][0] // BLOCK)]}
        return pa.table(out, schema=pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("node", pa.string()), ("total", pa.int64())]))

    blocks = in_blocks(nodes.select("grp", "idx", "node", "total"))
    return blocks.groupBy("grp", "block").applyInArrow(root, "grp string, idx bigint, node string, total bigint")


#: Pieces of a witness, from below; `top` is where it leads.
PIECES = "array<struct<before:string,after:string>>"
PIECES_ARROW = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def climbed(nodes: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Witness and top of every node (grp, idx, node, total), as (grp, idx, witness, top), all blocks of a group joined.

    `roots` are the roots of the blocks, if they are known. Ends when no group has more than one block.
    """
    paths = block_paths(roots if roots is not None else stage(block_roots(nodes), "blocks"))

    def complete(table: pa.Table, path: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        order, subtrees, _ = appended(rows)
        rest, top = path.column("witness")[0].as_py(), path.column("top")[0].as_py()
        pieces = [[{"before": b.decode(), "after": a.decode()} for b, a in x.witness()] + rest for x in subtrees]
        arrays = [pa.array(rows["grp"], pa.string()), pa.array([rows["idx"][i] for i in order], pa.int64()), pa.array(pieces, PIECES_ARROW), pa.array([top] * len(order), pa.string())]
        return pa.Table.from_arrays(arrays, names=["grp", "idx", "witness", "top"])

    blocks = in_blocks(nodes.select("grp", "idx", "node", "total")).groupBy("grp", "block")
    return blocks.cogroup(paths.groupBy("grp", "block")).applyInArrow(complete, f"grp string, idx bigint, witness {PIECES}, top string")


def block_paths(roots: DataFrame) -> DataFrame:
    """What remains of the witness above each block: (grp, block, witness, top)."""
    if roots.where("total > 1").isEmpty():
        found = roots.select("grp", "idx", F.array().cast(PIECES).alias("witness"), F.col("node").alias("top"))
    else:
        found = climbed(roots)
    return stage(found.withColumnRenamed("idx", "block"), "paths")


@dataclass
class Manifest:
    """`leaves` (grp, doc_id, node, tampered, idx, total) and `roots` of their blocks, both written to the shared folder.

    grp is the language, null for rows without one.
    """

    leaves: DataFrame
    roots: DataFrame


def append(docs: DataFrame, manifest: Manifest | None = None) -> Manifest:
    """A manifest with the rows of `docs` after those it has, which must come first in the order of ids.

    Only block roots that change are made anew: the last block of a language that grows, and the new ones.
    """
    new = stage(leaves(docs), "leaves").withColumnsRenamed({"lang": "grp", "leaf": "node"})
    order = ["doc_id", "node", "tampered"]
    if manifest is None:
        rows = stage(numbered(new, "grp", order), "numbered")
        return Manifest(rows, stage(block_roots(rows), "blocks"))
    old = manifest.leaves
    sizes = stage(old.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.max("doc_id").alias("last")), "sizes")
    early = new.alias("n").join(sizes.alias("s"), F.expr("n.grp <=> s.grp and (n.doc_id < s.last or (n.doc_id is null and s.last is not null))"))
    if not early.isEmpty():
        raise ValueError("rows to append must have larger ids than those of the manifest, language by language")
    added = numbered(new, "grp", order, sizes)
    totals = added.groupBy("grp").agg(F.max("total").alias("_total")).withColumnRenamed("grp", "_g")
    kept = old.join(totals, F.col("grp").eqNullSafe(F.col("_g")), "left").withColumn("total", F.coalesce("_total", "total")).select(old.columns)
    rows = stage(kept.unionByName(added), "numbered")
    grown = sizes.join(totals, F.col("grp").eqNullSafe(F.col("_g"))).select("_g", F.floor(F.col("size") / BLOCK).alias("_open"), (F.ceil(F.col("_total") / BLOCK)).alias("_blocks"))
    closed = manifest.roots.join(grown, F.col("grp").eqNullSafe(F.col("_g")), "left").where("_open is null or idx < _open").withColumn("total", F.coalesce("_blocks", "total")).select(manifest.roots.columns)
    reopened = in_blocks(rows).join(sizes.select(F.col("grp").alias("_s"), F.floor(F.col("size") / BLOCK).alias("_open")), F.col("grp").eqNullSafe(F.col("_s")), "left")
    changed = reopened.join(totals, F.col("grp").eqNullSafe(F.col("_g")), "left_semi").where("_open is null or block >= _open").select(rows.columns)
    return Manifest(rows, stage(closed.unionByName(block_roots(changed)), "blocks"))


def subtrees(manifest: Manifest) -> DataFrame:
    """What remains of the witness above each block, up to the root over all languages: (grp, block, witness, subroot, root)."""
    paths = block_paths(manifest.roots)
    subroots = paths.where("block = 0").select(F.col("grp").alias("lang"), F.lit("").alias("grp"), F.col("top").alias("node"))
    tops = numbered(subroots.select("lang", "grp", "node"), "grp", ["lang"])
    tops = stage(tops, "subroots")
    above = climbed(tops.select("grp", "idx", "node", "total"))
    above = tops.join(above.withColumnRenamed("witness", "rest"), ["grp", "idx"]).select(F.col("lang").alias("_lang"), F.col("node").alias("subroot"), "rest", F.col("top").alias("root"))
    joined = paths.join(above, F.col("grp").eqNullSafe(F.col("_lang")))
    return joined.select("grp", "block", F.concat("witness", "rest").alias("witness"), "subroot", "root")


def verify(manifest: Manifest) -> DataFrame:
    """Every leaf with its proof, checked from the tampered leaf: the columns of the contract.

    Columns of any other name are not read. Null columns count as `-`, so an empty text differs from none. Leaves without
    an id come first in their language; equal ids follow in the order of their leaves; repeated rows are leaves of
    their own. Rows without a language are a language that comes first. An empty table has no rows.
    """

    def check(table: pa.Table, path: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        order, nodes, _ = appended(rows)
        rest = [(p["before"].encode(), p["after"].encode()) for p in path.column("witness")[0].as_py()]
        subroot, root = (path.column(c)[0].as_py() for c in ("subroot", "root"))
        out: dict[str, list] = {c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
        for i, node in zip(order, nodes):
            witness = [*node.witness(), *rest]
            again = folded(rows["tampered"][i].encode(), witness).decode()
            proof = sha(b"".join(side for piece in witness for side in piece)).decode()
            for c, v in zip(out, (rows["doc_id"][i], rows["node"][i], subroot, root, proof, again, again == root)):
                out[c].append(v)
        fields = [("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())]
        return pa.table(out, schema=pa.schema(fields))

    blocks = in_blocks(manifest.leaves).groupBy("grp", "block")
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.cogroup(subtrees(manifest).groupBy("grp", "block")).applyInArrow(check, schema)


def digest(docs: DataFrame) -> DataFrame:
    return verify(append(docs.select(*COLUMNS)))


#: Levels by a recursive query; crc32 bit by bit over the decimal id (-1 stands for a shift).
DIGEST_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, lang, text, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) ELSE xor(s // 2, (s % 2) * 3988292384) END), 4294967295) % 3 = 0 AS chosen,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents),
leaf AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN chosen THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS bad FROM t),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, h, bad) - 1 AS i FROM leaf),
level(depth, lang, i, h, n, kids) AS (
  SELECT 0, lang, i, h, count(*) OVER (PARTITION BY lang), CAST(NULL AS VARCHAR[]) FROM placed
  UNION ALL
  SELECT depth + 1, lang, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8, list(h ORDER BY i) FROM level WHERE n > 1 GROUP BY depth, lang, i // 8),
subroot AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM level WHERE n = 1),
upper(depth, i, h, n, kids) AS (
  SELECT 0, i, h, count(*) OVER (), CAST(NULL AS VARCHAR[]) FROM subroot
  UNION ALL
  SELECT depth + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8, list(h ORDER BY i) FROM upper WHERE n > 1 GROUP BY depth, i // 8),
runs AS (
  SELECT lang, depth, i, kids FROM level WHERE depth > 0
  UNION ALL SELECT s.lang, 1000 + u.depth, u.i, u.kids FROM upper u, subroot s WHERE u.depth > 0 AND u.i = s.i // CAST(pow(8, u.depth) AS BIGINT)),
steps AS (
  SELECT p.doc_id, p.lang, p.i AS leaf_i, row_number() OVER (PARTITION BY p.lang, p.i ORDER BY r.depth) AS step, r.kids,
    CASE WHEN r.depth < 1000 THEN (p.i // CAST(pow(8, r.depth - 1) AS BIGINT)) % 8 ELSE (s.i // CAST(pow(8, r.depth - 1001) AS BIGINT)) % 8 END AS pos
  FROM placed p JOIN subroot s ON s.lang IS NOT DISTINCT FROM p.lang
  JOIN runs r ON r.lang IS NOT DISTINCT FROM p.lang AND (r.depth >= 1000 OR r.i = p.i // CAST(pow(8, r.depth) AS BIGINT))),
proof AS (SELECT lang, leaf_i, string_agg(array_to_string(kids[1:pos], '') || array_to_string(kids[pos + 2:8], ''), '' ORDER BY step) AS siblings, max(step) AS n FROM steps GROUP BY lang, leaf_i),
fold(lang, leaf_i, step, h) AS (
  SELECT lang, i, 0, bad FROM placed
  UNION ALL
  SELECT f.lang, f.leaf_i, f.step + 1, sha256(array_to_string(kids[1:pos], '') || f.h || array_to_string(kids[pos + 2:8], ''))
  FROM fold f JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.leaf_i = f.leaf_i AND s.step = f.step + 1),
top AS (SELECT h FROM upper WHERE n = 1)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, top.h AS root, sha256(coalesce(w.siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = top.h AS verified
FROM placed p JOIN subroot s ON s.lang IS NOT DISTINCT FROM p.lang
LEFT JOIN proof w ON w.lang IS NOT DISTINCT FROM p.lang AND w.leaf_i = p.i
JOIN fold f ON f.lang IS NOT DISTINCT FROM p.lang AND f.leaf_i = p.i AND f.step = coalesce(w.n, 0), top"""
