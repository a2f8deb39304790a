"""Merkle manifest of a table: a tree of SHA-256 digests over documents, per language, with a proof for every row.

Leaves. A leaf is the digest of a row's doc_id, source, lang, n_chars and text, each with its length in bytes. Built-in
functions; each text is read once.

Ranks. The rank of a leaf among the ids of its language comes from histograms of digits, not from a sort of the table: rows
of a cell (at first a language) are counted by the next eight bits of the id, the counts of smaller siblings are a child's
offset, and only children of over CELL rows are counted again by the next digit. Equal ids go on with digits of the leaf
and of the row's number, so no cell stays large, however often an id occurs. Within a cell of at most CELL rows a window
gives the rest of the rank.

Trie. The base-fanout digits of a rank are a leaf's key; nodes whose keys share all but the last BLOCK_LEVELS digits make a
block, which one task folds to one node. That node's key is the shared prefix, so blocks of blocks follow until each
language has one node: log(n) / BLOCK_LEVELS shuffles, each a thousandth of the last. Languages' nodes make a last trie.

Proofs go down the same blocks: a node's siblings are those within its block, then its block's own.

Defined cases. Null fields are ``-``. Null ids rank before all others, equal ids by their leaf; equal rows are
interchangeable. A null lang is a language of its own, the first. Rows without an id, or without n_chars, are never
tampered with. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm.common import BROADCAST_ROWS, lookup, written

FANOUT = 2
#: Levels that one task folds at once: a block has at most FANOUT ** BLOCK_LEVELS nodes.
BLOCK_LEVELS = 10
#: A cell of at most so many rows is ranked by one window.
CELL = 4096
DIGIT_BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose id has a crc32 divisible by this are tampered with by the check of the proofs.
TAMPER = 7

Level = tuple[str, str]  # what stands left and right of a node in its run


def digest(*inputs: str) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


# ---------------------------------------------------------------- leaves


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(**fields: Column) -> Column:
    """Digest of the five fields of a row."""
    return F.sha2(F.concat(*(_field(fields[c]) for c in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """lang, doc_id, leaf, tampered (the leaf with one character more in n_chars, where it is tampered with)."""
    own = {c: F.col(c) for c in FIELDS}
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0) & F.col("n_chars").isNotNull()
    tampered = F.when(hit, leaf_of(**own | {"n_chars": F.col("n_chars") + 1}))
    return docs.select("lang", "doc_id", leaf_of(**own).alias("leaf"), tampered.alias("tampered"))


# ---------------------------------------------------------------- ranks


def _digits(low: int, high: int) -> list[tuple[int, int]]:
    """(shift, mask) of the digits in which numbers of this range can differ, the highest first."""
    left, found = ((low ^ high) & (1 << 64) - 1).bit_length(), []
    while left:
        width = min(DIGIT_BITS, left)
        left -= width
        found.append((left, (1 << width) - 1))
    return found


def radix_ranks(rows: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """rows (with _g and long keys without nulls) with _rank, from 0 in the order of the keys within _g, and _n, the rows of _g.

    rows must be a written table, as it is read several times. Rows that are equal in all keys get any order.
    """
    ends = rows.agg(*(f(k) for k in keys for f in (F.min, F.max))).first()
    rows = lookup(rows, rows.groupBy("_g").agg(F.count("*").alias("_n")), ["_g"], F.col(keys[-1]))
    left, done = rows.withColumns({"_at": F.lit(0).cast("long"), "_m": F.col("_n")}), []
    digits = [(k, *d) for k, low, high in zip(keys, ends[::2], ends[1::2], strict=True) if low is not None for d in _digits(low, high)]
    for key, shift, mask in digits:
        open_ = left.where(F.col("_m") > cell)
        if open_.isEmpty():
            break
        # the sign bit is flipped, so unsigned digits are in the order of signed numbers
        digit = F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(-(2**63))), shift).bitwiseAND(F.lit(mask))
        open_ = open_.withColumn("_digit", digit)
        counts = open_.groupBy("_g", "_at", "_digit").agg(F.count("*").alias("_m"))
        before = Window.partitionBy("_g", "_at").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        children = written(counts.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))), "merkle-cells")
        open_ = lookup(open_.drop("_m"), children, ["_g", "_at", "_digit"], F.col(keys[-1]))
        done.append(left.where(F.col("_m") <= cell))
        left = written(open_.withColumn("_at", F.col("_at") + F.col("_before")).drop("_before", "_digit"), "merkle-open")
    for part in done:
        left = left.unionByName(part)
    inner = F.row_number().over(Window.partitionBy("_g", "_at").orderBy(*keys))
    return left.withColumn("_rank", F.col("_at") + inner - 1).drop("_at", "_m")


# ---------------------------------------------------------------- blocks


def levels_of(n: int, fanout: int, most: int) -> int:
    """Levels from n nodes to one, ``most`` at most."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // fanout), levels + 1
    return levels


def fold_up(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """Nodes of each level: runs of fanout consecutive ones (the last run may be shorter) become their digest."""
    tiers = [nodes]
    for _ in range(levels):
        last = tiers[-1]
        tiers.append([digest(*last[k : k + fanout]) for k in range(0, len(last), fanout)])
    return tiers


def siblings(tiers: list[list[str]], at: int, fanout: int) -> list[Level]:
    """Left and right of node ``at`` in its run, level by level."""
    found = []
    for tier in tiers[:-1]:
        start = at - at % fanout
        found.append(("".join(tier[start:at]), "".join(tier[at + 1 : start + fanout])))
        at //= fanout
    return found


def folded(node: str, path: list[Level]) -> str:
    """The root that a node and its siblings give."""
    for left, right in path:
        node = digest(left, node, right)
    return node


BLOCK = "_g string, _block long, _n long, nodes array<string>, _node string"
PATH = "array<struct<left:string,right:string>>"


def _blocks(nodes: DataFrame, fanout: int, levels: int, payload: list[str]) -> DataFrame:
    """nodes (_g, _rank, _n, node, payload) in blocks with the node that each block folds to; a row a block, written."""
    size = fanout**levels
    row = F.struct("_rank", "node", *payload)
    held = nodes.groupBy("_g", F.floor(F.col("_rank") / size).cast("long").alias("_block")).agg(F.first("_n").alias("_n"), F.sort_array(F.collect_list(row)).alias("_rows"))
    held = held.select("_g", "_block", "_n", F.col("_rows.node").alias("nodes"), *(F.col(f"_rows.{c}").alias(c) for c in payload))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [fold_up(x.as_py(), levels_of(n.as_py(), fanout, levels), fanout)[-1][0] for x, n in zip(batch.column("nodes"), batch.column("_n"), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.string())], names=[*batch.schema.names, "_node"])

    return written(held.mapInArrow(run, StructType([*held.schema.fields, StructField("_node", StringType())])), "merkle-blocks")


def _parents(blocks: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The nodes of the next layer: of each block one, at the rank that the block's number is."""
    return blocks.select("_g", F.col("_block").alias("_rank"), F.ceil(F.col("_n") / fanout**levels).cast("long").alias("_n"), F.col("_node").alias("node"))


def _layers(nodes: DataFrame, fanout: int, levels: int, payload: list[str]) -> list[DataFrame]:
    """Blocks of each layer, from the leaves to one node a group."""
    most = nodes.agg(F.max("_n")).first()[0] or 0
    found = [_blocks(nodes, fanout, levels, payload)]
    while (most := -(-most // fanout**levels)) > 1:
        found.append(_blocks(_parents(found[-1], fanout, levels), fanout, levels, []))
    return found


def _paths(blocks: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """_g, _block, path of the blocks below; above has the paths of these blocks."""
    held = blocks.join(above, ["_g", "_block"]).select("_g", "_block", "_n", "nodes", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                g, block, n, nodes, path = (c[k].as_py() for c in batch.columns)
                tiers = fold_up(nodes, levels_of(n, fanout, levels), fanout)
                own = [[{"left": a, "right": b} for a, b in siblings(tiers, at, fanout)] + path for at in range(len(nodes))]
                ranks = [block * fanout**levels + at for at in range(len(nodes))]
                kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(nodes), pa.string()), pa.array(ranks, pa.int64()), pa.array(own, kind)], names=["_g", "_block", "path"])

    return written(held.mapInArrow(run, f"_g string, _block long, path {PATH}"), "merkle-paths")


class Manifest:
    """The trie of a table, in written tables: layers of blocks per language, the languages' subroots, the root."""

    def __init__(self, docs: DataFrame, fanout: int = FANOUT, levels: int = BLOCK_LEVELS, cell: int = CELL):
        if fanout < 2 or levels < 1:
            raise ValueError("fanout is at least 2, levels at least 1")
        self.fanout, self.levels = fanout, levels
        own = leaves(docs.select(*FIELDS))
        keyed = own.select(
            F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("_g"), "doc_id", F.col("leaf").alias("node"), "tampered",
            F.col("doc_id").isNotNull().cast("long").alias("_k0"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("_k1"),
            F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long").alias("_k2"), F.monotonically_increasing_id().alias("_k3"),
        )
        keys = ["_k0", "_k1", "_k2", "_k3"]
        ranked = radix_ranks(written(keyed, "merkle-leaves"), keys, cell).drop(*keys)
        self.layers = _layers(ranked, fanout, levels, ["doc_id", "tampered"])
        # a row a language: the numbers of the languages come from one window over them; "-" (null) sorts before "="
        tops = self.layers[-1].select("_g", F.col("_node").alias("node"))
        place = Window.orderBy("_g")
        numbered = tops.select(F.lit("").alias("_g"), (F.row_number().over(place) - 1).cast("long").alias("_rank"), F.count("*").over(Window.partitionBy()).alias("_n"), "node", F.col("_g").alias("lang_key"))
        self.subroots = written(numbered, "merkle-subroots")
        self.top_layers = _layers(self.subroots.drop("lang_key"), fanout, levels, [])
        self.root = self.top_layers[-1].select(F.col("_node").alias("root"))

    def proofs(self) -> DataFrame:
        """doc_id, lang_key, leaf, tampered, path (left and right siblings, level by level), subroot, root; a row a leaf."""
        spark = self.root.sparkSession
        empty = spark.createDataFrame([("", 0, [])], f"_g string, _block long, path {PATH}")
        for blocks in reversed(self.top_layers):
            empty = _paths(blocks, empty, self.fanout, self.levels)
        tops = self.subroots.select(F.col("lang_key").alias("_g"), F.col("_rank").alias("_block"), F.col("node").alias("subroot"))
        langs = written(tops.join(empty.select("_block", "path"), "_block").select("_g", F.lit(0).cast("long").alias("_block"), "path", "subroot"), "merkle-langs")
        above = langs.select("_g", "_block", "path")
        for blocks in reversed(self.layers[1:]):
            above = _paths(blocks, above, self.fanout, self.levels)
        small = above.count() <= BROADCAST_ROWS // 10  # a path may have some kilobytes
        held = self.layers[0].join(F.broadcast(above) if small else above, ["_g", "_block"])
        held = lookup(held, langs.select("_g", "subroot"), ["_g"], F.col("_block")).crossJoin(F.broadcast(self.root))
        return held.select("_g", "_n", "nodes", "doc_id", "tampered", "path", "subroot", "root")

    def checked(self) -> DataFrame:
        """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, n_siblings for every row of the table.

        proof_sha256 is the digest of all siblings in the order of the path; folded_root comes from the tampered leaf, where
        there is one, and the untampered siblings.
        """
        fanout, most = self.fanout, self.levels
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "n_siblings"]
        schema = self.layers[0].select(F.explode("doc_id").alias("doc_id")).schema
        for c in names[1:6]:
            schema = schema.add(c, "string")
        schema = schema.add("verified", "boolean").add("n_siblings", "long")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    n, nodes, bent, path, subroot, root = (batch.column(c)[k].as_py() for c in ("_n", "nodes", "tampered", "path", "subroot", "root"))
                    tiers = fold_up(nodes, levels_of(n, fanout, most), fanout)
                    above = [(x["left"], x["right"]) for x in path]
                    beyond = "".join(a + b for a, b in above)
                    tops: dict[str, str] = {}
                    proof, back = [], []
                    for at, (node, other) in enumerate(zip(nodes, bent, strict=True)):
                        own = siblings(tiers, at, fanout)
                        proof.append("".join(a + b for a, b in own) + beyond)
                        top = folded(other or node, own)
                        if top not in tops:
                            tops[top] = folded(top, above)
                        back.append(tops[top])
                    size = len(nodes)
                    text = [nodes, [subroot] * size, [root] * size, [digest(p) for p in proof], back]
                    rest = [pa.array([b == root for b in back]), pa.array([len(p) // 64 for p in proof], pa.int64())]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id")[k].values, *(pa.array(t, pa.string()) for t in text), *rest], names=names)

        return self.proofs().mapInArrow(run, schema)


def manifest(docs: DataFrame) -> DataFrame:
    """The checked proofs of every row of docs (see Manifest.checked)."""
    return Manifest(docs).checked()


MERKLE_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b::UBIGINT] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS c FROM range(256) r(b))),
rows AS (
  SELECT doc_id, lang, n_chars, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head, coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
    xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT), lambda c, x: xor(c // 256, t[(xor(c % 256, x) + 1)::BIGINT])), 4294967295::UBIGINT) % 7 = 0 AS hit
  FROM documents, crc_table),
leaf AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS g, sha256(head || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(length((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-') || tail) AS bent FROM rows),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i FROM leaf),
node AS (
  SELECT g, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM ranked
  UNION ALL
  SELECT g, level + 1, i // 2, sha256(h || coalesce(lead(h) OVER (PARTITION BY g ORDER BY i), '')), (n + 1) // 2 FROM node WHERE n > 1 QUALIFY i % 2 = 0),
sub AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
top AS (
  SELECT 0 AS level, i, h, n FROM sub
  UNION ALL
  SELECT level + 1, i // 2, sha256(h || coalesce(lead(h) OVER (ORDER BY i), '')), (n + 1) // 2 FROM top WHERE n > 1 QUALIFY i % 2 = 0),
tree AS (
  SELECT g, level, i, h, false AS above, n FROM node WHERE n > 1
  UNION ALL
  SELECT s.g, t.level, t.i, t.h, true, t.n FROM top t, sub s WHERE t.n > 1 AND (s.i >> t.level) // 2 = t.i // 2),
steps AS (SELECT g, above, level, row_number() OVER (PARTITION BY g ORDER BY above, level) AS step FROM (SELECT DISTINCT g, above, level FROM tree)),
fold AS (
  SELECT r.doc_id, r.leaf, r.g, r.i, s.i AS sub_i, 1 AS step, r.bent AS h, '' AS proof FROM ranked r JOIN sub s USING (g)
  UNION ALL
  SELECT f.doc_id, f.leaf, f.g, f.i, f.sub_i, f.step + 1,
    sha256(CASE WHEN f.pos % 2 = 1 THEN o.h || f.h ELSE f.h || coalesce(o.h, '') END), f.proof || coalesce(o.h, '')
  FROM (SELECT f.*, s.above, s.level, (CASE WHEN s.above THEN f.sub_i ELSE f.i END) >> s.level AS pos FROM fold f JOIN steps s ON s.g = f.g AND s.step = f.step) f
  LEFT JOIN tree o ON o.g = f.g AND o.above = f.above AND o.level = f.level AND o.i = xor(f.pos, 1)),
last AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY step DESC) = 1),
root AS (SELECT h AS root FROM top WHERE n = 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, root, sha256(l.proof) AS proof_sha256, l.h AS folded_root, l.h = root AS verified, (length(l.proof) // 64)::BIGINT AS n_siblings
FROM last l JOIN sub s USING (g), root
"""
