"""Merkle dataset manifest: digests of all rows, folded into one root that proves each of them.

A leaf is the digest of a row's fields. The leaves of a group stand in order of the row ids; every
``FAN`` consecutive nodes become one, until one is left, the group's subroot; the subroots, ordered by
group, are folded to the root in the same way. Nodes are collected in ordered arrays of a fixed size,
``FAN ** LEVELS`` leaves a block, and array functions collapse a block's levels within its row; the
roots of the blocks are the nodes of the next round. A group with a third of all rows is thus many
blocks, and three rounds hold 68 thousand million leaves.

Places in a group come from one range partitioning over (group, id): a written row's place in its
partition, less the group's first one, plus the group's rows in the partitions before. Paths go down
the rounds block by block, so a path from a block to the root is sent once a block, not once a leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lodestream.llm.spelling import CRC_TABLE_SQL, crc_sql
from lodestream.scratch import Workspace

#: Nodes that become one, its logarithm to base 2, and the levels that one block collapses.
FAN, BITS, LEVELS = 16, 4, 3
_HEX = 64  # characters of a digest
_BLOCK_BITS = BITS * LEVELS
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ABOVE = "array<struct<run: string, place: int>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _right(value: Column, bits: Column | int) -> Column:
    return F.call_function("shiftright", value, bits if isinstance(bits, Column) else F.lit(bits))


def digest(*texts: Column) -> Column:
    """Lowercase hexadecimal sha256 of texts one after another."""
    return F.sha2(F.concat(*texts), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of a row's fields: ``-`` for a null, else the value's number of UTF-8 bytes, a colon, the value."""
    text = [v.cast("string") for v in values]
    return digest(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text))


def _levels(n: Column) -> Column:
    """Levels that a block collapses, by the nodes of its group: all of ``LEVELS`` unless fewer leave one node."""
    out = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        out = F.when(n <= FAN**k, k).otherwise(out)
    return out


def _collapse(digests: Column, levels: Column) -> Column:
    """struct<nodes, runs>: the nodes that are left of a block, and each level's runs as joined digests."""

    def level(state: Column, _: Column) -> Column:
        last = _right(F.size(state["nodes"]) - 1, BITS)
        runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(state["nodes"], i * FAN + 1, FAN), ""))
        return _let(runs, lambda r: F.struct(F.transform(r, lambda x: F.sha2(x, 256)).alias("nodes"), F.concat(state["runs"], F.array(r)).alias("runs")))

    start = F.struct(digests.alias("nodes"), F.array().cast("array<array<string>>").alias("runs"))
    return F.aggregate(F.slice(F.array(*(F.lit(k) for k in range(LEVELS))), 1, levels), start, level)


def _path(runs: Column, i: Column) -> Column:
    """From a block's place i to its root: each level's run and the place in it."""
    return F.transform(runs, lambda r, k: F.struct(F.get(r, _right(i, k * BITS + BITS)).alias("run"), _right(i, k * BITS).bitwiseAND(FAN - 1).alias("place")))


def _left_of(step: Column) -> Column:
    return F.substr(step["run"], F.lit(1), step["place"] * _HEX)


def _right_of(step: Column) -> Column:
    return F.substr(step["run"], step["place"] * _HEX + _HEX + 1)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on a path, level by level from the leaf on, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(_left_of(s), _right_of(s))), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, s: digest(_left_of(s), node, _right_of(s)))


def _ranked(made: Workspace, rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` of a written table with ``rank`` in their ``group``, from 0 on by ``order``, and ``n``, the group's rows.

    Rows that are equal in ``order`` are told apart by where they lie, so that copies spread, too.
    """
    keys = ["group", *order, "__tie"]
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    placed = made.table(dealt.withColumn("__at", F.monotonically_increasing_id()), "merkle-placed")
    part = _right(F.col("__at"), 33).alias("__part")
    spans = placed.groupBy("group", part).agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    mine = Window.partitionBy("group")  # at most one row a partition of the table
    before = F.sum("__rows").over(mine.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = made.table(spans.select("group", "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__rows").over(mine).alias("n")), "merkle-starts")
    return placed.withColumn("__part", part).join(starts, ["group", "__part"]).withColumn("rank", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def _fold_blocks(made: Workspace, nodes: DataFrame, kept: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The written blocks of all rounds, and (group, top) with each group's last node.

    ``nodes`` has group, rank, n, node and columns ``kept``. A block has group, block, n, its items in
    order (rank, node and what is kept) and top, the node that it becomes.
    """
    rounds = []
    while True:
        item = F.struct("rank", "node", *kept) if not rounds else F.struct("rank", "node")
        blocks = nodes.groupBy("group", _right(F.col("rank"), _BLOCK_BITS).alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items"))
        top = F.get(_collapse(F.transform("items", lambda x: x["node"]), _levels(F.col("n")))["nodes"], F.lit(0))
        blocks = made.table(blocks.withColumn("top", top), "merkle-blocks")
        rounds.append(blocks)
        whole = F.col("n") <= FAN**LEVELS
        if blocks.where(~whole).limit(1).count() == 0:
            break
        nodes = blocks.where(~whole).select("group", F.col("block").alias("rank"), F.ceil(F.col("n") / FAN**LEVELS).cast("bigint").alias("n"), F.col("top").alias("node"))
    tops = [b.where(F.col("n") <= FAN**LEVELS).select("group", "top") for b in rounds]
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return rounds, out


def _paths_down(rounds: list[DataFrame], groups: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """The lowest blocks with ``above``, the path from a block's top to the root, and the groups' columns ``carried``.

    ``groups`` has group, above and what is carried, one row a group.
    """
    whole = F.col("n") <= FAN**LEVELS
    upper = None
    for k in reversed(range(len(rounds))):
        rows = rounds[k].where(whole).join(groups, "group")
        if upper is not None:
            rows = rows.unionByName(rounds[k].where(~whole).join(upper, ["group", "block"]))
        if k:
            tree = _collapse(F.transform("items", lambda x: x["node"]), _levels(F.col("n")))
            paths = _let(F.struct(tree["runs"].alias("runs"), F.col("above").alias("above")), lambda t: F.transform("items", lambda x, i: F.struct(x["rank"].alias("block"), F.concat(_path(t["runs"], i), t["above"]).alias("above"))))
            upper = rows.select("group", *carried, F.explode(paths).alias("__x")).select("group", *carried, "__x.block", "__x.above")
    return rows


def _leaves(docs: DataFrame, fields: Sequence[str], group_col: str, id_col: str, claimed: dict[str, Column], changed: Column) -> DataFrame:
    values = [F.col(c) for c in fields]
    claims = [claimed.get(c, F.col(c)) for c in fields]
    group = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))  # null first, then by bytes
    rows = docs.select(group.alias("group"), F.col(id_col).alias("id"), leaf_digest(*values).alias("node"), (F.when(changed, leaf_digest(*claims)) if claimed else F.lit(None).cast("string")).alias("claim"))
    return rows.withColumn("claim", F.coalesce("claim", "node"))


def roots(docs: DataFrame, fields: Sequence[str], group_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(group_col as string, subroot, n_rows, root): the manifest of a table, one row a group; an empty table has none."""
    with Workspace(docs.sparkSession) as made:
        leaves = made.table(_leaves(docs, fields, group_col, id_col, {}, F.lit(False)).drop("claim"), "merkle-leaves")
        rows = leaves.groupBy("group").agg(F.count("*").alias("n_rows"))
        _, subroots = _fold_blocks(made, _ranked(made, leaves, ["id", "node"]))
        _, root = _fold_blocks(made, _ranked(made, _as_nodes(made, subroots), ["key"]))
        name = F.when(F.col("group") != "0", F.substr("group", F.lit(2)))
        done = made.table(subroots.join(rows, "group").crossJoin(F.broadcast(root.select(F.col("top").alias("root")))), "merkle-roots")  # the root is one row
        made.keep(done)
        return done.select(name.alias(group_col), F.col("top").alias("subroot"), "n_rows", "root")


def _as_nodes(made: Workspace, subroots: DataFrame) -> DataFrame:
    return made.table(subroots.select(F.lit("").alias("group"), F.col("group").alias("key"), F.col("top").alias("node")), "merkle-subroots")


def prove(docs: DataFrame, fields: Sequence[str], group_col: str = "source", id_col: str = "doc_id", claimed: dict[str, Column] | None = None, changed: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: id_col, leaf, subroot, root, proof_sha256, folded_root, verified, path.

    ``claimed`` gives other values of fields for the rows where ``changed`` holds, as a checker may
    have received them; ``folded_root`` is what the claimed row and the true siblings give, and
    ``verified`` tells whether it is the root. ``path`` is the proof itself: each level's run of
    digests and the row's place in it. Defined results: nulls in any field are ``-`` and a null id
    comes first in its group; a null group is one of its own before all others, an empty string
    another; rows that share an id are ordered by their leaves, and equal rows, which have equal
    leaves, stand next to each other in either order; a group of one row has its leaf as subroot;
    long texts are digested whole; other columns play no part; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with Workspace(spark) as made:
        leaves = made.table(_leaves(docs, fields, group_col, id_col, claimed or {}, F.lit(True) if changed is None else changed), "merkle-leaves")
        rounds, subroots = _fold_blocks(made, _ranked(made, leaves, ["id", "node"]), ["id", "claim"])
        upper, tops = _fold_blocks(made, _ranked(made, _as_nodes(made, subroots), ["key"]), ["key"])
        no_path = tops.select("group", F.col("top").alias("root"), F.array().cast(_ABOVE).alias("above"))
        rows = _paths_down(upper, no_path, ["root"])
        tree = _collapse(F.transform("items", lambda x: x["node"]), _levels(F.col("n")))
        parts = _let(F.struct(tree["runs"].alias("runs"), F.col("above").alias("above")), lambda t: F.transform("items", lambda x, i: F.struct(x["key"].alias("group"), x["node"].alias("subroot"), F.concat(_path(t["runs"], i), t["above"]).alias("above"))))
        groups = made.table(rows.select("root", F.explode(parts).alias("__x")).select("root", "__x.*"), "merkle-groups")
        rows = _paths_down(rounds, groups, ["subroot", "root"])
        path = lambda t, i: F.concat(_path(t["runs"], i), t["above"])
        one = lambda x, p: F.struct(x["id"].alias("id"), x["node"].alias("leaf"), proof_digest(p).alias("proof"), fold(x["claim"], p).alias("folded"), p.alias("path"))
        out = _let(F.struct(tree["runs"].alias("runs"), F.col("above").alias("above")), lambda t: F.transform("items", lambda x, i: _let(path(t, i), lambda p: one(x, p))))
        made.keep(*rounds, groups)
        out = rows.select("subroot", "root", F.explode(out).alias("__x"))
    return out.select(F.col("__x.id").alias(id_col), F.col("__x.leaf").alias("leaf"), "subroot", "root", F.col("__x.proof").alias("proof_sha256"), F.col("__x.folded").alias("folded_root"), (F.col("__x.folded") == F.col("root")).alias("verified"), F.col("__x.path").alias("path"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    lower = F.translate("text", _UPPER, _LOWER)
    return prove(docs, FIELDS, claimed={"text": lower}, changed=tampered).drop("path")


def _tree_sql(name: str, depth: int) -> str:
    """Common table expressions that fold the nodes ``{name}0`` (g, pos, d, n) level by level, with runs and tops."""
    parts = [f"{name}{k + 1} AS (SELECT g, pos // {FAN} AS pos, sha256(string_agg(d, '' ORDER BY pos)) AS d, (n + {FAN - 1}) // {FAN} AS n, string_agg(d, '' ORDER BY pos) AS run FROM {name}{k} WHERE n > 1 GROUP BY g, pos // {FAN}, n)" for k in range(depth)]
    tops = " UNION ALL ".join(f"SELECT g, d FROM {name}{k} WHERE n = 1" for k in range(depth + 1))
    return ", ".join([*parts, f"{name}_top AS ({tops})"])


def _walk_sql(name: str, depth: int, rows: str) -> str:
    """``rows`` (g, pos, siblings, node) with the levels of a tree added to siblings and node."""
    out = rows
    for k in range(depth):
        place = f"w.pos // {FAN**k} % {FAN} * {_HEX}"
        left, right = f"r.run[: {place}]", f"r.run[{place} + {_HEX + 1} :]"
        out = f"SELECT w.* REPLACE (siblings || coalesce({left} || {right}, '') AS siblings, CASE WHEN r.run IS NULL THEN node ELSE sha256({left} || node || {right}) END AS node) FROM ({out}) w LEFT JOIN {name}{k + 1} r ON r.g = w.g AND r.pos = w.pos // {FAN ** (k + 1)}"
    return out


_DEPTH = 6  # levels that the SQL has: 16 million rows a group
_FIELDS_SQL = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS)
_ID_BYTES = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: unicode(c)::BIGINT)"
OP13_SQL = f"""
WITH {CRC_TABLE_SQL},
rows AS (SELECT *, {crc_sql(_ID_BYTES)} % 5 = 0 AS tampered FROM documents, crc_table),
leaves AS (SELECT doc_id, coalesce('1' || source, '0') AS g, sha256({_FIELDS_SQL}) AS leaf, tampered, sha256({_FIELDS_SQL.replace("text", f"translate(text, '{_UPPER}', '{_LOWER}')")}) AS other FROM rows),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
a0 AS (SELECT g, pos, leaf AS d, n FROM placed), {_tree_sql("a", _DEPTH)},
groups AS (SELECT g AS name, '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, d, count(*) OVER () AS n FROM a_top),
b0 AS (SELECT g, pos, d, n FROM groups), {_tree_sql("b", _DEPTH)},
within AS ({_walk_sql("a", _DEPTH, "SELECT doc_id, g, pos, leaf, '' AS siblings, CASE WHEN tampered THEN other ELSE leaf END AS node FROM placed")}),
above AS (SELECT w.doc_id, w.leaf, w.siblings, w.node, s.d AS subroot, s.g, s.pos FROM within w JOIN groups s ON s.name = w.g)
SELECT doc_id, leaf, subroot, t.d AS root, sha256(siblings) AS proof_sha256, node AS folded_root, node = t.d AS verified FROM ({_walk_sql("b", _DEPTH, "SELECT * FROM above")}) w, b_top t
"""
