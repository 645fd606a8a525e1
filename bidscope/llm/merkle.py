"""Merkle manifest of a table, with upper proofs by butterfly exchange.

Leaves are numbered within their group and cut into aligned blocks of
``FANOUT ** LEVELS`` rows. A block hashes its own subtree. Then the blocks
exchange in rounds: in round r the aligned FANOUT blocks whose numbers differ
in base-FANOUT digit r alone send each other the roots they hold, and each of
them hashes the common parent itself. So after the last round every block
holds the group's root and all siblings on its way there; nothing is sent back
down. The group roots form a tree of their own in the same way.

A tree whose number of blocks is no power of the fanout has incomplete
subtrees. Members without leaves fill it up to a multiple of the largest
complete subtree (less than twice the blocks): they receive, hash and send
like any other, so each member sends and gets at most FANOUT roots a round,
and no block serves more partners than another.

Scale: documents are hashed where they are read, and only hashes move. Rows
get their place by a range partitioning on (group, id, running number), which
splits a group with a third of all rows as well as many copies of one row; the
counts that turn places in a partition into places in a group are one row for
each partition and group. A block holds at most 4,096 rows of about 200 bytes.
The rounds move eight hashes a block.

Defined cases: a null value hashes as ``-``; null groups are one group, before
all others; null ids come first; equal ids are ordered by leaf, so equal rows
get one row each with neighbouring places; an empty table gives an empty
result; a group of one row has its leaf as subroot, and a table of one group
its subroot as root; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import again, drop, stored

FANOUT, LEVELS = 8, 4
BITS = 3  # of a base-FANOUT digit
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_STEPS = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(values: Sequence[Column]) -> Column:
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return digest(F.concat(*map(part, values)))


def _placed(nodes: DataFrame) -> DataFrame:
    """``nodes(key, id, leaf, altered)`` with ``pos`` (place in the key) and ``size`` (rows of the key)."""
    # the running number tells equal rows apart, so that ranges can split them
    known = stored(nodes.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    order = ["key", "id", "leaf", "tie"]
    ranged = known.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    drop(known)
    part = F.shiftright("at", 33).alias("part")
    runs = again(ranged).groupBy("key", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("key", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                       F.sum("n").over(Window.partitionBy("key")).alias("size"))
    return (ranged.withColumn("part", part).join(runs, ["key", "part"])
            .select("key", "id", "leaf", "altered", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "size"))


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(level, i * FANOUT + 1, FANOUT), "")))


def _with_levels(blocks: DataFrame) -> DataFrame:
    """``level0`` to ``level4``: the nodes of a block's subtree; a tree of one block ends at its root."""
    out = blocks.withColumn("level0", F.transform("items", lambda x: x["leaf"]))
    for k in range(LEVELS):
        below = F.col(f"level{k}")
        out = out.withColumn(f"level{k + 1}", F.when((F.col("blocks") > 1) | (F.size(below) > 1), _parents(below)).otherwise(F.array().cast("array<string>")))
    return out


def _blocks(placed: DataFrame) -> DataFrame:
    """One row for each block: ``key, block, blocks, items`` in order of place, and the subtree's root ``node``."""
    shift = BITS * LEVELS
    item = F.struct("pos", "id", "leaf", "altered")
    rows = (placed.groupBy("key", F.shiftright("pos", shift).alias("block"))
            .agg((F.shiftright(F.first("size") - 1, shift) + 1).alias("blocks"), F.array_sort(F.collect_list(item)).alias("items")))
    levels = _with_levels(rows)
    node = F.lit(None).cast("string")
    for k in range(LEVELS + 1):
        node = F.when(F.size(f"level{k}") == 1, F.get(f"level{k}", F.lit(0))).otherwise(node)
    return levels.select("key", "block", "blocks", "items", node.alias("node"))


def _exchange(blocks: DataFrame) -> DataFrame:
    """``key, block, up, top``: all siblings above a block's own root, and the root over all blocks of the key."""
    most = blocks.agg(F.max("blocks")).first()[0] or 1
    all_rounds = next(r for r in range(22) if FANOUT ** r >= most)
    rounds = sum((F.when(F.col("blocks") > FANOUT ** r, 1).otherwise(0) for r in range(all_rounds)), F.lit(0))
    now = blocks.select("key", "block", "blocks", "node", rounds.alias("rounds"), F.array().cast(_STEPS).alias("up"))
    span = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest((F.col("rounds") - 1) * BITS, F.lit(0)))
    now = now.withColumn("members", F.ceil(F.col("blocks") / span) * span)
    # members without leaves stand after the blocks; there are fewer of them than blocks
    now = now.select("key", F.explode(F.array("block", F.col("block") + F.col("blocks"))).alias("member"), "block", "blocks", "members", "rounds", "node", "up")
    now = now.where(F.col("member") < F.col("members")).select(
        "key", "member", "blocks", "members", "rounds", F.when(F.col("member") == F.col("block"), F.col("node")).alias("node"), "up")
    for r in range(all_rounds):
        digit = F.shiftright("member", BITS * r).bitwiseAND(FANOUT - 1)
        first = F.col("member") - F.shiftleft(digit, BITS * r)
        partners = F.filter(F.array(*[first + F.lit(e << (BITS * r)).cast("long") for e in range(FANOUT)]), lambda p: p < F.col("members"))
        active = F.col("rounds") > r
        sent = now.select("key", "blocks", "members", "rounds", "node", digit.alias("digit"), F.col("member").alias("sender"),
                          "up", F.explode(F.when(active, partners).otherwise(F.array("member"))).alias("member"))
        own = F.col("sender") == F.col("member")
        got = sent.groupBy("key", "member").agg(
            F.max("blocks").alias("blocks"), F.max("members").alias("members"), F.max("rounds").alias("rounds"), F.max(F.when(own, F.col("digit"))).alias("digit"),
            F.first(F.when(own, F.col("up")), ignorenulls=True).alias("up"),
            F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("digit", "node")))).alias("run"))
        side = lambda test: F.array_join(F.transform(F.filter("run", lambda x: test(x["digit"])), lambda x: x["node"]), "")
        step = F.struct(side(lambda d: d < F.col("digit")).alias("left"), side(lambda d: d > F.col("digit")).alias("right"))
        whole = F.when(F.size("run") > 0, digest(side(lambda d: d >= 0)))
        now = got.select("key", "member", "blocks", "members", "rounds", F.when(active, whole).otherwise(F.get("run", F.lit(0))["node"]).alias("node"),
                         F.when(active, F.concat("up", F.array(step))).otherwise(F.col("up")).alias("up"))
    return now.where(F.col("member") < F.col("blocks")).select("key", F.col("member").alias("block"), "up", F.col("node").alias("top"))


def _rows(blocks: DataFrame, *carry: str) -> DataFrame:
    """A row for each item: ``key, id, leaf, altered, steps`` (siblings level by level up to the top) and ``carry``."""
    def steps(place: Column) -> Column:
        out = []
        for k in range(LEVELS):
            level, at = F.col(f"level{k}"), F.shiftright(place, BITS * k)
            start = at - at.bitwiseAND(FANOUT - 1)
            left = F.array_join(F.slice(level, start + 1, at - start), "")
            right = F.array_join(F.slice(level, at + 2, start + FANOUT - 1 - at), "")
            # where the tree has ended there is no step
            out.append(F.when(F.size(f"level{k + 1}") > 0, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array().cast(_STEPS)))
        return F.concat(*out, F.col("up"))

    made = F.transform("items", lambda x, i: F.struct(x["id"].alias("id"), x["leaf"].alias("leaf"), x["altered"].alias("altered"), steps(i).alias("steps")))
    return (_with_levels(blocks).select("key", *carry, F.explode(made).alias("x"))
            .select("key", "x.id", "x.leaf", "x.altered", "x.steps", *carry))


def manifest(table: DataFrame, *, row_id: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, altered: Column | None = None) -> DataFrame:
    """Per row: ``row_id, leaf, altered_leaf, subroot, root, steps``.

    ``steps`` is the proof: from the leaf up to the root, the joined hashes of
    the siblings to the left and to the right. ``altered`` is a leaf hash to
    be checked against the tree in place of the row's own (null: the own one).
    """
    c = {f: F.col(f"`{f}`") for f in fields}
    # keeps the order: null first, then bytewise
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = table.select(key.alias("key"), F.col(f"`{row_id}`").alias("id"), leaf_of(list(c.values())).alias("leaf"),
                          (F.lit(None).cast("string") if altered is None else altered).alias("altered"))
    blocks = stored(_blocks(_placed(leaves)), "merkle-blocks")
    above = stored(_exchange(blocks), "merkle-above")
    roots = above.where("block = 0").select(F.lit("").alias("key"), F.col("key").alias("id"), F.col("top").alias("leaf"), F.lit(None).cast("string").alias("altered"))
    groups = stored(_blocks(_placed(roots)), "merkle-groups")
    over = _rows(again(groups).join(_exchange(groups), ["key", "block"]), "top")
    over = stored(over.select(F.col("id").alias("key"), F.col("leaf").alias("subroot"), F.col("top").alias("root"), F.col("steps").alias("over")), "merkle-roots")
    drop(groups)
    whole = again(blocks).join(again(above).drop("top"), ["key", "block"]).join(over, "key").withColumn("up", F.concat("up", "over"))
    return _rows(whole, "subroot", "root").select(F.col("id").alias(row_id), "leaf", F.coalesce("altered", "leaf").alias("altered_leaf"), "subroot", "root", "steps")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def tampered_leaf(every: int = 3) -> Column:
    """Leaf of the row with the text's A-Z lower-cased, where ``every`` divides the crc32 of the decimal doc_id; else null."""
    values = [F.translate("text", *_AZ) if f == "text" else F.col(f) for f in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, leaf_of(values))


def verified(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` with each row's proof checked against its (possibly tampered) leaf."""
    m = manifest(docs, altered=tampered_leaf())
    siblings = F.aggregate("steps", F.lit(""), lambda t, s: F.concat(t, s["left"], s["right"]))
    out = m.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), folded(F.col("altered_leaf"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
