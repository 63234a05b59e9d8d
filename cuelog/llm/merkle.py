"""Merkle dataset manifest: the levels of a block of the tree are hex strings, cut and hashed by SQL substrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .ranks import ranked

#: Hex digits of a digest.
DIGEST = 64


def leaf_of(*columns: Column) -> Column:
    """The leaf of a record: sha256 of every value as ``-`` if null, else its UTF-8 length, ``:`` and itself."""
    spelled = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in spelled]), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's ``digest`` gives with the siblings of its ``path``."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def siblings(path: Column) -> Column:
    """The digests of a path as one string: level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def _blocks(nodes: DataFrame, keys: list[str], payload: list[str], arity: int, height: int) -> DataFrame:
    """One row a block of ``arity ** height`` aligned nodes: ``members`` by place, and ``levels``, each one hex string.

    The last level holds one digest, the block's.  A block that is all of its tree ends where one
    node is left; a block of a larger tree always has ``height`` levels of parents.
    """
    size, width = arity ** height, DIGEST * arity
    fields = ", ".join(["cast(pos % {} as int) AS at".format(size), "digest", *payload])
    return (nodes.groupBy(*keys, F.expr(f"pos div {size}").alias("block")).agg(F.max("n").alias("n"), F.expr(f"array_sort(collect_list(struct({fields})))").alias("members"))
            .withColumn("levels", F.expr(f"""
                aggregate(sequence(1, {height}), array(array_join(members.digest, '')), (levels, k) -> CASE WHEN n > {size} OR length(levels[size(levels) - 1]) > {DIGEST}
                    THEN concat(levels, transform(array(levels[size(levels) - 1]), level -> array_join(transform(sequence(0, (length(level) - 1) div {width}),
                        i -> sha2(substring(level, cast(i * {width} + 1 as int), {width}), 256)), '')))
                    ELSE levels END)""")))


def _climb(nodes: DataFrame, keys: list[str], payload: list[str], arity: int, height: int, most: int) -> list[DataFrame]:
    """The written blocks of every storey: the roots of one are the nodes of the next, until every tree is one block."""
    size, storeys = arity ** height, []
    while True:
        storeys.append(cut_lineage(_blocks(nodes, keys, payload, arity, height)))
        if most <= size:
            return storeys
        most, payload = -(-most // size), []
        nodes = storeys[-1].select(*keys, F.col("block").alias("pos"), F.expr("levels[size(levels) - 1]").alias("digest"), F.expr(f"(n - 1) div {size} + 1").alias("n"))


def _descend(storeys: list[DataFrame], keys: list[str], above: DataFrame, carried: list[str], arity: int, height: int) -> DataFrame:
    """Every node of the lowest storey (``m``) with its ``path``; ``above`` has a row a tree with ``path`` and the ``carried`` columns."""
    width = DIGEST * arity
    runs = f"transform(slice(levels, 1, size(levels) - 1), level -> transform(sequence(0, (length(level) - 1) div {width}), i -> substring(level, cast(i * {width} + 1 as int), {width})))"
    at = f"m.at div cast(pow({arity}, l) as bigint)"
    run, place = f"level[cast({at} div {arity} as int)]", f"cast(({at}) % {arity} as int)"
    flanks = f"named_struct('before', substring({run}, 1, {DIGEST} * {place}), 'after', substring({run}, {DIGEST} * {place} + {DIGEST + 1}, {width}))"
    above = above.withColumn("pos", F.lit(0).cast("bigint"))
    for storey in reversed(storeys):
        upper = above.select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.col("pos").alias("block"), "path", *carried)
        same = storey["block"] == upper["block"]
        for c in keys:
            same = same & storey[c].eqNullSafe(upper[f"_k_{c}"])
        met = storey.drop("n").join(upper, same).select(*[storey[c] for c in keys], storey["block"], "members", "levels", "path", *carried)
        nodes = met.select(*keys, "block", *carried, F.expr(f"""explode(flatten(transform(array({runs}), runs -> transform(members, m -> named_struct(
            'm', m, 'path', concat(transform(runs, (level, l) -> {flanks}), path))))))""").alias("node"))
        above = nodes.select(*keys, *carried, (F.col("block") * arity ** height + F.col("node.m.at")).alias("pos"), "node.m", "node.path")
    return above


def manifest(docs: DataFrame, leaf: Column, tree: str = "source", order: str = "doc_id", arity: int = 3, height: int = 6, **carry: Column) -> DataFrame:
    """The Merkle manifest of ``docs``: ``order``, ``tree``, ``leaf``, ``subroot``, ``root``, ``path`` and the ``carry`` columns of every row.

    Rows of one ``tree`` are leaves in ascending ``order`` (nulls first, equal ones by ``leaf``, then by the carried columns);
    while several nodes remain, every ``arity`` consecutive ones (the last run may have fewer) become the sha256
    of their concatenated hex digests.  What remains is the ``subroot``; subroots, ordered by ``tree`` (null
    first, bytewise), give the ``root`` the same way.  ``path`` lists the siblings of every level as the hex strings ``before`` and
    ``after``, from the leaf up to the root; ``folded(leaf, path)`` is the root again.

    A row without a tree belongs to the tree null; repeated rows are leaves of their own; an empty table
    has no rows.  Other columns of ``docs`` play no part.  Nothing of a tree is in one task but blocks of ``arity ** height`` nodes:
    places come from range partitions (``ranks.ranked``), the blocks' digests are the nodes of the
    next storey, and paths are handed down storey by storey.
    """
    docs = docs.select(F.col(tree).alias("_tree"), F.col(order).alias("_order"), leaf.alias("digest"), *[c.alias(name) for name, c in carry.items()])
    nodes = cut_lineage(ranked(cut_lineage(docs), ["_tree"], ["_order", "digest", *carry]))
    most = nodes.agg(F.max("n")).first()[0] or 0
    storeys = _climb(nodes, ["_tree"], ["_order", *carry], arity, height, most)
    subroots = storeys[-1].select("_tree", F.expr("levels[size(levels) - 1]").alias("digest"))
    tops = cut_lineage(ranked(cut_lineage(subroots), [], ["_tree"]))
    over = _climb(tops, [], ["_tree"], arity, height, tops.count())
    root = over[-1].select(F.expr("levels[size(levels) - 1]").alias("root"), F.expr("cast(array() as array<struct<before:string,after:string>>)").alias("path"))
    trees = _descend(over, [], root, ["root"], arity, height).select("root", "path", F.col("m._tree").alias("_tree"), F.col("m.digest").alias("subroot"))
    leaves = _descend(storeys, ["_tree"], trees, ["subroot", "root"], arity, height)
    return leaves.select(F.col("m._order").alias(order), F.col("_tree").alias(tree), F.col("m.digest").alias("leaf"), "subroot", "root", "path", *[f"m.{c}" for c in carry])
