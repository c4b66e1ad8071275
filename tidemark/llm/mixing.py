"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A token budget runs down a tree of domains, languages and sources. Every node's budget is split among its children by
weight, but no child gets more than its subtree can give (its tokens times the most epochs); what it can't take goes to
its siblings first, and only what all of them can't take is missing further up. A leaf with more than one epoch's budget
gives all documents once an epoch; of the last epoch it gives the prefix of a seeded order that the budget pays for.

The order inside a leaf is that of a hash of seed, epoch, id and text, dealt into buckets. Bucket sums tell in which
bucket a leaf's budget ends; only the hashes of that bucket are summed one by one. So no task sees a whole leaf. All this
runs on a stored table of leaves, hashes and token counts; the texts are read once to count and once to select, and
are never moved.

Nulls and edge cases: null domain, language or source count as ''. Leaves that the tree lacks get nothing, and so do
texts without words. A document that is larger than what remains of its leaf's budget ends the prefix. Rows that repeat
id and text share their hash and count as one document of their joint size: they are all selected, or none. Rows that
repeat an id with another text, or have none, are documents of their own. Without documents or budget nothing is selected.
Extra columns stay, whatever their names; only those called domain, epoch or n_tokens give way to the operator's own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

LEVELS = ("domain", "lang", "source")
#: The columns that the result has besides the documents' own.
ADDED = ("domain", "epoch", "n_tokens")
#: Rows that a bucket of a leaf's order should have at most.
BUCKET_ROWS = 1_000


@dataclass
class Node:
    weight: float = 1.0
    children: dict[str, Node] = field(default_factory=dict)


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\t-\\r]+")).cast("long")


def split_budget(budget: int, children: list[tuple[float, int]]) -> list[int]:
    """Shares of whole tokens by weight, none above its capacity: shortages go to the siblings that have room.

    Children fill in ascending order of capacity per weight, so one pass finds those that are full. The rest is rounded
    by largest remainders, the first of equal ones first.
    """
    shares = [0] * len(children)
    queue = sorted((i for i, (w, c) in enumerate(children) if w > 0 and c > 0), key=lambda i: children[i][1] / children[i][0])
    left, total = min(budget, sum(children[i][1] for i in queue)), sum(children[i][0] for i in queue)
    full = 0
    while full < len(queue) and children[queue[full]][1] * total <= left * children[queue[full]][0]:
        weight, shares[queue[full]] = children[queue[full]]
        left, total, full = left - shares[queue[full]], total - weight, full + 1
    rest = sorted(queue[full:])
    total = sum(children[i][0] for i in rest)
    exact = {i: left * children[i][0] / total for i in rest}
    for i in rest:
        shares[i] = int(exact[i])
    spare = left - sum(shares[i] for i in rest)
    for i in sorted(rest, key=lambda i: shares[i] - exact[i])[:spare]:
        shares[i] += 1
    return shares


def leaf_budgets(tree: Node, capacity: dict[tuple, int], budget: int) -> dict[tuple, int]:
    """The budget of every leaf of the tree; ``capacity``: of the leaves, by path. Work is linear in leaves and levels."""
    below: dict[tuple, int] = {}
    for path, room in capacity.items():
        if _in(tree, path):
            for k in range(len(path) + 1):
                below[path[:k]] = below.get(path[:k], 0) + room
    out: dict[tuple, int] = {}

    def down(node: Node, path: tuple, share: int) -> None:
        if not node.children:
            out[path] = min(share, capacity.get(path, 0))
            return
        names = sorted(node.children)
        for name, part in zip(names, split_budget(share, [(node.children[n].weight, below.get((*path, n), 0)) for n in names]), strict=True):
            down(node.children[name], (*path, name), part)

    down(tree, (), budget)
    return out


def _in(node: Node, path: tuple) -> bool:
    for name in path:
        node = node.children.get(name)
        if node is None or node.weight <= 0:
            return False
    return not node.children


def mixed(docs: DataFrame, tree: Node | Callable[[list[tuple]], Node], budget: int | float, domain: Column, max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """The selected rows of ``docs`` (doc_id, text, lang, source, ...), with epoch, n_tokens and domain.

    ``tree``: of domains, languages and sources, or what makes it from the leaves that there are. ``budget``: tokens, or
    as a float the share of all tokens of the tree's leaves. What comes to the driver is one row a leaf, so as many as
    the table has sources in a language and domain; it is broadcast back.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ADDED))
    own = "mix_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    leaf, ident, plan_, tokens, whole, rest, buckets, bucket, order, end, cut = (own + x for x in ("leaf", "ident", "plan", "tokens", "whole", "rest", "buckets", "bucket", "order", "end", "cut"))
    path = F.struct(F.coalesce(domain, F.lit("")).alias("domain"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"))
    rows = docs.select("*", path.alias(leaf), F.xxhash64("doc_id", "text").alias(ident))
    sizes = stored(rows.select(leaf, ident, n_tokens(F.col("text")).alias(tokens)))

    totals = {tuple(r[0]): (r[1] or 0, r[2]) for r in sizes.groupBy(leaf).agg(F.sum(tokens), F.count(F.lit(1))).collect()}
    tree = tree if isinstance(tree, Node) else tree(list(totals))
    have = {k: t for k, (t, _) in totals.items() if t and _in(tree, k)}
    if isinstance(budget, float):
        budget = int(budget * sum(have.values()))
    shares = leaf_budgets(tree, {k: v * max_epochs for k, v in have.items()}, budget) if have else {}
    plan = [(k, shares[k] // have[k], shares[k] % have[k], 1 + totals[k][1] // BUCKET_ROWS) for k in have if shares.get(k)]
    spark, kind = docs.sparkSession, f"{leaf} struct<domain:string,lang:string,source:string>"
    planned = F.broadcast(spark.createDataFrame(plan, f"{kind}, {whole} long, {rest} long, {buckets} long"))  # one row a leaf

    def placed(df: DataFrame) -> DataFrame:
        hashed = F.xxhash64(F.lit(seed), F.col(whole), F.col(ident))
        return df.join(planned, leaf).select("*", F.pmod(F.shiftrightunsigned(hashed, 20), F.col(buckets)).alias(bucket), hashed.alias(order))

    # where in its last epoch each leaf's budget ends: in which bucket, and after which hash there
    dealt = placed(sizes.where(F.col(tokens) > 0))
    upto = Window.partitionBy(leaf).orderBy(bucket)
    sums = dealt.groupBy(leaf, rest, bucket).agg(F.sum(tokens).alias("n")).withColumn("sum", F.sum("n").over(upto))
    ends = sums.where(F.col("sum") > F.col(rest)).groupBy(leaf).agg(F.min(F.struct(F.col(bucket).alias("at"), (F.col(rest) - F.col("sum") + F.col("n")).alias("left"))).alias(end))
    ended = [(tuple(r[0]), r[1]["at"], r[1]["left"]) for r in ends.collect()]
    ended = F.broadcast(spark.createDataFrame(ended, f"{kind}, {end} long, left long"))  # one row a leaf
    edge = dealt.join(ended, leaf).where(F.col(bucket) == F.col(end)).groupBy(leaf, end, "left", order).agg(F.sum(tokens).alias("n"))
    sofar = F.sum("n").over(Window.partitionBy(leaf).orderBy(order))
    last = edge.withColumn("sum", sofar).where(F.col("sum") <= F.col("left")).groupBy(leaf).agg(F.max(order).alias(cut))
    last = [(tuple(r[0]), r[1]) for r in last.collect()]
    cuts = ended.select(leaf, end).join(spark.createDataFrame(last, f"{kind}, {cut} long"), leaf, "left")

    none = F.array().cast("array<long>")
    before = F.when(F.col(whole) > 0, F.sequence(F.lit(0).cast("long"), F.col(whole) - 1)).otherwise(none)
    inside = (F.col(bucket) < F.col(end)) | ((F.col(bucket) == F.col(end)) & (F.col(order) <= F.col(cut)))
    epochs = F.concat(before, F.when(inside, F.array(whole)).otherwise(none))
    solid = rows.where(F.col("text").rlike("[^\\x20\\t-\\r]"))  # stops at the first word
    chosen = placed(solid).join(F.broadcast(cuts), leaf, "left").withColumn("epoch", F.explode(epochs))
    return chosen.select(*docs.columns, F.col(leaf)["domain"].alias("domain"), "epoch", n_tokens(F.col("text")).alias("n_tokens"))


def default_tree(spark_rows: list[tuple[str, str, str]], domains: dict[str, float], langs: dict[str, float], other: float) -> Node:
    """A tree with weighted domains and languages and sources of equal weight, from (domain, lang, source) triples.

    ``other``: the weight of each domain or language that isn't listed, the empty one included.
    """
    tree = Node()
    for d, lang, source in sorted(set(spark_rows)):
        at = tree.children.setdefault(d, Node(domains.get(d, other))).children.setdefault(lang, Node(langs.get(lang, other)))
        at.children.setdefault(source, Node())
    return tree
