"""Near-duplicates by bottom-k sketches of one hash function.

A-Z are read as a-z. A document's set is that of its five-word shingles, each hashed once to 64
bits; its sketch is the ``K`` least hashes of the set. Two documents at Jaccard similarity 0.75
share about three quarters of the K least hashes of their union, and every one of those stands in
both sketches.

1. Texts with the same set become one node, keyed by 128 bits of the set, so exact copies are never
   paired. All that follows works on nodes.
2. Inverted lists: retained hash -> nodes. A node's retained hashes are ordered by how many nodes
   retain them, rarest first. Sketches that share ``LEAST`` hashes share one among the first
   K - LEAST + 1 of that order, so only those are posted; hashes that one node retains are not.
   A set of n <= K shingles shares three quarters of them with another such set, and
   K - m/4 with the sketch of a larger set of m <= n/0.75; it posts by the lesser of the two.
3. First links: a list's head is the node with the fewest hashes of its own, the middle of a group
   of near copies. Each node is compared with the head that it meets most often, and with the other
   node of each list of two. Verified links are joined into components, which draws together groups
   of near copies, however large, with a bounded number of comparisons a node.
4. The rest, exactly. Lists whose nodes are all in one component are done: a link inside it changes
   nothing. Of the others, those of up to ``SHORT`` nodes are paired directly. In a longer list each
   node is described by what sets it apart from the list's head: the shingles that one of both has
   and the other has not. With d(A) and d(B) the sizes of those differences, o what they share and
   |A|, |B| the set sizes, A and B are linked exactly where d(A) + d(B) - 2 o <= (|A| + |B|) / 7.
   Where both are close to the head they are linked with it; all other links need a shared
   difference, and so many that it stands among the rarest of each (the prefix of step 2, on
   differences). So a passage or a text that very many documents share costs nothing: it is no
   difference. What is left meets in inverted lists of differences; classes of nodes (by the size of
   their difference) that the inequality keeps apart are not paired.
   Lists of differences with more than ``MANY`` possible pairs are not paired as rows: the nodes of
   their head are compared in blocks of bounded size, by their differences, and only links leave.
5. A pair is first held against the union sketch (the K least of both sketches: the share in both
   estimates the similarity; under ``ESTIMATE`` it is let go), then confirmed on full sets.

Full sets are made again from the texts of the nodes that need them, never kept for all documents.
Components come from rounds of label passing along verified links, on the cluster. Tables of nodes
are broadcast only up to ``BROADCAST_KEYS`` counted rows; past it the joins shuffle, and adaptive
execution splits the partitions of hot keys.

How sure it is: a pair at 0.75 misses step 2 or 5 only if its union sketch of 64 shows under 27 of
64 in common where 48 are expected (under one in 10^8); a set of at most K shingles is its own
sketch, so it is compared exactly.

Defined cases: a null text or one without a word has no shingle and is linked with nothing; with
fewer than five words the whole sequence is the one shingle; a null doc_id is no smallest id unless
a component has no other; repeated rows fall into one node; very long texts are read whole, one at
a time; columns besides id and text are not read (``keep`` carries them along by place, so their
names may clash with any used here); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WorkerCache, arrow_pass, prepare, text_of

WORDS, K, LEAST, ESTIMATE = 5, 64, 27, 0.45
#: Nodes up to which a list is paired directly, and possible pairs up to which a list of differences is.
SHORT, MANY = 6, 1500
#: Elements of the differences that a block holds on either side.
BLOCK = 200_000
#: A similarity of 75/100 or more links.
PART, WHOLE = 75, 100
#: Node keys (16 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 300_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = WorkerCache(_WordHashes)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes, as signed 64-bit numbers."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_hashes.get().__getitem__, words), np.uint64, len(words))
    n = max(len(h) - WORDS + 1, 1)
    key = np.full(n, min(len(h), WORDS), np.uint64)
    for k in range(min(WORDS, len(h))):
        key = (key ^ (key >> np.uint64(31))) * _M1 + h[k : k + n]
        key = (key ^ (key >> np.uint64(29))) * _M2
    return np.unique((key ^ (key >> np.uint64(32))).view(np.int64))


def _sketches(doc_id, texts):
    sets = [shingle_set(t) for t in texts]
    keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
    return [doc_id, np.array([len(s) for s in sets], np.int64), keys, [s[:K] for s in sets]]


def _alike(n_a, n_b):
    """Sizes that allow the similarity."""
    return (n_a * WHOLE >= n_b * PART) & (n_b * WHOLE >= n_a * PART)


class Finder:
    """The steps above over one table; scratch tables live in the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.spark = docs.sparkSession
        prepare(self.spark)
        self.scratch = Scratch(self.spark, "neardup")
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id; one row for each row of docs. The scratch tables that it reads stay, the others go."""
        cut = self.scratch.cut
        self.found = cut(arrow_pass(self.docs, ["doc_id", "text"], _sketches, "doc_id long, n_shingles long, node binary, sketch array<long>"), "sketches")
        posted = cut(self.postings(), "postings")
        self.nodes = cut(self.one.join(posted.select("node").distinct(), "node", "left_semi"), "nodes")
        lists = cut(posted.groupBy("value").agg(F.min(F.struct("alone", "node"))["node"].alias("head"), F.count("*").alias("nodes")).filter("nodes > 1"), "lists")
        links = self.verified(self.head_pairs(posted, lists), "heads")
        labels = self.joined(links)
        open_ = self.open_lists(posted, lists, labels)
        rest = cut(self.verified(self.short_pairs(open_), "short").unionByName(self.long_links(open_)), "rest")
        if not rest.isEmpty():
            labels = self.joined(links.unionByName(rest))
        parts = self.parts(labels)
        self.scratch.drop_others(self.found, parts)
        out = self.found.select("doc_id", "n_shingles", "node").join(self.small(parts), "node", "left")
        return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

    def small(self, rows: DataFrame) -> DataFrame:
        """Broadcast up to a counted size; rows come from the shared folder, so the count reads no data."""
        return F.broadcast(rows) if rows.count() <= BROADCAST_KEYS else rows

    def postings(self) -> DataFrame:
        """value, node, n of what step 2 posts, and how many hashes the node alone retains."""
        one = self.found.filter("node is not null").groupBy("node").agg(F.min("n_shingles").alias("n"), F.min(F.struct("doc_id", "sketch"))["sketch"].alias("sketch"))
        one = self.one = self.scratch.cut(one, "distinct")
        values = one.select("node", "n", F.explode("sketch").alias("value"))
        lists = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
        shared = values.join(lists, "value")
        # Hashes that one node alone retains are the rarest; they take the first places without being posted.
        size = F.least(F.col("n"), F.lit(K))
        held = shared.groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
        alone = size - F.size("held")
        # Of a set of more than K shingles only K are in its sketch, so a smaller set can miss some of what they share.
        most = F.floor(size * WHOLE / PART)
        common = F.least(F.ceil(size * PART / WHOLE), K - F.floor(most * (WHOLE - PART) / WHOLE))
        least = F.when(F.col("n") > K, F.lit(K - LEAST + 1)).otherwise(size - common + 1)
        kept = F.slice("held", 1, F.greatest(least - alone, F.lit(0)).cast("int"))
        return held.select("node", "n", alone.alias("alone"), F.explode(kept).alias("p")).select("node", "n", "alone", F.col("p.value").alias("value"))

    def head_pairs(self, posted: DataFrame, lists: DataFrame) -> DataFrame:
        """Each node with the head that it meets in most lists, and the two nodes of lists of two."""
        met = posted.join(lists, "value").filter("node != head").groupBy("node", "head").agg(F.count("*").alias("lists"), F.min("nodes").alias("least"))
        heads = met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("lists", "head", "least")), False).alias("heads"))
        chosen = F.filter("heads", lambda x, i: (i == 0) | (x["least"] == 2))
        return heads.select(F.col("node").alias("b"), F.explode(chosen).alias("x")).select(F.col("x.head").alias("a"), "b")

    def open_lists(self, posted: DataFrame, lists: DataFrame, labels: DataFrame) -> DataFrame:
        """value, head, nodes, node, n, part of the lists of three nodes or more that have several components."""
        marked = posted.join(self.small(labels), "node", "left").select("value", "node", "n", F.coalesce("label", "node").alias("part"))
        marked = self.scratch.cut(marked, "marked")
        mixed = marked.groupBy("value").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("c")).filter("p != q and c > 2").select("value")
        mixed = self.scratch.cut(lists.join(mixed, "value", "left_semi"), "mixed")
        return self.scratch.cut(marked.join(self.small(mixed), "value"), "open")

    def short_pairs(self, open_: DataFrame) -> DataFrame:
        few = open_.filter(F.col("nodes") <= SHORT)
        x = few.select("value", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("part").alias("part_a"))
        y = few.select("value", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("part").alias("part_b"))
        pairs = x.join(y, (x["value"] == y["value"]) & (F.col("a") < F.col("b")) & (F.col("part_a") != F.col("part_b")) & _alike(F.col("n_a"), F.col("n_b")))
        return pairs.select("a", "b").distinct()

    def long_links(self, open_: DataFrame) -> DataFrame:
        """Links found in long lists by what sets their nodes apart from the lists' heads."""
        cut = self.scratch.cut
        at = cut(open_.filter((F.col("nodes") > SHORT) & (F.col("node") != F.col("head"))).select("head", "node", "part").distinct(), "by-head")
        if at.isEmpty():
            return self.spark.createDataFrame([], "a binary, b binary")
        sets = self.full_sets(at.select("node").unionByName(at.select(F.col("head").alias("node"))).distinct(), "long")
        heads = at.select(F.col("head").alias("node")).distinct().join(sets, "node").select(F.col("node").alias("head"), F.col("full").alias("of"))
        both = at.join(sets, "node").join(self.small(cut(heads, "head-sets")), "head")
        apart = F.concat(F.array_except("full", "of"), F.array_except("of", "full"))
        near = F.size("apart") * (WHOLE + PART) <= (F.size("full") + F.size("of")) * (WHOLE - PART)
        apart = cut(both.withColumn("apart", apart).select("head", "node", "part", F.size("full").cast("long").alias("n"), F.size("apart").cast("long").alias("d"), near.alias("inside"), "apart"), "apart")
        links = apart.filter("inside").select(F.col("head").alias("a"), F.col("node").alias("b"))
        pairs, many = self.difference_pairs(apart)
        links = links.unionByName(self.verified(pairs, "apart"))
        return links if many.isEmpty() else links.unionByName(self.compared(apart.join(self.small(many), "head")))

    def difference_pairs(self, apart: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs a, b that meet in lists of differences, and the heads with lists that would give over MANY."""
        cut, key = self.scratch.cut, ["head", "value"]
        values = apart.select("head", "node", "part", "n", "d", "inside", F.explode("apart").alias("value"))
        common = values.groupBy(*key).agg(F.count("*").alias("df")).filter("df > 1")
        held = values.join(common, key).groupBy("head", "node").agg(*[F.first(c).alias(c) for c in ("part", "n", "d", "inside")], F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
        # d(A) + d(B) - 2 o <= span for any partner's size; as o <= d(B), o is at least d(A) - span.
        span = F.floor((F.col("n") + F.floor(F.col("n") * WHOLE / PART)) * (WHOLE - PART) / (WHOLE + PART))
        least = F.greatest(F.col("d") - span, F.lit(1))
        held = held.withColumn("s", F.size("held").cast("long")).filter(F.col("s") >= least)
        kept = F.slice("held", 1, F.greatest(F.col("s") - least + 1, F.lit(0)).cast("int"))
        step = F.floor(F.log(F.col("d").cast("double")) * 8).cast("int")
        posted = held.select("head", "node", "part", "n", "d", "s", "inside", step.alias("step"), F.explode(kept).alias("p"))
        posted = cut(posted.withColumn("value", F.col("p.value")).drop("p"), "differences")
        classes = posted.groupBy(*key, "step", "inside").agg(F.min("d").alias("d"), F.max("n").alias("n"), F.max("s").alias("s"), F.count("*").alias("c"))
        classes = cut(classes, "classes")
        x, y = (classes.select(*key, *[F.col(c).alias(f"{c}_{s}") for c in ("step", "inside", "d", "n", "s", "c")]) for s in "xy")
        order = (F.col("step_x") < F.col("step_y")) | ((F.col("step_x") == F.col("step_y")) & (F.col("inside_x") <= F.col("inside_y")))
        met = x.join(y, key).filter(order & ~(F.col("inside_x") & F.col("inside_y")) & _reach("x", "y"))
        same = (F.col("step_x") == F.col("step_y")) & (F.col("inside_x") == F.col("inside_y"))
        met = met.withColumn("pairs", F.when(same, F.col("c_x") * (F.col("c_x") - 1) / 2).otherwise(F.col("c_x") * F.col("c_y"))).filter("pairs > 0")
        met = cut(met.select(*key, "step_x", "inside_x", "step_y", "inside_y", "pairs"), "met")
        sizes = met.groupBy(*key).agg(F.sum("pairs").alias("all"))
        many = cut(sizes.filter(F.col("all") > MANY).select("head").distinct(), "many")
        met = met.join(sizes.filter(F.col("all") <= MANY).select(*key), key, "left_semi").drop("pairs")
        x, y = (posted.select(*key, *[F.col(c).alias(f"{c}_{s}") for c in ("node", "part", "n", "d", "s", "step", "inside")]) for s in "xy")
        apart_still = (F.col("part_x") != F.col("part_y")) & (F.col("node_x") != F.col("node_y")) & _reach("x", "y") & _alike(F.col("n_x"), F.col("n_y"))
        some = met.join(x, [*key, "step_x", "inside_x"]).join(y, [*key, "step_y", "inside_y"]).filter(apart_still)
        pairs = some.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
        return pairs, many

    def compared(self, apart: DataFrame) -> DataFrame:
        """Links between nodes of one head, by their differences from it, in blocks of bounded size that send out links only."""
        rows = self.scratch.cut(apart, "blocks")
        blocks = rows.groupBy("head").agg(F.ceil(F.sum("d") / BLOCK).cast("int").alias("blocks"))
        rows = rows.join(self.small(self.scratch.cut(blocks, "block-counts")), "head").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        rows = rows.withColumn("other", every).withColumn("at", F.least("own", "other")).withColumn("to", F.greatest("own", "other"))
        rows = rows.select("head", "at", "to", "own", "node", "part", "n", "d", "inside", "apart")
        return rows.groupBy("head", "at", "to").applyInPandas(_block_links, "a binary, b binary")

    def verified(self, pairs: DataFrame, tag: str) -> DataFrame:
        """The pairs a, b that reach the similarity: union sketch first, full sets then."""
        pairs = self.scratch.cut(pairs, f"{tag}-pairs")
        if pairs.isEmpty():
            return pairs
        side = lambda s: self.nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"))
        held = pairs.join(side("a"), "a").join(side("b"), "b")
        union = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, K)
        both = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
        whole = (F.col("n_a") <= K) & (F.col("n_b") <= K)
        shared = F.size(F.array_intersect("s_a", "s_b"))
        exact = shared * WHOLE >= (F.col("n_a") + F.col("n_b") - shared) * PART
        sure = F.when(whole, exact)
        likely = F.when(whole, exact).otherwise((both >= F.lit(ESTIMATE) * F.size(union)) & _alike(F.col("n_a"), F.col("n_b")))
        kept = self.scratch.cut(held.filter(likely).select("a", "b", "n_a", "n_b", sure.alias("sure")), f"{tag}-likely")
        done, open_ = kept.filter("sure").select("a", "b"), kept.filter("sure is null")
        if open_.isEmpty():
            return done
        sets = self.full_sets(open_.select(F.col("a").alias("node")).unionByName(open_.select(F.col("b").alias("node"))).distinct(), tag)
        full = open_.join(sets.select(F.col("node").alias("a"), F.col("full").alias("f_a")), "a")
        full = full.join(sets.select(F.col("node").alias("b"), F.col("full").alias("f_b")), "b")
        common = F.size(F.array_intersect("f_a", "f_b"))
        links = full.filter(common * WHOLE >= (F.col("n_a") + F.col("n_b") - common) * PART).select("a", "b")
        return self.scratch.cut(done.unionByName(links), f"{tag}-links")

    def full_sets(self, keys: DataFrame, tag: str) -> DataFrame:
        """node, full: the whole set of each node, from the text of one of its documents."""
        keys = self.scratch.cut(keys, f"{tag}-keys")
        one = self.found.join(self.small(keys), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        one = self.small(self.scratch.cut(one, f"{tag}-ids"))
        texts = self.docs.join(one, self.docs["doc_id"].eqNullSafe(one["doc_id"])).select("node", "text")
        sets = arrow_pass(texts, ["node", "text"], _keyed_sets, "node binary, full array<long>").filter("full is not null")
        return self.scratch.cut(sets.dropDuplicates(["node"]), f"{tag}-sets")

    def joined(self, links: DataFrame) -> DataFrame:
        """node, label of every node in a link: the least node that it reaches.

        Rounds of passing the least label to neighbours and then to the label's own label, until no
        label changes. A label's label halves the distance that is left, so rounds stay few.
        """
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        both = self.scratch.cut(both, "edges")
        labels = self.scratch.cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
        while True:
            at = self.small(labels.select("node", "label"))
            near = both.join(at.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
            step = near.join(at, "node").select("node", F.least("label", "near").alias("next"), "label")
            jump = at.select(F.col("node").alias("next"), F.col("label").alias("far"))
            moved = step.join(jump, "next").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") != F.col("label")).alias("moved"))
            labels = self.scratch.cut(moved, "labels")
            if labels.filter("moved").isEmpty():
                return labels.select("node", "label")

    def parts(self, labels: DataFrame) -> DataFrame:
        """node, component_id of nodes in links or of several documents; any other document is its own component."""
        least = self.found.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("docs"))
        part = least.join(self.small(labels), "node", "left").filter("label is not null or docs > 1")
        part = self.scratch.cut(part.select("node", "least", F.coalesce("label", "node").alias("label")), "part")
        smallest = self.scratch.cut(part.groupBy("label").agg(F.min("least").alias("component_id")), "smallest")
        return self.scratch.cut(part.join(self.small(smallest), "label").select("node", "component_id"), "components")


def _reach(x: str, y: str):
    """Sizes of differences at which two nodes of these sizes can still be linked, however much they share."""
    span = (F.col(f"n_{x}") + F.col(f"n_{y}")) * (WHOLE - PART) / (WHOLE + PART)
    return F.col(f"d_{x}") + F.col(f"d_{y}") <= span + 2 * F.least(F.col(f"s_{x}"), F.col(f"s_{y}"))


def _block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks of one head's nodes (or inside one): of each node one link to every component it reaches."""
    at, to = rows["at"].iat[0], rows["to"].iat[0]
    own, others = rows[rows["own"] == at].reset_index(drop=True), rows[rows["own"] == to]
    a, b = [], []
    if len(own) and len(others):
        sizes, apart, inside = own["n"].to_numpy(np.int64), own["d"].to_numpy(np.int64), own["inside"].to_numpy(bool)
        values = np.concatenate([np.asarray(x, np.int64) for x in own["apart"]])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(own)), apart)[order]
        names, parts = own["node"].tolist(), own["part"].astype("category").cat
        codes, of = parts.codes.to_numpy(), {p: i for i, p in enumerate(parts.categories)}
        for node, part, n, d, near, mine in zip(others["node"], others["part"], others["n"], others["d"], others["inside"], others["apart"], strict=True):
            mine = np.asarray(mine, np.int64)
            lo, hi = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            each = hi - lo
            met = np.repeat(lo - (np.cumsum(each) - each), each) + np.arange(each.sum())
            same = np.bincount(owner[met], minlength=len(own))
            linked = ((apart + d - 2 * same) * (WHOLE + PART) <= (sizes + n) * (WHOLE - PART)) & (codes != of.get(part, -1))
            if near:
                linked &= ~inside
            hits = np.flatnonzero(linked)
            for i in hits[np.unique(codes[hits], return_index=True)[1]]:
                a.append(names[i])
                b.append(node)
    return pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object)})


def _keyed_sets(keys, texts):
    """A repeated doc_id may bring another text; only the one that makes the key counts."""
    sets = [shingle_set(t) for t in texts]
    same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k for s, k in zip(sets, keys)]
    return [keys, [s if ok else None for s, ok in zip(sets, same)]]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each row of docs."""
    out = Finder(docs, id_col, text_col).components()
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all its columns: the one of the smallest id. Rows that repeat that id all stay."""
    finder = Finder(docs, id_col, text_col)
    found = finder.components()
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone")).distinct()
    gone = finder.scratch.cut(gone, "gone")
    finder.scratch.drop_others(gone)
    inner = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    at = f"_c{docs.columns.index(id_col)}"
    kept = inner.join(finder.small(gone), F.col(at).cast("long") == F.col("_gone"), "left_anti")
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
