"""Exact join of documents whose word-shingle sets have a Jaccard similarity of at least num / den.

1. Documents with the same set are one node; the node is the least of their ids.
2. Sets of similar size are cut by hash range into more segments than two similar sets can differ in
   elements, so similar sets agree on a whole segment. The segment hashes say which nodes may have
   partners at all; a frequent shingle alone makes no candidates.
3. The token-group matrix: such nodes are dealt to groups of at most ``group_size`` similar ones (by
   their most shared segment). A group has the union of its members' shingles and a row of bits for
   each member. A query set that shares a segment with a group is compared with the union first; only
   if that overlap can reach the threshold is the group opened and each member counted.
4. Links that join a new pair of parts within a group are kept, and the components of all links found.
5. A set asks the first of its groups, and after that only those that hold a member it is not yet
   connected with.

No pair list of a group of copies is made: queries meet groups, not members, one after the other in
a task's stream, and a group with very many queries is copied to several tasks.

Cases: a text with fewer words than a shingle is one shingle; without words, or null, it has none and
links with nothing; a null id gets a null component; rows that repeat an id are one document (each row
with its own n_shingles); extra columns are not read unless named; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .components import components
from .staging import stage
from .textbytes import LOWER, Chunk, by_doc, chunks, grams, mix, span_hashes, words

#: Bytes of words: everything but blanks.
WORD = np.ones(256, bool)
WORD[[32, *range(9, 14)]] = False

MAP_BITS = 23
ROWS = 1_024  # bit rows that are counted at once
STEP = 1.5  # size classes grow by this factor


@dataclass(frozen=True)
class Rule:
    """Sets of shingles of ``words`` words, linked from num / den (two thirds at least)."""

    words: int = 3
    num: int = 90
    den: int = 100

    def similar(self, inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * inter >= self.num * (a + b - inter)


def shingle_sets(chunk: Chunk, rule: Rule, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(document, sorted distinct shingle hashes) of the chunk's documents that have words."""
    data = LOWER[chunk.data]
    starts, ends, docs = words(Chunk(chunk.first, chunk.last, data, chunk.offsets), WORD)
    hashes, n_docs = span_hashes(data, starts, ends), chunk.last - chunk.first
    begin = by_doc(docs, n_docs)
    found, at = grams(hashes, docs, rule.words)
    cut = by_doc(docs[at], n_docs)
    for i in range(n_docs) if wanted is None else np.flatnonzero(wanted):
        if cut[i + 1] > cut[i]:
            yield int(i), np.unique(found[cut[i] : cut[i + 1]])
        elif begin[i + 1] > begin[i]:
            few = slice(begin[i], begin[i + 1])
            yield int(i), grams(hashes[few], docs[few], int(begin[i + 1] - begin[i]))[0]


def size_class(n: int) -> tuple[int, int]:
    """The class of a set of n shingles, and the greatest size in that class."""
    c, top = 0, 8
    while top < n:
        c, top = c + 1, int(top * STEP)
    return c, top


def signatures(s: np.ndarray, rule: Rule) -> tuple[np.ndarray, int]:
    """Hashes of the segments of a set, in its own size class and in the next if a partner can be there; how many it shares with any partner at least.

    In a class with ``d`` as the greatest possible difference there are d + 1 + spare segments. Each
    filled segment of a set in which a partner differs takes a differing element, so a set with more
    filled segments than it can differ from any partner in the class agrees on a filled one. Empty
    segments tell little and are left out for such sets; a pair of others has them on both sides.
    """
    out, needs, n, total = [], [], len(s), np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s), out=total[1:])
    high = s >> np.uint64(32)
    most = n * rule.den // rule.num  # the size of the largest partner
    for c, top in sorted({size_class(n), size_class(most)}):
        d = 2 * top * (rule.den - rule.num) // (rule.den + rule.num)
        if d:
            m = d + 2 + d // 8
            cuts = np.searchsorted(high, (np.arange(m + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(m))
            part = mix(total[cuts[1:]] - total[cuts[:-1]] + np.uint64(c << 32) + np.arange(m, dtype=np.uint64))
            full = cuts[1:] > cuts[:-1]
            differing = (n + min(top, most)) * (rule.den - rule.num) // (rule.den + rule.num)
            out.append(part[full] if full.sum() > differing else part)
            needs.append(max(1, int(full.sum()) - differing))
    return (np.concatenate(out), min(needs)) if out else (np.zeros(0, np.uint64), 1)


def described(docs: DataFrame, id_col: str, text_col: str, rule: Rule) -> DataFrame:
    """(_id, n_shingles, need, k1, k2, signatures): k1 and k2 are 128 bits for the whole set, null without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes, needs, keys, known, parts = np.zeros(n, np.int64), np.ones(n, np.int32), np.zeros((2, n), np.uint64), np.zeros(n, bool), [np.zeros(0, np.uint64)] * n
            for chunk in chunks(batch.column("_text")):
                for i, s in shingle_sets(chunk, rule):
                    at = chunk.first + i
                    sizes[at], known[at] = len(s), True
                    keys[0, at], keys[1, at] = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
                    parts[at], needs[at] = signatures(s, rule)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes), pa.array(needs), *[pa.array(k.view(np.int64), mask=~known) for k in keys], lists], names=["_id", "n_shingles", "need", "k1", "k2", "signatures"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, n_shingles bigint, need int, k1 bigint, k2 bigint, signatures array<bigint>")


def chosen_sets(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, rule: Rule) -> DataFrame:
    """(node, k1, k2, members): the sets of ``nodes`` and few others, read from the texts again.

    A bitmap of 2 ** MAP_BITS bits spares most other documents the work; the caller's join decides.
    """
    bit = F.shiftrightunsigned(F.xxhash64("node"), 64 - MAP_BITS)
    rows = nodes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("mask")).toPandas()
    packed = np.zeros(1 << (MAP_BITS - 6), np.int64)
    packed[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("_bit").to_numpy()
            batch = batch.filter(pa.array((packed[bit >> 6] >> (bit & 63)) & 1 == 1))
            for chunk in chunks(batch.column("_text")):
                at, sets, keys = [], [], []
                for i, s in shingle_sets(chunk, rule):
                    at.append(chunk.first + i)
                    keys.append((mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)))
                    sets.append(s.tobytes())
                both = np.array(keys, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(at, pa.int64())), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(sets, pa.binary())], names=["_id", "k1", "k2", "members"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.shiftrightunsigned(F.xxhash64(id_col), 64 - MAP_BITS).alias("_bit"), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, f"_id {kind}, k1 bigint, k2 bigint, members binary").withColumnRenamed("_id", "node")


def dealt(nodes: DataFrame, group_size: int, group_shingles: int) -> DataFrame:
    """(node, gid): runs of neighbours in the order of their most shared segment, cut where it changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, last, count, size = TaskContext.get().partitionId() << 40, None, 0, 0
        for batch in batches:
            ids = []
            for top, n in zip(batch.column("top").to_pylist(), batch.column("n").to_pylist()):
                if top != last or count >= group_size or size + n > group_shingles:
                    gid, last, count, size = gid + 1, top, 0, 0
                count, size = count + 1, size + n
                ids.append(gid)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(ids, pa.int64())], names=["node", "gid"])

    kind = nodes.schema["node"].dataType.simpleString()
    return nodes.select("node", "top", "n").orderBy("top", "node").mapInArrow(run, f"node {kind}, gid bigint")


class Group:
    """The token-group matrix of one group: all shingles of its members, and who has which."""

    def __init__(self, rule: Rule):
        self.rule, self.nodes, self.sets, self.parts = rule, [], [], {}

    def add(self, node, s: np.ndarray) -> None:
        self.nodes.append(node)
        self.sets.append(s)

    def close(self) -> None:
        self.sizes = np.array([len(s) for s in self.sets])
        self.union, where = np.unique(np.concatenate(self.sets), return_inverse=True)
        member = np.repeat(np.arange(len(self.sets)), self.sizes)
        self.bits = np.zeros((len(self.union), (len(self.sets) + 7) // 8), np.uint8)  # eight members a byte
        np.bitwise_or.at(self.bits, (where, member >> 3), (1 << (member & 7)).astype(np.uint8))

    def part(self, node):
        while (up := self.parts.get(node, node)) != node:
            node = up
        return node

    def links(self, node, s: np.ndarray, upto: int) -> list[tuple]:
        """Links of a query set with the first ``upto`` members that join parts not yet joined here."""
        at = np.searchsorted(self.union, s)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == s]
        if self.rule.den * len(at) < self.rule.num * len(s):  # no member can share enough
            return []
        inter = np.zeros(8 * self.bits.shape[1], np.int64)
        for k in range(0, len(at), ROWS):
            inter += np.unpackbits(self.bits[at[k : k + ROWS]], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        inter = inter[:upto]
        out = []
        for i in np.flatnonzero(self.rule.similar(inter, len(s), self.sizes[:upto])):
            a, b = self.part(self.nodes[i]), self.part(node)
            if a != b:
                self.parts[a] = b
                out.append((node, self.nodes[i]))
        return out


def matched(rows: DataFrame, rule: Rule) -> DataFrame:
    """Links (u, v) from rows (gid, salt, kind, node, k1, members), members of a group before its queries; repeated rows count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key, filling, last = Group(rule), None, False, None

        def closed() -> list[tuple]:
            if not filling:
                return []
            group.close()
            return [x for i, s in enumerate(group.sets) if i for x in group.links(group.nodes[i], s, i)] if key[1] == 0 else []

        for batch in batches:
            links = []
            for gid, salt, kind, node, k1, members in zip(*[batch.column(c).to_pylist() for c in ("gid", "salt", "kind", "node", "k1")], batch.column("members")):
                if last == (last := (gid, salt, kind, node, k1)):
                    continue
                if (gid, salt) != key:
                    links += closed()
                    group, key, filling = Group(rule), (gid, salt), True
                s = np.frombuffer(members.as_buffer(), np.uint64)
                if kind == 0:
                    group.add(node, s.copy())
                else:
                    links += closed()
                    filling = False
                    links += group.links(node, s, len(group.nodes))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], out_type) for i in (0, 1)], names=["u", "v"])
        if key is not None:
            links = closed()
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], out_type) for i in (0, 1)], names=["u", "v"])

    kind = rows.schema["node"].dataType.simpleString()
    out_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    ordered = rows.repartition("gid", "salt").sortWithinPartitions("gid", "salt", "kind", "node", "k1")
    return ordered.mapInArrow(run, f"u {kind}, v {kind}")


def opened(docs: DataFrame, id_col: str, text_col: str, nodes: DataFrame, groups: DataFrame, queries: DataFrame, rule: Rule, queries_per_task: int) -> DataFrame:
    """Links (u, v) within the groups (node, gid) and of queries (node, gid) with them."""
    salts = stage(queries.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / queries_per_task).cast("int").alias("salts")), "salts")
    sizes = groups.groupBy("gid").agg(F.count(F.lit(1)).alias("size")).join(salts, "gid", "left").where("size > 1 or salts is not null")
    members = groups.join(sizes, "gid").select("node", "gid", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"), F.lit(0).alias("kind"))
    asked = queries.join(salts, "gid").select("node", "gid", F.pmod(F.hash("node"), F.col("salts")).alias("salt"), F.lit(1).alias("kind"))
    places = stage(members.unionByName(asked).join(nodes.select("node", "k1", "k2"), "node"), "places")
    sets = chosen_sets(docs, id_col, text_col, places, rule)
    return matched(places.join(sets, ["node", "k1", "k2"]), rule)


def similar_parts(docs: DataFrame, id_col: str, text_col: str, rows: DataFrame, nodes: DataFrame, rule: Rule, group_size: int, group_shingles: int, queries_per_task: int) -> DataFrame:
    """(node, root) for every node with a link; rows: described(), nodes: node, k1, k2, n, need."""
    own = nodes.select("node", F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    same = (F.col("_id") == F.col("node")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    by = W.partitionBy("signature")
    every = rows.join(own, same, "left_semi").select(F.col("_id").alias("node"), F.explode("signatures").alias("signature"))
    every = every.select("node", "signature", F.min("node").over(by).alias("_a"), F.max("node").over(by).alias("_b"), F.count(F.lit(1)).over(by).alias("_n"))
    shared = stage(every.where("_a < _b").select("node", "signature", "_n"), "shared")
    tops = shared.groupBy("node").agg(F.max(F.struct("_n", "signature")).alias("_top")).join(nodes.select("node", "n"), "node")
    tops = tops.select("node", "n", F.col("_top.signature").alias("top")).dropDuplicates(["node"])
    groups = stage(dealt(tops, group_size, group_shingles), "groups")
    placed = stage(shared.select("node", "signature").join(groups, "node"), "placed")
    blocks = stage(placed.groupBy("signature").agg(F.collect_set("gid").alias("others")), "blocks")
    asked = placed.join(blocks, "signature").select("node", F.filter("others", lambda g: g < F.col("gid")).alias("others")).where(F.size("others") > 0)
    asked = asked.groupBy("node").agg(F.sort_array(F.flatten(F.collect_list("others"))).alias("met"))
    enough = F.array_distinct(F.filter("met", lambda g, i: F.get("met", i + F.col("need") - 1) == g))
    asked = asked.join(nodes.groupBy("node").agg(F.min("need").alias("need")), "node").select("node", enough.alias("others"))
    asked = stage(asked.where(F.size("others") > 0), "asked")
    first = asked.select("node", F.element_at("others", 1).alias("gid"))
    parts = components(stage(opened(docs, id_col, text_col, nodes, groups, first, rule, queries_per_task), "links"))
    rooted = stage(groups.join(parts, "node", "left").select("node", "gid", F.coalesce("root", "node").alias("root")), "rooted")
    spans = stage(rooted.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high")), "spans")
    later = asked.where(F.size("others") > 1).select("node", F.explode(F.slice("others", F.lit(2), F.size("others"))).alias("gid"))
    later = later.join(rooted.select("node", "root"), "node").join(spans, "gid").where("low < root or high > root").select("node", "gid").distinct()
    later = stage(later, "later")
    met = groups.join(later.select("gid").distinct(), "gid", "left_semi")
    more = opened(docs, id_col, text_col, nodes, met, later, rule, queries_per_task)
    joined = rooted.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    return components(stage(joined.unionByName(more), "links"))


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rule: Rule = Rule(),
    group_size: int = 256,
    group_shingles: int = 262_144,
    queries_per_task: int = 2_048,
) -> DataFrame:
    """One row per document: id, n_shingles and component_id, the least id it reaches by links."""
    rows = stage(described(docs, id_col, text_col, rule), "described")
    known = rows.where("_id is not null and k1 is not null")
    nodes = stage(known.groupBy("k1", "k2").agg(F.min("_id").alias("node"), F.first("n_shingles").alias("n"), F.first("need").alias("need")), "nodes")
    roots = similar_parts(docs, id_col, text_col, rows, nodes, rule, group_size, group_shingles, queries_per_task)
    labels = stage(nodes.select("k1", "k2", "node").join(roots, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("component_id")), "labels")
    found = rows.drop("signatures", "need").join(labels, ["k1", "k2"], "left")
    own = F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id"))
    return found.select(F.col("_id").alias(id_col), "n_shingles", own.alias("component_id"))
