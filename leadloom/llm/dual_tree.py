"""Ranked lexical search of many queries at once: a dual tree over items and documents.

Documents become vectors of term impacts over the items' terms and are laid next to documents with the same weightiest
terms.  Each task cuts its share into batches and builds a tree of coordinate maxima over each; the items have a tree of
maximal weights.  The product of two nodes' maxima bounds every score between them, so a pair of nodes whose bound lies
under the weakest k-th score of its items is left, with all documents and items below, and nothing is lost.

Two rounds share what tasks cannot: in the first each task scores its most promising documents for every item, and the
k-th best score of all tasks is a floor for the second, exact one.  All scores are whole numbers.

Items are taken in blocks of at most about ``BLOCK_TERMS`` words, whose terms every task holds; one longer item is a block.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom.llm.common import in_blocks, parts
from leadloom.session import stage

TOP = 20
BLOCK_TERMS = 200_000
BATCH, LEAF, FAN = 2048, 32, 8
ITEM_LEAF = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Impacts stay under a million, and float64 holds whole numbers under 2**53: weights up to this sum are exact in it.
MOST_IMPACT = 1_000_000
EXACT_SUM = (1 << 53) // MOST_IMPACT


class Node:
    """Items with alike terms: ``terms`` sorted, ``most`` the largest weight of each among the items below."""

    def __init__(self, items: list[int], weights: list[dict[int, int]], below: list[Node]) -> None:
        self.items, self.below = items, below
        largest: Counter = Counter()
        for i in items:
            for term, weight in weights[i].items():
                largest[term] = max(largest[term], weight)
        kind = np.float64 if sum(largest.values()) < EXACT_SUM else np.int64
        self.terms = np.array(sorted(largest), np.int64)
        self.most = np.array([largest[t] for t in self.terms.tolist()], kind)
        self.matrix = None
        if not below:
            column = {t: c for c, t in enumerate(self.terms.tolist())}
            self.matrix = np.zeros((len(self.terms), len(items)), kind)
            for row, i in enumerate(items):
                for term, weight in weights[i].items():
                    self.matrix[column[term], row] = weight


def item_tree(weights: list[dict[int, int]], leaf: int = ITEM_LEAF, fan: int = 4) -> Node:
    """A tree over items, those with the same weightiest terms side by side."""
    heavy = lambda i: sorted(weights[i], key=lambda t: (-weights[i][t], t))[:4]
    order = sorted(range(len(weights)), key=heavy)
    level = [Node(order[at : at + leaf], weights, []) for at in range(0, len(order), leaf)]
    while len(level) > 1:
        level = [Node([i for n in level[at : at + fan] for i in n.items], weights, level[at : at + fan]) for at in range(0, len(level), fan)]
    return level[0]


class Batch:
    """Documents in a row as sparse impacts, with a tree of coordinate maxima: leaves, nodes of ``FAN`` leaves, the whole."""

    def __init__(self, ids: list, terms: list[bytes], impacts: list[bytes], n_terms: int) -> None:
        self.ids = ids
        self.sizes = np.array([len(t) // 4 for t in terms])
        self.ends = np.cumsum(self.sizes)
        self.terms = np.frombuffer(b"".join(terms), np.int32).astype(np.int64)
        self.impacts = np.frombuffer(b"".join(impacts), np.int32).astype(np.int64)
        leaf_of = np.repeat(np.arange(len(ids)) // LEAF, self.sizes)
        most = np.zeros((-(-len(ids) // LEAF), n_terms), np.int64)
        np.maximum.at(most.reshape(-1), leaf_of * n_terms + self.terms, self.impacts)
        self.levels = [most]
        while len(self.levels[0]) > 1:
            self.levels.insert(0, np.maximum.reduceat(self.levels[0], np.arange(0, len(self.levels[0]), FAN), axis=0))

    def scores(self, leaves: np.ndarray, node: Node) -> tuple[np.ndarray, np.ndarray]:
        """Documents of some leaves, and their scores with the items of a leaf node."""
        docs = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        docs = docs[docs < len(self.ids)]
        sizes = self.sizes[docs]
        row = np.repeat(np.arange(len(docs)), sizes)
        at = np.repeat(self.ends[docs] - np.cumsum(sizes), sizes) + np.arange(len(row))
        terms = self.terms[at]
        column = np.minimum(np.searchsorted(node.terms, terms), len(node.terms) - 1)
        known = node.terms[column] == terms
        dense = np.zeros((len(docs), len(node.terms)), node.matrix.dtype)
        dense[row[known], column[known]] = self.impacts[at[known]]
        return docs, dense @ node.matrix


class Search:
    """The best documents met so far for every item, and the walk over pairs of nodes."""

    def __init__(self, tree: Node, floors: dict[int, int], top: int) -> None:
        self.tree, self.top = tree, top
        self.best: list[list[tuple]] = [[] for _ in tree.items]
        self.weakest = np.array([floors.get(i, 1) for i in range(len(tree.items))], np.int64)
        self.met = 0  # documents scored, over all item leaves

    def take(self, batch: Batch, leaves: np.ndarray, node: Node) -> None:
        docs, scores = batch.scores(leaves, node)
        self.met += len(docs)
        for row, column in zip(*np.nonzero(scores >= self.weakest[node.items])):
            item, score, doc = node.items[column], int(scores[row, column]), batch.ids[docs[row]]
            if score < self.weakest[item]:
                continue
            found = self.best[item]
            insort(found, (-score, doc is None, 0 if doc is None else doc))
            if len(found) > self.top:
                found.pop()
            if len(found) == self.top:
                self.weakest[item] = max(self.weakest[item], -found[-1][0])

    def bounds(self, batch: Batch, level: int, nodes: np.ndarray, node: Node) -> np.ndarray:
        return batch.levels[level][np.ix_(nodes, node.terms)].astype(node.most.dtype) @ node.most

    def walk(self, batch: Batch, level: int, nodes: np.ndarray, node: Node) -> None:
        """Go down from pairs of document nodes and an item node, the larger side first; leave those that cannot matter."""
        nodes = nodes[self.bounds(batch, level, nodes, node) >= self.weakest[node.items].min()]
        if not len(nodes):
            return
        last = level == len(batch.levels) - 1
        if last and not node.below:
            self.take(batch, nodes, node)
        elif node.below and (last or level > 0):
            for child in node.below:
                self.walk(batch, level, nodes, child)
        else:
            children = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            self.walk(batch, level + 1, children[children < len(batch.levels[level + 1])], node)

    def promise(self, batch: Batch, node: Node) -> None:
        """Score the documents of the leaf with the highest bound for each item leaf."""
        for child in node.below:
            self.promise(batch, child)
        if not node.below:
            last = len(batch.levels) - 1
            bound = self.bounds(batch, last, np.arange(len(batch.levels[last])), node)
            self.take(batch, np.array([int(bound.argmax())]), node)

    def whole(self, batch: Batch) -> None:
        self.walk(batch, 0, np.arange(1), self.tree)


def _vectors(known: dict[bytes, int]):
    """Per text: number of words, and its known terms with their counts, as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sizes, terms, counts = [], [], []
            for text in batch.column("text").to_pylist():
                words = text.translate(FOLDED).split()
                term, count = np.unique(np.array([known[w] for w in words if w in known], np.int32), return_counts=True)
                sizes.append(len(words))
                terms.append(term.tobytes())
                counts.append(count.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], names=["id", "n", "terms", "tf"]
            )

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the share that hold each term, one row a term."""
    held = np.zeros(0, np.int64)
    for batch in batches:
        add = np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=len(held))
        add[: len(held)] += held
        held = add
    term = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(held[term], pa.int64())], names=["term", "df"])


def _impacts(weights: np.ndarray, n_docs: int, n_words: int):
    """Term counts as impacts, and the two weightiest terms to lay documents by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, first, second = [], [], []
            for n, terms, counts in zip(*(batch.column(c).to_pylist() for c in ("n", "terms", "tf"))):
                term, tf = np.frombuffer(terms, np.int32), np.frombuffer(counts, np.int32).astype(np.int64)
                norm = 75 + 25 * n * n_docs // n_words
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * norm)
                heavy = term[np.lexsort((term, -weights[term] * impact))[:2]].tolist() + [-1, -1]
                out.append(impact.astype(np.int32).tobytes())
                first.append(heavy[0])
                second.append(heavy[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("terms"), pa.array(out, pa.binary()), pa.array(first, pa.int32()), pa.array(second, pa.int32())],
                names=["id", "terms", "impacts", "first", "second"],
            )

    return run


def _searched(tree, floors: dict[int, int], top: int, n_terms: int, exact: bool):
    """The best documents of a share for every item; not exact: of its most promising leaves."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
        held: tuple[list, list, list] = ([], [], [])
        for batch in parts(batches):
            for kept, column in zip(held, ("id", "terms", "impacts")):
                kept.extend(batch.column(column).to_pylist())
            while len(held[0]) >= BATCH:
                yield Batch(*(kept[:BATCH] for kept in held), n_terms)
                held = tuple(kept[BATCH:] for kept in held)
        if held[0]:
            yield Batch(*held, n_terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        search, kind = Search(tree.value, floors, top), first.schema.field("id").type
        for batch in batches_of(chain([first], batches)):
            if exact:
                search.whole(batch)
            else:
                search.promise(batch, search.tree)
        rows = [(item, None if null else doc, -score) for item, found in enumerate(search.best) for score, null, doc in found]
        item, doc, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, kind), pa.array(score, pa.int64())], names=["place", "doc", "score"])

    return run


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """``item, rank, doc, score``: the ``top`` documents with the highest score above 0 for every row of ``items``.

    Equal scores go by ascending id, null ids last.  Rows that repeat an id, of documents or of items, stand for themselves.
    Texts that are null or without terms match nothing and do not count; an empty table on either side gives no rows.
    """
    found = F.regexp_extract_all(F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))
    listed = items.select(F.col(f"`{item_col}`").alias("item"), found.alias("words")).withColumn("n", F.size("words")).filter("n > 0")
    listed = stage(listed.withColumn("place", F.monotonically_increasing_id()), "search-items")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    out = None
    for block in in_blocks(listed, "place", block_terms):
        asked = block.select("place", "words").collect()  # at most block_terms words, or one item
        if not asked:
            continue
        ranked = _search_block(rows, [(r.place, [w.encode() for w in r.words]) for r in asked], top)
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        out = rows.limit(0).select(F.lit(0).cast("long").alias("place"), F.col("id").alias("doc"), F.lit(0).cast("long").alias("score"))
    place = F.row_number().over(W.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    best = out.withColumn("rank", place).filter(F.col("rank") <= top)
    return best.join(listed.select("place", "item"), "place").select("item", "rank", "doc", "score")


def _search_block(rows: DataFrame, items: list[tuple[int, list[bytes]]], top: int) -> DataFrame:
    """``place, doc, score``: candidates of the exact round, at most ``top`` per item and task, staged."""
    spark = rows.sparkSession
    known = {w: k for k, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
    shape = rows.select("id", F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("terms"), F.lit(None).cast("binary").alias("tf")).schema
    vectors = stage(rows.mapInArrow(_vectors(known), shape).filter("n > 0"), "search-vectors")
    n_docs, n_words = vectors.agg(F.count("*"), F.sum("n")).first()
    df = vectors.select("terms").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    held = dict(df.collect())  # one row per term of the block
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(k, 0) + 1))) for k in range(len(known))]
    counted = [Counter(known[w] for w in words) for _, words in items]
    tree = spark.sparkContext.broadcast(item_tree([{t: weight[t] * times for t, times in c.items()} for c in counted]))

    shape = vectors.select("id", "terms", F.col("tf").alias("impacts"), F.lit(0).alias("first"), F.lit(0).alias("second")).schema
    near = vectors.filter("length(terms) > 0").mapInArrow(_impacts(np.array(weight, np.int64), n_docs, n_words or 1), shape)
    laid = near.repartitionByRange(F.col("first"), F.col("second"), F.xxhash64("terms", "id")).sortWithinPartitions("first", "second")
    laid = stage(laid.select("id", "terms", "impacts"), "search-laid")

    shape = laid.select(F.lit(0).cast("long").alias("place"), F.col("id").alias("doc"), F.lit(0).cast("long").alias("score")).schema
    run = lambda floors, exact: laid.mapInArrow(_searched(tree, floors, top, len(known), exact), shape)
    by_score = F.row_number().over(W.partitionBy("place").orderBy(F.desc("score")))
    kth = run({}, False).select("place", "score").withColumn("rank", by_score).filter(F.col("rank") == top)
    floors = {r.place: r.score for r in kth.collect()}  # one row per item of the block
    places = spark.createDataFrame([(k, place) for k, (place, _) in enumerate(items)], "k long, place long")
    best = run(floors, True).withColumnRenamed("place", "k").join(places, "k").select("place", "doc", "score")
    return stage(best, "search-best")
