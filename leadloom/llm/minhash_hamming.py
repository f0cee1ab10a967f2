"""Near duplicates: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full shingle sets.

A signature is split into chunks.  Two signatures within ``chunks * (errors + 1) - 1`` differing positions agree, by the
pigeonhole principle, on some chunk up to ``errors`` positions; every way to leave those positions out of every chunk is
enumerated as a key, so all such pairs share a key.  With 10 chunks of 5 and one error, a pair at similarity 0.85 shares
no key with a probability of 1.5e-8, one at 0.8 with 1.6e-6.

Pairs that share a key are not enumerated where many documents do.  Small buckets give their pairs; in larger ones each
member is first confirmed against one hub.  What then still falls into several components is compared on the full sets
block by block inside tasks; only links that join components leave them, so a crowd gives fewer links than it has members.
Every step is exact, whatever the size of a bucket.

Nodes of the graph are distinct shingle sets, so copies meet only in a combined count.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import id_and_text, parts, row_key, sha
from leadloom.llm.components import components
from leadloom.llm.word_hashes import SPREAD, WordHasher, mixed, runs
from leadloom.session import stage

WIDTH = 5
PERCENT = 85
CHUNKS, CHUNK, ERRORS = 10, 5, 1
POSITIONS = 128
#: Buckets up to this size give all their pairs; larger ones go by hub and block. Results are the same either way.
SMALL = 16
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
MARK_BUCKETS = 1 << 20


def shingles(hasher: WordHasher, text: str, width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted."""
    return np.unique(runs(hasher.of(text), width))


def _factors(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * SPREAD) | np.uint64(1)


def signature(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash positions: the least multiple of any shingle, per factor."""
    least = np.full(len(factors), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * factors).min(axis=0), out=least)
    return mixed(least)


def chunk_keys(values: np.ndarray, chunks: int = CHUNKS, size: int = CHUNK, errors: int = ERRORS) -> np.ndarray:
    """Keys of many signatures, one row each: every chunk with every choice of ``errors`` positions left out."""
    columns = []
    for c in range(chunks):
        part = values[:, c * size : (c + 1) * size]
        for gone in combinations(range(size), errors):
            key = np.full(len(values), np.uint64(c << size | sum(1 << g for g in gone)))
            for p in set(range(size)).difference(gone):
                key = mixed(key * SPREAD + part[:, p])
            columns.append(key)
    return np.stack(columns, axis=1)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_sha, n, node, sig, keys`` per row: shingle count, 128-bit set hash, one byte per position, chunk keys.

    Texts without a word have n = 0, a null node and no keys.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("text_sha", sha(F.col("text")))
    none = lambda kind: F.lit(None).cast(kind)
    schema = rows.select("id", "text_sha", F.lit(0).cast("long").alias("n"), none("binary").alias("node"), none("binary").alias("sig"), none("array<long>").alias("keys")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, factors = WordHasher(), _factors(POSITIONS)
        for batch in parts(batches):
            sets = [shingles(hasher, t) for t in batch.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            values = np.array([signature(sets[i], factors) for i in full], np.uint64).reshape(-1, POSITIONS)
            keys = chunk_keys(values & np.uint64(0xFFFF)).view(np.int64)
            sigs = (values & np.uint64(0xFF)).astype(np.uint8)
            at = {i: k for k, i in enumerate(full)}
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("text_sha"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([sigs[at[i]].tobytes() if i in at else None for i in range(len(sets))], pa.binary()),
                    pa.array([keys[at[i]] if i in at else None for i in range(len(sets))], pa.list_(pa.int64())),
                ],
                names=["id", "text_sha", "n", "node", "sig", "keys"],
            )

    return rows.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, nodes: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``node, shingles`` of the wanted ``id, node`` rows, built anew from the texts.

    Texts whose id is certainly not wanted are left out before they are read into words: the set of wanted id buckets
    holds at most ``2**20`` numbers at any input size.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("mark", F.pmod(F.xxhash64("id"), F.lit(MARK_BUCKETS)).cast("int"))
    marks = nodes.select(F.pmod(F.xxhash64("id"), F.lit(MARK_BUCKETS)).cast("int").alias("mark")).distinct()
    likely = rows.join(F.broadcast(marks), "mark", "left_semi").select("id", "text")
    schema = likely.select(F.lit(b"").cast("binary").alias("node"), F.array().cast("array<long>").alias("shingles")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in parts(batches):
            sets = [shingles(hasher, t) for t in batch.column("text").to_pylist()]
            names = [xxhash.xxh128_digest(s.tobytes()) if len(s) else b"" for s in sets]
            arrays = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), arrays], names=["node", "shingles"])

    built = likely.mapInArrow(run, schema)
    return built.join(nodes.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Set sizes that allow the similarity at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _signature_bar(percent: int) -> int:
    """Equal positions a pair at the threshold surely has: more than five standard deviations under the mean."""
    p = percent / 100
    return int(POSITIONS * p - 5.2 * (POSITIONS * p * (1 - p)) ** 0.5)


def likely_pairs(pairs: DataFrame, sigs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs whose signatures do not rule the similarity out.

    The number of equal positions is binomial.
    """
    bar = _signature_bar(percent)
    left = sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    right = sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bytes_of = lambda name: np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint8).reshape(-1, POSITIONS)
            good = (bytes_of("sig_a") == bytes_of("sig_b")).sum(axis=1) >= bar
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, both.select("a", "b").schema)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return both.filter(100 * shared >= percent * union).select("a", "b")


def _bits(values: list[np.ndarray]) -> np.ndarray:
    """A row of bits per list, one bit for each value that several lists hold; the others are in no intersection."""
    owners = np.repeat(np.arange(len(values)), [len(v) for v in values])
    _, code, seen = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = seen[code] > 1
    code, owners = np.unique(code[shared], return_inverse=True)[1], owners[shared]
    bits = np.zeros((len(values), (int(code.max()) + 64) // 64 if len(code) else 1), np.uint64)
    np.bitwise_or.at(bits, (owners, code // 64), np.uint64(1) << (code % 64).astype(np.uint64))
    return bits


def _block_links(percent: int):
    """Links that join the components of a group: of members of two blocks across these, of one block among themselves.

    A pair is compared in the least key that both share, and only while its components are apart, so a group of m rows
    gives m - 1 links at most.
    """
    bar = _signature_bar(percent)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets, key = [np.asarray(s, np.int64) for s in group["shingles"]], group["key"].iloc[0]
        sizes, block = np.array([len(s) for s in sets]), group["block"].to_numpy()
        across = group["low"].iloc[0] != group["high"].iloc[0]
        bits, earlier = _bits(sets), _bits([np.asarray(k, np.int64)[np.asarray(k, np.int64) < key] for k in group["keys"]])
        sigs = np.frombuffer(b"".join(group["sig"]), np.uint8).reshape(-1, POSITIONS)
        labels, nodes = pd.factorize(group["label"])[0], group["node"].to_numpy()
        found: list[tuple[bytes, bytes]] = []
        for i in range(len(sets) - 1):
            others = np.flatnonzero(labels[i + 1 :] != labels[i]) + i + 1
            if across:
                others = others[block[others] != block[i]]
            others = others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]
            others = others[(sigs[others] == sigs[i]).sum(axis=1) >= bar]
            others = others[~(earlier[others] & earlier[i]).any(axis=1)]
            if not len(others):
                continue
            mine = np.flatnonzero(bits[i])
            common = np.bitwise_count(bits[np.ix_(others, mine)] & bits[i, mine]).sum(axis=1).astype(np.int64)
            for j in others[100 * common >= percent * (sizes[others] + sizes[i] - common)]:
                if labels[i] != labels[j]:
                    found.append((nodes[i], nodes[j]))
                    labels[labels == labels[j]] = labels[i]
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def block_links(members: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links that join components inside buckets: ``key, node, n, label`` rows in blocks of about ``BLOCK`` members.

    Blocks hold about ``BLOCK_SHINGLES`` shingles at most, so long texts make smaller ones.  The members of a bucket's largest
    component, its base, are not compared with one another: a bucket of m members, o of them outside its base, makes about
    (m / BLOCK) * (o / BLOCK) block pairs, each a task of bounded size.  Of keys with the same members one is kept.
    """
    weights = F.count("*").alias("size"), F.sum("n").alias("words"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum")
    alike = F.struct(F.sum("size").alias("size"), F.sum("sum").alias("sum")).alias("members")
    base = F.max(F.struct("size", "words", "label")).alias("base")
    counted = members.groupBy("key", "label").agg(*weights).groupBy("key").agg(alike, base, F.sum("size").alias("size"), F.sum("words").alias("words"))
    counted = counted.groupBy("members").agg(F.min(F.struct("key", "base", "size", "words")).alias("one")).select("one.*")
    blocks = lambda size, words: F.ceil(F.greatest(size / F.lit(BLOCK), words / F.lit(BLOCK_SHINGLES))).cast("int")
    rest = blocks(F.col("size") - F.col("base.size"), F.col("words") - F.col("base.words"))
    counted = stage(counted.select("key", F.col("base.label").alias("base"), blocks(F.col("base.size"), F.col("base.words")).alias("base_blocks"), rest.alias("blocks")), "block-sizes")
    # a node has at most as many keys as chunk keys, and meets its signature and set once for all of them
    of_node = members.join(counted, "key").groupBy("node").agg(F.min("label").alias("label"), F.collect_list(F.struct("key", "base", "base_blocks", "blocks")).alias("of"))
    filled = of_node.join(nodes.select("node", "sig"), "node").join(sets, "node")
    spread = filled.select("node", "label", "sig", "shingles", F.col("of.key").alias("keys"), F.explode("of").alias("at")).select("*", "at.*")
    in_base, place = F.col("label") == F.col("base"), F.xxhash64("node", "key")
    block = F.when(in_base, F.pmod(place, "base_blocks")).otherwise(F.col("base_blocks") + F.pmod(place, "blocks")).cast("int")
    others = F.sequence(F.when(in_base, F.col("base_blocks")).otherwise(0), F.col("base_blocks") + F.col("blocks") - 1)
    paired = spread.withColumn("block", block).withColumn("other", F.explode(others))
    cells = paired.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "label", "sig", "shingles", "keys")
    return cells.groupBy("key", "low", "high").applyInPandas(_block_links(percent), "a binary, b binary").distinct()


def near_links(docs: DataFrame, rows: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``node, component`` of the nodes that have a link; ``rows`` are the staged rows of ``signed``."""
    first = stage(rows.filter("n > 0").groupBy("node").agg(F.min_by(F.struct("id", "n", "sig", "keys"), F.struct(F.col("id").isNull(), F.col("id"))).alias("row")), "near-nodes")
    nodes = first.select("node", "row.*")
    keyed = nodes.select(F.explode("keys").alias("key"), "node", F.col("n").cast("int").alias("n"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("hub")).filter("size > 1")
    buckets = stage(buckets, "near-buckets")
    members = stage(keyed.join(buckets, "key"), "near-members")

    small = members.filter(F.col("size") <= SMALL).select("key", "node", "n")
    other = small.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"))
    pairs = small.join(other, "key").filter((F.col("node") < F.col("b")) & _alike(F.col("n"), F.col("n_b"), percent)).select(F.col("node").alias("a"), "b")
    large = members.filter(F.col("size") > SMALL)
    stars = large.filter((F.col("hub.node") != F.col("node")) & _alike(F.col("n"), F.col("hub.n"), percent)).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
    likely = stage(likely_pairs(pairs.unionByName(stars).distinct(), nodes.select("node", "sig"), percent), "near-likely")

    crowd = large.select("node").distinct()
    wanted = likely.select(F.col("a").alias("node")).union(likely.select("b")).union(crowd).distinct()
    sets = stage(shingle_sets(docs, nodes.select("node", "id").join(wanted, "node"), text_col, id_col), "near-sets")
    links = stage(confirmed(likely, sets, percent), "near-links")
    groups = stage(components(links), "near-groups")

    labelled = large.select("key", "node", "n").join(groups, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("label"))
    labelled = stage(labelled, "near-labelled")
    torn = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    more = stage(block_links(labelled.join(stage(torn, "near-torn"), "key"), sets, nodes, percent), "near-more")
    if more.isEmpty():
        return groups
    # components of components: the links found last lead from one to another
    name = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    between = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    merged = stage(components(between).select(F.col("node").alias("component"), F.col("component").alias("into")), "near-merged")
    moved = groups.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    fresh = merged.join(groups.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("node"), F.col("into").alias("component"))
    return moved.unionByName(fresh)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, text_sha, n_shingles, component_id, kept``.

    Letters A to Z count as a to z.  A text's set is its distinct 5-word shingles; a shorter text is one shingle; a
    null text or one without words has an empty set, is linked with nothing and stays.  The component is the smallest id
    reachable over links; a row stays when its id is that.  Rows that repeat an id share no decision beyond their sets;
    null ids come after all others and a component of null ids alone keeps them.  An empty table gives no rows.
    """
    rows = stage(signed(docs, id_col, text_col), "near-rows")
    grouped = stage(near_links(docs, rows, percent, id_col, text_col), "near-components")
    least = rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    named = least.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stage(named, "near-named")
    names = stage(named.groupBy("component").agg(F.min("least").alias("component_id")), "near-names")
    of_node = stage(named.join(names, "component").select("node", "component_id"), "near-of-node")
    full = rows.filter("n > 0").join(of_node, "node").select("id", "text_sha", "n", "component_id")
    empty = rows.filter("n = 0").select("id", "text_sha", "n", F.col("id").alias("component_id"))
    kept = F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    return full.unionByName(empty).select("id", "text_sha", F.col("n").alias("n_shingles"), "component_id", kept)


def keep_one(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    decided = near_duplicates(docs, percent, id_col, text_col).filter("kept")
    stay = decided.select(row_key(F.col("id"), F.hex("text_sha")).alias("_key")).distinct()
    keyed = docs.withColumn("_key", row_key(F.col(f"`{id_col}`"), F.hex(sha(F.col(f"`{text_col}`")))))
    return keyed.join(stay, "_key", "left_semi").drop("_key")
