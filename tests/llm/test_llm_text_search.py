"""Positional index, dual-tree search and collocations against plain Python and defined results for odd inputs."""

import collections
import hashlib
import math
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain
from leadloom.llm import catalog, collocations, dual_tree, positional_index

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(40_000))
ODD = [
    (1, None, None), (2, "", "en"), (3, " \t\n .;", "en"), (4, "One two", None), (5, "one two", "en"), (5, "one two", "en"), (None, "one, two", "en"),
    (None, None, None), (6, LONG, "en"), (7, LONG.upper(), "en"), (8, "Zoë's \U0001F600 a-b 12 x", "fr"),
]
EXTRA = "id string, term string, n string, rank string, words string, phrase string, segment string, doc string, item string, place string, score string, key string, count string"
LEAK = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def odd(spark):
    names = [c.split()[0] for c in EXTRA.split(", ")]
    return spark.createDataFrame([(*row, *names) for row in ODD], f"doc_id long, text string, lang string, {EXTRA}")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.filter("doc_id > 100")


def prose(rng, n, words=("an", "le", "ti", "or", "es", "un", "da", "Éa", "so", "in")):
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", ",", ".", "é"]) for _ in range(n))


def folded(text):
    return LEAK.findall((text or "").translate(plain.LOWER))


def leaks(docs, items, width=10):
    out = []
    for i, text in docs:
        words, hit, names = folded(text), set(), set()
        for item, asked in items:
            terms = folded(asked)
            for at in range(max(1, len(terms) - width + 1) if terms else 0):
                window = terms[at : at + width]
                for start in range(len(words) - len(window) + 1):
                    if words[start : start + len(window)] == window:
                        hit.update(range(start, start + len(window)))
                        names.add(str(item))
        out.append((i, len(words), len(hit), sorted(names)))
    return sorted(out, key=str)


def test_leaks_beside_brute_force(spark, odd, nothing):
    rng = random.Random(7)
    items = [(k, prose(rng, rng.choice([1, 3, 9, 10, 11, 30]))) for k in range(14)] + [(14, None), (15, " . "), (16, "an an an an"), (16, "Zoë s"), (None, "one two")]
    docs = [(k, prose(rng, rng.randint(0, 60))) for k in range(60)]
    docs += [(100 + k, f"{prose(rng, 5)} {items[k % 14][1].upper()}! {prose(rng, 4)} {items[(k + 1) % 14][1]}") for k in range(20)] + [(3, "an an an an an an")]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as phrase", "'y' as words")
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    # tiny segments and blocks change nothing
    for index in (None, positional_index.build_index(table, segment=70)):
        found = positional_index.contamination(table, asked, index=index)
        rows = sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=str)
        assert rows == leaks(docs, [(i, t) for i, t in items if i is not None])
    rows = positional_index.contamination(odd, asked).collect()
    got = sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in rows), key=str)
    expected = leaks([(i, t) for i, t, _ in ODD], items)
    assert [(i, n, h, [x for x in names if x != "None"]) for i, n, h, names in expected] == got
    assert positional_index.contamination(nothing, asked).count() == 0
    clean = positional_index.contamination(odd, asked.filter("item_id > 100")).collect()
    assert len(clean) == len(ODD) and all(r.n_hit == 0 and r["items"] == [] for r in clean)


def test_phrases_in_blocks_and_proximity(spark):
    rng = random.Random(3)
    docs = [(k, prose(rng, rng.randint(0, 40))) for k in range(40)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    index = positional_index.build_index(table, segment=100)
    names = {(r.segment, r.doc): r.id for r in positional_index.texts(index).collect()}
    asked = [(k, [w.encode() for w in folded(prose(rng, rng.choice([1, 2, 3, 5])))]) for k in range(30)] + [(30, [b"nowhere", b"an"]), (31, [])]
    queries = spark.createDataFrame(asked, "phrase long, words array<binary>")
    for rarest, block in ((1, 30), (3, 1000)):
        found = positional_index.phrase_matches(index, queries, rarest, block).collect()
        got = {(names[r.segment, r.doc], r.phrase, s) for r in found for s in r.starts}
        expected = set()
        for i, text in docs:
            words = [w.encode() for w in folded(text)]
            expected |= {(i, q, s) for q, terms in asked if terms for s in range(len(words)) if words[s : s + len(terms)] == terms}
        assert got == expected and expected
    for span in (2, 6):
        found = positional_index.proximity_matches(index, queries, span, block_words=30).collect()
        got = {(names[r.segment, r.doc], r.phrase, s, e) for r in found for s, e in zip(r.starts, r.ends)}
        expected = set()
        for i, text in docs:
            words = [w.encode() for w in folded(text)]
            for q, terms in asked:
                for s in range(len(words)):
                    part = words[s : s + span]
                    if terms and words[s] in terms and set(terms) <= set(part):
                        expected.add((i, q, s, s + max(part.index(t) for t in terms)))
        assert got == expected and expected


def ranking(docs, items, top):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(i, collections.Counter(term.findall((t or "").translate(plain.LOWER)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, words = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked = collections.Counter(term.findall((text or "").translate(plain.LOWER)))
        scored = []
        for i, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n_docs // words
            weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))  # noqa: B023, E731
            score = sum(times * weight(t) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t, times in asked.items())
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if null else i, -score) for rank, (score, null, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def test_search_beside_brute_force(spark, odd, nothing):
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    write = lambda n: " ".join(stems[min(399, int(rng.paretovariate(0.6)))] + rng.choice(["", ".", "É"]) for _ in range(n))
    docs = [(k, write(rng.randint(0, 80))) for k in range(900)] + [(k, "same text here") for k in (905, 903, 904, 903)] + [(None, "same text here"), (None, None)]
    items = [(k, write(rng.choice([1, 8, 30]))) for k in range(50)] + [(50, "here same"), (51, None), (52, "!"), (50, "TEXT text"), (None, "same")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as n", "2 as place", "3 as words")
    expected = ranking(docs, items, 5)
    for block in (200_000, 60):
        found = dual_tree.search(table, asked, 5, block_terms=block)
        assert sorted(((r["item"], r["rank"], r.doc, r.score) for r in found.collect()), key=str) == expected
    got = sorted(((r["item"], r["rank"], r.doc, r.score) for r in dual_tree.search(odd, asked).collect()), key=str)
    assert got == ranking([(i, t) for i, t, _ in ODD], items, 20)
    assert dual_tree.search(nothing, asked).count() == 0 and dual_tree.search(odd, asked.filter("item_id > 100")).count() == 0
    named = table.selectExpr("concat('d', doc_id) as doc_id", "text")
    assert dual_tree.search(named, asked, 3).filter("item = 50").count() == 6


def test_node_pairs_are_left_out():
    rng = np.random.default_rng(5)
    # topics of ten terms each; a document keeps to one topic, as items do
    weights = [{int(t): int(rng.integers(1000, 9000)) for t in np.unique(rng.integers(0, 10, 6)) + 10 * (i % 20)} for i in range(100)]
    rows = []
    for k in range(8192):
        terms = np.unique(rng.integers(0, 10, 8)).astype(np.int32) + np.int32(10 * (k // 410))
        rows.append((k, terms.tobytes(), rng.integers(1, 900_000, len(terms)).astype(np.int32).tobytes()))
    search = dual_tree.Search(dual_tree.item_tree(weights), {}, 20)
    for at in range(0, len(rows), dual_tree.BATCH):
        ids, terms, impacts = (list(c) for c in zip(*rows[at : at + dual_tree.BATCH]))
        search.whole(dual_tree.Batch(ids, terms, impacts, 200))
    for item in range(0, 100, 7):
        scores = []
        for k, terms, impacts in rows:
            scores.append((-sum(weights[item].get(t, 0) * s for t, s in zip(np.frombuffer(terms, np.int32).tolist(), np.frombuffer(impacts, np.int32).tolist())), False, k))
        assert search.best[item] == [s for s in sorted(scores)[:20] if s[0] < 0]
    assert search.met < 0.25 * len(rows) * math.ceil(100 / dual_tree.ITEM_LEAF)


def mined(docs, least, top):
    f = collections.defaultdict(collections.Counter)
    n, first = collections.Counter(), {}
    for i, text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(plain.LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3, 4):
                for at in range(len(words) - size + 1):
                    phrase = tuple(words[at : at + size])
                    f[lang][phrase] += 1
                    if i is not None:
                        first[lang, phrase] = min(i, first.get((lang, phrase), i))
    out = []
    for lang, counts in f.items():
        found = []
        often = {p: c for p, c in counts.items() if c >= least and len(p) > 1}
        inside = collections.defaultdict(int)
        for p, c in often.items():
            for size in range(2, len(p)):
                for at in range(len(p) - size + 1):
                    inside[p[at : at + size]] = max(inside[p[at : at + size]], c)
        for p, a in often.items():
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            if 100 * inside[p] < 80 * a:
                found.append((-score, -a, " ".join(p).encode(), left, right, p))
        for rank, (score, a, phrase, left, right, p) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score, first.get((lang, p))))
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score", "first_doc")


def test_collocations_beside_brute_force(spark, odd, nothing, monkeypatch):
    rng = random.Random(2)
    docs = [(k, prose(rng, rng.randint(0, 60)) + rng.choice(["", "\nOne two. three", " stock phrase in full;"]), rng.choice(["en", "fr", None])) for k in range(300)]
    docs += [(None, "stock phrase in full", "en"), (7, "a\x00b a\x00b c", "en")] * 12
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    expected = mined(docs, 10, 200)
    assert len(expected) > 20
    for options in ({}, {"chunk": 300, "filter_bits": 12}):
        rows = collocations.mine(table, 10, 200, **options).select(*COLUMNS).collect()
        assert sorted(map(tuple, rows)) == expected
    assert sorted(map(tuple, collocations.mine(odd, 2, 5000).select(*COLUMNS).collect())) == mined(ODD, 2, 5000)
    assert collocations.mine(nothing).count() == 0 and collocations.mine(odd.filter("text IS NULL")).count() == 0


def test_colliding_fingerprints_are_told_apart(monkeypatch):
    """All n-grams of one length get the same fingerprint: the words decide."""
    import pyarrow as pa

    class Shared:
        value = np.full(2, np.uint64(0xFFFFFFFFFFFFFFFF))

    monkeypatch.setattr(collocations.Chunk, "keys", lambda self, at, n: np.full(len(at), n, np.uint64))
    texts = [b"a b c a b", b"b c. a b", b"a b"]
    batch = pa.RecordBatch.from_arrays([pa.array([3, 1, None]), pa.array(["x", "x", "y"]), pa.array(texts)], names=["id", "lang", "text"])
    rows = [r for b in collocations._verified((Shared, Shared), 4, 1 << 20)(iter([batch])) for r in b.to_pylist()]
    got = {(r["lang"], r["phrase"].decode()): (r["count"], r["doc"]) for r in rows if r["n"] == 2}
    assert got == {("x", "a b"): (3, 1), ("x", "b c"): (2, 1), ("x", "c a"): (1, 3), ("y", "a b"): (1, None)}


def test_chunk_words_are_numbered_by_columns():
    """A chunk's words come from one dictionary of the whole chunk, not word by word; odd texts keep their places."""
    import pyarrow as pa

    texts = [b"", b"  \t ", b".\n,", b"A  b. c", None, b"B\x00 b"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x"] * 6), pa.array([t or b"" for t in texts])], names=["id", "lang", "text"])
    (chunk,) = collocations.chunks(iter([rows]))
    assert len(chunk.words) == len(set(chunk.words)) and not hasattr(chunk, "numbers")
    spelled = [[chunk.words[i] for i in chunk.ids_of[chunk.doc == d]] for d in range(6)]
    end = b"\n"
    assert spelled == [[end], [end], [end] * 4, [b"a", b"b", end, b"c", end], [end], [b"b\x00", b"b", end]]
    assert chunk.room[chunk.doc == 3].tolist() == [2, 1, 0, 1, 0]
    assert sum((c.ids for c in collocations.chunks(iter([rows]), 1)), []) == list(range(6))


def test_registered_with_sql():
    for name in ("op11_positional_index", "op12_dual_tree", "op13_collocations"):
        assert name in catalog.QUERIES and name in catalog.ORACLES
    assert hashlib.sha256(b"").hexdigest() == plain.sha("")
