"""Operators against plain Python and against defined results for odd inputs."""

import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pandas as pd
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plain
from leadloom.llm import bpe_automaton, catalog, chain_dedup, entropy_secrets, exact_dedup, minhash_hamming, mixing, perspectives, pii_patterns, robust_quality, virtual_slots
from leadloom.llm.word_hashes import WordHasher, by_text, hashes_of_all

BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, "one two", None, "a"), (5, "one two", "en", "a"), (5, "one two", "en", "a"),
    (None, "one two", "en", "b"), (None, None, None, None), (6, LONG, "en", "a"), (7, LONG.upper(), "en", "a"), (8, "Zoë's \U0001F600 a@b.co +1 (555) 123-4567", "fr", "é"),
]
#: Columns whose names the operators use inside.
EXTRA = "id string, kept string, n string, node string, key string, bucket string, size string, rank string, words string, lines string, cell string, doc string, sha256 string"


@pytest.fixture(scope="module")
def odd(spark):
    names = [c.split()[0] for c in EXTRA.split(", ")]
    schema = f"doc_id long, text string, lang string, source string, {EXTRA}"
    return spark.createDataFrame([(*row, *names) for row in ODD], schema)


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.filter("doc_id > 100")


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "le", "ti", "or", "es", "un", "da"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def by_id(df, column="id"):
    return {r[column]: r for r in df.collect()}


def test_exact_groups(odd, nothing):
    rows = exact_dedup.exact_groups(odd, hash_all=True).collect()
    assert len(rows) == len(ODD) and exact_dedup.exact_groups(nothing).count() == 0
    for row in rows:
        text = next((t or "" for i, t, *_ in ODD if i == row.id and row.id is not None), None)
        if text is not None:
            same = [i for i, t, *_ in ODD if (t or "") == text]
            assert row.keep_id == max(i for i in same if i is not None) and row.group_size == len(same) and bytes(row.sha256).hex() == plain.sha(text)
    assert sum(r.kept for r in rows) == len({t or "" for _, t, *_ in ODD})
    kept = exact_dedup.drop_exact(odd)
    assert kept.columns == odd.columns and sorted(kept.select("doc_id").collect()) == [(2,), (3,), (5,), (6,), (7,), (8,)]


def test_quality_counts_and_odd_rows(spark, odd, nothing):
    texts = [t for _, t, *_ in ODD] + [
        "a b c d e f g h i a b c d e f g h x", "x " * 30, "line one here\nline one here\n\n  \nline one here", "#*$%&|<> a|b",
        "p q r s t u v w p q r s t u v w p q r s t u v w", "   not a gap \x0b\x0c gap",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = by_id(robust_quality.text_counts(df).withColumn("failed", robust_quality.base_failed()))
    for i, text in enumerate(texts):
        r = counts[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.failed) == plain.quality_counts(text), text
    judged = robust_quality.judge(odd).collect()
    assert len(judged) == len(ODD) and all(r.kept == (r.id in (6, 7)) for r in judged)
    assert robust_quality.judge(nothing).count() == 0
    assert robust_quality.keep_good(odd).columns == odd.columns


def test_quality_rejects_what_lies_far_off(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(60, 300)), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "***" for w in prose(rng, 100).split()), "en", "s") for i in range(40)]
    rows += [(2000 + i, " ".join(w + "***" for w in prose(rng, 100).split()), None, None) for i in range(5)]  # too few to judge
    judged = by_id(robust_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert all(judged[i].kept for i in range(300)) and not any(judged[1000 + i].kept for i in range(40)) and all(judged[2000 + i].kept for i in range(5))
    # the estimate equals the moments of the nearest part, found with NumPy from the same start
    counts = [plain.quality_counts(t) for i, t, *_ in rows if i < 2000]
    lines = [max(sum(bool(plain.WORD.search(x)) for x in t.split("\n")), 1) for i, t, *_ in rows if i < 2000]
    c = np.array([x[:5] for x in counts], float)
    share = lambda p, w: np.arcsin(np.sqrt(p / np.maximum(w, 1)))
    x = np.round(1000 * np.stack([np.log1p(c[:, 0]), np.log1p(c[:, 1] / c[:, 0]), share(c[:, 2], c[:, 1]), share(c[:, 3], np.array(lines)), share(c[:, 4], c[:, 0])], 1))
    floor = np.diag(np.array(robust_quality.FLOORS) ** 2)
    best = None
    low = lambda v: np.sort(v, axis=0)[(len(v) + 1) // 2 - 1]
    med = low(x)
    for mean, cov in ((med, np.diag((1.4826 * low(abs(x - med))) ** 2) + floor), (x.mean(0), np.cov(x.T, bias=True) + floor)):
        for _ in range(robust_quality.STEPS):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            bins = np.floor(robust_quality.BINS_PER_OCTAVE * np.log2(1 + 8 * d))
            cut = np.sort(bins)[int(np.ceil(robust_quality.SUPPORT * len(x))) - 1]
            near = x[bins <= cut]
            mean, cov = near.mean(0), np.cov(near.T, bias=True) + floor
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0] - 1e-9:
            best = (det, mean, cov)
    d = np.einsum("ij,jk,ik->i", x - best[1], np.linalg.inv(best[2]), x - best[1])
    bins = low(np.floor(robust_quality.BINS_PER_OCTAVE * np.log2(1 + 8 * d)))
    scale = max((2 ** ((bins + 1) / robust_quality.BINS_PER_OCTAVE) - 1) / 8 / robust_quality.CHI_MEDIAN, 1)
    ids = [i for i, *_ in rows if i < 2000]
    assert np.allclose([judged[i].distance for i in ids], np.sqrt(d / scale), rtol=1e-6)


def test_personal_data(spark, odd, nothing):
    texts = [
        "a@b.c%d@e.f x@y@z.com no@dot a.b@c-d.e.f.", "1.2.3.4.5 256.1.1.1 001.2.3.255 1.2.3", "4111 1111-1111 1111 4111111111111112 41111111111111111111",
        "+1 (202) 555-0100 +12 +1234567890123456 ++49 30 1234567", "9" * 5000 + " " + "a" * 5000 + "@", "1.1." * 3000, "a." * 3000 + "@x.y", "é\U0001F600 q@r.st",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = by_id(pii_patterns.personal_data(df))
    for i, text in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in found[i].base] == plain.personal_spans(text), text[:50]
        assert all(s.value == text[s.start : s.end] for s in found[i].spans)
    assert pii_patterns.personal_data(odd).count() == len(ODD) and pii_patterns.personal_data(nothing).count() == 0


def test_patterns_discover_unknown_identifiers(spark):
    rows = [(i, f"please write to mailbox user{i}@site{i}.com today, thanks") for i in range(12)]
    rows += [(50, "please write to mailbox someone@intranet today, thanks"), (51, "nothing near 5551234567 here")]
    found = by_id(pii_patterns.personal_data(spark.createDataFrame(rows, "doc_id long, text string")))
    extra = [s for s in found[50].spans if s not in found[50].base]
    assert [(s.kind, s.value) for s in extra] == [("email", "someone@intranet")] and not found[51].spans


def test_mix(spark, odd, nothing):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(1, 60)), f"s{i % 4}" if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(df).collect()
    assert sorted(taken) == sorted(mixing.mix(df.repartition(5)).collect())
    sizes, got = {}, {}
    for r in taken:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        got[r.source] = got.get(r.source, 0) + r.taken
        assert r.taken <= 2 * r.size
    target = {r.source: r.target for r in taken}
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(abs(got[s] - target[s]) <= 30 and target[s] <= 2 * sizes[s] for s in sizes)
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(nothing).count() == 0
    assert mixing.mixed_rows(odd).columns == odd.columns
    assert mixing.mixed_rows(df).count() == sum(r.epochs for r in taken)


def test_perspectives(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "who"),
        (2, 0, "system", "alone"), (None, None, "eve", "x"),
    ]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "conv_id long, turn long, role string, text string, conv string, segment string")
    got = perspectives.rotate(df).collect()
    assert len(got) == 5 * 3 + 1 and perspectives.rotate(df.filter("turn > 9")).count() == 0
    for r in got:
        assert r.role == ("assistant" if r.speaker == r.perspective else "system" if r.speaker == "system" else "user")
        assert r.name == (r.speaker if r.role == "user" else None) and r.segment.count("<|im_end|>") == 1
        trained = r.segment[r.mask_start : r.mask_end]
        assert r.train == bool(trained) and (not trained or trained.endswith("<|im_end|>\n") and "im_start" not in trained)


def test_bpe_round_trip_is_one_python_step(spark, odd, nothing, monkeypatch):
    """Encoding and decoding share a task's process, and caches of few entries give the same tokens."""
    both = bpe_automaton.round_trip(odd, BPE)
    assert str(both._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1
    apart = bpe_automaton.decode(bpe_automaton.encode(odd, BPE), BPE)
    assert both.dtypes == apart.dtypes and sorted(map(repr, both.collect())) == sorted(map(repr, apart.collect()))
    assert bpe_automaton.round_trip(nothing, BPE).count() == 0
    automaton, split = bpe_automaton.load(BPE), regex.compile(r" ?\w+|\W+").findall
    texts = [" ".join(f"word{i * k % 97} abc{i}xyz" for i in range(60)) for k in range(1, 6)]
    expected = [automaton.encode(t, split) for t in texts]
    monkeypatch.setattr(bpe_automaton, "WORDS_KEPT", 7)
    monkeypatch.setattr(bpe_automaton, "ARCS_KEPT", 5)
    automaton.words.clear(), automaton.arcs.clear()
    assert [automaton.encode(t, split) for t in texts] == expected and len(automaton.words) <= 7


def test_bpe_equals_library(spark, odd, nothing):
    rng = random.Random(5)
    letters = "abcdeinotrs '\n\t.,!?0159éüñ中文\U0001F642​\x00\u0085 "
    texts = [t for _, t, *_ in ODD] + ["<|endoftext|>a<|endoftext|><|endoftext|> b", "x\x1c\x1d y 　 z\r\n", "a" * 400]
    texts += ["".join(rng.choice(letters) for _ in range(200)) for _ in range(150)] + [prose(rng, 200) for _ in range(20)]
    library = Tokenizer.from_file(BPE)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(bpe_automaton.decode(bpe_automaton.encode(df, BPE), BPE))
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].tokens == ids and got[i].decoded == library.decode(ids, skip_special_tokens=False) == (text or "")
    assert bpe_automaton.encode(odd, BPE).count() == len(ODD) and bpe_automaton.encode(nothing, BPE).count() == 0


def test_arcs_are_the_pairs_that_encode_to_themselves():
    automaton, library, rng = bpe_automaton.load(BPE), Tokenizer.from_file(BPE), random.Random(11)
    tokens = sorted((t.decode(), i) for t, i in automaton.ids.items() if t.isalpha() and t.isascii() and len(t) < 7)
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(3000)]
    # and pairs cut from real encodings, most of which are arcs
    for text, i in rng.sample(tokens, 1500):
        k = rng.randint(1, max(1, len(text) - 1))
        pairs += [((text[:k], automaton.ids[text[:k].encode()]), (text[k:], automaton.ids[text[k:].encode()]))] if text[k:].encode() in automaton.ids and text[:k].encode() in automaton.ids else []
    for (a, i), (b, j) in pairs:
        assert automaton._has(i, bpe_automaton.FOREVER, j) == (library.encode(a + b).ids == [i, j]), (a, b)


def edited(rng, text, share):
    words = text.split()
    for _ in range(int(share * len(words))):
        words[rng.randrange(len(words))] = "w" + str(rng.randrange(10**9))
    return " ".join(words)


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_equal_all_pairs(spark, percent):
    rng = random.Random(7)
    base = prose(rng, 120)
    rows = [(i, edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.03]))) for i in range(160)]  # one large group, many pairs near the bar
    for g in range(30):
        text = prose(rng, rng.randint(3, 90))
        rows += [(1000 + 10 * g + k, edited(rng, text, rng.choice([0, 0.01, 0.05]))) for k in range(4)]
    rows += [(3000 + i, base.upper()) for i in range(5)] + [(4000, None), (4001, ""), (4002, "one"), (4003, "ONE"), (4004, " ")]
    rng.shuffle(rows)
    got = by_id(minhash_hamming.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent))
    for i, (size, component) in plain.near_components(rows, percent).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (size, component, component == i)


def test_near_duplicates_odd_rows(odd, nothing):
    rows = minhash_hamming.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and minhash_hamming.near_duplicates(nothing).count() == 0
    assert {r.id: r.component_id for r in rows if r.id} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8}
    assert minhash_hamming.keep_one(odd).columns == odd.columns


def test_secrets(spark, odd, nothing):
    texts = [
        'Password = "hunter22" passwd:abc TOKEN=x secret=token=abcdefgh password=token:abcdef', "AKIA" + "B" * 16 + " AKIAB xAKIAAKIA" + "C" * 15,
        "deadbeef" * 3 + " " + "0f" * 11, "key 9f8G7h6J5k4L3m2N1b0VcXz8Qw uuid 123e4567-e89b-12d3-a456-426614174000", "ünïcode token: 'abcdef12' \U0001F600 api_key=ABCDEFG",
        "aaaaaaaaaaaaaaaaaaaaaaaaa1 supercalifragilisticexpialidocious example-9f8G7h6J5k4L3m2N1b0V",
    ]
    got = by_id(entropy_secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, text in enumerate(texts):
        spans = [(s.kind, s.start, s.end) for s in got[i].spans]
        assert [s for s in spans if s[0] != "entropy"] == plain.secret_spans(text)
        assert [text[a:b] for k, a, b in spans if k == "entropy"] == (["9f8G7h6J5k4L3m2N1b0VcXz8Qw"] if i == 3 else [])
    assert entropy_secrets.scan(odd).count() == len(ODD) and entropy_secrets.scan(nothing).count() == 0


def test_passages(spark, odd, nothing):
    rng = random.Random(3)
    shared = prose(rng, 70).split()
    fuzzy = [w if k % 17 else "zz" + str(k) for k, w in enumerate(shared)]
    rows = [(i, prose(rng, 150)) for i in range(20)]
    rows += [(100 + i, " ".join([prose(rng, 80), *shared, prose(rng, 50)])) for i in range(6)] + [(200, " ".join([*fuzzy, prose(rng, 90)]))]
    rows += [(300, rows[3][1]), (301, rows[3][1].upper())]
    got = chain_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    assert {r.id for r in got if r.kind == "passage"} | {r.ref_id for r in got if r.kind == "passage"} == {*range(100, 106), 200}
    assert {(r.id, r.ref_id) for r in got if r.kind == "copy"} == {(300, 3), (301, 3)}
    for r in got:
        mine, theirs = texts[r.id].lower().split()[r.start_word : r.end_word], texts[r.ref_id].lower().split()[r.ref_start : r.ref_end]
        assert len(mine) >= 60 and r.matches >= 0.8 * max(len(mine), len(theirs))
        if r.kind == "passage" and r.id != 200:
            assert mine == theirs and set(shared) <= set(mine)
    odd_rows = chain_dedup.repeated_passages(odd).collect()
    assert [(r.id, r.kind, r.ref_id) for r in odd_rows] == [(7, "copy", 6)] and chain_dedup.repeated_passages(nothing).count() == 0


def test_passages_with_own_text_between(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for n, gap in enumerate((20, 60, 100, 150, 400)):
        one, two = prose(rng, 60), prose(rng, 60)
        for k in range(2):
            rows.append((2 * n + k, " ".join([prose(rng, 30), one, prose(rng, gap), two, prose(rng, 30)])))
        want[2 * n + 1] = {(30, 90), (90 + gap, 150 + gap)}
    # four exact runs with a word changed between them are one passage, in a chain with another far away
    runs, other = [prose(rng, 25) for _ in range(4)], prose(rng, 50)
    for k in range(2):
        rows.append((20 + k, " ".join([prose(rng, 30), *(w for r in runs for w in (r, prose(rng, 1))), prose(rng, 200), other])))
    got = {}
    for r in chain_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.id, set()).add((r.start_word, r.end_word))
    for doc, spans in want.items():
        whole = (min(spans)[0], max(spans)[1])
        assert got[doc] in (spans, {whole}) and (whole[1] - whole[0] == 140 or got[doc] == spans)
    assert got[21] == {(30, 133), (334, 384)}


def test_passages_whose_seeds_stand_elsewhere_too(spark):
    rng = random.Random(8)
    texts = []
    for size, length in ((12, 60), (30, 60), (20, 40), (25, 47)):
        for _ in range(5):
            stock = [prose(rng, size) for _ in range(-(-length // size))]
            # each sentence, and each two in a row but for a word, stand in other documents first
            for one, two in zip(stock, [*stock[1:], ""]):
                texts += [" ".join([prose(rng, 30), *f"{one} {two}".split()[: 39 if length > 40 else 30], prose(rng, 30)]) for _ in range(3)]
            passage = " ".join(" ".join(stock).split()[:length])
            texts += [" ".join([prose(rng, 40), passage, prose(rng, 40)]) for _ in range(3)]
    rows = list(enumerate(texts))
    spans, seen = set(), {}
    for doc, text in rows:
        words = text.split()
        for at in range(len(words) - 39):
            seen.setdefault(tuple(words[at : at + 40]), []).append((doc, at))
    for places in seen.values():
        if len({doc for doc, _ in places}) > 1:
            spans |= {(doc, k) for doc, at in places for k in range(at, at + 40)}
    told = set()
    for r in chain_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        told |= {(r.id, k) for k in range(r.start_word, r.end_word)} | {(r.ref_id, k) for k in range(r.ref_start, r.ref_end)}
    assert len(spans) >= 20 * 3 * 40 and spans <= told


def test_rows_without_id_are_linked(spark):
    rng = random.Random(12)
    base = prose(rng, 200)
    docs = spark.createDataFrame([(None, base + " one"), (None, base + " two"), (5, base + " three"), (6, prose(rng, 90))], "doc_id long, text string")
    near = minhash_hamming.near_duplicates(docs).collect()
    assert sorted((r.id or 0, r.component_id, r.kept) for r in near) == [(0, 5, False), (0, 5, False), (5, 5, True), (6, 6, True)]
    told = chain_dedup.repeated_passages(docs).collect()
    # both rows without id are told beside document 5 or one another
    assert {(r.id, r.start_word, r.matches) for r in told if r.kind == "passage"} == {(None, 0, 200)} and any(r.ref_id == 5 for r in told)


def test_equal_runs_and_parts():
    rng = random.Random(6)
    for _ in range(200):
        a = [rng.randrange(30) for _ in range(rng.randint(0, 60))]
        b = [x if rng.random() < 0.8 else rng.randrange(30) for x in a if rng.random() < 0.95]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert chain_dedup._common(a, b) == table[-1][-1]
        runs = chain_dedup._extend(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in runs)
        assert all(i + n <= p and j + n <= q for (i, j, n), (p, q, _) in zip(runs, runs[1:]))
        gaps = [chain_dedup._common(a[i + n : p], b[j + n : q]) for (i, j, n), (p, q, _) in zip(runs, runs[1:])]
        passing = set()
        for f in range(len(runs)):
            for k in range(f, len(runs)):
                words = max(runs[k][0] + runs[k][2] - runs[f][0], runs[k][1] + runs[k][2] - runs[f][1])
                least = min(runs[k][0] + runs[k][2] - runs[f][0], runs[k][1] + runs[k][2] - runs[f][1])
                if least >= 10 and 100 * (sum(r[2] for r in runs[f : k + 1]) + sum(gaps[f:k])) >= 80 * words:
                    passing |= set(range(runs[f][0], runs[k][0] + runs[k][2]))
        told = chain_dedup.alike_parts(a, b, runs, 10, 80)
        assert set().union(*(range(p[0], p[1]) for p in told)) == passing
        assert all(100 * p[4] >= 80 * max(p[1] - p[0], p[3] - p[2]) and min(p[1] - p[0], p[3] - p[2]) >= 10 for p in told)


@pytest.mark.parametrize("others", [10, 30])
def test_fuzzy_passages_whose_seeds_stand_elsewhere_too(spark, others):
    """Two documents share a passage but for two words; each of its sentences stands first in many others."""
    rng = random.Random(21)
    texts, want = [], set()
    for _ in range(8):
        stock = [prose(rng, 25) for _ in range(3)]
        texts += [" ".join([prose(rng, 30), sentence, prose(rng, 30)]) for sentence in stock for _ in range(others)]
        texts += [" ".join([prose(rng, 30), stock[0], prose(rng, 1), stock[1], prose(rng, 1), stock[2], prose(rng, 30)]) for _ in range(2)]
        want.add((len(texts) - 1, len(texts) - 2))
    found = chain_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {(r.id, r.ref_id) for r in found.collect()} == want
    sides = chain_dedup.both_sides(found).collect()
    assert {(r.id, r.ref_id) for r in sides} == want | {(b, a) for a, b in want}
    for r in sides:
        assert abs(r.start_word - 30) <= 1 and abs(r.end_word - 107) <= 1 and r.matches >= 75


def test_chain_is_the_best(spark):
    rng = random.Random(9)
    for _ in range(30):
        points = [(rng.randrange(200), rng.randrange(200)) for _ in range(rng.randint(1, 12))]
        at, ref = map(list, zip(*points))
        order = sorted(range(len(at)), key=lambda i: at[i])
        best = {}
        for i in order:
            gains = [best[j] - chain_dedup.GAP_COST * (at[i] - at[j] + ref[i] - ref[j]) for j in best if at[j] < at[i] and ref[j] < ref[i]]
            best[i] = chain_dedup.SEED + max([0, *gains])
        path = chain_dedup.chain(at, ref)[0]
        cost = sum(chain_dedup.GAP_COST * (at[b] - at[a] + ref[b] - ref[a]) for a, b in zip(path, path[1:]))
        assert all(at[a] < at[b] and ref[a] < ref[b] for a, b in zip(path, path[1:]))
        assert abs(chain_dedup.SEED * len(path) - cost - max(best.values())) < 1e-6


def test_shards(spark, odd, nothing):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 500)) for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = virtual_slots.shard(df, 8).collect()
    texts = dict(rows)
    loads, places = {}, {}
    for r in got:
        assert r.size == len(texts[r.id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.id].encode())
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.position)
    assert sorted(loads) == list(range(8)) and max(loads.values()) - min(loads.values()) < 0.01 * sum(loads.values()) / 8
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert virtual_slots.shard(odd, 3).count() == len(ODD) and virtual_slots.shard(nothing, 3).count() == 0


def test_rebalancing_moves_few_slots(spark):
    rows = virtual_slots.slotted(spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', cast(id % 300 AS int)) AS text"))
    sums = virtual_slots.slot_bytes(rows).cache()
    folder = virtual_slots.store_map(spark, virtual_slots.edit_map(sums, 8))
    old = virtual_slots.load_map(spark, folder, 1)
    virtual_slots.store_map(spark, virtual_slots.edit_map(sums, 9, old, version=2), folder)
    new = virtual_slots.load_map(spark, folder, 2)
    pairs = old.join(new.withColumnRenamed("shard", "now"), "virtual_slot").join(sums, "virtual_slot").select("shard", "now", "bytes").collect()
    moved = [p for p in pairs if p.shard != p.now]
    assert len(pairs) == virtual_slots.SLOTS and sum(p.bytes for p in moved) < 0.12 * sum(p.bytes for p in pairs)
    assert sum(p.now == 8 for p in moved) > 0.9 * len(moved)
    loads = new.join(sums, "virtual_slot").groupBy("shard").sum("bytes").collect()
    assert len(loads) == 9 and max(x[1] for x in loads) < 1.05 * sum(x[1] for x in loads) / 9


def test_catalog_names():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 11)) and set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_near_crowd_around_the_bar(spark, monkeypatch):
    """Large buckets whose members stay apart: the blocks find every component, with fewer links than members."""
    monkeypatch.setattr(minhash_hamming, "BLOCK", 40)
    made = []
    links = minhash_hamming.block_links

    def counted(*args):
        found = links(*args).cache()
        made.append((args[0].count(), found.count()))
        return found

    monkeypatch.setattr(minhash_hamming, "block_links", counted)
    rng = random.Random(9)
    rows = []
    for crowd in range(2):
        base = prose(rng, 120).split()
        for _ in range(170):
            words = list(base)
            for at in rng.sample(range(120), rng.choice([1, 2, 3])):
                words[at] = f"w{rng.randint(0, 10**9)}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = plain.near_components(rows, 85)
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash_hamming.near_duplicates(df).collect()}
    assert got == expected
    assert len({c for _, c in expected.values()}) > 5 and made and 0 < made[0][1] < made[0][0]


def test_near_blocks_leave_a_component_apart_from_itself(spark, monkeypatch):
    """One component of 400 and three outside it: its members go to blocks of these only, once each, and not once per block."""
    monkeypatch.setattr(minhash_hamming, "BLOCK", 20)

    def counting(percent):
        return lambda group: pd.DataFrame([(f"{group['key'].iloc[0]} {group['low'].iloc[0]} {group['high'].iloc[0]}".encode(), str(len(group)).encode())], columns=["a", "b"])

    monkeypatch.setattr(minhash_hamming, "_block_links", counting)
    name = lambda i: i.to_bytes(16, "big")
    crowd = [(name(i), name(0) if i < 400 else name(i)) for i in range(403)]
    members = spark.createDataFrame([(k, n, 5, label) for k in (1, 2) for n, label in crowd[k - 1 :]], "key long, node binary, n int, label binary")
    sets = spark.createDataFrame([(n, [1]) for n, _ in crowd], "node binary, shingles array<long>")
    nodes = spark.createDataFrame([(n, 5, bytes(128)) for n, _ in crowd], "node binary, n int, sig binary")
    sent = [(r.a.decode().split()[0], int(r.b)) for r in minhash_hamming.block_links(members, sets, nodes).collect()]
    for key, m in (("1", 403), ("2", 402)):
        rows = sum(size for k, size in sent if k == key)
        assert m <= rows <= m + 3 * 20


def test_straight_chains_agree_with_the_alignment():
    """What the place-by-place comparison tells is what aligning tells; the rest is left to be aligned."""
    rng = random.Random(12)
    seed, margin = chain_dedup.SEED, chain_dedup.MARGIN
    chains = []
    for _ in range(300):
        length = rng.choice([8, 30, 40, 41, 60, 120])
        core = [rng.randint(0, 10**6) for _ in range(length)]
        other = list(core)
        for at in rng.sample(range(length), rng.choice([0, 0, 1, 2, length // 9])):
            other[at] = -1 - at
        if rng.random() < 0.2:
            cut = rng.randint(1, length - 1)
            other = other[:cut] + [rng.randint(0, 10**6)] * rng.randint(1, 2) + other[cut:]
        before, after = rng.randint(0, 90), rng.randint(0, 90)
        a = [rng.randint(0, 40) for _ in range(before)] + core + [rng.randint(0, 40) for _ in range(after)]
        b = [rng.randint(50, 90) for _ in range(rng.randint(0, 90))]
        start = len(b)
        b = b + other + [rng.randint(50, 90) for _ in range(rng.randint(0, 90))]
        seeds = [(before + k, start + k) for k in range(min(length, len(other)) - seed + 1) if core[k : k + seed] == other[k : k + seed]]
        if seeds:
            kept = chain_dedup.thinned([p for p, _ in seeds], [q for _, q in seeds])
            chains.append((a, b, *kept))
    cut = lambda words, at: words[max(at[0] - margin, 0) : at[-1] + seed + margin]
    packed = lambda lists: (np.concatenate([np.array(x, np.int32) for x in lists]), np.array([len(x) for x in lists]))
    lists = [packed([c[2] for c in chains]), packed([c[3] for c in chains]), packed([cut(c[0], c[2]) for c in chains]), packed([cut(c[1], c[3]) for c in chains])]
    rows, told, left = chain_dedup.straight(*lists, 40, 80)
    told = {int(r): tuple(t) for r, t in zip(rows, told.tolist())}
    assert len(told) > 60 and len(told) + len(left) < len(chains)
    for k, (a, b, at, ref) in enumerate(chains):
        if k in left:
            continue
        low, ref_low = max(at[0] - margin, 0), max(ref[0] - margin, 0)
        x, y = cut(a, at), cut(b, ref)
        parts = chain_dedup.alike_parts(x, y, chain_dedup.equal_runs(x, y, [p - low for p in at], [q - ref_low for q in ref]), 40, 80)
        parts = [(s + low, e + low, rs + ref_low, re + ref_low, m) for s, e, rs, re, m in parts]
        assert len(parts) == (k in told), k
        # past a word put in or left out, fewer than three equal words are not looked for
        assert not parts or max(abs(x - y) for x, y in zip(parts[0], told[k])) <= chain_dedup.ANCHOR + 1, k


def test_ends_without_two_equal_words_in_a_row_are_not_aligned():
    """Past a run of equal words, edits cannot pay where no two equal words in a row are left: few comparisons tell so."""
    compared = 0

    class Word(int):
        __hash__ = int.__hash__

        def __eq__(self, other):
            nonlocal compared
            compared += 1
            return int(self) == int(other)

    a, b = [Word(k) for k in range(70)], [Word(k if k < 6 or k % 4 == 0 else -k) for k in range(70)]
    assert chain_dedup._extend(a, b) == [(0, 0, 6)] and compared < 40
    assert chain_dedup._extend(a, b[:6] + [Word(-1)] + b[6:12]) == [(0, 0, 6)]
    assert chain_dedup._extend(a, a[:6] + [Word(-1)] + a[6:]) == [(0, 0, 6), (6, 7, 64)]
    assert chain_dedup._extend(a, a[:9]) == [(0, 0, 9)] and chain_dedup._extend([], a) == chain_dedup._extend(a[1:], b[30:]) == []


def test_words_and_seeds_of_many_texts_at_once():
    rng = random.Random(17)
    texts = ["", " \t\n ", "One", " É\x85z\x0bA\u2003b\x1c c ", *(" ".join(rng.choice("abcd") for _ in range(n)) for n in range(50)), *(prose(rng, n) for n in (7, 8, 23, 24, 300, 2000))]
    for some in (texts, texts[:2], texts[4:14], [*texts[::-1], ""], [" ".join(texts) + " "]):
        each = [WordHasher().of(t) for t in some]
        flat, sizes = hashes_of_all(pa.array(some))
        assert sizes.tolist() == [len(h) for h in each] and flat.tolist() == np.concatenate(each).tolist()
        assert [h.tolist() for h in by_text(flat, sizes)] == [h.tolist() for h in each]
        seeds, places, counts = chain_dedup.seeds_of_all(flat, sizes)
        want = [chain_dedup.sampled_seeds(h) for h in each]
        assert counts.tolist() == [len(w[0]) for w in want]
        assert seeds.tolist() == [x for w in want for x in w[0].tolist()] and places.tolist() == [x for w in want for x in w[1].tolist()]


@pytest.mark.parametrize("block", [4096, 7])
def test_fuzzy_passages_beside_a_crowded_seed(spark, monkeypatch, block):
    """Two documents share a sentence that stands in thirty others too, and past another word, or one put in, sixteen words more."""
    monkeypatch.setattr(chain_dedup, "BLOCK", block)
    rng = random.Random(33)
    texts, want = [], set()
    for k in range(12):
        sentence, tail = prose(rng, 30), prose(rng, 16)
        texts += [" ".join([prose(rng, 50), sentence, prose(rng, 50)]) for _ in range(30)]
        for gap in (1, 0 if k % 3 == 0 else 1):
            parts = [sentence, prose(rng, gap), tail][:: -1 if k % 2 else 1]
            texts.append(" ".join(" ".join([prose(rng, 50), *parts, prose(rng, 50)]).split()))
        want.add((len(texts) - 1, len(texts) - 2))
    found = chain_dedup.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.id, r.ref_id) for r in found} == want
    for r in found:
        assert abs(r.ref_start - 50) <= 2 and abs(r.ref_end - 97) <= 2 and r.matches >= 46


def test_words_around_a_seed_are_compared_with_all():
    rng = np.random.default_rng(2)
    reach, seed = 44, chain_dedup.SEED
    base = rng.integers(2, 4000, (6, 2 * reach + seed)).astype(np.uint16)
    lines = []
    for k in range(300):
        line = rng.integers(2, 4000, 2 * reach + seed).astype(np.uint16)
        line[reach - k % 9 : reach + seed + k % 17] = base[0, reach - k % 9 : reach + seed + k % 17]  # what all have
        if k % 3 == 0:  # what few have, with a word put in or not, or after nothing equal
            at = reach + seed + k % 17 + 1
            moved = at + k % 2
            size = min(k % 30, 2 * reach + seed - moved)
            line[moved : moved + size] = base[1 + k % 5, at : at + size]
        lines.append(line)
    words = np.array(lines)
    open_ = rng.random(words.shape) < 0.9
    met = [(int(x), int(y)) for rows, refs in chain_dedup.worth_a_look(words, open_, words, reach, 16, 5) for x, y in zip(rows, refs)]
    every = np.array([(x, y) for x in range(300) for y in range(300)])
    good = chain_dedup.go_on(words[every[:, 0]], words[every[:, 1]], open_[every[:, 0]], 32)
    met_good = {p for p, kept in zip(met, chain_dedup.go_on(words[[p[0] for p in met]], words[[p[1] for p in met]], open_[[p[0] for p in met]], 32)) if kept}
    assert {tuple(map(int, p)) for p in every[good]} <= met_good | {(k, k) for k in range(300)} and len(met_good) > 300
    # the dense way gives all that the other way does, but for pairs with little beside the seed
    dense = {(low + int(x), int(y)) for low in range(0, 300, 100) for rows, refs in chain_dedup.near_equal(words[low : low + 100], words, reach, 16, 5) for x, y in zip(rows, refs)}
    few = lambda x, y: max((words[x, reach - 16 : reach] == words[y, reach - 16 : reach]).sum(), (words[x, reach + seed : reach + seed + 16] == words[y, reach + seed : reach + seed + 16]).sum()) < 5
    assert all(few(*map(int, p)) or tuple(map(int, p)) in dense for p in every[good])
