"""The pipeline, each stage beside a plain version judged on the stage's own input."""

import collections
import sys
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
import plain
from leadloom.llm import mixing, robust_quality

FOLDER = "/root/testdata/sf0.001"
ODD = [(10**6 + k, text, lang, source, n) for k, (text, lang, source, n) in enumerate([
    (None, None, None, None), ("", "en", "a", 0), (" \t\n", "en", None, 3), ("two words", "xx", "a", 9), ("two words", "xx", "a", 9),
])]


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output rows of every stage over the documents and some odd rows."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(ODD, docs.schema)).unionByName(docs.limit(3))  # some rows twice
    out = []
    for name, apply in corpus_pipeline.STAGES:
        after = corpus_pipeline.stage(apply(spark, docs, FOLDER), f"test-{name}")
        out.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_columns_and_order(steps):
    assert [name for name, *_ in steps] == ["robust_quality", "exact_dedup", "minhash_hamming", "source_mix", "bpe_automaton"]
    assert all(tuple(columns) == corpus_pipeline.COLUMNS for _, _, _, columns in steps[:-1])


def test_quality_keeps_what_passes(spark, steps):
    _, before, after, _ = steps[0]
    passed = {r.id for r in robust_quality.judge(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")).collect() if r.kept}
    assert {r.doc_id for r in after} == passed
    assert not any(plain.quality_counts(r.text)[-1] for r in after)
    kept_base = sum(not plain.quality_counts(r.text)[-1] for r in before)
    assert len(after) > 0.85 * kept_base  # the estimates turn away few of those that pass the fixed rules


def test_exact_keeps_the_largest_id(steps):
    _, before, after, _ = steps[1]
    last = collections.defaultdict(int)
    for r in before:
        last[r.text or ""] = max(last[r.text or ""], r.doc_id)
    assert sorted((r.text or "", r.doc_id) for r in after) == sorted(last.items())


def test_near_keeps_the_least_id_of_a_component(steps):
    _, before, after, _ = steps[2]
    components = plain.near_components([(r.doc_id, r.text) for r in before], 80)
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, component) in components.items() if i == component)


def test_mix_comes_near_its_targets(spark, steps):
    _, before, after, _ = steps[3]
    size = lambda r: len(plain.WORD.findall(r.text or ""))
    times = collections.Counter(r.doc_id for r in after)
    texts = {r.doc_id: r for r in before}
    assert set(times) <= set(texts) and max(times.values()) <= 2 and all(texts[r.doc_id].text == r.text for r in after)
    decided = mixing.mix(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    by_source = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in decided:
        known = by_source[texts[r.id].source]
        known[0] += times[r.id] * size(texts[r.id])
        known[1] = r.target
        known[2] = max(known[2], size(texts[r.id]))
    for taken, target, largest in by_source.values():
        assert abs(taken - target) <= largest


def test_tokens_equal_the_library(steps):
    _, before, after, _ = steps[4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    expected = collections.Counter()
    for r in before:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        expected[r.doc_id, tuple(ids), plain.sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert collections.Counter((r.doc_id, tuple(r.tokens), r.decoded_sha256) for r in after) == expected
    assert all(r.n_tokens == len(r.tokens) for r in after)


def test_run_and_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.columns == ["doc_id", "n_tokens", "tokens", "decoded_sha256"] and rows.count() > 100
