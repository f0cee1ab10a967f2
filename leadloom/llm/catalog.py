"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import bpe_automaton, chain_dedup, collocations, dual_tree, entropy_secrets, exact_dedup, minhash_hamming, mixing, perspectives, pii_patterns, positional_index, robust_quality, virtual_slots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined in its order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


@query(
    "op1_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def exact(spark: SparkSession, folder: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, folder, "documents"), hash_all=True)
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


@query("op2_robust_quality")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    return robust_quality.judge(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cell", "distance"
    )


@query("op3_pii_patterns")
def personal(spark: SparkSession, folder: str) -> DataFrame:
    base, kinds = F.col("base"), pii_patterns.KINDS
    count = lambda kind: F.size(of_kind(base, kind)).cast("long").alias(f"n_{kind}")
    return pii_patterns.personal_data(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), *map(count, kinds), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


MIX_SQL = r"""
    WITH sized AS (
        SELECT doc_id, source, coalesce(text, '') AS body,
               length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS size
        FROM documents),
    totals AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
        FROM sized GROUP BY source),
    weighed AS (SELECT source, source_size, place, [5, 2, 1][CAST((place - 1) % 3 + 1 AS INT)] AS weight, 2 * source_size AS most FROM totals),
    filling AS (
        SELECT *, sum(source_size) OVER () * 1.5 AS total,
               sum(source_size) OVER () * 1.5 - coalesce(sum(most) OVER earlier, 0) AS rest_words,
               sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS rest_weight
        FROM weighed
        WINDOW earlier AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    flagged AS (SELECT *, rest_words * weight >= most * rest_weight AS is_full FROM filling),
    targets AS (
        SELECT source, source_size,
               CASE WHEN is_full THEN CAST(most AS DOUBLE)
                    ELSE CAST(total - coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0) AS DOUBLE) * weight
                         / sum(CASE WHEN NOT is_full THEN weight END) OVER () END AS target
        FROM flagged),
    budgets AS (
        SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
    keyed AS (
        SELECT s.doc_id, s.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS rest, b.source, sha256(s.body) AS sha,
               -ln((CAST(('0x' || substr(md5('mix-1|' || coalesce(CAST(s.doc_id AS VARCHAR), 'null') || '|' || sha256(s.body)), 1, 13)) AS BIGINT) + 0.5)
                   / 4503599627370496.0)
               / CASE WHEN length(s.body) > 0
                      THEN greatest(0.0625, 1 - 4 * CAST(length(s.body) - length(regexp_replace(s.body, '[0-9#*$%&|<>]+', '', 'g')) AS DOUBLE) / length(s.body))
                      ELSE 1.0 END AS sort_key
        FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source),
    run AS (
        SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY sort_key, doc_id, sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
        FROM keyed)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(size * (whole + CASE WHEN size > 0 AND 2 * ahead + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM run
"""


@query("op4_source_mix", MIX_SQL)
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


ROTATE_SQL = """
    WITH said AS (
        SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker,
               replace(replace(coalesce(text, ''), '<|im_', '< im_'), '|>', ' >') AS body
        FROM conversations),
    people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
    seen AS (
        SELECT s.conv_id, s.turn, p.perspective, s.speaker, s.body,
               CASE WHEN s.speaker = p.perspective THEN 'assistant' WHEN s.speaker = 'system' THEN 'system' ELSE 'user' END AS role
        FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
    headed AS (
        SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
               '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || replace(replace(speaker, '<|im_', '< im_'), '|>', ' >') ELSE '' END || chr(10) AS head
        FROM seen),
    segments AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS segment FROM headed)
    SELECT conv_id, turn, perspective, speaker, role, name, segment,
           CAST(CASE WHEN role = 'assistant' THEN length(head) ELSE length(segment) END AS BIGINT) AS mask_start,
           CAST(length(segment) AS BIGINT) AS mask_end, role = 'assistant' AS train
    FROM segments
"""


@query("op5_perspective_rotation", ROTATE_SQL)
def perspective_rotation(spark: SparkSession, folder: str) -> DataFrame:
    return perspectives.rotate(table(spark, folder, "conversations")).withColumnRenamed("conv", "conv_id")


@query("op6_bpe_automaton")
def bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe_automaton.round_trip(table(spark, folder, "documents"), path)
    return both.select(
        F.col("id").alias("doc_id"),
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op7_minhash_hamming")
def near(spark: SparkSession, folder: str) -> DataFrame:
    decided = minhash_hamming.near_duplicates(table(spark, folder, "documents"))
    return decided.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query("op8_entropy_secrets")
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    spans, base = F.col("spans"), ("assign", "access", "hex")
    count = lambda kind: F.size(of_kind(spans, kind)).cast("long").alias(f"n_{kind}")
    return entropy_secrets.scan(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), *map(count, base), F.sha2(listed(of_kind(spans, *base)), 256).alias("base_sha256"), listed(spans).alias("spans")
    )


@query("op9_chain_dedup")
def passages(spark: SparkSession, folder: str) -> DataFrame:
    found = chain_dedup.both_sides(chain_dedup.repeated_passages(table(spark, folder, "documents")))
    return found.withColumnsRenamed({"id": "doc_id", "ref_id": "ref_doc_id"})


@query("op10_virtual_slots")
def sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = virtual_slots.shard(table(spark, folder, "documents"), 8)
    return rows.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )


LEAK_SQL = r"""
    WITH spoken AS (
        SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents),
    items AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, least(10, len(w)) AS size, unnest([array_to_string(w[i:i + 9], ' ') FOR i IN range(1, greatest(1, len(w) - 9) + 1)]) AS phrase
        FROM items WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT size FROM windows),
    runs AS (
        SELECT row, size, unnest(range(1, len(w) - size + 2)) AS start, unnest([array_to_string(w[i:i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]) AS phrase
        FROM spoken, sizes WHERE len(w) >= size),
    met AS (SELECT row, start, r.size, item_id FROM runs r JOIN windows USING (size, phrase)),
    hit AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(start, start + size)) AS place FROM met) GROUP BY row),
    named AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY row)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM spoken LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""


@query("op11_positional_index", LEAK_SQL)
def leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = positional_index.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SEARCH_SQL = r"""
    WITH spoken AS (
        SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
        FROM documents WHERE text IS NOT NULL),
    sized AS (SELECT doc_id, row, w, len(w) AS n FROM spoken WHERE len(w) > 0),
    totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sized),
    asked AS (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark WHERE text IS NOT NULL),
    wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
    held AS (
        SELECT row, doc_id, n, term, count(*) AS tf
        FROM (SELECT row, doc_id, n, unnest(w) AS term FROM sized) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
    weights AS (
        SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM held, totals GROUP BY term),
    scored AS (
        SELECT item_id, row, doc_id,
               CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words)))) AS BIGINT) AS score
        FROM wanted JOIN held USING (term) JOIN weights USING (term), totals GROUP BY ALL),
    ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query("op12_dual_tree", SEARCH_SQL)
def lexical(spark: SparkSession, folder: str) -> DataFrame:
    found = dual_tree.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumnsRenamed({"item": "item_id", "doc": "doc_id"})


COLLOCATION_SQL = r"""
    WITH pieces AS (
        SELECT doc_id, coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    listed AS (SELECT doc_id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    grams AS (
        SELECT doc_id, lang, k AS size, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
        FROM listed, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
    counts AS (SELECT lang, size, phrase, count(*) AS f, min(doc_id) AS first_doc FROM grams GROUP BY ALL HAVING count(*) >= 30),
    sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM listed GROUP BY lang),
    long AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size >= 2),
    cuts AS (
        SELECT c.lang, c.phrase, k, head.f AS l, tail.f AS r, CAST((2000000::HUGEINT * c.f) // (head.f + tail.f) AS BIGINT) AS score
        FROM (SELECT *, unnest(range(1, size)) AS k FROM long) c
        JOIN counts head ON head.lang = c.lang AND head.phrase = array_to_string(c.w[1:c.k], ' ')
        JOIN counts tail ON tail.lang = c.lang AND tail.phrase = array_to_string(c.w[c.k + 1:], ' ')),
    lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    covering AS (
        SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(f) AS longer
        FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM long)) GROUP BY ALL),
    ranked AS (
        SELECT p.lang, row_number() OVER (PARTITION BY p.lang ORDER BY score DESC, p.f DESC, encode(p.phrase)) AS rank,
               p.phrase, p.f AS a, l, r, n, score, first_doc
        FROM long p JOIN lowest USING (lang, phrase) JOIN sizes USING (lang) LEFT JOIN covering USING (lang, phrase)
        WHERE longer IS NULL OR 100 * longer < 80 * p.f)
    SELECT * FROM ranked WHERE rank <= 2000
"""


@query("op13_collocations", COLLOCATION_SQL)
def phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))
