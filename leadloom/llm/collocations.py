"""Phrase collocations: Rabin-Karp fingerprints of all n-grams, counted by shuffles, verified against the words.

Each task reads texts in chunks of at most about ``CHUNK`` words, numbers their words and hashes every n-gram from prefix
polynomials.  A chunk sends one row per distinct fingerprint, so a hot phrase is a count, never its occurrences.

1. Fingerprints of one and two words are counted; those found ``least`` times or more are marked in a bit table.
2. Fingerprints of three and four words are counted where the table marks all their word pairs; the frequent are marked too.
3. Every marked n-gram is verified: within a chunk each occurrence is compared, word by word, with the one its fingerprint
   points to, and phrases whose fingerprints collide are told apart.  Only these phrases are cut out of the text, and their
   exact counts, by text, decide.

The bit table has a fixed size.  It only spares rows: an n-gram marked by mistake fails on its count in step 3, and none that
is frequent goes unmarked.  A larger corpus wants more bits (``filter_bits``); the result never depends on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadloom.llm.common import parts
from leadloom.llm.word_hashes import SPREAD, mixed
from leadloom.session import stage

LONGEST, LEAST, TOP = 4, 30, 2000
COVERED = 80
CHUNK = 1 << 20
#: Counted fingerprints keep this many bits, to shuffle less; chance matches among them only mark phrases that then fail.
KEY_BITS = 40
FILTER_BITS = 27
NO_LANG = "und"

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BREAK = b"\n"
#: A to Z become a to z, tabs spaces, and the piece ends ``.,;:!?`` and 0A to 0D one mark.
CLEANED = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if chr(c) in ".,;:!?" or 10 <= c <= 13 else c for c in range(256)
)


class Powers:
    """Powers of the base and its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            power = lambda b: np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, b, np.uint64))])
            self.up, self.down = power(BASE), power(INVERSE)
        return self.up[:n], self.down[:n]


class Chunk:
    """Words of some documents in a row, with the fingerprints of their n-grams."""

    def __init__(self, texts: list[bytes], langs: list[str], ids: list, powers: Powers) -> None:
        self.langs, self.ids = langs, ids
        # cleaned texts end with a space, so a text has as many places as spaces; two spaces in a row make an empty word
        encoded = pc.split_pattern(pa.array([b"".join(texts)[:-1]], pa.large_binary()), " ").flatten().dictionary_encode()
        self.words = encoded.dictionary.to_pylist()
        places, end = encoded.indices.to_numpy(), self.words.index(BREAK)
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), [t.count(b" ") for t in texts])
        if b"" in self.words:
            real = places != self.words.index(b"")
            places, doc = places[real], doc[real]
        self.ids_of, self.doc, self.is_end = places, doc, places == end
        hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, self.words)), ">u8").astype(np.uint64)[places]
        self.up, down = powers.reach(len(hashes))
        hashes *= down
        self.prefix = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes, out=self.prefix[1:])
        # words up to the next piece end, from every place; each text ends with one
        ends = np.flatnonzero(self.is_end).astype(np.int32)
        self.room = np.repeat(ends, np.diff(ends, prepend=np.int32(-1))) - np.arange(len(places), dtype=np.int32)
        self.salt = np.array([xxhash.xxh64_intdigest(lang, 1) for lang in langs], np.uint64)

    def starts(self, n: int) -> np.ndarray:
        """Places where an n-gram fits in its piece."""
        return np.flatnonzero(self.room >= n)

    def keys(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the n-grams at some places, apart by language and length."""
        polynomial = (self.prefix[at + n] - self.prefix[at]) * self.up[at]
        return mixed((polynomial ^ self.salt[self.doc[at]]) * SPREAD + np.uint64(n)) >> np.uint64(64 - KEY_BITS)


def cleaned(text: bytes) -> bytes:
    """Words and piece ends of a text, a space behind each; an end stands behind its last word."""
    return text.translate(CLEANED).replace(BREAK, b" \n ") + b" \n "


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of about ``size`` words; a longer text is a chunk of its own."""
    powers = Powers()
    texts: list[bytes] = []
    langs: list[str] = []
    ids: list = []
    held = 0
    for batch in parts(batches, 64):
        for doc, lang, text in zip(*(batch.column(c).to_pylist() for c in ("id", "lang", "text"))):
            texts.append(cleaned(text))
            langs.append(lang)
            ids.append(doc)
            held += texts[-1].count(b" ") - texts[-1].count(b"  ")
            if held >= size:
                chunk = Chunk(texts, langs, ids, powers)
                texts, langs, ids, held = [], [], [], 0
                yield chunk
                del chunk  # gone before the next one is built, as in the loops over chunks
    if texts:
        yield Chunk(texts, langs, ids, powers)


def marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit table marks the keys."""
    slot = keys & np.uint64(len(table) * 64 - 1)
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _counts(keys: list[np.ndarray]) -> pa.RecordBatch:
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], names=["key", "count"])


def _short_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, size):
            counts = _counts([chunk.keys(chunk.starts(n), n) for n in (1, 2)])
            del chunk
            yield counts
            del counts

    return run


def _long_counts(table, longest: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, size):
            at = chunk.starts(2)
            pair = np.zeros(len(chunk.doc) + longest, bool)  # places where a marked pair starts
            pair[at[marked(table.value, chunk.keys(at, 2))]] = True
            keys = []
            for n in range(3, longest + 1):
                at = chunk.starts(n)
                for k in range(n - 1):
                    at = at[pair[at + k]]
                keys.append(chunk.keys(at, n))
            counts = _counts(keys)
            del chunk, at, pair, keys
            yield counts
            del counts

    return run


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each key begins in it."""
    order = np.argsort(key, kind="stable")
    first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    return order, np.flatnonzero(first)


def _verified(tables, longest: int, size: int):
    """Per chunk: its words by language (n = 0), and every marked phrase with its count and the least id that has it."""

    def phrases(chunk: Chunk, n: int) -> Iterator[tuple]:
        at = chunk.starts(n)
        key = chunk.keys(at, n)
        good = marked(tables[n > 2].value, key)
        at, key = at[good], key[good]
        if not len(at):
            return
        order, first = _groups(key)
        at = at[order]
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
        pointer = at[first]  # the occurrence every other one of the fingerprint is held against
        same = chunk.salt[chunk.doc[at]] == chunk.salt[chunk.doc[pointer]][group]
        for k in range(n):
            same &= chunk.ids_of[at + k] == chunk.ids_of[pointer + k][group]
        if not same.all():  # colliding fingerprints: group by the words themselves
            spelled = np.stack([chunk.salt[chunk.doc[at]].view(np.int64), *(chunk.ids_of[at + k].astype(np.int64) for k in range(n))], axis=1)
            order, first = _groups(np.unique(spelled, axis=0, return_inverse=True)[1].ravel())
            at = at[order]
            pointer = at[first]
        place = np.minimum.reduceat(chunk.place[chunk.doc[at]], first)
        counts = np.diff(np.append(first, len(at)))
        words, ids_of = chunk.words, chunk.ids_of
        spans = [ids_of[pointer + k].tolist() for k in range(n)]
        texts = [b" ".join([words[i] for i in span]) for span in zip(*spans)]
        docs = chunk.doc[pointer].tolist()
        yield from zip([chunk.langs[d] for d in docs], [n] * len(docs), texts, counts.tolist(), [chunk.sorted_ids[p] for p in place.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, size):
            by_id = sorted(range(len(chunk.ids)), key=lambda d: (chunk.ids[d] is None, chunk.ids[d] or 0))
            chunk.sorted_ids = [chunk.ids[d] for d in by_id]
            chunk.place = np.empty(len(by_id), np.int64)
            chunk.place[by_id] = np.arange(len(by_id))
            words = np.bincount(chunk.doc[~chunk.is_end], minlength=len(chunk.ids))
            rows = [(lang, 0, b"", int(n), None) for lang, n in zip(chunk.langs, words)]
            for n in range(1, longest + 1):
                rows.extend(phrases(chunk, n))
            del chunk
            for at in range(0, len(rows), 50_000):
                lang, n, phrase, count, doc = zip(*rows[at : at + 50_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(phrase, pa.binary()), pa.array(count, pa.int64()), pa.array(doc, pa.int64())],
                    names=["lang", "n", "phrase", "count", "doc"],
                )
            del rows, lang, n, phrase, count, doc, by_id, words

    return run


def _bit_table(counted: DataFrame, least: int, bits: int) -> np.ndarray:
    """Bits of the keys counted ``least`` times or more: at most ``2**bits`` of them reach the driver, at any input size."""
    slot = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    often = counted.groupBy("key").agg(F.sum("count").alias("count")).filter(F.col("count") >= least).select(slot.alias("slot"))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = stage(often.groupBy(F.expr("cast(shiftright(slot, 6) as int)").alias("word")).agg(F.bit_or(bit).alias("bits")), "phrase-bits").toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table


def frequent_phrases(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    filter_bits: int = FILTER_BITS, chunk: int = CHUNK,
) -> DataFrame:
    """``lang, n, phrase, count, first_doc`` of every phrase of up to ``longest`` words found ``least`` times in its language, staged.

    Rows with ``n = 0`` and an empty phrase hold the number of words of each language.  ``first_doc`` is the least id that
    has the phrase; ids are whole numbers, null ids count last.  A null language reads as ``und``, a null text as empty.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANG)).alias("lang"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"),
    )
    counted = "key long, count long"
    short = spark.sparkContext.broadcast(_bit_table(rows.mapInArrow(_short_counts(chunk), counted), least, filter_bits))
    long = spark.sparkContext.broadcast(_bit_table(rows.mapInArrow(_long_counts(short, longest, chunk), counted), least, filter_bits))
    found = rows.mapInArrow(_verified((short, long), longest, chunk), "lang string, n int, phrase binary, count long, doc long")
    exact = found.groupBy("lang", "n", "phrase").agg(F.sum("count").alias("count"), F.min("doc").alias("first_doc"))
    exact = exact.filter((F.col("n") == 0) | (F.col("count") >= least))
    return stage(exact.withColumn("phrase", F.col("phrase").cast("string")), "phrases")


def _span(start, length) -> F.Column:
    return F.concat_ws(" ", F.slice("words", start, length))


def collocations(frequent: DataFrame, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score, first_doc``: the first ``top`` phrases of two words or more of each language.

    ``a`` is the count of the phrase, ``l`` and ``r`` those of its parts at the lowest-scoring cut, the score
    ``floor(2000000 a / (l + r))`` in exact arithmetic, ``n`` the words of the language.  A phrase goes where a longer
    one that holds it has ``covered`` percent of its count or more.
    """
    phrases = frequent.filter("n >= 2").select("lang", "n", "phrase", F.col("count").alias("a"), "first_doc", F.split("phrase", " ").alias("words"))
    counts = frequent.filter("n >= 1").select("lang", F.col("phrase").alias("part"), F.col("count").alias("f"))

    cuts = phrases.select("lang", "phrase", "a", "n", "words", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", _span(F.lit(1), F.col("k")).alias("head"), _span(F.col("k") + 1, F.col("n") - F.col("k")).alias("tail"))
    left = sides.join(counts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    both = left.join(counts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("(2000000BD * a) div (l + r)").alias("score")
    lowest = both.groupBy("lang", "phrase").agg(F.min(F.struct(score, "k", "l", "r")).alias("cut"))

    inner = phrases.filter("n > 2").select("lang", "a", "n", "words", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("size"))
    inner = inner.select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)).alias("start"))
    over = inner.groupBy("lang", _span(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    hidden = over.join(phrases.select("lang", "phrase", "a"), ["lang", "phrase"]).filter(F.col("longer") * 100 >= F.col("a") * covered)

    open_ = phrases.select("lang", "phrase", "a", "first_doc").join(hidden.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    scored = open_.join(lowest, ["lang", "phrase"]).select("lang", "phrase", "a", "first_doc", "cut.*")
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)
    sizes = frequent.filter("n = 0").select("lang", F.col("count").alias("words_of_lang"))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words_of_lang").alias("n"), "score", "first_doc")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, **options) -> DataFrame:
    """``collocations`` of a table of texts; an empty table, or texts without words, give no rows."""
    return collocations(frequent_phrases(docs, least, **options), top)
