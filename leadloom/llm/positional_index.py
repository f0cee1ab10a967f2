"""A distributed positional inverted index over texts, and exact phrase and proximity matches from it.

Documents are indexed in segments of about ``SEGMENT`` words, each within one task, so building takes no shuffle.  A row of
the index is a term of a segment with all its places, counted through the segment's texts; the places under the empty term
are where the texts begin.  The table is written once and serves any number of query sets.

A phrase is looked up from its rarest terms: their lists, each moved back by the term's offset in the phrase, are intersected
first, and the lists of its other terms are fetched only for segments where something is left.  Phrases that hold a term the
corpus lacks fetch nothing.  Phrases are sent to the tasks in blocks of at most ``BLOCK_WORDS`` words, lists are grouped by
segment: what a task holds is bounded by these two, and no row arises for a phrase and a segment that have nothing in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import in_blocks, parts
from leadloom.session import stage

WINDOW = 10
RAREST = 3
SEGMENT = 1 << 22
BLOCK_WORDS = 1_000_000
MARK_BUCKETS = 1 << 20
#: A to Z as a to z; of the ASCII characters only letters and digits belong to words.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLACE = np.dtype("<i4")


def terms_of(text: Column) -> Column:
    """The terms of a text in order, as bytes; null has none."""
    found = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))
    return F.transform(found, lambda word: word.cast("binary"))


class _Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Segment:
    """Texts of one segment; ``rows`` are its share of the index."""

    def __init__(self, number: int) -> None:
        self.number, self.known, self.found, self.ids = number, _Numbers(), [], []

    def add(self, doc: object, text: bytes) -> int:
        words = text.translate(FOLDED).split()
        self.found.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
        self.ids.append(doc)
        return len(words)

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(f) for f in self.found], np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(PLACE)
        words = np.concatenate(self.found)
        sizes = np.bincount(words, minlength=len(self.known))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 4
        places = np.argsort(words, kind="stable").astype(PLACE)
        lists = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(places)])
        listed = {"segment": np.full(len(sizes), self.number), "term": pa.array(list(self.known), pa.binary()), "size": sizes, "places": lists.cast(pa.binary())}
        edges = {"segment": [self.number], "term": [b""], "size": [len(begins)], "places": [begins.tobytes()]}
        texts = {"segment": np.full(len(lengths), self.number), "doc": np.arange(len(lengths)), "id": self.ids, "n_words": lengths}
        for columns in (listed, edges, texts):
            n = len(columns["segment"])
            arrays = [columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns.get(f.name, [None] * n), f.type) for f in schema]
            whole = pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)
            for at in range(0, n, 20_000):
                yield whole.slice(at, 20_000)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The index, staged: ``segment, term, size, places`` for terms and ``segment, doc, id, n_words`` for texts (null term).

    Every row of ``docs`` is a text of its own, whatever its id; a null text has no words.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    none = lambda kind: F.lit(None).cast(kind)
    blank = {"segment": "long", "term": "binary", "size": "long", "places": "binary", "doc": "int", "n_words": "long"}
    schema = rows.select(*(none(kind).alias(name) for name, kind in blank.items()), "id").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_, held, arrow = None, 0, None
        for batch in parts(batches, 64):
            if arrow is None:
                kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
                arrow = pa.schema([(name, kinds[kind]) for name, kind in blank.items()] + [("id", batch.schema.field("id").type)])
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if open_ is None:
                    open_, held, number = _Segment(number), 0, number + 1
                held += open_.add(doc, text)
                if held >= segment:
                    yield from open_.rows(arrow)
                    open_ = None
        if open_ is not None:
            yield from open_.rows(arrow)

    return stage(rows.mapInArrow(run, schema), "positional-index")


def texts(index: DataFrame) -> DataFrame:
    """``segment, doc, id, n_words``: a row per indexed text."""
    return index.filter("term IS NULL").select("segment", "doc", "id", "n_words")


def _postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The lists of some terms and the beginnings of texts, in place: the others go before any shuffle.

    They go by hash buckets of the terms, at most ``2**20`` numbers at any input size; a few more lists than asked for stay.
    """
    mark = F.pmod(F.xxhash64("term"), F.lit(MARK_BUCKETS)).cast("int").alias("mark")
    marks = terms.select("term").unionByName(terms.sparkSession.range(1).select(F.lit(b"").alias("term"))).select(mark).distinct()
    listed = index.filter("term IS NOT NULL").select("segment", "term", "size", "places", mark)
    return listed.join(F.broadcast(marks), "mark", "left_semi").drop("mark")


def _met(places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the wanted places a sorted list holds."""
    at = np.searchsorted(places, wanted)
    return places[np.minimum(at, len(places) - 1)] == wanted


class Asked:
    """A block of phrases: their words as numbers of a vocabulary, rarest first, with their offsets."""

    def __init__(self, phrases: list[list[bytes]], frequency: dict[bytes, int]) -> None:
        self.number = {term: k for k, term in enumerate(frequency)}
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        #: Phrases by their rarest term; those with a term that nowhere occurs are in no list.
        self.of: dict[int, list[int]] = {}
        for k, words in enumerate(phrases):
            if not words or any(w not in frequency for w in words):
                self.rows.append((np.empty(0, np.int32), np.empty(0, np.int32)))
                continue
            order = sorted(range(len(words)), key=lambda i: (frequency[words[i]], i))
            terms = np.array([self.number[words[i]] for i in order], np.int32)
            self.rows.append((terms, np.array(order, np.int32)))
            self.of.setdefault(int(terms[0]), []).append(k)

    def lists(self, group: pd.DataFrame) -> dict[int, np.ndarray]:
        """Places of a segment's lists by term number; the beginnings of its texts under -1."""
        return {self.number.get(term, -1 if not term else None): np.frombuffer(found, PLACE) for term, found in zip(group["term"], group["places"])}


def _walked(left: np.ndarray | None, terms: np.ndarray, offsets: np.ndarray, places: dict[int, np.ndarray]) -> np.ndarray:
    """Places where a phrase may begin, after some more of its words."""
    for term, offset in zip(terms.tolist(), offsets.tolist()):
        there = places.get(term)
        if there is None:
            return np.empty(0, PLACE)
        left = there[there >= offset] - offset if left is None else left[_met(there, left + offset)]
        if not len(left):
            break
    return left


def _begun(asked, rarest: int):
    """Per segment: where its phrases may begin after their rarest terms."""

    def run(lists: pd.DataFrame) -> pd.DataFrame:
        places, out = asked.value.lists(lists), []
        for term in places:
            for phrase in asked.value.of.get(term, ()):
                terms, offsets = asked.value.rows[phrase]
                left = _walked(None, terms[:rarest], offsets[:rarest], places)
                if len(left):
                    out.append((lists["segment"].iloc[0], phrase, left.astype(PLACE).tobytes()))
        return pd.DataFrame(out, columns=["segment", "k", "starts"])

    return run


def _finished(asked, rarest: int):
    """Per segment: the phrases found after all their words, within one text each."""

    def run(likely: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        places, out = asked.value.lists(lists), []
        for segment, phrase, starts in likely.itertuples(index=False):
            terms, offsets = asked.value.rows[phrase]
            left = _walked(np.frombuffer(starts, PLACE), terms[rarest:], offsets[rarest:], places)
            if not len(left):
                continue
            doc = np.searchsorted(places[-1], left, "right") - 1
            whole = doc == np.searchsorted(places[-1], left + (len(terms) - 1), "right") - 1
            doc, left = doc[whole], left[whole]
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            for one, among in zip(doc[first].tolist(), np.split(left - places[-1][doc], first[1:])):
                out.append((segment, one, phrase, len(terms), among))
        return pd.DataFrame(out, columns=["segment", "doc", "k", "length", "starts"])

    return run


def _blocks(index: DataFrame, phrases: DataFrame, block_words: int) -> Iterator[tuple[list, Asked, DataFrame, DataFrame]]:
    """Blocks of phrases: their ids, themselves, their terms as rows and the lists of these terms."""
    spark = index.sparkSession
    counted = stage(phrases.select("phrase", "words").withColumn("n", F.size("words")).filter("n > 0"), "phrases-asked")
    for block in in_blocks(counted, "phrase", block_words):
        rows = block.collect()  # at most block_words words, or one phrase
        if not rows:
            continue
        words = [[bytes(w) for w in r.words] for r in rows]
        terms = spark.createDataFrame([(w,) for w in dict.fromkeys(w for one in words for w in one)], "term binary")
        terms = stage(terms, "phrase-terms")
        found = _postings(index, terms)
        frequency = found.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("size").alias("df")).collect()  # a row per term of the block
        yield [r.phrase for r in rows], Asked(words, {bytes(term): df for term, df in frequency}), terms, found


def _named(found: DataFrame, names: list, phrases: DataFrame) -> DataFrame:
    """Matches under the ids of their phrases."""
    kind = dict(phrases.dtypes)["phrase"]
    ids = found.sparkSession.createDataFrame(list(enumerate(names)), f"k long, phrase {kind}")
    return found.join(ids, "k").drop("k")


def phrase_matches(index: DataFrame, phrases: DataFrame, rarest: int = RAREST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``segment, doc, length, starts, phrase``: the words of a text (from 0) at which a phrase begins, staged.

    ``phrases`` has ``phrase`` (any unique id) and ``words``, an array of terms as bytes; one without words matches nothing.
    """
    spark, out = index.sparkSession, None
    for names, block, terms, found in _blocks(index, phrases, block_words):
        asked = spark.sparkContext.broadcast(block)
        rare = {int(t) for row, _ in block.rows for t in row[:rarest]}
        first = spark.createDataFrame([(term,) for term, k in block.number.items() if k in rare], "term binary")
        lists = found.join(first, "term", "left_semi").select("segment", "term", "places")
        likely = stage(lists.groupBy("segment").applyInPandas(_begun(asked, rarest), "segment long, k long, starts binary"), "phrases-likely")

        spelled = list(block.number)
        rest = [(k, [*(spelled[t] for t in row[rarest:].tolist()), b""]) for k, (row, _) in enumerate(block.rows)]
        rest = spark.createDataFrame(rest, "k long, terms array<binary>")
        wanted = likely.select("segment", "k").join(rest, "k").select("segment", F.explode("terms").alias("term")).distinct()
        more = found.join(wanted, ["segment", "term"]).select("segment", "term", "places")
        both = likely.groupBy("segment").cogroup(more.groupBy("segment")).applyInPandas(_finished(asked, rarest), "segment long, doc int, k long, length int, starts array<int>")
        matched = stage(_named(both, names, phrases), "phrase-matches")
        out = matched if out is None else out.unionByName(matched)
    if out is None:
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        out = phrases.limit(0).select(none("long", "segment"), none("int", "doc"), none("int", "length"), none("array<int>", "starts"), "phrase")
    return out


def _close(asked, span: int):
    """Per segment and query: the words at which a stretch of ``span`` words begins that holds all its terms."""

    def run(lists: pd.DataFrame) -> pd.DataFrame:
        places, out = asked.value.lists(lists), []
        begins, segment = places.pop(-1), lists["segment"].iloc[0]
        for term in places:
            for query in asked.value.of.get(term, ()):
                of = [places.get(t) for t in asked.value.rows[query][0].tolist()]
                if any(there is None for there in of):
                    continue
                starts = np.unique(np.concatenate(of))
                after = np.searchsorted(of[0], starts)  # the rarest term decides where to look at all
                near = after < len(of[0])
                near[near] = of[0][after[near]] - starts[near] < span
                starts = starts[near]
                ends = starts.copy()
                for there in of:
                    at = np.searchsorted(there, starts)
                    good = at < len(there)
                    starts, ends = starts[good], np.maximum(ends[good], there[at[good]])
                    good = ends - starts < span
                    starts, ends = starts[good], ends[good]
                doc = np.searchsorted(begins, starts, "right") - 1
                whole = doc == np.searchsorted(begins, ends, "right") - 1
                doc, starts, ends = doc[whole], starts[whole], ends[whole]
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                for one, s, e in zip(doc[first].tolist(), np.split(starts - begins[doc], first[1:]), np.split(ends - begins[doc], first[1:])):
                    out.append((segment, one, query, s, e))
        return pd.DataFrame(out, columns=["segment", "doc", "k", "starts", "ends"])

    return run


def proximity_matches(index: DataFrame, queries: DataFrame, span: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``segment, doc, starts, ends, phrase``: stretches of at most ``span`` words that hold every term of a query, in any order.

    A stretch begins at an occurrence of a term and ends with the last term it needs; one per such beginning.
    """
    spark, out = index.sparkSession, None
    for names, block, terms, found in _blocks(index, queries.withColumn("words", F.array_distinct("words")), block_words):
        asked = spark.sparkContext.broadcast(block)
        both = terms.unionByName(spark.createDataFrame([(b"",)], "term binary"))
        lists = found.join(both, "term", "left_semi").select("segment", "term", "places")
        close = lists.groupBy("segment").applyInPandas(_close(asked, span), "segment long, doc int, k long, starts array<int>, ends array<int>")
        matched = stage(_named(close, names, queries), "close-matches")
        out = matched if out is None else out.unionByName(matched)
    if out is None:
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        out = queries.limit(0).select(none("long", "segment"), none("int", "doc"), none("array<int>", "starts"), none("array<int>", "ends"), "phrase")
    return out


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``phrase, words`` of the distinct windows of ``width`` words, and ``phrase, item`` of the items that hold them.

    An item of fewer words is one window; one without words has none.  ``phrase`` is the window's words, space-joined.
    """
    listed = items.select(F.col(f"`{id_col}`").alias("item"), terms_of(F.col(f"`{text_col}`")).alias("terms")).filter(F.size("terms") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("terms") - (width - 1)))).alias("start")
    cut = listed.select("item", "terms", start).select("item", F.slice("terms", F.col("start"), F.lit(width)).alias("words"))
    named = cut.select(F.array_join(F.transform("words", lambda w: w.cast("string")), " ").alias("phrase"), "words", "item")
    named = stage(named.distinct(), "windows")
    return named.select("phrase", "words").dropDuplicates(["phrase"]), named.select("phrase", "item")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", width: int = WINDOW, index: DataFrame | None = None) -> DataFrame:
    """``id, n_words, n_hit, items`` per row of ``docs``: words inside an occurrence of a window, and the items they belong to.

    ``items`` lists ids as strings, sorted; null item ids are left out of it.  Texts and items without words have no hits,
    equal ids stay rows of their own.  Pass ``index`` to use one built before.
    """
    index = build_index(docs, id_col, text_col) if index is None else index
    phrases, belongs = windows(items, item_col, text_col, width)
    found = phrase_matches(index, phrases)
    at = ("segment", "doc")
    covered = found.select(*at, "length", F.explode("starts").alias("start")).groupBy(*at, "start").agg(F.max("length").alias("length"))
    places = covered.select(*at, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("place")).distinct()
    hits = places.groupBy(*at).agg(F.count("*").alias("n_hit"))
    named = found.select(*at, "phrase").join(belongs, "phrase").select(*at, F.col("item").cast("string").alias("item"))
    of_doc = named.groupBy(*at).agg(F.array_sort(F.collect_set("item")).alias("items"))
    marked = hits.join(of_doc, list(at))
    none = F.array().cast("array<string>")
    return texts(index).join(marked, list(at), "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items")
    )
