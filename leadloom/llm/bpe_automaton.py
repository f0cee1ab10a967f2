"""Byte-level BPE as a deterministic automaton over tokens.

The automaton starts with one state and an arc per byte.  Every merge ``u v -> w`` adds one gadget:

* arcs ``u`` lead to a copy of their target without the arc ``v``, so ``u v`` can no longer be read as two tokens;
* every state with an arc ``u`` gets an arc ``w``, which leads where ``v`` led before.

All arcs of one token lead to one state, so a state is a token and the merges that have copied it.  The gadgets are
kept as a table (token, lost arc) -> merge; whether a state has an arc follows from it by table look-ups, and arcs once
found are kept.  A token path through the automaton is the BPE encoding of its bytes and each prefix of a word has
exactly one.  Encoding follows arcs through the word, longest label first, and never returns to a position it has left.
Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import id_and_text, parts

# The split before the merges, with Unicode's own white space.
PRE_SPLIT = (
    r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Bounds of what a process remembers; results never depend on them.
WORDS_KEPT, ARCS_KEPT = 200_000, 400_000
FOREVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: itself, or the next letter from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Automaton:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]) -> None:
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(token): i for token, i in vocabulary.items() if token not in special}
        self.labels = {i: token for token, i in self.ids.items()} | {i: s.encode() for s, i in special.items()}
        self.special = special
        self.born = {i: 0 for token, i in self.ids.items() if len(token) == 1}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.gadget: dict[tuple[int, int], int] = {}
        self.arcs: dict[int, bool] = {}
        for step, (a, b) in enumerate(merges, 1):
            u, v = self.ids[raw(a)], self.ids[raw(b)]
            w = self.ids[raw(a) + raw(b)]
            if w in self.born:
                raise ValueError("two merges make one token")
            if self._has(u, step - 1, v):  # else the merge never applies and its token has no arc
                self.born[w], self.left[w], self.right[w] = step, u, v
                self.gadget[u, v] = step
        self.ids = {token: i for token, i in self.ids.items() if i in self.born}
        self.length = {i: len(token) for token, i in self.ids.items()}
        self.step: dict[int, int] = {}
        self.token_at = [-1]
        for token, i in self.ids.items():
            node = 0
            for byte in token:
                if (node << 8 | byte) not in self.step:
                    self.step[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.step[node << 8 | byte]
            self.token_at[node] = i
        self.words: dict[str, bytes] = {}

    def _has(self, state: int, step: int, arc: int) -> bool:
        """Whether the state after token ``state``, as it is after so many merges, has the arc."""
        born, left, right = self.born, self.left, self.right
        while True:
            lost = self.gadget.get((state, arc))
            if lost is not None and lost <= step:
                return False
            if born[arc] >= born[state] and born[arc]:
                step, arc = born[arc], left[arc]  # it was given with the arc of its left part
            elif born[state]:
                step, state = born[state] - 1, right[state]  # the state began as the one after its right part
            else:
                return True

    def encode_word(self, word: str) -> bytes:
        """Token ids of a pre-split word as packed 32-bit integers."""
        found = self.words.get(word)
        if found is not None:
            return found
        if len(self.words) >= WORDS_KEPT:
            self.words.clear()
        data, arcs, step, token_at, length = word.encode(), self.arcs, self.step, self.token_at, self.length
        size, at, dead = len(data), 0, set()
        path: list[int] = []
        open_arcs: list[list[int]] = []
        fresh = True
        while at < size:
            if fresh:  # all tokens that begin here, the longest last
                node, here = 0, []
                for j in range(at, size):
                    node = step.get(node << 8 | data[j])
                    if node is None:
                        break
                    if token_at[node] >= 0:
                        here.append(token_at[node])
                open_arcs.append(here)
            here, last, fresh = open_arcs[-1], path[-1] if path else -1, False
            while here:
                token = here.pop()
                if at + length[token] in dead:
                    continue
                if last >= 0:
                    pair = last << 32 | token
                    arc = arcs.get(pair)
                    if arc is None:
                        arc = arcs[pair] = self._has(last, FOREVER, token)
                    if not arc:
                        continue
                path.append(token)
                at += length[token]
                fresh = True
                break
            else:  # no way on: each position has one valid path, so it need not be tried again
                dead.add(at)
                open_arcs.pop()
                at -= length[path.pop()]
        packed = array("i", path).tobytes()
        if len(self.arcs) >= ARCS_KEPT:
            self.arcs.clear()
        self.words[word] = packed
        return packed

    def encode(self, text: str, split) -> bytes:
        """Packed token ids of a text."""
        words = self.words
        if not any(s in text for s in self.special):
            return b"".join([words.get(w) or self.encode_word(w) for w in split(text)])
        cut = "(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
        return b"".join([self._encode_part(part, split) for part in regex.split(cut, text)])

    def _encode_part(self, part: str, split) -> bytes:
        return array("i", [self.special[part]]).tobytes() if part in self.special else self.encode(part, split)

    def decode(self, ids: list[int]) -> str:
        labels = self.labels
        return b"".join([labels[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Automaton:
    """Compile a tokenizer file once per process."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return Automaton(model["vocab"], merges, special)


def _encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, split = load(path), regex.compile(pattern).findall
        for batch in parts(batches):
            packed = [automaton.encode(text, split) for text in batch.column("text").to_pylist()]
            offsets = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), tokens], names=["id", "tokens"])

    return run


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(path)
        for batch in parts(batches):
            tokens = batch.column("tokens")
            values, ends = tokens.values.to_numpy(), tokens.offsets.to_numpy()
            decoded = pa.array([automaton.decode(values[a:b].tolist()) for a, b in pairwise(ends)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tokens"), decoded], names=["id", "tokens", "decoded"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PRE_SPLIT) -> DataFrame:
    """``id, tokens`` (array of int) per row; null counts as empty and gives no tokens.

    ``path`` names a byte-level BPE file on every machine.  Strings of special tokens inside a text become those
    tokens.  A text is one row however long it is; its words are encoded one by one.  Repeated rows are repeated.
    """
    rows = id_and_text(docs, id_col, text_col)
    schema = rows.select("id", F.array().cast("array<int>").alias("tokens")).schema
    return rows.mapInArrow(_encoded(path, pattern), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``id, tokens, decoded``: the labels of each row's tokens as UTF-8; null tokens decode to an empty text."""
    rows = encoded.select("id", F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens"))
    schema = rows.select("*", F.lit("").alias("decoded")).schema
    return rows.mapInArrow(_decoded(path), schema)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PRE_SPLIT) -> DataFrame:
    """``decode(encode(docs))`` in one step: a task has one Python process, and one automaton in memory, for both."""
    rows = id_and_text(docs, id_col, text_col)
    schema = rows.select("id", F.array().cast("array<int>").alias("tokens"), F.lit("").alias("decoded")).schema
    encoding, decoding = _encoded(path, pattern), _decoded(path)
    return rows.mapInArrow(lambda batches: decoding(encoding(batches)), schema)
