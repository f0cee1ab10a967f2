"""Words of a text as 64-bit hashes, and hashes of word runs; used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORDS_KEPT = 200_000
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """Hashes of the words of texts, A to Z read as a to z; words seen before are remembered, up to a bound."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, text: str) -> np.ndarray:
        # on bytes, lower() and split() know ASCII alone: A to Z, and the six gaps between words
        words = text.encode().lower().split()
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        hashes = list(map(known.get, words))
        if None in hashes:
            for at, found in enumerate(hashes):
                if found is None:
                    hashes[at] = known[words[at]] = xxhash.xxh64_intdigest(words[at])
        return np.array(hashes, np.uint64)


def hashes_of_all(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What ``WordHasher`` gives for an array of texts: the hashes of all, one text after another, and the number of words of each."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten().dictionary_encode()
    spelled = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, spelled)), ">u8").astype(np.uint64)
    sizes, places = split.value_lengths().to_numpy().astype(np.int64), words.indices.to_numpy()
    if b"" in spelled:  # before the first gap or after the last
        real = places != spelled.index(b"")
        sizes = np.diff(np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], np.cumsum(sizes)])])
        places = places[real]
    return hashes[places], sizes


def by_text(flat: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Values one after another as an array for each size."""
    end = 0
    for size in sizes.tolist():
        yield flat[end : end + size]
        end += size


def runs(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order; of the whole text where it is shorter; none for no words."""
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    rolled = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        rolled = rolled * SPREAD + h[k : k + n]
        rolled ^= rolled >> np.uint64(29)
    return mixed(rolled)
