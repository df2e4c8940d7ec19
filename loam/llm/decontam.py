"""Benchmark decontamination by greedy string tiling.

Windows of ``LEAST`` words that a text shares with benchmark items are its seeds: both are hashed and joined, every distinct
seed of the text with all its places in the items, so that the work goes by those places and not by how often a text repeats a
seed.  An item whose words under shared seeds are too few for the coverage is left there.  For each other, running
Karp-Rabin matching marks the longest common runs of words first, without overlap in either, until none of ``LEAST`` words
is left; the tiles' share of the item is its coverage, wherever and in whatever order they stand in the text.  An item of
fewer than ``LEAST`` words is sought whole: its seed is all of it.

Texts are read once, whole, and never move: the items are sent to the tasks, in chunks of ``CHUNK_WORDS`` words at most, so that
what is broadcast is bounded however long the benchmark.  A longer benchmark takes a pass for each chunk, one after the other.
"""

from __future__ import annotations

import heapq
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loam.llm.common import filtered, materialize, window_sums, word_hashes

#: Words of a seed and of the shortest tile.
LEAST = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: Benchmark words broadcast at once (about 60 bytes for each in a worker).
CHUNK_WORDS = 2_000_000

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))


def plain(text: str | None) -> bytes:
    """Lower-case text; ASCII punctuation separates words."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PLAIN)


def _windows(tokens: list, marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, rolling hash) of each window without a marked token."""
    base, modulus = 1_000_003, (1 << 61) - 1
    top = pow(base, size, modulus)
    value, run = 0, 0
    for i, token in enumerate(tokens):
        if marked[i]:
            value, run = 0, 0
            continue
        value = (value * base + token + 1) % modulus
        run += 1
        if run > size:
            value = (value - (tokens[i - size] + 1) * top) % modulus
        if run >= size:
            yield i - size + 1, value


def _longest(p: list, t: list, marked_p: list[bool], marked_t: list[bool], size: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Maximal matches of ``size`` tokens or more; stops early at one of over twice the size."""
    places: dict[int, list[int]] = {}
    for start, value in _windows(t, marked_t, size):
        places.setdefault(value, []).append(start)
    found, longest = [], 0
    for i, value in _windows(p, marked_p, size):
        for j in places.get(value, ()):
            if i and j and p[i - 1] == t[j - 1] and not marked_p[i - 1] and not marked_t[j - 1]:
                continue  # part of the match one place before
            k = 0
            while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not marked_p[i + k] and not marked_t[j + k]:
                k += 1
            if k > 2 * size:
                return k, []
            if k >= size:
                found.append((-k, i, j))
                longest = max(longest, k)
    return longest, found


def tiles(p: list[int], t: list[int], marked_t: list[bool], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in p, start in t, length) of the item's tokens ``p`` in the text's tokens ``t``."""
    marked_p, marked_t, out = [False] * len(p), list(marked_t), []
    size = max(least, len(p) // 2)
    while True:
        longest, matches = _longest(p, t, marked_p, marked_t, size)
        if longest > 2 * size:
            size = longest
            continue
        heapq.heapify(matches)
        while matches:
            k, i, j = heapq.heappop(matches)
            free = [x for x in range(-k) if not (marked_p[i + x] or marked_t[j + x])]
            if len(free) == -k:
                out.append((i, j, -k))
                for x in free:
                    marked_p[i + x] = marked_t[j + x] = True
                continue
            start = 0
            for n in range(1, len(free) + 1):  # what other tiles have left of it, if long enough
                if n == len(free) or free[n] != free[n - 1] + 1:
                    if n - start >= size:
                        heapq.heappush(matches, (start - n, i + free[start], j + free[start]))
                    start = n
        if size > 2 * least:
            size //= 2
        elif size > least:
            size = least
        else:
            return sorted(out)


class Items:
    """A chunk of the benchmark: hashes of the items' words, one item after another, and all their seeds with their places."""

    def __init__(self, ids: list, texts: list[bytes]):
        self.ids = ids
        words = [word_hashes(t) for t in texts]
        self.length = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.words = np.concatenate([np.empty(0, np.uint64), *words])
        self.item_of = np.repeat(np.arange(len(words), dtype=np.int32), self.length)
        long = [i for i in range(len(words)) if len(words[i]) >= LEAST]
        values = np.concatenate([np.empty(0, np.uint64), *(window_sums(words[i], LEAST) for i in long)])
        places = np.concatenate([np.empty(0, np.int64), *(np.arange(self.length[i] - LEAST + 1) + self.first[i] for i in long)])
        order = np.argsort(values, kind="stable")
        self.values, self.places = values[order], places[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.values >> np.uint64(42)] = True
        self.short: dict[int, dict[int, list[int]]] = {}  # by length, items shorter than a seed by their one seed
        for i, w in enumerate(words):
            if len(w) < LEAST:
                self.short.setdefault(len(w), {}).setdefault(int(window_sums(w, len(w))[0]), []).append(i)

    def own(self, item: int) -> np.ndarray:
        return self.words[self.first[item] : self.first[item] + self.length[item]]

    def covered(self, seeds: np.ndarray, coverage: float) -> np.ndarray:
        """Items that have enough words under some distinct seeds."""
        low, high = np.searchsorted(self.values, seeds, "left"), np.searchsorted(self.values, seeds, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        under = np.unique((self.places[at][:, None] + np.arange(LEAST)).ravel())
        items, n = np.unique(self.item_of[under], return_counts=True)
        return items[n >= coverage * self.length[items]]

    def whole(self, words: np.ndarray) -> dict[int, int]:
        """Items shorter than a seed that stand whole in a text, each with its first place."""
        out: dict[int, int] = {}
        for n, items in self.short.items():
            h = window_sums(words, n)
            for place in np.flatnonzero(np.isin(h, np.array(list(items), np.uint64))).tolist():
                for item in items[int(h[place])]:
                    if item not in out and (words[place : place + n] == self.own(item)).all():
                        out[item] = place
        return out

    def matches(self, text: str | None, coverage: float) -> list[tuple]:
        """(item id, coverage, tiles) of the items that the text covers enough of; tiles by words of item and text."""
        words, found = word_hashes(plain(text)), []
        h = window_sums(words, LEAST)
        at = np.flatnonzero(self.maybe[h >> np.uint64(42)])
        seeds = h[at]
        for item in self.covered(np.unique(seeds), coverage).tolist() if len(at) else ():
            target = self.own(item)
            held = np.zeros(len(words), bool)
            for k, place in enumerate([at[np.isin(seeds, window_sums(target, LEAST))]] * LEAST):
                held[place + k] = True
            # Only words in seeds can be in tiles: the rest becomes one marked token between their runs.  Of runs that repeat no
            # more are kept than an item of this length has tiles.
            edges = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).view(np.int8)))
            times: Counter = Counter()
            where: list[int] = []
            for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
                key = words[a:b].tobytes()
                times[key] += 1
                if times[key] <= len(target) // LEAST:
                    where.extend(range(a, b))
                    where.append(-1)
            place = np.array(where)
            numbers = np.unique(np.concatenate([target, words[place]]), return_inverse=True)[1]
            numbers[len(target) :][place < 0] = -1
            got = tiles(numbers[: len(target)].tolist(), numbers[len(target) :].tolist(), (place < 0).tolist())
            got = [(i, where[j], k) for i, j, k in got]
            share = sum(k for _, _, k in got) / len(target)
            if share >= coverage:
                found.append((self.ids[item], share, got))
        for item, place in self.whole(words).items() if self.short else ():
            found.append((self.ids[item], 1.0, [(0, place, int(self.length[item]))]))
        return found


#: The chunk that this process matched last, by its name: tasks that a worker runs one after another share it.
_built: dict[str, Items] = {}


def built(name: str, ids: list, texts: list[bytes]) -> Items:
    if name not in _built:
        _built.clear()
        _built[name] = Items(ids, texts)
    return _built[name]


def item_chunks(benchmark: DataFrame, item_col: str, text_col: str, chunk_words: int) -> list[DataFrame]:
    """The benchmark by chunks of about ``chunk_words`` words, at least one chunk."""
    words = F.size(F.split(F.col(text_col), r"[^\p{L}\p{N}]+"))
    total = benchmark.select(F.sum(words)).first()[0] or 0
    chunks = max(1, -(-int(total) // chunk_words))
    rows = benchmark.select(F.col(item_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    return [rows.filter(F.pmod(F.xxhash64("id", "body"), F.lit(chunks)) == k) if chunks > 1 else rows for k in range(chunks)]


def items_of(chunk: DataFrame) -> tuple[str, list, list[bytes]]:
    """A name, ids and texts of a chunk's items, bounded by the chunk.  Items without a word are left out."""
    got = sorted(((r[0], plain(r[1])) for r in chunk.collect()), key=repr)
    got = [(i, t) for i, t in got if t.split()]
    return uuid.uuid4().hex, [i for i, _ in got], [t for _, t in got]


def find(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, chunk_words: int = CHUNK_WORDS
) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest, tiles for each document and item that it covers enough of.

    tiles: ``item:text:words`` by word positions.  Null and empty texts and items match nothing; an item of
    fewer than five words matches whole only.  Repeated rows and items are matched each for itself; null ids are carried.  Other columns are not read.
    """
    schema = f"doc_id {df.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, coverage double, n_tiles long, longest long, tiles string"
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    out = None
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    for chunk in item_chunks(benchmark, item_col, item_text_col, chunk_words):
        sent = df.sparkSession.sparkContext.broadcast(items_of(chunk))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = built(*sent.value)
            kind = None
            for batch in batches:
                kind = batch.schema.field(0).type
                which, got = [], []
                for i, body in enumerate(batch.column(1)):
                    for x in items.matches(body.as_py(), coverage):
                        which.append(i)
                        got.append(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(which, pa.int64())).cast(kind),
                        pa.array([x[0] for x in got], item_type),
                        pa.array([x[1] for x in got], pa.float64()),
                        pa.array([len(x[2]) for x in got], pa.int64()),
                        pa.array([max(k for _, _, k in x[2]) for x in got], pa.int64()),
                        pa.array([",".join(f"{i}:{j}:{k}" for i, j, k in x[2]) for x in got], pa.string()),
                    ],
                    names=["doc_id", "item_id", "coverage", "n_tiles", "longest", "tiles"],
                )

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The rows of ``df`` that cover no item, with all their columns.

    Rows with a null or empty text stay, as do all if the benchmark is empty; repeated rows stay or go together.  With more
    than one chunk what a pass keeps is written, so that no task holds two chunks.
    """
    at = df.columns.index(text_col)
    chunks = item_chunks(benchmark, item_col, item_text_col, chunk_words)
    for k, chunk in enumerate(chunks):
        sent = df.sparkSession.sparkContext.broadcast(items_of(chunk))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = built(*sent.value)
            for batch in batches:
                yield batch.filter(pa.array([not items.matches(x.as_py(), coverage) for x in batch.column(at)], pa.bool_()))

        df = filtered(df, run)
        if k + 1 < len(chunks):
            df = materialize(df, "clean")
    return df
