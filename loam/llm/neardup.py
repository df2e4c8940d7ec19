"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

A text's signature is ``TREES`` strings of ``DEEPEST`` minima.  A tree is the sorted prefix trie of one such string of every
text: its nodes are prefixes, kept as (prefix of ``FLOOR`` minima, the further minima packed into one number whose order is
the trie's), and texts meet where they share a node.  Every text starts at the full depth in all trees, and its prefixes
are shortened, one minimum in one tree at a time, until a pair at the threshold shares one of them with the target
probability.  Of all trees the next to be shortened is the one whose shorter prefix leads to the smallest node, where
nodes of up to ``CROWD`` texts count alike and the deepest tree goes first.  So a text beside which there is no crowd goes up in all trees
evenly; one whose minima in some trees come from a passage that very many texts share stays deep there and is shortened
further in the others.  (Small nodes count alike since a choice by single neighbours would avoid the very trees in which they
are met, and the probability would not hold.)  Two texts meet where either's prefix is the other's too.

Everything runs over distinct texts, so copies cost nothing.

1. Nodes at the least depth that one text alone has are left out first; nodes below are counted only where there are crowds.
2. A node's texts are cut into chunks, and each pair of chunks goes to a task of its own; there a walk over whole signatures
   links texts that may reach the threshold.  What leaves is a star for each linked set, never its pairs.
3. Connected components of the stars are candidate clusters.  Any pair above the threshold that met lies in one.
4. All pairs of a cluster are verified exactly.  Each text is compared once with the cluster's centre, and from then on it is
   the set of 64-bit hashes of the shingles in which the two differ: sizes of intersections follow from those.  These sets are
   dealt by pairs of chunks and multiplied as matrices.  What leaves is, for each text, its number of links and the root of its
   linked set: counts and stars, never pairs.
5. Components of the verified stars are the classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import checkpointed, materialize, mix64, parts_for, quoted, unused, window_sums, word_hashes
from loam.llm.graph import components

NGRAM = 5
#: Similarity as a fraction, so that the test is exact.
THRESHOLD = (4, 5)
TREES = 20
#: Greatest and least length of a prefix; at the least one in all trees a pair at the threshold meets with probability 0.99997.
DEEPEST = 8
FLOOR = 4
TARGET = 0.9999
#: Nodes of more texts are avoided while the target allows it.
CROWD = 1024
#: Signatures that agree in fewer places are not verified: over four standard deviations below the threshold.
SIGNATURE_LEAST = 0.65
#: Texts of a node that one chunk holds at least and at most; between them a node has ``NODE_CHUNKS`` chunks.
NODE_CHUNK = 256
NODE_CHUNKS = 64
NODE_CHUNK_MOST = 1 << 18
#: Texts or differing shingles of a cluster that one chunk holds.
CLUSTER_CHUNK = 1024
CLUSTER_SHINGLES = 2_000_000
#: Cells of text keys; a set of them is broadcast to spare other texts a shuffle.
CELLS = 1 << 20
#: A text with more copies than this, or than a ``HOT_SHARE``-th of all rows, is spread when its rows get their result.
HOT_COPIES = 100_000
HOT_SHARE = 10_000

_RNG = np.random.default_rng(20_240_229)
_MULTIPLY = _RNG.integers(0, 2**31, TREES * DEEPEST, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, TREES * DEEPEST, dtype=np.uint32)


def depths(sizes: np.ndarray, threshold: float = THRESHOLD[0] / THRESHOLD[1], target: float = TARGET, crowd: int | None = None) -> list[int]:
    """Length of a text's prefix in each tree; ``sizes`` has a row for each tree: texts of its nodes at ``FLOOR`` to ``DEEPEST``."""
    crowd = CROWD if crowd is None else crowd
    cost = np.where(sizes > crowd, sizes, 0).tolist()
    miss = [np.log1p(-min(threshold**d, 1 - 1e-12)) for d in range(FLOOR, DEEPEST + 1)]
    most = np.log1p(-target)
    at = [DEEPEST - FLOOR] * len(cost)
    while sum(miss[d] for d in at) > most and any(at):
        tree = min((i for i in range(len(at)) if at[i]), key=lambda i: (cost[i][at[i] - 1], -at[i], i))
        at[tree] -= 1
    return [FLOOR + d for d in at]


def shingles(raw: bytes, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of all n-word windows; of all words if there are fewer, none if there is no word."""
    h = word_hashes(raw)
    if not len(h):
        return h
    s = np.sort(window_sums(h, min(n, len(h))))
    return s[np.concatenate([[True], s[1:] != s[:-1]])]


def minima(s: np.ndarray) -> np.ndarray:
    """Least values of the shingles under 32-bit linear permutations."""
    out = np.full(TREES * DEEPEST, 0xFFFFFFFF, np.uint32)
    high = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 1024):
        x = high[None, at : at + 1024] * _MULTIPLY[:, None]
        x += _ADD[:, None]
        np.minimum(out, x.min(1), out=out)
    return out


def labels(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each tree the prefix of ``FLOOR`` minima, mixed, and the further minima, each mixed into 16 bits, packed in order."""
    m = m.reshape(TREES, DEEPEST)
    prefix, rest = np.arange(TREES, dtype=np.uint64), np.zeros(TREES, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(FLOOR):
            prefix = mix64(prefix * np.uint64(31) + m[:, k].astype(np.uint64))
        for k in range(FLOOR, DEEPEST):
            rest = rest << np.uint64(16) | (m[:, k] * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint64)
    return prefix.view(np.int64), rest.view(np.int64)


def signature(m: np.ndarray) -> bytes:
    """A byte of each minimum, mixed: of different minima one in 256 agrees."""
    return (m * np.uint32(0x85EBCA6B) >> np.uint32(24)).astype(np.uint8).tobytes()


def text_key(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        keys, counts, prefix, rest, signed = [], [], [], [], []
        for x in batch.column(1):
            raw = x.as_py() or b""
            key = hashlib.md5(raw).digest()
            keys.append(key)
            if key in seen:  # a copy in the same task
                for column in (counts, prefix, rest, signed):
                    column.append(None)
                continue
            if len(seen) < 500_000:
                seen.add(key)
            s = shingles(raw)
            m = minima(s)
            p, r = labels(m) if len(s) else ([], [])
            counts.append(len(s))
            prefix.append(p)
            rest.append(r)
            signed.append(signature(m))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(rest, pa.list_(pa.int64())), pa.array(signed, pa.binary())],
            names=["doc_id", "key", "shingles", "prefix", "rest", "signature"],
        )


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the groups' bounds; rows come sorted by the first ``keys`` integer columns."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        cuts = _cuts(held, keys)
        if len(cuts):
            yield held.slice(0, cuts[-1]), np.concatenate([[0], cuts])
            held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held, np.concatenate([[0], _cuts(held, keys), [held.num_rows]])


def _cuts(table: pa.Table, keys: int) -> np.ndarray:
    change = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in range(keys):
        change |= np.diff(table.column(k).to_numpy()) != 0
    return np.flatnonzero(change) + 1


def _blocks(df: DataFrame, id_col: str, chunks: str) -> DataFrame:
    """Each row once for every pair of chunks that its chunk belongs to: columns chunk, low, high."""
    df = df.withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), id_col), F.col(chunks)).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(chunks) - 1).cast("int"))))
    return df.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")}).drop("other", chunks)


def _walk(linked: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """Root (least position) of each of n items: a walk that compares found items with those not yet reached."""
    root = np.full(n, -1)
    left = np.arange(n)
    while len(left):
        first, front = left[0], left[:1]
        root[first] = first
        left = left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for at in range(0, len(front), 64):
                some = np.flatnonzero(~hit)
                if not len(some):
                    break
                hit[some] |= linked(front[at : at + 64], left[some])
            front, left = left[hit], left[~hit]
            root[front] = first
    return root


def _node_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns node, low, high, uid, signature; gives (u, v) with v the root of u."""
    least = int(SIGNATURE_LEAST * TREES * DEEPEST)
    for table, bounds in _runs(batches, 3):
        uid = table.column("uid").to_numpy()
        width = TREES * DEEPEST
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, width)
        us, vs = [], []
        size = np.diff(bounds)
        pairs = bounds[:-1][size == 2]
        close = (sig[pairs] == sig[pairs + 1]).sum(1) >= least
        us.append(np.maximum(uid[pairs], uid[pairs + 1])[close])
        vs.append(np.minimum(uid[pairs], uid[pairs + 1])[close])
        for i in np.flatnonzero(size > 2):
            a, b = bounds[i], bounds[i + 1]
            order = np.argsort(uid[a:b])
            ids, own = uid[a:b][order], sig[a:b][order]

            def linked(x: np.ndarray, y: np.ndarray, own: np.ndarray = own) -> np.ndarray:
                out = np.zeros(len(y), bool)
                for at in range(0, len(y), 1024):
                    out[at : at + 1024] = ((own[x][:, None, :] == own[y[at : at + 1024]][None, :, :]).sum(2) >= least).any(0)
                return out

            root = _walk(linked, b - a)
            us.append(ids)
            vs.append(ids[root])
        u, v = np.concatenate(us), np.concatenate(vs)
        yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])


def intersections(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of sets with each other, or of those of ``a`` with those of ``b``."""
    n = len(a)
    every = a + (b or [])
    values = np.concatenate(every)
    owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
    order = np.argsort(values, kind="stable")
    new = np.concatenate([[True], np.diff(values[order]) != 0]) if len(values) else np.empty(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(values) else new
    owner, column = owner[order][shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((n, len(b) if b is not None else n), np.float32)
    for at in range(0, int(column.max()) + 1 if len(column) else 0, 2048):
        lo, hi = np.searchsorted(column, [at, at + 2048])
        dense = np.zeros((len(every), 2048), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1
        out += dense[:n] @ (dense[:n] if b is None else dense[n:]).T
    return out.astype(np.int64)


def similar(inter: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    p, q = THRESHOLD
    union = size_a[:, None] + size_b[None, :] - inter
    return (q * inter >= p * union) & (inter > 0)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns cid, salt, member, uid, body, the centre first in each (cid, salt); gives cid, uid, centre, size, shared, n_diff, diff.

    centre: shingles of the cluster's centre; size: those of the text; shared: those of both; diff: those of one alone.
    """
    group, middle, last = None, np.empty(0, np.uint64), None
    for batch in batches:
        out = []
        columns = (batch.column(k).to_pylist() for k in range(4))
        for cid, salt, member, uid, body in zip(*columns, batch.column(4), strict=True):
            if (cid, salt) != group:
                group, last = (cid, salt), None
                middle = shingles(body.as_py())
            if member and uid != last:
                own = shingles(body.as_py())
                diff = np.setxor1d(own, middle, assume_unique=True)
                last = uid
                out.append((cid, uid, len(middle), len(own), (len(own) + len(middle) - len(diff)) // 2, len(diff), diff.tobytes()))
        kinds = [pa.int64()] * 6 + [pa.binary()]
        columns = list(zip(*out, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["cid", "uid", "centre", "size", "shared", "n_diff", "diff"])


def _cluster_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns cid, low, high, chunk, uid, centre, size, shared, diff; gives uid, links, root for each row of a pair of chunks.

    Two texts share the centre's shingles that neither lacks and the others that both have; as a shingle is either the
    centre's or not, that is shared + shared - centre + the number of their common differences.
    """
    for table, bounds in _runs(batches, 3):
        low, high, chunk, uid, centre, size, shared = (table.column(c).to_numpy() for c in ("low", "high", "chunk", "uid", "centre", "size", "shared"))
        diff, out = table.column("diff"), []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            sets = [np.frombuffer(diff[i].as_py(), np.uint64) for i in range(a, b)]
            ids, n, with_centre = uid[a:b], size[a:b], shared[a:b]
            near = np.zeros((b - a, b - a), bool)
            if low[a] == high[a]:
                near |= similar(intersections(sets) + with_centre[:, None] + with_centre[None, :] - centre[a], n, n)
                np.fill_diagonal(near, False)
            else:
                first = chunk[a:b] == low[a]
                x, y = np.flatnonzero(first), np.flatnonzero(~first)
                both = intersections([sets[i] for i in x], [sets[i] for i in y]) + with_centre[x][:, None] + with_centre[y][None, :] - centre[a]
                near[np.ix_(x, y)] = similar(both, n[x], n[y])
                near |= near.T
            links = near.sum(1)
            order = np.argsort(ids)
            near = near[np.ix_(order, order)]
            root = _walk(lambda f, r, near=near: near[np.ix_(f, r)].any(0), b - a)
            out.append((ids[order], links[order], ids[order][root]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["uid", "links", "root"])


def _key_of(name: str) -> Column:
    """Text of an id that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("-"))


def _node(depth: Column) -> Column:
    """The trie's node of columns tree, prefix, rest at a depth."""
    return F.xxhash64("tree", "prefix", depth, F.when(depth == FLOOR, F.lit(0).cast("long")).otherwise(F.expr(f"shiftrightunsigned(rest, cast(16 * ({DEEPEST} - depth) as int))")))


def _depths_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns uid and counts, an array of (tree, depth, n) of crowded nodes; gives uid and the depth in each tree."""
    for batch in batches:
        out = []
        for counts in batch.column(1).to_pylist():
            sizes = np.zeros((TREES, DEEPEST - FLOOR + 1), np.int64)
            for c in counts:
                sizes[c["tree"], c["depth"] - FLOOR] = c["n"]
            out.append(depths(sizes))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["uid", "depths"])


def forest(once: DataFrame) -> DataFrame:
    """node, uid of all nodes of two texts or more at which some text has stopped, with those of all texts below it.

    ``once`` has uid, prefix and rest.
    """
    every = once.select("uid", F.posexplode(F.arrays_zip("prefix", "rest")).alias("tree", "x")).select("uid", "tree", F.col("x.prefix").alias("prefix"), F.col("x.rest").alias("rest"))
    shared = every.groupBy("tree", "prefix").agg(F.count("*").alias("n")).filter("n > 1")
    leaves = materialize(every.join(shared, ["tree", "prefix"]), "leaves")
    usual = F.array(*map(F.lit, depths(np.zeros((TREES, DEEPEST - FLOOR + 1)))))
    crowded = leaves.filter(F.col("n") > CROWD)
    if crowded.isEmpty():
        planned = leaves.withColumn("depths", usual)
    else:
        levels = crowded.withColumn("depth", F.explode(F.sequence(F.lit(FLOOR), F.lit(DEEPEST)))).select("uid", "tree", "depth", _node(F.col("depth")).alias("node"))
        crowds = levels.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD)
        # At most TREES * (DEEPEST - FLOOR + 1) counts a text.
        counts = levels.join(crowds, "node").groupBy("uid").agg(F.collect_list(F.struct("tree", "depth", "n")).alias("counts"))
        own = counts.select("uid", "counts").mapInArrow(_depths_of, "uid long, depths array<int>")
        planned = leaves.join(own, "uid", "left").withColumn("depths", F.coalesce("depths", usual))
    stop = planned.withColumn("stop", F.expr("depths[tree]")).withColumn("depth", F.explode(F.sequence(F.lit(FLOOR), F.col("stop"))))
    entries = stop.select(_node(F.col("depth")).alias("node"), "uid", (F.col("depth") == F.col("stop")).alias("asks"))
    nodes = entries.groupBy("node").agg(F.count("*").alias("n"), F.max("asks").alias("asked")).filter("n > 1 and asked").drop("asked")
    return entries.drop("asks").join(nodes, "node")


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, uid) of every row, uid its own, and key, text_id, n_copies, n_links, root of every different text."""
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("body"))
    made = rows.mapInArrow(_features, f"doc_id {id_type}, key binary, shingles long, prefix array<long>, rest array<long>, signature binary")
    features = materialize(made.withColumn("uid", F.monotonically_increasing_id()), "features")
    own = F.when(F.col("prefix").isNotNull(), F.col("uid"))
    parts = parts_for(features.count())
    texts = checkpointed(features.groupBy("key").agg(F.min(own).alias("uid"), F.min("doc_id").alias("text_id"), F.count("*").alias("n_copies")), parts)
    once = features.filter("prefix is not null").select("uid", "prefix", "rest", "signature").join(texts.select("uid"), "uid", "left_semi")
    once = materialize(once.coalesce(parts), "once")

    chunks = F.greatest(F.least(F.ceil(F.col("n") / NODE_CHUNK), F.lit(NODE_CHUNKS)), F.ceil(F.col("n") / NODE_CHUNK_MOST)).cast("int")
    met = _blocks(forest(once).withColumn("chunks", chunks).drop("n"), "uid", "chunks").drop("chunk")
    signed = met.join(once.select("uid", "signature"), "uid").select("node", "low", "high", "uid", "signature")
    dealt = signed.repartition("node", "low", "high").sortWithinPartitions("node", "low", "high", "uid")
    clusters = components(dealt.mapInArrow(_node_stars, "u long, v long")).select(F.col("node").alias("uid"), F.col("root").alias("cid"))

    salts = clusters.groupBy("cid").agg(F.ceil(F.count("*") / CLUSTER_CHUNK).cast("int").alias("salts"))
    members = clusters.join(salts, "cid").withColumns({"salt": F.pmod(F.xxhash64(F.lit(5), "uid"), F.col("salts")).cast("int"), "member": F.lit(True)})
    centres = salts.select(F.col("cid").alias("uid"), "cid", "salts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"))
    asked = checkpointed(members.select("uid", "cid", "salt", "member").unionByName(centres.select("uid", "cid", "salt", "member")), parts)
    wanted = asked.join(texts.select("uid", "key", _key_of("text_id").alias("id")), "uid")
    placed = _bodies(df, id_col, text_col, wanted).select("cid", "salt", "member", "uid", "body")
    grouped = placed.repartition("cid", "salt").sortWithinPartitions("cid", "salt", "member", "uid")
    apart = materialize(grouped.mapInArrow(_differences, "cid long, uid long, centre long, size long, shared long, n_diff long, diff binary"), "apart")
    chunks = apart.groupBy("cid").agg(F.greatest(F.ceil(F.count("*") / CLUSTER_CHUNK), F.ceil(F.sum("n_diff") / CLUSTER_SHINGLES)).cast("int").alias("chunks"))
    dealt = _blocks(apart.drop("n_diff").join(chunks, "cid"), "uid", "chunks").select("cid", "low", "high", "chunk", "uid", "centre", "size", "shared", "diff")
    dealt = dealt.repartition("cid", "low", "high").sortWithinPartitions("cid", "low", "high", "uid")
    links = checkpointed(dealt.mapInArrow(_cluster_links, "uid long, links long, root long"))

    counts = links.groupBy("uid").agg(F.sum("links").alias("n_links"))
    roots = components(links.select(F.col("uid").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("uid"), "root")
    known = texts.join(counts, "uid", "left").join(roots, "uid", "left")
    known = known.select("key", "text_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "uid").alias("root"))
    return features.select("doc_id", "key", "uid"), checkpointed(known, parts)


def _cell(key: str) -> Column:
    """One of ``CELLS`` that a text's key falls in."""
    return F.pmod(F.xxhash64(F.lit(41), key), F.lit(CELLS)).cast("int")


def _cells(keys: DataFrame, key: str, name: str) -> DataFrame:
    """The cells of some keys, for a broadcast of ``CELLS`` small rows at most: a text whose cell is not among them is
    none of those texts and need not be shuffled to find that out."""
    return F.broadcast(keys.select(_cell(key).alias(name)).distinct())


def _bodies(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (key, id and others) with their body.  The id takes part in the join, so that copies do not
    meet in one task; repeated rows are combined before they move."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body")
    keyed = df.select(text_key(text_col).alias("key"), _key_of(id_col).alias("id"), body)
    maybe = keyed.withColumn("cell", _cell("key")).join(_cells(wanted, "key", "cell"), "cell", "left_semi").drop("cell")
    return maybe.groupBy("key", "id").agg(F.first("body").alias("body")).join(wanted, ["key", "id"])


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, text_id, n_copies, n_links of every row of ``df``.

    Equal texts are one text: text_id is the least id that has it, n_copies the number of its rows.  n_links is the
    number of different texts with a Jaccard similarity of 0.8 or more on five-word shingles, and class_id the least
    id of the connected component.  A text of fewer than five words is one shingle.  A null text equals an empty one,
    and texts without a word link to none.  Null ids are left out of minima; a class of null ids alone has a null id.
    Repeated rows give repeated results, other columns are not read, an empty table gives no rows.
    """
    rows, texts = classify(df, id_col, text_col)
    n = rows.count()
    classes = texts.groupBy("root").agg(F.min("text_id").alias("class_id"))
    known = texts.join(classes, "root").select("key", "class_id", "text_id", "n_copies", "n_links")
    most = max(HOT_COPIES, n // HOT_SHARE)  # fewer than HOT_SHARE texts have more copies: the broadcast's bound
    hot = F.broadcast(known.filter(F.col("n_copies") > most).select("key", F.ceil(F.col("n_copies") / most).alias("salts")))
    spread = rows.join(hot, "key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("uid"), "salts"), F.lit(0).cast("long")))
    own = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n_copies") > most, F.ceil(F.col("n_copies") / most) - 1).otherwise(F.lit(0).cast("long")))))
    found = spread.select("doc_id", "key", "salt").join(own, ["key", "salt"]).select("doc_id", "class_id", "text_id", "n_copies", "n_links")
    return found.coalesce(parts_for(n))  # narrow rows: few files, however many partitions the join has


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that of the least id (null ids last), with all its columns, whatever their names.

    Only rows whose text may have a copy or belong to another's class are shuffled; all others stay where they are.  Of rows that
    repeat in id and text any one stays.
    """
    _, texts = classify(df, id_col, text_col)
    least = F.min(F.struct(F.col("text_id").isNull().alias("last"), "text_id", "key")).alias("w")
    winners = texts.groupBy("root").agg(least)
    losers = texts.join(winners, "root").filter((F.col("n_copies") > 1) | (F.col("key") != F.col("w.key")))
    the_id, the_key, the_cell = unused(df, "id"), unused(df, "key"), unused(df, "cell")
    cells = _cells(losers, "key", the_cell)
    keyed = df.withColumns({the_id: _key_of(id_col), the_key: text_key(text_col)}).withColumn(the_cell, _cell(the_key))
    alone = keyed.join(cells, the_cell, "left_anti").select(*quoted(df))
    kept = winners.select(_key_of("w.text_id").alias(the_id), F.col("w.key").alias(the_key))
    others = keyed.join(cells, the_cell, "left_semi").join(kept, [the_id, the_key], "left_semi")
    return alone.unionByName(others.dropDuplicates([the_id, the_key]).select(*quoted(df)))
