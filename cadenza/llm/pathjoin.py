"""MinHash near-duplicates by a chosen-path set similarity join.

Each document is the set of its word shingles, with ``PER_TREE`` minwise values
for each of ``TREES`` trees. A tree reads its own values alone, so trees are
independent: a node picks one of the tree's coordinates (a quarter of the nodes
two, so a pair at the threshold is expected to stay together in one child), and
sends each of its documents to the child named by that coordinate's value. Documents of a small node are compared
exhaustively on sketches (the least hash in each of ``BINS`` bins); what looks
close is confirmed on the full sets. Equal sets count once.

Candidates come in three passes, so that copies are not expanded into pairs.
The first gives each group of close documents of a node a few hubs, linked with
the others. The next two look only across the components found: first at one link from
each component of a node to another, then at all that are left; that last pass compares
full sets inside the nodes, since sketches let many pairs just below the
threshold through. Nodes beyond ``NODE``
documents branch on; at ``DEEPEST`` they are cut into blocks that share one
document, and every document outside such a node's main component then meets
all its documents, by pairs of bounded parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from cadenza.llm.common import released, small_batches, stored

TREES, PER_TREE, DEPTH, DEEPEST, NODE = 12, 16, 3, 9, 512
COORDINATES = TREES * PER_TREE
#: A node's number ends in that of its tree.
TREE = 15
#: A pair is a candidate unless its sketches are so many standard deviations below the threshold.
BINS, DEVIATIONS = 256, 4.0
#: Nodes hold full sets up to so many shingles; pairs with a longer one go by sketch alone.
FULL, COLUMNS = 4096, 4096
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: dict, n: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of the whole text; fewer words than ``n`` are one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def minwise(values: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """16 bits of each coordinate's least value, over permutations of the hashes' lower halves."""
    low = values.astype(np.uint32)
    out = np.full(len(seeds[0]), np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(low), 512):
        out = np.minimum(out, (low[None, i : i + 512] * seeds[0][:, None] + seeds[1][:, None]).min(axis=1))
    return out.astype(np.uint16)


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 32, (2, COORDINATES), dtype=np.uint32)
    return a | np.uint32(1), b


def sketch(values: np.ndarray) -> np.ndarray:
    """Of sorted hashes, a byte of the least in each bin of the hashes' range; 0 for an empty bin."""
    bins = (values >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, dtype=np.uint8)
    out[bins[first]] = mix(values[first]) % np.uint64(255) + np.uint64(1)
    return out


def sets(docs: DataFrame, n: int = 2) -> DataFrame:
    """``doc_id, n_shingles, set_key, minhash, sketch``; empty sets have a null key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seeds = WordHashes(), coefficients()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingles(text, hashes, n)
                rows.append((doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, minwise(s, seeds).tobytes() if len(s) else None, sketch(s).tobytes() if len(s) else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_key", "minhash", "sketch"]).astype({"doc_id": "Int64"})

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(lambda b: released(run(b)), "doc_id long, n_shingles long, set_key binary, minhash binary, sketch binary")


def full_sets(docs: DataFrame, n: int = 2) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "set": [shingles(t, hashes, n).tobytes() for t in batch["text"]]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(lambda b: released(run(b)), "doc_id long, set binary")


def paths(sig: np.ndarray, node: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) after ``depth`` more levels; sig: minwise values by row, node: a node of each row."""
    rows = np.arange(len(sig))
    for _ in range(depth):
        twice = np.flatnonzero((mix(node) >> np.uint64(32)) % np.uint64(4) == 0)
        parts = []
        for r, at, turn in ((rows, node, 0), (rows[twice], node[twice], 1)):
            tree = at & np.uint64(TREE)
            c = (tree * np.uint64(PER_TREE) + mix(at + np.uint64((turn + 1) << 8)) % np.uint64(PER_TREE)).astype(np.int64)
            child = mix(mix(at + np.uint64((turn + 7) << 8)) ^ (sig[r, c].astype(np.uint64) + (c.astype(np.uint64) << np.uint64(16))))
            parts.append((r, child & np.uint64(MASK ^ TREE) | tree))
        rows, node = (np.concatenate(x) for x in zip(*parts, strict=True))
    return rows, node


def branch(df: DataFrame, depth: int, trees: int = 0) -> DataFrame:
    """``(node, rep)`` rows below the roots of ``trees`` trees, or below the column ``node``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch["minhash"]), np.uint16).reshape(len(batch), COORDINATES)
            reps = batch["rep"].to_numpy()
            starts = [mix(np.full(len(sig), 1000 + t, dtype=np.uint64)) & np.uint64(MASK ^ TREE) | np.uint64(t) for t in range(trees)] or [batch["node"].to_numpy().view(np.uint64)]
            for start in starts:
                rows, node = paths(sig, start, depth)
                yield pd.DataFrame({"node": node.view(np.int64), "rep": reps[rows]}).drop_duplicates()

    return df.mapInPandas(lambda b: released(run(b)), "node long, rep long")


def grouped(reps: DataFrame) -> DataFrame:
    """``node, whole, rep`` of all nodes that hold two documents or more.

    ``whole`` names the uncut node where a node is a block of one.
    """
    rows = branch(reps, DEPTH, TREES)
    small = None
    for depth in range(DEPTH, DEEPEST + 1, 3):
        rows = stored(rows)
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("hub")).filter("size > 1")
        sized = rows.join(sizes, "node")
        some = sized.filter(F.col("size") <= NODE).select("node", F.lit(None).cast("long").alias("whole"), "rep")
        small = some if small is None else small.unionByName(some)
        large = sized.filter(F.col("size") > NODE)
        if large.isEmpty():
            break
        if depth < DEEPEST:
            rows = branch(large.select("node", "rep").join(reps.select("rep", "minhash"), "rep"), 3)
        else:
            cut = large.withColumn("block", F.pmod(F.xxhash64("rep", "node"), F.ceil(F.col("size") / (NODE - 1)).cast("int")))
            hubs = cut.select("node", "block", F.col("hub").alias("rep")).distinct()
            blocks = cut.select("node", "block", "rep").unionByName(hubs).distinct()
            small = small.unionByName(blocks.select(F.xxhash64("node", "block").alias("node"), F.col("node").alias("whole"), "rep"))
    return small


def closeness(sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(close, estimate), each n x n above the diagonal, of a node's sketches."""
    n = len(sig)
    close, estimate = np.zeros((n, n), dtype=bool), np.zeros((n, n), dtype=np.float32)
    full = sig > 0
    for i in range(n - 1):
        either = np.maximum((full[i + 1 :] | full[i]).sum(axis=1), 1)
        estimate[i, i + 1 :] = ((sig[i + 1 :] == sig[i]) & full[i]).sum(axis=1) / either
        close[i, i + 1 :] = estimate[i, i + 1 :] >= threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / either)
    return close, estimate


def with_hubs(close: np.ndarray) -> Iterator[tuple[int, int]]:
    """(document, its hub) for each document with a close one; hubs are those with most close ones, and their own."""
    close = close | close.T
    degree = close.sum(axis=1)
    left = degree > 0
    while left.any():
        hub = int(np.argmax(np.where(left, degree, -1)))
        yield hub, hub
        left[hub] = False
        for i in np.flatnonzero(close[hub]):
            yield int(i), hub
            left[i] = False


def closest(close: np.ndarray, estimate: np.ndarray, comp: np.ndarray) -> Iterator[tuple[int, int]]:
    """One link a component: its document that is closest to another component, and that one there."""
    both = np.where(close & (comp[:, None] != comp[None, :]), estimate, -1)
    both = np.maximum(both, both.T)
    best = both.max(axis=1)
    for i in dict(zip(comp[np.argsort(best, kind="stable")].tolist(), np.argsort(best, kind="stable").tolist(), strict=True)).values():
        if best[i] >= 0:
            yield i, int(both[i].argmax())


def whole_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Batches sorted by node as frames that hold each node whole, with the nodes' bounds."""
    rest: pd.DataFrame | None = None
    for batch, last in iter_last(batches):
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        cuts = [0, *(np.flatnonzero(np.diff(batch["node"].to_numpy())) + 1).tolist(), len(batch)]
        if not last:
            rest = batch.iloc[cuts[-2] :]
            cuts = cuts[:-1]
        yield batch, cuts


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each two sets, by blocks of the shingles that two sets or more hold."""
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = count > 1
    keep = shared[column]
    row, column = row[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        at = slice(*np.searchsorted(column, (lo, lo + COLUMNS)))
        held = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        held[row[at], column[at] - lo] = 1
        out += held @ held.T
    return out


def linked_across(nodes: DataFrame, threshold: float) -> DataFrame:
    """One link a node between each two components of ``node, rep, comp, sketch, set``: ``rep, other``.

    A null ``set`` is a long one: all its pairs that are close by sketch come out.
    """
    hundredths = round(100 * threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, cuts in whole_nodes(batches):
            rep, comp = batch["rep"].to_numpy(), batch["comp"].to_numpy()
            out = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo < 2 or (comp[lo:hi] == comp[lo]).all():
                    continue
                node, c = batch.iloc[lo:hi], comp[lo:hi]
                held = [np.frombuffer(x or b"", np.uint64) for x in node["set"]]
                size = np.array([len(x) for x in held], dtype=np.float32)
                both = overlaps(held)
                other = np.triu(c[:, None] != c[None, :], 1)
                known = (size > 0)[:, None] & (size > 0)[None, :]
                sure = other & known & (100 * both >= hundredths * (size[:, None] + size[None, :] - both))
                seen = set()
                for i, j in zip(*np.nonzero(sure), strict=True):
                    ends = (min(c[i], c[j]), max(c[i], c[j]))
                    if ends not in seen:
                        seen.add(ends)
                        out.append((rep[lo + i], rep[lo + j]))
                if not known.all():
                    close, _ = closeness(np.frombuffer(b"".join(node["sketch"]), np.uint8).reshape(hi - lo, BINS), threshold)
                    out += [(rep[lo + i], rep[lo + j]) for i, j in zip(*np.nonzero(close & other & ~known), strict=True)]
            yield pd.DataFrame(out, columns=["rep", "other"], dtype="int64")

    return nodes.select("node", "rep", "comp", "sketch", "set").repartition("node").sortWithinPartitions("node").mapInPandas(lambda b: released(run(b)), "rep long, other long")


def compared(nodes: DataFrame, threshold: float, how: str) -> DataFrame:
    """Compare each node of ``node, whole, rep, sketch`` (and ``comp``) exhaustively: ``node, whole, rep, other``.

    ``how``: ``hubs``, or ``best`` for one link from each component of a node to another.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, cuts in whole_nodes(batches):
            sig = np.frombuffer(b"".join(batch["sketch"]), np.uint8).reshape(len(batch), BINS)
            comp = None if how == "hubs" else batch["comp"].to_numpy()
            left, right = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo > 1:
                    close, estimate = closeness(sig[lo:hi], threshold)
                    if close.any():
                        for i, j in with_hubs(close) if comp is None else closest(close, estimate, comp[lo:hi]):
                            left.append(lo + i)
                            right.append(lo + j)
                    if comp is None and not pd.isna(batch["whole"].iloc[lo]):
                        # Documents of a cut node may have their close ones in other blocks.
                        left += range(lo, hi)
                        right += range(lo, hi)
            if left:
                found = batch.iloc[left][["node", "whole", "rep"]].reset_index(drop=True)
                found["other"] = batch["rep"].to_numpy()[right]
                yield found.drop_duplicates()

    columns = [c for c in ("node", "whole", "rep", "sketch", "comp") if c in nodes.columns]
    return nodes.select(*columns).repartition("node").sortWithinPartitions("node").mapInPandas(lambda b: released(run(b)), "node long, whole long, rep long, other long")


def marked(nodes: DataFrame, threshold: float) -> DataFrame:
    """``node, rep`` of the documents with a close one of another component in their node; a node's come out of its task as one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, cuts in whole_nodes(batches):
            sig = np.frombuffer(b"".join(batch["sketch"]), np.uint8).reshape(len(batch), BINS)
            comp, rep, node = (batch[c].to_numpy() for c in ("comp", "rep", "node"))
            out = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo > 1:
                    close, _ = closeness(sig[lo:hi], threshold)
                    close &= comp[lo:hi, None] != comp[None, lo:hi]
                    some = np.flatnonzero(close.any(axis=0) | close.any(axis=1))
                    if len(some):
                        out.append((node[lo], rep[lo + some]))
            yield pd.DataFrame(out, columns=["node", "reps"])

    found = nodes.select("node", "rep", "comp", "sketch").repartition("node").sortWithinPartitions("node").mapInPandas(lambda b: released(run(b)), "node long, reps array<long>")
    return found.select("node", F.explode("reps").alias("rep")).distinct()


def pairs_of(found: DataFrame) -> DataFrame:
    return found.filter("rep <> other").select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def iter_last(batches: Iterator) -> Iterator[tuple]:
    """Each item with whether it is the last."""
    held = None
    for x in batches:
        if held is not None:
            yield held, False
        held = x
    if held is not None:
        yield held, True


def confirm(pairs: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose full sets reach the threshold, in whole numbers of hundredths."""
    hundredths = round(100 * threshold)

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(u, v, assume_unique=True)) if min(len(u), len(v)) * 100 >= hundredths * max(len(u), len(v)) else 0
            out.append(100 * both >= hundredths * (len(u) + len(v) - both))
        return pd.Series(out)

    a = full.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a"))
    b = full.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").filter(linked("set_a", "set_b")).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(v, comp)`` for each end of a link, ``comp`` the smallest id reachable.

    Each round hooks every root to its smallest neighbouring root, follows the
    pointers to their ends, and keeps the links between different roots.
    """
    links = stored(links.select("a", "b"))
    label = stored(links.select(F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("comp", F.col("v")))
    edges = links
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("root"), F.least("a", "b").alias("to"))
        while True:
            hook = stored(hook)
            up = hook.select(F.col("root").alias("to"), F.col("to").alias("next"))
            jumped = hook.join(up, "to").select("root", "to", "next")
            if jumped.filter("next <> to").isEmpty():
                break
            hook = jumped.select("root", F.col("next").alias("to"))
        label = stored(label.join(hook.withColumnRenamed("root", "comp"), "comp", "left").select("v", F.coalesce("to", "comp").alias("comp")))
        edges = (
            edges.join(hook.select(F.col("root").alias("a"), F.col("to").alias("x")), "a")
            .join(hook.select(F.col("root").alias("b"), F.col("to").alias("y")), "b")
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
        edges = stored(edges)
    return label


def met_blocks(told: DataFrame) -> DataFrame:
    """Documents outside the main component of a cut node meet all its documents, in rows of two parts.

    Both kinds are dealt into parts of about ``NODE``, and each two parts of
    which one is outside make a node, so no node exceeds ``2 * NODE`` and each
    such pair of documents meets once; pairs inside the main component need not.
    """
    size = max(1, NODE // 2, NODE - 4 * math.isqrt(NODE))  # a hash deals unevenly, by a few standard deviations
    blocks = told.filter("whole is not null").select("whole", "rep", "comp").distinct()
    tally = blocks.groupBy("whole", "comp").agg(F.count(F.lit(1)).alias("k"))
    shape = (
        tally.groupBy("whole")
        .agg(F.max(F.struct("k", "comp")).alias("main"), F.sum("k").alias("n"))
        .select("whole", F.col("main.comp").alias("main"), F.ceil((F.col("n") - F.col("main.k")) / size).cast("int").alias("minor_parts"), F.ceil(F.col("main.k") / size).cast("int").alias("main_parts"))
        .filter("minor_parts > 0")
    )
    minor = F.col("comp") != F.col("main")
    deal = lambda parts: F.pmod(F.xxhash64("rep", "whole"), F.col(parts)).cast("int")
    placed = blocks.join(shape, "whole").withColumn("place", F.when(minor, deal("minor_parts")).otherwise(F.col("minor_parts") + deal("main_parts")))
    others = F.sequence(F.lit(0), F.when(minor, F.col("minor_parts") + F.col("main_parts")).otherwise(F.col("minor_parts")) - 1)
    met = placed.select("whole", "rep", "comp", "place", F.explode(others).alias("other"))
    return met.select(F.xxhash64("whole", F.least("place", "other"), F.greatest("place", "other")).alias("node"), "whole", "rep", "comp")


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Null and empty texts are empty sets, linked with nothing. A repeated row is
    a copy; rows of one doc_id share its component. A null doc_id is kept and
    has a null component.
    """
    every = stored(sets(docs, n))
    reps = stored(
        every.filter("set_key is not null and doc_id is not null")
        .groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "minhash", "sketch")).alias("m"))
        .select("set_key", F.col("m.doc_id").alias("rep"), "m.minhash", "m.sketch")
    )
    sketches = reps.select("rep", "sketch")
    close = stored(compared(grouped(reps).join(sketches, "rep"), threshold, "hubs"))
    wanted = close.select(F.col("rep").alias("doc_id")).distinct()
    full = stored(full_sets(docs.join(wanted, "doc_id", "left_semi"), n))
    links = stored(confirm(pairs_of(close), full, threshold))
    nodes = close.select("node", "whole", "rep").distinct()
    found = nodes.select(F.col("rep").alias("v")).distinct().join(components(links), "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    for how in ("best", "all"):
        found = stored(found)
        told = stored(nodes.join(found.withColumnRenamed("v", "rep"), "rep"))
        mixed = told.groupBy("node").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("node")
        inner = told.join(mixed, "node", "left_semi")
        if how == "all":
            inner = stored(inner.unionByName(met_blocks(told)).distinct())
            # Only documents with some close one across components bring their sets.
            some = marked(inner.join(sketches, "rep"), threshold)
            brought = inner.select("node", "rep", "comp").join(some, ["node", "rep"]).join(sketches, "rep")
            short = full.filter(F.length("set") <= 8 * FULL).select(F.col("doc_id").alias("rep"), "set")
            pairs = linked_across(brought.join(short, "rep", "left"), threshold)
        else:
            pairs = compared(inner.join(sketches, "rep"), threshold, "best")
        more = stored(confirm(pairs_of(pairs), full, threshold))
        # Only components are joined from here on, not all links once more.
        ends = more.join(found.select(F.col("v").alias("a"), F.col("comp").alias("x")), "a").join(found.select(F.col("v").alias("b"), F.col("comp").alias("y")), "b")
        roots = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        found = found.join(roots.select(F.col("v").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("v", F.coalesce("root", "comp").alias("comp"))
    named = reps.select("set_key", "rep").join(found.select(F.col("v").alias("rep"), "comp"), "rep", "left").select("set_key", F.coalesce("comp", "rep").alias("comp"))
    return every.join(named, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("comp", "doc_id"), F.lit(True)).alias("kept")
    )
