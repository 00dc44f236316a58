"""MinHash near-duplicates with sequential Bayesian verification.

1. Texts with equal word sequences form a class; its smallest id stands for it.
2. A representative has 128 minhashes of its word shingles, in 32 bands of 4. Two with a Jaccard similarity
   of 0.75 share no band with a probability of 5e-6.
3. Each bucket's members are compared with its smallest id. Signatures (a byte of each minhash) are read in
   batches of 16; a pair goes once the posterior probability of the wanted similarity falls to the chosen miss
   probability. Survivors are confirmed on the full shingle sets, and links are joined to components.
4. What step 3 leaves apart is compared without emitting the pairs of a group. In buckets that still hold
   several components, blocks of 1024 are compared by signatures, and each pair of blocks gives a spanning
   forest of what survives. These forests make clusters; again in pairs of blocks, of 256, the members of a
   cluster are compared on their full sets, and each pair of blocks gives the links that join components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Work, table

SHINGLE, BANDS, ROWS, BATCH = 5, 32, 4, 16
HASHES = BANDS * ROWS
MISS = 1e-5
#: Members of a block that is compared on signatures, and of one compared on sets.
SIG_BLOCK, SET_BLOCK = 1024, 256
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bits of the map by which texts are read again: as many whatever the input, 2 MB.
MAP_BITS = 24
P64 = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


WORDS = WordHashes()


def words(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words of the whole text."""
    # Bytes split at the six ASCII white-space characters, and at no other.
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    return np.fromiter(map(WORDS.__getitem__, found), np.uint64, len(found))


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of runs of five words; fewer words are one shingle, none is none."""
    n = min(SHINGLE, len(hashes))
    if not n:
        return hashes
    h = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(29))) * P64 + hashes[k : k + len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)


@lru_cache(1)
def multipliers() -> np.ndarray:
    return np.random.default_rng(75).integers(0, 2**31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)


def signature(own: np.ndarray) -> np.ndarray:
    """128 minhashes of shingle hashes: half of their odd multiples modulo 2^32 are of the lower, half of the upper 32 bits."""
    a, half = multipliers(), HASHES // 2
    best = np.full(HASHES, 2**32 - 1, np.uint32)
    lower, upper = own.astype(np.uint32), (own >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(own), 4096):  # a long text goes in slices
        for at, part in ((slice(0, half), lower), (slice(half, HASHES), upper)):
            np.minimum(best[at], (part[k : k + 4096][None, :] * a[at, None]).min(1), out=best[at])
    return best


def band_keys(minhashes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band and its four minhashes."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in minhashes.reshape(BANDS, ROWS).astype(np.uint64).T:
        h = (h ^ (h >> np.uint64(29))) * P64 + column
    h ^= h >> np.uint64(32)
    return (h * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


@lru_cache(4)
def least_matches(similarity: float, miss: float) -> tuple[int, ...]:
    """Matches that n = 16, 32, ... compared hashes need, lest P(similarity >= wanted) <= miss, from a uniform prior.

    After m matches of n the posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, need = 0.0, 0
        for m in range(n + 1):
            tail += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if tail <= miss:
                need = m + 1
        out.append(need)
    return tuple(out)


def likely(a: np.ndarray, b: np.ndarray, need: tuple[int, ...]) -> np.ndarray:
    """Which rows of signatures a, b (pairs, 128 bytes) survive every batch; a pruned pair is compared no further."""
    alive, same = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(need):
        at = slice(k * BATCH, (k + 1) * BATCH)
        same = same + (a[alive, at] == b[alive, at]).sum(1, dtype=np.int32)
        ok = same >= least
        alive, same = alive[ok], same[ok]
    return alive


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, content, sig, keys): the content key of the word sequence, signature and band keys; null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, contents, sigs, keys = [], [], [], []
            for text in b.column(1):
                w = words(text.as_py())
                s = shingles(w)
                m = signature(s) if len(w) else None
                counts.append(len(s))
                contents.append(content_of(w))
                sigs.append(None if m is None else m.astype(np.uint8).tobytes())
                keys.append(None if m is None else band_keys(m))
            cols = [b.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(contents, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "content", "sig", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, content binary, sig binary, keys array<long>")


def classes(rows: DataFrame, repeated: bool) -> DataFrame:
    """(content, node, rep, n, sig, keys) of each content key: its smallest id and the number of rows. Combines before the shuffle.

    ``node`` names the class in all that follows: its smallest id, or, where rows that repeat an id may have
    different texts, a number that holds once the classes are saved.
    """
    known = rows.filter("content is not null and doc_id is not null")
    out = known.groupBy("content").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    return out.withColumn("node", F.monotonically_increasing_id() if repeated else F.col("rep"))


def attach(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """``pairs`` (a, b) with ``value`` of ``values`` (id, value) for both; plain shuffles, split where a key is hot."""
    for side in "ab":
        pairs = pairs.join(values.select(F.col("id").alias(side), F.col(value).alias(f"{value}_{side}")), side)
    return pairs


def prune(pairs: DataFrame, reps: DataFrame, need: tuple[int, ...]) -> DataFrame:
    """The pairs (a, b) that the signatures don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sig = [np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b")]
            yield x.select(["a", "b"]).take(pa.array(likely(*sig, need)))

    both = attach(pairs, reps.select(F.col("node").alias("id"), "sig"), "sig")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def spot(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(1 << MAP_BITS))


def word_of(c: str) -> Column:
    return F.shiftright(spot(c), 6)


def bit_of(c: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), spot(c).bitwiseAND(63).cast("int"))


def bit_map(work: Work, ids: DataFrame, name: str) -> DataFrame:
    """(_word, _bits): the set bits of a map of the hashed ids (id); 2^18 rows at most, whatever the input."""
    return work.save(ids.groupBy(word_of("id").alias("_word")).agg(F.bit_or(bit_of("id")).alias("_bits")), f"{name}_map")


def content_of(w: np.ndarray) -> bytes | None:
    """128 bits of a word sequence; none without words."""
    return xxhash.xxh128_digest(w.tobytes()) if len(w) else None


def full_sets(work: Work, docs: DataFrame, reps: DataFrame, ids: DataFrame, repeated: bool, name: str) -> DataFrame:
    """(id, own) of the nodes of ``ids`` (id) and a few others: the sorted shingle hashes of the whole text.

    Texts are not shuffled. A bit map of hashed ids goes to all readers; its size is fixed, so that with very
    many ids it lets more others through, which the joins that follow drop. Where ids repeat, a text is known by
    its content key.
    """
    ids = ids.distinct()
    wanted = reps.join(ids.withColumnRenamed("id", "node"), "node", "left_semi").select("content", "node", F.col("rep").alias("id")) if repeated else ids
    some = docs.select("doc_id", "text").join(F.broadcast(bit_map(work, wanted, name)), word_of("doc_id") == F.col("_word"))
    some = some.filter(F.col("_bits").bitwiseAND(bit_of("doc_id")) != 0).select("doc_id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = [words(t.as_py()) for t in x.column(1)]
            cols = [x.column(0).cast(pa.int64()), pa.array([content_of(w) for w in found] if repeated else [None] * len(found), pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([shingles(w).tobytes() for w in found], pa.binary())], ["id", "content", "own"])

    own = some.mapInArrow(sets, "id long, content binary, own binary")
    if not repeated:
        return work.save(own.select("id", "own"), f"{name}_sets")
    once = own.groupBy("content").agg(F.first("own").alias("own"))
    return work.save(once.join(wanted.drop("id"), "content").select(F.col("node").alias("id"), "own"), f"{name}_sets")


def confirm(work: Work, pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int, repeated: bool) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for k, (p, q) in enumerate(zip(x.column(2), x.column(3), strict=True)):
                p, q = (np.frombuffer(v.as_py(), np.uint64) for v in (p, q))
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(both) - common):
                    keep.append(k)
            yield x.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    own = full_sets(work, docs, reps, ids, repeated, "star")
    out = attach(pairs, own, "own").select("a", "b", "own_a", "own_b").mapInArrow(compare, "a long, b long")
    return work.save(out, "star_links")


def components(work: Work, links: DataFrame, name: str) -> DataFrame:
    """(id, comp) of every id in ``links`` (a, b): the smallest id that it reaches.

    Each round points every label to the smallest label beside it, follows the pointers to their ends, and
    relabels; labels that link to no other are done. The number of rounds grows with the logarithm.
    """
    labels = work.save(links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("comp", F.col("id")), f"{name}_labels")
    edges, k = links, 0
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        point = work.save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("x"), F.least("a", "b").alias("y")), f"{name}_{k}_p0")
        jumps = 0
        while True:  # pointers only lead to smaller labels, so this ends
            jumps += 1
            nxt = point.select(F.col("x").alias("y"), F.col("y").alias("z"))
            point = work.save(point.join(nxt, "y").select("x", F.col("z").alias("y"), (F.col("y") != F.col("z")).alias("moved")), f"{name}_{k}_p{jumps}")
            if not point.filter("moved").limit(1).count():
                break
            point = point.drop("moved")
        point = point.select("x", "y")
        to = point.select(F.col("x").alias("comp"), F.col("y").alias("_to"))
        labels = work.save(labels.join(to, "comp", "left").select("id", F.coalesce("_to", "comp").alias("comp")), f"{name}_{k}_labels")
        for side in "ab":
            edges = edges.join(point.select(F.col("x").alias(side), F.col("y").alias(f"_{side}")), side)
        edges = work.save(edges.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).filter("a < b").distinct(), f"{name}_{k}_edges")
        k += 1
        if not edges.limit(1).count():
            return labels


def forest(a: np.ndarray, b: np.ndarray, names: np.ndarray) -> list[int]:
    """Which of the pairs (a, b) of places suffice to join all the names that the pairs join."""
    root: dict = {}

    def find(x):
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    out = []
    for k, (i, j) in enumerate(zip(names[a].tolist(), names[b].tolist(), strict=True)):
        i, j = find(i), find(j)
        if i != j:
            root[i] = j
            out.append(k)
    return out


def in_blocks(members: DataFrame, size: int) -> DataFrame:
    """``members`` (id, n: the size of the group, ...) once for each pair of blocks (lo, hi) that its block is in.

    A block holds about ``size`` members, so that a task holds twice as many, however large the group is.
    """
    n_blocks = F.ceil(F.col("n") / size).cast("int")
    cut = members.withColumn("block", F.pmod(F.xxhash64("id"), n_blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    return cut.select("*", F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi")).drop("_other", "n")


def over_blocks(rows: DataFrame, group: str, pairs) -> DataFrame:
    """(a, b) that ``pairs`` finds in each pair of blocks; groups stream by, sorted, so that small ones share a call."""
    key = [group, "lo", "hi"]
    rows = rows.repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            found = []
            at = b[key].to_numpy()
            edge = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1), len(b)]
            for i, j in zip(edge, edge[1:], strict=False):
                if held and (held[0][key].iloc[0].to_numpy() != at[i]).any():
                    found.append(pairs(pd.concat(held)))
                    held = []
                held.append(b.iloc[i:j])
            yield pd.concat([pd.DataFrame({"a": [], "b": []}, dtype="int64"), *found])
        if held:
            yield pairs(pd.concat(held))

    return rows.mapInPandas(run, "a long, b long")


def compared(g: pd.DataFrame, need: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs between the two blocks of ``g`` (one, if they are the same) that differ in component and survive the signatures."""
    sig = np.frombuffer(b"".join(g.sig), np.uint8).reshape(-1, HASHES)
    ids, comp, block = g.id.to_numpy(), g.comp.to_numpy(), g.block.to_numpy()
    lo, hi = g.lo.iloc[0], g.hi.iloc[0]
    left, right, found = np.flatnonzero(block == lo), np.flatnonzero(block == hi), [np.empty((2, 0), np.int64)]
    for i in left:
        rest = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) | (lo != hi))]
        if len(rest):
            got = rest[likely(np.broadcast_to(sig[i], (len(rest), HASHES)), sig[rest], need)]
            found.append(np.stack([np.full(len(got), i), got]))
    i, j = np.concatenate(found, 1)
    return i, j


def as_pairs(g: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    a, b = g.id.to_numpy()[i], g.id.to_numpy()[j]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def clusters(work: Work, members: DataFrame, reps: DataFrame, need: tuple[int, ...]) -> DataFrame | None:
    """(id, cluster): ids that a survivor joins, over different components, are in one cluster. None: no survivor."""

    def pairs(g: pd.DataFrame) -> pd.DataFrame:
        i, j = compared(g, need)
        keep = forest(i, j, g.id.to_numpy())
        return as_pairs(g, i[keep], j[keep])

    full = in_blocks(members, SIG_BLOCK).join(reps.select(F.col("node").alias("id"), "sig"), "id")
    edges = work.save(over_blocks(full, "bucket", pairs).distinct(), "near")
    if not edges.limit(1).count():
        return None
    return components(work, edges, "near").withColumnRenamed("comp", "cluster")


def cluster_links(work: Work, near: DataFrame, comp: DataFrame, reps: DataFrame, docs: DataFrame, need: tuple[int, ...], percent: int, repeated: bool) -> DataFrame:
    """Links (a, b) that join components in each cluster, confirmed on full sets."""

    def pairs(g: pd.DataFrame) -> pd.DataFrame:
        i, j = compared(g, need)
        if len(i):
            used = np.unique(np.concatenate([i, j]))
            place = np.full(len(g), -1)
            place[used] = np.arange(len(used))
            common, size = intersections([np.frombuffer(x, np.uint64) for x in g.own.iloc[used]])
            k = common[place[i], place[j]]
            ok = 100 * k >= percent * (size[place[i]] + size[place[j]] - k)
            i, j = i[ok], j[ok]
        keep = forest(i, j, g.comp.to_numpy())
        return as_pairs(g, i[keep], j[keep])

    sizes = near.groupBy("cluster").agg(F.count("*").alias("n"))
    own = full_sets(work, docs, reps, near.select("id"), repeated, "near")
    full = near.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id")).join(sizes, "cluster")
    full = in_blocks(full, SET_BLOCK).join(reps.select(F.col("node").alias("id"), "sig"), "id").join(own, "id")
    return work.save(over_blocks(full, "cluster", pairs), "near_links")


def intersections(sets: list[np.ndarray], columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all intersections of ``sets``, and of the sets, by products of 0/1 matrices, some columns at a time."""
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, col, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[col] > 1  # what one set alone has is in no intersection
    row, col = row[shared], np.unique(col[shared], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)  # exact: counts stay below 2^24
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for k in range(0, int(col[-1]) + 1 if len(col) else 0, columns):
        i, j = np.searchsorted(col, (k, k + columns))
        x = np.zeros((len(sets), columns), np.float32)
        x[row[i:j], col[i:j] - k] = 1
        out += x @ x.T
    return out.astype(np.int64), size


def components_of(work: Work, docs: DataFrame, percent: int, miss: float) -> tuple[DataFrame, bool]:
    """(doc_id, n_shingles, content, group, component_id) of every row of ``docs``, and whether ids repeat.

    ``group`` numbers the components, which may share their least id where ids repeat; null: the only row of its text, without a link.
    """
    need = least_matches(percent / 100, miss)
    rows = work.save(sketches(docs), "sketches")
    repeated = bool(rows.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count())
    reps = work.save(classes(rows, repeated), "classes")
    placed = reps.select(F.col("node").alias("id"), F.explode("keys").alias("bucket"))
    size = placed.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    members = work.save(placed.join(work.save(size, "buckets"), "bucket"), "members")
    star = members.filter("id != first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    star = work.save(prune(work.save(star, "star"), reps, need), "star_pairs")
    links = confirm(work, star, docs, reps, percent, repeated)
    comp = components(work, links, "star")
    named = members.join(comp, "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp"), "n")
    named = work.save(named, "named")
    apart = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
    near = clusters(work, named.join(apart, "bucket", "left_semi"), reps, need)
    if near is not None:
        more = cluster_links(work, near, comp, reps, docs, need, percent, repeated)
        comp = components(work, links.union(more), "all")
    # A class that has one row and no link is its own component; the others are looked up.
    known = reps.select("content", "node", "rep", "n").join(comp.select(F.col("id").alias("node"), "comp"), "node", "left")
    known = known.filter("n > 1 or comp is not null").withColumn("group", F.coalesce("comp", "node"))
    if repeated:  # a component is named by its smallest id, not by its smallest node
        known = known.join(known.groupBy("group").agg(F.min("rep").alias("least")), "group")
    known = known.select(F.col("content").alias("_content"), "group", F.col("least" if repeated else "group").alias("_comp"))
    known = work.save(known, "known")
    out = rows.select("doc_id", "n_shingles", "content").join(known, F.col("content") == F.col("_content"), "left")
    out = out.select("doc_id", "n_shingles", "content", "group", F.when(F.col("doc_id").isNotNull(), F.coalesce("_comp", "doc_id")).alias("component_id"))
    return work.save(out, "found", last=True), repeated


def near_duplicates(work: Work, docs: DataFrame, percent: int = 75, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Null and empty texts, and null ids, are linked with nothing; a null id has a null component. A document is a
    row: rows that repeat an id are linked as their own texts are, and a component has the smallest id in it.
    """
    return components_of(work.part(), docs, percent, miss)[0].drop("content", "group")


def keep_one(work: Work, docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, in its columns, one of each near-duplicate group: of its smallest id and, of several such rows, the
    smallest content key; of rows equal in both, any one. Rows without an id, and those without words, all stay."""
    found, repeated = components_of(work.part(), docs, 75, MISS)
    if repeated:
        return keep_one_of_repeated(work, docs, found)
    # Most rows stay: those that miss the map of the dropped ids need no join, and their texts no shuffle.
    dropped = work.save(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("id")), "dropped")
    some, rest = split(work, docs, dropped)
    return rest.unionByName(some.join(dropped.withColumnRenamed("id", "_id"), F.col("doc_id") == F.col("_id"), "left_anti"))


def split(work: Work, docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` that may have one of ``ids`` (id), by the map of these, and the others."""
    seen = docs.withColumn("_spot", word_of("doc_id")).join(F.broadcast(bit_map(work, ids, "dropped")), F.col("_spot") == F.col("_word"), "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit_of("doc_id")) != 0, F.lit(False))
    return seen.filter(hit).select(*docs.columns), seen.filter(~hit).select(*docs.columns)


def keep_one_of_repeated(work: Work, docs: DataFrame, found: DataFrame) -> DataFrame:
    """``keep_one`` where ids repeat: rows are told apart by id and content key."""
    pairs = found.filter("content is not null and doc_id is not null").groupBy("doc_id", "content").agg(F.count("*").alias("n"), F.first("group").alias("group"))
    pairs = work.save(pairs, "pairs")
    grouped = pairs.filter("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "content")).alias("x")).select("x.*")
    chosen = grouped.union(pairs.filter("group is null").select("doc_id", "content"))
    chosen = work.save(chosen.select(F.col("doc_id").alias("_id"), F.col("content").alias("_key")), "chosen")
    others = pairs.join(chosen, (F.col("doc_id") == F.col("_id")) & (F.col("content") == F.col("_key")), "left_anti")
    gone = others.select("doc_id").union(pairs.filter("n > 1").select("doc_id")).distinct()
    some, rest = split(work, docs, work.save(gone.withColumnRenamed("doc_id", "id"), "gone"))

    @F.pandas_udf("binary")
    def content(text: pd.Series) -> pd.Series:
        return pd.Series([content_of(words(t)) for t in text], dtype=object)

    some = work.save(some.withColumn("_own", content("text")), "some")
    # Spark keeps the first row of each key before the shuffle, too, so a hot row makes one per task.
    first = Window.partitionBy("doc_id", "_own").orderBy(F.xxhash64("text"))
    kept = some.join(chosen, (F.col("doc_id") == F.col("_id")) & (F.col("_own") == F.col("_key")), "left_semi")
    kept = kept.withColumn("_place", F.row_number().over(first)).filter("_place = 1")
    return rest.unionByName(some.filter("_own is null or doc_id is null").select(*docs.columns)).unionByName(kept.select(*docs.columns))


def op9_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at a similarity of 0.75."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near_duplicates(Work(spark), docs)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


SQL_OP9 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT uid, doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS h
      FROM (SELECT uid, doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT uid, count(*) AS n FROM s GROUP BY uid),
p AS (SELECT x.uid AS a, y.uid AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.uid <> y.uid WHERE x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c ca ON ca.uid = a JOIN c cb ON cb.uid = b WHERE 100 * k >= 75 * (ca.n + cb.n - k)),
r AS (SELECT uid AS a, uid AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, m.component_id, coalesce(d.doc_id = m.component_id, true) AS kept
FROM d LEFT JOIN c USING (uid) JOIN (SELECT a, min(e.doc_id) AS component_id FROM r JOIN d e ON e.uid = r.b GROUP BY a) m ON m.a = d.uid
"""
