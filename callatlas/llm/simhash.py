"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are cut into threshold // 2 + 1 blocks, so that two fingerprints within the threshold differ in at
most one bit of some block. In each block the words of a Hamming code, a covering code of radius 1, are the anchors:
every fingerprint has its home anchor within that radius and is replicated to every anchor within radius plus one, the
block's share of the threshold. Two linked fingerprints then meet at the home anchor of either; they are compared there.
"""

from __future__ import annotations

import math
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._common import durable, small_batches, text_bytes

CHUNK = 1 << 16


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th family of hashes out of one: k = 0 leaves them as they are, others permute the 64-bit numbers."""
    if not k:
        return h
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def fingerprints(text: bytes, shingle: int = 3, seed: int = 42, families: int = 1) -> list[int]:
    """Unsigned SimHash of a text for each family: a bit is 1 if set in over half of the shingles' XXH64 hashes."""
    words = text.lower().split()
    if not words:
        return [0] * families
    grams = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    total, ones = 0, np.zeros((families, 64), np.int64)
    while part := list(map(xxh64_intdigest, islice(grams, CHUNK), repeat(seed))):
        total += len(part)
        h = np.array(part, np.uint64)
        for k in range(families):
            ones[k] += np.unpackbits(_mix(h, k).view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > total, axis=1, bitorder="little")
    return bits.view(np.uint64).ravel().tolist()


def fingerprint_table(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long): a row for each row of docs, whole texts."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprints(t.as_py(), shingle, seed)[0] for t in batch["bytes"]], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("bytes")).mapInArrow(run, "doc_id bigint, fp bigint")


def blocks_of(threshold: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each block."""
    n = threshold // 2 + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return list(zip(cuts, (b - a for a, b in zip(cuts, cuts[1:]))))


def anchors(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of block values x: indices into x, anchors within radius 1 plus 1, and which of them are home anchors.

    The block's first 2**r - 1 bits carry a Hamming code; bits beyond them belong to the anchor as they are.
    """
    r = (bits + 1).bit_length() - 1
    n = (1 << r) - 1
    one = np.uint64(1)
    syndrome = np.zeros(len(x), np.uint64)
    for j in range(r):
        mask = np.uint64(sum(1 << (p - 1) for p in range(1, n + 1) if p >> j & 1))
        syndrome |= (np.bitwise_count(x & mask).astype(np.uint64) & one) << np.uint64(j)
    error = np.where(syndrome > 0, one << (np.maximum(syndrome, one) - one), np.uint64(0))
    home, index = x ^ error, np.arange(len(x))
    found = [(index, home, True)] + [(index, home ^ (one << np.uint64(p)), False) for p in range(n, bits)]
    for p in range(1, n + 1):  # code words two away flip a pair p < q with p ^ q = syndrome
        q = syndrome ^ np.uint64(p)
        some = q > np.uint64(p)
        some &= syndrome > 0
        found.append((index[some], x[some] ^ (one << np.uint64(p - 1)) ^ (one << (q[some] - one)), False))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([np.full(len(f[0]), f[2]) for f in found])


def _replicate(nodes: DataFrame, threshold: int) -> DataFrame:
    """family, block, anchor, and the columns of nodes but fp, then fp, home: a row for each anchor that a fingerprint is sent to."""
    rest = [c for c in nodes.columns if c not in ("family", "fp")]

    def run(batches):
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            family = batch["family"].to_numpy(zero_copy_only=False)
            own = [batch[c].to_numpy(zero_copy_only=False) for c in rest]
            for block, (first, bits) in enumerate(blocks_of(threshold)):
                i, anchor, home = anchors(fp >> np.uint64(first) & np.uint64((1 << bits) - 1), bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(family[i]), pa.array(np.full(len(i), block, np.int32)), pa.array(anchor.view(np.int64)), *(pa.array(x[i]) for x in own), pa.array(fp[i].view(np.int64)), pa.array(home)],
                    ["family", "block", "anchor", *rest, "fp", "home"])

    return nodes.mapInArrow(run, f"family int, block int, anchor bigint, {', '.join(f'{c} bigint' for c in rest)}, fp bigint, home boolean")


def forest(fp: np.ndarray, home: np.ndarray, threshold: int, node: np.ndarray | None = None, checks: list[np.ndarray] = (), most: int = 0) -> list[tuple[int, int]]:
    """What is connected by links between an anchor's home fingerprints and all fingerprints sent to it, as pairs of the
    smallest node and each other one, so that the anchors where a class meets mostly give the same pairs. Two are linked if they
    differ in at most `threshold` bits, and their checks in at most `most` bits together."""
    node = fp if node is None else node
    left, edges = np.ones(len(fp), bool), []
    for root in np.flatnonzero(home):
        if not left[root]:
            continue
        left[root] = False
        queue, met = [root], [np.array([root])]
        while queue:
            u = queue.pop()
            near = np.flatnonzero(left & (home[u] | home))
            near = near[np.bitwise_count(fp[near] ^ fp[u]) <= threshold]
            if len(checks) and len(near):
                near = near[sum(np.bitwise_count(c[near] ^ c[u]).astype(np.int64) for c in checks) <= most]
            left[near] = False
            met.append(near)
            queue += near.tolist()
        nodes = np.unique(node[np.concatenate(met)])
        edges += [(int(nodes[0]), int(v)) for v in nodes[1:]]
    return edges


def _compare(rows: DataFrame, keys: list[str], checks: list[str], threshold: int, most: int) -> DataFrame:
    """a, b: links of nodes found at each anchor, of rows that lie together and sorted by `keys`."""
    columns_ = [*keys, *checks, "node", "fp", "home"]

    def links(columns: list[np.ndarray], out: list) -> None:
        key, home = columns[: len(keys)], columns[-1]
        *check, node, fp = (c.view(np.uint64) for c in columns[len(keys) : -1])
        change = np.zeros(len(fp) - 1, bool)
        for k in key:
            change |= k[1:] != k[:-1]
        start = np.concatenate(([0], np.flatnonzero(change) + 1))
        size = np.diff(np.append(start, len(fp)))
        homes = np.add.reduceat(home.astype(np.int64), start)
        for g in np.flatnonzero((homes > 0) & (size > 1)):
            s = slice(start[g], start[g] + size[g])
            out += forest(fp[s], home[s], threshold, node[s], [c[s] for c in check], most)

    def flush(out: list):
        both = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], ["a", "b"])

    def run(batches):
        held: list[list[np.ndarray]] = []
        for batch in batches:
            columns = [batch[c].to_numpy(zero_copy_only=False) for c in columns_]
            if not len(columns[0]):
                continue
            same = np.ones(len(columns[0]), bool)
            for c in columns[: len(keys)]:
                same &= c == c[-1]
            cut = len(same) - (int(np.argmin(same[::-1])) if not same.all() else len(same))  # the last group may go on
            if cut:
                out: list = []
                links([np.concatenate(x) for x in zip(*held, [c[:cut] for c in columns])], out)
                held = []
                if out:
                    yield flush(out)
            held.append([c[cut:] for c in columns])
        if held:
            out = []
            links([np.concatenate(x) for x in zip(*held)], out)
            if out:
                yield flush(out)

    return rows.select(*columns_).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint")


def link_fingerprints(nodes: DataFrame, threshold: int = 3, most: int = 0, most_homes: int = 4096) -> DataFrame:
    """a, b: links between nodes whose fingerprints of one family differ in at most `threshold` bits, enough of them to connect
    all that are connected.

    nodes: family, fp, node, and check columns, if any, in which linked nodes differ in at most `most` bits together. Anchors
    that are home to more than `most_homes` fingerprints are counted first and split: homes into n parts, all that was sent
    there into n parts, and every part of the one meets every part of the other, so that no task holds more than a few parts;
    nothing is left out.
    """
    rows = _replicate(nodes, threshold)
    key = ["family", "block", "anchor"]
    checks = [c for c in nodes.columns if c not in ("family", "fp", "node")]
    hot = durable(rows.where("home").groupBy(*key).count().where(F.col("count") > most_homes).withColumn("n", F.ceil(F.col("count") / most_homes).cast("int")).drop("count"))
    if hot.isEmpty():
        return _compare(rows, key, checks, threshold, most)
    rest = [*checks, "node", "fp"]
    parted = rows.join(hot, key, "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    as_home = parted.where("home").select(*key, F.col("mine").alias("p"), every.alias("q"), *rest, "home")
    sent = parted.where("n > 1 or not home").select(*key, every.alias("p"), F.col("mine").alias("q"), *rest, F.lit(False).alias("home"))
    return _compare(as_home.unionByName(sent), [*key, "p", "q"], checks, threshold, most)


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b): root is the smallest node of its component.

    Alternating large-star and small-star steps: each is a minimum by node, combined before it is shuffled, and an
    equi-join on the node, which adaptive execution can split. A step's links are written to the shared folder, so an
    executor's loss costs one step. The number of steps grows with the logarithm of the longest path.
    """
    undirected = lambda d: d.select("a", "b").union(d.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    links = durable(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(links)
    while True:
        both = undirected(links)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        links = durable(small.where("a <> b").distinct())
        now = state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b"), F.col("b")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, threshold: int = 3, seed: int = 42) -> DataFrame:
    """Near-duplicate classes: documents whose fingerprints differ in at most `threshold` bits are linked.

    docs: doc_id, text; other columns are ignored. Text is lower-cased (A-Z), words are runs of other characters than
    \\x20 and \\x09-\\x0D, shingles of `shingle` words count as often as they occur; a text of fewer words is one shingle,
    and one without words (empty, null) has fingerprint zero and is linked like any other. Long texts take linear time.

    Returns one row for each row of docs: doc_id, fp (signed long), component_id (smallest doc_id reachable; null only if all
    are null). Equal fingerprints are one node whatever their number, so exact copies and repeated rows cost no comparisons. An
    empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    fps = durable(fingerprint_table(docs, shingle, seed))
    first = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = link_fingerprints(first.select(F.lit(0).alias("family"), "fp", F.col("fp").alias("node")), threshold)
    roots = components(links)
    least = roots.join(first.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("first").alias("component_id"))
    linked = roots.join(least, "root").select(F.col("node").alias("fp"), F.col("component_id").alias("linked_id"))
    # written, so that the rows of a frequent fingerprint meet it in a join that adaptive execution can split
    ids = durable(first.join(linked, "fp", "left").select("fp", F.coalesce("linked_id", "first").alias("component_id")))
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


#: Candidates for near copies: families of fingerprints on pairs of words, which a change of one word moves less than those on
#: longer shingles; checks: families on the shingles themselves.
FAMILIES, CHECKS = 4, 3


def most_bits(similarity: float, bits: int, spread: float = 1.5) -> int:
    """Bits of SimHash fingerprints in which texts of a Jaccard similarity differ at most, in 93 of 100 cases: their mean and
    `spread` deviations. A bit differs with the chance of the angle between the shingles' counts."""
    chance = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * chance + spread * math.sqrt(bits * chance * (1 - chance)))


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, f0 ... (candidate families), c0 ... (checks), as signed longs."""
    names = [f"f{k}" for k in range(FAMILIES)] + [f"c{k}" for k in range(CHECKS)]

    def run(batches):
        for batch in batches:
            rows = [fingerprints(t, 2, families=FAMILIES) + fingerprints(t, shingle, families=CHECKS) for t in batch["bytes"].to_pylist()]
            table = np.array(rows, np.uint64).reshape(len(rows), len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(names)))], ["doc_id", "text_key", *names])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), text_bytes().alias("bytes"))
    return rows.mapInArrow(run, f"doc_id bigint, text_key bigint, {', '.join(f'{n} bigint' for n in names)}")


def representatives(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, threshold: int = 5) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text): of each class of near copies the smallest doc_id (null last), of texts with one
    doc_id the smallest key.

    Two texts are linked if their fingerprints on shingles of `shingle` words, CHECKS * 64 bits, differ in no more bits than
    those of texts of that Jaccard similarity do (most_bits), and they were compared: that is, a fingerprint on pairs of words
    differs in at most `threshold` bits in one of FAMILIES families. Classes are the connected texts. Texts with equal
    fingerprints are one node whatever their number.
    """
    small_batches(docs.sparkSession)
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    found = _signatures(docs, shingle)
    marks = [c for c in found.columns if c not in ("doc_id", "text_key")]
    nodes = found.groupBy(*marks).agg(F.min(own).alias("least"))
    nodes = durable(nodes.withColumn("node", F.monotonically_increasing_id()))
    checks = [c for c in marks if c.startswith("c")]
    families = F.explode(F.array(*(F.struct(F.lit(k).alias("family"), F.col(f"f{k}").alias("fp")) for k in range(FAMILIES))))
    rows = nodes.select("node", *checks, families.alias("f")).select("f.family", "f.fp", "node", *checks)
    roots = components(link_fingerprints(rows, threshold, most_bits(similarity, 64 * CHECKS)))
    classes = nodes.select("node", "least").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("class")).agg(F.min("least").alias("least"))
    return classes.select("least.doc_id", "least.text_key")


def keep_representatives(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, that stay when of each class of near copies (see representatives) one does.

    The smallest doc_id stays; rows without one are linked like any other and stay if no row with one is in their class. Of
    rows with one doc_id and one text, the one whose columns have the least hash stays. Null and empty texts are one class; long
    texts are compared whole; columns of any name are kept; an empty table stays empty.
    """
    stay = durable(representatives(docs, shingle, similarity)).select(F.col("doc_id").alias("stay"), F.col("text_key").alias("key"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("text_key"), F.struct(*docs.columns).alias("row"))
    rows = rows.join(stay, rows["id"].eqNullSafe(stay["stay"]) & (rows["text_key"] == stay["key"]), "left_semi")
    return rows.groupBy("id", "text_key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
