"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Every distinct text has one signature in each of ``trees`` trees: ``depth`` values, each a 16-bit digest of a minimum of
its five-word shingles under a hash function of its own. A tree is the prefix trie of its signatures, held as the table of
(tree, signature, text). Texts that share with no other text the shortest prefix that will be asked for leave the tree at
once: the table is range-sorted by one hash of tree and prefix, and a text without a neighbour of the same hash goes.

Matched prefixes are then shortened one value at a time, from ``depth`` on. At each length the texts below one node of a
trie that did not already meet at the longer prefix are compared on their whole shingle sets. How far a text goes is
settled by what it has found: with links of similarities J, a prefix of k values misses a link with probability
(1 - J ** k) ** trees, so the links found stand for sum(1 / (1 - miss)) links, to which one more link at the threshold
is added that may be there unseen. Once the share found of that sum reaches the wanted recall, the text asks no more; two
texts meet at a shorter prefix only if one of them still asks. Texts of dense groups stop early, where comparing costs
most; a text without links goes on to the prefix at which even a link at the threshold is found with the recall wanted.

Each pair is compared once: at the longest prefix at which it meets, in the first tree. The texts below one node are dealt by
hash into parts (at most ``block`` texts and ``block_bytes`` of shingles each in expectation); each two parts are one
piece of work, in which all pairs' common shingles are counted by a matrix product. No task holds more than two parts, no
partner is cut off, and pairs are never written, only each text's number of links and a tree of links that keeps what
belongs together. Classes are the connected components of the links.

Equal texts are one text throughout, joined to their documents at the end, so a group of copies costs one row.

Defined results: a null text is empty; empty texts (and texts of white space, equal ones) link only to their exact
copies; a text of fewer than five words has one shingle, itself; very long texts are used whole, their shingles are a
part of their own if need be; ties do not arise, as every link counts; repeated rows count as copies; a null id stays null
and never names a class that has another id; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged, text_or_empty
from .graph import components
from .grouped import binary_matrix, runs_of
from .text_arrays import chunks, code_points, shingle_hashes, word_hashes

#: Stands for a null id while classes are formed; larger than any id.
NO_ID = 2**63 - 1


def prefix_length(threshold: float, recall: float, trees: int, depth: int) -> int:
    """The longest prefix, at most depth, whose recall at the threshold suffices."""
    for k in range(depth, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


def text_shingles(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        words, first, _ = word_hashes(*code_points([t.lower() for t in texts[a:b]]))
        out += shingle_hashes(words, first)
    return out


class Forest:
    def __init__(self, trees: int, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.a = (rng.integers(0, 2**31, trees * depth) * 2 + 1).astype(np.uint32)
        self.b = rng.integers(0, 2**32, trees * depth).astype(np.uint32)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """Rows of trees * depth big-endian values, so that the order of bytes is the tries' order; zeros without shingles."""
        sizes = np.array([len(s) for s in sets])
        out = np.zeros((len(sets), self.trees * self.depth), ">u2")
        some = np.flatnonzero(sizes)
        if not len(some):
            return out
        h = (np.concatenate([sets[i] for i in some]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        for j in range(self.trees * self.depth):
            x = h * self.a[j] + self.b[j]
            x ^= x >> np.uint32(16)
            x *= np.uint32(0x7FEB352D)
            least = np.minimum.reduceat(x, starts)
            out[some, j] = (least ^ (least >> np.uint32(15))) * np.uint32(0x846CA68B) >> np.uint32(16)
        return out


def signatures(docs: DataFrame, forest: Forest, doc_id: str, text: str) -> DataFrame:
    """doc, sha (16 bytes of the text's SHA-256), n shingles, signature of every document. Texts stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 200):
                part = texts[a : a + 200]
                sets = text_shingles(part)
                rows = forest.signatures(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(part)), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:16] for t in part], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())],
                    ["doc", "sha", "n", "signature"],
                )

    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), text_or_empty(text).alias("text"))
    return own.mapInArrow(run, "doc bigint, sha binary, n bigint, signature binary")


def shared_prefixes(texts: DataFrame, trees: int, depth: int, least: int) -> DataFrame:
    """tree, label, node, n: of every tree the signatures whose first ``least`` values some other text has there too.

    Rows are ordered by one hash of tree and prefix, as a sort by the signatures' bytes copies two of them a comparison.
    Ranges are cut by hash and text, so that a prefix of many texts is no task of its own. At the borders of batches the
    neighbour is not known; there the row stays, which costs a look and loses nothing, as does a collision.
    """
    width = 2 * depth

    def with_neighbour(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            same = np.concatenate([[True], key[1:] == key[:-1], [True]])
            pick = pa.array(np.flatnonzero(same[1:] | same[:-1]))
            yield pa.RecordBatch.from_arrays([c.take(pick) for c in batch.columns[1:]], ["tree", "label", "node", "n"])

    rows = texts.where("n > 0").select("node", "n", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = rows.select("tree", F.expr(f"substring(signature, 1 + {width} * tree, {width})").alias("label"), "node", "n")
    rows = rows.select(F.xxhash64("tree", F.expr(f"substring(label, 1, {2 * least})")).alias("key"), "tree", "label", "node", "n")
    rows = rows.repartitionByRange("key", "node").sortWithinPartitions("key")
    return rows.mapInArrow(with_neighbour, "tree int, label binary, node bigint, n bigint")


def met(codes: np.ndarray, rows: np.ndarray, columns: np.ndarray, trees: int) -> np.ndarray:
    """Of each row and column whether they stand below one node in some of the first trees."""
    out = np.zeros((len(rows), len(columns)), bool)
    for t in range(trees):
        out |= codes[rows, t][:, None] == codes[columns, t][None, :]
    return out


def common_shingles(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, wanted: np.ndarray, step: int = 2048) -> np.ndarray:
    """How many shingles each wanted pair of a row and a column has in common; elsewhere anything."""
    counts = np.zeros((len(rows), len(columns)), np.float32)
    pairs = np.argwhere(wanted)
    if len(pairs) <= 2 * (len(rows) + len(columns)):
        for i, j in pairs:
            counts[i, j] = len(np.intersect1d(sets[rows[i]], sets[columns[j]], assume_unique=True))
        return counts
    every = np.union1d(rows, columns)
    flat, code, times = np.unique(np.concatenate([sets[i] for i in every]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(every)), [len(sets[i]) for i in every])
    kept = times[code] > 1  # a shingle of one text is common to none
    number = np.cumsum(times > 1) - 1
    owner, code = owner[kept], number[code[kept]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    at_row, at_column = np.searchsorted(every, rows), np.searchsorted(every, columns)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        a, b = np.searchsorted(code, [low, low + step])
        has = np.zeros((len(every), min(step, int(code[-1]) + 1 - low)), np.float32)
        has[owner[a:b], code[a:b] - low] = 1
        counts += has[at_row] @ has[at_column].T
    return counts


def compare_block(signatures: np.ndarray, sets: list[np.ndarray], part: np.ndarray, asks: np.ndarray, low: int, high: int, tree: int, k: int, depth: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one piece of work (i, j, similarity): pairs of a text in part low and one in part high that meet first here."""
    n, trees = len(sets), signatures.shape[1] // depth
    values = signatures.reshape(n, trees, depth)
    node_of = lambda length: np.stack([np.unique(np.ascontiguousarray(values[:, t, :length]).view(f"V{2 * length}").ravel(), return_inverse=True)[1] for t in range(trees)], axis=1)
    here = node_of(k)
    rows, columns = np.flatnonzero(part == low), np.flatnonzero(part == high)
    wanted = (here[rows, tree][:, None] == here[columns, tree][None, :]) & (asks[rows][:, None] | asks[columns][None, :])
    if low == high:
        wanted &= rows[:, None] < columns[None, :]
    sizes = np.array([len(s) for s in sets], np.int64)
    a, b = sizes[rows][:, None], sizes[columns][None, :]
    wanted &= np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9
    if wanted.any():
        wanted &= ~met(here, rows, columns, tree)
    if wanted.any() and k < depth:
        wanted &= ~met(node_of(k + 1), rows, columns, trees)
    if not wanted.any():
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    use, across = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    wanted = wanted[np.ix_(use, across)]
    shared = common_shingles(sets, rows[use], columns[across], wanted)
    i, j = np.nonzero(wanted & (shared >= threshold * (a[use] + b[:, across] - shared) - 1e-9))
    i, j, both = use[i], across[j], shared[i, j]
    i, j = rows[i], columns[j]
    return i, j, both / (sizes[i] + sizes[j] - both)


def verify(blocks: DataFrame, k: int, depth: int, trees: int, threshold: float) -> DataFrame:
    """node, root, text_links, doc_links, missed: per piece of work the links of each linked text, a text it belongs with,
    and how many links of such similarities are missed at this length beside those found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for table, borders in runs_of(batches, "work"):
            tree, low, high = (table[c].to_numpy() for c in ("tree", "low", "high"))
            nodes, copies, parts, asking = (table[c].to_numpy() for c in ("node", "copies", "part", "asks"))
            for a, b in zip(borders, [*borders[1:], table.num_rows], strict=True):
                if b <= a:
                    continue
                _, first = np.unique(nodes[a:b], return_index=True)  # a text's repeated rows are one
                if len(first) < 2:
                    continue
                pick = a + first
                rows = table.select(["shingles", "signature"]).take(pa.array(pick))
                sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"].to_pylist()]
                left, right, alike = compare_block(binary_matrix(rows["signature"], ">u2"), sets, parts[pick], asking[pick].astype(bool), int(low[a]), int(high[a]), int(tree[a]), k, depth, threshold)
                if not len(left):
                    continue
                ids, n = nodes[pick], copies[pick]
                parent = np.arange(len(ids))

                def find(i: int, parent=parent) -> int:
                    while parent[i] != i:
                        parent[i] = parent[parent[i]]
                        i = parent[i]
                    return i

                for i, j in zip(left.tolist(), right.tolist(), strict=True):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
                unseen = (1 - alike**k) ** trees
                unseen /= 1 - unseen
                count = lambda of, weights, m=len(ids): np.bincount(of, weights, m)
                texts, missed = count(left, None) + count(right, None), count(left, unseen) + count(right, unseen)
                docs = count(left, n[right]) + count(right, n[left])
                out += [(ids[i], ids[find(i)], int(texts[i]), int(docs[i]), float(missed[i])) for i in np.flatnonzero(texts)]
                if len(out) > 4096:
                    yield _links(out)
                    out = []
        if out:
            yield _links(out)

    return blocks.mapInArrow(run, "node bigint, root bigint, text_links bigint, doc_links bigint, missed double")


def _links(rows: list[tuple]) -> pa.RecordBatch:
    names = ["node", "root", "text_links", "doc_links", "missed"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if name == "missed" else pa.int64()) for name, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def shingled(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """node, copies, signature, shingles of the wanted texts (node, sha, doc, copies, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                sets = text_shingles(part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "copies", "signature", "shingles"])

    sources = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), text_or_empty(text).alias("text"))
    found = wanted.join(sources.withColumn("sha", F.expr("substring(unhex(sha2(text, 256)), 1, 16)")), ["doc", "sha"]).select("node", "copies", "signature", "text")
    return found.mapInArrow(run, "node bigint, copies bigint, signature binary, shingles binary")


def blocks_at(tries: DataFrame, k: int, depth: int, done: DataFrame | None, block: int, block_bytes: int) -> DataFrame:
    """work, tree, low, high, part, node, asks: the pieces of work at prefixes of k values. A trie's node is left out where
    no text asks any more, where all its texts stood below one node before, and where an earlier tree has the same texts."""
    rows = tries.select("node", "n", "tree", F.xxhash64("tree", F.expr(f"substring(label, 1, {2 * k})")).alias("key"), F.xxhash64("node" if k == depth else F.expr(f"substring(label, 1, {2 * k + 2})")).alias("child"))
    rows = rows.withColumn("asks", F.lit(True)) if done is None else rows.join(done.withColumn("asks", F.lit(False)), "node", "left").withColumn("asks", F.coalesce("asks", F.lit(True)))
    buckets = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.min("tree").alias("tree"), F.bool_or("asks").alias("any"), (F.min("child") != F.max("child")).alias("new"),
        F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x2"),
    ).where("size > 1 and any and new")
    buckets = buckets.groupBy("size", "shingles", "x1", "x2").agg(F.min(F.struct("tree", "key")).alias("first")).select("size", "shingles", "first.tree", "first.key")
    parts = F.ceil(F.greatest(F.col("size") / block, F.col("shingles") * 8 / block_bytes)).cast("int")
    dealt = rows.drop("tree").join(buckets, "key").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("node", "asks", "tree", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "key")
    return dealt.withColumn("work", F.xxhash64("key", "low", "high"))


def classed(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, trees: int = 24, depth: int = 8, block: int = 768, block_bytes: int = 6 << 20, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Staged: doc, sha of every document; and of every text sha, doc (its least id), label (one a class), class_doc, class_size and links."""
    least = prefix_length(threshold, recall, trees, depth)
    signed = staged(signatures(docs, Forest(trees, depth), doc_id, text), "join-signed", 1000)
    texts = signed.groupBy("sha").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    texts = staged(texts.withColumn("node", F.monotonically_increasing_id()), "join-texts")
    tries = staged(shared_prefixes(texts, trees, depth, least), "join-tries")
    wanted = tries.select("node").distinct().join(texts, "node").select("node", "sha", "doc", "copies", "signature")
    content = staged(shingled(docs, wanted, doc_id, text), "join-content", 400)
    links = done = None
    for k in range(depth, least - 1, -1):
        work = blocks_at(tries, k, depth, done, block, block_bytes).join(content, "node").select("work", "tree", "low", "high", "part", "node", "asks", "copies", "signature", "shingles")
        found = staged(verify(work.repartition("work").sortWithinPartitions("work"), k, depth, trees, threshold), f"join-links-{k}", 400)
        links = found if links is None else links.unionByName(found)
        unseen = (1 - threshold**k) ** trees  # the chance that one more link at the threshold has not met yet
        sums = links.groupBy("node").agg(F.sum("text_links").alias("found"), F.sum("missed").alias("missed"))
        done = sums.where(F.col("found") >= recall * (F.col("found") + F.col("missed") + unseen)).select("node")
    labels = components(links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("text_links").alias("text_links"), F.sum("doc_links").alias("doc_links"))
    named = texts.select("sha", "node", "doc", "copies").join(labels, "node", "left").join(counts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = named.groupBy("label").agg(F.min("doc").alias("class_doc"), F.sum("copies").alias("class_size"))
    named = named.join(classes, "label").select("sha", "doc", "label", "class_doc", "class_size", F.coalesce("text_links", F.lit(0)).alias("text_links"), (F.coalesce("doc_links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    named = staged(named, "join-named")
    for df in (texts, tries, content, links, labels):
        drop_staged(df)
    return signed.select("doc", "sha"), named


def join_similar(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, text_sha, class_id, class_size, links (documents that resemble it), text_links (texts other than its own that do).

    class_id is the least id of the class. It names no class where ids are null or stand on several texts.
    """
    signed, named = classed(docs, **settings)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return signed.join(named.drop("doc", "label"), "sha").select(real("doc").alias("doc_id"), F.lower(F.hex("sha")).alias("text_sha"), real("class_doc").alias("class_id"), "class_size", "links", "text_links")


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The documents, one of each class: the one with the least id, of equal ids the least text hash (of repeated rows any one)."""
    _, named = classed(docs, **settings)
    kept = named.groupBy("label").agg(F.min(F.struct("doc", "sha")).alias("first")).select(F.col("first.doc").alias("jj_key"), F.lower(F.hex("first.sha")).alias("jj_sha"))
    own = docs.select(F.struct("*").alias("jj_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("jj_key"), F.lower(F.hex(F.expr("substring(unhex(sha2(coalesce(cast(text as string), ''), 256)), 1, 16)"))).alias("jj_sha"))
    once = own.join(kept, ["jj_key", "jj_sha"]).dropDuplicates(["jj_key", "jj_sha"])
    return once.select(*[F.col("jj_row").getField(c).alias(c) for c in docs.columns])
