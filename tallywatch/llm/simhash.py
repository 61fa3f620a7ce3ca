"""Near-duplicates by SimHash fingerprints and BK-trees.

Two 64-bit fingerprints that differ in at most r bits agree on m - r whole blocks if the bits are cut into m
blocks. Every choice of m - r blocks is a key; a bucket is all distinct fingerprints with the same key value, so
any two linked fingerprints meet in a bucket. A bucket is indexed by BK-trees: the first fingerprint is the
root, and children hang on edges labelled with their integer Hamming distance to the parent. A search follows
only edges whose label is within r of the distance to the node. Large buckets are cut into shards with a tree
each, and the bucket's fingerprints are sent to each shard as queries.

Equal fingerprints are one node, so exact copies cost nothing. A search returns links to distinct trees of a
union-find only, so a bucket returns fewer links than it has fingerprints, and they connect all that is linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.llm.common import BROADCAST_IDS, in_steps, text_hash, without_rows, written
from tallywatch.llm.components import components

BITS = 64
#: Mean number of fingerprints in a bucket that the number of blocks is chosen for.
BUCKET_ROWS = 64
#: Fingerprints of one tree; a larger bucket gets more trees.
SHARD_ROWS = 16_384
#: (query, node) pairs of one step of a search.
_PAIRS = 1 << 18

_UNNAMED = 1 << 62
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of ``words`` words of a text, repeats included; A-Z count as a-z."""
    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(blanks + 1).tolist()], [*blanks.tolist(), len(joined)]
    size = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :])], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Fingerprint: a bit is 1 if it is set in over half of the hashes; 0 without hashes."""
    ones = np.zeros(BITS, np.int64)
    for s in range(0, len(hashes), 1 << 16):
        part = hashes[s : s + (1 << 16)].view(np.uint8)
        ones += np.add.reduce(np.unpackbits(part, bitorder="little").reshape(-1, BITS), axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the signed 64-bit value of the fingerprint; ``distinct`` counts a shingle once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, texts in in_steps(batches):
            hashes = (shingle_hashes(x, words) for x in texts)
            fps = np.array([majority(np.unique(h) if distinct else h) for h in hashes], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(fps)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def key_masks(radius: int, rows: int) -> list[int]:
    """Bit masks of the keys: two values within ``radius`` agree under one of them at least.

    More rows need longer keys, hence more blocks: the fewest for which a bucket of evenly spread
    fingerprints holds about BUCKET_ROWS. The result is the same for any number.
    """
    for blocks in range(radius + 1, radius + 9):
        kept = blocks - radius
        if rows / 2 ** (BITS * kept // blocks) <= BUCKET_ROWS:
            break
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(x) for x in combinations(parts, kept)]
    assert len(masks) == comb(blocks, kept)
    return masks


class Forest:
    """BK-trees of many groups at once: ``groups`` (sorted) says to which tree a value belongs, the first of a group is its root.

    Built level by level: all values start at their root; of those with the same distance to a node, the first
    becomes its child and the others go on from there.
    """

    def __init__(self, groups: np.ndarray, values: np.ndarray):
        n = len(values)
        self.values = values
        first = np.r_[True, groups[1:] != groups[:-1]] if n else np.zeros(0, bool)
        self.groups, self.roots = groups[first], np.flatnonzero(first)
        at = np.repeat(self.roots, np.diff(np.r_[self.roots, n]))
        rest = np.flatnonzero(~first)
        links: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rest):
            label = at[rest] * (BITS + 1) + np.bitwise_count(values[rest] ^ values[at[rest]])
            order = np.argsort(label, kind="stable")
            label, rest = label[order], rest[order]
            new = np.r_[True, label[1:] != label[:-1]]
            links.append((label[new], rest[new]))
            at[rest] = np.repeat(rest[new], np.diff(np.r_[np.flatnonzero(new), len(rest)]))
            rest = rest[~new]
        labels = np.concatenate([x[0] for x in links]) if links else np.zeros(0, np.int64)
        nodes = np.concatenate([x[1] for x in links]) if links else np.zeros(0, np.int64)
        order = np.argsort(labels, kind="stable")
        self.labels, self.nodes = labels[order], nodes[order]

    def search(self, groups: np.ndarray, values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, node) within ``radius``; a query looks into the tree of its group."""
        where = np.searchsorted(self.groups, groups)
        stack = [(np.arange(len(values)), self.roots[where])]
        while stack:
            q, v = stack.pop()
            if len(q) > _PAIRS:
                half = len(q) // 2
                stack += [(q[half:], v[half:]), (q[:half], v[:half])]
                continue
            far = np.bitwise_count(values[q] ^ self.values[v]).astype(np.int64)
            near = far <= radius
            if near.any():
                yield q[near], v[near]
            base = v * (BITS + 1)
            low = np.searchsorted(self.labels, base + np.maximum(far - radius, 0))
            count = np.searchsorted(self.labels, base + np.minimum(far + radius, BITS), side="right") - low
            total = int(count.sum())
            if total:
                into = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(total)
                stack.append((np.repeat(q, count), self.nodes[into]))


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def spanning_links(groups: np.ndarray, ids: np.ndarray, values: np.ndarray, tree: np.ndarray, radius: int, nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids that connect, within each group, what is linked: ``tree`` marks the rows of the tree, all rows are queries.

    With ``nearest``, each id is also paired with the nearest one in its tree (of equally near ones, the first).
    """
    rows = np.flatnonzero(tree)
    forest = Forest(groups[rows], values[rows])
    asks = np.flatnonzero(np.isin(groups, forest.groups))
    parent = list(range(len(values)))
    top = np.arange(len(values))
    out: list[tuple[int, int]] = []
    # A row may stand in the tree and among the queries; equal (group, id) is the same node.
    order = np.lexsort((ids, groups))
    same = np.r_[False, (groups[order][1:] == groups[order][:-1]) & (ids[order][1:] == ids[order][:-1])]
    for i in np.flatnonzero(same):
        a, b = _root(parent, int(order[i])), _root(parent, int(order[i - 1]))
        parent[max(a, b)] = min(a, b)
    top = np.array([_root(parent, x) for x in range(len(values))])
    closest = np.full(len(values), np.iinfo(np.int64).max)
    for q, v in forest.search(groups[asks], values[asks], radius):
        q, v = asks[q], rows[v]
        if nearest:
            other = ids[q] != ids[v]
            np.minimum.at(closest, q[other], (np.bitwise_count(values[q[other]] ^ values[v[other]]).astype(np.int64) << 40) | v[other])
        # Nearest first; of many links between two parts, one is enough.
        pairs = np.c_[np.minimum(top[q], top[v]), np.maximum(top[q], top[v])]
        apart = pairs[:, 0] != pairs[:, 1]
        if not apart.any():
            continue
        q, v, pairs = q[apart], v[apart], pairs[apart]
        near = np.argsort(np.bitwise_count(values[q] ^ values[v]), kind="stable")
        q, v, pairs = q[near], v[near], pairs[near]
        _, keep = np.unique(pairs[:, 0] * len(values) + pairs[:, 1], return_index=True)
        joined = False
        for i in np.sort(keep).tolist():
            a, b = _root(parent, int(q[i])), _root(parent, int(v[i]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(q[i]), int(v[i])))
                joined = True
        if joined:
            top = np.array(parent)
            while True:
                up = top[top]
                if (up == top).all():
                    break
                top = up
    met = np.flatnonzero(closest < np.iinfo(np.int64).max)
    a = np.r_[np.array([x[0] for x in out], np.int64), met]
    b = np.r_[np.array([x[1] for x in out], np.int64), closest[met] & ((1 << 40) - 1)]
    return ids[a], ids[b]


def fingerprint_links(nodes: DataFrame, radius: int, shard_rows: int = SHARD_ROWS, nearest: bool = False) -> DataFrame:
    """(a, b) pairs of ids of ``nodes`` (id, fp; distinct fp) within ``radius`` bits that connect all linked ones, and with
    ``nearest`` the nearest ones of each bucket too; pairs may come twice."""
    masks = key_masks(radius, nodes.count())
    keyed = nodes.select("id", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])).alias("mask", "part"))
    keyed = keyed.select("id", "fp", F.xxhash64("mask", "part").alias("bucket"))
    sizes = keyed.groupBy("bucket").count().where(F.col("count") > 1).select("bucket", F.ceil(F.col("count") / shard_rows).cast("int").alias("shards"))
    # A row is in the tree of its own shard, and asks the trees of all shards of its bucket.
    # Spark takes the exploded table for as small as the nodes and would send all of its keys to the driver.
    met = keyed.hint("merge").join(sizes, "bucket").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    met = met.withColumn("tree", F.pmod(F.xxhash64("id"), F.col("shards")) == F.col("shard"))
    shard = F.xxhash64("bucket", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= shard_rows:
                table = pa.Table.from_batches(held).combine_chunks()
                groups = table.column("group").to_numpy()
                cut = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
                if cut:
                    yield links(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield links(pa.Table.from_batches(held))

    def links(table: pa.Table) -> pa.RecordBatch:
        columns = [table.column(c).to_numpy(zero_copy_only=False) for c in ("group", "id", "fp", "tree")]
        a, b = spanning_links(columns[0], columns[1], columns[2].view(np.uint64), columns[3].astype(bool), radius, nearest)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = met.select(shard.alias("group"), "id", "fp", "tree").repartition("group").sortWithinPartitions("group", "id")
    return rows.mapInArrow(run, "a bigint, b bigint")


def similar_groups(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every document: documents whose fingerprints differ in ``radius`` bits or fewer
    are linked, and a component is named by its smallest doc_id (below 2**62).

    A text with fewer words than a shingle is one shingle; null, empty and blank texts have fingerprint 0 and are
    linked like others. A row without id is in the result, with the component of its fingerprint. Rows that repeat
    an id are each returned, in the component of their own text. Other columns are ignored; an empty table gives no rows.
    """
    marked = written(fingerprints(docs, words, id_col=id_col, text_col=text_col), "fingerprints")
    # A fingerprint of rows without id only gets a number above all ids.
    unnamed = F.xxhash64("fp").bitwiseAND(_UNNAMED - 1) + _UNNAMED
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("id", F.coalesce("least", unnamed)), "fingerprint-nodes")
    links = fingerprint_links(nodes.select("id", "fp"), radius, shard_rows)
    groups = components(links)
    component = F.coalesce("component", "id")
    named = nodes.join(groups, nodes["id"] == groups["node"], "left").select("fp", F.when(component < _UNNAMED, component).alias("component_id"))
    return marked.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: What near copies share: this part of their distinct shingles of so many words.
SIMILARITY, SHINGLE_WORDS = 0.8, 5
#: Fingerprints of distinct words this close are the fast path to candidates. Copies that gained or lost a passage are
#: often further apart, so what the fast path leaves apart is compared by shared shingles, which misses none.
WORD_RADIUS = 6
#: Part of the texts that is looked at for frequent shingles, in how many of them a shingle is frequent, and the most that are kept.
SAMPLE_SHARE, FREQUENT, FREQUENT_ROWS = 8, 4, 1_000_000
#: Shingles counted by a task at once.
_COUNTED = 1 << 21
#: Rows of one shingle that stand in one cell; the rows of a more frequent one are dealt to the pairs of their blocks.
CELL_ROWS = 2_048
#: Least bits of a text's sign: each shingle turns one bit over, so the signs of two texts differ in no more bits than the texts do in
#: shingles. A sign has at least as many bits as the text has shingles; the longer of two signs is folded.
SIGN_BITS = 256
#: A token's rows from which on they are first compared with a few of them only.
HEAD_ROWS, HEADS = 16, 4


def text_sign(tokens: np.ndarray) -> np.ndarray:
    """64-bit words of a text's sign: bit k is the parity of its shingles whose hash ends in k. The number of words is a power of two."""
    bits = max(SIGN_BITS, 1 << max(len(tokens) - 1, 0).bit_length())
    return np.packbits((np.bincount(tokens & (bits - 1), minlength=bits) & 1).astype(bool), bitorder="little").view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]).astype(np.int32)), pa.array(np.concatenate(arrays)))


def shingle_sets(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, size, sign, shingles): the distinct shingle hashes of each text of ``docs`` (id, text), their number and the text's sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, texts in in_steps(batches):
            sets = [np.unique(shingle_hashes(x, words)).view(np.int64) for x in texts]
            sizes = pa.array(np.array([len(x) for x in sets], np.int32))
            yield pa.RecordBatch.from_arrays([step.column(0), sizes, _lists([text_sign(x) for x in sets]), _lists(sets)], names=["id", "size", "sign", "shingles"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, size int, sign array<bigint>, shingles array<bigint>")


def differing_bits(x: Column, y: Column) -> Column:
    """Bits in which two signs differ, the longer one folded to the length of the other."""
    short = F.least(F.size(x), F.size(y))

    def folded(sign: Column, i: Column) -> Column:
        parts = F.transform(F.sequence(i, F.size(sign) - 1, short), lambda j: F.get(sign, j))
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b))

    each = F.transform(F.sequence(F.lit(0), short - 1), lambda i: F.bit_count(folded(x, i).bitwiseXOR(folded(y, i))))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def frequent_shingles(texts: DataFrame, share: int = SAMPLE_SHARE, words: int = SHINGLE_WORDS) -> pa.Table:
    """(token, n) of the most frequent shingles of one in ``share`` texts of ``texts`` (id, text), rarest first; ``n`` is reckoned for all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(np.concatenate(held), return_counts=True)], names=["token", "n"])

        for _, part in in_steps(batches):
            held += [np.unique(shingle_hashes(x, words)).view(np.int64) for x in part]
            size += sum(map(len, held[-len(part) :]))
            if size > _COUNTED:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    sample = texts.where(F.pmod("id", F.lit(share)) == 0)
    counts = sample.select("id", "text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    return counts.orderBy(F.desc("n"), "token").limit(FREQUENT_ROWS).orderBy("n", "token").select("token", (F.col("n") * share).alias("n")).toArrow()


def prefixes(texts: DataFrame, similarity: float, words: int, frequent: pa.Table, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(token, id, part, size, place, often): the first shingles of each text of ``texts`` (id, text, part), in one order for all texts.

    The order is by hash, with ``frequent`` (token, n) ones last in their order; those of half of ``cell_rows`` texts are ``often``. Two texts that share ``similarity`` of their shingles share one
    of so many first ones at least, whatever the order is. A text without words has the token 0.
    """
    token, n = (frequent.column(c).to_numpy() for c in ("token", "n"))
    order = np.argsort(token)
    shared = texts.sparkSession.sparkContext.broadcast((token[order], (order + 1).astype(np.int32), int(np.searchsorted(n, cell_rows // 2)) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank, many = shared.value
        for step, part in in_steps(batches):
            sets = [np.unique(shingle_hashes(x, words)).view(np.int64) for x in part]
            sizes = np.array([len(x) for x in sets], np.int64)
            rows = np.maximum(sizes, 1)
            tokens = np.concatenate([x if len(x) else np.zeros(1, np.int64) for x in sets])
            owner = np.repeat(np.arange(len(sets)), rows)
            late = np.zeros(len(tokens), np.int32)
            if len(last):
                at = np.minimum(np.searchsorted(last, tokens), len(last) - 1)
                late = np.where(last[at] == tokens, rank[at], 0)
                order = np.lexsort((late, owner))
                tokens, late = tokens[order], late[order]
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(rows) - rows, rows)
            first = place <= (sizes - np.ceil(similarity * sizes - 1e-9))[owner]
            owner, place = owner[first], place[first]
            names = [step.column(c).to_numpy(zero_copy_only=False)[owner] for c in (0, 2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (tokens[first], *names, sizes[owner].astype(np.int32), place.astype(np.int32), late[first] >= many)],
                names=["token", "id", "part", "size", "place", "often"],
            )

    return texts.select("id", "text", "part").mapInArrow(run, "token bigint, id bigint, part bigint, size int, place int, often boolean")


_SHARED = ["token", "id", "part", "size", "place"]


def shared_firsts(firsts: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(token, id, part, size, place, n): the rows of ``firsts`` whose token stands in two parts; ``n`` rows have it, null for
    tokens in ``often`` and for those in more than ``cell_rows`` texts, all of whose rows are kept.

    A token's rows meet in one task, which reads them in order and holds at most ``cell_rows`` of them; those in ``often`` are dealt by their text too.
    """
    key = F.when(F.col("often"), F.xxhash64("token", "id")).otherwise(F.col("token"))
    schema = pa.schema([*((c, pa.int64()) for c in _SHARED[:3]), ("size", pa.int32()), ("place", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.zeros(0, schema.field(c).type.to_pandas_dtype()) for c in _SHARED}
        endless = None  # a token of which rows have gone out already

        def out(rows: dict[str, np.ndarray], n: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(rows[c]) for c in _SHARED), n], schema=schema)

        def whole(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            """Of groups that are there to the last row, those of two parts."""
            token = rows["token"]
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            counts = np.diff(np.r_[starts, len(token)])
            mixed = np.minimum.reduceat(rows["part"], starts) != np.maximum.reduceat(rows["part"], starts)
            kept = np.repeat(mixed, counts)
            return out({c: x[kept] for c, x in rows.items()}, pa.array(np.repeat(counts, counts)[kept]))

        def unknown(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
            return out(rows, pa.nulls(len(rows["token"]), pa.int64()))

        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in [*_SHARED, "often"]}
            often = new.pop("often").astype(bool)
            if often.any():
                yield unknown({c: x[often] for c, x in new.items()})
                new = {c: x[~often] for c, x in new.items()}
            if endless is not None:
                same = new["token"] == endless
                if same.any():
                    yield unknown({c: x[same] for c, x in new.items()})
                    new = {c: x[~same] for c, x in new.items()}
            rows = {c: np.concatenate([held[c], new[c]]) for c in _SHARED}
            again = np.r_[False, (rows["token"][1:] == rows["token"][:-1]) & (rows["id"][1:] == rows["id"][:-1])][: len(rows["token"])]
            rows = {c: x[~again] for c, x in rows.items()}
            n = len(rows["token"])
            if not n:
                held = rows
                continue
            cut = int(np.searchsorted(rows["token"], rows["token"][-1]))  # the last group may go on
            if cut:
                yield whole({c: x[:cut] for c, x in rows.items()})
            held = {c: x[cut:] for c, x in rows.items()}
            if n - cut > cell_rows:
                endless = int(held["token"][0])
                yield unknown(held)
                held = {c: x[:0] for c, x in held.items()}
        if len(held["token"]):
            yield whole(held)

    dealt = firsts.withColumn("key", key).repartition("key").sortWithinPartitions("token", "id").drop("key")
    found = written(dealt.mapInArrow(run, "token bigint, id bigint, part bigint, size int, place int, n bigint"), "shared-firsts")
    return found


def least_common(sizes: np.ndarray, others: np.ndarray, similarity: float) -> np.ndarray:
    """How many first shingles two texts of these sizes share at least, if they share ``similarity`` of all.

    The first shingles of one of them are all before the last one of the other, so beyond those that they share as first ones, no more
    than the rest of that text can be shared.
    """
    rest = np.maximum(np.ceil(similarity * sizes - 1e-9), np.ceil(similarity * others - 1e-9)) - 1
    return np.maximum(np.ceil(similarity / (1 + similarity) * (sizes + others) - 1e-6) - rest, 1)


def head_rows(groups: np.ndarray, ids: np.ndarray, firsts: np.ndarray, parts: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Marks the heads of each group of HEAD_ROWS rows or more: of the HEADS parts whose rows share most of their first shingles, one row each.

    A text of which much is shared is near to many; its share is the same in all groups, so a pair of a head meets in most groups that it has in common.
    """
    share = -held / firsts
    order = np.lexsort((ids, share, parts, groups))
    g, p = groups[order], parts[order]
    first = order[np.r_[True, (g[1:] != g[:-1]) | (p[1:] != p[:-1])][: len(g)]]
    first = first[np.lexsort((ids[first], share[first], groups[first]))]
    g = groups[first]
    first = first[np.arange(len(g)) - np.searchsorted(g, g) < HEADS]
    top = np.zeros(len(ids), bool)
    top[first] = True
    return top & (np.searchsorted(groups, groups, side="right") - np.searchsorted(groups, groups) >= HEAD_ROWS)


def cell_pairs(groups: np.ndarray, ids: np.ndarray, sizes: np.ndarray, places: np.ndarray, parts: np.ndarray, held: np.ndarray, blocks: np.ndarray, similarity: float, heads: bool = False) -> list[np.ndarray]:
    """Pairs of ids that meet in a group (sorted by group, then size), and what they can still share from their places on: a, b, both sizes, n groups, rest.

    A place is the number of a text's shared first shingles before this one.

    Only pairs of different ``parts`` whose sizes fit, which both hold enough shared first shingles (``held``), and which can share enough before and from
    their places on. ``blocks`` is -1, or the block of a row in a group that is for the pairs of two blocks only. With ``heads``, only the heads of a group are
    paired with the others, and only if the group has HEAD_ROWS rows: of HEADS parts the row that shares most of its first shingles.
    """
    n = len(ids)
    # A row is compared with those after it that are not too large.
    width = int(sizes.max(initial=0)) + 2
    rank = np.r_[False, groups[1:] != groups[:-1]].cumsum() * width if n else groups
    ends = np.searchsorted(rank + sizes, rank + np.minimum(np.floor(sizes / similarity + 1e-6).astype(np.int64), width - 2), side="right")
    begins = np.arange(n) + 1
    firsts = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    # All of a text but the first shingles that it shares with no other part, and those before this one.
    left = sizes - np.maximum(firsts - held, 0) - places
    if heads:
        top = head_rows(groups, ids, firsts, parts, held)
        least = np.searchsorted(rank + sizes, rank + np.ceil(similarity * sizes - 1e-6).astype(np.int64))
        begins, ends = np.where(top, least, 0), np.where(top, ends, 0)
    after = np.cumsum(ends - begins)
    out, start = [], 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(after, (after[start - 1] if start else 0) + _PAIRS, side="right")))
        rows = np.arange(start, stop)
        count = ends[rows] - begins[rows]
        i = np.repeat(rows, count)
        j = begins[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        fits = (parts[i] != parts[j]) & ((blocks[i] < 0) | (blocks[i] != blocks[j])) & (np.minimum(held[i], held[j]) >= least_common(sizes[i], sizes[j], similarity))
        fits &= np.minimum(places[i], places[j]) + np.minimum(left[i], left[j]) >= similarity / (1 + similarity) * (sizes[i] + sizes[j]) - 1e-6
        if heads:
            fits &= ~top[j] | (i < j)
        i, j = i[fits], j[fits]
        swap = ids[i] > ids[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        out.append([ids[i], ids[j], sizes[i], sizes[j], np.minimum(left[i], left[j])])
        start = stop
    a, b, x, y, rest = (np.concatenate(c) for c in zip(*out)) if out else (ids, ids, sizes, sizes, places)
    order = np.lexsort((b, a))
    a, b, x, y, rest = a[order], b[order], x[order], y[order], rest[order]
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
    if not len(a):
        return [a, b, x, y, np.zeros(0, np.int64), rest]
    return [a[starts], b[starts], x[starts], y[starts], np.diff(np.r_[starts, len(a)]), np.maximum.reduceat(rest, starts)]


def _broadcast_if_small(rows: DataFrame) -> DataFrame:
    """``rows`` (written), to be broadcast if they are BROADCAST_IDS or fewer; else joined by shuffle, however small their files are."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows.hint("merge")


def pairs_apart(shared: DataFrame, moved: DataFrame | None, similarity: float, heads: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b): all pairs of texts in ``shared`` (token, id, part, size, place, n) that can share ``similarity`` of their shingles and whose
    parts ``moved`` (part, now) leaves apart.

    A pair stays if its sizes fit, if it has enough first shingles in common (see least_common), and if from the first of them on
    both texts are long enough: all that two texts share comes from there on. First shingles that a text shares with no other part count as gone. With ``heads`` only some likely pairs are found, few for each row: those
    of a few rows of a frequent shingle that share half of their first shingles.
    """
    # Shingles that no other part has cannot be shared: places are counted without them.
    text = Window.partitionBy("id")
    rows = shared.withColumns({"held": F.count("*").over(text).cast("int"), "place": F.dense_rank().over(text.orderBy("place")) - 1})
    if moved is not None:
        rows = rows.join(moved, "part", "left").withColumn("part", F.coalesce("now", "part")).drop("now")
    known = rows.where("n IS NOT NULL").select("id", "size", "place", "part", "held", F.lit(-1).alias("block"), F.col("token").alias("group"))
    # Tokens of many rows: those of two parts, in cells of two blocks of rows each.
    many = rows.where("n IS NULL").drop("n").dropDuplicates(["token", "id"])
    counts = many.groupBy("token").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count("*").alias("rows")).where("least <> most")
    counts = _broadcast_if_small(written(counts.select("token", F.ceil(F.col("rows") / cell_rows).cast("int").alias("blocks")), "frequent-firsts"))
    many = many.join(counts, "token").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    if heads:
        # A block is compared with its own heads and with one that all blocks of the token have.
        share = F.col("held") / (F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9) + 1)
        top = many.where("blocks > 1").groupBy("token").agg(F.min_by(F.struct("id", "size", "place", "part", "held", "blocks", "own"), F.struct(-share, "id")).alias("top"))
        top = top.select("token", "top.*").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> own").withColumn("own", F.col("other"))
        many = many.withColumn("other", F.col("own")).unionByName(top.select(*many.columns, "other"))
    else:
        many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))
    # In the cell of a block with itself all rows are compared, in that of two blocks the rows of one with those of the other.
    many = many.select("id", "size", "place", "part", "held", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("block"), cell.alias("group"))

    names = ["a", "b", "a_size", "b_size", "common", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            found = table.column("group").to_numpy()
            cut = int(np.searchsorted(found, found[-1])) if len(found) else 0  # the last group may go on
            if cut:
                yield met(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield met(pa.Table.from_batches(held))

    def met(table: pa.Table) -> pa.RecordBatch:
        columns = [table.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("group", "id", "size", "place", "part", "held", "block")]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cell_pairs(*columns, similarity, heads)], names=names)

    dealt = known.unionByName(many).repartition("group").sortWithinPartitions("group", "size", "id")
    found = dealt.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
    found = found.groupBy("a", "b").agg(F.first("a_size").alias("a_size"), F.first("b_size").alias("b_size"), F.sum("common").alias("common"), F.max("rest").alias("rest"))
    share = F.lit(similarity / (1 + similarity)) * (F.col("a_size") + F.col("b_size")) - 1e-6
    rest = F.ceil(F.lit(similarity) * F.greatest("a_size", "b_size") - 1e-9) - 1
    if heads:
        found = found.where(F.col("common") >= (1 - similarity) / 2 * F.least("a_size", "b_size"))
    return found.where((F.col("rest") >= share) & (F.col("common") + rest >= share)).select("a", "b")


def verified_links(marked: DataFrame, pairs: DataFrame, similarity: float, words: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts share ``similarity`` of their distinct shingles (Jaccard).

    Their signs rule most others out before shingles are joined.
    """
    met = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = written(shingle_sets(rows_of(marked, met).dropDuplicates(["id"]), words), "shingles")
    brief = sets.select("id", F.struct("size", "sign").alias("brief"))
    near = pairs.join(brief.select(F.col("id").alias("a"), F.col("brief").alias("x")), "a").join(brief.select(F.col("id").alias("b"), F.col("brief").alias("y")), "b")
    total = F.col("x.size") + F.col("y.size")
    near = near.where(differing_bits(F.col("x.sign"), F.col("y.sign")) <= (1 - similarity) / (1 + similarity) * total + 1e-6).select("a", "b")
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    either = F.size("x") + F.size("y") - both
    return written(near.join(left, "a").join(right, "b").where((either == 0) | (both >= similarity * either)).select("a", "b"), "links")


def near_copy_groups(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE_WORDS, radius: int = WORD_RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, component) for every row: rows of one component are near copies of each other, directly or by way of others.

    Two texts are linked if they share ``similarity`` of their distinct shingles of ``words`` words (Jaccard); the
    components are those of all such pairs. Candidates come first from texts whose fingerprints of distinct words are
    within ``radius`` bits: for each text its nearest in each bucket, and enough others to connect all. This cut is made
    before links are verified, so it may drop a link beside unrelated texts of the same words; none is lost by it, as texts that
    the links found so far leave apart are compared wherever they share enough of their first shingles (see prefixes); a large group of
    copies is first joined by way of a few of them, so that its pairs are not all made.
    Equal texts are one node; null, empty and blank texts are near copies of each other.
    """
    marked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = marked.select(text_hash("text").alias("doc_id"), "text")
    prints = written(fingerprints(hashed, 1, distinct=True).select(F.col("doc_id").alias("id"), "fp").distinct(), "word-fingerprints")
    heads = prints.groupBy("fp").agg(F.min("id").alias("head"))
    equal = prints.join(heads, "fp").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    near = fingerprint_links(heads.select(F.col("head").alias("id"), "fp"), radius, nearest=True)
    pairs = written(equal.unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    links = verified_links(marked, pairs, similarity, words)
    groups = components(links, "copies")
    named = _broadcast_if_small(written(groups.where("node <> component").select(F.col("node").alias("id"), "component"), "copy-names"))
    texts = one_of_each(marked).join(named, "id", "left").select("id", "text", F.coalesce("component", "id").alias("part"))
    shared = shared_firsts(prefixes(texts, similarity, words, frequent_shingles(texts, words=words)))
    moved = None
    for heads in (True, False):
        more = verified_links(marked, written(pairs_apart(shared, moved, similarity, heads), "candidates"), similarity, words)
        if more.take(1):
            links = links.unionByName(more)
            groups = components(links, "copies")
            moved = _broadcast_if_small(written(groups.where("node <> component").select(F.col("node").alias("part"), F.col("component").alias("now")), "copy-names"))
    groups = groups.withColumnRenamed("node", "_node")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_hash(text_col).alias("text_hash"))
    return rows.join(groups, F.col("text_hash") == F.col("_node"), "left").select("doc_id", "text_hash", F.coalesce("component", "text_hash").alias("component"))


def one_of_each(marked: DataFrame) -> DataFrame:
    """(id, text) of ``marked`` (doc_id, text): equal texts come once, but for rows that repeat the least doc_id or have none."""
    rows = marked.select(text_hash("text").alias("id"), "doc_id", "text")
    again = written(rows.groupBy("id").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1 AND least IS NOT NULL").select("id", "least"), "repeated")
    return rows.join(_broadcast_if_small(again), "id", "left").where("least IS NULL OR doc_id = least").select("id", "text")


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the rows of ``docs`` whose text hash is in ``ids``; up to BROADCAST_IDS ids are sent to the texts."""
    ids = _broadcast_if_small(written(ids, "ids"))
    return docs.select(text_hash("text").alias("id"), "text").join(ids, "id", "left_semi")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one of the smallest id. Columns stay.

    A row that is wholly repeated, id and text, stays once. A row without id stays only where no row of its group has one.
    """
    rows = written(near_copy_groups(docs, id_col=id_col, text_col=text_col, **settings), "copy-groups")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"), F.count("*").alias("n")).where("n > 1")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    gone = rows.join(first, "component").where(~kept).select(F.col("doc_id").alias("id"), "text_hash")
    left = without_rows(docs, gone, id_col, text_col)
    again = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id"), "text_hash")
    if not again.take(1):
        return left
    once = left.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("own"), text_hash(text_col).alias("sign"))
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("sign") == F.col("text_hash"))
    repeated = once.join(again, same, "left_semi").dropDuplicates(["own", "sign"]).select("row.*")
    return without_rows(left, again, id_col, text_col).unionByName(repeated)
