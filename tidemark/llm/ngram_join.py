"""Jaccard self-join on word n-grams with token-combination prefixes; links become components.

Documents with equal shingle sets are one node. A node x with n shingles can miss at most n // 4 of them in a partner
(for a similarity of 0.75), so its lowest n // 4 + 1 + m hashes, its *extended prefix*, share at least min(m) + 1 with that
of any partner. From there on only extended prefixes matter:

1. Prefix tokens are dealt to buckets by hash, as packed blocks. A bucket finds the tokens that two nodes share and their
   frequency; a bucket that a very frequent token makes large is split by node, and the counts of its parts are added up. A node with too
   few shared tokens has no partner and drops out; most documents end here.
2. The others order their prefix by frequency, rare tokens first, and emit signatures until what is left can't hold a
   partner's required overlap: rare tokens alone, frequent ones as all pairs of tokens within a class. Classes are a hash of the
   token; of each class one token is lost to pairing, so there are at most as many classes as the extended prefix has tokens to
   spare. Which classes hold depends on the size of documents, in overlapping levels, so both sides of a link agree.
3. Star round: each signature proposes its node with the most common tokens (the likely original) to all others; every node verifies
   the proposal that most of its signatures make. Verification computes both sets from whole texts. A large group of near copies
   becomes one component with about as many verifications as members.
4. Rest: where a signature's nodes are in different components, such pairs are compared by size and by parity bitmaps, which bound the size of
   the symmetric difference from below, and what passes is verified. Short lists give all their pairs, many lists at a time. Long ones
   are compared in blocks, which first return a spanning part of what passes: if it verifies, the other pairs are within components. Lists of
   nodes for which something did not verify are compared once more, and return all. No signature, list or candidate is
   capped, so no link between different components is lost.

Defined results: a null, empty or blank text has no shingles and links with nothing; a shorter text has its word sequence as its
one shingle; texts of any length are read whole; repeated rows are copies of each other; a null doc_id links with nothing and
has a null component; an empty table gives an empty table; other columns are not read, and :func:`keep_one` returns the columns
it got.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._store import bounded_batches, discard, fresh, materialize
from tidemark.llm._words import mix, shingle_sets, slices
from tidemark.llm.components import components, stars

WIDTH, PERCENT = 5, 75
#: A shingle in more nodes than this is frequent and is indexed in pairs.
RARE = 64
#: One spare prefix token for so many shingles.
SPARE = 8
#: Tokens in a bucket, on average; nodes of either side in a block; nodes in a short list, at most.
BUCKET_TOKENS, BLOCK, SHORT = 400_000, 4096, 64
#: Times the average from which a bucket is split.
LARGE = 4
#: Entries of short lists in a bucket, on average: the larger, the fewer times is a pair found.
BUCKET_ENTRIES = 400_000
#: Entries of long lists in a bucket, on average, counted as often as they are compared; each comes with its bitmap.
BLOCK_ENTRIES = 20_000
#: One of so many long lists is compared before the others.
EARLY = 16
_LEVEL = math.log(100 / (PERCENT - 1))


def _misses(n):
    return n - -(-n * PERCENT // 100)


def _spare(n):
    return n // SPARE


def prefix_size(n):
    """Tokens in the extended prefix of a set of ``n``."""
    return np.minimum(n, _misses(n) + 1 + _spare(n))


def overlap(n):
    """Prefix tokens that a node of ``n`` shares with any partner at least."""
    return _spare(-(-n * PERCENT // 100)) + 1


def level(n: int) -> int:
    return int(math.log(n) / _LEVEL)


def level_overlap(tag: int) -> int:
    """The least overlap among nodes of levels ``tag - 1`` and ``tag``."""
    return _spare(max(1, math.floor(math.exp((tag - 1) * _LEVEL)))) + 1


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common) and common > 0


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _planes(*arrays: np.ndarray) -> bytes:
    """Integer columns byte by byte: high bytes are mostly equal, and shuffles compress."""
    return b"".join(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays)


def _unplanes(data: bytes, columns: int) -> list[np.ndarray]:
    x = np.frombuffer(data, np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).view("<u8").ravel() for c in x]


def _pack(buckets: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    order = np.argsort(buckets, kind="stable")
    which, begin = np.unique(buckets[order], return_index=True)
    ends = np.append(begin, len(order))[1:]
    sorted_ = [c[order] for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([_planes(*(c[a:b] for c in sorted_)) for a, b in zip(begin, ends, strict=True)], pa.binary())], ["bucket", "data"])


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for texts in slices(batch.column("text")):
        for d, s in enumerate(shingle_sets(texts, WIDTH)):
            yield texts.first + d, s


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, n, a 128-bit fingerprint and the extended prefix of each document's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            prefix = [b""] * batch.num_rows
            for i, s in _sets(batch):
                n[i] = len(s)
                a[i], b[i] = _fingerprint(s)
                prefix[i] = s[: int(prefix_size(len(s)))].astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (n, a, b)), pa.array(prefix, pa.binary())], ["doc_id", "n", "h1", "h2", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, tokens binary")


def _deal(buckets: int):
    """Rows node, n, tokens as blocks of (token, node, n) for each bucket of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token = np.concatenate([t for t, _, _ in held])
            times = [len(t) for t, _, _ in held]
            node, n = (np.repeat(np.array([h[k] for h in held], np.uint64), times) for k in (1, 2))
            held.clear()
            return _pack((token % np.uint64(buckets)).astype(np.int32), [token, node, n])

        for batch in batches:
            for node, n, blob in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "tokens")), strict=True):
                held.append((np.frombuffer(blob, "<u8"), node, n))
                size += len(held[-1][0])
                if size >= 500_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


_BLOCKS = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """token, node, n of all blocks, sorted, each once."""
    token, node, n = (np.concatenate(c) for c in zip(*(_unplanes(d.as_py(), 3) for d in table.column("data")), strict=True))
    order = np.lexsort((node, token))
    token, node, n = token[order], node[order], n[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    return token[new], node[new], n[new]


def _to_nodes(token: np.ndarray, node: np.ndarray, n: np.ndarray, often: np.ndarray, buckets: int) -> pa.Table:
    keep = often > 1
    columns = [c[keep].astype(np.uint64) for c in (node, n, token, often)]
    return pa.Table.from_batches([_pack((node[keep] % np.uint64(buckets)).astype(np.int32), columns)], _BLOCKS)


def _shared(buckets: int):
    """The tokens of a bucket that more than one node has, as blocks of (node, n, token, frequency) for each bucket of nodes."""

    def run(table: pa.Table) -> pa.Table:
        token, node, n = _entries(table)
        _, inverse, count = np.unique(token, return_inverse=True, return_counts=True)
        return _to_nodes(token, node, n, count[inverse], buckets)

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of large buckets, dealt to ``parts`` by node."""
    for batch in batches:
        for bucket, parts, data in zip(*(batch.column(c) for c in ("bucket", "parts", "data")), strict=True):
            columns = _unplanes(data.as_py(), 3)
            made = _pack((mix(columns[1]) % np.uint64(parts.as_py())).astype(np.int32), columns)
            yield pa.RecordBatch.from_arrays([pa.array([bucket.as_py()] * made.num_rows, pa.int32()), *made.columns], ["bucket", "part", "data"])


def _counted(table: pa.Table) -> pa.Table:
    """The tokens of a part of a bucket, and in how many nodes they are."""
    token, count = np.unique(_entries(table)[0], return_counts=True)
    return pa.table({"bucket": table.column("bucket").slice(0, 1).cast(pa.int32()), "data": pa.array([_planes(token, count)], pa.binary())})


def _added(table: pa.Table) -> pa.Table:
    """The counts of a bucket's parts as one: the tokens of several nodes."""
    token, count = (np.concatenate(c) for c in zip(*(_unplanes(d.as_py(), 2) for d in table.column("data")), strict=True))
    token, inverse = np.unique(token, return_inverse=True)
    total = np.bincount(inverse, count).astype(np.uint64)
    return pa.table({"bucket": table.column("bucket").slice(0, 1).cast(pa.int32()), "data": pa.array([_planes(token[total > 1], total[total > 1])], pa.binary())})


def _shared_part(buckets: int):
    """What :func:`_shared` returns, for a part of a bucket and the counts of the whole bucket."""

    def run(table: pa.Table) -> pa.Table:
        whole = pa.compute.equal(table.column("kind"), 1)
        blocks, totals = table.filter(pa.compute.invert(whole)), table.filter(whole)
        if not blocks.num_rows:
            return _BLOCKS.empty_table()
        token, node, n = _entries(blocks)
        known, count = _unplanes(totals.column("data")[0].as_py(), 2)
        at = np.minimum(np.searchsorted(known, token), max(len(known) - 1, 0))
        often = np.where(known[at] == token, count[at], 1) if len(known) else np.ones(len(token))
        return _to_nodes(token, node, n, often, buckets)

    return run


def _shared_tokens(blocks: DataFrame, buckets: int, bucket_tokens: int) -> DataFrame:
    """Blocks of the shared tokens for each bucket of nodes. ``blocks``, which are written down, may be of any size together."""
    sizes = blocks.groupBy("bucket").agg((F.sum(F.length("data")) / 24).alias("n")).where(F.col("n") > LARGE * bucket_tokens)
    large = materialize(sizes.select(F.col("bucket").alias("of"), F.ceil(F.col("n") / bucket_tokens).cast("int").alias("parts")))
    if large.isEmpty():
        return blocks.groupBy("bucket").applyInArrow(_shared(buckets), "bucket int, data binary")
    own = blocks.join(large, F.col("bucket") == F.col("of"), "left_anti")
    parted = materialize(blocks.join(large, F.col("bucket") == F.col("of")).select("bucket", "parts", "data").mapInArrow(_split, "bucket int, part int, data binary"))
    counts = parted.groupBy("bucket", "part").applyInArrow(_counted, "bucket int, data binary").groupBy("bucket").applyInArrow(_added, "bucket int, data binary")
    to_each = counts.join(large, F.col("bucket") == F.col("of")).select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "data", F.lit(1).alias("kind"))
    met = parted.withColumn("kind", F.lit(0)).unionByName(to_each).repartition("bucket", "part").groupBy("bucket", "part")
    return own.groupBy("bucket").applyInArrow(_shared(buckets), "bucket int, data binary").unionByName(met.applyInArrow(_shared_part(buckets), "bucket int, data binary"))


_C1, _C2 = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def signatures(n: int, tokens: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The signatures of a node of ``n`` shingles, whose extended prefix shares ``tokens``, each in ``often`` nodes."""
    size = int(prefix_size(n))
    order = np.lexsort((tokens, often))
    tokens, often = tokens[order], often[order]
    alone = size - len(tokens)  # tokens that no other node has: they come first, and no signature of theirs can meet another
    singles, pairs = 0, []
    rare = int(np.searchsorted(often, RARE, "right"))
    for tag in (level(n), level(n) + 1):
        least = level_overlap(tag)
        need = size - least + 1 - alone
        classes = least - 1
        if need <= 0:
            continue
        if not classes:
            singles = max(singles, min(need, len(tokens)))
            continue
        singles = max(singles, min(need, rare))
        need -= rare
        if need <= 0:
            continue
        common = tokens[rare:]
        own = (mix(common) % np.uint64(classes)).astype(np.int64)
        seen = np.zeros(len(common), bool)
        seen[np.unique(own, return_index=True)[1]] = True  # the first of its class adds no pair
        upto = int(np.searchsorted(np.cumsum(~seen), need)) + 1
        common, own = common[:upto], own[:upto]
        by = np.argsort(own, kind="stable")
        for group in np.split(common[by], np.flatnonzero(np.diff(own[by])) + 1):
            group = np.sort(group)
            i, j = np.triu_indices(len(group), 1)
            pairs.append(mix(group[i] * _C1 + mix(group[j] * _C2 + np.uint64(tag))))
    return np.concatenate([mix(tokens[:singles]), *pairs])


def _sign(table: pa.Table) -> pa.Table:
    """The signatures of a bucket's nodes that can have partners."""
    node, n, token, often = (np.concatenate(c) for c in zip(*(_unplanes(d.as_py(), 4) for d in table.column("data")), strict=True))
    order = np.argsort(node, kind="stable")
    node, n, token, often = node[order], n[order].astype(np.int64), token[order], often[order]
    nodes, begin = np.unique(node, return_index=True)
    ends = np.append(begin[1:], len(node))
    sig, who, size, own = [np.zeros(0, np.uint64)], [], [], []
    times = []
    for i in np.flatnonzero(ends - begin >= overlap(n[begin])):
        a, b = begin[i], ends[i]
        s = signatures(int(n[a]), token[a:b], often[a:b])
        sig.append(s)
        who.append(nodes[i])
        size.append(n[a])
        own.append(-np.log2(often[a:b].astype(float)).sum() / int(prefix_size(n[a])))
        times.append(len(s))
    spread = lambda v, t: pa.array(np.repeat(np.array(v, t), times))
    return pa.table({"sig": pa.array(np.concatenate(sig).view(np.int64)), "node": spread(who, np.int64), "n": spread(size, np.int32), "own": spread(own, np.float32)})


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose whole texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in recent:
                recent[node] = shingle_sets(next(slices(pa.array([text.as_py()]))), WIDTH)[0]
                if len(recent) > 256:
                    recent.popitem(last=False)
            recent.move_to_end(node)
            return recent[node]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ok = [linked(of(x, s), of(y, t)) for x, y, s, t in zip(a, b, batch.column("text_a"), batch.column("text_b"), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _bits(n: int) -> int:
    """Bits of the parity bitmap of a set of ``n``: a power of two, so that a longer one folds to a shorter one."""
    return 1 << max(6, (4 * n - 1).bit_length())


def _bitmap(s: np.ndarray) -> bytes:
    bits = _bits(len(s))
    return np.packbits(np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _mapped(texts: DataFrame) -> DataFrame:
    """With each node's bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps: list[bytes] = [b""] * batch.num_rows
            for i, s in _sets(batch):
                maps[i] = _bitmap(s)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("text"), pa.array([len(m) for m in maps], pa.int32()), pa.array(maps, pa.binary())], ["node", "text", "bytes", "map"])

    return texts.select("node", "text").mapInArrow(run, "node long, text string, bytes int, map binary")


def _fold(m: np.ndarray, size: int) -> np.ndarray:
    while len(m) > size:
        m = m[: len(m) // 2] ^ m[len(m) // 2 :]
    return m


def _may_link(apart, total):
    """Whether a symmetric difference of ``apart`` at least leaves sets of ``total`` together similar enough."""
    return apart * (100 + PERCENT) <= total * (100 - PERCENT)


def _by_bitmap(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b, total) that the bitmaps let pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, total in zip(batch.column("map_a"), batch.column("map_b"), batch.column("total").to_pylist(), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
                size = min(len(a), len(b))
                keep.append(_may_link(int(np.bitwise_count(_fold(a, size) ^ _fold(b, size)).sum(dtype=np.int64)), total))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left, right = (maps.select(F.col("node").alias(k), F.col("map").alias(f"map_{k}")) for k in ("a", "b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "total", "map_a", "map_b").mapInArrow(run, "a long, b long")


def _listed(table: pa.Table) -> pa.Table:
    """All pairs of different components and fitting sizes in a bucket of short lists."""
    sig, node, n, label = (table.column(c).to_numpy() for c in ("sig", "node", "n", "label"))
    order = np.lexsort((n, sig))
    sig, node, n, label = sig[order], node[order], n[order].astype(np.int64), label[order]
    out, held = [np.zeros((0, 3), np.int64)], 0
    for k in range(1, SHORT):
        i = np.flatnonzero(sig[k:] == sig[:-k])
        if not len(i):
            break
        i = i[(label[i] != label[i + k]) & (n[i + k] * PERCENT <= n[i] * 100)]
        a, b = node[i], node[i + k]
        out.append(np.stack([np.maximum(a, b), np.minimum(a, b), n[i] + n[i + k]], 1))
        held += len(i)
        if held > 1_000_000:
            out, held = [np.unique(np.concatenate(out), axis=0)], 0
    pairs = np.unique(np.concatenate(out), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "total": pa.array(pairs[:, 2])})


def _spanning(margin: np.ndarray, i: np.ndarray, j: np.ndarray, group: np.ndarray, each: int = 8) -> np.ndarray:
    """Edges (i, j) that hold a spanning forest over the groups, by Boruvka's rounds: the ``each`` edges of lowest margin that leave a
    component. One would do if all were links; some more make it likely that one is."""
    order = np.argsort(margin, kind="stable")
    a, b = group[i[order]], group[j[order]]
    chosen: list[np.ndarray] = [np.zeros(0, np.int64)]
    while len(order):
        ends = np.stack([a, b], 1).ravel()
        by = np.argsort(ends, kind="stable")
        begin = np.flatnonzero(np.concatenate(([True], ends[by][1:] != ends[by][:-1])))
        rank = np.arange(len(by)) - np.repeat(begin, np.diff(np.append(begin, len(by))))
        chosen.append(order[np.unique(by[rank < each] // 2)])
        best = np.unique(by[rank == 0] // 2)
        child, root = stars(a[best], b[best])
        at = np.minimum(np.searchsorted(child, a), len(child) - 1), np.minimum(np.searchsorted(child, b), len(child) - 1)
        a, b = np.where(child[at[0]] == a, root[at[0]], a), np.where(child[at[1]] == b, root[at[1]], b)
        apart = a != b
        a, b, order = a[apart], b[apart], order[apart]
    return np.unique(np.concatenate(chosen))


def _close(spanning: bool):
    """Pairs of the blocks of long lists in a bucket, of different components, that size and bitmap let pass, each once; or a spanning
    part of them."""

    def block(node, n, label, side, wide, maps) -> np.ndarray:
        order = np.argsort(n, kind="stable")
        node, n, label, side, wide = node[order], n[order], label[order], side[order], wide[order]
        maps = [maps[i] for i in order]
        top = np.searchsorted(n, n * 100 // PERCENT, "right")
        left, right, margins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        # Sizes are sorted: partners of at least a node's own size stand behind it, and the bitmap of a smaller set is not longer.
        for size in np.unique(wide):
            mine = np.flatnonzero(wide == size)
            first, stop = mine[0], top[mine].max()
            folded = np.stack([_fold(maps[j], size) if len(maps[j]) >= size else np.zeros(size, np.uint8) for j in range(first, stop)]).view(np.uint64)
            for i in mine:
                near = np.arange(i + 1, top[i])
                near = near[label[near] != label[i]]
                near = near[(side[near] == 2) | (side[near] != side[i])]
                if len(near):
                    apart = np.bitwise_count(folded[near - first] ^ folded[i - first]).sum(1, dtype=np.int64)
                    both = n[i] + n[near]
                    good = _may_link(apart, both)
                    near = near[good]
                    left.append(np.full(len(near), i))
                    right.append(near)
                    margins.append(apart[good] / both[good])
        i, j = np.concatenate(left), np.concatenate(right)
        if spanning:
            chosen = _spanning(np.concatenate(margins), i, j, label)
            i, j = i[chosen], j[chosen]
        return np.stack([np.maximum(node[i], node[j]), np.minimum(node[i], node[j])], 1)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        keys = [table.column(c).to_numpy() for c in ("j", "i", "sig")]
        order = np.lexsort(keys)
        changed = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        raw = table.column("map").combine_chunks()
        own = [table.column(c).to_numpy() for c in ("node", "n", "label", "side", "bytes")]
        own[1] = own[1].astype(np.int64)
        found = np.zeros((0, 2), np.int64)
        for part in np.split(order, np.flatnonzero(changed) + 1):
            pairs = block(*(c[part] for c in own), [np.frombuffer(raw[int(i)].as_buffer(), np.uint8) for i in part])
            found = np.unique(np.concatenate([found, pairs]), axis=0) if len(pairs) else found
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return run


def _relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the component of each node as label."""
    return rows.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")


def _still_mixed(rows: DataFrame) -> DataFrame:
    """The rows of those lists whose nodes are in different components."""
    lists = rows.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return rows.join(lists.select("sig"), "sig", "left_semi")


def _mixed(signed: DataFrame, labels: DataFrame) -> DataFrame:
    """sig, node, n, label, size of the lists whose nodes are in different components."""
    found = _relabelled(signed.select("sig", "node", "n"), labels)
    lists = found.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").cast("int").alias("size")).where("low < high")
    return found.join(lists.select("sig", "size"), "sig")


def _in_blocks(rows: DataFrame, maps: DataFrame, block: int, spanning: bool, buckets: int) -> DataFrame:
    """Pairs of long lists. Blocks share ``buckets``, so that a pair that many lists hold is returned a few times only."""
    rows = rows.join(maps, "node").withColumn("parts", F.ceil(F.col("size") / block).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # A list's nodes meet in blocks (i, j), i <= j: side 0 against side 1, or (2) among themselves.
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    i, j = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1)
    met = met.select("sig", i.alias("i"), j.alias("j"), side.alias("side"), "node", "n", "label", "bytes", "map")
    dealt = met.withColumn("bucket", F.pmod(F.xxhash64("sig", "i", "j"), F.lit(buckets)))
    # A task a bucket: by their bytes alone, adaptive execution would give many to one task.
    return dealt.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_close(spanning), "a long, b long").distinct()


def classes(docs: DataFrame, block: int = BLOCK, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    whole = materialize(measured(docs))  # texts are cut into words once
    meta = materialize(whole.drop("tokens"))
    nodes = meta.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("first"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    total = nodes.agg(F.sum((F.col("n") / 3 + 1).cast("long"))).first()[0]
    if total is None:
        return meta.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    buckets = max(1, total // bucket_tokens)
    at = nodes.select("h1", "h2", "n", "node", F.col("first").alias("doc_id"))
    prefixes = whole.where("n > 0").join(at, ["doc_id", "h1", "h2", "n"]).select("node", "n", "tokens")
    blocks = materialize(prefixes.mapInArrow(_deal(buckets), "bucket int, data binary"))
    discard(whole)
    signed = materialize(_shared_tokens(blocks, buckets, bucket_tokens).groupBy("bucket").applyInArrow(_sign, "sig long, node long, n int, own float"))
    discard(blocks)

    alive = signed.select("node").distinct().join(nodes.select("node", "h1", "h2", F.col("first").alias("doc_id")), "node")
    # Repeated rows of an id would come twice; equal fingerprints are equal sets, so one of them is enough.
    texts = docs.select("doc_id", "text").join(alive, "doc_id").join(meta.select("doc_id", F.col("h1").alias("g1"), F.col("h2").alias("g2")).distinct(), "doc_id").where("h1 = g1 and h2 = g2")
    texts = materialize(_mapped(texts))
    maps = texts.select("node", "bytes", "map")

    star = signed.groupBy("sig").agg(F.min(F.struct("own", "node", "n")).alias("top"), F.count("*").alias("size")).where("size > 1")
    offered = signed.join(star.select("sig", "top"), "sig").where((F.col("top.node") != F.col("node")) & (F.greatest("n", "top.n") * PERCENT <= F.least("n", "top.n") * 100))
    votes = offered.groupBy("node", "top").agg(F.count("*").alias("votes"))
    best = votes.groupBy("node").agg(F.max_by("top", F.struct("votes", -F.col("top.own"), -F.col("top.node"))).alias("top"))
    tried = materialize(best.select(F.greatest("node", "top.node").alias("a"), F.least("node", "top.node").alias("b")).distinct())
    links = materialize(_verify(tried, texts))
    labels = components(links)

    mixed = materialize(_mixed(signed, labels))
    # A list of several blocks is compared block by block: each entry as often as there are blocks.
    compared = mixed.where(F.col("size") > SHORT).agg(F.sum(F.ceil(F.col("size") / block))).first()[0]
    blocks_in = max(1, int(compared or 0) // BLOCK_ENTRIES)
    # A part of the long lists goes first: it joins most of what belongs together, and then few lists are left to compare.
    early = _in_blocks(mixed.where((F.col("size") > SHORT) & (F.pmod(F.xxhash64("sig"), F.lit(EARLY)) == 0)), maps, block, True, blocks_in)
    early = materialize(early.join(tried, ["a", "b"], "left_anti"))
    joined = materialize(_verify(early, texts))
    links = links.unionByName(joined)
    tried = tried.unionByName(early)
    mixed = materialize(_still_mixed(_relabelled(mixed, components(links))))

    buckets = max(1, mixed.count() // BUCKET_ENTRIES)
    short = mixed.where(F.col("size") <= SHORT).select(F.pmod("sig", F.lit(buckets)).alias("bucket"), "sig", "node", "n", "label")
    pairs = short.groupBy("bucket").applyInArrow(_listed, "a long, b long, total long").distinct().join(tried, ["a", "b"], "left_anti")
    spanning = _in_blocks(mixed.where(F.col("size") > SHORT), maps, block, True, blocks_in)
    rest = materialize(_by_bitmap(pairs, maps).unionByName(spanning).distinct())
    more = materialize(_verify(rest, texts))
    links = links.unionByName(more)
    labels = components(links)

    # A spanning pair that did not verify may have stood for others: lists with its nodes return all that passes.
    failed = rest.unionByName(early).join(more.unionByName(joined), ["a", "b"], "left_anti")
    doubtful = failed.select(F.col("a").alias("node")).unionByName(failed.select(F.col("b").alias("node"))).distinct()
    open_ = _still_mixed(_relabelled(mixed.where(F.col("size") > SHORT), labels))
    again = open_.join(doubtful, "node", "left_semi").select("sig").distinct()
    last = _in_blocks(open_.join(again, "sig", "left_semi"), maps, block, False, blocks_in)
    last = last.join(rest.unionByName(tried), ["a", "b"], "left_anti")
    found = components(links.unionByName(_verify(materialize(last), texts)))
    discard(texts, signed, mixed, tried, rest)

    # The least doc_id of each component that has several nodes, written down: the join with it can then be split where one is large.
    least = found.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("low"))
    least = materialize(least.join(nodes.select(F.col("node").alias("component"), "first"), "component").select("component", F.least("low", "first").alias("component_id")))
    member = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).join(least, "component", "left")
    named = member.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("n").alias("k"), F.coalesce("component_id", "first").alias("component_id"))
    joined = meta.join(named, (meta.h1 == F.col("k1")) & (meta.h2 == F.col("k2")) & (meta.n == F.col("k")) & meta.doc_id.isNotNull(), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, block: int = BLOCK, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """``docs`` with the smallest doc_id of each component alone, once; rows with a null doc_id stay."""
    columns, row = docs.columns, fresh(docs.columns, "__row")
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    kept = classes(docs, block, bucket_tokens).where("doc_id = component_id").select("doc_id").distinct()
    ids = docs.select("doc_id", row).groupBy("doc_id").agg(F.min(row).alias(row))
    chosen = ids.join(kept, "doc_id", "left_semi").select(row).unionByName(docs.where("doc_id is null").select(row))
    return docs.join(chosen, row, "left_semi").select(*(F.col(f"`{c}`") for c in columns))
