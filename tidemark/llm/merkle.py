"""A manifest of a dataset: Merkle trees over its rows, with a proof for each row.

Every row is a leaf. The leaves of a group (a language) are ranked by id; eight consecutive nodes have a parent, up to one node, and the groups'
nodes make a tree of the same kind, whose top is the root.

*Ranks.* Leaves are ordered by ranges, so that each task holds a run of them; a running sum over the tasks' counts gives each run its
first rank. Equal leaves are told apart by where they were read, so that a leaf that is repeated often fills many ranges.

*Nodes* come from a ``combineByKey`` that is driven by what arrives. A partial parent (:class:`Open`) collects the digests of its children, each under its own
index. How many it waits for follows from the size of its group: eight, or what is left for the last one. The child that completes it makes its digest,
which is a child that arrives a level higher, and so on. A task combines its own leaves that way, and as they stand in order, all but the parents at the ends
of its run get complete. Those that don't are its frontier. It is shuffled by an ancestor ``STEP`` levels up, whose task combines it further, and what is still
open is shuffled again, ``STEP`` levels higher, until nothing is. Completed parents leave links: a parent with its children's digests.

*Proofs* follow the links back: from the top, ``BLOCK`` levels at a time, nodes meet the links of one ancestor and the path that leads from there
to the root. So a task holds the few hundred links and the leaves of one ancestor, whatever the size of the group.

Defined results: null values are hashed as ``-``; null groups come first and null ids first in a group, ids that are repeated by their leaf's hash; repeated rows are leaves
each, with proofs of their own; a row with a null id is never tampered with; a root without siblings has the hash of nothing as its proof; an
empty table gives an empty table; columns other than the five are not read. A proof names the other nodes of its runs alone, so its size follows the depth of both trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._store import bounded_batches, discard, materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
#: Levels that a round combines, levels of which a task has the links, partial parents that a task holds open before it hands them on.
STEP, BLOCK, OPEN = 7, 4, 100_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf(fields: list[Column]) -> Column:
    """The hash of these values: each ``-`` if null, else its number of bytes, a colon, and itself."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, grp (lang), leaf, tampered: hashes as bytes. ``tampered`` is the leaf of the row as it was changed, null if it wasn't."""
    columns = {c: F.col(c) for c in FIELDS}
    changed = columns | {"text": F.translate("text", _UPPER, _UPPER.lower())}
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    tampered = F.when(hit, F.unhex(leaf(list(changed.values()))))
    return docs.select("doc_id", F.col("lang").alias("grp"), F.unhex(leaf(list(columns.values()))).alias("leaf"), tampered.alias("tampered"))


def rank(items: DataFrame, order: list[str]) -> DataFrame:
    """``items`` (grp, ...) with ``pos``, the place of each in its group in this order, and ``n``, the group's size."""
    keyed = items.withColumn("_at", F.monotonically_increasing_id())
    ordered = [F.asc_nulls_first("grp"), *(F.asc_nulls_first(c) for c in order), F.asc("_at")]
    runs = keyed.repartitionByRange(*ordered).sortWithinPartitions(*ordered).drop("_at")
    # The number of a row: its partition in the high bits, its place there in the low ones.
    runs = materialize(runs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)))
    spans = runs.groupBy("grp", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("grp", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("grp")).alias("n"))
    # A row for each run of a group: as many as partitions and groups. Its size on disk decides how it is joined.
    spans = materialize(spans.select(F.col("grp").alias("_grp"), F.col("_part").alias("_of"), "_first", "_before", "n"))
    joined = runs.join(spans, (F.col("_part") == F.col("_of")) & F.col("grp").eqNullSafe(F.col("_grp")))
    ranked = materialize(joined.select(*items.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias("pos"), "n"))
    discard(runs, spans)
    return ranked


def parent_hash(digests: bytes) -> bytes:
    """The hash of a run of digests, which are joined as hexadecimal text."""
    return hashlib.sha256(digests.hex().encode()).digest()


class Open:
    """The partial parents of a task. ``add`` and ``merge`` are told of children; what gets complete is written to ``out`` at once."""

    def __init__(self, arity: int, top: int | None = None):
        self.arity, self.top = arity, top
        self.partial: dict[tuple, dict[int, bytes]] = {}
        self.out: list[tuple] = []

    def waits_for(self, n: int, level: int, parent: int) -> int:
        """Children of this node: ``level`` is its height, ``n`` the leaves of its group."""
        below = -(-n // self.arity ** (level - 1))
        return min(self.arity, below - parent * self.arity)

    def add(self, grp: str | None, n: int, level: int, index: int, digest: bytes) -> None:
        """A node has its digest: its parent gets it, and if that makes the parent complete, the parent's parent gets its digest."""
        while True:
            if -(-n // self.arity**level) == 1:
                self.out.append(("top", grp, n, level, index, None, digest))
                return
            parent, slot = divmod(index, self.arity)
            level += 1
            key = (grp, n, level, parent)
            children = self.partial.setdefault(key, {})
            children[slot] = digest
            if len(children) < self.waits_for(n, level, parent) or (self.top is not None and level > self.top):
                return
            del self.partial[key]
            run = b"".join(children[i] for i in range(len(children)))
            self.out.append(("link", grp, n, level, parent, None, run))
            index, digest = parent, parent_hash(run)

    def merge(self, grp: str | None, n: int, level: int, parent: int, slots: list[int], run: bytes) -> None:
        """The children that another task has collected for this parent."""
        for i, slot in enumerate(slots):
            self.add(grp, n, level - 1, parent * self.arity + slot, run[32 * i : 32 * i + 32])

    def flush(self) -> None:
        """Hand on what is not complete."""
        for (grp, n, level, parent), children in self.partial.items():
            slots = sorted(children)
            self.out.append(("open", grp, n, level, parent, slots, b"".join(children[s] for s in slots)))
        self.partial = {}

    def take(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        kind, grp, n, level, index, slots, run = zip(*rows, strict=True) if rows else ((),) * 7
        types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((kind, grp, n, level, index, slots, run), types, strict=True)], ["kind", "grp", "n", "level", "index", "slots", "run"])


NODE = "kind string, grp string, n long, level int, index long, slots array<int>, run binary"


def combine(ranked: DataFrame, arity: int = ARITY, step: int = STEP) -> DataFrame:
    """Nodes of the groups' trees above ``ranked`` (grp, n, pos, digest): a ``link`` (a parent with its children's digests) or a ``top`` each."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = Open(arity)
        for batch in batches:
            for grp, n, pos, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                opened.add(grp, n, 0, pos, digest)
            if len(opened.partial) > OPEN:
                opened.flush()
            yield opened.take()
        opened.flush()
        yield opened.take()

    def go_on(top: int):
        def run(group: pa.Table) -> pa.Table:
            opened = Open(arity, top)
            for r in group.to_pylist():
                opened.merge(r["grp"], r["n"], r["level"], r["index"], r["slots"], r["run"])
            opened.flush()
            return pa.Table.from_batches([opened.take()])

        return run

    found = materialize(ranked.select("grp", "n", "pos", "digest").mapInArrow(start, NODE))
    done, top = found.where("kind <> 'open'"), step
    frontier = found.where("kind = 'open'")
    while frontier.limit(1).count():
        # All partial parents below one ancestor of height ``top`` meet; higher ones by themselves.
        ancestor = F.expr(f"CASE WHEN level < {top} THEN index div CAST(power({arity}, {top} - level) AS LONG) ELSE index END")
        found = frontier.withColumn("_level", F.greatest("level", F.lit(top))).withColumn("_to", ancestor).groupBy("grp", "_level", "_to").applyInArrow(go_on(top), NODE)
        found = materialize(found)
        done = done.unionByName(found.where("kind <> 'open'"))
        frontier, top = found.where("kind = 'open'"), top + step
    return done


def climb(members: DataFrame, links: DataFrame, base: DataFrame, low: int, arity: int, block: int, schema: str, finish) -> DataFrame:
    """``finish`` of each member (grp, index, a payload of bytes columns) of height ``low`` with its path: the runs above it and its place in each, from the lowest on.

    ``base`` has the paths (grp, index, runs, slots) of the ancestors ``block`` levels up.
    """
    width = arity**block
    none = F.lit(None)
    own = members.select("grp", F.expr(f"index div {width}").alias("_to"), F.lit(0).alias("kind"), F.lit(low).alias("level"), "index", "doc_id", "leaf", "tampered", none.cast("binary").alias("run"), none.cast("array<binary>").alias("runs"), none.cast("array<int>").alias("slots"))
    near = links.where((F.col("level") > low) & (F.col("level") <= low + block))
    up = F.expr(f"index div CAST(power({arity}, {low + block} - level) AS LONG)")
    near = near.select("grp", up.alias("_to"), F.lit(1).alias("kind"), "level", "index", none.cast("long").alias("doc_id"), none.cast("binary").alias("leaf"), none.cast("binary").alias("tampered"), "run", none.cast("array<binary>").alias("runs"), none.cast("array<int>").alias("slots"))
    above = base.select("grp", F.col("index").alias("_to"), F.lit(2).alias("kind"), F.lit(low + block).alias("level"), "index", none.cast("long").alias("doc_id"), none.cast("binary").alias("leaf"), none.cast("binary").alias("tampered"), none.cast("binary").alias("run"), "runs", "slots")

    def run(group: pa.Table) -> pa.Table:
        kind = group["kind"].combine_chunks()
        part = lambda k: group.filter(pa.compute.equal(kind, k))
        mine = part(0)
        if not mine.num_rows:
            return pa.Table.from_batches([], schema=finish.schema)
        runs_of = {(r["level"], r["index"]): r["run"] for r in part(1).select(["level", "index", "run"]).to_pylist()}
        top = part(2).select(["runs", "slots"]).to_pylist()
        top_runs, top_slots = (top[0]["runs"], top[0]["slots"]) if top else ([], [])

        def path(index: int) -> tuple[list[bytes], list[int]]:
            runs, slots = [], []
            for level in range(low + 1, low + block + 1):
                index, slot = divmod(index, arity)
                if (found := runs_of.get((level, index))) is None:
                    break  # the top of a small tree
                runs.append(found)
                slots.append(slot)
            return runs + top_runs, slots + top_slots

        return finish.table(mine, path)

    return own.unionByName(near).unionByName(above).groupBy("grp", "_to").applyInArrow(run, schema)


class _Paths:
    """Keeps the paths themselves: for the heads of blocks."""

    schema = pa.schema([("grp", pa.string()), ("index", pa.int64()), ("runs", pa.list_(pa.binary())), ("slots", pa.list_(pa.int32()))])

    @classmethod
    def table(cls, mine: pa.Table, path) -> pa.Table:
        found = [path(i) for i in mine["index"].to_pylist()]
        return pa.table([mine["grp"], mine["index"], pa.array([r for r, _ in found], pa.list_(pa.binary())), pa.array([s for _, s in found], pa.list_(pa.int32()))], schema=cls.schema)


class _Proofs:
    """The hash of the siblings along a path, and the root that a leaf folds into."""

    schema = pa.schema([("grp", pa.string()), ("doc_id", pa.int64()), ("leaf", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])

    @classmethod
    def table(cls, mine: pa.Table, path) -> pa.Table:
        proofs, folded, text = [], [], {}  # a run is shown to all rows of it, so each is spelled out once
        for index, leaf_, tampered in zip(*(mine[c].to_pylist() for c in ("index", "leaf", "tampered")), strict=True):
            runs, slots = path(index)
            proof, node = hashlib.sha256(), (tampered or leaf_).hex()
            for run, slot in zip(runs, slots, strict=True):
                shown = text.get(run)
                if shown is None:
                    shown = text[run] = run.hex()
                left, right = shown[: 64 * slot], shown[64 * slot + 64 :]
                proof.update((left + right).encode())
                node = hashlib.sha256((left + node + right).encode()).hexdigest()
            proofs.append(proof.hexdigest())
            folded.append(node)
        return pa.table([mine["grp"], mine["doc_id"], pa.array([x.hex() for x in mine["leaf"].to_pylist()]), pa.array(proofs, pa.string()), pa.array(folded, pa.string())], schema=cls.schema)


def _ddl(schema: pa.Schema) -> str:
    names = {"string": "string", "int64": "long", "int32": "int", "list<item: binary>": "array<binary>", "list<item: int32>": "array<int>"}
    return ", ".join(f"{f.name} {names[str(f.type).replace('element', 'item')]}" for f in schema)


def along(ranked: DataFrame, links: DataFrame, base: DataFrame, deepest: int, arity: int, block: int, finish) -> DataFrame:
    """``finish`` of all leaves with their paths. ``base``: the path of each group's top (grp, runs, slots)."""
    steps = max(1, -(-deepest // block))
    # The blocks that each tree takes.
    taken = sum((F.when(F.col("n") > arity ** (block * k), 1).otherwise(0) for k in range(1, steps)), F.lit(1))
    tops = ranked.select("grp", "n").distinct().withColumn("_steps", taken)
    tops = materialize(tops.select("grp", "_steps").alias("t").join(base.alias("b"), F.col("t.grp").eqNullSafe(F.col("b.grp")), "left").select("t.grp", "_steps", F.coalesce("runs", F.array().cast("array<binary>")).alias("runs"), F.coalesce("slots", F.array().cast("array<int>")).alias("slots")))
    above = None
    for k in range(steps - 1, -1, -1):
        # Trees whose top lies within this block begin here.
        begin = tops.where(F.col("_steps") == k + 1).select("grp", F.lit(0).cast("long").alias("index"), "runs", "slots")
        paths = begin if above is None else above.unionByName(begin)
        low = block * k
        if k:
            none = F.lit(None)
            # The top of a tree that ends at this height is no head: its path begins a block below.
            heads = links.where((F.col("level") == low) & (F.col("n") > arity**low)).select("grp", "index", none.cast("long").alias("doc_id"), none.cast("binary").alias("leaf"), none.cast("binary").alias("tampered"))
            above = materialize(climb(heads, links, paths, low, arity, block, _ddl(_Paths.schema), _Paths))
        else:
            members = ranked.select("grp", F.col("pos").alias("index"), "doc_id", F.col("digest").alias("leaf"), "tampered")
            return climb(members, links, paths, low, arity, block, _ddl(finish.schema), finish)
    raise AssertionError("a tree has one step at least")


def _deepest(ranked: DataFrame, arity: int) -> int:
    most = ranked.agg(F.max("n").alias("n")).first()["n"] or 1
    depth = 0
    while most > 1:
        most, depth = -(-most // arity), depth + 1
    return depth


def manifest(docs: DataFrame, arity: int = ARITY, step: int = STEP, block: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs`` (doc_id, source, lang, n_chars, text)."""
    bounded_batches(docs.sparkSession)
    found = materialize(leaves(docs))
    ranked = rank(found.select("grp", "doc_id", F.col("leaf").alias("digest"), "tampered"), ["doc_id", "digest"])
    discard(found)
    nodes = combine(ranked, arity, step)
    links, tops = nodes.where("kind = 'link'"), nodes.where("kind = 'top'").select("grp", F.col("run").alias("digest"))

    # The groups' tops are the leaves of a tree of their own.
    of_tops = rank(tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"])
    upper = combine(of_tops, arity, step)
    numbered = of_tops.select("grp", "n", "pos", F.col("pos").alias("doc_id"), "digest", F.lit(None).cast("binary").alias("tampered"))
    nothing = of_tops.select("grp", F.array().cast("array<binary>").alias("runs"), F.array().cast("array<int>").alias("slots")).limit(1)
    upper_paths = along(numbered, upper.where("kind = 'link'"), nothing, _deepest(of_tops, arity), arity, block, _Paths)
    base = materialize(upper_paths.alias("p").join(of_tops.alias("t"), F.col("p.index") == F.col("t.pos")).select(F.col("t.name").alias("grp"), "p.runs", "p.slots", F.hex("t.digest").alias("subroot")))
    proofs = along(ranked, links, base.drop("subroot"), _deepest(ranked, arity), arity, block, _Proofs)

    root = upper.where("kind = 'top'").select(F.lower(F.hex("run")).alias("root"))
    # A row for each group, and one row.
    named = base.select(F.col("grp").alias("_grp"), F.lower("subroot").alias("subroot")).crossJoin(F.broadcast(root))
    out = proofs.join(named, F.col("grp").eqNullSafe(F.col("_grp")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _level_sql(name: str, key: str, levels: int) -> str:
    """Levels of a tree whose leaves are ``name``0 (key, i, h): ``name``K has the nodes of level K, ``name``rK the runs below it."""
    out = []
    for k in range(levels):
        out.append(f"{name}m{k} AS (SELECT *, count(*) OVER (PARTITION BY {key}) AS m FROM {name}{k})")
        out.append(f"{name}r{k} AS (SELECT {key}, i // 8 AS p, string_agg(h, '' ORDER BY i) AS run FROM {name}m{k} WHERE m > 1 GROUP BY {key}, i // 8)")
        out.append(f"{name}{k + 1} AS (SELECT {key}, i // 8 AS i, CASE WHEN max(m) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM {name}m{k} GROUP BY {key}, i // 8)")
    return ",\n".join(out)


def oracle_sql(levels: int = 6, top_levels: int = 2) -> str:
    """SQL for :func:`manifest` over up to 8 ** levels rows of a language and 8 ** top_levels languages."""
    hash_of = lambda text: "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
    )
    tampered = "translate(text, '" + _UPPER + "', '" + _UPPER.lower() + "')"
    joins, fold, proof = "", f"CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN t ELSE h END", []
    for name, key, at, count in (("v", "lang", "pos", levels), ("w", "one", "tpos", top_levels)):
        for k in range(count):
            on = "lang IS NOT DISTINCT FROM a.lang" if key == "lang" else "one = 1"
            joins += f" LEFT JOIN {name}r{k} ON {name}r{k}.{on} AND {name}r{k}.p = a.{at} // {8 ** (k + 1)}"
            run, slot = f"{name}r{k}.run", f"(a.{at} // {8**k} % 8)"
            left, right = f"substr({run}, 1, 64 * {slot})", f"substr({run}, 64 * {slot} + 65)"
            proof.append(f"coalesce({left} || {right}, '')")
            fold = f"CASE WHEN {run} IS NULL THEN {fold} ELSE sha256({left} || {fold} || {right}) END"
    return f"""WITH d AS (SELECT doc_id, lang, {hash_of("text")} AS h, {hash_of(tampered)} AS t FROM documents),
a0 AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM d),
v0 AS (SELECT lang, pos AS i, h FROM a0),
{_level_sql("v", "lang", levels)},
tops AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tpos FROM v{levels}),
w0 AS (SELECT 1 AS one, tpos AS i, subroot AS h FROM tops),
{_level_sql("w", "one", top_levels)},
a AS (SELECT a0.*, subroot, tpos FROM a0 JOIN tops ON tops.lang IS NOT DISTINCT FROM a0.lang),
f AS (SELECT doc_id, a.h AS leaf, subroot, sha256({" || ".join(proof)}) AS proof_sha256, {fold} AS folded_root FROM a{joins})
SELECT doc_id, leaf, subroot, (SELECT h FROM w{top_levels}) AS root, proof_sha256, folded_root, folded_root = (SELECT h FROM w{top_levels}) AS verified FROM f"""


ORACLE_SQL = oracle_sql()
