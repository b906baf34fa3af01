"""Near-duplicate documents by an inverted join over MinHash coordinates.

1. A document's set is its distinct word shingles, hashed to 64 bits. Documents with
   equal sets are one node from here on.
2. A node has ``COORDINATES`` MinHash values and is posted under each coordinate-value pair.
   Two nodes of similarity s collide in a binomial number of coordinates with mean
   COORDINATES * s; pairs with at least ``MATCHES`` collisions are candidates. At s = 0.75 the mean
   is 36 of 48, and fewer than 19 happen for 4 in 10^8 pairs.
3. Counting with prefix and skip: postings that hold one node can't collide and go
   first. A node with m postings left joins only under its m - MATCHES + 1 rarest ones: any pair with enough
   collisions meets there, in the order by (length, key) that all nodes share. The longest
   lists, such as those of a passage in a third of all documents, are skipped; their
   collisions only count for pairs that meet elsewhere. In a block of nodes that meet, every list, skipped or not, is a bitmap
   over the block, and a node's counts are the sum of the bitmaps of its lists.
4. Candidates must also agree in ``SKETCH_MATCHES`` of ``SKETCH`` coordinates (the first ones among them), of which a node
   keeps a byte each (at 0.75, fewer agree for 7 in 10^8 pairs), and are then confirmed on the full sets.
5. Groups of thousands of copies must not give all their pairs. So first every node is
   compared with one pivot of a list; what that joins into one component needs no more
   pairs. When that has done what it can, the nodes of different components that meet in a list
   are compared there, in blocks, and only pairs that pass 2 and 4 come out, each from
   the rarest list that they share. So no link that matters for the components is lost. A list too long for that is
   first split by the next list that a pair has in common.

Sets travel by the node to the blocks in which they are compared, never with a pair. No list, group or partner
count is capped. Tables between steps are written to the shared folder; components are found by star
contractions on DataFrames. Nodes have numbers of their own; links and components are of document ids, where an
id with several texts is linked with the smallest id of each of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, documents, forget, materialize, slices

COORDINATES = 48
MATCHES = 19
SHINGLE = 5
SKETCH = 256
SKETCH_MATCHES = 154
#: Pivot rounds end when a round leaves more than this share of the pairs it found.
ROUND_LEAVES = 0.7
MAX_ROUNDS = 6
#: Rows of a list that one task compares with as many others, and shingles in the sets of a block, about.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
#: Lists of more nodes are split by the next list in common.
SPLIT = 1 << 14

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_rng = np.random.default_rng(20240501)
_FACTORS = _rng.integers(1, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
_TAGS = _rng.integers(1, 1 << 63, SKETCH, np.uint64)
_WORDS = _rng.integers(1, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 256


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, memo: Memo) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    Words are runs of bytes other than space and 09-0D, with A-Z in lower case. A text of
    fewer words than a shingle has its whole sequence as one; a text without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words) + 1)] if words else [], np.uint64)
    ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    m = len(ids) - SHINGLE + 1
    out = ids[:m] * _WORDS[0]
    for k in range(1, SHINGLE):
        out = mix(out) + ids[k : k + m] * _WORDS[k]
    return np.unique(mix(out))


def signature(found: np.ndarray) -> tuple[bytes, bytes]:
    """A 64-bit coordinate-value key for each of the first coordinates, and a byte for each of all."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), _CHUNK):
        part = found[start : start + _CHUNK]
        np.minimum(least, (part[None, :] * _FACTORS[:, None]).min(1), out=least)
    keys = mix(least + _TAGS)
    return keys[:COORDINATES].tobytes(), keys.astype(np.uint8).tobytes()


def _word_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, 300_000)


def _sign(batches):
    forget()
    memo = _word_memo()
    for batch in batches:
        for part in slices(batch, 1):
            n, prints, keys, sketches = [], [], [], []
            for text in part.column(1).to_pylist():
                found = shingles(text, memo)
                own = signature(found) if len(found) else (b"", b"")
                n.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                keys.append(own[0])
                sketches.append(own[1])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (prints, keys, sketches))], ["doc_id", "n_shingles", "print", "keys", "sketch"])


def _post(batches):
    for batch in batches:
        sigs = batch.column(1).to_pylist()
        keys = np.frombuffer(b"".join(sigs), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), COORDINATES)), pa.array(keys)], ["node", "key"])


def _sets(batches):
    """The sets of the rows whose print is the one wanted, from (text, print, node, id); a node once a batch."""
    memo = _word_memo()
    for batch in batches:
        for part in slices(batch, 0):
            known, out = set(), []
            for text, wanted, node, own in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if node not in known:
                    found = shingles(text, memo).tobytes()
                    if xxhash.xxh3_128_digest(found) == wanted:  # an id may have other texts
                        known.add(node)
                        out.append((node, own, found))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["node", "id", "set"])


def _members(batches):
    """Per node: its keys cut to 32 bits, and each coordinate's rank in the node's order of lists (255: in none)."""
    for batch in batches:
        ranks, keys = [], []
        for own, lists in zip(batch.column("keys").to_pylist(), batch.column("lists").to_pylist(), strict=True):
            own, place = np.frombuffer(own, np.int64), {k: i for i, k in enumerate(lists)}
            ranks.append(np.array([place.get(k, 255) for k in own.tolist()], np.uint8).tobytes())
            keys.append(own.astype(np.uint32).tobytes())
        names = ["node", "id", "print", "lists", "size", "sketch"]
        rest = [batch.column(c) for c in names]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(keys, pa.binary()), pa.array(ranks, pa.binary())], [*names, "keys", "ranks"])


def _rows(column, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _agree(batches):
    """Pairs with enough collisions whose sketches agree enough. Both are counted from a byte a coordinate, which can only add candidates."""
    for batch in batches:
        if batch.num_rows:
            same = _rows(batch.column("sketch_a"), np.uint8, SKETCH) == _rows(batch.column("sketch_b"), np.uint8, SKETCH)
            good = (same[:, :COORDINATES].sum(1) >= MATCHES) & (same.sum(1) >= SKETCH_MATCHES)
            yield batch.select(["a", "b", "size"]).filter(pa.array(good))


def collisions(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How often each row of keys of ``first`` collides with each of ``second``: the bitmaps of its lists over ``second``, added up."""
    counts = np.zeros((len(first), len(second)), np.uint8)
    for c in range(COORDINATES):
        counts += first[:, c, None] == second[None, :, c]
    return counts


def _meet(table: pa.Table) -> pa.Table:
    """Pairs of a block of a list with another block of it that are candidates and meet in this list first: one row, if any."""
    node, root, size, block = (np.asarray(table.column(c)) for c in ("node", "root", "size", "block"))
    lo, hi = (table.column(c)[0].as_py() for c in ("lo", "hi"))
    first, second = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    pairs = np.empty((0, 2), np.int64)
    if len(first) and len(second) and (root[first].min() != root[second].max() or root[first].max() != root[second].min()):
        keys, ranks, sketch = _rows(table.column("keys"), np.uint32, COORDINATES), _rows(table.column("ranks"), np.uint8, COORDINATES), _rows(table.column("sketch"), np.uint8, SKETCH)
        here = [int((keys == np.uint32(table.column(c)[0].as_py() & 0xFFFFFFFF)).all(0).argmax()) for c in ("key", "next")]
        use = collisions(keys[first], keys[second]) >= MATCHES
        use &= root[first][:, None] != root[second]
        use &= (4 * size[first][:, None] >= 3 * size[second]) & (4 * size[second] >= 3 * size[first][:, None])
        if lo == hi:
            use &= node[first][:, None] < node[second]
        i, j = np.nonzero(use)
        i, j = first[i], second[j]
        kept = [np.empty(0, bool)]
        for a in range(0, len(i), 1 << 14):
            x, y = i[a : a + (1 << 14)], j[a : a + (1 << 14)]
            rank = np.sort(np.where(keys[x] == keys[y], ranks[x], 255), 1)
            good = rank[:, 0] == ranks[x, here[0]]
            if here[1] != here[0]:
                good &= rank[:, 1] == ranks[x, here[1]]
            kept.append(good & ((sketch[x] == sketch[y]).sum(1) >= SKETCH_MATCHES))
        good = np.concatenate(kept)
        pairs = np.stack([node[i[good]], node[j[good]]], 1)
    some = [0] * (len(pairs) > 0)
    own = {c: table.column(c).take(pa.array(some, pa.int64())) for c in ("key", "next", "lo", "hi")}
    return pa.table(own | {"nodes": pa.array([np.unique(pairs)] * len(some), pa.list_(pa.int64())), "pairs": pa.array([pairs.tobytes()] * len(some), pa.binary())})


def _links(out: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([min(x) for x in out], pa.int64()), "b": pa.array([max(x) for x in out], pa.int64())})


def _verify(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of a block's candidate pairs (left), those that are links by the sets of its nodes (right), as ids."""
    sets = {node: (own, np.frombuffer(x, np.uint64)) for node, own, x in zip(*(right.column(c).to_pylist() for c in ("node", "id", "set")), strict=True)}
    return _links([(sets[a][0], sets[b][0]) for row in left.column("pairs").to_pylist() for a, b in np.frombuffer(row, np.int64).reshape(-1, 2).tolist() if similar(sets[a][1], sets[b][1])])


def _verify_pivot(table: pa.Table) -> pa.Table:
    """Of the nodes of a block of a pivot's candidates, those that are linked with it, as ids."""
    nodes, ids = (table.column(c).to_pylist() for c in ("node", "id"))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
    pivot = nodes.index(table.column("pivot")[0].as_py())
    return _links([(own, ids[pivot]) for k, (own, x) in enumerate(zip(ids, sets, strict=True)) if k != pivot and similar(x, sets[pivot])])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, as sorted arrays, have a similarity of 0.75 or more."""
    if 4 * min(len(x), len(y)) < 3 * max(len(x), len(y)):
        return False
    both = np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y)
    return bool(100 * both >= 75 * (len(x) + len(y) - both))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for nodes of edges (a, b) that aren't the smallest of their component.

    Alternating star contractions: each node's larger neighbours move to the smallest
    node it knows, until all edges lead to a root. Minima are combined before the
    shuffle and a hub's edges are only joined, so no neighbourhood is gathered.
    """
    edges = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(edges)
    while before[0]:
        known = edges.union(edges.select("v", "u")).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = edges.join(known, "v").select("u", F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _of_roots(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Links (a, b) of ids as links of their roots."""
    if roots is not None:
        for side in "ab":
            links = links.join(roots.select(F.col("node").alias(side), F.col("root").alias("r")), side, "left").withColumn(side, F.coalesce("r", side)).drop("r")
    return links


def _moved(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The roots after the links."""
    moved = components(links)
    if roots is None:
        return moved
    again = moved.select(F.col("node").alias("root"), F.col("root").alias("r"))
    return materialize(roots.join(again, "root", "left").select("node", F.coalesce("r", "root").alias("root")).union(moved), "roots")


def _pivot_links(pairs: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of ids of those pairs (a node, its pivot b) that are similar."""
    for side in "ab":
        pairs = pairs.join(members.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}"), *([F.col("size")] if side == "a" else [])), side)
    found = materialize(pairs.mapInArrow(_agree, "a long, b long, size long"), "candidates")
    # a pivot may have candidates without number: they are dealt to blocks, each of which gets the pivot's set once
    blocks = found.groupBy("b").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    dealt = found.join(blocks, "b").select(F.col("b").alias("pivot"), F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"), "a")
    needed = dealt.select("pivot", "block", F.col("a").alias("node")).union(dealt.select("pivot", "block", F.col("pivot").alias("node")).distinct())
    return needed.join(sets, "node").groupBy("pivot", "block").applyInArrow(_verify_pivot, "a long, b long")


def link_components(postings: DataFrame, members: DataFrame, sets: DataFrame, roots: DataFrame | None = None) -> DataFrame | None:
    """(node, root) of all ids in a component of several, but for the roots; from what ``roots`` has joined on.

    postings: (node, id, key); members: (node, size, sketch, keys, ranks); sets: (node, id, set).
    """
    before = None
    for turn in range(MAX_ROUNDS + 1):
        if roots is None:
            labelled = postings.withColumn("root", F.col("id"))
        else:
            labelled = materialize(postings.join(roots.withColumnRenamed("node", "id"), "id", "left").select("node", "id", "key", F.coalesce("root", "id").alias("root")), "labelled")
        by_root = labelled.groupBy("key", "root").agg(F.count("*").alias("n"))
        open_lists = by_root.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same")).where("n * n > same").select("key", "n", ((F.col("n") * F.col("n") - F.col("same")) / 2).alias("pairs"))
        if turn:
            left = open_lists.agg(F.sum("pairs")).first()[0] or 0
            if not left:
                return roots
            if turn == MAX_ROUNDS or before is not None and left > ROUND_LEAVES * before:
                break
            before = left
        order = F.xxhash64("node", "key", F.lit(turn)) if turn else F.col("id")
        pivots = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(order.alias("o"), F.col("node").alias("p"), F.col("root").alias("q"))).alias("s")).select("key", "n", "s.p", "s.q")
        rank = F.xxhash64("key", F.lit(turn)) if turn else F.col("n")  # one list a node: the longest first, then any
        chosen = labelled.join(pivots, "key").where("root != q").groupBy("node").agg(F.max(F.struct(rank.alias("o"), F.col("p"))).alias("s"))
        pairs = chosen.select(F.col("node").alias("a"), F.col("s.p").alias("b"))
        roots = _moved(roots, _of_roots(_pivot_links(pairs, members, sets), roots))
    found = _candidates_of_blocks(labelled, open_lists, members)
    # a node's set goes once to a block, not once to a pair
    block = ["key", "next", "lo", "hi"]
    needed = found.select(*[F.col(c).alias(f"_{c}") for c in block], F.explode("nodes").alias("node")).join(sets, "node")
    links = found.groupBy(*block).cogroup(needed.groupBy(*[f"_{c}" for c in block])).applyInArrow(_verify, "a long, b long")
    return _moved(roots, _of_roots(links, roots))


def _candidates_of_blocks(labelled: DataFrame, open_lists: DataFrame, members: DataFrame) -> DataFrame:
    """(key, next, lo, hi, nodes, pairs): candidate pairs of different components, by the blocks of the list in which they meet first.

    Lists of more than ``SPLIT`` nodes are split by ``next``, the list in which a pair meets second; of others it is the list itself.
    """
    own = labelled.join(open_lists.select("key", "n"), "key").select("key", "n", "node", "root")
    few = own.where(f"n <= {SPLIT}").select("key", F.col("key").alias("next"), "node", "root")
    at = F.array_position("lists", F.col("key")).cast("int")
    after = F.slice("lists", at + 1, F.size("lists") - MATCHES + 2 - at)
    many = own.where(f"n > {SPLIT}").join(members.select("node", "lists"), "node").select("key", F.explode(after).alias("next"), "node", "root")
    posted = few.union(many)
    size = posted.join(members.select("node", "size"), "node").groupBy("key", "next")
    blocks = size.agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("long").alias("blocks")).where("n > 1")
    dealt = posted.join(blocks, ["key", "next"]).withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks"))).join(members, "node")
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    dealt = dealt.select("key", "next", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "root", "size", "keys", "ranks", "sketch")
    return materialize(dealt.groupBy("key", "next", "lo", "hi").applyInArrow(_meet, "key long, next long, lo long, hi long, nodes array<long>, pairs binary"), "candidates")


def _sets_of(rows: DataFrame, members: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """(node, id, set) of the members, from a text that has the node's print."""
    wanted = members.select("print", "node", "id")
    sets = materialize(rows.join(wanted, rows["doc_id"] == wanted["id"]).select("text", "print", "node", "id").mapInArrow(_sets, "node long, id long, set binary"), "sets")
    if repeated is None:
        return sets
    ids = repeated.select(F.col("doc_id").alias("id"))
    again = sets.join(ids, "id", "left_semi").groupBy("node", "id").agg(F.first("set").alias("set"))
    return materialize(sets.join(ids, "id", "left_anti").select("node", "id", "set").union(again), "sets")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row with a non-null id.

    ``component_id`` is the smallest id reachable over links of similarity 0.75 or
    more; texts without words link with nothing. Rows that repeat an id are one
    document for the links of all their texts, and get one component.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    signed = materialize(rows.mapInArrow(_sign, "doc_id long, n_shingles long, print binary, keys binary, sketch binary"), "signed")
    full = signed.where("n_shingles > 0")
    nodes = full.groupBy("print", "n_shingles", "keys", "sketch").agg(F.min("doc_id").alias("id")).withColumnRenamed("n_shingles", "size")
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    posted = nodes.select("node", "keys").mapInArrow(_post, "node long, key long")
    lengths = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    own = posted.join(lengths, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("lists"))  # COORDINATES at most
    enough = own.where(F.size("lists") >= MATCHES).select("node", F.col("lists.key").alias("lists"))
    schema = "node long, id long, print binary, lists array<long>, size long, sketch binary, keys binary, ranks binary"
    members = materialize(enough.join(nodes, "node").mapInArrow(_members, schema), "members")
    postings = members.select("node", "id", F.explode(F.expr(f"slice(lists, 1, size(lists) - {MATCHES} + 1)")).alias("key"))
    # ids of several rows: linked with the smallest id of each of their texts
    repeated, roots = materialize(signed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated"), None
    if repeated.isEmpty():
        repeated = None
    else:
        roots = _moved(None, full.select("doc_id", "print").join(repeated, "doc_id").join(nodes.select("print", "id"), "print").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    # every round joins the sets, so they are kept in their partitions; a lost one comes again from the table
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = _sets_of(rows, members, repeated).repartition(parts, "node").persist(StorageLevel.DISK_ONLY)
    roots = link_components(postings, members, sets, roots)
    sets.unpersist()
    named = nodes.select("print", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("print", F.coalesce("root", "id").alias("component_id"))
    linked = full.join(named, "print").select("doc_id", "n_shingles", "component_id")
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles")
    empty = empty.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
    return linked.union(empty).select("*", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component."""
    kept = near_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs[id_col] == kept["__kept_id"], "left_semi")


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
), bag AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS s FROM word
), item AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM bag
), pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM item x JOIN item y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (
  SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a
), least_id AS (
  SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept FROM bag LEFT JOIN least_id USING (doc_id)
"""
