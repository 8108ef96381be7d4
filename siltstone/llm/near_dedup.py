"""Near-duplicate detection: chosen-path set similarity join over minwise tokens.

A text is the set of its distinct word shingles (64-bit hashes), of 4 words in the query, of 5 in ``deduplicate``; its
record holds ``TOKENS`` minwise tokens. Equal sets are collapsed first, so a record stands for any number of copies.
Each of ``TREES`` independent trees starts with all records in one node. The root hands each record on to two children:
the root's key draws two token places, and the record goes to the child named by (place, its token there). Larger nodes
below split faster: the key draws ``BRANCH`` pairs of places, and a child is named by the pair and both tokens there.
Records of Jaccard similarity s meet in a child of the root with probability s for each place, in a deeper one with s^2
for each pair. At s = 0.8 a tree keeps a pair together for ever with probability 0.93 or more, so four trees miss less
than 0.07 ** 4 = 2.4e-5 of the pairs that similar, and fewer of closer ones.

Nodes of at most ``LEAF`` records are compared exhaustively, on token agreement; what agrees in at least ``AGREE`` of
``TOKENS`` places is a candidate (a pair of similarity 0.8 falls below that with probability 2e-5), and every candidate
link is confirmed on the full sets: 100 * intersection >= 80 * union. Nodes of the same records are compared once. It
goes in two phases:

1. Each small node gives a spanning forest of its candidates, each large one a star from its smallest record. The
   confirmed links merge records into groups. A large family of near copies so costs links in proportion to its size.
2. Nodes whose records are all in one group are done. In other small ones all candidates from different groups are
   compared. Large ones branch on, but for those that hold more than half of their parent: their records are alike on
   the whole, would go on together, and are compared exhaustively, on full sets, in blocks. So is what is below
   ``BLOCK`` records or at ``DEPTH``. Records of the node's largest group are compared with those of other groups only,
   so a node of n records, all but r of them in one group, costs r * n comparisons, not n * n.

So every candidate pair is either confirmed or refuted on full sets, or lies within a group already. In large nodes,
records of at most ``WHOLE`` shingles are decided on their full sets at once, longer ones become candidates by their
tokens as in small nodes; the outcome of both ways is that of the full sets. Groups are joined in the cluster, in one
task where links are few, else by min-label propagation with pointer jumping; nothing but counts reaches the driver.

Defined results: null, empty or blank text has an empty set and is linked with nothing; fewer words than a shingle
has are one; null ids sort last (a group of null ids only has a null component_id); repeated rows are copies of one
another; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, drop, join_hot, mix, per_batch, raw_texts, table
from .exact_dedup import decide

SHINGLE, STAGE_SHINGLE = 4, 5  # words: the query's contract; the pipeline's stage
SIMILAR = 80  # per cent
TOKENS, BRANCH, TREES, LEAF, DEPTH = 64, 3, 4, 64, 4
ALONE = 1 << 15  # links that one task joins to groups at once; more are dealt out, round by round
BLOCK, WHOLE = 512, 4096  # records compared at once in a large node; shingles of a text that is decided there
AGREE = 36
_MULTIPLY = np.random.default_rng(20240607).integers(1, 1 << 63, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1)
_K = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(found: list[bytes], hashes: WordHash, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    w = hashes.of(found)
    if not len(w):
        return w
    with np.errstate(over="ignore"):
        size = min(width, len(w))
        out = np.full(len(w) - size + 1, size, np.uint64)
        for i in range(size):
            out = out * _K + w[i : len(w) - size + 1 + i]
        return np.unique(mix(out))


def tokens_of(shingles: np.ndarray) -> np.ndarray:
    """The minwise tokens of a non-empty set."""
    best = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 1024):
        np.minimum(best, np.multiply.outer(_MULTIPLY, shingles[start : start + 1024]).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _profile(width: int):
    hashes, pack = WordHash(), zstandard.ZstdCompressor(level=1)
    schema = pa.schema([("_row", pa.int64()), ("_doc", pa.int64()), ("n", pa.int64()), ("key", pa.string()), ("sig", pa.list_(pa.int32())), ("z", pa.binary())])

    def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, keys, sigs, packed = [], [], [], []
        for raw in raw_texts(batch.column("_text")):
            text = raw.lower()
            s = shingle_set(text.split(), hashes, width)
            n.append(len(s))
            keys.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
            sigs.append(tokens_of(s) if len(s) else None)
            packed.append(pack.compress(text))
        return pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_doc"), pa.array(n, pa.int64()), pa.array(keys, pa.string()), pa.array(sigs, pa.list_(pa.int32())), pa.array(packed, pa.binary())], schema=schema)

    return handle


def first_level(records: DataFrame) -> DataFrame:
    """(node, rec): the two children of each tree's root that a record goes to."""
    roots = records.select("rec", "sig", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(TREES).cast("long"))).alias("node"))
    places = F.transform(F.array(F.lit(0), F.lit(1)), lambda j: _place("node", j))
    return roots.select("rec", "sig", "node", F.explode(places).alias("_i")).select(F.xxhash64("node", "_i", F.get("sig", F.col("_i"))).alias("node"), "rec")


def _place(node: str, j: Column) -> Column:
    """The j-th token place that a node's key draws; TOKENS is a power of two and steps are odd, so places differ."""
    first, step = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(TOKENS)), F.pmod(F.xxhash64(node, F.lit(2)), F.lit(TOKENS // 2)) * 2 + 1
    return ((first + step * j) % TOKENS).cast("int")


def children(nodes: DataFrame) -> DataFrame:
    """The next level below large nodes: a child for each of ``BRANCH`` pairs of places. ``_n`` becomes the parent's ``_p``."""
    each = nodes.select("rec", "n", "sig", "grp", F.col("_n").alias("_p"), "node", F.explode(F.sequence(F.lit(0), F.lit(BRANCH - 1))).alias("_j"))
    token = lambda k: F.get("sig", _place("node", F.col("_j") * 2 + k))
    return each.select(F.xxhash64("node", "_j", token(0), token(1)).alias("node"), "rec", "n", "sig", "grp", "_p")


def _agree(a: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates i < j among the records of a node, and their agreement."""
    same = np.empty((len(a), len(a)), np.int16)
    for i in range(len(a)):
        same[i] = (a == a[i]).sum(axis=1)
    low, high = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    i, j = np.nonzero(np.triu((same >= AGREE) & (100 * low >= SIMILAR * high), 1))
    return i, j, same[i, j]


def _compare(forest: bool):
    """Candidates of each small node: a spanning forest of the closest, or all between different groups."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
        listed = batch.column("members")
        offsets = listed.offsets.to_numpy()
        inner = listed.values
        rec, size, group = (inner.field(k).to_numpy() for k in ("rec", "n", "grp"))
        flat = inner.field("sig")
        sig = flat.flatten().to_numpy().reshape(-1, TOKENS)
        out_a, out_b = [], []
        for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
            r, g = rec[lo:hi], group[lo:hi]
            i, j, same = _agree(sig[lo:hi], size[lo:hi])
            if forest and len(i):
                top = list(range(hi - lo))

                def find(x, top=top):
                    while top[x] != x:
                        top[x] = x = top[top[x]]
                    return x

                chosen = []
                for k in np.argsort(-same, kind="stable").tolist():
                    x, y = find(int(i[k])), find(int(j[k]))
                    if x != y:
                        top[x] = y
                        chosen.append(k)
                i, j = i[chosen], j[chosen]
            elif len(i):
                other = g[i] != g[j]
                i, j = i[other], j[other]
            out_a.append(np.minimum(r[i], r[j]))
            out_b.append(np.maximum(r[i], r[j]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a) if out_a else [], pa.int64()), pa.array(np.concatenate(out_b) if out_b else [], pa.int64())], schema=schema)

    return lambda: handle


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of sets: products of 0/1 matrices over the shingles that two sets or more hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(held > 1) - 1
    shared = held[column] > 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int((held > 1).sum()), columns):
        lo, hi = np.searchsorted(column, [start, start + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        both += part @ part.T
    return both


def _settle(width: int):
    """Links between the groups of a large node.

    Pairs whose texts are both at hand are decided on full sets, and of the links just enough are put out to join the
    groups that they join: they grow with the groups, not with pairs. Other candidates are all put out.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    hashes, unpack = WordHash(), zstandard.ZstdDecompressor()

    def node(members: pa.StructArray, out: list[tuple[int, int]]) -> None:
        rec, size = members.field("rec").to_numpy(), members.field("n").to_numpy()
        names, group = np.unique(members.field("grp").to_numpy(), return_inverse=True)
        z = members.field("z")
        has = np.array(z.is_valid().to_pylist())
        if not has.all():
            i, j, _ = _agree(members.field("sig").flatten().to_numpy().reshape(-1, TOKENS), size)
            open_ = (group[i] != group[j]) & ~(has[i] & has[j])
            out += zip(np.minimum(rec[i], rec[j])[open_].tolist(), np.maximum(rec[i], rec[j])[open_].tolist(), strict=True)
        k = np.nonzero(has)[0]
        if len(k) < 2:
            return
        both, n = overlaps([shingle_set(unpack.decompress(z[int(x)].as_py()).split(), hashes, width) for x in k]), size[k].astype(np.float32)
        alike = np.triu((100 + SIMILAR) * both >= SIMILAR * np.add.outer(n, n), 1) & (group[k][:, None] != group[k])
        i, j = (k[x] for x in np.nonzero(alike))
        _, first = np.unique(np.minimum(group[i], group[j]) * len(names) + np.maximum(group[i], group[j]), return_index=True)
        top = list(range(len(names)))

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True):
            g, h = find(int(group[x])), find(int(group[y]))
            if g != h:
                top[g] = h
                out.append((int(min(rec[x], rec[y])), int(max(rec[x], rec[y]))))

    def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[int, int]] = []
        for k in range(batch.num_rows):
            members = batch.column("members")[k].values
            _, once = np.unique(members.field("rec").to_numpy(), return_index=True)  # a record may stand on both sides of a block
            node(members.take(pa.array(once)), out)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=schema)

    return handle


def _confirm(width: int):
    """Keeps the pairs whose full sets are similar enough."""
    hashes, unpack = WordHash(), zstandard.ZstdDecompressor()
    kept: OrderedDict[int, np.ndarray] = OrderedDict()
    held = 0

    def forget(rec: int | None = None) -> None:
        nonlocal held
        held -= len(kept.pop(rec) if rec is not None else kept.popitem(last=False)[1])

    def full(rec: int, z: pa.Scalar) -> np.ndarray:
        nonlocal held
        if rec not in kept:
            kept[rec] = shingle_set(unpack.decompress(z.as_py()).split(), hashes, width)
            held += len(kept[rec])
            while len(kept) > 1 and held > 1_000_000:  # 8 MB
                forget()
        return kept[rec]

    def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        za, zb = batch.column("za"), batch.column("zb")
        good = []
        for k in range(len(a)):
            x = full(a[k], za[k])
            y = full(b[k], zb[k])
            if b[k] != a[k] and b[k] in kept:
                forget(b[k])
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return handle


def confirm(pairs: DataFrame, texts: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) of records that are similar on their full sets; ``texts`` has rec, n and packed text z."""
    pairs = table(pairs.where("a != b").distinct(), "pairs")
    if pairs.isEmpty():
        return pairs
    full = pairs.join(texts.select(F.col("rec").alias("b"), F.col("z").alias("zb")), "b").join(texts.select(F.col("rec").alias("a"), F.col("z").alias("za")), "a")
    good = table(per_batch(full.select("a", "b", "za", "zb"), lambda: _confirm(width), "a long, b long", 64), "good")
    drop(pairs)
    return good


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``components`` of the links in all batches, by union-find."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    recs = list(top)
    yield pa.RecordBatch.from_arrays([pa.array(recs, pa.int64()), pa.array([find(x) for x in recs], pa.int64())], names=["rec", "grp"])


def components(edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """(rec, grp): the smallest record reachable, for each record with an edge. Hubs and labels of many records stay on the map side.

    At most ``alone`` edges are joined in one task: rounds of joins would cost the driver dozens of jobs and broadcasts for
    them. Else each round is written and read again: estimates of a checkpointed frame's size would multiply from round to
    round.
    """
    edges = table(edges.select("a", "b"), "links")
    if edges.count() <= alone:
        labels = table(edges.coalesce(1).mapInArrow(_join_up, "rec long, grp long"), "labels")
        drop(edges)
        return labels
    both = table(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    drop(edges)
    labels = table(both.groupBy(F.col("a").alias("rec")).agg(F.least(F.min("b"), F.first("a")).alias("grp")), "labels")
    while True:
        near = join_hot(both, labels.withColumnRenamed("rec", "b"), "b").groupBy(F.col("a").alias("rec")).agg(F.min("grp").alias("_near"))
        moved = table(labels.join(near, "rec").select("rec", F.least("grp", "_near").alias("grp"), F.col("grp").alias("_was")), "moved")
        jump = moved.select(F.col("rec").alias("grp"), F.col("grp").alias("_next"))
        after = table(join_hot(moved, jump, "grp").select("rec", F.least("grp", "_next").alias("grp"), (F.least("grp", "_next") != F.col("_was")).alias("_new")), "labels")
        drop(labels)
        drop(moved)
        labels = after
        if after.where("_new").isEmpty():
            drop(both)
            return labels.select("rec", "grp")


def _members(rows: DataFrame, key: list[str], *more: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.collect_list(F.struct("rec", "n", "grp", "sig", *more)).alias("members")).select("members")


_SAME = ["_n", "_pivot", "_x", "_y"]


def _contents() -> list[Column]:
    """Of a node: size, smallest record, and two 64-bit hashes of its set of records."""
    return [F.count("*").alias("_n"), F.min("rec").alias("_pivot"), *[F.bit_xor(F.xxhash64("rec", F.lit(k))).alias(c) for k, c in ((1, "_x"), (2, "_y"))]]


def _once(nodes: DataFrame, spare: Column) -> DataFrame:
    """One node of those with the same records, where ``spare`` says that one will do."""
    return nodes.where(spare).groupBy(*_SAME).agg(F.min(F.struct(*[c for c in nodes.columns if c not in _SAME])).alias("_v")).select(*_SAME, "_v.*").unionByName(nodes.where(~spare))


def mixed_nodes(rows: DataFrame, depth: int) -> DataFrame:
    """The rows of nodes that hold records of different groups, with the node's size ``_n``, its largest group ``_main``
    and that one's size ``_m``, and whether it is to be compared (``_tight``, always so for small ones) or to branch on."""
    part = rows.groupBy("node", "grp", "_p").agg(F.count("*").alias("_c"), F.min("rec").alias("_a"), *_contents()[2:])
    each = part.groupBy("node", "_p").agg(F.sum("_c").alias("_n"), F.min("_a").alias("_pivot"), F.bit_xor("_x").alias("_x"), F.bit_xor("_y").alias("_y"), F.max_by("grp", F.struct("_c", "grp")).alias("_main"), F.max("_c").alias("_m"))
    tight = (F.col("_n") <= BLOCK) | (2 * F.col("_n") > F.col("_p")) | F.lit(depth == DEPTH)
    each = table(_once(each.where("_m < _n").withColumn("_tight", tight), F.col("_tight")).select("node", "_n", "_main", "_m", "_tight"), "sizes")
    return table(rows.drop("_p").join(each, "node"), "mixed")


def blocks_of(rows: DataFrame) -> DataFrame:
    """Rows of large tight nodes dealt out to blocks (``_i``, ``_j``): in those, every record outside of the main group
    meets every record of the node."""
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    rare, all_ = parts(F.col("_n") - F.col("_m")), parts(F.col("_n"))
    i, j = F.pmod(F.xxhash64("rec", F.lit(3)), rare).cast("int"), F.pmod(F.xxhash64("rec", F.lit(4)), all_).cast("int")
    span = lambda n: F.sequence(F.lit(0), n - 1)
    right = F.transform(span(rare), lambda k: F.struct(k.alias("_i"), j.alias("_j")))
    left = F.transform(span(all_), lambda k: F.struct(i.alias("_i"), k.alias("_j")))
    at = F.when(F.col("grp") == F.col("_main"), right).otherwise(F.array_union(left, right))
    return rows.withColumn("_at", F.explode(at)).select("node", "_at.*", "rec", "n", "grp", "sig")


def linked(records: DataFrame, texts: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(rec, grp) of all records that are linked with another. ``records``: rec, n, sig of distinct sets."""
    level = table(first_level(records), "level")
    sizes = table(_once(level.groupBy("node").agg(*_contents()).where("_n > 1"), F.col("_n") <= LEAF).select("node", "_n", "_pivot"), "sizes")
    nodes = table(level.join(sizes, "node").join(records, "rec"), "nodes")
    drop(level)
    # texts are dealt out once, at every size by a merge join, those of records that share a node; all later joins take
    # the few that are left
    texts = table(texts.join(nodes.select("rec").distinct().hint("merge"), "rec", "left_semi"), "texts")
    small = _members(nodes.where(F.col("_n") <= LEAF).withColumn("grp", F.lit(0).cast("long")), ["node"])
    pivots = nodes.where((F.col("_n") > LEAF) & (F.col("rec") == F.col("_pivot"))).select("node", F.col("n").alias("_na"), F.col("sig").alias("_sa"))
    stars = nodes.where((F.col("_n") > LEAF) & (F.col("rec") != F.col("_pivot"))).join(pivots, "node")
    agree = F.size(F.filter(F.zip_with("_sa", "sig", lambda x, y: x == y), lambda x: x))
    stars = stars.where((100 * F.least("_na", "n") >= SIMILAR * F.greatest("_na", "n")) & (agree >= AGREE)).select(F.col("_pivot").alias("a"), F.col("rec").alias("b"))
    first = confirm(per_batch(small, _compare(True), "a long, b long", 128).union(stars), texts, width)
    groups = components(first)

    pairs, large, used = None, None, [nodes, texts]
    rows = nodes.drop("_n", "_pivot").join(groups, "rec", "left").withColumn("grp", F.coalesce("grp", "rec")).withColumn("_p", F.lit(1 << 62))
    for depth in range(1, DEPTH + 1):
        mixed = mixed_nodes(rows, depth)
        used.append(mixed)
        found = per_batch(_members(mixed.where(F.col("_n") <= LEAF), ["node"]), _compare(False), "a long, b long", 128)
        cut = blocks_of(mixed.where((F.col("_n") > LEAF) & F.col("_tight")))
        pairs, large = (found, cut) if pairs is None else (pairs.union(found), large.union(cut))
        loose = mixed.where(~F.col("_tight"))
        if loose.isEmpty():
            break
        rows = children(loose)
    large = table(large, "large")
    used.append(large)
    if not large.isEmpty():
        whole = large.join(texts.where(F.col("n") <= WHOLE).select("rec", "z"), "rec", "left")
        pairs = pairs.union(per_batch(_members(whole, ["node", "_i", "_j"], "z"), lambda: _settle(width), "a long, b long", 4))
    again = confirm(pairs, texts, width)
    for written in used:
        drop(written)
    if again.isEmpty():
        return groups
    merged = join_hot(again, groups.select(F.col("rec").alias("a"), F.col("grp").alias("_ga")), "a", "left")
    merged = join_hot(table(merged, "merged"), groups.select(F.col("rec").alias("b"), F.col("grp").alias("_gb")), "b", "left")
    merged = components(merged.select(F.coalesce("_ga", "a").alias("a"), F.coalesce("_gb", "b").alias("b")).where("a != b"))
    joined = join_hot(groups, merged.select(F.col("rec").alias("grp"), F.col("grp").alias("_top")), "grp", "left").select("rec", F.coalesce("_top", "grp").alias("grp"))
    return table(joined.union(merged.join(groups, "rec", "left_anti")), "groups")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, width: int = SHINGLE) -> DataFrame:
    """One row per input row: row, doc_id, n_shingles, component_id, stays (true for exactly one row of a component).

    ``row_col`` names a unique long column; without it rows are numbered as they are read.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = table(per_batch(df.select(row.alias("_row"), F.col(id_col).cast("long").alias("_doc"), F.col(text_col).cast("string").alias("_text")), lambda: _profile(width), "_row long, _doc long, n long, key string, sig array<int>, z binary", 64), "profile")
    done = table(decide(rows.where("key is not null").select("_row", "_doc", "n", "key"), "key", "_doc", "_row").select("_row", "_doc", "n", "_keep"), "decided")
    chief = done.where("_row = _keep._row").select(F.col("_row").alias("rec"), F.struct(F.col("_keep._none").alias("_none"), F.col("_keep._id").alias("_id"), F.col("_row").alias("_row")).alias("_first"))
    records = table(rows.where("key is not null").select(F.col("_row").alias("rec"), "n", "sig").join(chief.select("rec"), "rec", "left_semi"), "records")
    groups = linked(records, rows.select(F.col("_row").alias("rec"), "n", "z"), width)
    drop(records)
    tops = groups.join(chief, "rec").groupBy("grp").agg(F.min("_first").alias("_top"))
    tops = table(join_hot(groups, table(tops, "tops"), "grp").select(F.col("rec").alias("_rec"), "_top"), "tops")
    full = join_hot(done.withColumn("_rec", F.col("_keep._row")), tops, "_rec", "left")
    own = F.struct(F.col("_keep._none").alias("_none"), F.col("_keep._id").alias("_id"), F.col("_keep._row").alias("_row"))
    full = full.withColumn("_top", F.coalesce("_top", own))
    linked_rows = full.select(F.col("_row").alias("row"), F.col("_doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("_top._id").alias("component_id"), (F.col("_row") == F.col("_top._row")).alias("stays"))
    bare = rows.where("key is null").select(F.col("_row").alias("row"), F.col("_doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("_doc").alias("component_id"), F.lit(True).alias("stays"))
    return linked_rows.union(bare)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = STAGE_SHINGLE) -> DataFrame:
    """The records of ``df``, all columns, of which exactly one of each component stays: that of the smallest id."""
    names = df.columns
    rows = table(df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("rec"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")).select("row", "doc", "rec"), "whole")
    gone = near_duplicates(rows.select("row", "doc", F.col("rec").getField(text_col).alias("text")), "doc", "text", "row", width).where("not stays").select("row")
    return rows.join(gone, "row", "left_anti").select("rec.*")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=SHINGLE)
    return done.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
