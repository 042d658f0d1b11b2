"""N-gram Jaccard join by chosen paths.

A document is the set of its word shingles (``k`` words; a text of fewer words is
one shingle, a text without words is its own shingle).  In every run a node of
the recursion samples tokens by a hash of (node, token), each token of a set of n
with chance 1 / (threshold * n), and the sets that share a sampled token meet in
its child node.  Two sets of Jaccard similarity ``threshold`` or more are expected
to share at least one child.  The sampling needs the set alone, so each document
writes down its paths to ``DEPTH`` once; what is decided from the data, level by
level, is where to stop: a node of at most ``BLOCK`` different sets is compared
whole, in a larger one each member is compared with one member drawn at random.
What the drawn member does not hold is compared with the whole node, block by
block, where it is at most ``BLOCK`` sets or the depth is used up; else the node
is split by its children.  So no pair that meets in a last node is dropped.
``runs`` repeats the whole until the target recall: a pair is missed with chance
exp(-runs) at depth 1, under 1 % at depth 3.

Before that, groups are contracted: in the top nodes of ``FIRST_RUNS`` runs every set
is compared with the drawn member, and sets that are likely links of one member are
connected by it.  A node whose sets are all connected already can join nothing and
is left out, and in the rest only sets that are not are compared.  So a group of
near copies is compared once and then counts as one.

These comparisons are by 128 one-byte min-hashes and only drop estimates far below
the threshold (four standard deviations); of the rest they keep edges enough to
hold the likely links together.  In each connected component of them all pairs are
then compared exactly on their whole sets, in salted blocks of at most about
``BLOCK`` sets where the component is larger: that gives the links, their numbers
and the classes, which are the connected components of the links.  Pairs are
counted inside a task and never become rows.  Components are found by min-label
propagation with pointer jumping; every round is written to the shared folder.

Defined results: documents with the same shingle set are one node (its copies are
not expanded into pairs) and always share a class; null and empty texts are the
same text; a null id is an id; repeated rows are each reported; the class id is the
smallest document id of the class (nulls last).  ``n_links`` counts the other
documents with the same set and those of every set linked to it.  An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paytrail.llm.common import WordHash, pick, release, small_batches, stored, words_of

K, THRESHOLD = 5, 0.8
RUNS, DEPTH, BUCKET = 12, 3, 32
FIRST_RUNS = 4  # runs whose top nodes are contracted
# sets and tokens of a block that is compared with another in one task; columns of one dense lot
BLOCK, BLOCK_TOKENS, COLUMNS = 512, 2_000_000, 4096
SKETCH = 128
_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, 4097, dtype=np.uint64) * _G)


def shingles(text: str | None, hasher: WordHash, k: int = K) -> np.ndarray:
    """Sorted distinct shingle hashes; never empty."""
    words = words_of(text)
    if not words:
        return np.array([xxhash.xxh3_64_intdigest((text or "").encode("utf-8"), seed=1)], dtype=np.uint64)
    h = hasher(words)
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for j in range(n):
        out = _mix(out + h[j : len(h) - n + 1 + j] + _G)
    return np.unique(out)


def sketch(tokens: np.ndarray) -> bytes:
    """One byte of each of ``SKETCH`` min-hashes."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lot in np.array_split(tokens, max(1, len(tokens) // 4000)):
        low = np.minimum(low, ((lot[:, None] ^ _SEEDS[None, :SKETCH]) * _M1).min(axis=0))
    return (_mix(low) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def paths(tokens: np.ndarray, runs: int, depth: int, threshold: float) -> list[list[int]]:
    """Chosen paths of a set: node keys [level 1, level 2, ...], one list per end of a path, shorter where a path ends."""
    chance = min(1.0, 1.0 / (threshold * len(tokens)))
    limit = np.uint64(min(2**64 - 1, int(chance * 2.0**64)))

    def children(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        who, what = [], []
        for lot in np.array_split(np.arange(len(tokens)), max(1, len(tokens) // 8000)):
            h = _mix(nodes[:, None] ^ _mix(tokens[lot] + _G)[None, :])
            a, b = np.nonzero(h <= limit)
            who.append(a)
            what.append(_mix(h[a, b] + _M2))
        return np.concatenate(who), np.concatenate(what)

    out: list[list[int]] = [[]] * runs
    nodes, owners = _SEEDS[1000 : 1000 + runs], list(range(runs))
    done: list[list[int]] = []
    for _ in range(depth):
        if not len(nodes):
            break
        who, what = children(nodes)
        grown = [out[owners[a]] + [int(x)] for a, x in zip(who.tolist(), what.view(np.int64).tolist(), strict=True)]
        childless = set(range(len(nodes))) - set(who.tolist())
        done += [out[owners[a]] for a in childless if out[owners[a]]]
        out, nodes, owners = grown, what, list(range(len(grown)))
    return done + out


FEATURES = "key binary, n int, sketch binary, tops array<long>, paths array<array<long>>"


def features(df: DataFrame, id_col: str, text_col: str, k: int, runs: int, depth: int, threshold: float) -> DataFrame:
    """(id, key of the shingle set, its size, its sketch, its top nodes in the first runs, its paths) of every whole text."""
    src = pick(df, id_col, text_col)
    first = min(FIRST_RUNS, runs)

    def run(batches):
        release()
        hasher = WordHash()
        for batch in batches:
            key, n, sk, fs, ps = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                tokens = shingles(text, hasher, k)
                key.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                n.append(len(tokens))
                sk.append(sketch(tokens))
                ps.append(paths(tokens, runs, depth, threshold))
                fs.append([p[0] for p in paths(tokens, first, 1, threshold) if p])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(key, pa.binary()), pa.array(n, pa.int32()), pa.array(sk, pa.binary()), pa.array(fs, pa.list_(pa.int64())), pa.array(ps, pa.list_(pa.list_(pa.int64())))],
                ["id", "key", "n", "sketch", "tops", "paths"])

    return src.mapInArrow(run, T.StructType([T.StructField("id", src.schema["id"].dataType), *T._parse_datatype_string(FEATURES).fields]))


def _met(members: DataFrame) -> DataFrame:
    """``members`` (node, key, root) of the nodes whose sets are not all connected, with their number ``m`` and a drawn member."""
    drawn = F.min(F.struct(F.xxhash64("key").alias("h"), "key", "root"))
    nodes = members.groupBy("node").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"), drawn.alias("d"))
    nodes = nodes.filter("m > 1 and low < high").select("node", "m", F.col("d.key").alias("c"), F.col("d.root").alias("c_root"))
    return stored(members.join(nodes, "node"), "jaccard-met")


def contracted(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((key, root) of the sets that are not their own root, edges (a, b)): likely links of drawn members; sets of one root
    are connected by the edges."""
    slim = sets.select("key", "n", "sketch")
    members = stored(sets.select(F.explode("tops").alias("node"), "key", F.col("key").alias("root")).distinct(), "jaccard-members")
    star = _star(_met(members).join(slim, "key"), slim, threshold)
    edges = stored(star.filter("near and key <> c").select(F.col("key").alias("a"), F.col("c").alias("b")).distinct(), "jaccard-tops")
    up = edges.groupBy("a").agg(F.min("b").alias("up"))
    # one step further: the member that the first one is linked to
    root = up.join(up.toDF("up", "top"), "up", "left").select(F.col("a").alias("key"), F.coalesce("top", "up").alias("root"))
    return stored(root, "jaccard-contracted"), edges


def candidates(sets: DataFrame, root: DataFrame, depth: int, bucket: int, threshold: float, block: int) -> DataFrame:
    """(a, b) keys of likely links that connect all sets that meet in a node and are likely links there.

    ``root`` (key, root): sets of one root are connected already; a set that is not there is its own root.
    """
    slim = sets.select("key", "n", "sketch")
    pairs, near = [], []
    ends = sets.select("key", F.explode("paths").alias("p"))
    hot = None
    for level in range(depth):
        rows = ends.filter(F.size("p") > level)
        if hot is not None:
            rows = rows.select("key", "p", F.get("p", F.lit(level - 1)).alias("parent")).join(hot, "parent").drop("parent")
        node = F.get("p", F.lit(level))
        # the slim rows meet the roots, not the sets with their paths; one shuffle by key serves the join and the distinct
        members = rows.select(node.alias("node"), "key").join(root, "key", "left").select("node", "key", F.coalesce("root", "key").alias("root"))
        members = stored(members.distinct(), "jaccard-members")
        met = _met(members)
        # at most ``bucket`` keys a node: the pairs of a node are bounded
        lists = met.filter(F.col("m") <= bucket).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("key", "root"))).alias("keys"))
        others = lambda x, i: F.filter(F.slice(F.col("keys"), i + 2, F.size("keys")), lambda y: y["root"] != x["root"])
        both = F.flatten(F.transform("keys", lambda x, i: F.transform(others(x, i), lambda y: F.struct(x["key"].alias("a"), y["key"].alias("b")))))
        pairs.append(lists.select(F.explode(both).alias("p")).select("p.a", "p.b"))
        middle = met.filter((F.col("m") > bucket) & (F.col("m") <= block)).select("node", "key").join(slim, "key")
        near.append(middle.groupBy("node").applyInArrow(_inside(threshold), EDGE))
        large = met.filter(F.col("m") > block)
        if large.isEmpty():
            break  # no node goes on to its children
        star = stored(_star(large.join(slim, "key"), slim, threshold), "jaccard-star")
        near.append(star.filter("near and root <> c_root").select(F.col("key").alias("a"), F.col("c").alias("b")))
        # the drawn member holds its likely links and its component together: only the rest has to meet the whole node
        left = star.filter("not near").groupBy("node").agg(F.count("*").alias("r"), F.first("m").alias("m"))
        if level < depth - 1:
            hot = stored(left.filter(F.col("r") > block).select(F.col("node").alias("parent")), "jaccard-hot")
            left = left.filter(F.col("r") <= block)
        packed = F.collect_list(F.struct("key", "n", "sketch"))
        rest = (star.filter("not near").select("node", "key", "n", "sketch").join(left, "node")
                .withColumn("i", _block_of("key", F.ceil(F.col("r") / block))).groupBy("node", "i").agg(packed.alias("xs")))
        whole = (star.select("node", "key", "n", "sketch").join(left, "node")
                 .withColumn("j", _block_of("key", F.ceil(F.col("m") / block))).groupBy("node", "j").agg(packed.alias("ys")))
        near.append(rest.join(whole, "node").groupBy("node", "i", "j").applyInArrow(_across(threshold), EDGE))
        if level < depth - 1 and hot.isEmpty():
            break
    out = _estimate(_union(pairs).distinct(), sets, threshold)
    return stored(_union([out, *near]).distinct(), "jaccard-candidates")


EDGE = "a binary, b binary"


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out


def _block_of(key: str, blocks) -> Column:
    """The salted block of a key: one of ``blocks``."""
    return F.pmod(F.xxhash64(F.lit("block"), key), F.greatest(blocks, F.lit(1)).cast("long"))


def _margin(threshold: float) -> float:
    return 4 * (threshold * (1 - threshold) / SKETCH) ** 0.5


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)


def _likely(nx: np.ndarray, sx: np.ndarray, ny: np.ndarray, sy: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of x, columns of y: may the two sets be a link?"""
    out = np.empty((len(nx), len(ny)), dtype=bool)
    least = threshold - _margin(threshold)
    for i in range(len(nx)):
        j = ((sy == sx[i]).mean(axis=1) - 1 / 256) * 256 / 255
        out[i] = (j >= least) & (np.minimum(ny, nx[i]) >= threshold * np.maximum(ny, nx[i]) - 1e-9)
    return out


def _forest(adjacent: np.ndarray) -> np.ndarray:
    """The first member of each row's component."""
    label = np.full(len(adjacent), -1)
    for s in range(len(adjacent)):
        if label[s] < 0:
            label[s] = s
            front = np.array([s])
            while len(front):
                front = np.nonzero(adjacent[front].any(axis=0) & (label < 0))[0]
                label[front] = s
    return label


def _square(links: np.ndarray) -> np.ndarray:
    """Adjacency of the members of x, then of y, for links between x and y."""
    x, y = links.shape
    out = np.zeros((x + y, x + y), dtype=bool)
    out[:x, x:], out[x:, :x] = links, links.T
    return out


def _edges(keys: list[bytes], label: np.ndarray) -> pa.Table:
    # to the smallest key: other nodes of the same sets give the same edges
    least: dict[int, bytes] = {}
    for key, x in zip(keys, label.tolist(), strict=True):
        least[x] = min(key, least.get(x, key))
    moved = [(key, least[x]) for key, x in zip(keys, label.tolist(), strict=True) if key != least[x]]
    return pa.table([pa.array([x[0] for x in moved], pa.binary()), pa.array([x[1] for x in moved], pa.binary())], ["a", "b"])


def _inside(threshold: float):
    """All pairs of one node: edges that hold its likely links together."""
    def run(table):
        release()
        n, s = table["n"].to_numpy(), _bytes(table["sketch"])
        return _edges(table["key"].to_pylist(), _forest(_likely(n, s, n, s, threshold)))
    return run


def _across(threshold: float):
    """All pairs of two blocks of a node."""
    def run(table):
        release()
        x, y = (table[c].combine_chunks().flatten() for c in ("xs", "ys"))
        links = _likely(x.field("n").to_numpy(), _bytes(x.field("sketch")), y.field("n").to_numpy(), _bytes(y.field("sketch")), threshold)
        return _edges(x.field("key").to_pylist() + y.field("key").to_pylist(), _forest(_square(links)))
    return run


def _star(members: DataFrame, slim: DataFrame, threshold: float) -> DataFrame:
    """``members`` with ``near``: it is a likely link of its node's drawn member ``c``, or connected to it already."""
    both = (members.select("node", "key", "root", "n", "sketch", "m", "c", "c_root")
            .join(slim.toDF("c", "nc", "sc"), "c"))

    def run(batches):
        release()
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(c).to_numpy() for c in ("n", "nc"))
            j = ((_bytes(batch.column("sketch")) == _bytes(batch.column("sc"))).mean(axis=1) - 1 / 256) * 256 / 255
            near = (j >= threshold - _margin(threshold)) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)
            near |= np.array([a == b for a, b in zip(batch.column("root").to_pylist(), batch.column("c_root").to_pylist(), strict=True)], dtype=bool)
            names = ["node", "key", "root", "n", "sketch", "m", "c", "c_root"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(near)], [*names, "near"])

    return both.mapInArrow(run, "node long, key binary, root binary, n int, sketch binary, m long, c binary, c_root binary, near boolean")


def _estimate(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) that may be links."""
    slim = sets.select("key", "n", "sketch")
    both = (pairs.join(slim.toDF("a", "na", "sa"), "a").join(slim.toDF("b", "nb", "sb"), "b")
            .filter(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9).select("a", "b", "sa", "sb"))

    def run(batches):
        release()
        for batch in batches:
            if not batch.num_rows:
                continue
            j = ((_bytes(batch.column(2)) == _bytes(batch.column(3))).mean(axis=1) - 1 / 256) * 256 / 255
            keep = pa.array(j >= threshold - _margin(threshold))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.mapInArrow(run, EDGE)


def _tokens(wanted: DataFrame, docs: DataFrame, feats: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(key, tokens): the whole sets of ``wanted`` keys."""
    # one document of each wanted set
    owners = feats.select("id", "key").join(wanted.select("key"), "key").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("x"), F.col("id"))).alias("o"))
    owners = stored(owners.select(F.col("o.id").alias("owner")), "jaccard-owners")
    src = pick(docs, id_col, text_col)
    texts = src.join(owners, F.col("id").eqNullSafe(F.col("owner")), "left_semi").select("text")

    def sets(batches):
        release()
        hasher = WordHash()
        for batch in batches:
            tokens = [shingles(t, hasher, k) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in tokens], pa.binary()), pa.array([x.tobytes() for x in tokens], pa.binary())], ["key", "tokens"])

    return texts.mapInArrow(sets, "key binary, tokens binary").dropDuplicates(["key"])


def _linked(xs: list[np.ndarray], ys: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Exact links of the sets ``xs`` with the sets ``ys``, or with one another."""
    sets = xs + (ys or [])
    n = np.array([len(x) for x in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.r_[True, tokens[1:] != tokens[:-1]]
    often = np.diff(np.r_[np.nonzero(first)[0], len(tokens)])
    kept = np.repeat(often > 1, often)  # a token of one set alone is in no intersection
    owner, column = owner[kept], np.cumsum(first[kept]) - 1
    x = len(xs)
    shared = np.zeros((x, x if ys is None else len(ys)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        dense = np.zeros((len(sets), min(COLUMNS, int(column[b - 1]) + 1 - low)), dtype=np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        shared += dense[:x] @ (dense if ys is None else dense[x:]).T
    both = n[:x, None] + n[None, : x if ys is None else None][:, 0 if ys is None else x :]
    links = shared >= threshold * (both - shared) - 1e-9
    if ys is None:
        np.fill_diagonal(links, False)
    return links


def _counted(keys: list[bytes], label: np.ndarray, links: np.ndarray) -> pa.Table:
    return pa.table([pa.array(keys, pa.binary()), pa.array([keys[x] for x in label.tolist()], pa.binary()), pa.array(links, pa.int64())], ["a", "b", "links"])


def _exact(label: DataFrame, sets: DataFrame, docs: DataFrame, feats: DataFrame, id_col: str, text_col: str, k: int, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(key, root) of the exact classes and (key, partners), from all pairs in each component ``label`` of likely links.

    A component goes to one task, or in salted blocks to one task for each pair of blocks; no pair becomes a row.
    """
    size = label.join(sets.select("key", "n", "copies"), "key")
    lots = size.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("lots"))
    size = stored(size.join(lots, "root").select("root", "key", "copies", "lots"), "jaccard-likely")
    whole = size.join(_tokens(size, docs, feats, id_col, text_col, k), "key")

    def alone(table):
        release()
        keys, copies = table["key"].to_pylist(), table["copies"].to_numpy()
        links = _linked([np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()], None, threshold)
        return _counted(keys, _forest(links), links @ copies)

    def within(table):
        release()
        keys, copies = table["key"].to_pylist(), table["copies"].to_numpy()
        links = _linked([np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()], None, threshold)
        found = _counted(keys, _forest(links), links @ copies)
        return table.append_column("b", found["b"]).append_column("links", found["links"])

    def crossed(table):
        release()
        x, y = (table[c].combine_chunks().flatten() for c in ("xs", "ys"))
        (kx, ky), (bx, by) = ([z.field(c).to_pylist() for z in (x, y)] for c in ("key", "b"))
        cx, cy = (z.field("copies").to_numpy() for z in (x, y))
        tx, ty = ([np.frombuffer(t, np.uint64) for t in z.field("tokens").to_pylist()] for z in (x, y))
        links = _linked(tx, ty, threshold)
        own = _counted(kx + ky, np.arange(len(kx) + len(ky)), np.r_[links @ cy, links.T @ cx]).set_column(1, "b", pa.array(bx + by, pa.binary()))
        # links join the blocks' own classes: one edge for each two of them
        i, j = np.nonzero(links)
        nx, ny = ({b: n for n, b in enumerate(sorted(set(z)))} for z in (bx, by))
        codes = np.unique(np.array([nx[b] for b in bx])[i] * len(ny) + np.array([ny[b] for b in by])[j])
        rx, ry = list(nx), list(ny)
        between = [(rx[c // len(ry)], ry[c % len(ry)]) for c in codes.tolist()]
        edges = pa.table([pa.array([e[0] for e in between], pa.binary()), pa.array([e[1] for e in between], pa.binary()), pa.array([0] * len(between), pa.int64())], ["a", "b", "links"])
        return pa.concat_tables([own, edges])

    counted = "a binary, b binary, links long"
    one = stored(whole.filter("lots = 1").select("root", "key", "copies", "tokens").groupBy("root").applyInArrow(alone, counted), "jaccard-alone")
    parts = stored(whole.filter("lots > 1").select("root", _block_of("key", F.col("lots")).alias("i"), "key", "copies", "tokens").groupBy("root", "i")
                   .applyInArrow(within, "root binary, i long, key binary, copies long, tokens binary, b binary, links long"), "jaccard-within")
    blocks = stored(parts.groupBy("root", "i").agg(F.collect_list(F.struct("key", "copies", "tokens", "b")).alias("xs")), "jaccard-blocks")
    crossing = blocks.join(blocks.toDF("root", "j", "ys"), "root").filter(F.col("i") < F.col("j"))
    many = stored(parts.select(F.col("key").alias("a"), "b", "links").unionAll(crossing.groupBy("root", "i", "j").applyInArrow(crossed, counted)), "jaccard-crossed")
    roots = one.select(F.col("a").alias("key"), F.col("b").alias("root"))
    if not many.isEmpty():
        roots = roots.unionAll(components(many.select("a", "b").distinct()))
    return roots, one.unionAll(many).groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("partners"))


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(key, root): the smallest key of each node's component, for the nodes that have an edge.

    ``edges`` (a, b) are undirected.
    """
    both = stored(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "jaccard-edges")
    label = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("root")), "jaccard-roots")
    for _ in range(max_rounds):
        around = both.join(label.toDF("a", "root"), "a").select(F.col("b").alias("key"), "root")
        near = around.unionAll(label).groupBy("key").agg(F.min("root").alias("root"))
        # pointer jumping: a node takes its root's root
        jump = stored(near, "jaccard-near")
        new = stored(jump.join(jump.toDF("root", "far"), "root", "left").select("key", F.coalesce(F.least("root", "far"), "root").alias("root")), "jaccard-roots")
        moved = new.join(label.withColumnRenamed("root", "old"), "key").filter(F.col("root") != F.col("old")).limit(1).count()
        label = new
        if not moved:
            return label
    raise RuntimeError(f"the components did not settle in {max_rounds} rounds")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, threshold: float = THRESHOLD, runs: int = RUNS,
            depth: int = DEPTH, bucket: int = BUCKET, block: int = BLOCK, counted: bool = True) -> tuple[DataFrame, DataFrame]:
    """(features per document, (key, first id, copies, root, partners) per set): the join itself; ``root`` is the key of the class.

    Without ``counted`` the numbers of links are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    feats = stored(features(docs, id_col, text_col, k, runs, depth, threshold), "jaccard-features")
    place = F.struct(F.col("id").isNull().alias("x"), F.col("id"))
    same = [F.first(c).alias(c) for c in ("n", "sketch", "tops", "paths")]
    sets = stored(feats.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("copies"), *same)
                  .select("key", F.col("first.id").alias("first"), "copies", "n", "sketch", "tops", "paths"), "jaccard-sets")
    root, edges = contracted(sets, threshold)
    likely = components(edges.unionAll(candidates(sets, root, depth, bucket, threshold, block)).distinct())
    roots, partners = _exact(likely, sets, docs, feats, id_col, text_col, k, threshold, block)
    if not counted:
        by_set = sets.select("key", "first", "copies").join(roots, "key", "left")
        return feats.select("id", "key"), stored(by_set.select("key", "first", "copies", F.coalesce("root", "key").alias("root")), "jaccard-classes")
    linked = roots.join(partners, "key")
    by_set = sets.select("key", "first", "copies").join(linked, "key", "left")
    return feats.select("id", "key"), stored(by_set.select("key", "first", "copies", F.coalesce("root", "key").alias("root"), F.coalesce("partners", F.lit(0)).alias("partners")), "jaccard-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(id, class_id, n_links, n_copies) per document."""
    feats, sets = classes(docs, id_col, text_col, **settings)
    place = F.struct(F.col("first").isNull().alias("x"), F.col("first"))
    heads = sets.groupBy("root").agg(F.min(place).alias("h")).select("root", F.col("h.first").alias("class_id"))
    by_set = sets.join(heads, "root").select("key", "class_id", (F.col("copies") - 1 + F.col("partners")).alias("n_links"), F.col("copies").alias("n_copies"))
    return feats.join(by_set, "key").select(F.col("id").alias(id_col), "class_id", "n_links", "n_copies")


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, **settings) -> DataFrame:
    """``docs`` with all columns: of every class one row, that of its smallest (id, set key); nulls last.

    Rows of one id and one set go by their JSON form.  A row is found by its id where no other row has it, else by id and set.
    """
    feats, sets = classes(docs, id_col, text_col, k=k, counted=False, **settings)
    place = F.struct(F.col("first").isNull().alias("x"), "first", "key")
    best = sets.groupBy("root").agg(F.min(place).alias("h")).select(F.col("h.first").alias("__pt_id"), F.col("h.key").alias("__pt_key"))
    best = stored(best, "jaccard-best")
    many = stored(feats.filter("id is not null").groupBy("id").count().filter("count > 1").select(F.col("id").alias("__pt_id")), "jaccard-repeated")
    alone = best.filter("__pt_id is not null").join(many, "__pt_id", "left_anti").select("__pt_id")
    out = docs.join(alone, docs[id_col] == F.col("__pt_id"), "left_semi")
    unclear = docs.filter(docs[id_col].isNull()).unionAll(docs.join(many, docs[id_col] == F.col("__pt_id"), "left_semi"))

    @F.arrow_udf("binary")
    def set_key(texts):
        hasher = WordHash()
        return pa.array([xxhash.xxh3_128_digest(shingles(t, hasher, k).tobytes()) for t in texts.to_pylist()], pa.binary())

    row = F.struct(*[F.col(c) for c in docs.columns])
    rows = (unclear.select(row.alias("row"), F.col(id_col).alias("id"), set_key(F.col(text_col).cast("string")).alias("key"))
            .groupBy("id", "key").agg(F.min_by("row", F.to_json("row")).alias("row")))
    found = rows.join(best, (F.col("key") == F.col("__pt_key")) & F.col("id").eqNullSafe(F.col("__pt_id")), "left_semi")
    return out.unionAll(found.select("row.*"))
