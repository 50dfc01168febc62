"""Near-duplicate detection by MinHash with odd sketches.

1. Every text becomes the set of its distinct five-word shingles (64-bit hashes); a text of fewer words is one
   shingle, a text without words has an empty set and no links. MinHash gives ``BANDS`` keys of ``ROWS`` minima,
   and all minima are folded into a parity bitmap, the odd sketch: the population count of two bitmaps' XOR
   estimates how many minima differ, which is precise at high similarity.
2. Texts with the same set form a class; only classes go on, so copies are never paired.
3. In each band bucket every class is paired with the bucket's first class (a star, as many pairs as
   members). Pairs whose sketches are far apart go; the rest are confirmed on the full sets. Confirmed links
   give components.
4. Buckets that still hold several components are searched for links between them: sketches are compared in
   blocks of bounded size. A block reports which members the sketches tie together (as many rows as members, never
   the pairs), and these ties join components into families.
5. The members of a family meet once, in blocks that carry the full sets; a pair of components is tried on the full
   sets until it is linked, and only the links go on.

A link is missed only if no band agrees or the sketches err by five standard deviations: about 1 in 10^6 at the
threshold, less above it. Components need not lose anything by it while another path joins the texts.

Defined results: null or blank text has an empty set; equal ids are separate rows; a null id is ignored by the
smallest id of a component (null only if all are); an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casework.llm.common import arrow_batches, column, map_arrow, materialize, packed_rows, texts_of

WIDTH = 5
BANDS, ROWS = 50, 5
BITS = 512
#: Largest XOR population count of a pair that goes to the full sets: the mean at similarity 0.5.
FAR = round(BITS * (1 - np.exp(-2 * (2 * BANDS * ROWS * 0.5) / BITS)) / 2)
#: Bytes of text hashed at once, rows of a Python step, shingles of a MinHash step.
BLOCK, STEP, SHINGLES = 1 << 20, 256, 1 << 15
LEFT, RIGHT = 256, 2048

_RNG = np.random.default_rng(20_240_501)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _RNG.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_BAND = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, p, np.uint64))]) for p in (_P, _P_INV))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word (a run of bytes other than 0x20 and 0x09-0x0D) of a block of text."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    space = np.concatenate([[True], _SPACE[a], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _POWERS.get(len(a) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[a] * up[:-1])])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def document_words(texts: list[str]) -> list[np.ndarray]:
    """The word hashes of each text; texts are hashed together in blocks, a long text in several."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush():
        nonlocal held, size
        if held:
            h, start = word_hashes(b" ".join(d for _, d in held))
            ends = np.cumsum([len(d) + 1 for _, d in held])
            for (i, _), part in zip(held, np.split(h, np.searchsorted(start, ends)[:-1])):
                out[i].append(part)
        held, size = [], 0

    for i, t in enumerate(texts):
        data, at = t.encode("utf-8", "surrogatepass"), 0
        while at < len(data):
            to = at + BLOCK
            if to < len(data):  # cut at the next space, so that no word is split
                while to < len(data) and not _SPACE[data[to]]:
                    to += 1
            held.append((i, data[at:to]))
            size += to - at
            at = to
            if size >= BLOCK:
                flush()
    flush()
    return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.empty(0, np.uint64) for p in out]


def shingles(w: np.ndarray) -> np.ndarray:
    """The sorted distinct shingles of a word sequence."""
    n = min(len(w), WIDTH)
    if n == 0:
        return w
    s = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        s += w[k:len(w) - n + 1 + k] * _PLACE[k]
    return np.unique(mix(s + np.uint64(n)))


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (sets, BANDS) and odd sketches (sets, BITS / 64) of non-empty sets."""
    keys, odd = np.empty((len(sets), BANDS), np.uint64), np.zeros((len(sets), BITS // 64), np.uint64)
    lo = 0
    while lo < len(sets):
        hi, n = lo, 0
        while hi < len(sets) and (hi == lo or n + len(sets[hi]) <= SHINGLES):
            n += len(sets[hi])
            hi += 1
        x = np.concatenate(sets[lo:hi])
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[lo:hi]])[:-1]])
        low, v = np.empty((BANDS * ROWS, hi - lo), np.uint64), np.empty_like(x)
        for i in range(BANDS * ROWS):
            np.multiply(x, _MUL[i], out=v)
            v += _ADD[i]
            np.minimum.reduceat(v, at, out=low[i])
        low = mix(low.T + np.arange(BANDS * ROWS, dtype=np.uint64))  # a minimum counts with its place
        keys[lo:hi] = mix((low.reshape(-1, BANDS, ROWS) * _BAND).sum(axis=2, dtype=np.uint64))
        bit = (low % np.uint64(BITS)).astype(np.int64)
        parity = np.zeros((hi - lo, BITS), np.uint8)
        np.add.at(parity, (np.arange(hi - lo)[:, None], bit), 1)
        odd[lo:hi] = np.packbits(parity & 1, axis=1).view(np.uint64)
        lo = hi
    return keys, odd


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.reshape(-1).view(np.int64)))


FEATURES = "doc_id long, text_key binary, n_shingles long, class binary, bands array<long>, odd array<long>"


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in arrow_batches(batches, STEP):
        texts = texts_of(b)
        sets = [shingles(w) for w in document_words(texts)]
        full = [s for s in sets if len(s)]
        keys, odd = np.zeros((len(sets), BANDS), np.uint64), np.zeros((len(sets), BITS // 64), np.uint64)
        if full:
            on = np.array([len(s) > 0 for s in sets])
            keys[on], odd[on] = sketches(full)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary()),
             pa.array([len(s) for s in sets], pa.int64()),
             pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), _lists(keys), _lists(odd)],
            names=["doc_id", "text_key", "n_shingles", "class", "bands", "odd"])


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full set of each text key, once per task."""
    seen: set[bytes] = set()
    for b in arrow_batches(batches, STEP):
        keys, nodes, texts = b.column("text_key").to_pylist(), b.column("node").to_pylist(), texts_of(b)
        new = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
        sets = [shingles(w).view(np.int64) for w in document_words([texts[i] for i in new])]
        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in new], pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                                         names=["node", "set"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sets in the order of unsigned numbers."""
    small, large = (x.view(np.uint64), y.view(np.uint64)) if len(x) <= len(y) else (y.view(np.uint64), x.view(np.uint64))
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_batches(batches, STEP):
            sides = []
            for c in ("left_set", "right_set"):
                flat, ends = b.column(c).values.to_numpy(), b.column(c).offsets.to_numpy()
                sides.append([flat[i:j] for i, j in zip(ends[:-1], ends[1:])])
            keep = [similar(x, y, percent) for x, y in zip(*sides)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def by_block(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[dict]:
    """The rows of each block (fam or band, k, r), which come sorted; list columns as numpy rows."""
    held: dict | None = None
    for b in batches:
        now = {}
        for c in (*names, "k", "r", "node", "comp", "right"):
            now[c] = b.column(c).to_numpy(zero_copy_only=False)
        now["odd"] = b.column("odd").flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
        if "set" in b.schema.names:
            flat, ends = b.column("set").values.to_numpy(), b.column("set").offsets.to_numpy()
            now["set"] = np.empty(b.num_rows, object)
            now["set"][:] = [flat[i:j] for i, j in zip(ends[:-1], ends[1:])]
        held = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in now}
        cut = np.flatnonzero(np.any([held[c][1:] != held[c][:-1] for c in (*names, "k", "r")], axis=0)) + 1
        ends = [0, *cut.tolist()]
        for i, j in zip(ends[:-1], ends[1:]):
            yield {c: v[i:j] for c, v in held.items()}
        held = {c: v[ends[-1]:] for c, v in held.items()}
    if held is not None and len(held["node"]):
        yield held


def near_in_block(g: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right rows of a block, and which pairs of different components have near sketches."""
    left, right = np.flatnonzero(~g["right"]), np.flatnonzero(g["right"])
    near = np.zeros((len(left), len(right)), bool)
    for at in range(0, len(left), 32):
        part = left[at:at + 32]
        differ = np.bitwise_count(g["odd"][part][:, None, :] ^ g["odd"][right][None, :, :]).sum(axis=2, dtype=np.int64)
        near[at:at + 32] = (differ <= FAR) & (g["comp"][part][:, None] != g["comp"][right][None, :])
    return left, right, near


def _pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([np.asarray(p[k], np.int64) for p in found]) if found else np.empty(0, np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block, each member that has a near pair with the smallest left member it is connected to by such pairs."""
    for g in by_block(batches, ("band",)):
        left, right, near = near_in_block(g)
        if not near.any():
            continue
        none = len(left)
        low = np.where(near.any(axis=1), np.arange(none), none)
        while True:
            far = np.where(near, low[:, None], none).min(axis=0)
            new = np.minimum(low, np.where(near, far[None, :], none).min(axis=1))
            if (new == low).all():
                break
            low = new
        node = g["node"]
        on, off = np.flatnonzero(low < none), np.flatnonzero(far < none)
        yield _pairs([(node[left[low[on]]], node[left[on]]), (node[left[far[off]]], node[right[off]])])


def block_links(percent: int):
    """Per block of a family, links on the full sets that join its components as far as any do."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in by_block(batches, ("fam",)):
            left, right, near = near_in_block(g)
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = x = root[root[x]]
                return x

            found, comp, sets, node = [], g["comp"].tolist(), g["set"], g["node"].tolist()
            for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
                i, j = left[i], right[j]
                x, y = find(comp[i]), find(comp[j])
                if x != y and similar(sets[i], sets[j], percent):
                    root[max(x, y)] = min(x, y)
                    found.append((node[i], node[j]))
            if found:
                yield _pairs([tuple(np.array(found, np.int64).T)])
    return run


def near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose odd sketches differ in at most FAR bits."""
    odd = classes.select("node", "odd")
    p = pairs.join(odd.select(F.col("node").alias("a"), F.col("odd").alias("odd_a")), "a") \
        .join(odd.select(F.col("node").alias("b"), F.col("odd").alias("odd_b")), "b")
    bits = sum((F.bit_count(F.col("odd_a")[i].bitwiseXOR(F.col("odd_b")[i])) for i in range(BITS // 64)), F.lit(0))
    return p.filter(bits <= FAR).select("a", "b")


def sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, set``: full sets of some classes, made again from their texts."""
    wanted = classes.select("node", "text_key").join(nodes, "node")
    sets = map_arrow(docs.join(wanted, "text_key").select("text_key", "node", "text"), full_sets, "node long, set array<long>")
    return materialize(sets, "full-sets")


def links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a < b) that hold on the full sets."""
    pairs = materialize(pairs, "near-pairs")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, docs)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("left_set")), "a") \
        .join(sets.select(F.col("node").alias("b"), F.col("set").alias("right_set")), "b")
    return materialize(map_arrow(both, confirmed(percent), "a long, b long").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of the nodes of undirected links, by alternating stars: every node
    hands its smallest neighbour to its larger ones, then to its smaller ones, until nothing changes. Each round
    is aggregations and joins over written tables; only a count and a checksum reach the driver."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    last = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                              F.struct("u", F.col("m").alias("v")))).alias("e")) \
            .select("e.*").filter("u <> v").distinct()
        edges = materialize(small, "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def in_blocks(m: DataFrame, by: str, width: int) -> DataFrame:
    """Members (by, node, comp, odd, ..., n members, s strays, stray) dealt into blocks ``by, k, r``: each block has up
    to about LEFT members on the left and ``width`` strays on the right, and every member meets every stray."""
    own = [c for c in m.columns if c not in ("n", "s", "stray")]
    m = m.withColumn("left_blocks", F.ceil(F.col("n") / LEFT).cast("int")).withColumn("right_blocks", F.ceil(F.col("s") / width).cast("int"))
    spread = F.xxhash64("node")
    left = m.select(*own, F.pmod(spread, F.col("left_blocks")).cast("int").alias("k"),
                    F.explode(F.sequence(F.lit(0), F.col("right_blocks") - 1)).alias("r"), F.lit(False).alias("right"))
    right = m.filter("stray").select(*own, F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("k"),
                                     F.pmod(spread, F.col("right_blocks")).cast("int").alias("r"), F.lit(True).alias("right"))
    rows = left.unionByName(right)
    return rows.repartition(by, "k", "r").sortWithinPartitions(by, "k", "r")


def strays(m: DataFrame, by: str) -> DataFrame:
    """Members of the groups that hold several components: ``n`` of them, ``s`` outside the largest component."""
    sizes = m.groupBy(by, "comp").agg(F.count(F.lit(1)).alias("c")).groupBy(by) \
        .agg(F.sum("c").alias("n"), F.max(F.struct("c", "comp")).alias("most"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    return m.join(sizes.select(by, "n", (F.col("n") - F.col("most.c")).alias("s"), F.col("most.comp").alias("large")), by) \
        .withColumn("stray", F.col("comp") != F.col("large")).drop("large")


def between(buckets: DataFrame, classes: DataFrame, parts: DataFrame) -> DataFrame:
    """Ties (a, b) that connect all classes that share a bucket, not a component, and have near sketches."""
    m = buckets.filter("n > 2").select("band", "node").join(parts, "node", "left") \
        .select("band", "node", F.coalesce("component", "node").alias("comp"))
    m = strays(m, "band").join(classes.select("node", "odd"), "node")
    return map_arrow(in_blocks(m, "band", RIGHT), ties, "a long, b long").filter("a <> b").distinct()


def within(tied: DataFrame, found: DataFrame, parts: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links between the components of each family, a family being what ties and links connect."""
    families = materialize(components(tied.unionAll(found)), "families")
    m = families.select("node", F.col("component").alias("fam")).join(parts, "node", "left") \
        .select("fam", "node", F.coalesce("component", "node").alias("comp"))
    m = materialize(strays(m, "fam"), "family-members")
    sets = sets_of(m.select("node").distinct(), classes, docs)
    m = m.join(classes.select("node", "odd"), "node").join(sets, "node")
    return materialize(map_arrow(in_blocks(m, "fam", LEFT), block_links(percent), "a long, b long").distinct(), "family-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_shingles, component_id, component`` (a number of the component)."""
    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    f = materialize(map_arrow(d, features, FEATURES).withColumn("rid", F.monotonically_increasing_id()), "features")
    first = F.min(F.struct(F.col("rid").alias("node"), "text_key", "odd", "bands")).alias("c")
    classes = materialize(f.filter("n_shingles > 0").groupBy("class").agg(first, F.min("doc_id").alias("low"))
                          .select("class", "low", "c.*"), "classes")
    keyed = d.select(F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text_key"), "text")
    bands = classes.select("node", F.explode("bands").alias("band"))
    stars = bands.groupBy("band").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = materialize(bands.join(stars, "band"), "buckets")
    tested = buckets.filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    found = links(near(tested, classes), classes, keyed, percent)
    parts = materialize(components(found), "components")
    tied = materialize(between(buckets, classes, parts), "ties")
    if not tied.isEmpty():
        found = found.unionAll(within(tied, found, parts, classes, keyed, percent))
        parts = materialize(components(found), "components")
    whole = classes.join(parts, "node", "left").select("class", "low", F.coalesce("component", "node").alias("component"))
    lows = whole.groupBy("component").agg(F.min("low").alias("component_id"))
    named = whole.join(lows, "component").select("class", "component", "component_id")
    out = f.select("doc_id", "text_key", "n_shingles", "class", "rid")
    alone = out.filter("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.col("rid").alias("component"))
    return out.filter("n_shingles > 0").join(named, "class") \
        .select("doc_id", "text_key", "n_shingles", "component_id", "component").unionAll(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """``docs`` with the document of the smallest id of each component (of equal ids, the smallest text key; of
    rows equal in both, one); documents without words stay. Columns stay as they are."""
    n = materialize(near_duplicates(docs, id_col, text_col, percent), "near-groups")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("best")
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    drop = n.filter("n_shingles > 0").join(n.groupBy("component").agg(best), "component") \
        .withColumn("same", same).groupBy("doc_id", "text_key").agg(F.max("same").alias("same"), F.count(F.lit(1)).alias("rows"))
    drop = materialize(drop.filter("NOT same OR rows > 1").select(F.struct("doc_id", "text_key").alias("key"), "same"), "near-drop")
    keyed = packed_rows(docs, key=F.struct(column(docs, id_col).cast("long").alias("doc_id"), F.unhex(
        F.md5(F.coalesce(column(docs, text_col), F.lit("")).cast("binary"))).alias("text_key")))
    out = keyed.join(drop.select("key"), "key", "left_anti").select("_row")
    twins = drop.filter("same")
    if not twins.isEmpty():
        out = out.unionAll(keyed.join(twins.select("key"), "key").groupBy("key").agg(F.first("_row").alias("_row")).select("_row"))
    return out.select("_row.*")
