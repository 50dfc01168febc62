import hashlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from casework.llm import exact_dedup, near_dedup
from tests.llm.conftest import ROWS


def test_misra_gries_keeps_every_frequent_key():
    r = np.random.default_rng(0)
    keys = np.concatenate([np.full(300, 7), np.full(200, 9), r.integers(100, 10_000, 1500)])
    r.shuffle(keys)
    counts = {}
    for part in np.array_split(keys, 13):
        counts = exact_dedup.misra_gries(counts, part, 10)
        assert len(counts) <= 10
    n = len(keys)
    true = Counter(keys.tolist())
    assert {k for k, c in true.items() if c > n / 11} <= set(counts)
    assert all(true[k] - n / 11 <= c <= true[k] for k, c in counts.items())


def test_copy_groups(docs):
    for counters in (1, 1024):  # with and without broadcast winners for most groups
        got = exact_dedup.copy_groups(docs, counters=counters).collect()
        groups = defaultdict(list)
        for i, t, *_ in ROWS:
            groups[t or ""].append(i)
        want = Counter()
        for t, ids in groups.items():
            known = [i for i in ids if i is not None]
            for i in ids:
                want[(i, max(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
        assert Counter((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in got) == want
        kept = Counter(bytes(r.digest).hex() for r in got if r.kept)
        assert set(kept.values()) == {1} and len(kept) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_drop_copies_keeps_columns_and_one_row_each(docs, empty):
    out = exact_dedup.drop_copies(docs)
    assert out.schema == docs.schema
    rows = out.collect()
    assert len(rows) == len({t or "" for _, t, *_ in ROWS})
    assert len({r.text or "" for r in rows}) == len(rows)
    assert exact_dedup.drop_copies(empty).count() == 0 and exact_dedup.copy_groups(empty).count() == 0


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text):
    w = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows, percent=75):
    sets = [brute_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    low = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return [(r[0], len(sets[i]), low[find(i)]) for i, r in enumerate(rows)]


def test_near_duplicates_match_all_pairs(docs, empty):
    got = near_dedup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(ROWS))
    assert near_dedup.near_duplicates(empty).count() == 0


def test_one_of_each(docs):
    out = near_dedup.one_of_each(docs)
    assert out.schema == docs.schema
    want = {(i, c) for i, n, c in brute_components(ROWS) if n and i == c and i is not None}
    got = [r.doc_id for r in out.collect() if r.text and r.text.split() and r.doc_id is not None]
    assert Counter(got) == Counter(i for i, _ in want)


def test_links_between_components_of_one_bucket(spark):
    """A chain of versions: neighbours are linked, the ends are not, and every link counts."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(12):
        for i in range(4):
            words[(k * 17 + i) % 200] = f"v{k}.{i}"
        rows.append((k, " ".join(words)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(d).collect()}
    assert got == {i: c for i, _, c in brute_components(rows)}


def test_ties_in_blocks(spark, monkeypatch):
    """The block search connects every sketch-supported pair across components, with as many rows as members."""
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 62, 8)
    rows = []
    for i in range(40):
        odd = base.copy() if i < 30 else r.integers(0, 1 << 62, 8)
        odd[i % 8] ^= np.int64(1 << (i % 60))
        rows.append((i, odd.tolist()))
    classes = spark.createDataFrame(rows, "node long, odd array<long>")
    buckets = classes.selectExpr("1L AS band", "node", "40L AS n")
    parts = spark.createDataFrame([(i, 0 if i < 20 else i) for i in range(40)], "node long, component long")
    monkeypatch.setattr(near_dedup, "LEFT", 7)
    monkeypatch.setattr(near_dedup, "RIGHT", 5)
    got = near_dedup.between(buckets, classes, parts)
    joined = {x.node: x.component for x in near_dedup.components(got).collect()}
    assert joined == {i: 0 for i in range(30)} or set(joined) == set(range(30)) and len(set(joined.values())) == 1


def test_family_blocks_find_every_link(spark, monkeypatch):
    """Many versions of one text, some linked only through others: components equal those of all pairs."""
    import random
    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(90):
        w = list(base)
        for i in r.sample(range(150), r.choice([1, 2, 4, 6, 9])):
            w[i] = f"x{k}.{i}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(near_dedup, "LEFT", 8)
    monkeypatch.setattr(near_dedup, "RIGHT", 8)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(d).collect()}
    assert got == {i: c for i, _, c in brute_components(rows)}


def test_components(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2)) if a != b] + [(1000 + i, 1001 + i) for i in range(40)]
    got = dict(map(tuple, near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in root}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\t\x0b中x", max_size=60), max_size=6))
def test_words_and_shingles(texts):
    for block in (1 << 20, 16):
        old, near_dedup.BLOCK = near_dedup.BLOCK, block
        try:
            sets = [near_dedup.shingles(w) for w in near_dedup.document_words(texts)]
        finally:
            near_dedup.BLOCK = old
        assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts]
        for a, x in zip(texts, sets):
            for b, y in zip(texts, sets):
                assert len(np.intersect1d(x, y)) == len(brute_set(a) & brute_set(b))


def test_odd_sketch_estimates_similarity():
    r = np.random.default_rng(4)
    for share, low, high in ((0.9, 0.8, 1.0), (0.75, 0.6, 0.88), (0.3, 0.0, 0.5)):
        n = 3000
        both = int(2 * n * share / (1 + share))
        x = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        sets = [np.unique(x[:n]), np.unique(x[n - both:2 * n - both])]
        _, odd = near_dedup.sketches(sets)
        bits = int(np.bitwise_count(odd[0] ^ odd[1]).sum())
        differ = -near_dedup.BITS / 2 * np.log(max(1e-9, 1 - 2 * bits / near_dedup.BITS))
        assert low <= 1 - differ / (2 * near_dedup.BANDS * near_dedup.ROWS) <= high
