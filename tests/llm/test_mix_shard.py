import re
from collections import defaultdict

import pytest

from casework.llm import mixing, sharding
from tests.llm.conftest import ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights, share=1.5, epochs=2.0):
    """Water-filling by repeated rounds over plain dictionaries."""
    pool, done = share * sum(sizes.values()), {}
    while True:
        left, open_ = pool - sum(done.values()), [s for s in sizes if s not in done]
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w >= epochs * sizes[s]]
        if not over:
            return done | {s: left * weights[s] / w for s in open_}
        done |= {s: epochs * sizes[s] for s in over}


def test_mixture(docs, empty):
    got = mixing.mixture(docs).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in ROWS:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(s for s in sizes if s is not None) + [None]
    want = targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = defaultdict(int)
    assert len(got) == len(ROWS)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == round(want[s])
    again = mixing.mixture(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mixture(empty).count() == 0


def test_whole_documents_and_mixed_rows(docs, empty):
    plan = mixing.mixture(docs, whole_documents=True).collect()
    assert all(r.taken in (0, r.size, 2 * r.size) for r in plan)
    out = mixing.mixed(docs)
    assert out.schema == docs.schema
    rows = out.collect()
    assert sum(len(WORD.findall(r.text or "")) for r in rows) == sum(r.taken for r in plan)
    assert mixing.mixed(empty).count() == 0


def test_water_fill_all_clamped(spark):
    s = spark.createDataFrame([(1.0, 10), (5.0, 20), (1.0, 0)], "weight double, source_size long")
    assert sorted(r.target for r in mixing.water_fill(s, 3.0, 2.0).collect()) == [0.0, 20.0, 40.0]


def fits(rows, limit):
    """Buckets by splitting one bit at a time."""
    out, todo = {}, [("", rows)]
    while todo:
        name, part = todo.pop()
        if sum(b for _, b in part) <= limit or len({k for k, _ in part}) == 1:
            for k, _ in part:
                out[k] = name
        else:
            for bit in "01":
                todo.append((name + bit, [(k, b) for k, b in part if k[len(name)] == bit]))
    return out


@pytest.mark.parametrize("limit", [700, 5000, 10_000_000])
def test_shards(docs, empty, limit):
    import hashlib
    got = sharding.shards(docs, limit).collect()
    keyed = []
    for i, t, *_ in ROWS:
        h = hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15]
        keyed.append((bin(int(h, 16))[2:].zfill(60), len((t or "").encode())))
    want = sorted((fits(keyed, limit)[k], b) for k, b in keyed)
    assert sorted((r.shard.split("-")[0], r.n_bytes) for r in got) == want
    sums = defaultdict(int)
    for r in got:
        sums[r.shard] += r.n_bytes
    for r in got:
        assert r.shard_bytes == sums[r.shard]
        assert r.shard_bytes <= limit or r.shard_bytes == r.n_bytes
    assert sharding.shards(empty).count() == 0


def test_copies_go_to_overflow_pages(spark):
    d = spark.createDataFrame([(1, "x" * 100)] * 25 + [(2, "y")], "doc_id long, text string").coalesce(1)
    got = sharding.shards(d, 1000).collect()
    sums = defaultdict(int)
    for r in got:
        sums[r.shard] += r.n_bytes
    assert len(got) == 26 and max(sums.values()) <= 1000


def test_write_shards(spark, docs, tmp_path):
    path = sharding.write_shards(docs.select("doc_id", "text", "lang", "kept"), str(tmp_path / "s"), 5000)
    back = spark.read.parquet(path)
    assert back.count() == len(ROWS) and back.select("shard").distinct().count() > 3
