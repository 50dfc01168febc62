import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casework.llm import lang_id, pii, resampling, topk
from tests.conftest import SF_SMALL
from tests.llm.conftest import ROWS

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(text):
    ok = (lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")),
          lambda s: 14 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(d), lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15)
    return sorted(((m.start(), m.end(), k) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if ok[k](m.group())),
                  key=lambda s: (s[0], s[2]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@+- 29(_%5é", max_size=50))
def test_base_spans(text):
    assert pii.base_spans(text)[0] == brute_spans(text)


def test_long_runs_stay_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1.1." * 80_000, "+1" * 100_000, "a@" * 100_000):
        pii.base_spans(t)


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    f = pii.Field()
    f.w, f.t, f.s = (r.normal(size=x.shape) for x in (f.w, f.t, f.s))
    x = r.integers(0, pii.BUCKETS, (4, 3))
    trans, first = f._weights()
    e, k = f.w[x].sum(axis=1), len(pii.LABELS)
    paths = [(first[a] + e[0, a] + trans[a, b] + e[1, b] + trans[b, c] + e[2, c] + trans[c, d] + e[3, d], (a, b, c, d))
             for a in range(k) for b in range(k) for c in range(k) for d in range(k)]
    assert tuple(f.decode([x, x[:1]])[0]) == max(paths)[1]


def test_field_learns_and_adds_spans(spark):
    table = [(f"call (98{i % 10}) 555-24{10 + i} or write to bo.{i}@mail.org, version {i}.0 of 3 items",
              f"phone:5:19,email:{32}:{len(f'call (98{i % 10}) 555-24{10 + i} or write to bo.{i}@mail.org')}") for i in range(40)]
    labelled = spark.createDataFrame(table, "text string, spans string")
    d = spark.createDataFrame([(1, "call (123) 555-9988 now"), (2, "clean text, version 7.0 of 3 items"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(d, labelled=labelled).collect()}
    assert got[1].spans == "phone:5:19" and got[1].n_added == 1 and got[1].n_phone == 1
    assert [got[i].spans for i in (2, 3, 4)] == ["", "", ""]
    assert got[3].base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_registered_field_adds_cases_outside_the_base_patterns(spark):
    cards = "4465758382889437", "4111 1111 1111 1111", "5500005555555559"
    found = {1: f"total {cards[0]} {cards[0]} ramiar", 2: f"paid {cards[1]} {cards[2]} then left", 3: "call us at 555-123-4567 today",
             4: "phone: 030 12345678, then", 5: "visa 4111 **** **** 1111 used", 6: "write bo @ mail.org now"}
    want = {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (3, 1), 5: (2, 1), 6: (0, 1)}
    clean = {20: "order 555-123-4567 came", 21: "in 1990 1991 1992 1993 1994 1995 it rose", 22: "it was 4465758382889438 4465758382889438 once",
             23: "12 @ 3.50 each", 24: "rated ***** 5 of 5", 25: "page 123 456 7890", 26: "10.5 20.5 30.5 40.5 50.5", 27: "call 911 now", 28: ""}
    d = spark.createDataFrame(list((found | clean).items()), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(d).collect()}
    assert {i: (k, got[i][f"n_{pii.KINDS[k]}"]) for i, (k, _) in want.items()} == want
    assert got[1].spans == "card:6:22,card:23:39" and got[1].n_added == 2
    assert [got[i].spans for i in clean] == [""] * len(clean)


def test_personal_data_of_the_tables(spark, docs, empty):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r.doc_id: r.spans for r in pii.personal_data(d).collect()}
    for r in d.collect():
        assert set(filter(None, pii.join(brute_spans(r.text)).split(","))) <= set(filter(None, got[r.doc_id].split(",")))
    assert pii.personal_data(docs).count() == len(ROWS) and pii.personal_data(empty).count() == 0


def test_gradients_by_differences():
    r = np.random.default_rng(0)
    net = lang_id.Network(["a", "b", "c"], hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, n, y = r.integers(0, 256, (lang_id.WINDOW, 5)), np.array([64, 40, 64, 1, 9]), np.array([0, 1, 2, 0, 1])

    def loss():
        p = net.probabilities(net.states(x, n, "f").astype(float), net.states(x, n, "b").astype(float))
        m = np.arange(lang_id.WINDOW)[:, None] < n
        return -(np.log(p[:, y, np.arange(5)]) * m).sum() / m.sum()
    grad = net.gradients(x, n, y)
    for k, at in (("Uf", (1, 2)), ("Uf", (7, 1)), ("Ub", (4, 0)), ("Eb", (8, x[3, 0])), ("Ef", (5, x[5, 0])), ("V", (1, 4)), ("c", (0, 0))):
        net.w[k][at] += 1e-2
        up = loss()
        net.w[k][at] -= 2e-2
        down = loss()
        net.w[k][at] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(grad[k][at], rel=0.02, abs=2e-5)


def test_padding_plays_no_part():
    net = lang_id.Network(["a", "b"])
    short, long = net.documents([b"hello"]), net.documents([b"hello", b"x" * 500])
    assert np.allclose(short[0], long[0], atol=1e-6) and np.allclose(long.sum(axis=1), 1, atol=1e-5)
    assert len(net.positions("héllo " * 30)) == len(("héllo " * 30).encode())


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in lang_id.languages(d).collect()}
    held = [(r.lang, got[r.doc_id]) for r in d.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(g.held_out and 0 <= g.score <= 1 for _, g in held) and sum(g.held_out for g in got.values()) == len(held)
    assert sum(l == g.lang_pred for l, g in held) / len(held) > 0.97


def test_language_of_awkward_rows(spark, docs, empty):
    net = lang_id.train(docs, steps=30)
    assert net.langs == ["de", "en", "fr"] or net.langs == ["en", "fr"]
    got = lang_id.languages(docs, steps=30).collect()
    und = Counter(r.doc_id for r in got if r.lang_pred == "und")
    assert und == Counter(i for i, t, *_ in ROWS if not any(unicodedata.category(c)[0] == "L" for c in t or ""))
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    kept = lang_id.known_language(docs, steps=30, least=0.0)
    assert kept.schema == docs.schema and kept.count() == len(ROWS) - sum(und.values())
    assert lang_id.languages(empty).count() == 0
    signs = spark.createDataFrame([(1, "½ ² ①"), (2, "Ⅷ ٣ 12"), (3, "² x"), (4, "ª"), (5, "日")], "doc_id long, text string")
    predict = lang_id.predictor(net)
    assert [r.p.lang == "und" for r in signs.select(predict("text").alias("p")).collect()] == [True, True, False, False, False]
    bare = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")  # nothing to learn from: texts with letters stay
    assert lang_id.known_language(bare).count() == len(ROWS) - sum(und.values())
    assert {r.lang_pred for r in lang_id.languages(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def brute_top(rows, k=5):
    """Sorted results; every row that takes part is a candidate, and each row of a query's id a query of its own."""
    vectors = [(i, [math.floor(256 * c) for c in x]) for i, x in rows
               if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for q, w in vectors:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in vectors if i != q)
            out += [(q, r + 1, i, -t) for r, (t, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 30.0])
def test_top_k_equals_brute_force(spark, spread):
    from pyspark.sql import functions as F
    r = np.random.default_rng(5)
    x = r.normal(size=(700, 24)) * np.linspace(spread, 0.1, 24) * r.lognormal(0, 0.7, (700, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[7][1]) for i in range(20)]  # ties
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 24), (2150, [float("inf")] + [0.0] * 23), (None, rows[0][1]),
             (3000, [1.0, 2.0]), (3050, []), (50, rows[50][1]), (50, rows[51][1]), (7, rows[8][1]), (7, rows[7][1])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("norm", F.lit(1)).repartition(4)
    for part in (65536, 40):
        got = topk.top_k(d, F.col("id") % 50 == 0, part_rows=part, seeds=16)
        assert sorted(tuple(x) for x in got.collect()) == brute_top(rows)


def test_top_k_of_repeated_ids_and_too_long_vectors(spark):
    from pyspark.sql import functions as F
    rows = [(0, [1.0]), (1, [2.0]), (1, [1.0]), (2, [0.5])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in topk.top_k(d, F.col("id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 131072), (0, 2, 1, 65536), (0, 3, 2, 32768)]
    with pytest.raises(ValueError, match="64-bit"):
        topk.top_k(d.unionAll(spark.createDataFrame([(3, [1e300])], d.schema)), F.col("id") % 50 == 0)


def test_top_k_of_many_files_in_few_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F
    # long vectors make small files (one component each), which a task reads after the large files of short ones
    r = np.random.default_rng(11)
    size = np.sort(r.lognormal(0, 2, 2400))
    x = r.normal(size=(2400, 24)) / 24 ** 0.5 * size[:, None]
    for i in range(1200, 2400):
        x[i] = np.eye(24)[r.integers(24)] * r.choice([-1, 1]) * size[i]
    rows = [(i, v.tolist()) for i, v in zip(r.permutation(2400).tolist(), x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    monkeypatch.setattr(topk, "BLOCK", 64)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(tuple(t) for t in topk.top_k(d, F.col("id") % 50 == 0, seeds=16).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert got == brute_top(rows)


def test_top_k_of_few_and_large(spark):
    from pyspark.sql import functions as F
    d = spark.createDataFrame([(0, [3e5, 1.0]), (1, [2e7, -5.0]), (2, [1.5, 2.5])], "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in topk.top_k(d, F.col("id") % 50 == 0).collect())
    assert got == brute_top([tuple(r) for r in d.collect()])
    assert topk.top_k(d.limit(0), F.col("id") % 50 == 0).count() == 0


def test_resampling(spark, docs, empty):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in resampling.resample(d, l).collect()}
    q = {r.doc_id: r.quality for r in l.collect()}
    kept = sum(r.kept for r in got.values())
    assert kept == round(len(got) * sum(q.values()) / len(q))
    assert min(r.gumbel_key for r in got.values() if r.kept) >= max(r.gumbel_key for r in got.values() if not r.kept)
    good = [got[i].kept for i, v in q.items() if v == 1 and i in got]
    bad = [got[i].kept for i, v in q.items() if v == 0 and i in got]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.4
    # log weights by plain counting
    from casework.llm.near_dedup import document_words
    rows = d.collect()
    grams = {r.doc_id: resampling.n_grams(w) for r, w in zip(rows, document_words([r.text for r in rows]))}
    raw, target = np.zeros(resampling.BUCKETS), np.zeros(resampling.BUCKETS)
    for i, g in grams.items():
        np.add.at(raw, g, 1)
        if q.get(i) == 1:
            np.add.at(target, g, 1)
    ratio = np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    assert all(got[i].log_weight == pytest.approx(ratio[g].sum()) for i, g in grams.items())


def test_resampling_of_awkward_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (400, None)], "doc_id long, quality int")
    got = resampling.resample(docs, labels).collect()
    assert len(got) == len(ROWS) and sum(r.kept for r in got) == round(len(ROWS) / 2)
    assert all(r.log_weight == 0 for r in got if r.doc_id in (300, 301, 302))
    assert resampling.resample(empty, labels).count() == 0
    assert all(r.kept for r in resampling.resample(docs, labels.limit(0)).collect())
