"""Consistent weighted sampling: estimates against the exact generalised Jaccard similarity, edits against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from tests.conftest import SF_SMALL

from casework.llm import fingerprints as fp
from casework.llm.queries import QUERIES


def weights(text):
    w = ["", "", *(p for x in re.findall(r"[^\x20\x09-\x0D]+", text)
                   for p in (x.encode()[i:i + fp.PIECE] for i in range(0, len(x.encode()), fp.PIECE)))]
    return Counter(zip(w, w[1:], w[2:]))


def jaccard(a, b):
    a, b = weights(a), weights(b)
    both = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in both) / sum(max(a[k], b[k]) for k in both) if both else 1.0


def signed(*texts, samples=1024):
    return fp._signed([t.encode() for t in texts], samples)


def test_collision_rate_is_generalised_jaccard():
    r, errors = random.Random(4), []
    for trial in range(60):
        words = [f"w{i}" for i in range(r.choice([2, 3, 5, 300]))]  # few words: heavy weights
        a = [r.choice(words) for _ in range(r.choice([5, 40, 400]))]
        b = list(a)
        for _ in range(r.randrange(1 + len(a) // 2)):
            b[r.randrange(len(b))] = r.choice(words)
        if trial % 3 == 0:
            b = b * r.choice([2, 5])
        s = signed(" ".join(a), " ".join(b))
        errors.append((s[0] == s[1]).mean() - jaccard(" ".join(a), " ".join(b)))
    assert abs(np.mean(errors)) < 0.006 and np.max(np.abs(errors)) < 0.075


def test_samples_do_not_depend_on_the_batch():
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefg") * r.randrange(1, 4) for _ in range(r.choice([0, 1, 2, 50, 3000]))) for _ in range(40)]
    texts += ["", " \n", "x" * 1000, "x" * 33 + " " + "x", "é" * 40, "ends with space ", " starts"]
    whole = signed(*texts, samples=64)
    alone = np.concatenate([signed(t, samples=64) for t in texts])
    assert (whole == alone).all()
    assert (signed("", " \t")[0] == 0).all() and (signed("a")[0] > 0).all()


def expected(rows):
    """(doc_id, n_chars, edited text) of rows ordered by id."""
    out = []
    for i, (d, t) in enumerate(rows):
        t, u = t or "", rows[(i + 1) % len(rows)][1] or ""
        out.append((d, len(t), t[:len(t) - len(t) // 4] + u[:len(t) // 4], t, u))
    return out


def check(got, want, samples=fp.SAMPLES):
    got = {r["doc_id"]: r for r in got}
    assert len(got) == len(want)
    for d, n, edited, text, following in want:
        r, (s, e, f) = got[d], signed(text, edited, following, samples=samples)
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == s.astype(">u2").tobytes().hex() and r["edited_fingerprint"] == e.astype(">u2").tobytes().hex()
        assert r["near_edited"] == pytest.approx((s == e).mean()) and r["near_next"] == pytest.approx((s == f).mean())


def test_query_on_the_whole_table(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    got = QUERIES["op11_fingerprints"](spark, SF_SMALL).collect()
    want = expected(docs)
    check(got, want)
    err = [r["near_edited"] - jaccard(w[3], w[2]) for r, w in zip(sorted(got, key=lambda r: r["doc_id"]), want)]
    assert abs(np.mean(err)) < 0.02 and np.max(np.abs(err)) < 0.25
    long = [r for r, w in zip(sorted(got, key=lambda r: r["doc_id"]), want) if len(w[3]) > 400 and w[3] != w[4]]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.97


@pytest.mark.parametrize("parts", [1, 7])
def test_odd_texts_and_partition_borders(spark, parts, monkeypatch):
    texts = [None, "", "a", "é" * 9, "\U0001F600 \U0001F600 b c d e", " \n", "word " * 2000, "x" * 9000, "a b c d", "a b c d", "none", "ab", "abc",
             "abcd e", "tab\tseparated\x0bwords", "\xa0 is a word"]
    rows = [(None if i == 0 else 10 * i, t) for i, t in enumerate(texts)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, sig string, part int").repartition(3)
        check(fp.edited_likeness(df, 32).collect(), expected(rows), 32)
        one = fp.edited_likeness(df.filter("doc_id = 80"), 32).collect()
        check(one, expected([(80, "a b c d")]), 32)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_empty_table_and_plain_fingerprints(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fp.edited_likeness(empty).count() == 0 and fp.fingerprints(empty).count() == 0
    rows = [(1, "one two three four"), (1, "one two three four"), (2, None), (3, "one two three five")]
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 64)
    f = {r["doc_id"]: r["fingerprint"] for r in got.collect()}
    assert got.count() == 4 and f[2] == "0000" * 64 and f[1] == signed("one two three four", samples=64)[0].astype(">u2").tobytes().hex()
    from pyspark.sql import functions as F
    like = spark.range(1).select(fp.likeness(F.lit(f[1]), F.lit(f[3])).alias("x")).first()["x"]
    a, b = signed("one two three four", "one two three five", samples=64)
    assert like == pytest.approx((a == b).mean())
