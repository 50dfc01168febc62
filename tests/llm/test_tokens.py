import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from casework.llm import orc_ids, packing
from casework.llm.tokens import Encoder
from tests.llm.conftest import ROWS

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ENC = {p: Encoder(p, spaced, units=200) for p, spaced in ((BYTE, True), (WORD, False))}


def plain(path, text):
    return ENC[path].tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\tabAB.,!'’sé ́ΣİßǅΑ中0​\x1c<|>", max_size=60)))
def test_ids_equal_the_library(path, text):
    assert np.frombuffer(ENC[path].encode(text), "<u4").tolist() == plain(path, text)


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("text", ["", " ", "a  b ", "a\n b", "x\t\ty  z\n\n", " lead", "don't I'll 's", "a<|endoftext|>b", "A.B,c!! d--e 12ab", "İ Σας"])
def test_ids_of_awkward_texts(path, text):
    for _ in range(2):  # from the library, then from memory
        assert np.frombuffer(ENC[path].encode(text), "<u4").tolist() == plain(path, text)


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|>", "one <|endoftext|> two  three", "é<|endoftext|> 中<|startoftext|>x", "A<|ENDOFTEXT|>b",
                                  "a<|EndOfText|> <|endoftext|>", "<|endoftext |> <|endoftext", "a\n<|startoftext|>\n b"])
def test_added_tokens_in_a_text_as_in_a_fresh_tokenizer(path, text):
    fresh = Tokenizer.from_file(path)
    for t in (text, text + " x", "don't " + text):
        for _ in range(2):
            assert np.frombuffer(ENC[path].encode(t), "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids


def test_one_id_for_an_added_token(spark):
    d = spark.createDataFrame([(1, "a<|endoftext|>b"), (2, "c")], "doc_id long, text string")
    got = {r.doc_id: r for r in orc_ids.round_trip(d, BYTE).collect()}
    assert got[1].n_tokens == 4 and got[2].start == 4  # 64, 50256, 65 and the end
    assert [r.length for r in packing.packed(d, WORD).collect() if r.doc_id == 1] == [4]


def test_orc_round_trip(spark, docs, empty, tmp_path):
    out = orc_ids.write_ids(docs, str(tmp_path / "ids"), BYTE)
    rows = orc_ids.read_ids(spark, out).collect()
    assert len(rows) == len(ROWS)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    want = Counter((i, tuple(plain(BYTE, t or "")) + (2,)) for i, t, *_ in ROWS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    crc = orc_ids.id_digests(spark, out).collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in crc) == Counter((i, zlib.crc32(np.array(x, "<u4").tobytes())) for (i, x), n in want.items() for _ in range(n))
    assert orc_ids.round_trip(empty, BYTE).count() == 0


def test_orc_lookup_pushes_the_filter_down(spark, docs, tmp_path, capsys):
    out = orc_ids.write_ids(docs, str(tmp_path / "ids"), BYTE)
    found = orc_ids.lookup(spark, out, [3, 500])
    assert sorted(r.doc_id for r in found.collect()) == [3, 500]
    found.explain()
    assert "PushedFilters: [In(doc_id" in capsys.readouterr().out


def histogram(lengths):
    return dict(Counter(lengths))


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_up_the_histogram(seed):
    r = np.random.default_rng(seed)
    lengths = np.clip((r.lognormal(6, 1.2, 3000)).astype(int) + 1, 1, 4096).tolist() + [4096] * 40 + [1] * 200
    h = histogram(lengths)
    p = packing.plan(h)
    used = Counter()
    for ls, n in p:
        assert sum(ls) <= 4096 and n > 0
        for x in ls:
            used[x] += n
    assert used == Counter(h)
    assert sum(n for _, n in p) <= 1.01 * sum(lengths) / 4096 + 1


def test_plan_of_few_and_of_none():
    assert packing.plan({}) == []
    assert packing.plan({4096: 3}) == [((4096,), 3)]
    assert sorted(packing.plan({2000: 1, 2097: 1})) == [((2000,), 1), ((2097,), 1)]


def test_non_negative_fit():
    r = np.random.default_rng(0)
    a, x = r.random((20, 8)), np.array([0, 1, 2, 0, 0, 3, 0.5, 0])
    assert np.allclose(packing.non_negative_fit(a, a @ x), x, atol=1e-6)
    s = packing.non_negative_fit(a, r.normal(size=20))
    assert (s >= 0).all()


def test_packed(docs, empty):
    got = packing.packed(docs, WORD).collect()
    want = Counter()
    for i, t, *_ in ROWS:
        ids = plain(WORD, t or "") + [1]
        for k in range(0, len(ids), 4096):
            x = ids[k:k + 4096]
            want[i, k // 4096, k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.packed(empty, WORD).count() == 0


def test_plain_texts_by_their_pre_tokens():
    import random
    from casework.llm import tokens
    r, enc, flat = random.Random(2), Encoder(BYTE, True, units=500), 0
    fresh = Tokenizer.from_file(BYTE)
    for _ in range(4000):
        text = "".join(r.choice("aabcdZéßÿ×÷0123  '''\"!,.-_~`|{}[]\\/:;<=>?@#$%^&*()+\n\t  'sre") for _ in range(r.randrange(24)))
        flat += bool(tokens._FLAT(text))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids
    assert flat > 2000
