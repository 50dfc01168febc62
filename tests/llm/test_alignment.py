"""Cross-tokenizer alignment against a brute-force version that encodes whole texts with the libraries."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
from tests.conftest import SF_SMALL

from casework.llm import alignment as al
from casework.llm.queries import QUERIES

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [None, "", "a", "  a  b ", "\ta\n b", "▁x", "a▁ b", "ﬁ é é", "<s>a</s><|endoftext|> <0x41>", "日本\U0001F600", " ", "  ", "a\x00b", "a\xa0 b",
       "x" * 5000, " \n ", "<unk>", "​ a", "᠎ a b", "12 345 67", "it's we'll I'D", "a" * 70 + " b", "a \n\n b\r\n c ", "½ ² ①", "퟿ ￿", "word " * 3000,
       "é ́x", "İ ǅ ﬀ", "<|endoftext|>", "  x", "tab\t\tx", "\x1c y", "\x85 z", "ẞ \U0001e030 x"]


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def aligned(plain, text):
    """n_a, n_b, groups text and links of one text, by whole encodings and dictionaries of ends."""
    a, b = plain
    if not text:
        return 0, 0, "", []
    whole = (" " + text).encode()
    back = {v: k for k, v in al.byte_symbols().items()}
    ta = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    tb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if b"".join(x for _, x in ta) != whole or b"".join(x for _, x in tb) != whole:
        return 0, 0, "", []

    def ends(tokens):
        out, at = {}, 0
        for k, (_, raw) in enumerate(tokens):
            at += len(raw)
            out[at] = k
        return out
    ea, eb, groups, links, pa, pb = ends(ta), ends(tb), [], [], 0, 0
    for e in sorted(ea.keys() & eb.keys()):
        groups.append(",".join(str(i) for i, _ in ta[pa:ea[e] + 1]) + "|" + ",".join(str(i) for i, _ in tb[pb:eb[e] + 1]))
        links.append((ta[ea[e]][0], tb[eb[e]][0]))
        pa, pb = ea[e] + 1, eb[e] + 1
    return len(ta), len(tb), ";".join(groups), links


def expected(plain, rows):
    parts = [(i, *aligned(plain, t)) for i, t in rows]
    count = Counter(x for p in parts for x in p[4])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(((i, na, nb, len(links), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(g.encode()).hexdigest() if g else "") for i, na, nb, g, links in parts), key=repr)


def rows_of(df):
    names = [c.split()[0] for c in al.RESULT.split(", ")]
    return sorted((tuple(r[c] for c in names) for r in df.select(*names).collect()), key=repr)


def test_query_is_brute_force_on_the_whole_table(spark, plain):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert rows_of(QUERIES["op13_alignment"](spark, SF_SMALL)) == expected(plain, docs)


@pytest.mark.parametrize("hot", [1 << 20, 40, 0])
def test_odd_texts_and_every_share_of_broadcast_pairs(spark, plain, hot):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(ODD)] + [(2, "a"), (2, "a")]
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "doc_id long, text string, links string, row int, `a.b` int").repartition(3)
    assert rows_of(al.alignment(df, A, B, hot_pairs=hot)) == expected(plain, rows)


def test_memory_of_units_does_not_change_results(monkeypatch, plain):
    import pyarrow as pa
    monkeypatch.setattr(al, "UNITS", 3)
    p = al.Pair(A, B)
    for _ in range(2):
        for t in ["one two three four", "five  six\n seven", "one " + "long" * 40 + " two", "four six"]:
            n_a, n_b, n, digest, pairs, _ = al.align_texts(p, pa.array([t]))
            na, nb, g, links = aligned(plain, t)
            assert (n_a[0], n_b[0], n[0], digest[0]) == (na, nb, len(links), hashlib.sha256(g.encode()).hexdigest())
            assert pairs.tolist() == [a * len(p.bytes_b) + b for a, b in links]


def test_empty_table(spark):
    df = al.alignment(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert df.columns == [c.split()[0] for c in al.RESULT.split(", ")] and df.count() == 0
