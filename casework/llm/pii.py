"""Personal data: patterns with checks, widened by a linear-chain conditional random field over word shapes.

Four base patterns (e-mail, IP address, payment card, phone) are searched in every whole text; matches that fail
their check (octets, Luhn, number of digits) are dropped. The field then reads the stretches of a text that
hold a digit, an @ or a mask (****, XXXX): another chunk between white space is outside by definition, so it cuts the
chain, and decoding each stretch alone is exact Viterbi decoding of the whole text. Its spans are added where
they do not overlap a base span.

The field's features are token shapes (letters, digits with their number, single signs) of a token and its
neighbours, the space before it, whether it lies in a match that failed its check, its place in a card-like
run of groups with a valid check digit inside such a match, and the kind of the nearest telling word before and
after, also outside the stretch (``call``, ``card``, ``order``). It is trained by gradient ascent on a small labelled
table (text, spans as ``kind:start:end,...``); without one, on the table of ``pii_table``, which holds cases outside the
base patterns and hard negatives. An added span must be plausible for its kind (check digit, number of digits).

Defined results: null text counts as empty and has no spans; repeated rows give repeated results; an empty table
gives an empty table; a labelled table without any span adds none; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from casework.llm import pii_table
from casework.llm.common import arrow_batches, column, map_arrow, texts_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
BUCKETS = 4096
STEP = 512
Span = tuple[int, int, int]  # start, end, kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+").match
# a match can only begin at the first digit of a run, so looking behind keeps the search linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile("[0-9@]")
_PART = re.compile(r"[0-9@]|[*•]{4}|(?<![^\W_])[xX]{4}(?![^\W_])")
_CHUNK = re.compile(r"[\w.+-]++ @ [\w-]++(?:\.[\w-]++)+|\S+")
_WORD = re.compile(r"[^\W\d_]+")
#: Telling words by what they announce: phones, cards, other numbers.
CUES = {w: c for c, words in {
    "P": "call phone tel telephone mobile fax ring whatsapp cell telefon teléfono téléphone",
    "C": "card visa mastercard amex paid karte tarjeta carte",
    "N": "order invoice part no isbn page item ticket version serial sku ref id"}.items() for w in words.split()}
#: Groups of digits that cards are written in.
CARDS = frozenset({"16", "15", "14", "19", "4-4-4-4", "4-6-5", "4-6-4", "4-4-4-4-3"})
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part reaches back from an @ to the last match or to a sign it cannot hold."""
    done, at = 0, text.find("@")
    while at >= 0:
        i = at
        while i > done and text[i - 1] in _LOCAL:
            i -= 1
        m = _DOMAIN(text, at + 1) if i < at else None
        if m:
            yield i, m.end()
            done = m.end()
        at = text.find("@", done if m else at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _card(s: str) -> bool:
    d = s.replace(" ", "").replace("-", "")
    return 14 <= len(d) <= 19 and luhn(d)


def _phone(s: str) -> bool:
    return 10 <= sum(c.isdigit() for c in s) <= 15


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """The base spans by start, then kind; and the matches that failed their check."""
    good, bad = [], []
    if "@" in text:
        good += [(i, j, 0) for i, j in emails(text)]
    for kind, pattern, check in ((1, _IP, _octets), (2, _CARD, _card), (3, _PHONE, _phone)):
        for m in pattern.finditer(text):
            if check(m.group()):
                good.append((m.start(), m.end(), kind))
            else:
                bad.append(m.span())
    return sorted(good, key=lambda s: (s[0], s[2])), bad


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring chunks that each hold a digit, an @ or a mask."""
    start = end = -1
    for m in _CHUNK.finditer(text):
        if _PART.search(m.group()):
            if start < 0:
                start = m.start()
            end = m.end()
        elif start >= 0:
            yield start, end
            start = -1
    if start >= 0:
        yield start, end


def _shape(token: str) -> str:
    c = token[0]
    if c.isdigit() and c.isascii():
        return f"d{min(len(token), 20)}"
    if c.isalpha():
        if token in ("xxxx", "XXXX"):
            return "x4"
        return ("A" if token.isupper() else "a") + str(min(len(token), 3))
    return c if c.isascii() else "?"


def card_marks(text: str, at: list[tuple[int, int]], failed: list[bool]) -> list[str]:
    """Per token its place in a run of groups that cards are written in, with a valid check digit, inside a failed match."""
    out, i = ["-"] * len(at), 0
    while i < len(at):
        found, sizes, digits, j = None, [], "", i
        while j < len(at) and failed[j] and text[at[j][0]].isascii() and text[at[j][0]].isdigit():
            digits += text[at[j][0]:at[j][1]]
            if len(digits) > 19:
                break
            sizes.append(str(at[j][1] - at[j][0]))
            form = "-".join(sizes)
            if form in CARDS and luhn(digits):
                found = found or (j + 1, form)
            if j + 2 < len(at) and text[at[j + 1][0]] == "-":
                j += 2
            else:
                j += 1
        if found:
            kind = found[1] + ("i" if text[at[i][0]] in "3456" else "o")
            out[i:found[0]] = ["B" + kind] + ["I" + kind] * (found[0] - i - 1)
            i = found[0]
        else:
            i += 1
    return out


def cues(text: str, at: list[tuple[int, int]], start: int, end: int) -> tuple[list[str], str]:
    """Per token the kind of the nearest telling word before it, and that of the first two words after the stretch."""
    def kind(words: list[str]) -> str:
        return next((CUES[w] for w in words if w in CUES), "?")
    cue, before = kind([w.lower() for w in _WORD.findall(text[max(0, start - 48):start])][:-5:-1]), []
    for i, j in at:
        cue = CUES.get(text[i:j].lower(), cue)
        before.append(cue)
    return before, kind([w.lower() for w in _WORD.findall(text[end:end + 32])][:2])


def tokens(text: str, start: int, end: int, bad: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Tokens of a stretch and the numbers of their features."""
    at = [m.span() for m in _TOKEN.finditer(text, start, end)]
    inside, starts, ends = [False] * len(at), [i for i, _ in at], [j for _, j in at]
    for x, y in bad:
        for k in range(bisect_right(ends, x), bisect_left(starts, y)):
            inside[k] = True
    marks, (before, after) = card_marks(text, at, inside), cues(text, at, start, end)
    shapes = ["^^", "^", *(_shape(text[i:j]) for i, j in at), "$", "$$"]
    rows = []
    for k, (i, j) in enumerate(at):
        two, one, own, nxt, far = shapes[k:k + 5]
        gap = "_" if k and at[k - 1][1] < i else ""
        failed = inside[k]
        rows.append([zlib.crc32(f.encode()) % BUCKETS for f in (
            f"0{own}", f"1{gap}{own}", f"2{one}{gap}{own}", f"3{own}{nxt}", f"4{two}{one}{gap}{own}", f"5{own}{nxt}{far}",
            f"6{one}", f"7{nxt}", f"8{failed}{own[0]}", f"9{failed}",
            f"c{marks[k]}", f"p{before[k]}", f"q{before[k]}{own}", f"r{before[k]}{one}{gap}{own}{nxt}", f"n{after}{own[0]}")])
    return at, np.array(rows, np.int32).reshape(len(at), -1)


class Field:
    """Weights of features by label, of label pairs, and of a stretch's first label."""

    def __init__(self):
        k = len(LABELS)
        self.w, self.t, self.s = np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)
        # an inside label continues its own kind only
        self.allowed = np.array([[not b.startswith("I") or a[1:] == b[1:] for b in LABELS] for a in LABELS])
        self.first = np.array([not b.startswith("I") for b in LABELS])

    def _weights(self):
        return np.where(self.allowed, self.t, -1e4), np.where(self.first, self.s, -1e4)

    @staticmethod
    def _padded(feats: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(f) for f in feats])
        x = np.zeros((len(feats), n.max(), feats[0].shape[1]), np.int32)
        for i, f in enumerate(feats):
            x[i, :len(f)] = f
        return x, n

    def decode(self, feats: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi paths of many stretches, in batches of similar length."""
        out: list[np.ndarray] = [np.empty(0, int)] * len(feats)
        order, at = sorted(range(len(feats)), key=lambda i: len(feats[i])), 0
        trans, first = self._weights()
        while at < len(order):
            to = at + 1
            while to < len(order) and (to + 1 - at) * len(feats[order[to]]) <= 50_000:
                to += 1
            x, n = self._padded([feats[i] for i in order[at:to]])
            score = first + self.w[x[:, 0]].sum(axis=1)
            back = np.zeros((x.shape[1], *score.shape), np.int8)
            for t in range(1, x.shape[1]):
                step = score[:, :, None] + trans
                back[t] = step.argmax(axis=1)
                new = step.max(axis=1) + self.w[x[:, t]].sum(axis=1)
                live = t < n
                score[live] = new[live]
            last = score.argmax(axis=1)
            for i, k in enumerate(order[at:to]):
                path = np.empty(n[i], int)
                path[-1] = last[i]
                for t in range(n[i] - 1, 0, -1):
                    path[t - 1] = back[t, i, path[t]]
                out[k] = path
            at = to
        return out

    def fit(self, feats: list[np.ndarray], labels: list[np.ndarray], rounds: int = 60, rate: float = 0.25, ridge: float = 1e-3) -> Field:
        """Ascent (Adam) on the mean log-likelihood less a ridge; gradients by forward-backward over all stretches."""
        x, n = self._padded(feats)
        size, long = x.shape[:2]
        y = np.zeros((size, long), int)
        for i, l in enumerate(labels):
            y[i, :len(l)] = l
        real = np.arange(long) < n[:, None]
        k, total = len(LABELS), real.sum()
        params = [self.w, self.t, self.s]
        m, q = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        hot = np.eye(k)[y] * real[:, :, None]
        pairs = np.einsum("sta,stb->ab", hot[:, :-1], hot[:, 1:])
        for r in range(1, rounds + 1):
            trans, first = self._weights()
            e = self.w[x].sum(axis=2)
            et = np.exp(trans)
            fwd, scale = np.zeros((long, size, k)), np.zeros((long, size))
            top = e.max(axis=2, keepdims=True)
            e = np.exp(e - top)
            a = np.exp(first) * e[:, 0]
            for t in range(long):
                if t:
                    a = np.where(real[:, t, None], (a @ et) * e[:, t], a)
                scale[t] = a.sum(axis=1)
                a = a / scale[t][:, None]
                fwd[t] = a
            b, expect, edge = np.ones((size, k)), np.zeros((size, long, k)), np.zeros((k, k))
            for t in range(long - 1, -1, -1):
                post = fwd[t] * b
                post /= post.sum(axis=1, keepdims=True)
                expect[:, t] = post * real[:, t, None]
                if t:
                    eb = e[:, t] * b
                    xi = fwd[t - 1][:, :, None] * et * eb[:, None, :]
                    xi /= np.maximum(xi.sum(axis=(1, 2), keepdims=True), 1e-300)
                    edge += (xi * real[:, t, None, None]).sum(axis=0)
                    nb = eb @ et.T
                    nb /= np.maximum(nb.sum(axis=1, keepdims=True), 1e-300)
                    b = np.where(real[:, t, None], nb, b)
            diff = (hot - expect)[real]
            gw = np.zeros_like(self.w)
            for j in range(x.shape[2]):
                np.add.at(gw, x[:, :, j][real], diff)
            grads = [gw / total - ridge * self.w / 10, (pairs - edge) * self.allowed / total - ridge * self.t / 10,
                     (hot[:, 0] - expect[:, 0]).sum(axis=0) * self.first / total - ridge * self.s / 10]
            for p, g, mm, qq in zip(params, grads, m, q):
                mm += 0.1 * (g - mm)
                qq += 0.01 * (g * g - qq)
                p += rate * (mm / (1 - 0.9 ** r)) / (np.sqrt(qq / (1 - 0.99 ** r)) + 1e-9)
        return self


def spans_of(path: np.ndarray, at: list[tuple[int, int]]) -> list[Span]:
    out: list[Span] = []
    for (i, j), label in zip(at, path.tolist()):
        if label % 2 == 1:
            out.append((i, j, label // 2))
        elif label:
            s, _, kind = out.pop()
            out.append((s, j, kind))
    return out


def labels_of(at: list[tuple[int, int]], spans: list[Span]) -> np.ndarray:
    """Labels of tokens from spans; where spans overlap, the first token of either begins one."""
    out = np.zeros(len(at), int)
    for s, e, kind in spans:
        inside = [i for i, (a, b) in enumerate(at) if s <= a and b <= e]
        if inside and not out[inside].any():
            out[inside] = 2 * kind + 2
            out[inside[0]] = 2 * kind + 1
    return out


def parse(spans: str) -> list[Span]:
    return [(int(s), int(e), KINDS.index(k)) for k, s, e in (x.split(":") for x in (spans or "").split(",") if x)]


def join(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], s[2])))


def plausible(text: str, kind: int) -> bool:
    """Whether an added span can be of its kind."""
    if kind == 0:
        local, _, domain = text.replace(" ", "").partition("@")
        return any(c.isalpha() for c in local) and bool(re.fullmatch(r"[\w-]+(\.[\w-]+)*\.[^\W\d_]{2,}", domain))
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and _octets(".".join(parts))
    digits = re.sub("[^0-9]", "", text)
    if kind == 2:
        masked = len(re.sub("[^*•xX]", "", text))
        return 14 <= len(digits) + masked <= 19 and (len(digits) >= 4 and masked >= 6 if masked else luhn(digits))
    return 10 <= len(digits) <= 15


def train(labelled: list[tuple[str, str]], most_tokens: int = 80, most: int = 1500) -> Field | None:
    """Fit on at most ``most`` stretches of at most ``most_tokens`` tokens; None if they hold no span."""
    feats, labels = [], []
    for text, spans in labelled:
        bad = base_spans(text)[1]
        for s, e in stretches(text):
            at, x = tokens(text, s, e, bad)
            if 0 < len(at) <= most_tokens and len(feats) < most:
                feats.append(x)
                labels.append(labels_of(at, [v for v in parse(spans) if s <= v[0] and v[1] <= e]))
    return Field().fit(feats, labels) if any(l.any() for l in labels) else None


@lru_cache(maxsize=1)
def registered_field() -> Field | None:
    """The field of the table kept in the repository; the table is constant, so it is trained once a process."""
    return train(pii_table.rows())


def find(texts: list[str], field: Field | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    out, todo, feats = [], [], []
    for k, text in enumerate(texts):
        if not _SIGN.search(text):
            out.append(([], []))
            continue
        good, bad = base_spans(text)
        out.append((good, []))
        for s, e in stretches(text) if field else ():
            at, x = tokens(text, s, e, [b for b in bad if b[0] < e and s < b[1]])
            if len(at):
                todo.append((k, at))
                feats.append(x)
    for (k, at), path in zip(todo, field.decode(feats) if feats else ()):
        base, more = out[k]
        for s, e, kind in spans_of(path, at):
            if plausible(texts[k][s:e], kind) and not any(a < e and s < b for a, b, _ in base):
                more.append((s, e, kind))
    return out


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def annotate(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_batches(batches, STEP):
            found = find(texts_of(b), field)
            kinds = [[k for _, _, k in base + more] for base, more in found]
            cols = [b.column("doc_id"), *(pa.array([v.count(k) for v in kinds], pa.int64()) for k in range(4)),
                    pa.array([hashlib.sha256(join(base).encode()).hexdigest() for base, _ in found], pa.string()),
                    pa.array([join(base + more) for base, more in found], pa.string()),
                    pa.array([len(more) for _, more in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in RESULT.split(", ")])
    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None,
                  train_rows: int = 800) -> DataFrame:
    """``doc_id``, the number of spans of each kind, a digest of the base spans, all spans, and how many were added."""
    if labelled is not None:
        table = [(r.text or "", r.spans or "") for r in labelled.select("text", "spans").limit(train_rows).collect()]
    else:
        table = None
    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    return map_arrow(d, annotate(registered_field() if table is None else train(table)), RESULT)
