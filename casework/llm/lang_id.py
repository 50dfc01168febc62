"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in windows of WINDOW bytes, forwards and backwards, and gives each
position a probability for each language. A document's probabilities are the mean over all its positions. It
is trained here, in numpy, by back-propagation through time on windows of a bounded sample of labelled
documents: per language the ``train_rows`` / languages documents of smallest seeded hash, and of each a
stretch of at most STRETCH characters. Prediction reads every byte of every text.

Defined results: a null text, or one without letters, is ``und`` with score 0; without labelled rows every text
is ``und``; a null id counts as an empty string in the split; documents with a null language are not learned
from; ties go to the language that sorts first; other columns play no part; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casework.llm.common import column, ship_package

HIDDEN = 8
WINDOW = 64
STRETCH = 4096
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether any character is of a letter category; number forms, superscripts and circled digits are not."""
    return any(map(str.isalpha, text))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in rows of WINDOW bytes, the bytes used in each row, and each row's text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    rows = -(-sizes // WINDOW)
    out = np.zeros(int(rows.sum()) * WINDOW, np.uint8)
    at = (np.cumsum(rows) - rows) * WINDOW
    for i, t in zip(at.tolist(), texts):
        out[i:i + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), rows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
    return out.reshape(-1, WINDOW), np.minimum(sizes[owner] - place * WINDOW, WINDOW), owner


class Network:
    """Weights per direction: ``E`` byte to gates (3H, 256), ``U`` state to gates (3H, H); ``V`` and ``c`` both
    states to languages. Gate rows are reset, update, candidate; states are columns. A window's state starts at
    zero, and padding behind a text's end never touches its positions: forwards it comes after them, backwards
    the state is held at zero until the last byte."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        f = np.float32
        self.w = {f"E{d}": r.normal(0, 0.3, (3 * hidden, 256)).astype(f) for d in "fb"}
        self.w |= {f"U{d}": r.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(f) for d in "fb"}
        self.w |= {"V": r.normal(0, 0.3, (len(langs), 2 * hidden)).astype(f), "c": np.zeros((len(langs), 1), f)}

    def states(self, x: np.ndarray, n: np.ndarray, d: str, keep: bool = False):
        """States at each position (WINDOW, H, rows) of bytes ``x`` (WINDOW, rows); with ``keep`` also the gates."""
        h2, hid = 2 * self.hidden, self.hidden
        e, u = self.w["E" + d].copy(), self.w["U" + d].copy()
        e[:h2] *= 0.5  # sigmoid(v) = tanh(v / 2) / 2 + 1 / 2
        u[:h2] *= 0.5
        steps, rows = x.shape
        out, h = np.empty((steps, hid, rows), np.float32), np.zeros((hid, rows), np.float32)
        kept = []
        full = bool((n == steps).all())
        for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
            g, b = u @ h, e.take(x[t], axis=1)
            s = g[:h2]
            s += b[:h2]
            np.tanh(s, out=s)
            s *= 0.5
            s += 0.5
            c = g[h2:] * s[:hid]
            c += b[h2:]
            np.tanh(c, out=c)
            if keep:
                kept.append((t, h, s, c, g[h2:]))
            new = c - h
            new *= s[hid:]
            new += h
            if d == "b" and not full:
                new *= t < n
            h = out[t] = new
        return (out, kept) if keep else out

    def probabilities(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(WINDOW, languages, rows) from both directions' states."""
        p = self.w["V"][:, :self.hidden] @ f
        p += self.w["V"][:, self.hidden:] @ b
        p += self.w["c"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def label(self, rows: np.ndarray, n: np.ndarray, step: int = 1024) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Position probabilities of blocks of windows, with the mask of real positions."""
        for at in range(0, len(rows), step):
            x, k = np.ascontiguousarray(rows[at:at + step].T), n[at:at + step]
            p = self.probabilities(self.states(x, k, "f"), self.states(x, k, "b"))
            yield slice(at, at + step), p, np.arange(WINDOW)[:, None] < k

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Pooled probabilities (texts, languages)."""
        rows, n, owner = windows(texts)
        total = np.zeros((len(texts), len(self.langs)))
        for at, p, real in self.label(rows, n):
            if not real.all():
                p *= real[:, None, :]
            np.add.at(total, owner[at], p.sum(axis=0).T)
        return total / np.maximum([[len(t)] for t in texts], 1)

    def positions(self, text: str) -> list[str]:
        """The label of every byte of one text."""
        rows, n, _ = windows([text.encode("utf-8", "surrogatepass")])
        return [self.langs[i] for _, p, real in self.label(rows, n) for i in p.argmax(axis=1).T[real.T]]

    def gradients(self, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over all positions, through time."""
        hid, h2 = self.hidden, 2 * self.hidden
        sides = {d: self.states(x, n, d, keep=True) for d in "fb"}
        p = self.probabilities(sides["f"][0], sides["b"][0])
        real = (np.arange(WINDOW)[:, None] < n).astype(np.float32)
        p[:, y, np.arange(len(y))] -= 1
        p *= (real / real.sum())[:, None, :]
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["c"] = p.sum(axis=(0, 2))[:, None]
        for i, d in enumerate("fb"):
            out, kept = sides[d]
            v = self.w["V"][:, i * hid:(i + 1) * hid]
            grad["V"][:, i * hid:(i + 1) * hid] = np.einsum("tcr,thr->ch", p, out)
            u, ge, later = self.w["U" + d], grad["E" + d], np.zeros_like(out[0])
            for t, h, s, c, gc in reversed(kept):
                dh = later + v.T @ p[t]
                if d == "b":
                    dh *= t < n
                z, r = s[hid:], s[:hid]
                dc = dh * z * (1 - c * c)
                dg = np.concatenate([dc * gc * r * (1 - r), dh * (c - h) * z * (1 - z), dc * r])
                later = dh * (1 - z) + u.T @ dg
                grad["U" + d] += dg @ h.T
                dg[h2:] = dc  # the input's share of the candidate is not gated
                order = np.argsort(x[t], kind="stable")
                bytes_, first = np.unique(x[t][order], return_index=True)
                ge[:, bytes_] += np.add.reduceat(dg[:, order], first, axis=1)
        return grad

    def fit(self, rows: np.ndarray, n: np.ndarray, y: np.ndarray, steps: int = 250, size: int = 256, rate: float = 0.02, seed: int = 7) -> Network:
        """Adam on seeded batches that draw every language alike."""
        r = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        q = {k: np.zeros_like(v) for k, v in self.w.items()}
        for t in range(1, steps + 1):
            pick = np.concatenate([r.choice(b, -(-size // len(by))) for b in by if len(b)])
            g = self.gradients(np.ascontiguousarray(rows[pick].T), n[pick], y[pick])
            step = rate * min(1.0, 2 * (1 - t / (steps + 1)))
            for k, v in self.w.items():
                m[k] += 0.1 * (g[k] - m[k])
                q[k] += 0.01 * (g[k] * g[k] - q[k])
                v -= step * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(q[k] / (1 - 0.99 ** t)) + 1e-8)
        return self


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3; documents of remainder 1 are held out of training."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 1600,
          steps: int = 250, seed: int = 7) -> Network | None:
    """Fit on at most ``train_rows`` documents (at least 8 a language) that are not held out; None without any."""
    text, lang = column(docs, text_col), column(docs, lang_col).cast("string")
    rows = docs.filter(fold(column(docs, id_col)) != 1).filter(lang.isNotNull() & text.rlike(r"\p{L}")) \
        .select(lang.alias("lang"), text.alias("text"), F.xxhash64(F.lit(seed), column(docs, id_col).cast("string"), text).alias("h"))
    counts = rows.groupBy("lang").count().collect()  # one row per language, as the network has outputs
    if not counts:
        return None
    each = max(8, train_rows // len(counts))
    # rows whose hash lies below a share that leaves about four times as many as wanted: texts of a language
    # that holds most rows do not all meet in the task that ranks it; the shares came from the driver, a row a language
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 4.0 * each / r["count"]) if r["count"] > 4 * each else 1.0) for r in counts],
                                              "lang string, share double")
    u = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)
    at = F.pmod("h", F.greatest(F.lit(1), F.length("text") - STRETCH)).cast("int") + 1
    few = rows.join(F.broadcast(share), "lang").filter((F.col("share") >= 1) | (u < F.col("share"))) \
        .select("lang", "h", F.substring("text", at, F.lit(STRETCH)).alias("text"))
    w = Window.partitionBy("lang").orderBy("h", "text")
    sample = few.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= each).orderBy("lang", "h").collect()
    langs = sorted({r.lang for r in sample})
    x, n, owner = windows([r.text.encode("utf-8", "surrogatepass") for r in sample])
    y = np.array([langs.index(r.lang) for r in sample])[owner]
    return Network(langs).fit(x, n, y, steps=steps, seed=seed)


def predictor(model: Network | None, step: int = 256):
    """A column function of the text: struct of language and score."""
    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            lang, score = [UNKNOWN] * len(s), np.zeros(len(s))
            todo = [i for i, t in enumerate(s) if t and has_letter(t)] if model else []
            while todo:
                part, size = [], 0
                while todo and len(part) < step and size < 1 << 21:
                    part.append(todo.pop())
                    size += len(s.iat[part[-1]])
                p = model.documents([s.iat[i].encode("utf-8", "surrogatepass") for i in part])
                for i, k, v in zip(part, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    lang[i], score[i] = model.langs[k], min(1.0, v)
            yield pd.DataFrame({"lang": lang, "score": score})
    return predict


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kw) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    ship_package(docs.sparkSession)
    predict = predictor(train(docs, id_col, text_col, lang_col, **kw))
    return docs.select(column(docs, id_col).alias("doc_id"), (fold(column(docs, id_col)) == 1).alias("held_out"),
                       predict(column(docs, text_col)).alias("p")) \
        .select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def known_language(docs: DataFrame, text_col: str = "text", least: float = 0.35, **kw) -> DataFrame:
    """``docs`` without the texts whose language is unknown: no letters, or a score below ``least``. Where no document has a
    label nothing can be learned, and all texts with letters stay."""
    ship_package(docs.sparkSession)
    model = train(docs, text_col=text_col, **kw)
    if model is None:
        return docs.filter(column(docs, text_col).rlike(r"\p{L}"))
    p = predictor(model)(column(docs, text_col))
    rows = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("_row"), p.alias("_p"))
    return rows.filter((F.col("_p.lang") != UNKNOWN) & (F.col("_p.score") >= least)).select("_row.*")
