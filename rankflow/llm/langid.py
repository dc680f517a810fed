"""Language identification in two steps: the family first, then languages within it.

Texts become hashed byte bigrams and trigrams (square roots of counts, unit
length).  Linear support vector machines (squared hinge), one family against the
rest, choose the family.  Within it, a machine for each pair of languages is
fitted on these two alone; the language with most wins is chosen, by the sum of
its margins if several have as many.  A family of one language needs no second
step.

Families of common languages are given; a language that isn't among them joins
the family of the language whose mean vector is nearest, if their cosine is
``RELATED`` or more, and is a family of its own otherwise.

The machines are fitted on a sample of at most about ``MAX_ROWS`` labelled
documents (``PER_LANG`` a language), drawn by a hash of doc_id; documents whose
crc32(doc_id) mod 4 is 2 are held out and never used.  Prediction uses only the
text, all of it.

A null text, or one without a letter, gives ``und`` and 0; so does every text
if nothing could be learned.  A null doc_id is not held out and not learned
from.  Repeated rows give repeated results.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .tokens import _LOWER, text_runs

FEATURES = 2048
PER_LANG = 1500
MAX_ROWS = 8000
COST = 1.0
DOCS_AT_ONCE = 2000
RELATED = 0.8
SLOPE = 6.0  # of the logistic curve that makes margins scores

#: Families of languages (fixed values).
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def families(langs: np.ndarray, x: np.ndarray) -> dict[str, str]:
    """The family of each language; those not listed go by their mean vectors."""
    names = sorted(set(langs.tolist()))
    listed = {v: name for name, members in FAMILIES.items() for v in members}
    mean = np.stack([x[langs == v].mean(axis=0) for v in names])
    mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
    out: dict[str, str] = {v: listed[v] for v in names if v in listed}
    for k, v in enumerate(names):
        if v not in out:
            near = [(mean[k] @ mean[names.index(u)], u) for u in out]
            best, u = max(near, default=(0.0, v))
            out[v] = out[u] if best >= RELATED else v
    return out


def _vectors(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, features, whether the text has a letter) for runs of texts."""
    for i, j, buf, starts in text_runs(column):
        for a in range(i, j, DOCS_AT_ONCE):
            b = min(j, a + DOCS_AT_ONCE)
            at = starts[a - i : b - i + 1]
            own = buf[at[0] : at[-1]]
            doc = np.repeat(np.arange(b - a), np.diff(at))
            letter = np.bincount(doc[_ASCII_LETTER[own]], minlength=b - a) > 0
            for k in np.flatnonzero(~letter):
                letter[k] = any(x.isalpha() for x in own[at[k] - at[0] : at[k + 1] - at[0]].tobytes().decode("utf-8", "ignore"))
            low = _LOWER[own].astype(np.uint32)
            total = np.zeros((b - a) * FEATURES, dtype=np.float64)
            for n in (2, 3):
                if len(low) < n:
                    continue
                gram = np.full(len(low) - n + 1, n, dtype=np.uint32)
                for k in range(n):
                    gram = gram * np.uint32(0x01000193) ^ low[k : len(low) - n + 1 + k]
                gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - 11)
                inside = doc[: len(gram)] == doc[n - 1 :]
                total += np.bincount(doc[: len(gram)][inside] * FEATURES + gram[inside], minlength=len(total))
            vectors = np.sqrt(total).reshape(b - a, FEATURES)
            size = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield a, b, vectors / np.maximum(size, 1e-9), letter


def _train_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i, j, vectors, letter in _vectors(batch.column(2)):
        data = [x.tobytes() if ok else None for x, ok in zip(vectors.astype(np.float16), letter, strict=True)]
        yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(data, pa.binary())], ["doc_id", "lang", "vector"])


def _svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (with a bias last) that minimise |w|^2 / 2 + COST * sum of squared hinges, by Newton steps with conjugate gradients."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    w = np.zeros(x.shape[1])
    loss = lambda v: 0.5 * v @ v + COST * np.sum(np.maximum(0, 1 - y * (x @ v)) ** 2)
    for _ in range(20):
        active = y * (x @ w) < 1
        xa = x[active]
        gradient = w + 2 * COST * xa.T @ (xa @ w - y[active])
        if np.linalg.norm(gradient) < 1e-3:
            break
        step, r = np.zeros_like(w), -gradient
        p, rr = r.copy(), r @ r
        for _ in range(30):
            hp = p + 2 * COST * xa.T @ (xa @ p)
            a = rr / (p @ hp)
            step, r = step + a * p, r - a * hp
            rr, old = r @ r, rr
            if rr < 1e-8:
                break
            p = r + rr / old * p
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
    return w


class Model:
    """Family weights, and for each family its languages and the weights of each pair of them."""

    def __init__(self, langs: list[str], x: np.ndarray):
        y = np.array(langs, dtype=object)
        self.family = families(y, x)
        home = np.array([self.family[v] for v in langs], dtype=object)
        self.families = sorted(set(self.family.values()))
        self.members = {f: sorted(v for v, name in self.family.items() if name == f) for f in self.families}
        self.top = np.stack([_svm(x, np.where(home == f, 1.0, -1.0)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for f, members in self.members.items():
            for i, v in enumerate(members):
                for j in range(i + 1, len(members)):
                    mine = (y == v) | (y == members[j])
                    self.pairs[f, i, j] = _svm(x[mine], np.where(y[mine] == v, 1.0, -1.0))

    def _families(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.top is None:
            return np.zeros(len(x), dtype=np.int64), np.ones(len(x))
        margin = x @ self.top[:, :-1].T + self.top[:, -1]
        share = np.exp(SLOPE / 2 * (margin - margin.max(axis=1, keepdims=True)))
        best = margin.argmax(axis=1)
        return best, share[np.arange(len(x)), best] / share.sum(axis=1)

    def _within(self, name: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.members[name])
        wins, margins, chance = (np.zeros((len(x), n)) for _ in range(3))
        for i in range(n):
            for j in range(i + 1, n):
                w = self.pairs[name, i, j]
                margin = x @ w[:-1] + w[-1]
                wins[:, i] += margin >= 0
                wins[:, j] += margin < 0
                margins[:, i] += margin
                margins[:, j] -= margin
                p = 1 / (1 + np.exp(-SLOPE * margin))
                chance[:, i] += p
                chance[:, j] += 1 - p
        best = np.lexsort((margins, wins), axis=1)[:, -1]
        return best, chance[np.arange(len(x)), best] / (n - 1) if n > 1 else np.ones(len(x))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        which, score = self._families(x)
        out = np.full(len(x), "und", dtype=object)
        for k, name in enumerate(self.families):
            mine = which == k
            lang, share = self._within(name, x[mine])
            out[mine] = np.array(self.members[name], dtype=object)[lang]
            score[mine] *= share
        return out, score


def fit(docs: DataFrame) -> Model | None:
    """Learn from ``docs`` (doc_id, text, lang); None if there is nothing to learn from."""
    known = docs.filter("lang is not null and text is not null").filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_ROWS).collect()}
    if not counts:
        return None
    each = max(1, min(PER_LANG, MAX_ROWS // len(counts)))
    share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for k, n in counts.items() for y in (k, each / n)]), F.col("lang")), F.lit(0.0))
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 11) / F.lit(float(2**53))
    chosen = known.filter(drawn < share).select("doc_id", "lang", "text")
    found = map_arrow(chosen, _train_rows, "doc_id long, lang string, vector binary").filter("vector is not null").toArrow()
    if not found.num_rows:
        return None
    found = found.sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    x = np.frombuffer(b"".join(found["vector"].to_pylist()), dtype=np.float16).reshape(-1, FEATURES)
    return Model(found["lang"].to_pylist(), x.astype(np.float64))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = model or fit(docs)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, vectors, letter in _vectors(batch.column(2)):
            lang, score = np.full(j - i, "und", dtype=object), np.zeros(j - i)
            if model is not None and letter.any():
                lang[letter], score[letter] = model.predict(vectors[letter])
            yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(lang.tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return map_arrow(docs.select("doc_id", held.alias("held_out"), "text"), each, "doc_id long, held_out boolean, lang_pred string, score double")
