"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Subwords are runs of two to four bytes of the lower-cased text that do not cross a word; a space at either
side of a word takes part. Their hashes index an embedding table, a text is the mean of its subwords'
embeddings, and a softmax over the languages reads that mean. Table and softmax are trained together by
stochastic gradient descent in numpy, on passages of various lengths so that short texts are learnt too.
The mean and the softmax's matrix are both linear, so for prediction the table is multiplied out once to one
score per subword and language.

Training reads a bounded sample: about ``PER_LANGUAGE`` labelled rows of each language, chosen by a hash
threshold (documented parameter), at most ``LANGUAGES`` languages, the most frequent ones. One in five of the
sampled rows is kept for calibration: a temperature is fitted to it, and the score from which on accepted
predictions are wrong at most ``ERROR_RATE`` of the time. Rows below are marked ``accepted = false``, the
prediction itself stays.

A null text, or one without a letter, is ``und`` with score 0 and not accepted. Whole texts are read. Without
any labelled row every text is ``und``. Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dragoman.llm.symbols import slices

UNKNOWN = "und"
BUCKET_BITS, DIMENSIONS = 17, 16
PER_LANGUAGE, LANGUAGES = 1500, 512
ERROR_RATE = 0.01
EPOCHS, BATCH, RATE, SEED = 3, 64, 0.5, 7
PASSAGES_PER_TEXT, LONGEST_PASSAGE = 4, 600
LETTER = r"\p{L}"

#: Bytes as the model sees them: white space and control become a space, digits become 0.
SEEN = np.arange(256, dtype=np.uint32)
SEEN[: 0x21] = 0x20
SEEN[0x30:0x3A] = 0x30


def subwords(data: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hash buckets of the runs of 2, 3 and 4 bytes, and where each starts; runs across words are left out."""
    b = SEEN[data]
    space = b == 0x20
    code, inner, out = b, np.zeros(len(b), bool), []
    for n in (2, 3, 4):
        if len(b) < n:
            break
        code = code[:-1] | (b[n - 1 :] << np.uint32(8 * (n - 1)))
        if n > 2:
            inner = inner[:-1] | space[n - 2 : len(b) - 1]
        else:
            inner = space[:-1] & space[1:]
        at = np.flatnonzero(~inner)
        hashed = (code[at] ^ np.uint32(n * 0x1F123BB5)) * np.uint32(0x9E3779B1)
        out.append(((hashed >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), at))
    return out


def _bag(text: bytes) -> np.ndarray:
    found = subwords(np.frombuffer(b" " + text + b" ", np.uint8))
    return np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int32)


class Model:
    """Languages, score of each subword bucket for each language, bias, temperature, accepting score."""

    def __init__(self, languages: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float = 1.0, accept: float = 0.0):
        self.languages, self.scores, self.bias = languages, scores, bias
        self.temperature, self.accept = temperature, accept

    def logits(self, texts: pa.Array) -> np.ndarray:
        """One row per text of a slice; each text is lower case and stands between spaces."""
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        total = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts))
        for buckets, at in subwords(raw):
            text = np.searchsorted(at, edges)
            count += np.diff(text)
            for k in range(len(self.languages)):
                sums = np.concatenate([[0.0], np.cumsum(self.scores[k][buckets], dtype=np.float64)])
                total[:, k] += np.diff(sums[text])
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _passages(text: str, rng: np.random.Generator) -> list[bytes]:
    words, out = text.lower().split(), []
    for _ in range(PASSAGES_PER_TEXT):
        if not words:
            break
        n = int(np.exp(rng.uniform(0, np.log(LONGEST_PASSAGE / 6))))
        a = int(rng.integers(0, max(1, len(words) - n + 1)))
        out.append(" ".join(words[a : a + n]).encode())
    return out


def train(rows: list[tuple[str, str]], languages: list[str]) -> Model:
    """Stochastic gradient descent on passages of (text, lang) rows; every fifth row calibrates."""
    rng = np.random.default_rng(SEED)
    number = {x: i for i, x in enumerate(languages)}
    bags, labels, held = [], [], []
    for i, (text, lang) in enumerate(rows):
        for p in _passages(text, rng):
            bag = _bag(p)
            if len(bag):
                bags.append(bag)
                labels.append(number[lang])
                held.append(i % 5 == 4)
    y, held = np.array(labels, np.int64), np.array(held, bool)
    k = len(languages)
    table = rng.normal(0, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, k), np.float32), np.zeros(k, np.float32)
    learn = np.flatnonzero(~held)
    steps = max(1, EPOCHS * -(-len(learn) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(learn), max(1, -(-len(learn) // BATCH))):
            if not len(some):
                continue
            parts = [bags[i] for i in some]
            length = np.array([len(p) for p in parts])
            index = np.concatenate(parts)
            owner = np.repeat(np.arange(len(some)), length)
            mean = np.add.reduceat(table[index], np.cumsum(length) - length) / length[:, None]
            z = mean @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            rate = RATE * (1 - step / steps)
            back = (p @ weights.T) / length[:, None]
            weights -= rate * mean.T @ p / len(some) * 10
            bias -= rate * p.mean(axis=0)
            order = np.argsort(index, kind="stable")
            heads = np.flatnonzero(np.r_[True, np.diff(index[order]) != 0])
            table[index[order][heads]] -= rate * 100 * np.add.reduceat(back[owner[order]], heads).astype(np.float32)
            step += 1
    model = Model(languages, np.ascontiguousarray((table @ weights).T.astype(np.float32)), bias.astype(np.float64))
    check = np.flatnonzero(held)
    if len(check):
        z = np.array([model.scores[:, bags[i]].mean(axis=1) + model.bias for i in check])
        _calibrate(model, z, y[check])
    return model


def _calibrate(model: Model, logits: np.ndarray, y: np.ndarray) -> None:
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 60):
        model.temperature = float(t)
        p = model.probabilities(logits)[np.arange(len(y)), y]
        best = min(best, (float(-np.log(np.maximum(p, 1e-12)).mean()), float(t)))
    model.temperature = best[1]
    p = model.probabilities(logits)
    order = np.argsort(-p.max(axis=1), kind="stable")
    wrong = np.cumsum((p.argmax(axis=1) != y)[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero(wrong <= ERROR_RATE)
    model.accept = float(p.max(axis=1)[order][fine[-1]]) if len(fine) else 1.0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, max_languages: int = LANGUAGES) -> Model | None:
    """Model of the labelled rows that are not held out; two passes over them, nothing is sorted."""
    known = docs.select("text", "lang", "doc_id").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return None
    chosen = F.lit(False)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.lit(1 << 30))
    for r in counts:
        chosen = chosen | ((F.col("lang") == r["lang"]) & (draw < int(min(1.0, per_language / r["count"]) * (1 << 30))))
    # rows that share an id are drawn together; the limit holds in that case too
    rows = known.filter(chosen).select("text", "lang", draw.alias("draw")).limit(2 * per_language * len(counts)).collect()
    languages = sorted(r["lang"] for r in counts)
    return train([(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["draw"], r["lang"], r["text"]))], languages)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                p = model.probabilities(model.logits(part.column(2)))
                best = p.argmax(axis=1)
                letters = np.asarray(part.column(3), dtype=object).astype(bool)
                score = np.where(letters, p[np.arange(len(p)), best], 0.0)
                names = [model.languages[b] if x else UNKNOWN for b, x in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(names), pa.array(score), pa.array(letters & (score >= model.accept))],
                    ["doc_id", "held_out", "lang_pred", "score", "accepted"],
                )

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row of ``docs``."""
    model = model or fit(docs)
    rows = docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.concat(F.lit(" "), F.lower(F.coalesce("text", F.lit(""))), F.lit(" ")).alias("text"),
        F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("letters"),
    )
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(_predict(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")
