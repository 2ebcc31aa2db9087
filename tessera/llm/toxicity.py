"""Toxicity by a convolutional text classifier trained in numpy.

Words, and their first four and six bytes, hash into one table of embeddings, so
that inflected forms share what is learned; filters of several widths slide over
the embeddings; the strongest response of each filter in the whole text feeds a
logistic output.  A threshold for each language, which is guessed from the text
itself by its function words, is calibrated by cross-validation and folded into
the score, so that 0.5 is the line everywhere.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle, text_bytes

WIDTHS = (1, 2, 3)
FILTERS = 8
DIMS = 8
BITS = 18
BUCKETS = 1 << BITS
#: Bytes of the beginnings that a longer word is also known by.
STEMS = (4, 6)
#: Words and beginnings of fewer texts of the sample teach nothing and count as unseen.
LEAST_TEXTS = 8
#: Share of words left out at random each time that a text is learned from.
DROPPED = 0.25
#: Bounds of the labelled sample that the classifier is fitted on, in rows; texts are whole.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 5000
EPOCHS, FOLDS = 14, 4
#: A false alarm's share weighs so many times a miss's; a language's own toxic rows
#: weigh against so many of all languages together; logit of texts without words.
ALARM_WEIGHT, POOLED_ROWS, NO_WORDS = 4.0, 20, -3.0
WORDS_AT_ONCE = 50_000
#: Frequent function words, by which a text's language is guessed.
FUNCTION_WORDS = {
    "en": "the of and to is that was for with are this be",
    "fr": "le les et un une est que dans pour qui pas des",
    "de": "der die und das den von zu mit ist nicht ein sich",
    "es": "el los y en del las por con para una se su",
}
#: ASCII letters in lower case; other ASCII becomes a space; bytes of longer characters stay.
_TO_WORDS = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SLOTS = [(w, j) for w in WIDTHS for j in range(w)]
_REACH = max(WIDTHS) - 1
_IDS = 1 + len(STEMS)
_LANGUAGE = {zlib.crc32(w.encode()): k for k, words in enumerate(FUNCTION_WORDS.values(), 1) for w in words.split()}
_LANGUAGE_IDS = np.array(sorted(_LANGUAGE), np.uint32)
_LANGUAGE_OF = np.array([_LANGUAGE[h] for h in sorted(_LANGUAGE)], np.int64)


def word_hashes(text: bytes) -> np.ndarray:
    """One row a word: hashes of the word and of its beginnings (of a shorter word: the word's own)."""
    words = text.translate(_TO_WORDS).split()
    n = len(words)
    out = np.empty((n, _IDS), np.uint32)
    if not n:
        return out
    out[:, 0] = np.fromiter(map(zlib.crc32, words), np.uint32, n)
    lengths = np.fromiter(map(len, words), np.int64, n)
    flat = np.frombuffer(b"".join(words) + b"\0" * max(STEMS), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for k, stem in enumerate(STEMS, 1):
        h = np.full(n, stem, np.uint64)
        for j in range(stem):
            h = (h ^ flat[starts + j]) * np.uint64(0x100000001B3)
        out[:, k] = np.where(lengths > stem, (h ^ (h >> np.uint64(29))) & np.uint64(0xFFFFFFFF), out[:, 0])
    return out


@dataclass
class Model:
    """Weights; ``thresholds`` are logits for no language and each known one.

    ``slot`` gives a bucket's row of ``table`` and ``tag`` the rest of the hash that
    owns the bucket, so that an unseen word does not pass for a known one.  Row 0 is
    the unknown word and stays zero.
    """

    slot: np.ndarray
    tag: np.ndarray
    table: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: float
    thresholds: np.ndarray

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        bucket = hashes & (BUCKETS - 1)
        return np.where(self.tag[bucket] == hashes >> BITS, self.slot[bucket], 0)

    def responses(self, rows: np.ndarray, pad: np.ndarray) -> np.ndarray:
        x = self.table[rows[:, 0]]
        for k in range(1, _IDS):
            x += self.table[rows[:, k]]
        y = x @ self.conv
        parts = []
        for k, w in enumerate(WIDTHS):
            first = sum(WIDTHS[:k]) * FILTERS
            c = y[:, first : first + FILTERS].copy()
            for j in range(1, w):
                c[:-j] += y[j:, first + j * FILTERS : first + (j + 1) * FILTERS]
            parts.append(c)
        r = np.maximum(np.hstack(parts) + self.bias, 0)
        r[pad] = 0
        return r

    def strongest(self, texts: list[np.ndarray], hits: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The best response of each filter in each text of rows; with ``hits`` also the rows of the words there.

        Texts are laid out WORDS_AT_ONCE words at a time; longer ones are cut into
        pieces that overlap by a filter's reach, and the best piece counts.
        """
        wide = FILTERS * len(WIDTHS)
        best = np.zeros((len(texts), wide), np.float32)
        hit = np.zeros((len(texts), wide, max(WIDTHS), _IDS), np.int32) if hits else None
        pieces = [(i, x[a : a + WORDS_AT_ONCE + _REACH]) for i, x in enumerate(texts) for a in range(0, max(len(x), 1), WORDS_AT_ONCE)]
        k = 0
        while k < len(pieces):
            n, words = k + 1, len(pieces[k][1])
            while n < len(pieces) and words + len(pieces[n][1]) <= WORDS_AT_ONCE:
                words += len(pieces[n][1])
                n += 1
            lengths = np.array([len(x) + _REACH for _, x in pieces[k:n]])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            rows, pad = np.zeros((int(lengths.sum()), _IDS), np.int32), np.ones(int(lengths.sum()), bool)
            for s, (_, x) in zip(starts, pieces[k:n]):
                rows[s : s + len(x)] = x
                pad[s : s + len(x)] = False
            r = self.responses(rows, pad)
            own = np.maximum.reduceat(r, starts, axis=0)
            for (i, _), s, length, found in zip(pieces[k:n], starts, lengths, own):
                better = np.flatnonzero(found > best[i])
                best[i, better] = found[better]
                if hit is not None and len(better):
                    at = s + r[s : s + length].argmax(axis=0)[better]
                    hit[i, better] = rows[np.minimum(at[:, None] + np.arange(max(WIDTHS)), s + length - 1)]
            k = n
        return best, hit

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        best, _ = self.strongest([self.rows(x) for x in texts])
        return best.astype(np.float64) @ self.out + self.base

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Between 0 and 1; texts without words have the score of NO_WORDS."""
        z = self.logits(texts) - self.thresholds[languages(texts)]
        z[[len(x) == 0 for x in texts]] = NO_WORDS
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def languages(texts: list[np.ndarray]) -> np.ndarray:
    """The language whose function words a text has most of, as a number from 1; 0 without any."""
    out = np.zeros(len(texts), np.int64)
    for i, x in enumerate(texts):
        own = x[:, 0]
        at = np.minimum(np.searchsorted(_LANGUAGE_IDS, own), len(_LANGUAGE_IDS) - 1)
        counts = np.bincount(_LANGUAGE_OF[at[_LANGUAGE_IDS[at] == own]], minlength=len(FUNCTION_WORDS) + 1)
        out[i] = counts.argmax() if counts.any() else 0
    return out


def vocabulary(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """slot, tag and number of rows of the hashes of at least LEAST_TEXTS texts; the most frequent owns a bucket."""
    found = np.sort(np.concatenate([np.zeros(0, np.uint32), *[np.unique(x) for x in texts]]).astype(np.uint32))
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(found)))
    known = found[first[counts >= LEAST_TEXTS]]
    known = known[np.argsort(counts[counts >= LEAST_TEXTS], kind="stable")]  # the last one written owns the bucket
    slot, tag = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.uint32)
    slot[known & (BUCKETS - 1)], tag[known & (BUCKETS - 1)] = np.arange(1, len(known) + 1), known >> BITS
    return slot, tag, len(known) + 1


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Model:
    """Fit the classifier by stochastic gradients; its thresholds stay zero."""
    rng = np.random.default_rng(seed)
    wide = FILTERS * len(WIDTHS)
    draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    slot, tag, n = vocabulary(texts)
    m = Model(slot, tag, draw(n, DIMS) * 0.03, draw(DIMS, FILTERS * len(_SLOTS)) * 0.5, np.full(wide, 0.02, np.float32), draw(wide).astype(np.float64) * 0.5, 0.0, np.zeros(len(FUNCTION_WORDS) + 1))
    m.table[0] = 0
    if not len(labels) or labels.min() == labels.max():
        m.table[:], m.out[:], m.base = 0, 0, -30.0
        return m
    rows, language = [m.rows(x) for x in texts], languages(texts)
    weight = np.ones(len(texts))
    for k in range(len(m.thresholds)):  # a language's two classes weigh alike, and small languages weigh more than their share
        for y in (0, 1):
            own = (language == k) & (labels == y)
            if own.any():
                weight[own] = ((language == k).sum() * len(texts)) ** 0.5 / own.sum()
    weight /= weight.mean()
    seen = {k: np.full(v.shape, 1e-4, v.dtype) for k, v in (("table", m.table), ("conv", m.conv), ("bias", m.bias), ("out", m.out))}
    base_seen = 1e-4

    def step(name: str, grad: np.ndarray, rate: float) -> None:
        value, total = getattr(m, name), seen[name]
        total += grad * grad
        value -= (rate * grad / np.sqrt(total)).astype(value.dtype)

    order = np.arange(len(texts))
    for epoch in range(epochs):
        rate = 0.1 / (1 + 0.15 * epoch)
        rng.shuffle(order)
        for k in range(0, len(order), 32):
            own = order[k : k + 32]
            kept = [np.where(rng.random(len(rows[i]))[:, None] < DROPPED, 0, rows[i]) for i in own]
            best, hit = m.strongest(kept, hits=True)
            p = 1 / (1 + np.exp(-np.clip(best @ m.out + m.base, -30, 30)))
            d = (p - labels[own]) * weight[own] / len(own)
            to = ((d[:, None] * m.out[None, :]) * (best > 0)).astype(np.float32)
            conv_grad, places, grads = np.zeros_like(m.conv), [], []
            for s, (w, j) in enumerate(_SLOTS):
                f = slice(WIDTHS.index(w) * FILTERS, (WIDTHS.index(w) + 1) * FILTERS)
                c = slice(s * FILTERS, (s + 1) * FILTERS)
                word = hit[:, f, j]  # texts, filters, ids
                x = m.table[word].sum(axis=2)
                conv_grad[:, c] = np.einsum("tf,tfd->df", to[:, f], x)
                g = to[:, f, None] * m.conv[:, c].T[None, :, :]
                places.append(word.reshape(-1))
                grads.append(np.repeat(g.reshape(-1, DIMS), _IDS, axis=0))
            step("out", best.T @ d, rate)
            step("bias", to.sum(axis=0), rate / 4)
            base_seen += d.sum() ** 2
            m.base -= rate * d.sum() / np.sqrt(base_seen)
            step("conv", conv_grad, rate / 2)
            where, g = np.concatenate(places), np.concatenate(grads)
            live = (where > 0) & g.any(axis=1)
            touched, at = np.unique(where[live], return_inverse=True)
            summed = np.zeros((len(touched), DIMS), np.float32)
            np.add.at(summed, at, g[live])
            seen["table"][touched] += summed * summed
            m.table[touched] -= rate * summed / np.sqrt(seen["table"][touched])
    return m


def thresholds(z: np.ndarray, y: np.ndarray, language: np.ndarray) -> np.ndarray:
    """The logit of each language at which held-out rows err least.

    A cut's error is the share of toxic rows below it plus ALARM_WEIGHT times the
    share of clean rows above.  A language's own error counts by its toxic rows,
    that of all languages by POOLED_ROWS, so that few rows of a language can't
    move its cut far.  Of equal cuts the middle of the widest gap is taken.
    """
    out = np.zeros(len(FUNCTION_WORDS) + 1)
    if not len(y) or y.min() == y.max():
        return out
    values = np.unique(z)
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    widths = np.concatenate([[1.0], values[1:] - values[:-1], [1.0]])

    def error(own: np.ndarray) -> np.ndarray:
        high, low = np.sort(z[own & (y == 1)]), np.sort(z[own & (y == 0)])
        misses, alarms = np.searchsorted(high, cuts), len(low) - np.searchsorted(low, cuts)
        return misses / max(len(high), 1) + ALARM_WEIGHT * alarms / max(len(low), 1)

    pooled = error(np.ones(len(y), bool))
    for k in range(len(out)):
        own = language == k
        n = (own & (y == 1)).sum() if (own & (y == 0)).any() else 0
        wrong = (n * error(own) + POOLED_ROWS * pooled) / (n + POOLED_ROWS)
        best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
        out[k] = cuts[best[widths[best].argmax()]]
    return out


def held_out(doc_id):
    """True for rows never learned from: crc32 of the id as text is 0 modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A bounded sample of labelled rows outside the held-out fold: doc_id, text and toxic.

    Chosen by a hash of the id, so the same rows come out however the table is
    dealt.  At most SAMPLE_TOXIC and SAMPLE_CLEAN labels are chosen, and the list
    of ids is all that is broadcast.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    order = F.xxhash64("doc_id", "toxic")
    chosen = [usable.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(n) for k, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.select("doc_id", text_bytes(F.col("text")).alias("text")).join(ids, "doc_id")
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text", "toxic").limit(SAMPLE_TOXIC + SAMPLE_CLEAN)


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> Model:
    """Train on the whole sample, and calibrate on folds that models of the other folds score.

    Each model is trained in a task of its own, which reads the bounded sample; the
    driver gets the last model and the folds' logits.
    """
    sample = settle(labelled_sample(docs, labels), "toxic-sample")
    dealt = sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(folds)).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(folds)))).repartitionById(folds + 1, F.col("part"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(part, fold, doc_id, word_hashes(text), toxic) for pdf in frames for part, fold, doc_id, text, toxic in zip(pdf.part, pdf.fold, pdf.doc_id, pdf.text, pdf.toxic)]
        rows.sort(key=lambda r: (zlib.crc32(r[3].tobytes()), r[2], r[4]))  # the rows' order sets the order of the steps
        for part in sorted({r[0] for r in rows}):
            own = [r for r in rows if r[0] == part and r[1] != part]
            model = train([x for *_, x, _ in own], np.array([y for *_, y in own], np.int64))
            rest = [r for r in rows if r[0] == part and r[1] == part]
            if part == folds:
                yield pd.DataFrame({"model": [pickle.dumps(model)], "z": [0.0], "toxic": [0], "language": [0]})
            elif rest:
                texts = [x for *_, x, _ in rest]
                yield pd.DataFrame({"model": None, "z": model.logits(texts), "toxic": [y for *_, y in rest], "language": languages(texts)})

    found = dealt.select("part", "fold", "doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInPandas(run, "model binary, z double, toxic int, language int").toArrow()
    models = [x.as_py() for x in found.column("model") if x.is_valid]
    if not models:
        return train([], np.zeros(0, np.int64))
    scored = found.filter(found.column("model").is_null())
    model = pickle.loads(models[0])
    model.thresholds = thresholds(*(scored.column(c).to_numpy() for c in ("z", "toxic", "language")))
    return model


def _scores(model: Broadcast, texts: pd.Series) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(model.value.scores([word_hashes(x) for x in texts[k : k + 64]]) for k in range(0, len(texts), 64))])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from its whole text alone.

    Null and empty texts, and texts without words, have the score of NO_WORDS, about
    0.05.  Rows with a null id count as held out.  Repeated rows get equal scores.
    Without labels of both classes nothing can be learned and texts with words
    score about 0.  An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = _scores(model, pdf.text)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "held_out": pdf.held_out, "score": found, "predicted": (found >= 0.5).astype(np.int32)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_bytes(F.col("text")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, all columns kept.

    The score is computed beside the row, so nothing is joined or shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(_scores(model, texts))

    return docs.where(score(text_bytes(F.col("text"))) < 0.5)
