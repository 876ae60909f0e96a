"""Toxic spans and document scores by a linear-chain conditional random field, trained here."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, small_batches, table, tidy, trimmed

#: The bounds of the training sample: toxic rows and other rows, with their whole texts.
TRAIN_TOXIC, TRAIN_OTHER = 1500, 4000
#: The chance of taking any feature for a mark that isn't one.
FAMILY_ERROR = 0.05
#: Words of a block. A document is one chain, whatever its length; blocks only set how it is computed.
BLOCK = 64
#: Documents are scored together up to so many words, a longer one alone.
CALL_WORDS = 1 << 18
STRIP = ".,;:!?\"'()[]{}<>*#@_-+=~|/\\`$%^&0123456789"


def features(word: str) -> list[str]:
    """The word and its first letters, from three on."""
    return [f"={word}", *[f"^{word[:n]}" for n in range(3, min(len(word), 8) + 1)]]


@dataclass
class Crf:
    """Labels 0 and 1. Log-potentials: a word's emission for label 1, and of transitions relative to 0 -> 0."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    enter: float = 0.0  # 0 -> 1
    leave: float = 0.0  # 1 -> 0
    stay: float = 0.0  # 1 -> 1
    final: tuple[float, float, float, float] = (0.0, 0.0, 0.0, -20.0)  # of the document score: three slopes and the rest

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))


def passes(e, lengths, crf):
    """Forward and backward ratios of label 1 to label 0 at every word of documents that lie end to end.

    Each step maps a ratio x to (A x + B) / (C x + D). Blocks' products of these 2 x 2 matrices come first, all blocks
    at once; ratios then pass from block to block of a document, and from there through each block's words.
    """
    import numpy as np

    w, lengths = np.exp(np.clip(e, -60, 60)), np.asarray(lengths, dtype=np.int64)
    t01, t10, t11 = np.exp(crf.enter), np.exp(crf.leave), np.exp(crf.stay)
    n_blocks = -(-lengths // BLOCK)
    doc, first = np.repeat(np.arange(len(lengths)), n_blocks), np.cumsum(n_blocks) - n_blocks
    at = np.arange(len(doc)) - first[doc]
    starts, sizes = (np.cumsum(lengths) - lengths)[doc] + at * BLOCK, np.minimum(BLOCK, lengths[doc] - at * BLOCK)
    head, rows = at == 0, int(sizes.max(initial=0))
    inside = np.arange(rows)[:, None] < sizes
    v = w[np.minimum(starts + np.arange(rows)[:, None], max(len(w) - 1, 0))]

    def product(a, b, c, m):
        """Of the step with matrix (a, b; c, 1) after m, scaled."""
        p = [a * m[0] + b * m[2], a * m[1] + b * m[3], c * m[0] + m[2], c * m[1] + m[3]]
        top = np.maximum(np.maximum(p[0], p[1]), np.maximum(p[2], p[3]))
        return [x / top for x in p]

    def kept(some, new, old):
        return new if some.all() else [np.where(some, x, y) for x, y in zip(new, old, strict=True)]

    enter, leave = np.ones(len(doc)), np.ones(len(doc))  # ratios before a block's first word and at its last
    if len(doc) > len(lengths):
        one, none = np.ones(len(doc)), np.zeros(len(doc))
        fwd = bwd = [one, none, none, one]
        for t in range(rows):
            step = product(v[t] * t11, v[t] * t01, t10, fwd)
            fwd = kept(inside[t] & ~(head & (t == 0)), step, [v[0], none, none, one] if t == 0 else fwd)
        for t in range(rows - 1, -1, -1):
            bwd = kept(inside[t], product(v[t] * t11, t10, v[t] * t01, bwd), bwd)
        last = first + n_blocks - 1
        for k in range(1, int(n_blocks.max())):
            of = np.flatnonzero(n_blocks > k)
            i = first[of] + k - 1
            enter[i + 1] = (fwd[0][i] * enter[i] + fwd[1][i]) / (fwd[2][i] * enter[i] + fwd[3][i])
            i = last[of] - k + 1
            leave[i - 1] = (bwd[0][i] * leave[i] + bwd[1][i]) / (bwd[2][i] * leave[i] + bwd[3][i])
    x, y = np.empty_like(v), np.empty_like(v)
    now = enter
    for t in range(rows):
        now = v[t] * (t01 + now * t11) / (1 + now * t10)
        if t == 0:
            now = np.where(head, v[0], now)
        x[t] = now
    now = leave
    for t in range(rows - 1, -1, -1):
        y[t] = now
        now = np.where(inside[t], (t10 + v[t] * now * t11) / (1 + v[t] * now * t01), now)
    return x.T[inside.T], y.T[inside.T]


def words_of(text: str) -> list[str]:
    return text.lower().split()


def sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def label_words(numbers: list, words: list[str], toxic: list[int]) -> set[str]:
    """Features that mark toxic documents: the words that carry one get label 1 in toxic documents.

    Documents are arrays of places in `words`. A feature marks if it is in so many toxic documents and so few others
    that, were toxic ones a random choice, any of all features would reach that with a chance under FAMILY_ERROR
    (Chernoff's bound on the binomial). Other documents are counted for features alone that would mark without them.
    """
    import numpy as np

    own = [np.unique(t) for t in numbers]
    n = [sum(len(t) for t, y in zip(own, toxic, strict=True) if y == k) for k in (0, 1)]
    known: dict[str, int] = {}
    of: dict[int, list[int]] = {}
    seen: Counter = Counter()
    for t, y in zip(own, toxic, strict=True):
        if y:
            for w in t.tolist():
                if w not in of:
                    of[w] = [known.setdefault(f, len(known)) for f in features(words[w])]
            seen.update({f for w in t.tolist() for f in of[w]})
    share, need = n[1] / max(1, sum(n)), math.log((len(known) + 1) / FAMILY_ERROR)

    def evidence(c: int, z: int) -> float:
        p = c / (c + z)
        return (c + z) * (p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if z else 0.0)) if p > share else 0.0

    count = {f: seen[i] for f, i in known.items() if evidence(seen[i], 0) > need}
    carried = [[f for f in features(w) if f in count] for w in words]
    others: Counter = Counter()
    for t, y in zip(own, toxic, strict=True):
        if not y:
            others.update({f for w in t.tolist() for f in carried[w]})
    return {f for f, c in count.items() if evidence(c, others[f]) > need}


def train(docs: list[tuple[str, int]], steps: int = 30) -> Crf:
    """Fit the field on labelled words by Adagrad on the exact gradient, then the document score on its marginals.

    Words are held as numbers, and each step takes the documents in parts of some CALL_WORDS words, so memory is
    that of the texts, their distinct words, and one part.
    """
    import numpy as np

    docs = list(dict(sorted(docs)).items())  # copies of a text are no further evidence; toxic if any copy is
    toxic = [y for _, y in docs]
    if not sum(toxic) or sum(toxic) == len(toxic):
        return Crf(final=(0.0, 0.0, 0.0, 20.0 if sum(toxic) else -20.0))
    vocabulary: dict[str, int] = {}
    numbers = [np.array([vocabulary.setdefault(w.strip(STRIP), len(vocabulary)) for w in words_of(t)], dtype=np.int32) for t, _ in docs]
    del docs
    words = list(vocabulary)
    del vocabulary
    marks = label_words(numbers, words, toxic)
    index = {f: i for i, f in enumerate(sorted(marks))}
    # marked words are numbered from 1 on; the others are alike
    code, rows, cols, n_codes = np.zeros(len(words), dtype=np.int32), [], [], 1
    for i, w in enumerate(words):
        held = [index[f] for f in features(w) if f in index]
        if held:
            rows += [n_codes] * len(held)
            cols += held
            code[i], n_codes = n_codes, n_codes + 1
    del words
    rows, cols = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64)
    numbers = [code[t] for t in numbers]
    # documents without any marked word are alike if equally long: one of each length stands for all
    key = np.array([i + 1 if t.any() else -len(t) for i, t in enumerate(numbers)])
    _, one, back, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    lengths = np.array([len(numbers[i]) for i in one])
    part = np.cumsum(lengths) // CALL_WORDS
    parts = np.split(np.arange(len(one)), np.flatnonzero(part[1:] != part[:-1]) + 1)
    word = [np.concatenate([numbers[i] for i in one[k]]) for k in parts]
    del numbers
    hot = np.array(toxic, dtype=bool)[one]
    # weights, bias, and three transitions
    theta, seen = np.zeros(len(index) + 4), np.full(len(index) + 4, 1e-8)
    theta[-4] = -4.0
    crf = Crf()
    for step in range(steps):
        crf.enter, crf.leave, crf.stay = theta[-3:]
        emission = np.bincount(rows, theta[cols], minlength=n_codes) + theta[-4]
        q, turns, found = np.zeros(n_codes), np.zeros(3), []
        for w, k in zip(word, parts, strict=True):
            of = np.repeat(k, lengths[k])
            y, e = (w > 0) & hot[of], emission[w]
            fwd, bwd = passes(e, lengths[k], crf)
            p = fwd * bwd / (1 + fwd * bwd)
            q += np.bincount(w, (p - y) * times[of], minlength=n_codes)
            pairs = np.flatnonzero(of[1:] == of[:-1]) + 1  # words with one before them
            weight, a, b = times[of[pairs]], y[pairs - 1], y[pairs]
            x, z = fwd[pairs - 1], np.exp(np.clip(e[pairs], -60, 60)) * bwd[pairs]
            z01, z10, z11 = np.exp(crf.enter) * z, np.exp(crf.leave) * x, np.exp(crf.stay) * x * z
            total = weight / (1 + z01 + z10 + z11)
            turns += [(z01 * total).sum() - weight[~a & b].sum(), (z10 * total).sum() - weight[a & ~b].sum(), (z11 * total).sum() - weight[a & b].sum()]
            if step + 1 == steps:
                found.append(document_features(p, lengths[k]))
        grad = np.r_[np.bincount(cols, q[rows], minlength=len(index)), q.sum(), turns]
        grad += 0.1 * theta
        seen += grad * grad
        theta -= 1.0 * grad / np.sqrt(seen)
    crf.weights = {f: float(theta[i]) for f, i in index.items()}
    crf.bias, (crf.enter, crf.leave, crf.stay) = float(theta[-4]), map(float, theta[-3:])
    crf.final = _logistic(np.concatenate(found)[back], np.array(toxic, dtype=float))
    return crf


def document_features(p, lengths):
    """Of each document: log(1 + expected toxic words), the largest marginal, and log(1 + words with a marginal over one half)."""
    import numpy as np

    of = np.repeat(np.arange(len(lengths)), lengths)
    x = np.zeros((len(lengths), 3))
    x[:, 0] = np.log1p(np.bincount(of, p, minlength=len(lengths)))
    np.maximum.at(x[:, 1], of, p)
    x[:, 2] = np.log1p(np.bincount(of, p > 0.5, minlength=len(lengths)))
    return x


def _logistic(x, y) -> tuple[float, float, float, float]:
    """Ridge logistic regression by Newton's method."""
    import numpy as np

    a = np.c_[x, np.ones(len(x))]
    b = np.zeros(4)
    for _ in range(30):
        p = sigmoid(a @ b)
        b -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 0.05 * np.eye(4), a.T @ (p - y) + 0.05 * b)
    return tuple(map(float, b))


def _scorer(crf: Crf, spans: bool, id_at: int = 0, text_at: int = 1, below: float | None = None):
    """Scores batches; with `below` it passes on whole rows whose score is lower."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        cache: dict[str, float] = {}

        def scored(words):
            if len(cache) > 200_000:
                cache.clear()
            for w in {w for t in words for w in t}:
                if w not in cache:
                    cache[w] = crf.emission(w.strip(STRIP))
            lengths = [len(t) for t in words]
            fwd, bwd = passes(np.array([cache[w] for t in words for w in t], dtype=float), lengths, crf)
            p = fwd * bwd / (1 + fwd * bwd)
            found = [[] for _ in words]
            if spans:
                ends = np.cumsum(lengths)
                for i in np.flatnonzero(p > 0.5).tolist():
                    d = int(np.searchsorted(ends, i, side="right"))
                    found[d].append((i - int(ends[d]) + lengths[d], float(p[i])))
            return sigmoid(document_features(p, lengths) @ np.array(crf.final[:3]) + crf.final[3]), found

        for batch in batches:
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            score, hits, words, size = [np.empty(0)], [], [], 0
            for i, t in enumerate(texts):
                words.append(words_of(t))
                size += len(words[-1])
                if size >= CALL_WORDS or i + 1 == len(texts):
                    s, found = scored(words)
                    score.append(s), hits.extend(found)
                    words, size = [], 0
            score = np.concatenate(score)
            if below is not None:
                yield batch.filter(pa.array(score < below))
                continue
            cols = [pa.array(batch.column(id_at).to_pylist(), pa.int64()), pa.array(score, pa.float64())]
            if spans:
                cols.append(pa.array([_offsets(t, h) for t, h in zip(texts, hits, strict=True)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", *(["spans"] if spans else [])])

    return run


def _offsets(text: str, hits: list[tuple[int, float]]) -> list[dict]:
    """Code-point offsets of the words with these numbers."""
    if not hits:
        return []
    import re

    at = [m.span() for m in re.finditer(r"\S+", text)]
    return [{"start": at[i][0], "end": at[i][1], "p": p} for i, p in hits]


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def _trainer(batches):
    """Train on all rows, text and label, and give the field as rows name, value; a name of a feature begins with = or ^."""
    import pyarrow as pa

    crf = train([(t or "", y) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True)])
    rows = {"bias": crf.bias, "enter": crf.enter, "leave": crf.leave, "stay": crf.stay, **{f"final{i}": x for i, x in enumerate(crf.final)}, **crf.weights}
    yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(list(rows.values()), pa.float64())], names=["name", "value"])


@tidy
def fit(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, other: int = TRAIN_OTHER) -> Crf:
    """Train on the whole texts of at most `toxic` and `other` rows of the classes, the first by a hash of the id, never held-out ones.

    One task trains, as the sample is bounded, and its weights, of words in toxic rows of the sample, come to the
    driver. Rows that repeat an id count once, with the first of their texts; labels that do are toxic if any is.
    """
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    sample = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((0, other), (1, toxic))]
    some = materialize(sample[0].unionByName(sample[1]))  # toxic + other rows, so it can be broadcast
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    model = {r.name: r.value for r in materialize(texts.repartition(1).mapInArrow(trimmed(_trainer), "name string, value double")).collect()}
    if not model:  # no task ran, as there is no labelled row
        return Crf()
    return Crf({k: v for k, v in model.items() if k[0] in "=^"}, *(model[k] for k in ("bias", "enter", "leave", "stay")), tuple(model[f"final{i}"] for i in range(4)))


def score(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """doc_id, score and the words whose marginal is over one half: spans (start, end, p) in code points.

    A null or empty text has no toxic words and the score that goes with none.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_scorer(crf, spans)), "doc_id bigint, score double" + (", spans array<struct<start: bigint, end: bigint, p: double>>" if spans else ""))


def without_toxic(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a score under one half, with all their columns. Nothing is shuffled."""
    return docs.mapInArrow(trimmed(_scorer(crf, False, docs.columns.index(id_col), docs.columns.index(text_col), 0.5)), docs.schema)


@small_batches
@tidy
def toxicity(docs: DataFrame, labels: DataFrame, spans: bool = False) -> DataFrame:
    """Train on `labels` and score all of docs: one row per input row: doc_id, held_out, score, predicted (and spans).

    The training labels of words come from documents' labels: a word is toxic in a toxic document if it has
    a marking feature. Without labelled rows of both classes every score is near 0 (or near 1 if all are toxic).
    A null doc_id counts as not held out. Ids are whole numbers (cast to bigint; others become null).
    """
    scored = materialize(score(docs, fit(docs, labels), spans=spans))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *(["spans"] if spans else []))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the field trained on `labels`: doc_id, held_out, score, predicted."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
