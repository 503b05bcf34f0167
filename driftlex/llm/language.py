"""Language identification by a string kernel.

The kernel of two texts is the number of character n-grams (blended spectrum,
n = 1 to 3, presence only) that both hold, over the geometric mean of their
own numbers. Landmark texts give a Nyström approximation of it; one-versus-rest
kernel ridge regression on those features gives a score for each language. A
batch of texts is scored by two matrix products.

N-grams are of folded UTF-8 bytes: letters of either case share a class, what
is no letter is one separator, and accented letters are two classes each.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlex.llm.npwords import text_chunks
from driftlex.llm.rowflags import row_key
from driftlex.llm.scratch import materialise

#: Fit on this many labelled texts of each language, so many in all unless that left a language with fewer than LEAST;
#: characters of such a text at most: of a longer one a window.
PER_LANGUAGE, MOST_TEXTS, LEAST, LONGEST = 300, 12_000, 4, 8000
#: Landmarks of each language, and in all.
LANDMARKS, MOST_LANDMARKS = 48, 768
RIDGE = 1e-2
SHARPNESS = 6.0


def _byte_class() -> np.ndarray:
    """64 classes: 0 separator, a-z, continuation bytes by their low five bits, lead bytes by range."""
    c = np.zeros(256, np.int32)
    for i in range(26):
        c[97 + i] = c[65 + i] = 1 + i
    for b in range(0x80, 0xC0):
        c[b] = 27 + (b & 0x1F)
    for b in range(0xC0, 0x100):
        c[b] = 59 + (0 if b < 0xC4 else 1 if b < 0xD0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
    return c


BYTE_CLASS = _byte_class()
IDS = 64 * 64 + 64 * 64 * 64


def _ids(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: ids of the n-grams that end there, of two and of three; single ones are bigrams after a separator."""
    c = BYTE_CLASS[data]
    two = c.copy()
    two[1:] += 64 * c[:-1]
    three = two + 64 * 64
    three[2:] += 64 * 64 * c[:-2]
    return two, three


class Model:
    """Landmark n-grams, and the matrix that takes kernels with the landmarks to language scores."""

    def __init__(self, languages: list[str], column: np.ndarray, landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.column, self.landmarks, self.weights = languages, column, landmarks, weights
        self.norm = np.sqrt(np.maximum(landmarks.sum(1), 1))

    def __getstate__(self):
        return self.languages, np.flatnonzero(self.column).astype(np.int32), np.packbits(self.landmarks > 0, axis=1), self.landmarks.shape[1], self.weights

    def __setstate__(self, state):
        languages, used, bits, width, weights = state
        column = np.zeros(IDS, np.int32)
        column[used] = 1 + np.arange(len(used))
        self.__init__(languages, column, np.unpackbits(bits, axis=1, count=width).astype(np.float32), weights)

    def kernel(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Kernel of each text with each landmark."""
        two, three = _ids(data)
        seen = presence(data, off, self.column, two, three, self.landmarks.shape[1])
        size = np.sqrt(np.maximum(seen.sum(1), 1))
        return (seen @ self.landmarks.T) / size[:, None] / self.norm

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """A score of each text for each language."""
        k = self.kernel(data, off)
        return np.hstack([k, np.ones((len(k), 1), k.dtype)]) @ self.weights

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, its share under a softmax) of each text."""
        s = self.scores(data, off)
        e = np.exp(SHARPNESS * (s - s.max(1, keepdims=True)))
        return s.argmax(1), e.max(1) / e.sum(1)


def presence(data, off, column, two, three, width: int) -> np.ndarray:
    """Texts by n-gram columns, 1 where the text holds it. Column 0 takes all others and is cleared."""
    n = len(off) - 1
    seen = np.zeros((n, width), np.float32)
    flat = seen.ravel()
    row = np.repeat(np.arange(n, dtype=np.int64) * width, np.diff(off))
    # n-grams don't cross from one text to the next
    first = np.zeros(len(data), np.int8)
    starts = off[:-1][np.diff(off) > 0]
    first[starts] = 2
    later = starts + 1
    later = later[later < len(data)]
    first[later] = np.maximum(first[later], 1)
    two = np.where(first == 2, BYTE_CLASS[data], two) if len(data) else two
    flat[row + column[two]] = 1
    ok = first == 0
    flat[(row + column[three])[ok]] = 1
    seen[:, 0] = 0
    return seen


def fit(texts: list[str], labels: list[str]) -> Model:
    """Kernel ridge regression on Nyström features; texts of a language: the first ones are its landmarks.

    With more languages than ``MOST_LANDMARKS``, some have none of their own; each has its column of the regression.
    """
    languages = sorted(set(labels))
    each = max(1, min(LANDMARKS, MOST_LANDMARKS // len(languages)))
    raw = [t.encode("utf-8", "replace") for t in texts]
    off = np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    where = {x: [i for i, y in enumerate(labels) if y == x][:each] for x in languages}
    chosen = [i for x in languages for i in where[x]]
    if len(chosen) > MOST_LANDMARKS:
        chosen = [chosen[k * len(chosen) // MOST_LANDMARKS] for k in range(MOST_LANDMARKS)]
    used = np.zeros(IDS, bool)
    for i in chosen:
        d = data[off[i] : off[i + 1]]
        two, three = _ids(d)
        used[two] = True
        used[three[2:]] = True
    column = np.zeros(IDS, np.int32)
    column[used] = 1 + np.arange(used.sum())
    width = int(used.sum()) + 1

    def rows(index):
        d = np.concatenate([data[off[i] : off[i + 1]] for i in index]) if index else data[:0]
        o = np.append(0, np.cumsum([off[i + 1] - off[i] for i in index]))
        return presence(d, o, column, *_ids(d), width)

    marks = rows(chosen)
    model = Model(languages, column, marks, np.zeros((len(chosen) + 1, len(languages))))
    size = model.norm
    kmm = (marks @ marks.T) / size[:, None] / size
    value, vector = np.linalg.eigh(kmm.astype(np.float64))
    keep = value > 1e-6 * max(value.max(), 1e-12)
    root = vector[:, keep] / np.sqrt(value[keep])  # kernel row -> Nyström features
    gram, moment = 0.0, 0.0
    number = {x: i for i, x in enumerate(languages)}
    y = np.array([number[x] for x in labels])
    count = np.bincount(y, minlength=len(languages))
    for a in range(0, len(texts), 256):
        index = list(range(a, min(a + 256, len(texts))))
        seen = rows(index)
        k = (seen @ marks.T) / np.sqrt(np.maximum(seen.sum(1), 1))[:, None] / size
        f = np.hstack([k @ root, np.ones((len(k), 1))])
        w = 1 / count[y[index]]  # languages weigh alike
        t = np.where(y[index][:, None] == np.arange(len(languages)), 1.0, -1.0)
        gram, moment = gram + (f * w[:, None]).T @ f, moment + (f * w[:, None]).T @ t
    solved = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), moment)
    model.weights = np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32)
    return model


def held_out():
    """Rows that the model doesn't learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, seed: int = 11) -> Model | None:
    """Fit on a bounded sample of the labelled rows that may be learned from, by hash; None without any.

    The sample: ``PER_LANGUAGE`` texts of each language, fewer if there are so many languages that this would
    exceed ``MOST_TEXTS``. Of one beyond ``LONGEST`` characters, a window at a place that its hash gives is learned
    from. Rows with a null id, text or language, or with an empty text, teach nothing; repeated ids are rows of their
    own, rows with equal id and text count once. Every language that has a text can be predicted, whatever the
    number of languages.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = own.where("doc_id is not null and lang is not null and text is not null").where(~held_out()).where("text <> ''").withColumn("key", row_key())
    sizes = materialise(known.select("lang", "key").distinct().groupBy("lang").count(), "languages")
    languages = sizes.count()
    if not languages:
        return None
    each = max(LEAST, min(PER_LANGUAGE, MOST_TEXTS // languages))
    # a share that gives somewhat more than is wanted, then the rank among those
    share = sizes.select("lang", F.greatest(1.5 * each / F.col("count"), F.lit(20.0) / F.col("count")).alias("share"))
    some = known.withColumn("unit", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30))).join(share, "lang").where(F.expr(f"unit < share * {1 << 30}"))
    place = F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.greatest(F.length("text") - LONGEST + 1, F.lit(1)).cast("long")).cast("int")
    some = some.withColumn("text", F.substring("text", place + 1, F.lit(LONGEST)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("unit", "key"))
    sample = some.dropDuplicates(["lang", "key"]).withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "unit", "key", "text")

    def run(batches):
        rows = sorted(((u, k, x, t) for b in batches for x, u, k, t in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:3])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[3] for r in rows], [r[2] for r in rows]))], pa.binary())], names=["model"])

    # the bounded sample meets in one task, whose memory is an executor's and not the driver's
    fitted = sample.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(fitted["model"]) if fitted else None


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def identify(docs: DataFrame, model: Model | None, *columns: str) -> DataFrame:
    """``columns`` of docs with ``lang_pred`` and ``score``; ``und`` and 0 for texts that are null, empty or have no letter.

    Without a model all are ``und``. Texts of any length are taken whole; ties go to the language that sorts
    first. Repeated rows are judged each by itself; columns that aren't asked for are left out, whatever their
    names. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks and the n-gram alphabet
    kept = [f for f in docs.schema.fields if f.name in columns]
    own = docs.select(*columns, F.col("text").cast("string").alias("__text"))

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            lang, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for a, b, data, off in text_chunks(texts, 1 << 20):
                if m is None:
                    break
                count = np.append(0, np.cumsum(_ASCII_LETTER[data]))
                letters = count[off[1:]] > count[off[:-1]]
                for i in np.flatnonzero(~letters & (np.diff(off) > 0)):
                    letters[i] = any(c.isalpha() for c in texts[a + int(i)].as_py())
                # rows of the presence matrix are bounded besides bytes: short texts
                for c in range(0, b - a, 512):
                    d = min(c + 512, b - a)
                    best, s = m.predict(data[off[c] : off[d]], off[c : d + 1] - off[c])
                    ok = letters[c:d]
                    lang[a + c : a + d][ok] = np.array(m.languages, object)[best[ok]]
                    score[a + c : a + d][ok] = s[ok]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], names=[*columns, "lang_pred", "score"])

    return own.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs), "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
