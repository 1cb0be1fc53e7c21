"""Toxicity by compression distance: windows that a dictionary trained on toxic text compresses better.

Two zstandard dictionaries are trained: on windows of ordinary documents, and on what sets toxic documents apart. Each
window of a document is compressed with the ordinary dictionary, and with both; the bytes that the toxic one saves are
the window's distance. A document's score is a logistic function, calibrated on other labelled documents, of how
many of its windows pass a calibrated threshold and of how far.

The plain method, a dictionary trained on windows of toxic documents beside one of ordinary documents, was measured
and gives no right results on these texts: toxic documents are mostly ordinary text, and what two dictionaries of it
happen to hold differs by more bytes than an insult saves. On the held-out fold of the 0.1 GB table it found 47 to
83 % of the toxic documents and flagged 28 to 48 % of the others, whatever the size of windows and dictionaries,
also after rounds in which it was trained again on the windows that it set apart best; trained on windows around
distinctive words only, and with the tables of both dictionaries in use, 88 % and 9 %. So the toxic dictionary is
trained on the words themselves: those with a beginning that stands in many more contexts in toxic than in ordinary
documents. Counting contexts (the words around) rather than documents keeps groups of near copies from passing their
own words for toxic ones. Both dictionaries are used as raw content, as differences in their entropy tables would count
as well.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, table

FOLDS = 5
#: The classifier is fitted on at most so many labelled documents of each class, none longer than MAX_FIT_CHARS.
FIT_TOXIC, FIT_ORDINARY, MAX_FIT_CHARS = 2000, 4000, 20_000
WINDOW, STEP = 4, 3
ORDINARY_BYTES, TOXIC_BYTES = 14_000, 2048
PREFIXES = range(4, 9)
WORD = re.compile(rb"[a-z\x80-\xff]{4,}")


def windows(text: str | None, size: int = WINDOW, step: int = STEP) -> list[bytes]:
    """Overlapping windows of words over the whole text; one empty window for a text without words."""
    words = (text or "").encode().lower().split()
    return [b" ".join(words[i : i + size]) for i in range(0, max(1, len(words) - size + step), step)]


def _contexts(texts: Iterable[str]) -> tuple[Counter, dict[bytes, set[bytes]]]:
    """How many distinct contexts each word beginning has, and the words with it."""
    seen: set[int] = set()
    counts: Counter = Counter()
    words: dict[bytes, set[bytes]] = {}
    for text in texts:
        ws = text.encode().lower().split()
        for i, raw in enumerate(ws):
            for w in WORD.findall(raw):
                around = (ws[i - 1] if i else b"", ws[i + 1] if i + 1 < len(ws) else b"")
                for k in PREFIXES:
                    if len(w) < k:
                        break
                    p = w[:k]
                    if (key := hash((p, around))) not in seen:
                        seen.add(key)
                        counts[p] += 1
                        words.setdefault(p, set()).add(w)
    return counts, words


def toxic_words(toxic: list[str], ordinary: list[str], least: int = 6, times: float = 8.0, share: float = 0.15) -> Counter:
    """Words whose beginning has far more contexts in toxic than in ordinary text, with the contexts' number."""
    a, words = _contexts(toxic)
    b, _ = _contexts(ordinary)
    na, nb = max(1, sum(map(len, toxic))), max(1, sum(map(len, ordinary)))
    set_apart = lambda p: a[p] > times * (b[p] + 0.5) * na / nb
    far = {p: n for p, n in a.items() if n >= least and set_apart(p)}
    # Beginnings far rarer than the commonest are chance, or words of a group of near copies.
    enough = share * max(far.values(), default=0)
    found: Counter = Counter()
    for p, n in far.items():
        if n >= enough:
            for w in (w for w in words[p] if all(set_apart(w[:k]) for k in PREFIXES if len(p) <= k <= len(w))):
                found[w] = max(found[w], n)
    return found


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; of too few samples the samples themselves."""
    try:
        return zs.train_dictionary(size, samples).as_bytes()
    except zs.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass
class Model:
    """Two dictionaries, a threshold in bytes and logistic weights; a few KB, whatever the corpus."""

    ordinary: bytes = b""
    toxic: bytes = b""
    threshold: int = 3
    weights: list[float] = field(default_factory=lambda: [-2.0, 1.0, 0.0, 0.0])
    _coders: tuple | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_coders": None}  # coders stay in their process

    def distances(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves, for each window."""
        if self._coders is None:
            made = []
            # The ordinary text stands last in both, so its matches cost the same and only toxic ones tell.
            for d in (self.ordinary, self.toxic + self.ordinary):
                p = zs.ZstdCompressionParameters(
                    format=zs.FORMAT_ZSTD1_MAGICLESS,
                    window_log=16,
                    hash_log=16,
                    chain_log=16,
                    search_log=5,
                    min_match=5,
                    target_length=64,
                    strategy=zs.STRATEGY_LAZY2,
                    write_content_size=0,
                    write_checksum=0,
                    write_dict_id=0,
                )
                kept = zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT)
                kept.precompute_compress(compression_params=p)
                made.append(zs.ZstdCompressor(dict_data=kept, compression_params=p).compress)
            self._coders = tuple(made)
        plain, both = self._coders
        return np.array([len(plain(w)) - len(both(w)) for w in windows(text)])

    def features(self, text: str | None) -> list[float]:
        d = self.distances(text)
        over = int((d >= self.threshold).sum())
        return [1.0, np.log1p(over), 10.0 * over / len(d), float(np.clip(d.max(), 0, 8))]

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.features(text), self.weights), -30, 30))))


def fit(rows: list[tuple[str, int, bool]], seed: int = 0) -> Model:
    """A model from (text, label, part): dictionaries from one part, threshold and weights from the other."""
    rows = sorted(set(rows))
    toxic, ordinary = ([t for t, y, part in rows if part and y == label] for label in (1, 0))
    model, draw = Model(), random.Random(seed)
    plain = [w for t in ordinary for w in windows(t, 8, 8)]
    model.ordinary = _trained(ORDINARY_BYTES, draw.sample(plain, min(len(plain), 30_000))) if plain else b""
    found = toxic_words(toxic, ordinary)
    samples = [b" " + w + b" " for w, n in sorted(found.items()) for _ in range(4)]
    draw.shuffle(samples)
    model.toxic = _trained(TOXIC_BYTES, samples) if samples else b""
    other = [(t, y) for t, y, part in rows if not part]
    y = np.array([y for _, y in other], float)
    if not 0 < y.sum() < len(y):
        return model
    most = np.array([model.distances(t).max() for t, _ in other])
    even = lambda k: (most[y == 1] >= k).mean() - (most[y == 0] >= k).mean()
    model.threshold = max(range(1, 9), key=even)
    x = np.array([model.features(t) for t, _ in other])
    w = np.zeros(x.shape[1])
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) * 0.5 + 0.5
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (balance * (y - p)) - 1e-2 * w
        curve = (x * (balance * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.clip(np.linalg.solve(curve, slope), -4, 4)
    model.weights = w.tolist()
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> list[tuple[str, int, bool]]:
    """(text, label, part) of a bounded sample of labelled documents outside the held-out fold, by hash of the id."""
    learn = labels.select("doc_id", F.col(label).alias("__y")).where(~held_out(F.col("doc_id")))
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got: list[tuple[str, int, bool]] = []
    for y, n in ((1, FIT_TOXIC), (0, FIT_ORDINARY)):
        # The ids of a sample are at most 2 n rows: long texts are left out of it below.
        ids = learn.where(F.col("__y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * n)
        short = docs.select("doc_id", "text").where(F.length("text") <= MAX_FIT_CHARS)
        chosen = short.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        got += [(r.text, y, r.part) for r in chosen.select("text", part.alias("part")).collect()]
    return got


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``, from its whole text alone.

    Null and empty texts get the score of a text without toxic windows. Repeated rows are scored alike; a null doc_id
    is scored and not held out; a score of exactly 0.5 is predicted 1; long texts are scored over all their windows; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.array([shared.value.score(t.as_py()) for t in b.column("text")], float)
            columns = [b.column("doc_id"), b.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(labelled_sample(docs, table(spark, sf_dir, "labels"))))


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
