"""Toxicity by a subsequence-string-kernel SVM with Nyström landmarks.

The kernel of two words sums, over all common subsequences of three characters, ``DECAY`` to the power of
the spans they take in both words, so that a gap or an inserted character only weakens a match. Landmark
words span the feature space (Nyström), a linear SVM is trained in it, and as the kernel is an inner
product of subsequence weights, the trained machine folds into one table of weights per subsequence.

Training is multiple-instance learning on labelled sentences: only documents are labelled, a sentence is as
toxic as its strongest word, and the sentences of toxic documents that hold one are found in rounds, with
the strongest words of clean documents as counterexamples. The sample of labelled documents is bounded
(``SAMPLE`` documents by their class, in the order of a hash of their id). A document's score is a logistic function of its two
strongest words.

Defined results: words are lower-cased and stripped of outer punctuation; a run of three or more one-letter
words also counts as the word they spell, and a word as its letters alone; a very long word counts as its
overlapping pieces. Null, empty and white texts get the score of a text without any word. Rows that repeat a
document get its score each. Without both classes among the labels the score is the rate of label 1.
"""

from __future__ import annotations

import functools
import gc
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewatch.llm.words import LOWER, HashTable, flat_bytes, mix, range_hashes, shingle_hashes, slices, word_bounds, word_hashes

DECAY = 0.7
#: Characters are numbered modulo this; a subsequence of three is a place in a table of its cube.
SIGNS = 64
#: The longest span of a subsequence that counts, and the length of pieces of very long words.
SPAN, PIECE = 9, 24
LANDMARKS = 160
#: Labelled documents that are learned from: at most so many clean and so many toxic ones.
SAMPLE = (9000, 3000)
THRESHOLD = 0.3
_LOW = -4.0
#: Words of one clean text only that serve as counterexamples.
RARE = 30_000
_CACHE = 500_000

_EDGE = np.ones(256, bool)
_EDGE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_OUTER = ".,;:!?\"'()[]*#%$&-"
_NOT_LETTER = re.compile(r"[\W\d_]+")


@dataclass
class ToxicityModel:
    table: np.ndarray
    bias: float
    weights: tuple[float, float, float]
    key: str

    def probability(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        a, b, c = self.weights
        return 1 / (1 + np.exp(-np.clip(a + b * first + c * second, -30, 30)))


def _combinations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all subsequences of three that a word of n characters has, and their weights."""
    at = np.array([c for c in itertools.combinations(range(n), 3) if c[2] - c[0] < SPAN], np.int64).reshape(-1, 3)
    return at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


_known: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the words of each length: which they are, their subsequences as places in the table, the weights."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size):
        if n not in _known:
            _known[int(n)] = _combinations(int(n))
        at, weight = _known[int(n)]
        own = np.flatnonzero(size == n)
        for part in np.array_split(own, -(-len(own) * max(1, len(at)) // 500_000)):
            text = "".join([words[i] for i in part])
            codes = (np.frombuffer(text.encode("utf-32-le"), np.uint32) * np.uint32(2654435761) >> np.uint32(26)).astype(np.int64).reshape(len(part), n)
            yield part, (codes[:, at[:, 0]] * SIGNS + codes[:, at[:, 1]]) * SIGNS + codes[:, at[:, 2]], weight


def _self_kernel(places: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The kernel of each word with itself: squares of the summed weights of equal subsequences."""
    order = np.argsort(places, axis=1, kind="stable")
    sums = np.cumsum(np.broadcast_to(weight, places.shape)[0][order].astype(np.float64), axis=1)
    ordered = np.take_along_axis(places, order, 1)
    last = np.ones(places.shape, bool)
    last[:, :-1] = ordered[:, 1:] != ordered[:, :-1]
    total = np.zeros(len(places))
    rows, cols = np.nonzero(last)
    ends = sums[rows, cols]
    start = np.concatenate([[0.0], ends[:-1]])
    start[np.concatenate([[True], rows[1:] != rows[:-1]])] = 0
    np.add.at(total, rows, (ends - start) ** 2)
    return total


def decisions(words: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's decision for each word; words of under three characters have the lowest."""
    out = np.full(len(words), _LOW)
    for part, places, weight in _by_length(words):
        if len(weight):
            out[part] = (table[places] @ weight) / np.sqrt(_self_kernel(places, weight)) + bias
    return np.maximum(out, _LOW)


@functools.lru_cache(50_000)
def forms(word: str) -> list[str]:
    """What a word counts as: itself, its letters alone, or the pieces of either if very long."""
    word = word.lower()
    letters = _NOT_LETTER.sub("", word)
    out = [word] if letters == word or not letters else [word, letters]
    return [w[i : i + PIECE] for w in out for i in range(0, max(1, len(w) - PIECE // 2), PIECE // 2)]


def _spelled(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, str]]:
    """(text, word) for runs of three or more one-letter words in a text."""
    lead = raw[np.minimum(starts, len(raw) - 1)]
    single = ((ends - starts == 1) & ~_EDGE[lead]) | ((ends - starts == 2) & (lead >= 0xC3) & (lead < 0xE0))
    if single.sum() < 3:
        return
    edges = np.zeros(len(single) + 1, bool)
    edges[first] = True
    begin = np.flatnonzero(single & (edges[:-1] | ~np.concatenate([[False], single[:-1]])))
    end = np.flatnonzero(single & (edges[1:] | ~np.concatenate([single[1:], [False]]))) + 1
    data = raw.tobytes()
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        if b - a >= 3:
            text = int(np.searchsorted(first, a, "right")) - 1
            yield text, "".join(data[starts[i] : ends[i]].decode(errors="ignore") for i in range(a, b))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (lower-cased A-Z), starts and ends of the words without outer punctuation, first word of each text."""
    raw, offsets = flat_bytes(texts)
    raw = LOWER[raw]
    starts, ends, first = word_bounds(raw, offsets)
    for _ in range(6):
        move = (ends > starts) & _EDGE[raw[np.minimum(starts, max(len(raw) - 1, 0))]] if len(raw) else np.zeros(0, bool)
        starts = starts + move
        back = (ends > starts) & _EDGE[raw[np.maximum(ends - 1, 0)]] if len(raw) else np.zeros(0, bool)
        ends = ends - back
        if not (move.any() or back.any()):
            break
    return raw, starts, ends, first


class WordScores:
    """Decisions of words by their hash, each computed once in a worker process."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self._table, self._value, self._n = HashTable(), np.zeros(1024, np.float32), 0

    def strongest(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The two highest decisions among the words of each text."""
        raw, starts, ends, first = words_of(texts)
        n = len(texts)
        top = np.full((2, n), _LOW)
        if len(starts):
            keys = range_hashes(raw, starts, ends)
            at = self._table.get(keys)
            if (at < 0).any():
                if self._n > _CACHE:
                    self._clear()
                    at[:] = -1
                new, where = np.unique(keys[at < 0], return_index=True)
                where = np.flatnonzero(at < 0)[where]
                data = raw.tobytes()
                score = self._score([data[a:b].decode(errors="ignore") for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
                if self._n + len(new) > len(self._value):
                    self._value = np.concatenate([self._value, np.zeros(max(self._n, len(new)), np.float32)])
                self._value[self._n : self._n + len(new)] = score
                self._table.put(new, np.arange(self._n, self._n + len(new)))
                self._n += len(new)
                at = self._table.get(keys)
            score = self._value[at].astype(np.float64)
            full = np.flatnonzero(np.diff(first))
            text = np.repeat(np.arange(n), np.diff(first))
            top[0, full] = np.maximum.reduceat(score, first[:-1][full])
            best = np.flatnonzero(score == top[0, text])
            score[best[np.unique(text[best], return_index=True)[1]]] = _LOW
            top[1, full] = np.maximum.reduceat(score, first[:-1][full])
            for i, word in _spelled(raw, starts, ends, first):
                own = float(self._score([word])[0])
                top[:, i] = sorted([*top[:, i], own], reverse=True)[:2]
        return top[0], top[1]

    def _score(self, words: list[str]) -> np.ndarray:
        several = [forms(w) for w in words]
        flat = decisions([f for x in several for f in x], self.model.table, self.model.bias)
        size = np.fromiter(map(len, several), np.int64, len(several))
        return np.maximum.reduceat(flat, np.cumsum(size) - size)


def _kernel(words: list[str], marks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised kernel of words and landmarks, the landmarks' subsequences, and their weights in each landmark."""
    column = np.full(SIGNS**3, -1, np.int64)
    features, norm = {}, np.ones(len(marks))
    for part, places, weight in _by_length(marks):
        norm[part] = np.sqrt(_self_kernel(places, weight)) if len(weight) else 1
        for i, row in zip(part.tolist(), places, strict=True):
            features[i] = row, weight
    present = np.unique(np.concatenate([row for row, _ in features.values()]))
    column[present] = np.arange(len(present))
    sums = np.zeros((len(present) + 1, len(marks)), np.float32)
    for i, (row, weight) in features.items():
        np.add.at(sums[:, i], column[row], weight / norm[i])
    out = np.zeros((len(words), len(marks)), np.float32)
    for part, places, weight in _by_length(words):
        if len(weight):
            own = np.sqrt(_self_kernel(places, weight)).astype(np.float32)
            value = np.zeros((len(part), len(marks)), np.float32)
            for k in range(places.shape[1]):
                value += weight[k] * sums[column[places[:, k]]]
            out[part] = value / own[:, None]
    return out, present, sums[:-1]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    v = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(25):
        inside = y * (x @ v) < 1
        xi, wi = x[inside], c * weight[inside]
        new = np.linalg.solve(ridge + (xi * wi[:, None]).T @ xi, (xi * wi[:, None]).T @ y[inside])
        if np.allclose(new, v, atol=1e-6):
            break
        v = new
    return v


def _with_insertion(word: str, rng: np.random.Generator) -> str:
    """The word with a letter or sign put in or in place of one."""
    at, sign = int(rng.integers(1, max(2, len(word) - 1))), "abcdefghijklmnopqrstuvwxyz.-*_1"[int(rng.integers(31))]
    return word[:at] + sign + word[at + int(rng.random() < 0.3) :]


def _telling(has: np.ndarray, n: list[int]) -> np.ndarray:
    """Which items toxic texts hold so much oftener than clean ones that no item of all would by chance (a Chernoff bound)."""
    rate, total = n[1] / (n[0] + n[1]), has.sum(axis=0)
    own = has[1] / np.maximum(total, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = total * (np.where(own > 0, own * np.log(own / rate), 0) + np.where(own < 1, (1 - own) * np.log((1 - own) / (1 - rate)), 0))
    return (own > rate) & (bound > np.log(has.shape[1] + 1) + 2) & (has[0] * n[1] < 0.05 * has[1] * n[0])


def _unlike(texts: list[str], toxic: list[int]) -> tuple[list[str], list[int]]:
    """Without texts that share one of four min-hashes of word triples with an earlier one, as copies do."""
    seen, kept, i = set(), [], 0
    for part in slices(pa.array(texts)):
        words, first = word_hashes(part)
        h, offsets = shingle_hashes(words, first, 3)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            marks = {(k, int(mix(h[a:b] + np.uint64(k)).min())) for k in range(4)} if b > a else set()
            if not marks & seen:
                kept.append(i)
            seen |= marks
            i += 1
    return [texts[i] for i in kept], [toxic[i] for i in kept]


def train(texts: list[str], toxic: list[int], rounds: int = 3) -> ToxicityModel:
    """Trains on labelled texts; see the module's text. The lists are used up, so that the sample is held once."""
    rate = float(np.mean(toxic)) if toxic else 0.0
    blank = ToxicityModel(np.zeros(SIGNS**3, np.float32), _LOW, (float(np.log((rate + 1e-3) / (1 - rate + 1e-3))), 0.0, 0.0), "blank")
    if not 0 < rate < 1:
        return blank
    texts[:], toxic[:] = _unlike(texts, toxic)
    number: dict[str, int] = {}
    bags, label = [], np.array(toxic)  # the distinct words of each text, by number
    for t in texts:
        own = {number.setdefault(f, len(number)) for w in set(t.split()) for f in forms(w.strip(_OUTER)) if len(f) > 2}
        bags.append(np.fromiter(own, np.int32, len(own)))
    texts.clear()  # as large as the sample; only the words are needed from here on
    n = [int((label == 0).sum()), int((label == 1).sum())]
    has = np.array([np.bincount(np.concatenate([b for b, y in zip(bags, toxic, strict=True) if y == k] or [np.zeros(0, np.int32)]), minlength=len(number)) for k in (0, 1)], np.float64)
    # Words of one clean text only serve as counterexamples; a bounded number of them is enough.
    rng = np.random.default_rng(0)
    names = np.array(list(number), object)
    order = np.argsort(names, kind="stable")
    rare = order[(has[0] == 1)[order] & (has[1] == 0)[order]]
    used = np.ones(len(names), bool)
    used[rng.permutation(rare)[RARE:]] = False
    place = np.cumsum(used) - 1
    vocabulary, has = names[used].tolist(), has[:, used]
    bags = [place[b[used[b]]] for b in bags]
    del number, names
    # Where the search for witnesses begins: words that toxic texts hold by more than chance among so many words.
    positive = np.flatnonzero(_telling(has, n))
    if not len(positive):
        positive = np.argsort(has[0] / (n[0] + 1) - has[1] / (n[1] + 1), kind="stable")[:20]
    clean = np.flatnonzero(has[0] > 0)
    negative = np.unique(np.concatenate([clean[np.argsort(-has[0][clean], kind="stable")[:2000]], rng.choice(clean, min(len(clean), 6000), replace=False)]))
    table, bias, decided = None, 0.0, None
    for turn in range(rounds):
        marks = [vocabulary[i] for i in (rng.choice(positive, min(len(positive), LANDMARKS * 3 // 4), replace=False))]
        marks += [vocabulary[i] for i in rng.choice(negative, min(len(negative), LANDMARKS - len(marks)), replace=False)]
        shaken = [_with_insertion(vocabulary[i], rng) for i in positive for _ in range(2)]
        own = [vocabulary[i] for i in positive] + shaken + [vocabulary[i] for i in negative]
        k, present, sums = _kernel(own + marks, marks)
        value, vectors = np.linalg.eigh(k[-len(marks) :].astype(np.float64) + 1e-4 * np.eye(len(marks)))
        root = vectors / np.sqrt(np.maximum(value, 1e-4)) @ vectors.T
        y = np.where(np.arange(len(own)) < 3 * len(positive), 1.0, -1.0)
        v = _svm(k[: len(own)] @ root, y, np.where(y > 0, 1 / (3 * len(positive)), 2 / len(negative)) * len(y) / 4)
        table = np.zeros(SIGNS**3, np.float32)
        table[present] = sums @ (root @ v[:-1])
        bias = float(v[-1])
        decided = decisions(vocabulary, table, bias)
        if turn + 1 < rounds:
            # Witnesses: the strongest word of the strongest sentence of each toxic text, and whatever decides like one.
            witness = {int(b[np.argmax(decided[b])]) for b, y in zip(bags, toxic, strict=True) if y and len(b)}
            strong = np.flatnonzero((decided > 0.3) & (has[0] == 0) & (has[1] >= 2))
            positive = np.unique(np.concatenate([positive, strong, np.array([i for i in sorted(witness) if has[0][i] * n[1] < 0.2 * has[1][i] * n[0]], np.int64)]))
            hard = clean[np.argsort(-decided[clean], kind="stable")[:3000]]
            negative = np.setdiff1d(np.union1d(negative, hard), positive)
    top = np.array([np.sort(np.concatenate([decided[b], [_LOW, _LOW]]))[:-3:-1] for b in bags])
    y = np.array(toxic, np.float64)
    x = np.column_stack([np.ones(len(top)), top])
    w, ridge = np.zeros(3), np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -3, 3)
    return ToxicityModel(table, bias, tuple(float(a) for a in w), f"{hash((table.tobytes(), bias)):x}")


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> ToxicityModel:
    """Trains on at most ``sample[label]`` documents of each label, chosen by a hash of their id. ``labels(doc_id, toxic)``."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [labels.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[k]) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # sum(sample) rows at most
    sample_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("doc_id", "toxic", "text")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic", "text")), strict=True)]
        rows.sort(key=lambda r: r[:2])
        texts, toxic = [r[2] or "" for r in rows], [r[1] for r in rows]
        del rows
        m = train(texts, toxic)
        # The worker goes on with other tasks: nothing of the sample stays with it.
        forms.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_pydict({"table": [m.table.tobytes()], "bias": [m.bias], "weights": [list(m.weights)], "key": [m.key]})

    # The bounded sample is one task's work on an executor; the driver gets the model, 1 MB.
    found = sample_rows.repartition(1).mapInArrow(learn, "table binary, bias double, weights array<double>, key string").collect()
    if not found:
        return train([], [])
    m = found[0]
    return ToxicityModel(np.frombuffer(m.table, np.float32), m.bias, tuple(m.weights), m.key)


_scores: dict[str, WordScores] = {}


def score_toxicity(docs: DataFrame, model: ToxicityModel, column: str = "toxicity") -> DataFrame:
    """``docs`` with its columns and the score of its ``text``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # one table of fixed size, 1 MB
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        if model.key not in _scores:
            _scores.clear()
            _scores[model.key] = WordScores(model)
        scores = _scores[model.key]
        for batch in batches:
            parts = [scores.strongest(x) for x in slices(batch.column(batch.schema.get_field_index("text")))]
            p = model.probability(*(np.concatenate([x[k] for x in parts]) if parts else np.zeros(0) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def held_out() -> F.Column:
    """Whether a document's label is kept from training."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit_toxicity(docs, labels.where(~held_out()))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
