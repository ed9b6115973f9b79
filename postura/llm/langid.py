"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, its letter n-grams and its place in a lexicon of known
words; they weigh for each language, and transitions weigh how languages follow each
other, so that a word in code-switched text is labelled by what it looks like and by its
neighbours. Weights are fitted by gradient ascent on the likelihood, with expectations from
forward-backward, to runs of words from a bounded sample of labelled texts, half of them
joined from two languages. A text's language is the one with the most expected words.

Every text is labelled whole, in one pass without a shuffle. Features of all different words
of many documents are looked up together, and the recursions run over their joined words in
segments: segment products first, then all segments side by side, which is exact whatever
a document's length. A word has all its features whatever its own length.

Defined results for odd input: a null text or one without a letter is `und` with score 0;
without any labelled text all are `und`; repeated rows each give their row; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, make_room, words

UNDETERMINED = "und"
#: Labelled texts that the weights are fitted to, at most; runs of words taken of each, and their length; runs made of them.
SAMPLE, SLICES, RUN, RUNS = 1500, 8, 30, 4000
STEPS, RATE, DECAY = 40, 0.5, 1e-6
#: Words a task labels together, and different words whose features it has in memory.
TOGETHER, WORDS = 200_000, 8192
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def features(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word): hashes of the words' affixes of 2 and 3 characters, their 1- to 3-grams with the ends marked, and the words themselves."""
    low = pc.utf8_lower(vocabulary).to_pylist()
    if not low:
        return np.zeros(0, U), np.zeros(0, np.int64)
    code = np.frombuffer(("^" + "$^".join(low) + "$").encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)  # no word has these two signs
    size = np.fromiter(map(len, low), np.int64, len(low)) + 2
    word, first = np.repeat(np.arange(len(low)), size), np.cumsum(size) - size
    spread = mix(code + U(0x9E3779B97F4A7C15))
    keys, owners = [], []
    gram = np.zeros(len(code), U)
    for k in (1, 2, 3):  # grams of k characters begin at all places but the last k - 1 of a word
        gram = mix(gram[: len(code) - k + 1] * U(31) + spread[k - 1 :])
        inside = word[: len(gram)] == word[k - 1 :]
        keys.append(gram[inside])
        owners.append(word[: len(gram)][inside])
    at = np.arange(len(code)) - first[word]
    whole = np.add.reduceat(mix(spread + at.astype(U) * U(0xD1B54A32D192ED03)), first)
    keys.append(mix(whole ^ U(1)))
    owners.append(np.arange(len(low)))
    for k in (3, 4):
        some = np.flatnonzero(size > k)
        for kind, start in ((2, first[some]), (3, first[some] + size[some] - k)):
            affix = np.full(len(some), kind, U)
            for i in range(k):
                affix = mix(affix * U(31) + spread[start + i])
            keys.append(affix)
            owners.append(some)
    return np.concatenate(keys), np.concatenate(owners)


class Model:
    """Labels, weights by feature (a row for each, a column for each label), transitions and starts.

    Features are found in a hash table with linear probing.
    """

    def __init__(self, labels: list[str], keys: np.ndarray, weights: np.ndarray, moves: np.ndarray, starts: np.ndarray):
        self.labels, self.moves, self.starts = labels, moves, starts
        size = 1 << max(4, int(4 * len(keys)).bit_length())
        self.mask = U(size - 1)
        self.row = np.full(size, -1, np.int32)
        self.keys, self.weights, self.probes = keys, weights, 1
        todo, at = np.arange(len(keys)), keys & self.mask
        while len(todo):  # of those that want a free place one gets it, the others look at the next place
            free = self.row[at] < 0
            self.row[at[free]] = todo[free]
            placed = self.row[at] == todo
            todo, at = todo[~placed], (at[~placed] + U(1)) & self.mask
            self.probes += 1

    def emissions(self, vocabulary: pa.Array) -> np.ndarray:
        """A row of label weights for each word; features of WORDS words at a time are in memory."""
        out = np.zeros((len(vocabulary), len(self.labels)), np.float32)
        for at in range(0, len(vocabulary) if len(self.keys) else 0, WORDS):
            self.add_weights(vocabulary.slice(at, WORDS), out[at : at + WORDS])
        return out

    def add_weights(self, vocabulary: pa.Array, out: np.ndarray) -> None:
        keys, owners = features(vocabulary)
        at = keys & self.mask
        for _ in range(self.probes):
            row = self.row[at]
            known = row >= 0
            keys, owners, at, row = keys[known], owners[known], at[known], row[known]
            same = self.keys[row] == keys
            found, whose = self.weights[row[same]], owners[same]
            for c in range(out.shape[1]):
                out[:, c] += np.bincount(whose, found[:, c], len(out))
            keys, owners, at = keys[~same], owners[~same], (at[~same] + U(1)) & self.mask
            if not len(keys):
                break

    def marginals(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Label probabilities of each word by forward-backward; first: the words that begin a sequence."""
        return forward_backward(scores, first, np.exp(self.moves), np.exp(self.starts), False)[0]


def forward_backward(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, starts: np.ndarray, count_moves: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(label probabilities of the words, expected number of moves from label to label).

    A word multiplies the row of forward weights by moves * diag(e), or at the beginning of a
    sequence by the matrix whose rows all are starts * e: then nothing passes from before.
    """
    n, k = scores.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k))
    length, ones = max(1, int(np.sqrt(n))), np.ones(k)
    rows = -(-n // length)
    e = np.ones((rows * length, k))
    e[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    begins = np.ones(rows * length, bool)
    begins[:n] = first
    e = e.reshape(rows, length, k).transpose(1, 0, 2)  # word by segment by label
    begins = begins.reshape(rows, length).T[:, :, None]

    def forward(x: np.ndarray, t: int) -> np.ndarray:
        """x (segments, label) past word t."""
        out = np.where(begins[t], (x @ ones)[:, None] * starts, x @ moves) * e[t]
        return out / (out @ ones)[:, None]

    def backward(y: np.ndarray, t: int) -> np.ndarray:
        """y (segments, label) before word t."""
        v = y * e[t]
        out = np.where(begins[t], (v @ starts)[:, None], v @ moves.T)
        return out / (out @ ones)[:, None]

    product = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for t in range(length):
        product = np.where(begins[t][:, :, None], product.sum(axis=2, keepdims=True) * starts, (product.reshape(-1, k) @ moves).reshape(rows, k, k)) * e[t][:, None, :]
        product /= product.max(axis=(1, 2), keepdims=True)
    before, after = np.full((rows, k), 1.0 / k), np.full((rows, k), 1.0 / k)
    for s in range(1, rows):
        v = before[s - 1] @ product[s - 1]
        before[s] = v / v.sum()
    for s in range(rows - 2, -1, -1):
        v = product[s + 1] @ after[s + 1]
        after[s] = v / v.sum()
    alpha = np.empty((length, rows, k))
    x = before
    for t in range(length):
        alpha[t] = x = forward(x, t)
    gamma = np.empty_like(alpha)
    pairs = np.zeros((k, k))
    y = after
    for t in range(length - 1, -1, -1):
        g = alpha[t] * y
        gamma[t] = g / (g @ ones)[:, None]
        if count_moves:
            left = alpha[t - 1] if t else before
            both = left[:, :, None] * moves * (y * e[t])[:, None, :]
            total = both.sum(axis=(1, 2), keepdims=True)
            pairs += np.where(begins[t][:, :, None], 0.0, both / total).sum(axis=0)
        y = backward(y, t)
    return gamma.transpose(1, 0, 2).reshape(-1, k)[:n], pairs


def runs(texts: list[tuple[list[list[str]], int]], rng: np.random.Generator) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, labels, first): runs of words, every other one continued by a run of another text."""
    usable = [([x for x in some if x], label) for some, label in texts if any(some)]
    out, labels, first = [], [], []
    for i in range(RUNS if usable else 0):
        for part in range(1 + i % 2):
            some, label = usable[rng.integers(len(usable))]
            ws = some[rng.integers(len(some))]
            if i % 2:
                size = int(rng.integers(3, RUN))
                at = int(rng.integers(max(1, len(ws) - size + 1)))
                ws = ws[at : at + size]
            out += ws
            labels += [label] * len(ws)
            first += [part == 0 and j == 0 for j in range(len(ws))]
    return out, np.array(labels, int), np.array(first, bool)


def fit(texts: list[tuple[list[list[str]], str]], seed: int = 7) -> Model:
    """Weights for (runs of words, language) pairs, by adaptive gradient ascent on the likelihood of all runs."""
    labels = sorted({x for _, x in texts})
    k = max(1, len(labels))
    sequence, gold, first = runs([(w, labels.index(x)) for w, x in texts], np.random.default_rng(seed))
    coded = pa.array(sequence, pa.string()).dictionary_encode()
    at, n = coded.indices.to_numpy(), len(coded.dictionary)
    keys, owner = features(coded.dictionary)
    keys, flat = np.unique(keys, return_inverse=True)
    weights, moves, starts = np.zeros((len(keys), k)), np.zeros((k, k)), np.zeros(k)
    squares = [np.full(x.shape, 1e-3) for x in (weights, moves, starts)]
    observed = np.eye(k)[gold] if len(gold) else np.zeros((0, k))
    inside = ~first[1:] if len(first) else first
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (gold[:-1][inside], gold[1:][inside]), 1)
    by_word = lambda x: np.stack([np.bincount(at, x[:, c], n) for c in range(k)], axis=1)
    for _ in range(STEPS if len(gold) else 0):
        emission = np.stack([np.bincount(owner, weights[flat, c], n) for c in range(k)], axis=1)
        p, pairs = forward_backward(emission[at], first, np.exp(moves), np.exp(starts))
        g = by_word(observed - p)
        steps = (
            np.stack([np.bincount(flat, g[owner, c], len(keys)) for c in range(k)], axis=1) / len(gold) - DECAY * weights,
            (gold_moves - pairs) / len(gold),
            (observed - p)[first].sum(axis=0) / len(gold),
        )
        for x, s, q in zip((weights, moves, starts), steps, squares):
            q += s * s
            x += RATE * s / np.sqrt(q)
    return Model(labels, keys, weights.astype(np.float32), moves, starts)


def learning(docs: DataFrame) -> DataFrame:
    """The labelled documents that may be learned from: crc32 of the id, as text, modulo 4 is not 2."""
    return docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fitted(docs: DataFrame) -> Model:
    """A model of at most SAMPLE labelled texts, dealt by a hash of the id; of each, SLICES runs of RUN words come to the driver."""
    known = learning(docs)
    share = max(1, known.select("doc_id").count() // SAMPLE)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select(words(F.col("text")).alias("ws"), "lang", F.xxhash64("doc_id").alias("h"), "doc_id")
    part = lambda i: F.slice("ws", (F.pmod(F.xxhash64("doc_id", i), F.greatest(F.size("ws") - RUN + 1, F.lit(1))) + 1).cast("int"), F.lit(RUN))
    rows = chosen.select("lang", "h", "doc_id", F.transform(F.sequence(F.lit(1), F.lit(SLICES)), part).alias("parts")).orderBy("h", "doc_id").limit(SAMPLE).collect()
    return fit([([list(x) for x in r.parts], r.lang) for r in rows])


def label_lists(lists: pa.ListArray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(label, share of the expected words) of each list of words; label -1 without words. Different words are looked up once."""
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    coded = lists.flatten().dictionary_encode()
    emission, words = model.emissions(coded.dictionary), coded.indices.to_numpy()
    best, shares, at = np.full(len(lists), -1), np.zeros(len(lists)), 0
    while at < len(lists):  # some TOGETHER words at a time
        k = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOGETHER, side="right")) - 1)
        sizes = np.diff(offsets[at : k + 1])
        first = np.zeros(offsets[k] - offsets[at], bool)
        first[offsets[at:k][sizes > 0] - offsets[at]] = True
        p = model.marginals(emission[words[offsets[at] : offsets[k]]], first)
        doc = np.repeat(np.arange(k - at), sizes)
        sums = np.stack([np.bincount(doc, p[:, c], k - at) for c in range(p.shape[1])], axis=1)
        most = sums.argmax(axis=1)
        share = np.clip(sums[np.arange(k - at), most] / np.maximum(sizes, 1), 0.0, 1.0)
        best[at:k], shares[at:k] = np.where(sizes > 0, most, -1), np.where(sizes > 0, share, 0.0)
        at = k
    return best, shares


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs, and the language and its score under the given names. Only the words go to Python, some BATCH_BYTES at a time."""
    bounded_batches(docs.sparkSession)
    if not model.labels:
        return docs.withColumns({names[0]: F.lit(UNDETERMINED), names[1]: F.lit(0.0)})
    spread = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size: a bounded sample's features

    @F.arrow_udf("struct<label:string,share:double>")
    def labelled(lists: pa.Array) -> pa.Array:
        model = spread.value
        known = [*model.labels, UNDETERMINED]
        make_room()
        label, share = label_lists(lists, model)
        give_back()
        return pa.StructArray.from_arrays([pa.array([known[i] for i in label], pa.string()), pa.array(share, pa.float64())], names=["label", "share"])

    text = F.coalesce("text", F.lit(""))
    found = F.when(F.rlike(text, F.lit(r"\p{L}")), words(F.col("text"))).otherwise(F.array().cast("array<string>"))
    rows = docs.withColumn("__labelled", labelled(found))
    return rows.withColumns({names[0]: F.col("__labelled.label"), names[1]: F.col("__labelled.share")}).drop("__labelled")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, fitted(docs)).drop("text")
