"""Language identification by a linear-chain conditional random field over words.

Each word has affix, byte n-gram and whole-word (lexicon) features, hashed into one weight table; transitions between
labels are learned with them by the likelihood of whole chains. Forward-backward gives each word its label
probabilities, so code-switched texts are labelled word by word; a document's language is the one that its words' mean
probability favours.

Training sees a bounded sample of labelled rows: SAMPLE documents, shared out to the labels and taken in the order of a
hash of their id, with the same number of words at most from each, spliced into chains that switch between languages.
Of a column with more than MOST_LABELS labels the most frequent are taught, each has a row in the sample, and the weight
table has the fewer rows the more labels there are: a model has a fixed size. Prediction sees whole texts, as chains of
CHAIN words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Labelled documents that training sees at most, and their words; words of a chain; size of the hashed weight table.
SAMPLE, SAMPLE_WORDS, CHAIN, TABLE = 1500, 300_000, 128, 1 << 18
EPOCHS, RATE, SEED = 5, 0.3, 13
#: Labels that are taught at most; weights (of all labels) that a model has at most; label probabilities that are held at a time.
MOST_LABELS, CELLS, AT_ONCE = 64, 1 << 22, 1 << 21
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_GRAMS = (2, 3, 4)


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def _families(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Weight rows of each feature family: (rows, None) for one per word, (rows, where) for one per byte; row 0 is zero."""
    bits = np.uint64(64 - int(size).bit_length() + 1)
    spans = common.Spans(common.BYTE_VALUES[0][raw], common.BASES[0])

    def rows(h: np.ndarray, salt: int) -> np.ndarray:
        return ((h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) >> bits).astype(np.int64) | 1

    lengths = ends - starts
    yield rows(common.word_hashes(raw, starts, ends, 1), 1), None
    for n in (1, 2, 3):
        fits = lengths >= n
        first, last = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        first[fits] = rows(spans.of(starts[fits], starts[fits] + n), 10 + n)
        last[fits] = rows(spans.of(ends[fits] - n, ends[fits]), 20 + n)
        yield first, None
        yield last, None
    if len(raw):
        end_of = np.zeros(len(raw), np.int64)
        at = common.ranges(starts, lengths)
        end_of[at] = np.repeat(ends, lengths)
        for n in _GRAMS:
            where = at[end_of[at] - at >= n]
            yield rows(spans.of(where, where + n), 30 + n), where


@dataclass
class Model:
    """Labels, hashed weights (row 0 is zero) and transitions."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    chain: int = CHAIN

    def scores(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What a word's features add up to, for each label."""
        out = np.zeros((len(starts), len(self.labels)), np.float32)
        if not len(starts):
            return out
        for rows, where in _families(raw, starts, ends, len(self.weights)):
            if where is None:
                out += self.weights[rows]
            elif len(where):
                first = np.searchsorted(where, starts)
                has = np.flatnonzero(first < np.append(first[1:], len(where)))
                out[has] += np.add.reduceat(self.weights[rows], first[has], axis=0)
        return out

    def marginals(self, scores: np.ndarray, chain_starts: np.ndarray, chain_ends: np.ndarray) -> np.ndarray:
        """Label probabilities of each word, by forward-backward over each chain."""
        out = np.zeros_like(scores)
        lengths = chain_ends - chain_starts
        order = np.argsort(-lengths, kind="stable")
        step = 2048 * 8 // max(8, len(self.labels))
        for i in range(0, len(order), step):
            mine = order[i : i + step]
            out_index, p, _, _ = forward_backward(scores, self.moves, chain_starts[mine], lengths[mine])
            out[out_index] = p
        return out


def forward_backward(scores: np.ndarray, moves: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Chains in descending order of length: word positions, their label probabilities, summed move probabilities, log-likelihood scale."""
    steps, labels = int(lengths.max()), scores.shape[1]
    push = np.exp(moves).astype(np.float32)
    alive = np.array([np.searchsorted(-lengths, -t, side="left") for t in range(steps)])  # chains longer than t
    local = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    ahead = np.zeros((steps, len(starts), labels), np.float32)
    scale = np.ones((steps, len(starts)), np.float32)
    for t in range(steps):
        n = alive[t]
        e = local[starts[:n] + t]
        a = e if t == 0 else (ahead[t - 1, :n] @ push) * e
        scale[t, :n] = a.sum(axis=1)
        ahead[t, :n] = a / scale[t, :n, None]
    back = np.ones((len(starts), labels), np.float32)
    total = np.zeros((labels, labels), np.float64)
    at, got = [], []
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        if t + 1 < steps and alive[t + 1]:
            m = alive[t + 1]
            right = local[starts[:m] + t + 1] * back[:m] / scale[t + 1, :m, None]
            total += push * (ahead[t, :m].T @ right)
            back[:m] = right @ push.T
        p = ahead[t, :n] * back[:n]
        got.append(p / p.sum(axis=1, keepdims=True))
        at.append(starts[:n] + t)
    return np.concatenate(at), np.concatenate(got), total, float(np.log(scale[scale > 0]).sum())


def train(texts: list[tuple[str, str]], size: int = TABLE, chain: int = CHAIN, epochs: int = EPOCHS, max_words: int = SAMPLE_WORDS) -> Model | None:
    """A model from (text, label) rows, or None where there is no word with a label. Deterministic."""
    labels = sorted({label for _, label in texts})
    if not labels:
        return None
    index = {label: i for i, label in enumerate(labels)}
    size = min(size, 1 << (max(CELLS // len(labels), 2).bit_length() - 1))
    rng = np.random.Generator(np.random.PCG64(SEED))
    pieces: list[tuple[list[bytes], int]] = []
    total = 0
    for text, label in texts:
        words = text.lower().encode().split()
        at = 0
        while at < len(words) and total < max_words:
            n = int(rng.integers(4, 40))
            pieces.append((words[at : at + n], index[label]))
            at += n
            total += len(words[at - n : at])
    if not pieces or not any(words for words, _ in pieces):
        return None
    # neighbours are pieces of any language half of the time, else as they follow in their document
    order = np.arange(len(pieces))
    moved = np.flatnonzero(rng.random(len(pieces)) < 0.5)
    order[moved] = rng.permutation(moved)
    tokens = [w for i in order for w in pieces[i][0]]
    gold = np.concatenate([np.full(len(pieces[i][0]), pieces[i][1]) for i in order])
    raw = np.frombuffer(b" ".join(tokens), np.uint8)
    starts, ends, _ = common.words(raw, np.array([0, len(raw)]))
    del pieces, tokens

    def features(lo: int, hi: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(weight rows, words) of each family for the words lo to hi: made when they are needed, so that they take a block's room."""
        base = starts[lo]
        at, out = starts[lo:hi] - base, []
        for rows, where in _families(raw[base : ends[hi - 1]], at, ends[lo:hi] - base, size):
            out.append((rows, np.arange(hi - lo) if where is None else np.searchsorted(at, where, side="right") - 1))
        return out

    model = Model(labels, np.zeros((size, len(labels)), np.float32), np.zeros((len(labels), len(labels)), np.float32), chain)
    sums, move_sums = np.full(model.weights.shape, 1e-3, np.float32), np.full(model.moves.shape, 1.0, np.float64)
    block = 64 * chain
    for _ in range(epochs):
        for b in rng.permutation(-(-len(starts) // block)):
            lo, hi = int(b) * block, min((int(b) + 1) * block, len(starts))
            mine = features(lo, hi)
            scores = np.zeros((hi - lo, len(labels)), np.float32)
            for rows, words in mine:
                for k in range(len(labels)):
                    scores[:, k] += np.bincount(words, model.weights[rows, k], hi - lo)
            first = np.arange(0, hi - lo, chain)
            lengths = np.minimum(chain, hi - lo - first)
            at, p, moves, _ = forward_backward(scores, model.moves, first, lengths)
            residual = np.zeros_like(scores)
            residual[at] = -p
            y = gold[lo:hi]
            residual[np.arange(hi - lo), y] += 1
            real = np.zeros_like(moves)
            inner = np.flatnonzero(np.arange(1, hi - lo) % chain != 0)
            np.add.at(real, (y[inner], y[inner + 1]), 1)
            grad = np.stack([np.bincount(np.concatenate([r for r, _ in mine]), np.concatenate([residual[w, k] for _, w in mine]), size) for k in range(len(labels))], axis=1).astype(np.float32)
            grad -= 1e-3 * model.weights
            sums += grad * grad
            model.weights += RATE * grad / np.sqrt(sums)
            model.weights[0] = 0
            step = real - moves - 1e-3 * model.moves
            move_sums += step * step
            model.moves = (model.moves + RATE * step / np.sqrt(move_sums)).astype(np.float32)
    return model


def quotas(counts: dict[str, int], sample: int) -> dict[str, int]:
    """How many rows of each label are taken: `sample` in all (one of each label at least), as evenly as there are rows."""
    out, left = {}, sample
    for i, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[label] = min(n, max(1, left // (len(counts) - i)))
        left -= out[label]
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, words: int = SAMPLE_WORDS, most_labels: int = MOST_LABELS) -> Model | None:
    """Trains on at most `sample` labelled rows that aren't held out, of each label those first in the order of a hash of their id, and `words` words of them.

    Taught are the `most_labels` labels (and no more than `sample`) with the most rows, ties to the lesser name. Of each
    sampled text the first words are seen, as many as its share, and no more than 64 characters for each of them.
    One task takes the sample, whose size is fixed, and gives the model (CELLS weights at most); the driver holds
    nothing but that. None where no row has a label, the table has no such column, or is empty.
    """
    chosen = sampled(docs, id_col, text_col, label_col, sample, words, most_labels) if label_col in docs.columns else None
    if chosen is None:
        return None

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((r["h"], r["label"], r["k"], r["text"]) for batch in batches for r in batch.to_pylist()), key=lambda r: r[:3])
        model = train([(text, label) for _, label, _, text in rows], max_words=max(words, len(rows)))
        if model:
            yield pa.RecordBatch.from_arrays([pa.array([model.labels], pa.list_(pa.string())), pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.moves.tobytes()], pa.binary())], names=["labels", "weights", "moves"])

    got = chosen.repartition(1).mapInArrow(common.tidy(learn), common.schema("labels array<string>, weights binary, moves binary")).collect()  # a model of CELLS weights at most
    if not got:
        return None
    n = len(got[0]["labels"])
    return Model(list(got[0]["labels"]), np.frombuffer(got[0]["weights"], np.float32).reshape(-1, n), np.frombuffer(got[0]["moves"], np.float32).reshape(n, n))


def sampled(docs: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, words: int, most_labels: int = MOST_LABELS) -> DataFrame | None:
    """h, label, k, text of the rows to train on, each text cut to its share of the words; None if no row has a label."""
    rows = common.pair(docs.filter(~held_out(id_col)), id_col, text_col, F.col(label_col).cast("string").alias("label")).filter("text IS NOT NULL AND label IS NOT NULL")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max(1, min(most_labels, sample))).collect()}  # a column of the model for each
    if not counts:
        return None
    most = quotas(counts, sample)
    # somewhat more than a label's quota passes a threshold on the hash, so that tasks don't each send a whole sample's texts
    share = {k: (2.0 * most[k] + 30) / n for k, n in counts.items()}
    top = [(k, most[k], 2**63 - 1 if share[k] >= 1 else -(2**63) + int(share[k] * 2**64)) for k in counts]
    told = F.broadcast(docs.sparkSession.createDataFrame(top, "label string, quota int, top long"))
    few = rows.withColumn("h", F.xxhash64("doc_id")).join(told, "label").filter("h <= top")
    each = max(1, words // sum(most.values()))
    start = F.substring(F.ltrim("text"), 1, 64 * each)  # bounds what is sent, where hardly any space parts words
    cut = F.array_join(F.slice(F.split(start, "[ \\t\\n\\x0B\\f\\r]+", each + 1), 1, each), " ")
    order = Window.partitionBy("label").orderBy("h", "doc_id", F.sha2("text", 256))
    return few.withColumn("k", F.row_number().over(order)).filter("k <= quota").select("h", "label", "k", cut.alias("text"))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of each row. A null text, or one without a letter, is `und` with score 0, as is all without a model."""
    spec = common.schema("doc_id long, lang_pred string, score double")
    held = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: the table and a row for each pair of labels

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, limit=1 << 19):
            names, scores = label_texts(held.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return common.pair(docs, id_col, text_col).mapInArrow(common.tidy(label), spec)


#: Score below which a text counts as in none of the learned languages: no language has most of its words' probability.
LEAST = 0.4


def keep_known(docs: DataFrame, model: Model | None, text_col: str = "text", label_col: str = "lang", least: float = LEAST) -> DataFrame:
    """Rows of docs with a predicted language (not `und`) and a score of at least `least`; the label column holds the prediction.

    A label column that isn't one of strings, or is missing, is left as it is. Without a model nothing can be told of a
    language: rows with a letter in their text stay as they are. Repeated rows stay or go together; an empty table
    stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    has = label_col in docs.columns and docs.schema[label_col].dataType.typeName() == "string"

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text_col).to_pylist()
        if held.value is None:
            return batch.filter(pa.array([has_letter(t) for t in texts], pa.bool_()))
        names, scores = label_texts(held.value, texts)
        if has:
            at = batch.schema.get_field_index(label_col)
            batch = batch.set_column(at, label_col, pa.array(names, pa.string()).cast(batch.schema.field(at).type))
        return batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return common.rows_like(docs, label, text_col)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def label_texts(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    known = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if known:
        encoded = [texts[i].lower().encode() for i in known]
        raw, off = np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([0, *map(len, encoded)])
        starts, ends, first = common.words(raw, off)
        counts = np.diff(first)
        chains = -(-counts // model.chain)
        begin = np.repeat(first[:-1], chains) + model.chain * (common.ranges(np.zeros(len(chains), np.int64), chains))
        stop = np.minimum(begin + model.chain, np.repeat(first[1:], chains))
        letters = np.concatenate(([0], np.cumsum(_LETTER[raw])))
        mean, text = np.zeros((len(known), len(model.labels))), np.repeat(np.arange(len(known)), counts)
        # chains follow each other without a gap: as many at a time as AT_ONCE probabilities allow, one at least
        part = stop // max(model.chain, AT_ONCE // len(model.labels))
        for mine in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1) if len(part) else []:
            lo, hi = begin[mine[0]], stop[mine[-1]]
            at, base = slice(lo, hi), starts[lo]
            p = model.marginals(model.scores(raw[base : ends[hi - 1]], starts[at] - base, ends[at] - base), begin[mine] - lo, stop[mine] - lo).astype(np.float64)
            p[letters[ends[at]] == letters[starts[at]]] = 0
            first_of = np.flatnonzero(np.append(True, text[lo + 1 : hi] != text[lo : hi - 1]))
            mean[text[lo + first_of]] += np.add.reduceat(p, first_of, axis=0)
        best = mean.argmax(axis=1)
        top = mean[np.arange(len(best)), best] / np.maximum(mean.sum(axis=1), 1e-12)
        for i, b, s in zip(known, best.tolist(), top.tolist(), strict=True):
            names[i], scores[i] = model.labels[b], round(min(max(s, 0.0), 1.0), 6)
    return names, scores


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, label, probability) of each word of a text, in order."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    starts, ends, _ = common.words(raw, np.array([0, len(raw)]))
    begin = np.arange(0, len(starts), model.chain)
    p = model.marginals(model.scores(raw, starts, ends), begin, np.minimum(begin + model.chain, len(starts)))
    return [(bytes(raw[s:e]).decode(), model.labels[int(q.argmax())], float(q.max())) for s, e, q in zip(starts, ends, p, strict=True)]


def op1_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = predict(docs, fit(docs))
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
