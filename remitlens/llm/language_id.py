"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the lower-cased bytes of a word forwards and backwards and
gives language probabilities at every byte position. A document pools them: the
mean log-probability of each word's positions, summed over its words. State
starts afresh at every word, so equal words have equal labels and a task runs the
network once per distinct word; every word of the whole text counts.

The network is trained in numpy by backpropagation through time, on the driver,
from the word counts of all documents that may be learned from.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from remitlens.llm import hashing
from remitlens.llm.store import pinned, prepare
from remitlens.operators.scans import exact_percentiles

UNDETERMINED = "und"
#: Class of the noise words in a network; no value of a language column.
NOISE = "\x00noise"
LONGEST = 24  # bytes of a word read at once; longer words are cut
REMEMBERED = 500_000
_LETTER = re.compile(r"[^\W\d_]")  # also numbers that are no digits, like ½; see _has_letter
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _has_letter(text: str | None) -> bool:
    """Whether a character of Unicode category L occurs."""
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def _cut(word: bytes) -> list[bytes]:
    """The pieces that the network reads of a word."""
    return [word[k : k + LONGEST] for k in range(0, len(word), LONGEST)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Weights: byte inputs ``w`` and recurrences ``u`` per direction, output ``v`` and bias ``c``.

    The outputs are the languages and, with ``noise``, one more for words of none.
    """

    languages: list[str]
    w: list[np.ndarray]
    u: list[np.ndarray]
    v: list[np.ndarray]
    c: np.ndarray
    noise: bool = False

    @staticmethod
    def fresh(languages: list[str], hidden: int, seed: int, noise: bool = False) -> Network:
        random = np.random.default_rng(seed)
        draw = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
        n = len(languages) + noise
        return Network(
            languages, [draw(256, 3 * hidden, scale=0.3) for _ in range(2)], [draw(hidden, 3 * hidden, scale=hidden**-0.5) for _ in range(2)],
            [draw(hidden, n, scale=0.1) for _ in range(2)], np.zeros(n, np.float32), noise,
        )

    @property
    def parameters(self) -> list[np.ndarray]:
        return [*self.w, *self.u, *self.v, self.c]

    def _states(self, x: np.ndarray, side: int) -> tuple[np.ndarray, list]:
        """Hidden states (batch, length, hidden) in the order of ``x`` and what the backward pass needs."""
        inputs, u = self.w[side][x], self.u[side]
        size = u.shape[0]
        h, states, memory = np.zeros((len(x), size), np.float32), np.empty((*x.shape, size), np.float32), []
        for t in range(x.shape[1]):
            own = h @ u
            gates = _sigmoid(inputs[:, t, : 2 * size] + own[:, : 2 * size])
            z, r, a = gates[:, :size], gates[:, size:], own[:, 2 * size :]
            n = np.tanh(inputs[:, t, 2 * size :] + r * a)
            memory.append((h, z, r, a, n))
            h = n + z * (h - n)
            states[:, t] = h
        return states, memory

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(batch, length, languages) for a batch of byte rows of one length."""
        forward, backward = self._states(x, 0)[0], self._states(x[:, ::-1], 1)[0][:, ::-1]
        logits = forward @ self.v[0] + backward @ self.v[1] + self.c
        logits -= logits.max(-1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(-1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss of labelling every position of ``x`` with its word's language, and its gradients."""
        runs = [self._states(x, 0), self._states(x[:, ::-1], 1)]
        forward, backward = runs[0][0], runs[1][0][:, ::-1]
        logits = forward @ self.v[0] + backward @ self.v[1] + self.c
        logits -= logits.max(-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(-1, keepdims=True)
        target = np.zeros_like(p)
        target[np.arange(len(x))[:, None], np.arange(x.shape[1])[None], y[:, None]] = 1
        loss = -float((np.log(p + 1e-9) * target).sum() / x.size)
        d = ((p - target) / x.size).astype(np.float32)
        dw, du, dv = [], [], []
        for side, states in ((0, forward), (1, backward)):
            dv.append(states.reshape(-1, states.shape[-1]).T @ d.reshape(-1, d.shape[-1]))
            upstream = d @ self.v[side].T
            seen = x if side == 0 else x[:, ::-1]
            a, b = self._backward(seen, upstream if side == 0 else upstream[:, ::-1], runs[side][1], side)
            dw.append(a)
            du.append(b)
        return loss, [*dw, *du, *dv, d.sum((0, 1))]

    def _backward(self, x: np.ndarray, upstream: np.ndarray, memory: list, side: int) -> tuple[np.ndarray, np.ndarray]:
        u = self.u[side]
        size = u.shape[0]
        du, inputs, dh = np.zeros_like(u), np.empty((*x.shape, 3 * size), np.float32), np.zeros((len(x), size), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            h, z, r, a, n = memory[t]
            dh = dh + upstream[:, t]
            dn = dh * (1 - z) * (1 - n * n)
            dz, dr = dh * (h - n) * z * (1 - z), dn * a * r * (1 - r)
            inputs[:, t] = np.concatenate([dz, dr, dn], 1)
            own = np.concatenate([dz, dr, dn * r], 1)
            du += h.T @ own
            dh = dh * z + own @ u.T
        one_hot = np.zeros((x.size, 256), np.float32)
        one_hot[np.arange(x.size), x.ravel()] = 1
        return one_hot.T @ inputs.reshape(x.size, -1), du


def _byte_rows(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of lower-cased bytes."""
    return _LOWER[np.frombuffer(b"".join(words), np.uint8)].reshape(len(words), -1)


def fit(counts: list[tuple[str, bytes, int]], hidden: int = 16, steps: int = 700, batch: int = 384, seed: int = 7) -> Network:
    """Train on (language, word, count) rows; every language weighs the same. Adam, fixed seed."""
    counts = sorted((a, piece, n) for a, w, n in counts for piece in _cut(w))
    classes = sorted({a for a, _, _ in counts}, key=lambda a: (a == NOISE, a))
    net = Network.fresh([a for a in classes if a != NOISE], hidden, seed, NOISE in classes)
    if not classes:
        return net
    label = np.array([classes.index(a) for a, _, _ in counts])
    length = np.array([len(w) for _, w, _ in counts])
    weight = np.array([n for _, _, n in counts], float) ** 0.75
    weight /= np.bincount(label, weight)[label]
    random = np.random.default_rng(seed)
    lengths = np.unique(length)
    mass = np.array([(weight * length)[length == k].sum() for k in lengths])
    rows = {k: np.flatnonzero(length == k) for k in lengths.tolist()}
    first = [np.zeros_like(p) for p in net.parameters]
    second = [np.zeros_like(p) for p in net.parameters]
    for step in range(1, steps + 1):
        k = int(random.choice(lengths, p=mass / mass.sum()))
        own = rows[k]
        pick = own[random.choice(len(own), batch, p=weight[own] / weight[own].sum())]
        _, gradients = net.gradients(_byte_rows([counts[i][1] for i in pick]), label[pick])
        rate = 0.02 * (1 - step / (steps + 1)) + 0.001
        for p, g, m, s in zip(net.parameters, gradients, first, second):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _word_counts(batches):
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])
    for batch in batches:
        for part in hashing.slices(batch, "text"):
            w = hashing.words(part.column("text"), separators=hashing.PUNCTUATION, codes=hashing.LOWERED)
            lang = part.column("lang").dictionary_encode()
            spoken = np.repeat(lang.indices.to_numpy(zero_copy_only=False), w.counts)
            found: dict[tuple[str, bytes], int] = {}
            for k, name in enumerate(lang.dictionary.to_pylist()):
                own = np.flatnonzero(spoken == k)
                _, first, counts = np.unique(w.hashes[own], return_index=True, return_counts=True)
                for start, end, n in zip(w.starts[own[first]].tolist(), w.ends[own[first]].tolist(), counts.tolist()):
                    for piece in _cut(w.data[start:end].tobytes().lower()):
                        found[name, piece] = found.get((name, piece), 0) + n
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()), pa.array(list(found.values()), pa.int64())],
                schema=schema,
            )


def learnable() -> F.Column:
    """Rows that may be learned from: four of five, by checksum of the id."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0


def _of_frequent_languages(rows: DataFrame, most_languages: int = 1000) -> DataFrame:
    """Rows of the ``most_languages`` most frequent languages."""
    frequent = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    return rows.join(F.broadcast(frequent.select("lang")), "lang", "left_semi")


def _allow_limit(spark: SparkSession, rows: int) -> None:
    """Let Spark limit ranked groups of up to ``rows`` rows before it shuffles them."""
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(spark.conf.get(key, "1000")) < rows:
        spark.conf.set(key, str(rows))


def noise_words(words: list[bytes], n: int, seed: int = 5) -> list[bytes]:
    """``n`` words of no language: letters of ``words`` in random order and number, and random letters of random scripts."""
    random = np.random.default_rng(seed)
    letters = np.array(list(b"".join(words).decode("utf-8", "ignore")) or ["a"])
    lengths = np.array([len(w) for w in words] or [5])
    out = []
    for k in range(n):
        length = max(1, int(random.choice(lengths)))
        if k % 3 == 0:
            text = "".join(random.choice(letters, length))
        elif k % 3 == 1:
            text = bytes(random.integers(0x61, 0x7B, length, np.uint8)).decode()
        else:  # a block of 64 neighbouring letters, anywhere behind Latin
            block = int(random.choice([random.integers(0x370, 0x800), random.integers(0x800, 0xD000)]))
            text = "".join(map(chr, random.integers(block, block + 64, -(-length // 2))))
        out += _cut(text.encode().lower())[:1]
    return out


def train(docs: DataFrame, words_per_language: int = 8_000, noise: int = 8_000, **settings) -> Network:
    """Network for the values of ``lang`` in ``docs(doc_id, text, lang)``.

    It also learns ``noise`` words of no language, a class that no text is given as
    its language; ``identify`` then tells the margin to it.

    Counts the words of all rows with a non-null doc_id, text and lang whose checksum
    allows it, and learns the ``words_per_language`` most frequent words of each language
    (of the 1000 most frequent values of ``lang``). Both bounds hold at any size of the
    table: the words are limited on each task before they are gathered.
    """
    prepare(docs.sparkSession)
    _allow_limit(docs.sparkSession, words_per_language)
    usable = docs.where("doc_id is not null and text is not null and lang is not null").where(learnable())
    counted = _of_frequent_languages(usable.select("lang", "text")).select("lang", "text").mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # the limit also runs before the shuffle; what is collected is bounded per language
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counted.withColumn("nth", nth).where(F.col("nth") <= words_per_language).select("lang", "word", "n")
    rows = [(r.lang, bytes(r.word), r.n) for r in top.collect()]
    if not rows:
        return fit([])
    return fit([*rows, *((NOISE, w, 1) for w in noise_words([w for _, w, _ in rows], noise))], **settings)


class _Labels:
    """Mean log-probabilities of words, remembered by hash for the task."""

    def __init__(self, net: Network):
        self._net = net
        self._keys = np.zeros(0, np.uint64)
        self._values = np.zeros((0, len(net.c)), np.float32)

    def of(self, w: hashing.Words) -> np.ndarray:
        """(words, languages) for all words of a batch."""
        keys, first, place = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self._keys) > REMEMBERED:
            self._keys, self._values = self._keys[:0], self._values[:0]
        at = np.searchsorted(self._keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self._keys)
        known[inside] = self._keys[at[inside]] == keys[inside]
        out = np.empty((len(keys), self._values.shape[1]), np.float32)
        out[known] = self._values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self._run(w, first[new])
            self._keys = np.concatenate([self._keys, keys[new]])
            order = np.argsort(self._keys)
            self._keys = self._keys[order]
            self._values = np.concatenate([self._values, out[new]])[order]
        return out[place]

    def _run(self, w: hashing.Words, chosen: np.ndarray) -> np.ndarray:
        starts, ends = w.starts[chosen], w.ends[chosen]
        pieces = -(-(ends - starts) // LONGEST)
        owner = np.repeat(np.arange(len(chosen)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[owner] + nth * LONGEST
        length = np.minimum(ends[owner] - begin, LONGEST)
        sums = np.zeros((len(chosen), self._values.shape[1]))
        for k in np.unique(length).tolist():
            rows = np.flatnonzero(length == k)
            for i in range(0, len(rows), 4096):
                own = rows[i : i + 4096]
                x = _LOWER[w.data[begin[own][:, None] + np.arange(k)]]
                np.add.at(sums, owner[own], self._net.log_probabilities(x).sum(1))
        return (sums / (ends - starts)[:, None]).astype(np.float32)


def identify(docs: DataFrame, net: Network, with_margin: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1); only ``text`` is read.

    Defined cases: a null text, one without a letter and any text under a network
    without languages are ``und`` with score 0; texts of any length are used
    whole; equal sums go to the first language by name; columns of ``docs`` named
    lang_pred, score or margin are replaced, all others pass through; an empty table
    gives an empty table.

    ``with_margin`` adds ``margin``: how much likelier the language is than noise, as
    the mean logarithm per position and word, so that it does not grow with the text;
    0 where there is no language and under a network that did not learn noise.
    """
    prepare(docs.sparkSession)
    base = docs.drop("lang_pred", "score", "margin")

    def run(batches):
        labels = _Labels(net)
        spoken = len(net.languages)
        names = np.array([*net.languages, UNDETERMINED], object)
        for batch in batches:
            for part in hashing.slices(batch, "text"):
                column = part.column("text")
                w = hashing.words(column, separators=hashing.PUNCTUATION, codes=hashing.LOWERED)
                lettered = np.array([_has_letter(t) for t in column.to_pylist()], bool)
                best, score, margin = np.full(part.num_rows, spoken), np.zeros(part.num_rows), np.zeros(part.num_rows)
                if spoken and len(w.hashes):
                    total = np.zeros((part.num_rows + 1, len(net.c)))
                    full = np.flatnonzero(w.counts > 0)
                    total[full] = np.add.reduceat(labels.of(w).astype(float), w.offsets[full])
                    every, total = total[:-1], total[:-1, :spoken]
                    if net.noise:
                        own = total.max(1) - every[:, spoken]
                        margin[lettered] = (own / np.maximum(w.counts, 1))[lettered]
                    total = total - total.max(1, keepdims=True)
                    p = np.exp(total)
                    p /= p.sum(1, keepdims=True)
                    best[lettered], score[lettered] = p.argmax(1)[lettered], p.max(1)[lettered]
                new = {"lang_pred": pa.array(names[best], pa.string()), "score": pa.array(score)} | ({"margin": pa.array(margin)} if with_margin else {})
                yield pa.RecordBatch.from_arrays([*part.columns, *new.values()], names=[*part.schema.names, *new])

    return base.mapInArrow(run, f"{_ddl(base)}lang_pred string, score double{', margin double' if with_margin else ''}")


def margin_bound(docs: DataFrame, net: Network, rejected: float = 0.001) -> float:
    """Least margin that a text must have, set on all rows the network did not learn from.

    The largest bound of at most 0 (as likely as noise) that rejects no more than
    the share ``rejected`` of the held-out rows of any language: the least of the
    languages' exact percentiles.
    """
    held = docs.where("doc_id is not null and text is not null and lang is not null").where(~learnable()).select("lang", "text")
    judged = identify(held, net, with_margin=True).where(F.col("lang_pred") != UNDETERMINED).select("lang", "margin")
    # pinned, as an exact percentile reads its rows twice
    bounds = exact_percentiles(pinned(judged, "margins"), ["lang"], "margin", {"bound": rejected})
    least = bounds.agg(F.min("bound").alias("m")).first().m
    return 0.0 if least is None else min(0.0, least)


def _ddl(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)
