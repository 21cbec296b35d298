"""Gated recurrent language model in numpy, trained and applied on Spark, over exact corpus counts.

Tokens are words split at white space, A-Z lower-cased, and one end per text. All training tokens are
counted. The most frequent HEAD tokens are held by every worker; the others, whose number grows with
the corpus, meet their counts in a shuffle join, so no count is left out at any size.

The model predicts each token from a gated recurrent state. Its output softmax is factored into
classes: WORDS frequent tokens in classes of PER_CLASS, all others in TAIL classes by their ending, within
which a token has its smoothed share of the class's counts.

Training text is tokenised once into rows of two bytes a token. Rows are dealt by a hash of doc_id and text into ROUNDS
rounds and, within a round, into parts of about PART_BYTES, sorted by that hash: what a part holds and in which order
depends on the corpus alone, not on files or tasks. Every part is learned from by truncated backpropagation
over windows of STEPS tokens, LANES texts side by side, carrying the state from window to window; the parts'
weights are averaged by the tokens they saw. More text makes more parts and so the same number of steps a part.
Scoring carries the state through whole texts. Texts beyond BLOCK_BYTES are tokenised piece by piece, so a text
takes two bytes a token (and some 200 MB of working space), however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunweave.llm import words as W
from sunweave.llm.quality import fold
from sunweave.session import stage

#: Tokens whose counts every worker holds (16 bytes each).
HEAD = 1 << 20
PER_CLASS, WORD_CLASSES, TAIL = 64, 16, 16
WORDS = PER_CLASS * WORD_CLASSES
HIDDEN, STEPS = 16, 32
#: Texts trained side by side, and scored side by side.
LANES, WIDE = 128, 512
ROUNDS, RATE = 4, 0.01
#: Bytes of token ids in one part of a round.
PART_BYTES = 4 << 20
#: Tokens whose outputs are computed together.
CHUNK = 4096
#: Sums of weights that are added in parallel before the driver adds them.
SUMS = 16
#: Tokens scored together: their ids take two bytes each.
GROUP = 8 << 20
SMOOTH = 0.1

#: A token's hash carries its tail class in the lowest bits.
KIND = np.uint64(TAIL - 1)
END = np.uint64(0x5D1EAF00D5EED5E0)
START = WORDS + TAIL


def tokens(block: W.Block, found: W.Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token, text by text with its end, and tokens per text; the lowest bits are the tail class."""
    found = block.words(W.NON_SPACE) if found is None else found
    count = found.count + 1
    at = np.arange(len(found.row)) + found.row
    h = np.full(int(count.sum()), END, dtype=np.uint64)
    if len(at):
        last = block.data[found.end - 1].astype(np.uint64)
        second = block.data[np.maximum(found.end - 2, found.start)].astype(np.uint64)
        h[at] = (found.hashes() & ~KIND) | ((np.uint64(31) * last + second) & KIND)
    return h, count


def pieces(column: pa.Array) -> Iterator[tuple[W.Block, np.ndarray, np.ndarray, bool]]:
    """Blocks of texts with their tokens and counts; a text that goes on in the next block has no end yet (last value true)."""
    for block, found, more in W.parts(column, W.NON_SPACE):
        h, count = tokens(block, found)
        yield (block, h[:-1], count - 1, True) if more else (block, h, count, False)


def tail_class(h: np.ndarray) -> np.ndarray:
    return (h & KIND).astype(np.int16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [h for _, h, _, _ in pieces(batch.column(0))]
        if parts:
            h = np.concatenate(parts)
            h.sort()
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.append(first, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(n)], names=["h", "c"])


@dataclass
class Vocabulary:
    """Head tokens in order of hash with counts and word ids (-1: in a tail class), and totals."""

    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    total: int
    distinct: int
    tail_total: np.ndarray
    tail_distinct: np.ndarray
    complete: bool
    words: np.ndarray = field(init=False)
    word_ids: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        known = self.ids >= 0
        self.words, self.word_ids = self.hashes[known], self.ids[known]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash among the head tokens, or -1: by its leading bits to the few that share them."""
        if not hasattr(self, "starts"):
            self.bits = np.uint64(64 - min(20, max(1, len(self.hashes).bit_length())))
            borders = np.arange(1 << (64 - int(self.bits)), dtype=np.uint64) << self.bits
            self.starts = np.append(np.searchsorted(self.hashes, borders), len(self.hashes)).astype(np.int32)
        top = (h >> self.bits).astype(np.int32)
        at, end = self.starts[top], self.starts[top + 1]
        out = np.full(len(h), -1, dtype=np.int32)
        left = np.flatnonzero(at < end)
        while len(left):
            place = at[left]
            same = self.hashes[place] == h[left]
            out[left[same]] = place[same]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def encode(self, h: np.ndarray) -> np.ndarray:
        """Word id of each token, or WORDS plus its tail class."""
        out = WORDS + tail_class(h)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            out = np.where(self.words[at] == h, self.word_ids[at], out)
        return out.astype(np.int16)


def count_tokens(docs: DataFrame) -> DataFrame:
    """``h, c``: every distinct token of ``docs`` with its count."""
    return docs.select("text").mapInArrow(_count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """Totals of all counts and the most frequent tokens: as many whole frequency bands as fit into ``head``."""
    band = F.floor(F.log2(F.col("c").cast("double")) * 8)
    bands = counts.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.min("c").alias("low")).collect()
    least, room = None, head
    for row in sorted(bands, key=lambda r: -r.band):
        if row.n > room:
            break
        least, room = row.low, room - row.n
    chosen = counts.select("h", "c").where(F.col("c") >= (least if least is not None else 1 << 62)).toArrow()
    h = chosen.column("h").to_numpy().astype(np.int64).view(np.uint64)
    c, kind = chosen.column("c").to_numpy().astype(np.int64), tail_class(h)
    ids = np.full(len(h), -1, dtype=np.int32)
    ranked = np.lexsort((h, -c))[:WORDS]
    ids[ranked] = np.arange(len(ranked))
    tails = {r.kind: (r.c, r.n) for r in counts.groupBy(F.col("h").bitwiseAND(TAIL - 1).alias("kind")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    tail_total = np.array([tails.get(k, (0, 0))[0] for k in range(TAIL)], dtype=np.float64)
    tail_distinct = np.array([tails.get(k, (0, 0))[1] for k in range(TAIL)], dtype=np.float64)
    np.subtract.at(tail_total, kind[ranked], c[ranked])
    np.subtract.at(tail_distinct, kind[ranked], 1)
    order = np.argsort(h)
    total, distinct = sum(r.c for r in bands), sum(r.n for r in bands)
    return Vocabulary(h[order], c[order], ids[order], total, distinct, tail_total, tail_distinct, len(h) == distinct)


def blank(seed: int = 11) -> list[np.ndarray]:
    """Fresh weights: input table, recurrent matrix, class output and its bias, word output and its bias."""
    rng = np.random.default_rng(seed)
    shapes = [(START + 1, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (HIDDEN, WORD_CLASSES + TAIL), (WORD_CLASSES + TAIL,), (WORD_CLASSES, HIDDEN, PER_CLASS), (WORD_CLASSES, PER_CLASS)]
    scale = [0.3, 0.3, 0.1, 0.0, 0.1, 0.0]
    return [(rng.standard_normal(s) * x).astype(np.float32) for s, x in zip(shapes, scale)]


def starting(vocab: Vocabulary, seed: int = 11) -> list[np.ndarray]:
    """Fresh weights whose biases give the corpus frequencies."""
    weights = blank(seed)
    c = np.full(WORDS, SMOOTH)
    known = vocab.ids >= 0
    c[vocab.ids[known]] += vocab.counts[known]
    c = c.reshape(WORD_CLASSES, PER_CLASS)
    mass = np.concatenate([c.sum(1), vocab.tail_total + SMOOTH * (vocab.tail_distinct + 1)])
    weights[3] = np.log(mass / mass.sum()).astype(np.float32)
    weights[5] = np.log(c / c.sum(1, keepdims=True)).astype(np.float32)
    return weights


def _forward(inputs: np.ndarray, state: np.ndarray, table: np.ndarray, turn: np.ndarray, keep: bool):
    """States after each input (steps x lanes); with ``keep``, what backpropagation needs.

    Inside, units lie in rows and lanes in columns, so that gates are contiguous.
    """
    k = HIDDEN
    x = np.ascontiguousarray(table[inputs].transpose(0, 2, 1))
    turned, now = np.ascontiguousarray(turn.T), np.ascontiguousarray(state.T)
    steps, lanes = inputs.shape
    out = np.empty((steps, k, lanes), dtype=now.dtype)
    kept = [np.empty((steps, n, lanes), dtype=now.dtype) for n in (k, 2 * k, k, k)] if keep else None
    for t in range(steps):
        g = turned @ now
        gate = np.add(x[t, : 2 * k], g[: 2 * k], out=kept[1][t] if keep else None)
        # The logistic function by way of tanh.
        gate *= 0.5
        np.tanh(gate, out=gate)
        gate *= 0.5
        gate += 0.5
        z, r = gate[:k], gate[k:]
        n = np.multiply(r, g[2 * k :], out=kept[2][t] if keep else None)
        n += x[t, 2 * k :]
        np.tanh(n, out=n)
        if keep:
            kept[0][t], kept[3][t] = now, g[2 * k :]
        new = out[t]
        np.subtract(now, n, out=new)
        new *= z
        new += n
        now = new
    return out.transpose(0, 2, 1), now.T, kept


def _softmax(x: np.ndarray, chosen: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of the chosen row of each column, and if wanted ``every`` probability; overwrites ``x``."""
    at = np.arange(x.shape[1])
    x -= x.max(0)
    own = x[chosen, at].astype(np.float64)
    np.exp(x, out=x)
    total = x.sum(0)
    if every:
        x /= total
    return own - np.log(total), x


def _outputs(h: np.ndarray, target: np.ndarray, weights: list[np.ndarray], grads: list[np.ndarray] | None = None):
    """Natural log probability of each target given its state; with ``grads``, also the gradient on the states."""
    if len(h) > CHUNK:
        got = [_outputs(h[i : i + CHUNK], target[i : i + CHUNK], weights, grads) for i in range(0, len(h), CHUNK)]
        return np.concatenate([x for x, _ in got]), None if grads is None else np.concatenate([x for _, x in got])
    _, _, class_out, class_bias, word_out, word_bias = weights
    states = np.ascontiguousarray(h.T)
    kind = np.where(target < WORDS, target // PER_CLASS, target - WORDS + WORD_CLASSES)
    logp, d = _softmax(class_out.T @ states + class_bias[:, None], kind, grads is not None)
    back = None
    if grads is not None:
        d[kind, np.arange(len(h))] -= 1
        back = class_out @ d
        grads[2] += states @ d.T
        grads[3] += d.sum(1)
    order = np.argsort(kind, kind="stable")
    ends = np.searchsorted(kind[order], np.arange(WORD_CLASSES + 1))
    for c in range(WORD_CLASSES):
        at = order[ends[c] : ends[c + 1]]
        if len(at):
            own = states[:, at]
            word = target[at] - c * PER_CLASS
            mine, d = _softmax(word_out[c].T @ own + word_bias[c][:, None], word, grads is not None)
            logp[at] += mine
            if grads is not None:
                d[word, np.arange(len(at))] -= 1
                back[:, at] += word_out[c] @ d
                grads[4][c] += own @ d.T
                grads[5][c] += d.sum(1)
    return logp, None if back is None else back.T


def _backward(kept: list, inputs: np.ndarray, back: np.ndarray, weights: list[np.ndarray], grads: list[np.ndarray]) -> None:
    turn, k = weights[1], HIDDEN
    back = np.ascontiguousarray(back.transpose(0, 2, 1))
    carry = np.zeros_like(back[0])
    slopes = np.empty((len(inputs), 3 * k, inputs.shape[1]), dtype=back.dtype)
    du = np.empty_like(slopes)
    # What does not depend on later steps, for the whole window at once.
    state, gate, n, u = kept
    z, r = gate[:, :k], gate[:, k:]
    inner, outer, reset = (1 - z) * (1 - n * n), (state - n) * z * (1 - z), u * r * (1 - r)
    for t in range(len(inputs) - 1, -1, -1):
        d = back[t]
        d += carry
        da, own = slopes[t, 2 * k :], du[t]
        np.multiply(d, inner[t], out=da)
        np.multiply(d, outer[t], out=own[:k])
        np.multiply(da, reset[t], out=own[k : 2 * k])
        np.multiply(da, r[t], out=own[2 * k :])
        carry = turn @ own
        d *= z[t]
        carry += d
    slopes[:, : 2 * k] = du[:, : 2 * k]
    grads[1] += np.tensordot(state, du, axes=([0, 2], [0, 2]))
    ids, flat = inputs.ravel(), slopes.transpose(0, 2, 1).reshape(-1, 3 * k)
    order = np.argsort(ids, kind="stable")
    own = ids[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    grads[0][own[first]] += np.add.reduceat(flat[order], first, axis=0)


class _Trainer:
    """Adam steps of one task."""

    def __init__(self, weights: list[np.ndarray], rate: float) -> None:
        self.weights = [w.copy() for w in weights]
        self.first = [np.zeros_like(w) for w in weights]
        self.second = [np.zeros_like(w) for w in weights]
        self.rate, self.turn, self.seen = rate, 0, 0

    def learn(self, texts: list[np.ndarray]) -> None:
        """One pass over some texts side by side, longest first, window by window."""
        length = np.array([len(t) for t in texts])
        flat, begin = np.concatenate(texts), np.cumsum(length) - length
        state = np.zeros((len(texts), HIDDEN), dtype=np.float32)
        last = np.full(len(texts), START, dtype=np.int16)
        for at in range(0, int(length[0]), STEPS):
            target, real = _window(flat, begin, length, at)
            live = target.shape[1]
            inputs = np.concatenate([last[None, :live], target[:-1]])
            h, state, kept = _forward(inputs, state[:live], self.weights[0], self.weights[1], True)
            grads = [np.zeros_like(w) for w in self.weights]
            _, d = _outputs(h[real], target[real], self.weights, grads)
            back = np.zeros(h.shape, dtype=h.dtype)
            back[real] = d
            _backward(kept, inputs, back, self.weights, grads)
            self._step(grads, int(real.sum()))
            last = target[-1]

    def _step(self, grads: list[np.ndarray], n: int) -> None:
        self.turn += 1
        self.seen += n
        fix = np.sqrt(1 - 0.999**self.turn) / (1 - 0.9**self.turn)
        for w, g, m, v in zip(self.weights, grads, self.first, self.second):
            g *= 1 / n
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= self.rate * fix * m / (np.sqrt(v) + 1e-8)


def _window(flat: np.ndarray, begin: np.ndarray, length: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens ``at`` to ``at`` + STEPS of the texts that are that long (lengths descend), and which of them are real."""
    live = int(np.searchsorted(-length, -at, side="left"))
    place = at + np.arange(min(STEPS, int(length[0]) - at))[:, None]
    real = place < length[None, :live]
    return flat[begin[None, :live] + np.minimum(place, length[None, :live] - 1)], real


def _encoded(shared, rounds: int):
    """Token ids of whole texts, two bytes each, with the round and the key that deal them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab: Vocabulary = shared.value
        for batch in batches:
            keys, held = batch.column(0).to_numpy(), []
            for block, h, count, more in pieces(batch.column(1)):
                ids = vocab.encode(h)
                if more or held:
                    held.append(ids)
                    if more:
                        continue
                    rows, held = [np.concatenate(held)], []
                else:
                    rows = np.split(ids, np.cumsum(count)[:-1])
                own = keys[block.first : block.first + block.n]
                data = pa.array([x.tobytes() for x in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array((own % rounds).astype(np.int32)), pa.array(own), data], names=["turn", "key", "ids"])

    return run


def _train(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, first = _Trainer(shared.value, rate), None
        for batch in batches:
            first = int(batch.column(0)[0].as_py()) if first is None and batch.num_rows else first
            texts = sorted((np.frombuffer(x, np.int16) for x in batch.column(1).to_pylist()), key=lambda t: -len(t))
            groups = [texts[i : i + LANES] for i in range(0, len(texts), LANES)]
            for i in np.random.default_rng(len(texts)).permutation(len(groups)):
                trainer.learn(groups[i])
        if trainer.seen:
            flat = np.concatenate([w.ravel() for w in trainer.weights]).astype(np.float64) * trainer.seen
            yield _sum_row(first, np.append(flat, trainer.seen))

    return run


def _sum_row(key: int, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([key % SUMS], pa.int32()), pa.array([flat.tobytes()], pa.binary())], names=["key", "slot", "flat"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum for each slot; rows come sorted, so the order of addition is that of the keys."""
    slot, key, total = None, 0, None
    for batch in batches:
        for k, s, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
            part = np.frombuffer(raw)
            if s != slot:
                if slot is not None:
                    yield _sum_row(key, total)
                slot, key, total = s, k, part
            else:
                total = total + part
    if slot is not None:
        yield _sum_row(key, total)


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, part_bytes: int = PART_BYTES) -> list[np.ndarray]:
    """Weights after ``rounds`` averaged rounds, each over its own part of ``docs``: every text is learned from once."""
    weights = starting(vocab)
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(vocab_for_training(vocab))
    key = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1))
    ids = stage(docs.select(key.alias("key"), "text").mapInArrow(_encoded(known, rounds), "turn int, key bigint, ids binary"), "training-ids")
    sizes = {r.turn: r.size for r in ids.groupBy("turn").agg(F.sum(F.octet_length("ids")).alias("size")).collect()}
    for turn in range(rounds):
        if turn not in sizes:
            continue
        shared = sc.broadcast(weights)
        dealt = ids.where(F.col("turn") == turn).select("key", "ids").repartition(max(1, -(-sizes[turn] // part_bytes)), "key").sortWithinPartitions("key", "ids")
        made = dealt.mapInArrow(_train(shared, RATE * (1 - 0.6 * turn / rounds)), "key bigint, slot int, flat binary")
        rows = made.repartition(SUMS, "slot").sortWithinPartitions("slot", "key").mapInArrow(_sums, "key bigint, slot int, flat binary").collect()
        shared.unpersist()
        flat = sum((np.frombuffer(r.flat) for r in sorted(rows, key=lambda r: r.slot)), np.zeros(sum(w.size for w in weights) + 1))
        flat, at, new = (flat[:-1] / flat[-1]).astype(np.float32), 0, []
        for w in weights:
            new.append(flat[at : at + w.size].reshape(w.shape))
            at += w.size
        weights = new
    return weights


def vocab_for_training(vocab: Vocabulary) -> Vocabulary:
    """The vocabulary without the head tokens that are no words of the model."""
    known = vocab.ids >= 0
    return Vocabulary(vocab.hashes[known], vocab.counts[known], vocab.ids[known], vocab.total, vocab.distinct, vocab.tail_total, vocab.tail_distinct, False)


def _model_scores(texts: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each text's ids; tail tokens by their class only. Equal texts are scored once."""
    places: dict[bytes, int] = {}
    same = np.array([places.setdefault(t.tobytes(), len(places)) for t in texts], dtype=np.int64)
    distinct = [np.frombuffer(t, np.int16) for t in places]
    order = sorted(range(len(distinct)), key=lambda i: -len(distinct[i]))
    out = np.zeros(len(distinct))
    for a in range(0, len(order), WIDE):
        lanes = order[a : a + WIDE]
        length = np.array([len(distinct[i]) for i in lanes])
        flat, begin = np.concatenate([distinct[i] for i in lanes]), np.cumsum(length) - length
        state = np.zeros((len(lanes), HIDDEN), dtype=np.float32)
        last = np.full(len(lanes), START, dtype=np.int16)
        total = np.zeros(len(lanes))
        for at in range(0, int(length[0]), STEPS):
            target, real = _window(flat, begin, length, at)
            live = target.shape[1]
            inputs = np.concatenate([last[None, :live], target[:-1]])
            h, state, _ = _forward(inputs, state[:live], weights[0], weights[1], False)
            logp = np.zeros(real.shape)
            logp[real] = _outputs(h[real], target[real], weights)[0]
            total[:live] += logp.sum(0)
            last = target[-1]
        out[lanes] = total
    return out[same]


_SCORED = "text_hash bigint, n_tokens bigint, n_known bigint, base double, model double, rare array<bigint>, times array<int>"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, weights = shared.value
        base_norm = np.log10(vocab.total + SMOOTH * (vocab.distinct + 1))
        tail_norm = np.log10(vocab.tail_total + SMOOTH * (vocab.tail_distinct + 1))

        def flush(rows: list, texts: list[np.ndarray]) -> pa.RecordBatch:
            got = _model_scores(texts, weights) / np.log(10)
            ids, hashes, n, known, base, tail, rare, times, many = (list(x) for x in zip(*rows))
            cat = np.concatenate
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(ids), pa.array(cat(hashes)), pa.array(cat(n)), pa.array(cat(known)), pa.array(cat(base)),
                    pa.array(cat(tail) + got), W.lists(cat(rare), cat(many), pa.int64()), W.lists(cat(times), cat(many), pa.int32()),
                ],
                names=["doc_id", "text_hash", "n_tokens", "n_known", "base", "model", "rare", "times"],
            )

        rows, texts, held = [], [], 0
        open_: list[tuple] = []
        for batch in batches:
            for block, h, count, more in pieces(batch.column(2)):
                c = np.zeros(len(h), dtype=np.int64)
                ids = WORDS + tail_class(h)
                inside = np.zeros(len(h), dtype=bool)
                if len(vocab.hashes):
                    at = vocab.find(h)
                    inside = at >= 0
                    c[inside] = vocab.counts[at[inside]]
                    own = np.where(inside, vocab.ids[at], -1)
                    ids = np.where(own >= 0, own, ids)
                ids = ids.astype(np.int16)
                looked = inside | vocab.complete
                value = np.where(looked, np.log10(c + SMOOTH), 0.0)
                tail = np.where(ids >= WORDS, value - tail_norm[np.maximum(ids - WORDS, 0)], 0.0)
                made = (ids, count, W.sums((c > 0).astype(np.int64), count), W.sums(value - base_norm, count), W.sums(tail, count), h[~looked])
                if more or open_:
                    # A long text: its pieces are added up when the last one is there.
                    open_.append(made)
                    if more:
                        continue
                    ids, count, known, base, tail, left = (np.concatenate(x) if i in (0, 5) else sum(x) for i, x in enumerate(zip(*open_)))
                    rare, times = np.unique(left, return_counts=True)
                    rare, times, many, open_ = rare.view(np.int64), times.astype(np.int32), np.array([len(rare)]), []
                else:
                    _, count, known, base, tail, _ = made
                    rare, times, many = _rare(h, count, looked)
                rows.append((
                    batch.column(0).slice(block.first, block.n), batch.column(1).slice(block.first, block.n).to_numpy(), count, known, base, tail, rare, times, many,
                ))
                texts += np.split(ids, np.cumsum(count)[:-1])
                held += len(ids)
                if held >= GROUP:
                    yield flush(rows, texts)
                    rows, texts, held = [], [], 0
        if rows:
            yield flush(rows, texts)

    return run


def _rare(h: np.ndarray, count: np.ndarray, looked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of each text that are still to be looked up, how often they occur, and how many there are."""
    left = np.flatnonzero(~looked)
    if not len(left):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(len(count), np.int64)
    row = np.repeat(np.arange(len(count)), count)[left]
    order = np.lexsort((h[left], row))
    row, own = row[order], h[left][order]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1])]))
    times = np.diff(np.append(first, len(own)))
    return own[first].view(np.int64), times.astype(np.int32), np.bincount(row[first], minlength=len(count))


def language_model_scores(docs: DataFrame, head: int = HEAD, rounds: int = ROUNDS, held: int = 0, parts: int = 10) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Rows whose fold ``crc32(doc_id) mod parts`` is not ``held`` are learned from. ``base_score`` is the sum
    over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))): c the token's count, N all, V distinct training
    tokens; ``n_known`` counts tokens with c > 0. ``score`` is the model's log10 probability of the text.

    A null text counts as empty: one end token. Rows with a null doc_id are not held out and not learned
    from. Rows repeating a doc_id, or a whole row, are scored one by one. With nothing to learn from, c,
    N and V are 0, and so is base_score. Other columns are ignored, whatever their
    names. No rows give no rows.
    """
    training = docs.where(fold(F.col("doc_id"), parts) != held)
    counts = stage(count_tokens(training), "token-counts")
    vocab = vocabulary(counts, head)
    weights = train(training, vocab, rounds)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, weights))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_score(shared), f"doc_id {kind}, {_SCORED}")
    scored = stage(scored, "scored")
    if not vocab.complete:
        rare = scored.where(F.size("rare") > 0).select("doc_id", "text_hash", F.explode(F.arrays_zip("rare", "times")).alias("t"))
        rare = rare.select("doc_id", "text_hash", F.col("t.rare").alias("h"), F.col("t.times").alias("n"))
        met = rare.join(counts.select("h", "c"), "h", "left").groupBy("h", "doc_id", "text_hash").agg(F.max("n").alias("n"), F.max(F.coalesce("c", F.lit(0))).alias("c"))
        more = met.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(
            F.sum(F.col("n") * F.log10(F.col("c") + SMOOTH)).alias("extra"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known")
        )
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
        scored = scored.drop("rare", "times").join(more, same, "left")
        extra, known = F.coalesce("extra", F.lit(0.0)), F.coalesce("known", F.lit(0))
        scored = scored.withColumns({"n_known": F.col("n_known") + known, "base": F.col("base") + extra, "model": F.col("model") + extra})
    # Single precision depends on the texts scored beside a text in its last digits: equal texts take one of their scores.
    again = scored.groupBy(F.col("text_hash").alias("_text"), F.col("n_tokens").alias("_n")).agg(F.min("model").alias("_one"), F.count("*").alias("_rows")).where("_rows > 1")
    scored = scored.join(again, (F.col("text_hash") == F.col("_text")) & (F.col("n_tokens") == F.col("_n")), "left")
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(vocab.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.coalesce("_one", "model").alias("score"),
    )
