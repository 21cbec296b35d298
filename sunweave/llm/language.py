"""Language of texts, code-switched ones too, by a linear-chain conditional random field over words.

Every word is an observation described by its affixes, its inner n-grams, itself and its place in a
lexicon of words typical of one language; states are languages, transitions are learned. Forward-
backward gives each word's language marginals, whose mean over a whole text names its language.

``identify`` fits the field in numpy on a bounded sample of labelled documents (DOCS_PER_LANGUAGE whole texts
of each language, drawn by hash); ``identified`` fits it on all of them, part by part. Pieces of different languages are strung together, so that the
transitions learn when to switch. Prediction runs over all texts in one pass without a shuffle; long
texts are cut into segments whose transition products are combined, so a text of any length takes
about as many numpy steps as a segment has words plus a text has segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sunweave.llm import words as W
from sunweave.llm.columns import add_from_text, checked_broadcast, columns, fresh, named
from sunweave.llm.lm import SUMS, _sum_row, _sums
from sunweave.llm.quality import fold
from sunweave.session import stage

#: Most labelled documents of one language that the field is fitted on.
DOCS_PER_LANGUAGE = 150
TABLE = 1 << 16
SEGMENT = 48
STEPS, RATE, DECAY = 25, 0.15, 1e-4
#: A lexicon word occurs so often in the sample, so large a part of it in one language.
LEXICON_COUNT, LEXICON_SHARE = 3, 0.8
#: And if the field is fitted on all texts, at least this part of all their words.
LEXICON_PART = 1e-6
#: Bytes of text that one task fits, and words of one of its steps.
PART_BYTES, BATCH_WORDS = 4 << 20, 4000
#: Distinct words whose features are worked out at once.
SPELLED_WORDS = 1 << 13
UNKNOWN = "und"
#: A text passes ``identified`` with this share of the evidence per word that all but one in a hundred learned texts reach.
SHARE_OF_LEARNED, LEARNED_QUANTILE = 0.4, 0.01
#: Words a text needs before its evidence can speak against it.
JUDGED_WORDS = 10

LETTERS = W.byte_class((97, 122), (128, 255))
_KIND = np.random.default_rng(9).integers(1, 1 << 63, 16, dtype=np.uint64)


@dataclass
class Field:
    """Learned weights: of hashed features, of lexicon membership, of transitions, by language."""

    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    meaning: np.ndarray
    lexical: np.ndarray
    moves: np.ndarray


def word_features(block: W.Block, found: W.Words, chosen: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of the features of the chosen words, word by word, and how many each has.

    Prefixes and suffixes of 1 to 4 bytes, inner grams of 2 and 3 bytes, and the word itself.
    """
    start, end = found.start[chosen], found.end[chosen]
    length = end - start
    parts, owners = [], []
    for n in range(1, 5):
        ok = np.flatnonzero(length >= n)
        parts += [W.mix(block.hash_ranges(start[ok], start[ok] + n, prefix) ^ _KIND[n]), W.mix(block.hash_ranges(end[ok] - n, end[ok], prefix) ^ _KIND[4 + n])]
        owners += [ok, ok]
    for n in (2, 3):
        many = np.maximum(length - n + 1, 0)
        own = np.repeat(np.arange(len(length)), many)
        at = start[own] + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        parts.append(W.mix(block.hash_ranges(at, at + n, prefix) ^ _KIND[8 + n]))
        owners.append(own)
    parts.append(W.mix(block.hash_ranges(start, end, prefix) ^ _KIND[12]))
    owners.append(np.arange(len(length)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    slots = (np.concatenate(parts)[order] % np.uint64(TABLE)).astype(np.int64)
    return slots, np.bincount(owner, minlength=len(length))


def emissions(block: W.Block, found: W.Words, field: Field) -> np.ndarray:
    """Score of every language for every word; repeated words are worked out once."""
    prefix = block.prefix()
    h = block.hash_ranges(found.start, found.end, prefix)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    slots, many = word_features(block, found, first, prefix)
    score = np.add.reduceat(field.weights[slots], np.cumsum(many) - many, axis=0)
    score += _lexical(field, h[first])
    return score[back]


def _lexical(field: Field, h: np.ndarray) -> np.ndarray:
    out = np.zeros((len(h), len(field.languages)), dtype=np.float32)
    if len(field.lexicon):
        at = np.minimum(np.searchsorted(field.lexicon, h), len(field.lexicon) - 1)
        hit = np.flatnonzero(field.lexicon[at] == h)
        out[hit] = field.lexical[field.meaning[at[hit]]]
    return out


def marginals(score: np.ndarray, count: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """State marginals of each word by forward-backward, and expected moves if ``pairs``.

    ``count`` has the words of each sequence. Sequences are cut into segments; products of transition
    matrices over segments are chained per sequence, then each segment is swept from both ends.
    """
    total, k = score.shape
    psi = np.exp(score - score.max(1, keepdims=True)).astype(np.float64)
    step = np.exp(moves - moves.max()).astype(np.float64)
    pieces = -(-count // SEGMENT)
    seq = np.repeat(np.arange(len(count)), pieces)
    number = np.arange(len(seq)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (np.cumsum(count) - count)[seq] + number * SEGMENT
    length = np.minimum(SEGMENT, np.cumsum(count)[seq] - begin)
    order = np.argsort(-length, kind="stable")
    begin_o, length_o, head = begin[order], length[order], number[order] == 0
    active = [int(np.searchsorted(-length_o, -j, side="left")) for j in range(SEGMENT + 1)]
    n = len(seq)
    product = np.tile(np.eye(k), (n, 1, 1))
    for j in range(SEGMENT):
        a = active[j]
        if not a:
            break
        moved = (product[:a].reshape(-1, k) @ step).reshape(a, k, k)
        if j == 0:
            moved[head[:a]] = 1.0 / k
        moved *= psi[begin_o[:a] + j][:, None, :]
        product[:a] = moved / moved.max((1, 2), keepdims=True)
    back_order = np.empty(n, dtype=np.int64)
    back_order[order] = np.arange(n)
    product = product[back_order]
    before, after = np.full((n, k), 1.0 / k), np.ones((n, k))
    offsets = np.cumsum(pieces) - pieces
    rows = np.argsort(-pieces, kind="stable")
    sizes = -pieces[rows]
    for s in range(1, int(pieces.max(initial=0))):
        live = rows[: np.searchsorted(sizes, -s, side="left")]
        at = offsets[live] + s
        v = np.einsum("nk,nkl->nl", before[at - 1], product[at - 1])
        before[at] = v / v.sum(1, keepdims=True)
    for s in range(int(pieces.max(initial=0)) - 1, 0, -1):
        live = rows[: np.searchsorted(sizes, -s, side="left")]
        at = offsets[live] + s
        v = np.einsum("nkl,nl->nk", product[at], after[at])
        after[at - 1] = v / v.sum(1, keepdims=True)
    alpha, beta = np.empty((total, k)), np.empty((total, k))
    state = before[order]
    for j in range(SEGMENT):
        a = active[j]
        if not a:
            break
        moved = state[:a] @ step
        if j == 0:
            moved[head[:a]] = 1.0
        moved *= psi[begin_o[:a] + j]
        state[:a] = moved / moved.sum(1, keepdims=True)
        alpha[begin_o[:a] + j] = state[:a]
    state = after[order]
    for j in range(SEGMENT - 1, -1, -1):
        a = active[j]
        if a:
            at = begin_o[:a] + j
            beta[at] = state[:a]
            moved = (psi[at] * state[:a]) @ step.T
            state[:a] = moved / moved.sum(1, keepdims=True)
    both = alpha * beta
    both /= both.sum(1, keepdims=True)
    expected = np.zeros((k, k))
    if pairs and total > 1:
        second = np.ones(total, bool)
        second[(np.cumsum(count) - count)[count > 0]] = False
        at = np.flatnonzero(second)
        since, until = alpha[at - 1], psi[at] * beta[at]
        expected = step * ((since / ((since @ step) * until).sum(1, keepdims=True)).T @ until)
    return both, expected


def _ranges(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places begin to begin + many of each range, one range after the other."""
    return np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def _spelled(texts: list[str], limit: int = W.BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, their table slots and how many each has; each word's place among them, words per text.

    Texts are read a bounded block at a time, so that only what is returned grows with them.
    """
    count, names = np.zeros(len(texts), np.int64), np.zeros(0, np.uint64)
    hashes, found_names, found_slots, found_many = [np.zeros(0, np.uint64)], [names], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for block, found, _ in W.parts(pa.array(texts, pa.large_string()), LETTERS, limit=limit):
        prefix = block.prefix()
        h = block.hash_ranges(found.start, found.end, prefix)
        count[block.first : block.first + block.n] += found.count
        hashes.append(h)
        here, first = np.unique(h, return_index=True)
        new = np.isin(here, names, invert=True)
        for at in range(0, int(new.sum()), SPELLED_WORDS):
            slots, many = word_features(block, found, first[new][at : at + SPELLED_WORDS], prefix)
            found_slots.append(slots.astype(np.int32))
            found_many.append(many)
        found_names.append(here[new])
        names = np.union1d(names, here[new])
    order, many = np.argsort(np.concatenate(found_names)), np.concatenate(found_many)
    slots = np.concatenate(found_slots)[_ranges((np.cumsum(many) - many)[order], many[order])]
    return names, slots, many[order], np.searchsorted(names, np.concatenate(hashes)).astype(np.int32), count


def fit(texts: list[tuple[str, str]], steps: int = STEPS, seed: int = 3, given: Field | None = None, batch: int | None = None) -> Field | None:
    """Field of greatest regularised likelihood over code-switched strings of pieces of the texts.

    ``given`` names the languages and the lexicon, if they are known already. With ``batch``, a step sees that many
    words and the next step the next ones, as far as ``steps`` go round; each word is seen at least once. A step works
    on the distinct words that it sees only.
    """
    languages = given.languages if given else sorted({lang for _, lang in texts})
    if not languages:
        return None
    k, place = len(languages), {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    names, slots, many, back, per_text = _spelled([t for t, _ in texts])
    begin = np.cumsum(many) - many
    label = np.repeat(np.array([place[lang] for _, lang in texts], dtype=np.int32), per_text)
    if given:
        lexicon, meaning = given.lexicon, given.meaning
    else:
        seen = np.bincount(back.astype(np.int64) * k + label, minlength=len(names) * k).reshape(-1, k)
        typical = (seen.sum(1) >= LEXICON_COUNT) & (seen.max(1, initial=0) >= LEXICON_SHARE * seen.sum(1))
        lexicon, meaning = names[typical], seen[typical].argmax(1)
    field = Field(languages, np.zeros((TABLE, k), np.float32), lexicon, meaning, np.zeros((k, k), np.float32), np.zeros((k, k)))
    lexical = np.full(len(names), -1)
    if len(lexicon):
        place_of = np.minimum(np.searchsorted(lexicon, names), len(lexicon) - 1)
        lexical = np.where(lexicon[place_of] == names, meaning[place_of], -1)
    order, counts = _strung(per_text, rng)
    turns = 1 if batch is None else max(1, min(steps, len(order) // batch, len(counts)))
    borders = np.append(0, np.cumsum(counts))

    @lru_cache(maxsize=1)
    def turn(i: int) -> tuple[np.ndarray, ...]:
        a, b = len(counts) * i // turns, len(counts) * (i + 1) // turns
        at = order[borders[a] : borders[b]]
        chosen, words = np.unique(back[at], return_inverse=True)
        truth = label[at]
        return truth, words, counts[a:b], _moves_seen(truth, counts[a:b], k), chosen, slots[_ranges(begin[chosen], many[chosen])]

    parameters = [field.weights, field.lexical, field.moves]
    memory = [(np.zeros(p.shape), np.zeros(p.shape)) for p in parameters]
    for step in range(1, steps + 1 if len(order) else 1):
        truth, words, count, gold, chosen, own = turn(step % turns)
        n, has = max(len(truth), 1), many[chosen]
        per_word = np.add.reduceat(field.weights[own], np.cumsum(has) - has, axis=0) + _lexical(field, names[chosen])
        got, expected = marginals(per_word[words], count, field.moves, pairs=True)
        miss = -got
        miss[np.arange(len(truth)), truth] += 1
        by_word = np.stack([np.bincount(words, miss[:, c], minlength=len(chosen)) for c in range(k)], axis=1)
        by_slot = np.stack([np.bincount(own, np.repeat(by_word[:, c], has), minlength=TABLE) for c in range(k)], axis=1)
        by_list, listed = np.zeros((k, k)), lexical[chosen]
        np.add.at(by_list, listed[listed >= 0], by_word[listed >= 0])
        for p, g, (m, v) in zip(parameters, (by_slot, by_list, gold - expected), memory):
            g = g / n - DECAY * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return field


def _moves_seen(truth: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """How often each language follows each within strings."""
    gold = np.zeros((k, k))
    if len(truth) > 1:
        inner = np.ones(len(truth), bool)
        inner[(np.cumsum(count) - count)[count > 0]] = False
        at = np.flatnonzero(inner)
        np.add.at(gold, (truth[at - 1], truth[at]), 1)
    return gold


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in W.blocks(batch.column(0)):
            found = block.words(LETTERS)
            lang = batch.column(1).slice(block.first, block.n).dictionary_encode()
            own = lang.indices.to_numpy(zero_copy_only=False)[found.row]
            h = found.hashes()
            order = np.lexsort((h, own))
            own, h = own[order], h[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])])) if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[first].view(np.int64)), lang.dictionary.take(pa.array(own[first])), pa.array(np.diff(np.append(first, len(h))))], names=["h", "lang", "c"]
            )


def lexicon(learned: DataFrame) -> Field | None:
    """Languages of all rows of ``learned`` (text, lang), and the words that they tell apart, counted over all texts.

    A lexicon word also makes up LEXICON_PART of all words at least, so its number stays bounded on a corpus of any size.
    """
    languages = sorted(r.lang for r in learned.select("lang").distinct().collect())
    if not languages:
        return None
    counts = learned.select("text", "lang").mapInArrow(_word_counts, "h bigint, lang string, c bigint").groupBy("h", "lang").agg(F.sum("c").alias("c"))
    counts = stage(counts, "language-words")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words = counts.groupBy("h").agg(F.sum("c").alias("n"), F.max(F.struct("c", "lang")).alias("most"))
    words = words.where((F.col("n") >= max(LEXICON_COUNT, LEXICON_PART * total)) & (F.col("most.c") >= LEXICON_SHARE * F.col("n")))
    got = words.select("h", F.col("most.lang").alias("lang")).toArrow()
    h = got.column("h").to_numpy().astype(np.int64).view(np.uint64)
    place = {lang: i for i, lang in enumerate(languages)}
    meaning = np.array([place[x] for x in got.column("lang").to_pylist()], dtype=np.int64)
    order, k = np.argsort(h), len(languages)
    return Field(languages, np.zeros((0, k), np.float32), h[order], meaning[order], np.zeros((k, k), np.float32), np.zeros((k, k)))


def _fit_part(shared, part_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fitted() -> pa.RecordBatch:
            made = fit(texts, given=shared.value, batch=BATCH_WORDS)
            flat = np.concatenate([x.ravel().astype(np.float64) for x in (made.weights, made.lexical, made.moves)])
            return _sum_row(first, np.append(flat * size, size))

        texts, first, size = [], 0, 0
        for batch in batches:
            for key, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3))):
                first = first if texts else key
                texts.append((text, lang))
                size += len(text)
                # Rows that repeat have one hash; a task that gets many of them fits them part by part.
                if size >= 2 * part_bytes:
                    yield fitted()
                    texts, size = [], 0
        if size:
            yield fitted()

    return run


def fit_all(docs: DataFrame, part_bytes: int = PART_BYTES) -> Field | None:
    """The field of all rows of ``docs`` with text and lang, every text learned from.

    Texts are dealt by their hash into parts of about ``part_bytes``; each part is fitted by a task of its own, and the
    parts' weights are averaged by their length. What a part holds depends on the rows alone.
    """
    learned = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    given = lexicon(learned)
    if given is None:
        return None
    size = learned.agg(F.sum(F.octet_length("text").cast("long"))).first()[0]
    key = F.xxhash64("doc_id", "text", "lang").bitwiseAND(F.lit((1 << 62) - 1)).alias("key")
    dealt = learned.select(key, "text", "lang").repartition(max(1, -(-size // part_bytes)), "key").sortWithinPartitions("key", "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(given)
    made = dealt.mapInArrow(_fit_part(shared, part_bytes), "key bigint, slot int, flat binary")
    rows = made.repartition(SUMS, "slot").sortWithinPartitions("slot", "key").mapInArrow(_sums, "key bigint, slot int, flat binary").collect()
    k = len(given.languages)
    flat = sum((np.frombuffer(r.flat) for r in sorted(rows, key=lambda r: r.slot)), np.zeros(TABLE * k + 2 * k * k + 1))
    flat = flat[:-1] / max(flat[-1], 1)
    given.weights = flat[: TABLE * k].reshape(TABLE, k).astype(np.float32)
    given.lexical, given.moves = flat[TABLE * k : TABLE * k + k * k].reshape(k, k).astype(np.float32), flat[TABLE * k + k * k :].reshape(k, k)
    return given


def _strung(count: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Word order that strings pieces of 5 to 60 words from random texts together, and words per string."""
    cuts, at = [], 0
    for n in count.tolist():
        done = 0
        while done < n:
            take = min(int(rng.integers(5, 61)), n - done)
            cuts.append((at + done, take))
            done += take
        at += n
    rng.shuffle(cuts)
    order = [np.arange(a, a + n) for a, n in cuts]
    strings = [sum(n for _, n in cuts[i : i + 8]) for i in range(0, len(cuts), 8)]
    return np.concatenate(order) if order else np.zeros(0, np.int64), np.array(strings, dtype=np.int64)


def _score(field: Field, block: W.Block, known: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and evidence of each text of a block; ``known`` says which have a letter.

    Evidence is how far, on average over the words, the features of a word speak for its best language rather
    than for the next. It is small for words of no learned language, whatever the marginals make of them.
    """
    found = block.words(LETTERS)
    if not len(found.row):
        return [UNKNOWN] * block.n, np.zeros(block.n), np.zeros(block.n)
    given = emissions(block, found, field)
    got, _ = marginals(given, found.count, field.moves)
    words = np.maximum(found.count, 1)
    mean = np.stack([W.sums(got[:, c].copy(), found.count) for c in range(got.shape[1])], axis=1) / words[:, None]
    best = mean.argmax(1)
    some = known & (found.count > 0)
    lang = [field.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), some.tolist())]
    margin = given.max(1) - np.partition(given, -2, axis=1)[:, -2] if given.shape[1] > 1 else np.abs(given[:, 0])
    return lang, np.where(some, np.clip(mean[np.arange(block.n), best], 0, 1), 0.0), W.sums(margin.astype(np.float64), found.count) / words


def _predict(shared):
    def run(block: W.Block, letters: pa.Array) -> list[pa.Array]:
        if shared.value is None:
            return [pa.array([UNKNOWN] * block.n, pa.string()), pa.array(np.zeros(block.n)), pa.array(np.zeros(block.n))]
        lang, score, evidence = _score(shared.value, block, letters.to_numpy(zero_copy_only=False).astype(bool))
        return [pa.array(lang, pa.string()), pa.array(score), pa.array(evidence)]

    return run


def sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, held: int = 2, parts: int = 4) -> list[tuple[str, str]]:
    """At most ``per_language`` whole labelled texts of each language, drawn by hash outside the held-out fold."""
    given = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null").where(fold(F.col("doc_id"), parts) != held)
    counts = given.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 40)) / float(1 << 40)
    drawn = given.join(checked_broadcast(counts), "lang").where(draw * F.col("n") < 1.5 * per_language)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "lang"), "doc_id", "text"))
    return [(r.text, r.lang) for r in drawn.withColumn("rank", rank).where(F.col("rank") <= per_language).select("text", "lang").collect()]


def identify(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, held: int = 2, parts: int = 4, keep: list[str] | None = None) -> tuple[DataFrame, str, str]:
    """Rows of ``docs`` (columns ``keep``) with the language and its score, and the names of both columns.

    The field learns from text and lang of rows with both whose fold ``crc32(doc_id) mod parts`` is not
    ``held``. The score is the language's mean marginal over all words of the whole text.

    A text that is null or has no letter gets ``und`` and score 0; so do all if no row can be learned
    from. Rows with a null doc_id are in no fold and not learned from. Repeated rows are judged alike.
    Equal means go to the language that sorts first. Names that clash are avoided. No rows give no rows.
    """
    keep = docs.columns if keep is None else keep
    found, lang, score, evidence = predicted(docs, fit(sample(docs, per_language, held, parts)), keep)
    return found.drop(evidence), lang, score


def predicted(docs: DataFrame, field: Field | None, keep: list[str] | None = None) -> tuple[DataFrame, str, str, str]:
    """As ``identify``, by a field that is fitted already, with the evidence per word; without a field every text is ``und``."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(field)
    lang, score, evidence, letters = (fresh(docs, c) for c in ("lang_pred", "lang_score", "lang_evidence", "has_letter"))
    source = docs.withColumn(letters, F.coalesce(named("text").rlike(r"\p{L}"), F.lit(False)))
    added = [(lang, "string"), (score, "double"), (evidence, "double")]
    return add_from_text(source, _predict(shared), added, keep=keep, also=[letters]), lang, score, evidence


def identified(docs: DataFrame, least: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be named: with at least ``least`` evidence per word.

    The field learns from every row with text and lang (``fit_all``). By default the bound follows from the evidence of
    all of them: SHARE_OF_LEARNED of what all but LEARNED_QUANTILE reach. The words of a text in no learned
    language speak for none of them and fall far below it, while those of a text that switches between learned ones do
    not. Texts of fewer than ``JUDGED_WORDS`` words say too little and stay if they have a letter. Texts
    without letters go. If there is nothing to learn from, no language can be told and every text with a letter stays. Null texts
    go; no rows give no rows; rows that repeat are judged alike.
    """
    field = fit_all(docs)
    if field is None:
        return docs.where(F.coalesce(named("text").rlike(r"\p{L}"), F.lit(False)))
    found, lang, _, evidence = predicted(docs, field)
    bound = least
    if bound is None:
        found = stage(found, "languages")
        labelled = found.where(named("text").isNotNull() & named("lang").isNotNull())
        low = labelled.agg(F.percentile_approx(named(evidence), LEARNED_QUANTILE, 10000)).first()[0]
        bound = SHARE_OF_LEARNED * (low or 0.0)
    short = F.size(F.split(F.trim(named("text")), r"[\x20\x09-\x0D]+")) < JUDGED_WORDS
    return found.where((named(lang) != UNKNOWN) & (short | (named(evidence) >= bound))).select(*columns(docs))
