"""Language identification by unigrams over a fixed vocabulary, summed over all segmentations.

A language is a probability for each piece of a public vocabulary.  The probability of a text is
the sum over all ways to cut it into pieces, computed by a forward algorithm.  Pieces carry the
mark of a word's begin and never run over white space, so the sum is a product over words; all
different words of a batch are computed side by side.

Training is one pass over all labelled texts: the expected count of every piece under the
posterior over segmentations of a language-neutral start model, summed per language.  Only the
table of languages times pieces leaves the tasks; its size is bound by the vocabulary.

The posterior compares the learned languages with each other only, so letter junk gets a high score as well.
``understood`` tells it apart: a text goes with its language while its log-likelihood per character is at most
``TIMES`` as bad as that of the language's middle labelled text.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every text
if nothing was labelled; equal scores go to the alphabetically first language; texts are read whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from auditmill.llm.common import mix, python_ready

UNDETERMINED = "und"
MARK = "▁"
LONGEST = 16  # characters of a piece, mark included; longer pieces of the vocabulary are not used
SMOOTHING = 0.5  # added to each expected count
START = 1e-3  # what each piece costs in the start model
KNOWN = 800_000  # numbers kept of words that were met before, one per language
TOGETHER = 50_000  # characters of words that are computed side by side
TIMES = 2.0  # how much worse per character than the middle labelled text a text may be
MARGIN = 10.0  # what is allowed beyond, in nats over the whole text: a few characters prove little
PART = 64  # characters after which a very long word is cut
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


class Lattice:
    """All pieces inside a list of words, found by substring hashes for all words side by side.

    Words are held by descending length, so the words that reach a position come first.
    """

    def __init__(self, words: list[str], lexicon: "Lexicon"):
        size = np.array([len(w) for w in words], np.int64)
        self.order = np.argsort(-size, kind="stable")
        self.size, start = size[self.order], (np.cumsum(size) - size)[self.order]
        self.start, self.lexicon = start, lexicon
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        powers = np.full(len(codes) + 1, BASE)
        powers[:1] = 1
        back = np.full(len(codes) + 1, INVERSE)
        back[:1] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes + BASE) * np.multiply.accumulate(powers)[:-1])])

    def hashes(self, end: int, length: int, n: int) -> np.ndarray:
        """Of the substrings [end - length, end) of the first ``n`` words."""
        at = self.start[:n] + end
        return (self.sums[at] - self.sums[at - length]) * self.back[at - length]

    def steps(self):
        """(end, number of words that reach it, [(length, words, pieces)])."""
        for end in range(1, int(self.size.max(initial=0)) + 1):
            n = int(np.searchsorted(-self.size, -end, side="right"))
            arcs = []
            for length in range(1, min(end, LONGEST) + 1):
                words, found = self.lexicon.find(self.hashes(end, length, n), every=length == 1)
                if len(words):
                    arcs.append((length, words, found))
            yield end, n, arcs


class Lexicon:
    """Pieces of the vocabulary by hash; ``other`` stands for any other single character."""

    SHIFT = np.uint64(44)  # leaves 20 bits

    def __init__(self, pieces: list[str]):
        self.other, self.size = len(pieces), len(pieces) + 1
        self.key, self.number = np.zeros(1, np.uint64), np.zeros(1, np.int64)
        lattice = Lattice(pieces, self)
        key = np.empty(len(pieces), np.uint64)
        for length in range(1, LONGEST + 1):
            n = int(np.searchsorted(-lattice.size, -length, side="right"))
            mine = np.flatnonzero(lattice.size[:n] == length)
            key[lattice.order[mine]] = lattice.hashes(length, length, n)[mine]
        self.number = np.argsort(key, kind="stable")
        self.key = key[self.number]
        self.place(self.key)

    def place(self, key: np.ndarray) -> None:
        """Where the keys that share their first bits begin; most substrings are no pieces: one look tells."""
        first, start, size = np.unique(key >> self.SHIFT, return_index=True, return_counts=True)
        self.first = np.full(1 << 20, -1, np.int32)
        self.first[first] = start
        self.deepest = int(size.max(initial=1))

    def find(self, h: np.ndarray, every: bool):
        """Positions in ``h`` that are pieces and their numbers; with ``every``, all positions."""
        at = self.first[h >> self.SHIFT]
        rows = np.flatnonzero(at >= 0)
        at, wanted = at[rows], h[rows]
        good = self.key[at] == wanted
        for _ in range(1, self.deepest):  # a few keys share their first bits
            at = np.where(good, at, np.minimum(at + 1, len(self.key) - 1))
            good = self.key[at] == wanted
        if not every:
            return rows[good], self.number[at[good]]
        found = np.full(len(h), self.other)
        found[rows[good]] = self.number[at[good]]
        return np.arange(len(h)), found


@lru_cache(maxsize=2)
def lexicon(path: str) -> Lexicon:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    texts = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return Lexicon(sorted({t for t in texts if 0 < len(t) <= LONGEST}))


def expected(words: list[str], weights: np.ndarray, pieces: Lexicon) -> np.ndarray:
    """Expected piece counts (pieces x columns) of ``words`` under the start model, ``weights`` (words x columns) times each."""
    lattice = Lattice(words, pieces)
    ahead, steps = [np.ones(len(words))], []
    for _, n, arcs in lattice.steps():
        here = np.zeros(n)
        for length, rows, _found in arcs:
            here[rows] += ahead[-length][rows] * START
        ahead.append(here)
        steps.append(arcs)
    total = np.ones(len(words))
    for end, here in enumerate(ahead):
        mine = np.flatnonzero(lattice.size[: len(here)] == end)
        total[mine] = here[mine]
    behind = [np.zeros(len(x)) for x in ahead]
    for end, x in enumerate(behind):
        x[lattice.size[: len(x)] == end] = 1
    share, which, word = [], [], []
    for end in range(len(steps), 0, -1):
        for length, rows, found in steps[end - 1]:
            step = behind[end][rows] * START
            behind[end - length][rows] += step
            share.append(ahead[end - length][rows] * step / total[rows])
            which.append(found)
            word.append(lattice.order[rows])
    if not share:
        return np.zeros((pieces.size, weights.shape[1]))
    share, which, word = map(np.concatenate, (share, which, word))
    return np.stack([np.bincount(which, share * weights[word, c], pieces.size) for c in range(weights.shape[1])], axis=1)


def log_likelihoods(words: list[str], pieces: Lexicon, table: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations of each word (rows), for each language (columns of ``table``)."""
    lattice = Lattice(words, pieces)
    out, scale = np.zeros((len(words), table.shape[1])), np.zeros(len(words))
    ahead = [np.ones((len(words), table.shape[1]))]
    for end, n, arcs in lattice.steps():
        here = np.zeros((n, table.shape[1]))
        for length, rows, found in arcs:
            here[rows] += ahead[-length][rows] * table[found]
        ahead = [*ahead[1 - LONGEST:], here]
        if end % 8 == 0:  # keep the numbers near one
            top = here.max(axis=1)
            scale[:n] += np.log(top)
            ahead = [x[:n] / top[:, None] for x in ahead]
            here = ahead[-1]
        mine = np.flatnonzero(lattice.size[:n] == end)
        out[lattice.order[mine]] = np.log(here[mine]) + scale[mine, None]
    return out


def distinct_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of ``texts``, which of them each word is, and the text it comes from.

    Split at what Python takes as white space.
    """
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    some = pc.not_equal(flat, "")  # blanks at either end leave an empty word
    coded = flat.filter(some).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), row[some.to_numpy(zero_copy_only=False)]


def numbered(words: pa.Array, known: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each of ``words`` in ``known`` followed by the new ones, and these."""
    at = pc.index_in(words, value_set=known)
    new = at.is_null().to_numpy(zero_copy_only=False)
    place = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    place[new] = len(known) + np.arange(new.sum())
    return place, words.filter(pa.array(new))


def parts_of(words: pa.Array):
    """(parts, word of each part) in groups of bounded size: words with the mark; very long ones in parts, so that a text
    without blanks stays bounded."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    upto, a = np.cumsum(size), 0
    while a < len(words):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + TOGETHER)))
        parts, owner = [MARK + w for w in words[a:b].to_pylist()], np.arange(a, b)
        if size[a:b].max() > PART:
            parts = [w[i:i + PART] for w in parts for i in range(0, len(w), PART)]
            owner = np.repeat(owner, -(-size[a:b] // PART))
        most = TOGETHER // PART if b == a + 1 else len(parts)  # a word longer than a group comes alone
        for i in range(0, len(parts), most):
            yield parts[i:i + most], owner[i:i + most]
        a = b


def words_of(text: str) -> list[str]:
    """The words of a text in the order they come, with marks and in parts."""
    return [part for parts, _ in parts_of(pa.array(text.split(), pa.string())) for part in parts]


def strings(texts: pa.Array) -> pa.Array:
    return texts if pa.types.is_string(texts.type) else texts.cast(pa.string())


def piece_counts(labelled: DataFrame, path: str) -> DataFrame:
    """(lang, piece, count): expected piece counts per language over all rows of ``labelled(text, lang)``."""
    def run(batches):
        pieces, totals, langs = lexicon(path), {}, {}
        words, seen = pa.array([], pa.string()), []  # seen: (word, language, times)

        def settle():
            """Turn the words counted so far into piece counts."""
            if not seen:
                return
            word, lang, times = (np.concatenate(x) for x in zip(*seen, strict=True))
            order = np.argsort(word, kind="stable")
            word, lang, times = word[order], lang[order], times[order]
            for group, owner in parts_of(words):
                a, b = np.searchsorted(word, [owner[0], owner[-1] + 1])
                weights = np.zeros((owner[-1] + 1 - owner[0], len(langs)))
                np.add.at(weights, (word[a:b] - owner[0], lang[a:b]), times[a:b])
                for name, counts in zip(langs, expected(group, weights[owner - owner[0]], pieces).T, strict=True):
                    totals[name] = totals.get(name, 0) + counts

        for batch in batches:
            names = batch["lang"].to_pylist()
            number = np.array([langs.setdefault(x, len(langs)) for x in names], np.int64)
            mine, code, row = distinct_words(strings(batch["text"]))
            if not len(code):
                continue
            place, new = numbered(mine, words)
            words = pa.concat_arrays([words, new])
            pair, times = np.unique(code.astype(np.int64) * len(langs) + number[row], return_counts=True)
            seen.append((place[pair // len(langs)], pair % len(langs), times))
            if len(words) * len(langs) > KNOWN:
                settle()
                words, seen = words[:0], []
        settle()
        for lang, counts in totals.items():
            k = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(counts[k])], names=["lang", "piece", "count"])

    parts = python_ready(labelled.filter("lang is not null").select("text", "lang")).mapInArrow(run, "lang string, piece long, count double")
    return parts.groupBy("lang", "piece").agg(F.sum("count").alias("count"))


def train(labelled: DataFrame, path: str) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their piece probabilities (pieces x languages, float32).

    What comes to the driver has at most languages x pieces rows, however many texts there are.
    """
    counts = piece_counts(labelled, path).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((lexicon(path).size, len(langs)), SMOOTHING)
    at = {name: i for i, name in enumerate(langs)}
    # rounded: the order in which tasks were summed must not show
    np.add.at(table, (counts["piece"].to_numpy(np.int64), counts["lang"].map(at).to_numpy(np.int64)), counts["count"].round(6).to_numpy(np.float64))
    return langs, (table / table.sum(axis=0)).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str, text: str = "text", fit: bool = False) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (posterior under equal priors) to ``docs``, from ``text`` alone.

    With ``fit``, also ``log_likelihood`` of the text in its language and ``chars_read``, the characters of its
    words with their marks; both are 0 for ``und``.
    """
    langs, table = model
    made = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)]
    if fit:
        made += [T.StructField("log_likelihood", T.DoubleType(), False), T.StructField("chars_read", T.LongType(), False)]
    rest = docs.drop(*[f.name for f in made])
    schema = T.StructType([*rest.schema.fields, *made])
    sent = docs.sparkSession.sparkContext.broadcast(table)  # languages x vocabulary: bounded

    def run(batches):
        pieces, probabilities = lexicon(path), sent.value.astype(np.float64)
        known, rows = pa.array([], pa.string()), np.zeros((0, len(langs)))
        for batch in batches:
            if rows.size > KNOWN:
                known, rows = known[:0], rows[:0]
            n = batch.num_rows
            told = np.array([bool(langs) and bool(v) and any(map(str.isalpha, v)) for v in batch[text].to_pylist()], bool)
            mine, code, row = distinct_words(pc.if_else(pa.array(told, pa.bool_()), strings(batch[text]), ""))
            place, new = numbered(mine, known)
            fresh = np.zeros((len(new), len(langs)))
            for group, owner in parts_of(new):
                np.add.at(fresh, owner, log_likelihoods(group, pieces, probabilities))
            known, rows = pa.concat_arrays([known, new]), np.concatenate([rows, fresh])
            at = place[code]
            total = np.stack([np.bincount(row, rows[at, c], n) for c in range(len(langs))], axis=1) if langs else np.zeros((n, 1))
            best = total.argmax(axis=1)
            top = total[np.arange(n), best]
            score = np.where(told, 1 / np.exp(total - top[:, None]).sum(axis=1), 0.0)
            pred = [langs[i] if t else UNDETERMINED for i, t in zip(best.tolist(), told.tolist(), strict=True)]
            made_here = [pa.array(pred, pa.string()), pa.array(score)]
            if fit:
                size = pc.utf8_length(mine).to_numpy(zero_copy_only=False) + 1
                made_here += [pa.array(np.where(told, top, 0.0)), pa.array(np.bincount(row, size[code], n).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*[batch[x] for x in schema.names[:-len(made)]], *made_here], names=schema.names)

    return python_ready(rest).mapInArrow(run, schema)


def understood(told: DataFrame, lang: str = "lang") -> DataFrame:
    """The rows of ``told`` (of ``identify`` with ``fit``, written once) that read like their language.

    The middle text of a language is the median over all rows labelled with the language that was
    predicted; where there is none, its rows stay.  ``und`` goes.  The middles, a row for each language of the
    model, are sent to the texts: dealt by language, all texts of one would meet in one task.
    """
    per_char = F.col("log_likelihood") / F.col("chars_read")
    middle = told.filter((F.col(lang) == F.col("lang_pred")) & (F.col("chars_read") > 0)).groupBy(
        F.col("lang_pred").alias("_lang")).agg(F.percentile_approx(per_char, 0.5, 10_000).alias("_middle"))
    least = TIMES * F.col("_middle") * F.col("chars_read") - MARGIN
    rows = told.filter(F.col("lang_pred") != UNDETERMINED).join(F.broadcast(middle), F.col("lang_pred") == F.col("_lang"), "left")
    return rows.filter(F.coalesce(F.col("log_likelihood") >= least, F.lit(True))).drop("_lang", "_middle")
