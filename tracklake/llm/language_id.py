"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum, over all
ways to cut it into pieces, of the products of their probabilities; a forward pass over the word's letters gives it
without listing any segmentation, scaled as it goes, so that no word is too long for it. A text's score is the sum of its
words' log probabilities. Training is expectation maximisation over the same segmentations: a piece's probability is its
expected share of the pieces. The forward pass runs over arrays of words of like length, and a task remembers the words
it has scored.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import cut, small_batches

VOCABULARY = "piece_bpe_32k.model"
TRAIN_DOCS = 2000  # documents of each language, about, that the probabilities are learned from
ROUNDS = 2  # of expectation maximisation, after a start from the vocabulary's own segmentation
SMOOTHING = 0.1
UNKNOWN = 1e-8  # probability of a letter that is no piece
REMEMBERED = 300_000
LETTERS = 1024  # of a word that are worked on at a time
CELLS = 4_000_000  # numbers of the largest array, about

_WORDS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def text_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _WORDS.findall((text or "").lower())


def vocabulary_pieces(path: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return sorted({model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})


class Pieces:
    """The vocabulary's pieces, found in words by rolling hashes of their letters."""

    def __init__(self, pieces: list[str]) -> None:
        self.none, self.unknown = len(pieces), len(pieces) + 1  # ids of no piece, and of a letter that is none
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self.ids = np.argsort(hashes)
        self.hashes = hashes[self.ids]
        self.powers = np.array([pow(int(_BASE), n, 2**64) for n in range(self.longest + 1)], np.uint64)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) % 2**64
        return h

    def prefixes(self, words: list[str]) -> np.ndarray:
        """Hashes of the first 0, 1, 2 ... letters of words of one length, each after the mark of a word's start."""
        n = len(words[0]) + 1
        letters = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64) + np.uint64(1)
        out = np.zeros((n + 1, len(words)), np.uint64)
        for i in range(n):
            out[i + 1] = out[i] * _BASE + letters[:, i]
        return out

    def ending(self, prefixes: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """ids[i - lo, n - 1, word] of the piece of n letters that ends after letter i, for lo <= i < hi."""
        out = np.full((hi - lo, self.longest, prefixes.shape[1]), self.none, np.int32)
        for n in range(1, min(self.longest, hi - 1) + 1):
            first = max(lo, n)
            h = prefixes[first:hi] - prefixes[first - n : hi - n] * self.powers[n]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            found = np.where(self.hashes[at] == h, self.ids[at], self.none)
            out[first - lo :, n - 1] = np.where(found == self.none, self.unknown, found) if n == 1 else found
        return out


def by_length(words: list[str], most: int) -> Iterator[np.ndarray]:
    """Indexes of words of one length, at most so many letters together (or one word)."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        step = max(1, most // (int(n) + 1))
        yield from (rows[i : i + step] for i in range(0, len(rows), step))


class Scorer:
    """Log probabilities of words, one column for each language."""

    def __init__(self, pieces: list[str], probabilities: np.ndarray) -> None:
        n = probabilities.shape[1]
        self.p = np.vstack([probabilities, np.zeros((1, n)), np.full((1, n), UNKNOWN)])
        self.pieces = Pieces(pieces)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, self.p.shape[1]))

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probability of each word: alpha[i] sums alpha[i - n] p(piece) over the pieces of n letters that end at i.

        Only the last alphas are kept, divided by the newest every few letters; the logarithms of the divisors add up.
        """
        out, longest = np.zeros((len(words), self.p.shape[1])), self.pieces.longest
        for rows in by_length(words, max(1, CELLS // (longest * self.p.shape[1]))):
            prefixes = self.pieces.prefixes([words[i] for i in rows])
            n = len(prefixes) - 1
            shape = (len(rows), self.p.shape[1])
            alphas, scale = deque([np.ones(shape)], longest), np.zeros(shape)  # the newest last
            for lo in range(1, n + 1, LETTERS):
                for i, here in enumerate(self.pieces.ending(prefixes, lo, min(n + 1, lo + LETTERS)), lo):
                    alpha = np.zeros(shape)
                    for size in range(1, len(alphas) + 1):
                        if (here[size - 1] != self.pieces.none).any():
                            alpha += alphas[-size] * self.p[here[size - 1]]
                    alphas.append(alpha)
                    if i % 8 == 0 or i == n:
                        scale += np.log(alpha)
                        alphas = deque((x / alpha for x in alphas), longest)
            out[rows] = scale
        return out

    def texts(self, texts: list[list[str]]) -> np.ndarray:
        """Sum of word scores of each text."""
        if len(self.known) > REMEMBERED:
            self.forget()
        new = list({w for ws in texts for w in ws} - self.known.keys())
        if new:
            self.known |= {w: i for i, w in enumerate(new, len(self.known))}
            self.scores = np.vstack([self.scores, self.forward(new)])
        return np.array([self.scores[np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws))].sum(axis=0) for ws in texts]).reshape(len(texts), -1)


def expected_counts(pieces: Pieces, log_p: np.ndarray, words: list[str], weights: np.ndarray) -> np.ndarray:
    """How often each piece (and, at the end, no piece and an unknown letter) is expected in the words' segmentations.

    log_p: log probabilities in one language, with those of no piece (-inf) and of an unknown letter at the end. Forward
    and backward passes in logarithms; words count by their weights.
    """
    out = np.zeros(len(log_p))
    for rows in by_length(words, max(1, CELLS // (4 * pieces.longest))):
        prefixes = pieces.prefixes([words[i] for i in rows])
        n = len(prefixes) - 1
        ids = pieces.ending(prefixes, 1, n + 1)
        forward, backward = np.full((n + 1, len(rows)), -np.inf), np.full((n + 1, len(rows)), -np.inf)
        forward[0] = backward[n] = 0
        for i in range(1, n + 1):
            sizes = np.arange(1, min(i, pieces.longest) + 1)
            forward[i] = np.logaddexp.reduce(forward[i - sizes] + log_p[ids[i - 1, sizes - 1]], axis=0)
        for i in range(n, 0, -1):
            for size in range(1, min(i, pieces.longest) + 1):
                backward[i - size] = np.logaddexp(backward[i - size], backward[i] + log_p[ids[i - 1, size - 1]])
        for i in range(1, n + 1):
            for size in range(1, min(i, pieces.longest) + 1):
                here = ids[i - 1, size - 1]
                share = np.exp(forward[i - size] + log_p[here] + backward[i] - forward[n]) * weights[rows]
                np.add.at(out, here, share)
    return out


def word_counts(train: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) of the training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: dict[str, Counter] = {}
            for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.setdefault(g, Counter()).update(text_words(t))
            rows = [(g, w, n) for g, ws in words.items() for w, n in ws.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    return train.select(text, lang).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def piece_counts(words: DataFrame, model: tuple[list[str], list[str], np.ndarray] | None, path: str) -> DataFrame:
    """(lang, piece, n): counts of pieces in words (lang, word, n), expected by a model, or by the vocabulary's own cut."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        langs, names, p = shared.value or ([], [], None)
        pieces = Pieces(names) if names else None
        by_lang: dict[str, tuple[list[str], list[int]]] = {}  # a task's part of the words of the training sample
        for b in batches:
            for g, w, k in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                ws, n = by_lang.setdefault(g, ([], []))
                ws.append(w)
                n.append(k)
        for g, (ws, n) in by_lang.items():
            if pieces:
                with np.errstate(divide="ignore"):
                    log_p = np.log(np.concatenate([p[:, langs.index(g)], [0, UNKNOWN]]))
                counts = expected_counts(pieces, log_p, ws, np.array(n, float))
                out = {names[i]: float(counts[i]) for i in np.flatnonzero(counts[: len(names)])}
            else:
                out = Counter()
                for x, k in zip(own.encode(ws, out_type=str), n, strict=True):
                    for piece in x:
                        out[piece] += k
            columns = [pa.array([g] * len(out), pa.string()), pa.array(list(out), pa.string()), pa.array(map(float, out.values()), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "piece", "n"])

    return words.repartition(32).mapInArrow(run, "lang string, piece string, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def fit(
    train: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", train_docs: int = TRAIN_DOCS, vocabulary: str | None = None, rounds: int = ROUNDS,
) -> tuple[list[str], list[str], np.ndarray]:
    """(languages, pieces, probabilities) from at most about train_docs documents of each language, chosen by id hash.

    Rows of null text or lang teach nothing. To the driver come one row for each language, then, each round, at most one
    for each language and piece of the vocabulary: the model is 250 KB a value of lang.
    """
    small_batches(train.sparkSession)
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    train = train.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sizes = {r[lang]: r["n"] for r in train.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    pieces = vocabulary_pieces(path)
    at, column = {p: i for i, p in enumerate(pieces)}, {g: i for i, g in enumerate(langs)}
    probabilities = np.full((len(pieces), len(langs)), 1 / max(1, len(pieces)))
    if not langs:
        return langs, pieces, probabilities
    limit = F.create_map(*[F.lit(x) for g in langs for x in (g, min(1_000_000, 1_000_000 * train_docs // sizes[g]))])
    words = cut(word_counts(train.where(F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)) < limit[F.col(lang)]), text, lang))
    for i in range(rounds + 1):
        counts = np.full((len(pieces), len(langs)), SMOOTHING)
        for r in piece_counts(words, (langs, pieces, probabilities) if i else None, path).collect():
            if r["piece"] in at:
                counts[at[r["piece"]], column[r["lang"]]] += r["n"]
        probabilities = counts / counts.sum(axis=0, keepdims=True)
    return langs, pieces, probabilities


def predict(df: DataFrame, model: tuple[list[str], list[str], np.ndarray], text: str = "text") -> DataFrame:
    """df with its text replaced by lang_pred and score, the posterior probability of lang_pred at equal priors.

    Texts that are null or have no letter, and all texts if nothing was learned, are `und` with score 0. Ties go to the
    language that sorts first. Repeated rows are scored alike. Columns lang_pred and score of df are replaced.
    """
    spark = df.sparkSession
    small_batches(spark)
    langs, keep = model[0], [c for c in df.columns if c not in (text, "lang_pred", "score")]
    shared = spark.sparkContext.broadcast(model)  # vocabulary x languages, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value[1:]) if langs else None
        for b in batches:
            ws = [text_words(t.as_py()) for t in b.column(text)]
            names, scores = ["und"] * len(ws), [0.0] * len(ws)
            if scorer and ws:
                logs = scorer.texts(ws)
                best = logs.argmax(axis=1)
                posterior = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                for i, w in enumerate(ws):
                    if w:
                        names[i], scores[i] = langs[best[i]], float(posterior[i])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return df.mapInArrow(run, df.select(*keep).withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema)
