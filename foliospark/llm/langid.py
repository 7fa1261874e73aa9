"""Language ID by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product over its words, and the answer is the language
with the highest posterior under equal priors. Training is expectation maximisation: piece counts expected over all
segmentations (forward-backward) of the sample's words, in Spark jobs that return one number a piece and language.

Words are runs of letters in lower case, with the vocabulary's word mark before them. A letter outside the vocabulary is
a piece of its own with probability `UNKNOWN` in every language.

Scale: the model is fitted on at most `SAMPLE` documents a language, chosen by the hash of doc_id (rows that repeat as a whole count
once); its size is that of the vocabulary times the languages. Words are trained whole, whatever their length. Prediction is a narrow map without a shuffle. A task scores each distinct word of a
chunk once, many of them in step (numpy), and keeps a bounded cache.

Defined cases: null texts and texts without a letter are `und` with score 0; with nothing to learn from every text is; equal texts
have equal answers, ties go to the first language by name; a null doc_id counts as the empty string for the fold,
and its row may be learned from; all columns are kept, those named like an output are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import for_long_rows, mapped, written

#: Documents a language to learn from, rounds of expectation maximisation, parts of a language that are ranked apart.
SAMPLE, ROUNDS, PARTS = 300, 3, 64
UNKNOWN, SMOOTHING = 1e-7, 0.05
#: Probabilities are held times SCALE for each character, so that products over a word stay near one.
SCALE, LONG = 12.0, 64
CACHE_WORDS, CHUNK_CHARS, LATTICE_WORDS = 200_000, 500_000, 8_000
MARK = "▁"
LETTERS = regex.compile(r"\p{L}+").findall
RESULT = "struct<lang_pred:string,score:double>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_of(path: str | None = None) -> list[str]:
    """Pieces made of letters (and the word mark), in lower case, in order, each once."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
    each = (model.id_to_piece(k).lower() for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k)))
    return [p for p in dict.fromkeys(each) if p.strip(MARK) == "".join(LETTERS(p)) and p[1:].find(MARK) < 0]


@lru_cache(maxsize=2)
def _automaton(pieces: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, p in enumerate(pieces):
        found.add_word(p, (k, len(p)))
    found.make_automaton()
    return found


def words_of(text: str | None) -> list[str]:
    return LETTERS((text or "").lower())


class Lattice:
    """All pieces in all positions of some words, and sums over their paths for several languages at once."""

    def __init__(self, pieces: tuple[str, ...], words: list[str]):
        marked = [MARK + w for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])  # a separator after each word
        hits = [(end, k, n) for end, (k, n) in _automaton(pieces).iter("\n".join(marked))]
        ends, ids, lengths = np.array(hits, np.int64).reshape(-1, 3).T
        total = int(begin[-1])
        single = np.zeros(total, bool)
        single[ends[lengths == 1]] = True
        single[begin[1:] - 1] = True
        lone = np.flatnonzero(~single[:total])
        ends, ids, lengths = np.concatenate([ends, lone]), np.concatenate([ids, np.full(len(lone), len(pieces))]), np.concatenate([lengths, np.ones(len(lone), np.int64)])
        word = np.searchsorted(begin, ends, "right") - 1
        step = ends - begin[word] + 1
        order = np.lexsort((ends, step))
        # node b is before character b; edges go from node `source` to node `target`
        self.target, self.source, self.ids, step = (x[order] for x in (ends + 1, ends + 1 - lengths, ids, step))
        self.cuts = np.searchsorted(step, np.arange(1, (step.max() if len(step) else 0) + 2))
        self.begin, self.final, self.nodes = begin[:-1], begin[:-1] + sizes, total + 1
        self.sizes = sizes

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Sums of path products into every node; weight: (pieces + 1, languages)."""
        alpha = np.zeros((self.nodes, weight.shape[1]))
        alpha[self.begin] = 1
        for low, high in zip(self.cuts, self.cuts[1:], strict=False):
            if low < high:
                target = self.target[low:high]
                first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
                alpha[target[first]] = np.add.reduceat(alpha[self.source[low:high]] * weight[self.ids[low:high]], first, axis=0)
        return alpha

    def backward(self, weight: np.ndarray) -> np.ndarray:
        beta = np.zeros((self.nodes, weight.shape[1]))
        beta[self.final] = 1
        for low, high in reversed(list(zip(self.cuts, self.cuts[1:], strict=False))):
            np.add.at(beta, self.source[low:high], beta[self.target[low:high]] * weight[self.ids[low:high]])
        return beta


def _lengths(pieces: tuple[str, ...]) -> np.ndarray:
    return np.array([*map(len, pieces), 1])


def log_scores(pieces: tuple[str, ...], probability: np.ndarray, words: list[str]) -> np.ndarray:
    """(words, languages): log of the sum over all segmentations."""
    weight = probability * (SCALE ** _lengths(pieces))[:, None]
    out = np.empty((len(words), probability.shape[1]))
    short = [k for k, w in enumerate(words) if len(w) <= LONG]
    for at in range(0, len(short), LATTICE_WORDS):
        part = short[at : at + LATTICE_WORDS]
        lattice = Lattice(pieces, [words[k] for k in part])
        out[part] = np.log(lattice.forward(weight)[lattice.final]) - np.log(SCALE) * lattice.sizes[:, None]
    for k, w in enumerate(words):
        if len(w) > LONG:
            out[k] = _long_score(pieces, probability, MARK + w)
    return out


def _edges(pieces: tuple[str, ...], word: str) -> list[list[tuple[int, int]]]:
    """For each node of a word the (piece, length) that end there; a letter outside the vocabulary is a piece of its own."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(word) + 1)]
    for end, found in _automaton(pieces).iter(word):
        out[end + 1].append(found)
    for edges in out[1:]:
        if not any(n == 1 for _, n in edges):
            edges.append((len(pieces), 1))
    return out


def _log_forward(edges: list[list[tuple[int, int]]], log_p: np.ndarray) -> np.ndarray:
    """Logs of the sums into every node of one word, of any length; log_p: (pieces + 1, languages)."""
    logs = np.zeros((len(edges), log_p.shape[1]))
    for node in range(1, len(edges)):
        parts = np.stack([logs[node - n] + log_p[k] for k, n in edges[node]])
        top = parts.max(0)
        logs[node] = top + np.log(np.exp(parts - top).sum(0))
    return logs


def _long_score(pieces: tuple[str, ...], probability: np.ndarray, word: str) -> np.ndarray:
    return _log_forward(_edges(pieces, word), np.log(probability))[-1]


def _long_counts(pieces: tuple[str, ...], probability: np.ndarray, word: str) -> np.ndarray:
    """expected_counts for one word of any length and one language, by logs."""
    edges, log_p = _edges(pieces, word), np.log(probability)
    ahead = _log_forward(edges, log_p[:, None])[:, 0]
    back = np.full(len(edges), -np.inf)
    back[-1] = 0
    total = np.zeros(len(pieces) + 1)
    for node in range(len(edges) - 1, 0, -1):
        for k, n in edges[node]:
            through = log_p[k] + back[node]
            total[k] += np.exp(ahead[node - n] + through - ahead[-1])
            back[node - n] = np.logaddexp(back[node - n], through)
    return total


def expected_counts(pieces: tuple[str, ...], probability: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """(pieces + 1): how often each piece is used in `words`, `counts` times each, over all segmentations of one language."""
    long = [k for k, w in enumerate(words) if len(w) > LONG]
    total = np.zeros(len(pieces) + 1)
    for k in long:
        total += counts[k] * _long_counts(pieces, probability, MARK + words[k])
    short = [k for k, w in enumerate(words) if len(w) <= LONG]
    if not short:
        return total
    words, counts = [words[k] for k in short], counts[short]
    weight = probability[:, None] * (SCALE ** _lengths(pieces))[:, None]
    lattice = Lattice(pieces, words)
    alpha, beta = lattice.forward(weight)[:, 0], lattice.backward(weight)[:, 0]
    of_word = np.searchsorted(lattice.begin, lattice.source, "right") - 1
    share = alpha[lattice.source] * weight[lattice.ids, 0] * beta[lattice.target] / alpha[lattice.final][of_word]
    return total + np.bincount(lattice.ids, share * counts[of_word], len(pieces) + 1)


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, path: str | None = None) -> dict:
    """{pieces, languages, probability} from the labelled rows of docs (doc_id, text, lang) outside the held-out fold."""
    spark = docs.sparkSession
    for_long_rows(spark)
    pieces = tuple(pieces_of(path))
    named = docs.select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h"), F.xxhash64("doc_id", "lang", "text").alias("row"))
    labelled = named.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 0))
    chosen = labelled.select("lang", "doc_id", "h", "row")
    for by in (["lang", F.pmod(F.col("row"), F.lit(PARTS))], ["lang"]):  # first within parts, so that no task gets all rows of a language
        chosen = chosen.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id", "row"))).filter(F.col("r") <= sample).drop("r")
    chosen = chosen.select("row").distinct()
    # `sample` rows a language at most; rows that repeat as a whole are one
    texts = labelled.join(F.broadcast(chosen), "row").select("row", "lang", "text").dropDuplicates(["row"])
    spans = F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))
    counted = written(texts.select("lang", spans.alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    languages = sorted(r.lang for r in counted.select("lang").distinct().collect())
    start = np.array([0.25 ** len(p.strip(MARK)) for p in pieces] + [UNKNOWN])
    probability = np.repeat((start / start.sum())[:, None], len(languages), 1)
    for _ in range(rounds if languages else 0):
        model = spark.sparkContext.broadcast((pieces, languages, probability))

        def expect(batches, model=model):
            pieces, languages, probability = model.value
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                langs, words, ns = np.array(batch.column("lang").to_pylist(), object), batch.column("word").to_pylist(), np.array(batch.column("n").to_pylist(), float)
                for lang in set(langs):
                    rows = np.flatnonzero(langs == lang)
                    part = expected_counts(pieces, probability[:, languages.index(lang)], [words[k] for k in rows], ns[rows])
                    total[lang] = total.get(lang, 0) + part
            for lang, sums in total.items():
                used = np.flatnonzero(sums)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(used), "piece": used, "n": sums[used]})

        parts = counted.mapInArrow(expect, "lang string, piece long, n double")
        sums = np.full(probability.shape, SMOOTHING)
        for r in parts.groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():  # a number a piece and language at most
            sums[r.piece, languages.index(r.lang)] += r.n
        sums[-1] = 0
        probability = sums / sums.sum(0)
        probability[-1] = UNKNOWN
    return {"pieces": pieces, "languages": languages, "probability": probability}


class Scorer:
    """A worker's model with its cache of word scores."""

    def __init__(self, model: dict):
        self.model, self.rows, self.table = model, {}, np.empty((0, len(model["languages"])))

    def predict(self, texts: list[str | None]) -> list[dict]:
        names = self.model["languages"]
        out: list[dict] = []
        at = 0
        while at < len(texts):
            docs, chars = [], 0
            while at < len(texts) and (chars < CHUNK_CHARS or not docs):
                docs.append(words_of(texts[at]))
                chars += len(texts[at] or "")
                at += 1
            if len(self.rows) > CACHE_WORDS:
                self.rows, self.table = {}, self.table[:0]
            new = sorted(set().union(*docs).difference(self.rows))
            if new and names:
                self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
                self.table = np.concatenate([self.table, log_scores(self.model["pieces"], self.model["probability"], new)])
            for words in docs:
                if not words or not names:
                    out.append({"lang_pred": "und", "score": 0.0})
                    continue
                logs = self.table[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))].sum(0)
                best = int(logs.argmax())
                out.append({"lang_pred": names[best], "score": float(1 / np.exp(logs - logs[best]).sum())})
        return out


_SCORERS: dict[str, Scorer] = {}


def _scorer(name: str, model: Broadcast) -> Scorer:
    """This worker's scorer for the model of that name; an older one is dropped."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(model.value)
    return _SCORERS[name]


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score for the whole text."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    read = mapped(docs.drop("lang_pred", "score"), text_col, "__fs_answer", RESULT, lambda texts: _scorer(name, sent).predict(texts), _SCORERS.clear)
    return read.select("*", "__fs_answer.*").drop("__fs_answer")
