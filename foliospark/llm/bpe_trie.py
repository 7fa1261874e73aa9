"""Byte-level BPE encoding and decoding over a trie of the distinct words.

The encoding of a string's prefix is fixed by its last token: the encoding of w[:i] is that of w[:i - len(t)] followed by
t, where t is the one vocabulary entry that ends at i and that BPE would not merge across its left neighbour. So the
state of a trie node is one token (the candidates come from an Aho-Corasick automaton of the vocabulary, whose state goes with it). The distinct words of a batch are put in byte order, which is the depth-first order of
their trie: neighbours share the path down to their longest common prefix, the stack of states is that path, and every
shared prefix is encoded once. Whether two tokens may stand side by side is settled once a pair, from the order of the merges that make
them.

Results equal those of the `tokenizers` library for a byte-level BPE file without normaliser. Special tokens in a text
are matched first, as that library does.

Scale: a narrow map without a shuffle; a worker keeps a bounded word cache between batches; the vocabulary (a file of fixed
size) is read on the driver and broadcast. Work and memory are linear in the length of a word, however long it is.

Defined cases: a null text counts as empty, an empty text has no ids and decodes to the empty string; null ids decode to
the empty string; ids outside the vocabulary decode to nothing; rows keep all their columns, and a column that has an
output's name is replaced; an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

import json
from struct import pack

import numpy as np
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

#: Fixed values of byte-level BPE: the pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words, and pairs of tokens, kept by a task between batches; beyond it a cache starts afresh. Bounds memory, not results.
CACHE_WORDS, CACHE_PAIRS = 150_000, 300_000
#: Characters of text that are split and encoded together.
CHUNK_CHARS = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level file writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """One vocabulary: tokens as bytes, merge ranks, and the memo of pairs that may stand side by side."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = data["model"]["vocab"]
        self.id_of = {as_bytes(s): k for s, k in vocab.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = 1 + max([*self.id_of.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, k in self.id_of.items():
            self.bytes_of[k] = token
        for token, k in self.special.items():
            self.bytes_of[k] = token.encode()
        self.code_of = [pack("<I", k) for k in range(size)]
        # how each token is made: its two parts, and the rank of each merge of two tokens
        self.rank: dict[int, int] = {}
        self.parts: list[tuple[int, int, int] | None] = [None] * size
        for rank, (a, b) in enumerate(merges):
            left, right, k = self.id_of[as_bytes(a)], self.id_of[as_bytes(b)], self.id_of[as_bytes(a) + as_bytes(b)]
            if self.rank.setdefault(left * size + right, rank) == rank and self.parts[k] is None:
                self.parts[k] = (left, right, rank)
        self.never = len(merges)
        self._automaton()
        self.side_by_side: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]

    def _automaton(self) -> None:
        """The vocabulary as a trie with failure links: a state is the longest suffix read that begins a token.

        child: state * 256 + byte to state; ends: the tokens that end at a state, longest first, with their lengths.
        """
        self.child: dict[int, int] = {}
        nodes, token_at = [(0, 0, 0, 0)], [-1]  # depth, parent, byte, state
        for token, k in self.id_of.items():
            state = 0
            for depth, x in enumerate(token):
                after = self.child.setdefault(state * 256 + x, len(token_at))
                if after == len(token_at):
                    token_at.append(-1)
                    nodes.append((depth + 1, state, x, after))
                state = after
            token_at[state] = k
        self.fail, self.ends = [0] * len(nodes), [()] * len(nodes)
        for depth, parent, x, state in sorted(nodes)[1:]:
            if depth > 1:
                self.fail[state] = self._next(self.fail[parent], x)
            own = ((token_at[state], depth),) if token_at[state] >= 0 else ()
            self.ends[state] = own + self.ends[self.fail[state]]

    def _next(self, state: int, x: int) -> int:
        while (after := self.child.get(state * 256 + x)) is None:
            if not state:
                return 0
            state = self.fail[state]
        return after

    def stays(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b side by side: remembered in side_by_side.

        Both grow from the bytes at their border. Merges come in the order of their ranks, and from left to right
        within a rank; the border falls if its two current parts have a merge that comes before the next growth.
        """
        size, rank, never = len(self.bytes_of), self.rank.get, self.never
        lefts, rights, i, j = self._border(a, 1), self._border(b, 0), 0, 0
        while True:
            across = rank(lefts[i][0] * size + rights[j][0], never)
            grow_left = lefts[i + 1][1] if i + 1 < len(lefts) else never
            grow_right = rights[j + 1][1] if j + 1 < len(rights) else never
            if across < grow_left and across <= grow_right and across < never:
                known = False
                break
            if grow_left == grow_right == never:
                known = True
                break
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1
        if len(self.side_by_side) >= CACHE_PAIRS:
            self.side_by_side.clear()
        self.side_by_side[a * size + b] = known
        return known

    def _border(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token's outermost parts on one side (0: left, 1: right), from the byte to the whole, each with its merge's rank."""
        out = []
        while (made := self.parts[token]) is not None:
            out.append((token, made[2]))
            token = made[side]
        out.append((token, -1))
        return out[::-1]

    def encode_words(self, found: set[str]) -> None:
        """Put the encodings of all these words into the cache: a depth-first walk of their trie."""
        child, fail, ends, known, stays, code_of, size = self.child.get, self.fail, self.ends, self.side_by_side.get, self.stays, self.code_of, len(self.bytes_of)
        path, states, last, before = b"", [0], [-1], [0]
        for word, text in sorted([(w.encode(), w) for w in found]):
            shared = 0
            for x, y in zip(path, word, strict=False):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :], last[shared + 1 :], before[shared + 1 :]
            state, end = states[-1], shared
            for x in word[shared:]:
                end += 1
                while (after := child(state * 256 + x)) is None and state:
                    state = fail[state]
                state = after or 0
                for k, length in ends[state]:
                    start = end - length
                    if start:
                        ok = known(last[start] * size + k)
                        if ok is None:
                            ok = stays(last[start], k)
                        if not ok:
                            continue
                    break
                states.append(state)
                last.append(k)
                before.append(start)
            path, codes = word, []
            while end:
                codes.append(code_of[last[end]])
                end = before[end]
            self.words[text] = b"".join(reversed(codes))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            pieces, chars = [], 0
            while at < len(texts) and (chars < CHUNK_CHARS or not pieces):
                text = texts[at]
                chars += len(text)
                pieces.append([part if part in self.special else self.split(part) for part in self.cut(text) if part])
                at += 1
            if len(self.words) > CACHE_WORDS:
                self.words.clear()
            new: set[str] = set()
            for doc in pieces:
                for part in doc:
                    if not isinstance(part, str):
                        new.update(part)
            self.encode_words(new.difference(self.words))
            get = self.words.__getitem__
            out += [b"".join(pack("<I", self.special[p]) if isinstance(p, str) else b"".join(map(get, p)) for p in doc) for doc in pieces]
        return out

    def decode_batch(self, ids: list[bytes]) -> list[str]:
        table, size = self.bytes_of, len(self.bytes_of)
        out = []
        for raw in ids:
            codes = np.frombuffer(raw, "<u4")
            out.append(b"".join(map(table.__getitem__, codes[codes < size].tolist())).decode("utf-8", "replace"))
        return out


def _forget() -> None:
    """Empty the caches at the end of a task: an idle worker holds the vocabularies only."""
    for model in list(_MODELS.values()):
        model.words.clear()
        model.side_by_side.clear()


_MODELS: dict[int, ByteBpe] = {}


def _model(spec: str) -> ByteBpe:
    """This worker's vocabulary; another one replaces it."""
    key = hash(spec)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = ByteBpe(spec)
    return _MODELS[key]


def vocabulary(df: DataFrame, path: str | None = None) -> Broadcast:
    """The tokenizer file, read on the driver and sent once to each executor; its size doesn't depend on the data."""
    with open(path or default_path(), encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """df with ids_col: the token ids of the whole text as little-endian unsigned 32-bit integers."""
    spec = vocabulary(df, path)
    return mapped(df, text_col, ids_col, "binary", lambda v: _model(spec.value).encode_batch([x or "" for x in v]), _forget)


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """df with text_col: the text of the ids, special tokens included."""
    spec = vocabulary(df, path)
    return mapped(df, ids_col, text_col, "string", lambda v: _model(spec.value).decode_batch([x or b"" for x in v]))


def round_trip(df: DataFrame, text_col: str = "text", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """df without its text, with n_tokens, ids_sha256 and decoded_sha256 (and the ids themselves if asked for). Encodes and decodes in one pass through Python."""
    spec = vocabulary(df, path)

    def both(texts):
        model = _model(spec.value)
        ids = model.encode_batch([x or "" for x in texts])
        return [{"ids": i, "decoded": d} for i, d in zip(ids, model.decode_batch(ids), strict=True)]

    coded = mapped(df, text_col, "__fs_coded", "struct<ids:binary,decoded:string>", both, _forget).drop(text_col)
    return coded.select(
        *[c for c in coded.columns if c != "__fs_coded"], (F.length("__fs_coded.ids") / 4).cast("long").alias("n_tokens"),
        *([F.col("__fs_coded.ids").alias("ids")] if keep_ids else []), F.sha2("__fs_coded.ids", 256).alias("ids_sha256"), F.sha2(F.col("__fs_coded.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
