"""Byte-level BPE by a lazily determinised finite-state transducer, and its streaming inverse.

Why a transducer works: let T(w) be the BPE tokens of w. If T(w) ends in token t, then T(w without t) is T(w) without
that t, so each prefix of w needs only its last token. Token t can follow token s exactly if T(st) = (s, t). Reading a
byte, the machine extends every live boundary - a place from which the bytes read so far still begin some token - in
the vocabulary's trie, and picks the one complete token that can follow the last token at its boundary: the last token of what has been
read. Tokens shared by all live boundaries can't change any more and are emitted, so the lookahead is bounded. A state
is the live boundaries, each with the last token before it and its trie node. States and moves are made when first
needed and kept, up to MOST_STATES; then the machine forgets them and goes on.

Decoding concatenates the tokens' bytes; the text comes from an incremental UTF-8 machine, whose state is at most the three
bytes of an unfinished character.

Edge cases: null text counts as empty, and empty text has no tokens; bytes that aren't UTF-8 are read as U+FFFD;
repeated rows keep a row each; an empty table gives an empty result; other columns are ignored by `encode_table`.
"""

from __future__ import annotations

import base64
import codecs
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from vectide.llm.scratch import held, prepare, table, text_of

VOCABULARY, PATTERN = "byte_bpe_50k.tiktoken", public_tokenizers.PATTERN
#: States (with two moves each) and matches kept by a worker.
MOST_STATES, MOST_WORDS = 200_000, 120_000
#: Bytes after which what is certain is emitted; over twice the longest token.
LOOKAHEAD = 1024
HEAD = 5


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes one pre-token (bytes) after another. `ranks` gives merge priority and id of each token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.shift = max(self.bytes_of).bit_length()
        self.mask = (1 << self.shift) - 1
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.depth: list[int] = [0]
        for token, i in ranks.items():
            node = 0
            for b in token:
                if b not in self.trie[node]:
                    self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = self.trie[node][b]
            self.token_at[node] = i
        leaf: dict[int, int] = {}  # one dict for all nodes without children
        self.trie = [t or leaf for t in self.trie]
        self.size = {i: len(t) for i, t in self.bytes_of.items()}
        self.same = {i: i for i in self.size}  # one object for each id, shared by all that is kept
        self.pairs: dict[int, bool] = {}
        self.reachable: dict[int, bool] = {}  # tokens that the merges themselves don't produce are never emitted
        self.forget()

    def forget(self) -> None:
        """A state is the live boundaries in order of place, each as (last token before it, or -1) * nodes + trie node."""
        start = (-len(self.trie),)
        self.states, self.number = [start], {start: 0}
        #: state << 8 | byte -> next state << shift | last token of what has been read
        self.moves: dict[int, int] = {}
        #: The first HEAD bytes of a pre-token -> state and last tokens after them: many words begin alike.
        self.heads: dict[bytes, tuple[int, tuple[int, ...]]] = {}

    def merge(self, word: bytes) -> list[int]:
        """The definition: merge the adjacent pair of least rank, leftmost first, until none is left."""
        parts, ranks = [word[i : i + 1] for i in range(len(word))], self.ranks
        costs = [ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(len(parts) - 1)]
        while costs:
            best = min(costs)
            if best == 1 << 60:
                break
            at = costs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at < len(costs):
                costs[at] = ranks.get(parts[at] + parts[at + 1], 1 << 60)
            if at:
                costs[at - 1] = ranks.get(parts[at - 1] + parts[at], 1 << 60)
        return [ranks[p] for p in parts]

    def _stands(self, token: int) -> bool:
        if token not in self.reachable:
            self.reachable[token] = self.merge(self.bytes_of[token]) == [token]
        return self.reachable[token]

    def _follows(self, before: int, token: int) -> bool:
        if before < 0:
            return self._stands(token)
        key = before << self.shift | token
        got = self.pairs.get(key)
        if got is None:
            got = self._stands(token) and self.merge(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
            if len(self.pairs) > MOST_STATES:
                self.pairs.clear()
            self.pairs[key] = got
        return got

    def _move(self, key: int) -> int:
        """The move for state << 8 | byte, made and kept."""
        live, done, trie, byte, nodes = [], -1, self.trie, key & 255, len(self.trie)
        for boundary in self.states[key >> 8]:
            last, node = divmod(boundary, nodes)
            to = trie[node].get(byte)
            if to is not None:
                if trie[to]:  # a node without children can't be extended
                    live.append(boundary - node + to)
                if done < 0 and (token := self.token_at[to]) >= 0 and self._follows(last, token):
                    done = token
        if done < 0:
            raise ValueError("the vocabulary lacks a single byte")
        live.append(done * nodes)
        after = tuple(live)
        number = self.number.get(after)
        if number is None:
            number = self.number[after] = len(self.states)
            self.states.append(after)
        self.moves[key] = got = number << self.shift | done
        return got

    def _back(self, lasts: list[int], end: int) -> list[int]:
        """Tokens up to place `end`, from the last token at each place."""
        out, size, same = [], self.size, self.same
        while end > 0:
            token = lasts[end - 1]
            out.append(same[token])
            end -= size[token]
        out.reverse()
        return out

    def _certain(self, lasts: list[int], state: int) -> int:
        """The last place that the tokens up to every live boundary pass through."""
        ends = {len(lasts) - self.depth[boundary % len(self.trie)] for boundary in self.states[state]}
        while len(ends) > 1:
            far = max(ends)
            ends.discard(far)
            ends.add(far - self.size[lasts[far - 1]])
        return ends.pop()

    def encode(self, word: bytes) -> list[int]:
        if len(self.states) > MOST_STATES or len(self.moves) > 2 * MOST_STATES:
            self.forget()
        head = word[:HEAD]
        known = self.heads.get(head)
        if known is None:
            state, lasts = self._read(0, [], head)
            self.heads[head] = state, tuple(lasts)
        else:
            state, lasts = known[0], list(known[1])
        if len(word) <= LOOKAHEAD:
            self._read(state, lasts, word[HEAD:])
            return self._back(lasts, len(lasts))
        out: list[int] = []
        for at in range(HEAD, len(word), LOOKAHEAD):
            state, _ = self._read(state, lasts, word[at : at + LOOKAHEAD])
            sure = self._certain(lasts, state)
            out += self._back(lasts, sure)
            del lasts[:sure]
        return out + self._back(lasts, len(lasts))

    def _read(self, state: int, lasts: list[int], part: bytes) -> tuple[int, list[int]]:
        """The state after the bytes of `part`; adds the last token at each place to `lasts`."""
        get, move, add, shift, mask = self.moves.get, self._move, lasts.append, self.shift, self.mask
        for byte in part:
            key = state << 8 | byte
            got = get(key)
            if got is None:
                got = move(key)
            state = got >> shift
            add(got & mask)
        return state, lasts


class Utf8Stream:
    """Incremental UTF-8: push bytes, get the text that is complete so far; `close` gives what is left, replaced.

    The machine is the library's incremental decoder: its state is the bytes of a character that has begun, three at most.
    """

    def __init__(self):
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, data: bytes) -> str:
        return self.machine.decode(data)

    def close(self) -> str:
        return self.machine.decode(b"", True)


def narrow_pattern() -> re.Pattern:
    """PATTERN for texts of code points below 256, with its classes written out: the same matches, found faster."""
    letters, numbers, spaces = ("".join(re.escape(chr(i)) for i in range(256) if regex.match(c, chr(i))) for c in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


class Codec:
    """Encodes texts and decodes ids; each match of the pattern is encoded by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.machine = Transducer(ranks)
        self.split = regex.compile(pattern)
        self.narrow = narrow_pattern() if pattern == PATTERN else None
        #: Encoded matches (four bytes an id): those of late, and those of before, from which the ones that recur are taken over.
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def matches(self, text: str) -> list[str]:
        if self.narrow is not None:
            try:
                text.encode("latin-1")
                return self.narrow.findall(text)
            except UnicodeEncodeError:
                pass
        return self.split.findall(text)

    def _word(self, w: str) -> bytes:
        got = self.words.get(w) or self.before.get(w)
        if got is None:
            got = np.array(self.machine.encode(w.encode("utf-8")), "<i4").tobytes()
            if len(w) > 64:
                return got
        if len(self.words) >= MOST_WORDS:
            self.before, self.words = self.words, {}
        self.words[w] = got
        return got

    def encode_packed(self, text: str) -> bytes:
        """The ids, four bytes each."""
        found = self.matches(text)
        parts = list(map(self.words.get, found))
        if None in parts:
            word = self._word
            parts = [word(w) if p is None else p for p, w in zip(parts, found, strict=True)]
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<i4").tolist()

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.machine.bytes_of.__getitem__, ids))

    def decode_stream(self, ids, at_once: int = 8192):
        """Pieces of text, each as soon as its characters are complete."""
        stream = Utf8Stream()
        for i in range(0, len(ids), at_once):
            if piece := stream.push(self.decode_bytes(ids[i : i + at_once])):
                yield piece
        if piece := stream.close():
            yield piece


def codec(path: str) -> Codec:
    """The worker's codec; `path` must be readable on every worker."""
    return held(("codec", path), lambda: Codec(read_ranks(path)))


def default_vocabulary() -> str:
    return public_tokenizers.path(VOCABULARY)


def encode_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded) for each row of docs(doc_id, text); decoded is the text that the ids stream back to."""
    prepare(docs.sparkSession)
    path = path or default_vocabulary()

    def batches(stream):
        c = codec(path)
        for b in stream:
            packed = [c.encode_packed(t) if t else b"" for t in b.column("text").to_pylist()]
            back = ["".join(c.decode_stream(np.frombuffer(x, "<i4").tolist())) for x in packed]
            sizes = np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed))
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            ids = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(packed), "<i4"))
            yield pa.record_batch([b.column("doc_id"), ids, pa.array(sizes), pa.array(back, pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(batches, "doc_id long, ids array<int>, n_tokens long, decoded string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, with digests of the ids and of the bytes that they decode to."""
    out = encode_table(table(spark, sf_dir, "documents"))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", "n_tokens", F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
