"""Byte-level BPE as a tokenization automaton.

The merges are compiled in two steps.

1. Merge gadgets, one after another, build a deterministic automaton over
   tokens that accepts exactly the token sequences BPE yields. It starts as one
   state with a loop for each byte. The gadget of the merge (u, v)

   * splits the state behind u: its copy has no arc v, as u v is now merged;
   * adds an arc uv wherever an arc u leaves whose end has an arc v.

   So the state behind a token depends on that token alone. An arc table for
   50,000 tokens would have 2.5 billion entries; a gadget stores what it
   changes, and all else defaults to the state that it split: arc() follows
   those defaults.
2. That automaton is composed with the trie of the tokens' bytes, and the
   result made deterministic: a state is the longest suffix of the input that
   some token begins with, and, for it and each shorter such suffix, the state
   of step 1 at which it begins. As each prefix of a BPE sequence is the BPE
   sequence of its own bytes, one token ends the sequence at any byte: it is
   the label of the state reached. States and arcs are made when first met
   (there are far more than any corpus meets) and kept in one table of at most
   MAX_ARCS arcs, which starts anew when full.

Encoding a pre-split word takes one transition per byte, and none is ever
undone; the labels of the states passed, read from the word's end backwards,
are its tokens. Decoding emits arc labels.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, memo, only

#: Bytes of words kept with their tokens in each Python worker: so many of late, and as many before that; words met again are carried over.
MEMO_BYTES = 32_000_000
#: What a kept word takes beside its own bytes and labels; words longer than this many bytes aren't kept.
WORD_BYTES, LONGEST_WORD = 260, 64
#: Transitions kept: some 250 bytes each with the states they lead to.
MAX_ARCS = 320_000

#: Bytes of a word beyond which the bound is looked at inside it: fewer make no more arcs than that.
LONG_PATH = 4096
#: Instead of the token before a suffix: any token may come next, or none. Told apart where at most FEW tokens go on from the suffix.
FREE, DEAD, FEW = -1, -2, 24
#: Pairs of tokens kept with whether the token automaton has the arc.
MEMO_PAIRS = 100_000
#: The pre-tokenizer's pattern for byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself where printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class State(dict):
    """A state of the byte automaton: next state by byte, made when first asked for; the token that ends there and its length in bytes."""

    __slots__ = ("begins", "last", "of", "size")

    def __init__(self, of: Automaton, begins: tuple[int, ...], last: int, size: int):
        self.of, self.begins, self.last, self.size = of, begins, last, size

    def __missing__(self, byte: int) -> State:
        return self.of.compile(self, byte)


class Automaton:
    """vocab: token bytes -> id; merges: pairs of token bytes in order of rank. Every byte must be a token."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], max_arcs: int = MAX_ARCS):
        self.labels = {i: t for t, i in vocab.items()}
        self.by_bytes: dict[bytes, int] = {}
        self.born: dict[int, int] = {}  # the gadget that made a token's arc; -1: a byte
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.removed: dict[tuple[int, int], int] = {}  # (state, arc) -> the gadget that removed it
        self.known: dict[int, bool] = memo({})
        self.max_arcs = max_arcs
        for b in range(256):
            t = vocab[bytes([b])]
            self.born[t], self.by_bytes[bytes([b])] = -1, t
        for k, (u, v) in enumerate(merges):
            self.gadget(k, vocab[u], vocab[v], vocab[u + v], u + v)
        self._trie()
        self.states: dict[tuple[int, ...], State] = memo({})
        self.clear()

    def gadget(self, k: int, u: int, v: int, uv: int, label: bytes) -> None:
        if u not in self.born or v not in self.born:  # a part that no text ever reaches
            return
        there = self.arc(u, v, k)
        self.removed.setdefault((u, v), k)
        if there and uv not in self.born:  # a second way to the same token only removes an arc
            self.born[uv], self.left[uv], self.right[uv], self.by_bytes[label] = k, u, v, uv

    def arc(self, state: int, token: int, until: int = 1 << 60) -> bool:
        """Whether, after the gadgets before until, the state behind a token has an arc for another: the younger of the two defaults to what it was made from."""
        born, removed = self.born, self.removed
        while True:
            if removed.get((state, token), until) < until:
                return False
            a, b = born[state], born[token]
            if a < 0 and b < 0:
                return True
            # Before gadget a the state behind it was that behind its right part; after gadget b its arc is where its left part's is.
            if a > b:
                until, state = min(until, a), self.right[state]
            else:
                until, token = min(until, b + 1), self.left[token]

    def follows(self, state: int, token: int) -> bool:
        pair = state << 32 | token
        if (found := self.known.get(pair)) is None:
            if len(self.known) >= MEMO_PAIRS:
                self.known.clear()
            self.known[pair] = found = self.arc(state, token)
        return found

    def _trie(self) -> None:
        """The trie of the tokens' bytes: its arcs, and for each node its depth, token (-1: none), parent, itself and its suffixes that are nodes too (longest first, the root last), and the tokens below it (None: more than FEW)."""
        down: dict[int, int] = {}
        depth, token, parent = [0], [-1], [0]
        for label, t in sorted(self.by_bytes.items()):
            at = 0
            for b in label:
                if (to := down.get(at << 8 | b)) is None:
                    down[at << 8 | b] = to = len(depth)
                    depth.append(depth[at] + 1)
                    token.append(-1)
                    parent.append(at)
                at = to
            token[at] = t
        fail = [0] * len(depth)
        for key, to in sorted(down.items(), key=lambda x: depth[x[1]]):
            at, b = key >> 8, key & 255
            if at:
                f = fail[at]
                while f and (f << 8 | b) not in down:
                    f = fail[f]
                fail[to] = down.get(f << 8 | b, 0)
        under: list[tuple[int, ...] | None] = [()] * len(depth)
        for to in sorted(range(1, len(depth)), key=lambda n: -depth[n]):
            own, over = under[to], under[parent[to]]
            if own is None or over is None:
                under[parent[to]] = None
            else:
                both = (*over, *own, *([token[to]] if token[to] >= 0 else []))
                under[parent[to]] = both if len(both) <= FEW else None
        suffixes: list[tuple[int, ...]] = [(0,)] * len(depth)
        for to in sorted(range(1, len(depth)), key=depth.__getitem__):
            suffixes[to] = (to, *suffixes[fail[to]])
        self.down, self.depth, self.token, self.fail, self.parent, self.below, self.suffixes = down, depth, token, fail, parent, under, suffixes

    def clear(self) -> None:
        """Back to the start state alone: its node is the root, and no token comes before it."""
        self.states.clear()
        self.start = self.states[0, -1] = State(self, (0, -1), -1, 0)
        self.arcs = 0

    def compile(self, state: State, byte: int) -> State:
        """The transition, made and entered in the table.

        A state's begins are its node, then the token before each suffix that
        is a node, longest first, last of all the one before the empty suffix.
        """
        token, down, known, below = self.token, self.down, self.known, self.below
        node, *befores = state.begins
        before = dict(zip(self.suffixes[node], befores, strict=True))
        while node and (node << 8 | byte) not in down:
            node = self.fail[node]
        node = down[node << 8 | byte]
        last, begins = -1, [node]
        for at in self.suffixes[node]:
            if not at:
                break
            x = before[self.parent[at]]
            if last < 0 and x != DEAD and (t := token[at]) >= 0 and (x < 0 or (known.get(x << 32 | t) or self.follows(x, t))):
                last, size = t, self.depth[at]
            if x >= 0 and (ts := below[at]) is not None:
                n = 0
                for t in ts:
                    n += known[x << 32 | t] if x << 32 | t in known else self.follows(x, t)
                x = FREE if n == len(ts) else x if n else DEAD
            begins.append(x)
        begins.append(last)
        key = tuple(begins)
        if (to := self.states.get(key)) is None:
            self.states[key] = to = State(self, key, last, size)
        state[byte] = to
        self.arcs += 1
        return to

    def run(self, word: bytes) -> list[State]:
        """The states behind each byte of word: one transition a byte."""
        if self.arcs > self.max_arcs:
            self.clear()
        state, path = self.start, []
        for b in word:
            state = state[b]
            path.append(state)
        return path

    def encode_word(self, word: bytes) -> list[int]:
        """The labels on the automaton's only path over word."""
        if len(word) > LONG_PATH:
            return self.encode_long(word)
        path, out, at = self.run(word), [], len(word) - 1
        while at >= 0:
            s = path[at]
            out.append(s.last)
            at -= s.size
        out.reverse()
        return out

    def encode_long(self, word: bytes) -> list[int]:
        """The same for a word of any length: of the path only tokens and their sizes are kept, and the table starts anew inside the word when it is full."""
        last, size, state = array("i"), array("i"), self.start
        for b in word:
            if self.arcs > self.max_arcs:
                state = self.restarted(state)
            state = state[b]
            last.append(state.last)
            size.append(state.size)
        out, at = [], len(word) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def restarted(self, state: State) -> State:
        """The table emptied but for a state, whose transitions are to be made anew."""
        begins, last, size = state.begins, state.last, state.size
        for s in self.states.values():  # states point to each other: what is dropped shall go at once
            s.clear()
        self.clear()
        if begins != self.start.begins:
            state = self.states[begins] = State(self, begins, last, size)
            return state
        return self.start

    def decode(self, ids) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class Tokenizer:
    """An automaton with its pre-tokenizer and added tokens, from a tokenizers JSON file of byte-level BPE."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model, pre = j["model"], j["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or j["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"{path}: a byte-level BPE without normalizer, prefix space or ignored merges is needed")
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        added = {t["content"]: t["id"] for t in j["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in j["added_tokens"]):
            raise ValueError(f"{path}: added tokens that strip or need word bounds aren't supported")
        vocab = {raw(t): i for t, i in model["vocab"].items() if t not in added}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.automaton = Automaton(vocab, [(raw(a), raw(b)) for a, b in pairs])
        self.automaton.labels |= {i: t.encode() for t, i in added.items()}
        self.added = added
        self.digits = {i: str(i) for i in self.automaton.labels}
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None
        self.memo: dict[str, tuple[str, bytes]] = memo({})
        self.older: dict[str, tuple[str, bytes]] = memo({})
        self.kept = 0

    def word(self, w: str) -> tuple[str, bytes]:
        """(the tokens' ids joined by commas, the arc labels that they emit)."""
        if (out := self.older.get(w)) is None:
            ids = self.automaton.encode_word(w.encode())
            out = (",".join([self.digits[i] for i in ids]), self.automaton.decode(ids))
        if len(out[1]) > LONGEST_WORD:
            return out
        if self.kept > MEMO_BYTES:
            self.older.clear()
            self.memo, self.older, self.kept = self.older, self.memo, 0
        self.memo[w] = out
        self.kept += WORD_BYTES + 4 * len(out[1])
        return out

    def fresh(self) -> None:
        """Takes note of tables that another operator of this worker has emptied."""
        if not self.memo:
            self.kept = 0
        if not self.automaton.states:
            self.automaton.clear()

    def pieces(self, text: str) -> list[tuple[str, bytes]]:
        parts = self.special(text) if self.special and any(t in text for t in self.added) else [text]
        out, get, word = [], self.memo.get, self.word
        for p in parts:
            if p in self.added:
                out.append((str(self.added[p]), p.encode()))
            else:
                out += [get(w) or word(w) for w in self.split(p)]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.pieces(text) for i in p[0].split(",")]

    def decode(self, ids) -> str:
        return self.automaton.decode(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _digests(path: str):
    def run(batches):
        from hashlib import sha256

        import pyarrow as pa

        t = tokenizer(path)
        claim(t.memo, t.older, t.automaton.known, t.automaton.states)
        t.fresh()
        for batch in batches:
            n, ids, back = [], [], []
            for text in batch.column(1).to_pylist():
                p = t.pieces(text or "")
                joined = ",".join([x[0] for x in p])
                n.append(joined.count(",") + 1 if p else 0)
                ids.append(sha256(joined.encode()).hexdigest())
                back.append(sha256(b"".join([x[1] for x in p]).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, encoded and decoded again.

    A null text counts as empty: no tokens, digests of the empty string. Rows
    are treated one by one, so repeated ids and texts give repeated rows, an
    empty table gives none, and other columns are not looked at. path is the
    vocabulary file, at the same place on every executor.
    """
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encode(path: str):
    def run(batches):
        import pyarrow as pa

        t = tokenizer(path)
        claim(t.memo, t.older, t.automaton.known, t.automaton.states)
        t.fresh()
        for batch in batches:
            ids = [None if x is None else t.encode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches):
        import pyarrow as pa

        t = tokenizer(path)
        claim(t.memo, t.older, t.automaton.known, t.automaton.states)
        t.fresh()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else t.decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) of each whole text; null for a null text, an empty array for an empty one."""
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text of each row's ids; invalid UTF-8 becomes U+FFFD; an id outside the vocabulary raises."""
    return only(tokens, "doc_id", "ids").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(path), "doc_id long, text string")
