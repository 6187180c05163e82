"""Byte-level BPE by a tokenization automaton.

Merges are compiled, in order, into a deterministic automaton over tokens that accepts exactly the proper tokenizations (after
Berglund, Martens and van der Merwe, "Constructing a BPE tokenization DFA", 2024). All arcs with one label lead to one state,
so a state is named by the token that leads to it. The gadget of the merge (u, v) -> w does three things:

* it cuts the arc v from the state of u: those two tokens no longer stand side by side;
* it adds the arc w to each state that has the arc u just then, and the state of u itself if u isn't v (of three equal tokens
  the first two merge);
* it makes the state of w a copy of the state of v as it is just then.

States are kept as versions that share what they inherit: the gadgets' order numbers say which arcs an older version had, and an
arc is looked up by going back through the gadgets until both tokens are single bytes. Looked-up arcs are kept in a table.

A pre-split word has one accepting path. Its arcs are found by a second table, the trie of the arc labels: its transitions give
the tokens that start at a place, and the automaton admits those that may follow the token that ends there. Each place is
entered and left once at most, so time is linear in the word's length. Decoding emits the labels of the arcs.

Rows: a null text counts as empty, and an empty text gives no tokens. Equal rows each give a row.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from orebed.llm.frames import map_columns, pick

#: Fixed value: the pattern that splits a text into words before merges apply.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The vocabulary file goes to every executor; larger files are refused.
MAX_FILE_BYTES = 64 << 20
#: Words whose tokens a worker keeps in each of two generations, and the longest of them.
KEPT_WORDS, KEPT_CHARS = 250_000, 64
#: Arcs whose look-up a worker keeps.
KEPT_ARCS = 1_000_000


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """labels: each token's bytes. merges: pairs of tokens, in order. ids: what each token is called outside."""

    START = -1

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int]]) -> None:
        self.labels = labels
        made = {label: token for token, label in enumerate(labels)}
        self.cut: dict[tuple[int, int], int] = {}
        self.born = [-1] * len(labels)
        self.parts: list[tuple[int, int] | None] = [None] * len(labels)
        for order, (u, v) in enumerate(merges):
            w = made[labels[u] + labels[v]]
            if self.parts[w] is not None or (u, v) in self.cut:
                raise ValueError("two merges make the same token")
            self.cut[u, v] = order
            self.born[w], self.parts[w] = order, (u, v)
        self.arcs: dict[tuple[int, int], bool] = {}
        self.next: dict[int, int] = {}
        self.ends = [-1]
        reachable = [t for t, label in enumerate(labels) if self.parts[t] is not None or len(label) == 1]
        for token in reachable:
            node = 0
            for byte in labels[token]:
                to = self.next.get(node << 8 | byte)
                if to is None:
                    to = self.next[node << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                node = to
            self.ends[node] = token
        self.sizes = list(map(len, labels))
        self.shorter = [-1] * len(labels)  # the longest other token that a token starts with
        for token in reachable:
            node = 0
            for byte in labels[token][:-1]:
                node = self.next[node << 8 | byte]
                if self.ends[node] >= 0:
                    self.shorter[token] = self.ends[node]

    def arc(self, state: int, token: int) -> bool:
        """Whether the token may follow the one that names the state."""
        known = self.arcs.get((state, token))
        if known is None:
            if len(self.arcs) >= KEPT_ARCS:
                self.arcs.clear()
            known = self.arcs[state, token] = self._look_up(state, token)
        return known

    def _look_up(self, s: int, t: int) -> bool:
        before = len(self.cut)
        while True:
            if self.cut.get((s, t), before) < before:
                return False
            old, new = self.born[s], self.born[t]
            if old < 0 and new < 0:
                return True
            if new > old:  # the state got this arc where it had the arc of the token's first part
                before, t = new + 1, self.parts[t][0]
            elif old > new:  # the state began as a copy of the state of its second part
                before, s = old, self.parts[s][1]
            else:  # a token after itself: both of these at once
                before, (t, s) = old, self.parts[s]

    def _longest(self, word: bytes, at: int) -> int:
        """The longest arc label that starts there."""
        step, ends, node, found = self.next.get, self.ends, 0, -1
        for i in range(at, len(word)):
            node = step(node << 8 | word[i])
            if node is None:
                break
            if ends[node] >= 0:
                found = ends[node]
        return found

    def path(self, word: bytes) -> list[int]:
        """The tokens of a word.

        The longest arc is tried first, then shorter ones; where none leads on, the last arc is taken back. A place that was
        left so is never entered again: the accepted path to a place is the only one.
        """
        n, at, out, dead = len(word), 0, [], set()
        arcs, sizes, state = self.arcs, self.sizes, self.START
        token = self._longest(word, 0) if n else -1
        while at < n:
            if token < 0:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
                state = out[-1] if out else self.START
                token = self.shorter[token]
                continue
            if at + sizes[token] not in dead and (state < 0 or (arcs[state, token] if (state, token) in arcs else self.arc(state, token))):
                out.append(token)
                state, at = token, at + sizes[token]
                token = self._longest(word, at)
            else:
                token = self.shorter[token]
        return out


class Codec(dict):
    """Encodes and decodes texts; as a dict it keeps the packed ids of words that it has met."""

    def __init__(self, file: bytes) -> None:
        super().__init__()
        told = json.loads(file)
        model, pre = told["model"], told.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or told.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files are read")
        byte = printable_bytes()
        vocab = model["vocab"]
        names = sorted(vocab, key=vocab.get)
        number = {name: i for i, name in enumerate(names)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = Automaton([bytes(byte[c] for c in name) for name in names], [(number[a], number[b]) for a, b in pairs])
        self.ids = [vocab[name] for name in names]
        self.packed = [i.to_bytes(4, "little") for i in self.ids]
        self.older: dict[str, bytes] = {}
        self.added = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.labels = dict(zip(self.ids, self.automaton.labels)) | {i: text.encode() for text, i in self.added.items()}
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            packed = b"".join(map(self.packed.__getitem__, self.automaton.path(word.encode())))
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:  # words in use come back from the older generation
                self.older = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers. An added token's text is that token."""
        if self.cut is None or not (cuts := list(self.cut.finditer(text))):
            return b"".join(map(self.__getitem__, self.split.findall(text)))
        out, at = [], 0
        for m in cuts:
            out += map(self.__getitem__, self.split.findall(text[at : m.start()]))
            out.append(self.added[m[0]].to_bytes(4, "little"))
            at = m.end()
        return b"".join([*out, *map(self.__getitem__, self.split.findall(text[at:]))])

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode(errors="replace")


@lru_cache(2)
def _codec(digest: str, file) -> Codec:
    return Codec(file.value)


class _Shipped:
    """A broadcast vocabulary file that is equal to any other of the same content, so that a worker compiles it once."""

    def __init__(self, spark, file: bytes) -> None:
        self.sent, self.digest = spark.sparkContext.broadcast(file), hashlib.sha256(file).hexdigest()

    value = property(lambda self: self.sent.value)

    def __eq__(self, other) -> bool:
        return self.digest == other.digest

    def __hash__(self) -> int:
        return hash(self.digest)


def shipped_codec(spark, path: str):
    """A function without arguments that gives a worker its codec of the vocabulary file at path (on the driver)."""
    with open(path, "rb") as f:
        file = f.read(MAX_FILE_BYTES + 1)
    if len(file) > MAX_FILE_BYTES:
        raise ValueError(f"{path} has more than {MAX_FILE_BYTES} bytes")
    shipped = _Shipped(spark, file)
    return lambda: _codec(shipped.digest, shipped)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers), decoded (the text that the ids decode to)."""
    codec = shipped_codec(docs.sparkSession, path)

    def run(ids: list, texts: list) -> tuple[list, ...]:
        c = codec()
        packed = [c.encode(t or "") for t in texts]
        return ids, packed, [c.decode(p) for p in packed]

    return map_columns(pick(docs, "doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary, decoded string", rows=128)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode_documents, digested where it is made."""
    codec = shipped_codec(docs.sparkSession, path)

    def run(ids: list, texts: list) -> tuple[list, ...]:
        c = codec()
        out = ids, [], [], []
        for t in texts:
            packed = c.encode(t or "")
            out[1].append(len(packed) // 4)
            out[2].append(hashlib.sha256(packed).hexdigest())
            out[3].append(hashlib.sha256(c.decode(packed).encode()).hexdigest())
        return out

    return map_columns(pick(docs, "doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=128)
