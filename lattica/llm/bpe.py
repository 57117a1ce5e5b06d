"""BPE encoding and decoding by a tokenization automaton.

A merge list fixes one correct tokenization of every word. The automaton here reads tokens and accepts exactly the
correct sequences. It starts as one state that loops on every single byte. Each merge (u, v) -> w then applies a gadget:
where u leads into a state that goes on with v, that state gets a copy without v as the new target of u, and every state
that has u gets an arc w, which leads where v led. (Berglund, Martens and van der Merwe, 2024, "Constructing a BPE
Tokenization DFA".) All arcs of one label lead to one state, so the tables hold one target for each token and, for each
state, the state that it copies and the label that it lost; whether a state has an arc is worked out from these and kept.

Every prefix of a word has one accepted path too, so the automaton composed with the spelling of its labels can be made
deterministic over bytes. That table is worked out as its states come up and kept in bounds; encoding a word is one look-up
for each byte, then a walk back over the tokens.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, blank_if_null, table

#: White space of Unicode, fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Chunks kept with their ids in each Python worker, and tokens of these; a full table is emptied, so memory is bounded.
CACHE_CHUNKS, CACHE_IDS = 200_000, 4_000_000
#: States of the byte table kept in each Python worker; it starts anew beyond them.
TABLE_STATES = 120_000
#: The byte table's rows grow by so many.
ROWS = 1 << 14
#: Longer chunks are encoded one by one and not kept.
CACHE_CHARS = 64
#: Words that walk the byte table together, and characters of texts that are encoded together.
ABREAST, TOGETHER = 4096, 1 << 20
#: Columns of the byte table grow by so many when bytes come up that it has none for.
COLUMNS = 16
#: Settings of a vocabulary file that this reading of it holds for.
READ = {"normalizer": None, "ignore_merges": False, "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "fuse_unk": False}


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    spare = 256
    for b in range(256):
        if b not in plain:
            out[chr(spare)] = b
            spare += 1
    return out


class Automaton:
    """Tables of the tokenization automaton of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._known(spec)
        model, letters = spec["model"], byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        self.labels: dict[int, bytes] = {i: spell(s) for s, i in model["vocab"].items()}
        self.ids: dict[bytes, int] = {b: i for i, b in self.labels.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels |= {i: s.encode() for s, i in self.added.items()}
        self.sizes = array("i", [len(self.labels.get(i, b"")) for i in range(max(self.labels) + 1)])
        self.trie: dict[int, int] = {}
        self.node_token, self.node_inner = array("i", [-1]), bytearray(1)
        for b, i in self.ids.items():
            node = 0
            for byte in b:
                self.node_inner[node] = 1
                below = self.trie.setdefault((node << 8) | byte, len(self.node_token))
                if below == len(self.node_token):
                    self.node_token.append(-1)
                    self.node_inner.append(0)
                node = below
            self.node_token[node] = i
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        vocab = model["vocab"]
        self._build([(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs])

    @staticmethod
    def _known(spec: dict) -> None:
        """Raises if the file asks for anything but byte-level BPE with the usual split and added tokens that are taken as they stand."""
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k, v in READ.items() if (spec if k == "normalizer" else model).get(k) not in (v, None, "", False)]
        if model.get("type", "BPE") != "BPE":
            odd.append("type")
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            odd.append("pre_tokenizer")
        odd += [f"added token {t['content']!r}" for t in spec.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
        if odd:
            raise ValueError(f"no reading of this vocabulary: {', '.join(odd)}")

    def _build(self, merges: list[tuple[int, int, int]]) -> None:
        size = max(self.labels) + 1
        self.target = array("i", [0]) * size  # the state that each label leads to
        self.born = array("i", [-1]) * size  # the merge that made a token: -1 at first, -2 for labels without arcs
        self.left = array("i", [0]) * size
        self.copied, self.lost, self.made = array("i", [-1]), array("i", [-1]), array("i", [-1])  # by state
        for i, b in self.labels.items():
            self.born[i] = -1 if len(b) == 1 else -2
        for k, (u, v, w) in enumerate(merges):
            after_u, after_v = self.target[u], self.target[v]
            if self.born[u] == -2 or self.born[v] == -2 or self.born[w] != -2 or not self._slow(after_u, v):
                continue  # no path runs u, v any more: the gadget changes nothing
            self.copied.append(after_u)
            self.lost.append(v)
            self.made.append(k)
            self.target[u] = len(self.copied) - 1
            self.target[w] = after_v
            self.born[w], self.left[w] = k, u
            if u == v:  # after w the state from before the split goes on
                self.target[w] = after_u
        self._seek()
        self._arcs: dict[int, bool] = {}
        self._reset()

    def _seek(self) -> None:
        """Numbers the states so that those below one in the tree of copies are a range: a label is lost on at most one of the states above any state, so a search among the ranges that lost it decides."""
        below: list[list[int]] = [[] for _ in self.copied]
        for s in range(1, len(self.copied)):
            below[self.copied[s]].append(s)
        self.enter, leave, clock, stack = array("i", [0]) * len(self.copied), array("i", [0]) * len(self.copied), 0, [0]
        while stack:
            s = stack.pop()
            if s < 0:
                leave[~s] = clock
                continue
            self.enter[s] = clock
            clock += 1
            stack.append(~s)
            stack.extend(below[s])
        losers: dict[int, list[int]] = {}
        for s in sorted(range(1, len(self.copied)), key=self.enter.__getitem__):
            losers.setdefault(self.lost[s], []).append(s)
        self.lost_at = {t: (array("i", map(self.enter.__getitem__, states)), array("i", map(leave.__getitem__, states)), array("i", map(self.made.__getitem__, states))) for t, states in losers.items()}

    def _slow(self, state: int, token: int) -> bool:
        """has(), as long as states are still being added: up the copies one by one."""
        while True:
            if self.born[token] == -2:
                return False
            if state == 0 and self.born[token] == -1:
                return True
            if self.born[token] >= self.made[state]:
                token = self.left[token]  # the arc came after the state did, where the state had the left part
            elif token == self.lost[state]:
                return False
            else:
                state = self.copied[state]

    def has(self, state: int, token: int) -> bool:
        """Whether the state has an arc for the token: neither it nor a left part of it was lost before the larger token was made."""
        key = (state << 20) | token
        known = self._arcs.get(key)
        if known is not None:
            return known
        place, before, found = self.enter[state], 1 << 30, self.born[token] != -2
        while found:
            if lost := self.lost_at.get(token):
                enters, leaves, made = lost
                i = bisect_right(enters, place) - 1
                if i >= 0 and place < leaves[i] and made[i] <= before:
                    found = False
                    break
            before = self.born[token]
            if before == -1:
                break
            token = self.left[token]
        if len(self._arcs) > 300_000:
            self._arcs.clear()
        self._arcs[key] = found
        return found

    def _reset(self) -> None:
        self._live: list[bytes] = [array("i", [-1, 0, 0]).tobytes()]  # by state: the token that ends the path, then places of two numbers each; as bytes, which take a fraction of the room of tuples
        self._number: dict[bytes, int] = {}
        self._column = np.full(256, -1, np.int16)  # of a byte in the table; -1 if it hasn't come up
        self._columns = 0
        self._table = np.full((ROWS, COLUMNS), -1, np.int32)  # the state after one more byte; -1 if it isn't known yet
        self._last = np.full(ROWS, -1, np.int32)

    def _column_of(self, byte: int) -> int:
        if self._column[byte] < 0:
            if self._columns == self._table.shape[1]:
                self._table = np.concatenate([self._table, np.full((len(self._table), COLUMNS), -1, np.int32)], axis=1)
            self._column[byte] = self._columns
            self._columns += 1
        return int(self._column[byte])

    def _step(self, at: int, byte: int) -> int:
        """The state of the byte table after one more byte, worked out at its first use.

        A state of the byte table holds the places where a token may have begun, each as the spelling since then and the
        automaton's state before it, and the token that ends the one accepted path so far.
        """
        trie, live, last, places = self.trie, array("i", [-1]), -1, array("i", self._live[at])
        for i in range(1, len(places), 2):
            node, state = places[i], places[i + 1]
            below = trie.get((node << 8) | byte)
            if below is None:
                continue
            token = self.node_token[below]
            if token >= 0 and last < 0 and self.has(state, token):
                last = token
            if self.node_inner[below]:
                live.append(below)
                live.append(state)
        if last < 0:
            raise ValueError("the vocabulary does not cover every byte")
        live.append(0)
        live.append(self.target[last])
        live[0] = last
        key = live.tobytes()
        to = self._number.get(key)
        if to is None:
            to = self._number[key] = len(self._live)
            self._live.append(key)
            if to == len(self._last):
                self._table = np.concatenate([self._table, np.full((ROWS, self._table.shape[1]), -1, np.int32)])
                self._last = np.concatenate([self._last, np.full(ROWS, -1, np.int32)])
            self._last[to] = last
        self._table[at, self._column_of(byte)] = to
        return to

    def spell(self, word: bytes) -> list[int]:
        """The ids on the accepted path that spells a word of any length: forward through the byte table, then back by the tokens' lengths."""
        if len(self._live) > TABLE_STATES:
            self._reset()
        sizes, at, ends = self.sizes, 0, array("i")
        for byte in word:
            column = self._column[byte]
            to = self._table[at, column] if column >= 0 else -1
            at = int(to) if to >= 0 else self._step(at, byte)
            ends.append(int(self._last[at]))
            if len(self._live) > 2 * TABLE_STATES:  # a very long word: start a new table from where it is
                key, last = self._live[at], self._last[at]
                self._reset()
                self._live.append(key)
                self._last[1] = last
                self._number[key] = at = 1
        out, place = [], len(word)
        while place:
            token = ends[place - 1]
            out.append(token)
            place -= sizes[token]
        out.reverse()
        return out

    def spell_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and how many each has: as spell(), but the words, which are short, walk the table side by side."""
        parts = [self._abreast(words[at : at + ABREAST]) for at in range(0, len(words), ABREAST)]
        return (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.uint32, np.int64)))

    def _abreast(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self._live) > TABLE_STATES:
            self._reset()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        width = int(lengths.max(initial=0))
        letters = np.zeros((len(words), width), np.uint8)
        letters[np.arange(width)[None, :] < lengths[:, None]] = np.frombuffer(b"".join([words[i] for i in order]), np.uint8)
        for byte in np.unique(letters):
            self._column_of(int(byte))
        state, ends = np.zeros(len(words), np.int64), np.zeros((len(words), width), np.int32)
        for i in range(width):
            n = int(np.searchsorted(-lengths, -i))  # words that are longer than i
            at, byte = state[:n], letters[:n, i]
            to = self._table[at, self._column[byte]]
            if (unknown := np.nonzero(to < 0)[0]).size:
                pairs, back = np.unique(at[unknown] << 8 | byte[unknown], return_inverse=True)
                found = [self._step(int(p) >> 8, int(p) & 255) for p in pairs]
                to[unknown] = np.array(found, np.int32)[back]
            state[:n] = to
            ends[:n, i] = self._last[to]
        sizes, place, turns = np.frombuffer(self.sizes, np.int32), lengths.copy(), []
        rows = np.arange(len(words))
        while rows.size:
            tokens = ends[rows, place[rows] - 1]
            turns.append((rows, tokens))
            place[rows] -= sizes[tokens]
            rows = rows[place[rows] > 0]
        counts = np.zeros(len(words), np.int64)
        for rows, _ in turns:
            counts[rows] += 1
        own = np.empty(len(words), np.int64)
        own[order] = counts
        starts = (np.cumsum(own) - own)[order]
        out = np.empty(int(own.sum()), np.uint32)
        for k, (rows, tokens) in enumerate(turns):  # from the last token of each word to its first
            out[starts[rows] + counts[rows] - 1 - k] = tokens
        return out, own


class Splitter:
    """Pre-tokenization: contractions, runs of letters, of numerals and of other marks, each with one blank before it, and runs of white space."""

    def __init__(self):
        s = re.escape(SPACE)
        self.whole = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{s}\p{{L}}\p{{N}}]+|[{s}]+(?![^{s}])|[{s}]+")
        self.inner = re.compile(rf" (?=[^{s}])")

    def chunks(self, text: str) -> list[str]:
        """Pieces that end where pieces of the pre-tokenization end; a blank before a mark that isn't white always begins one."""
        parts = self.inner.split(text)
        return parts[:1] * bool(parts[0]) + [" " + p for p in parts[1:]]


class _Rows(dict):
    """Row numbers of chunks; a new chunk gets the next one."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = row = len(self)
        self.new.append(chunk)
        return row


class Codec:
    """Encoder and decoder over one automaton, with a bounded table of chunks that it has seen."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.splitter = automaton, Splitter()
        self._clear()
        self.stops = re.compile("(" + "|".join(map(re.escape, sorted(automaton.added, key=len, reverse=True))) + ")") if automaton.added else None
        size = max(automaton.labels) + 1
        self.arc_labels = [automaton.labels.get(i, b"") for i in range(size)]

    def _clear(self) -> None:
        self.rows = _Rows()
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _words(self, chunk: str) -> list[bytes]:
        bare = chunk[1:] if chunk[:1] == " " else chunk
        return [chunk.encode()] if bare.isalpha() else [w.encode() for w in self.splitter.whole.findall(chunk)]

    def _add(self) -> None:
        """Ids of the new chunks, in a table where each chunk has a start and a count."""
        words = [self._words(c) for c in self.rows.new]
        self.rows.new = []
        ids, each = self.automaton.spell_all([w for own in words for w in own])
        upto = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        ends = upto[ends]
        counts = np.diff(ends, prepend=0)
        self.starts = np.concatenate([self.starts, len(self.ids) + ends - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])

    def _plain(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of each piece of text."""
        if len(self.rows) >= CACHE_CHUNKS or len(self.ids) >= CACHE_IDS:
            self._clear()
        split = [self.splitter.chunks(p) for p in pieces]
        long = {c for own in split for c in own if len(c) > CACHE_CHARS}
        if long:
            return [self._mixed(own, long) for own in split]
        return self._gathered(split)

    def _gathered(self, split: list[list[str]]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        rows = np.fromiter(map(self.rows.__getitem__, (c for own in split for c in own)), np.int64, int(sizes.sum()))
        if self.rows.new:
            self._add()
        counts = self.counts[rows]
        before = np.concatenate([[0], np.cumsum(counts)])
        all_ids = self.ids[np.repeat(self.starts[rows] - before[:-1], counts) + np.arange(before[-1])]
        ends = before[np.cumsum(sizes)]
        return np.split(all_ids, ends[:-1])

    def _mixed(self, chunks: list[str], long: set[str]) -> np.ndarray:
        """Ids of a text with chunks that are too long to keep, between runs of others."""
        out, run = [], []
        for c in chunks:
            if c in long:
                out += self._gathered([run]) + [np.array(self.automaton.spell(w), np.uint32) for w in self._words(c)]
                run = []
            else:
                run.append(c)
        return np.concatenate(out + self._gathered([run]))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. Strings of added tokens become their ids."""
        pieces, marks = [], []  # all pieces between added tokens; for each text (numbers of its pieces, or ids of added tokens as bytes)
        for text in texts:
            parts = [text] if self.stops is None or not any(s in text for s in self.automaton.added) else self.stops.split(text)
            own = []
            for part in parts:
                if len(parts) > 1 and part in self.automaton.added:
                    own.append(self.automaton.added[part].to_bytes(4, "little"))
                else:
                    own.append(len(pieces))
                    pieces.append(part)
            marks.append(own)
        found = [x.astype("<u4", copy=False).tobytes() for x in self._plain(pieces)]
        return [b"".join([x if isinstance(x, bytes) else found[x] for x in own]) for own in marks]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The labels along the ids' arcs, as text."""
        numbers = array("I", ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        return b"".join(map(self.arc_labels.__getitem__, numbers)).decode("utf-8", "replace")


def together(column) -> Iterator[list[str]]:
    """The texts of a column in lists of about TOGETHER characters."""
    held, size = [], 0
    for x in column:
        held.append(x.as_py())
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


_codecs: dict[str, Codec] = {}


def codec(automaton: Automaton, key: str) -> Codec:
    """One codec for each Python worker and vocabulary, so that its chunks serve all tasks there."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(automaton)
    return _codecs[key]


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: list[str] | None = None, outputs: tuple[str, ...] = ("token_ids", "n_tokens")) -> DataFrame:
    """Tokens of every whole text.

    outputs: any of token_ids (binary: little-endian unsigned 32-bit integers), n_tokens, decoded (the text that the ids
    spell), ids_sha256 and decoded_sha256 (hex digests of the two). keep: columns of docs to carry along; one that has
    an output's name gives way to it. A null text counts as empty and gives no tokens; rows keep their number, repeated
    rows are encoded alike, and an empty table gives an empty one. No shuffle; the automaton, whose size the vocabulary
    bounds, is broadcast.
    """
    spark = docs.sparkSession
    shared, wanted = spark.sparkContext.broadcast(Automaton(vocabulary)), tuple(outputs)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in wanted]
    kinds = {"token_ids": "binary", "n_tokens": "long", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    source = docs.select(*(F.col(f"`{c}`") for c in kept), blank_if_null(F.col(f"`{text_col}`")).alias("__text"))
    schema = source.select(*(F.col(f"`{c}`") for c in kept)).schema
    for c in wanted:
        schema = schema.add(c, kinds[c])

    def step(cols: dict, rows: int) -> dict:
        tool = codec(shared.value, vocabulary)
        out: dict[str, list] = {c: [] for c in wanted}
        for texts in together(cols["__text"]):
            for ids in tool.encode_all(texts):
                text = tool.decode(ids) if "decoded" in out or "decoded_sha256" in out else ""
                for c in out:
                    out[c].append(len(ids) // 4 if c == "n_tokens" else ids if c == "token_ids" else text if c == "decoded" else hashlib.sha256(ids if c == "ids_sha256" else text.encode()).hexdigest())
        return {c: cols[c] for c in kept} | out

    return source.mapInArrow(batches(step, schema), schema)


def decode(tokens: DataFrame, vocabulary: str, ids_col: str = "token_ids", to: str = "decoded") -> DataFrame:
    """The texts that binary ids spell, beside the other columns; null ids give an empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(Automaton(vocabulary))
    others = [c for c in tokens.columns if c != to]
    schema = tokens.select(*(F.col(f"`{c}`") for c in others)).schema.add(to, "string")

    def step(cols: dict, rows: int) -> dict:
        tool = codec(shared.value, vocabulary)
        return {c: cols[c] for c in others} | {to: [tool.decode(x.as_py() or b"") for x in cols[ids_col]]}

    return tokens.select(*(F.col(f"`{c}`") for c in others)).mapInArrow(batches(step, schema), schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op7_bpe_codec(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text that they decode to."""
    docs = table(spark, sf_dir, "documents")
    return encode(docs, default_vocabulary(), keep=["doc_id"], outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
