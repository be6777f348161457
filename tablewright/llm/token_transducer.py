"""Operator 7: token counts by a deterministic transducer.

A sequence of pieces is the encoding of its text if and only if each two
neighbours are the encoding of their joined text.  So the last piece after a
character is the one suffix piece that fits the last piece before it, and what
comes later depends on the text read so far only through the places where a
longer piece may still begin and the last piece at each of them.  That is the
state; reading a character leads to the next state and emits the change of the
token count (which is negative where pieces join).  States and transitions are
compiled from the vocabulary when first met and kept.

A chunk of a text is a map from the state before it to the state after it and
the tokens emitted.  At a cut (two characters that no piece holds side by side,
such as a letter and the blank after it) every state leads to the start state,
so a chunk's map is its *head*, the characters up to its first cut, and a
constant for the rest.  A short head is run when maps are composed.  A long one
(a chunk may have no cut at all) is run beforehand from the states that the
characters before the chunk make likely; the map is then a table of these
states, and the head's text is kept for any other state, so counts are exact.
Composing maps is associative; the chunks of a long text are evaluated in
different tasks, and their maps are composed pairwise, level by level: the
up-sweep of a prefix scan, whose work is linear in the text (:func:`prefix_scan`
gives all prefixes).  The maps of short words, between two cuts, are kept in a
memo of bounded size, which outlives the states: these are compiled anew when
there are too many.  The last character of a word needs no state after it.

Defined results: null counts as the empty text, which has no tokens; repeated
rows are counted each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from operator import add

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import stage, text_or_empty
from .piece_bpe import BLANK, SHORT, Vocabulary, vocabulary

CHUNK_CHARS = 65_536
#: States, and last characters of words whose tokens are known.
MAX_STATES = 300_000
MEMO_WORDS = 500_000
#: Characters before a chunk that tell the likely states at its start.
BEFORE = 64


class Transducer:
    """State 0 is the start: nothing read, or a cut before what comes.  Any
    other state is (window, cuts): the longest suffix that may begin a piece or
    its last character, and for each place in it where a piece may begin, and its
    end, the last piece before and the tokens up to there less all tokens."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.begins = {p[:i] for p in vocab.rank for i in range(1, len(p))}
        self.memo: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self._fits: dict[tuple[str, str], bool] = {}
        self.states: list[tuple[str, tuple[tuple[int, str, int], ...]]] = [("", ((0, "", 0),))]
        self.index = {self.states[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.ends: dict[tuple[int, str], int] = {}

    def fits(self, left: str, right: str) -> bool:
        """Whether (left, right), or right alone after a cut, is an encoding."""
        got = self._fits.get((left, right))
        if got is None:
            got = self._fits[left, right] = self.vocab.merge(left + right) == ([left, right] if left else [right])
        return got

    def weight(self, piece: str) -> int:
        return 1 if piece in self.vocab.ids else len(piece.encode())

    def state(self, key: tuple[str, tuple[tuple[int, str, int], ...]]) -> int:
        i = self.index.get(key)
        if i is None:
            i = self.index[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return i

    def read(self, window: str, cuts: tuple[tuple[int, str, int], ...], c: str) -> tuple[str, int]:
        """The last piece after ``c`` and the tokens emitted."""
        end, rank = len(window), self.vocab.rank
        return next((piece, before + self.weight(piece)) for at, left, before in cuts
                    if ((piece := window[at:] + c) in rank or at == end) and self.fits(left, piece))

    def end(self, s: int, c: str) -> int:
        """The tokens that ``c`` emits, where the state after it is not asked for."""
        got = self.moves[s].get(c)
        if got is not None:
            return got[1]
        n = self.ends.get((s, c))
        if n is None:
            window, cuts = self.states[s]
            if window and window[-1] + c not in self.vocab.joined:
                window, cuts = self.states[0]  # a cut: as from the start
            n = self.ends[s, c] = self.read(window, cuts, c)[1]
        return n

    def move(self, s: int, c: str) -> tuple[int, int]:
        """The state after ``c`` and the tokens emitted; compiles the transition."""
        got = self.moves[s].get(c)
        if got is not None:
            return got
        window, cuts = self.states[s]
        if window and window[-1] + c not in self.vocab.joined:
            got = self.move(0, c)  # a cut: as from the start
        else:
            last, emitted = self.read(window, cuts, c)
            grown = window + c
            kept = [(at, left, before - emitted) for at, left, before in cuts if grown[at:] in self.begins]
            shift = min([at for at, *_ in kept], default=len(window))
            kept = [(at - shift, left, before) for at, left, before in kept]
            got = self.state((grown[shift:], (*kept, (len(grown) - shift, last, 0)))), emitted
        self.moves[s][c] = got
        return got

    def run(self, s: int, text: str) -> tuple[int, int]:
        total, moves = 0, self.moves
        for c in text:
            s, n = moves[s].get(c) or self.move(s, c)
            total += n
        return s, total

    def word(self, word: str) -> int:
        """The tokens of a word between two cuts."""
        n = self.memo.get(word)
        if n is None:
            if len(self.states) + len(self.ends) > MAX_STATES:
                self.reset()
            s, n = self.run(0, word[:-1])
            n += self.end(s, word[-1])
            if len(word) <= SHORT:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[word] = n
        return n

    def words(self, words: list[str]) -> int:
        """The tokens of words between cuts."""
        got = list(map(self.memo.get, words))
        if None in got:
            return sum([self.word(w) if n is None else n for w, n in zip(words, got, strict=True)])
        return sum(got)

    def first_cut(self, text: str) -> int:
        """The place of the first cut inside ``text``; its length if there is none."""
        joined = map(self.vocab.joined.__contains__, map(add, text, text[1:]))
        return next((i for i, x in enumerate(joined, 1) if not x), len(text))

    def run_likely(self, before: str, text: str) -> dict[tuple, tuple[tuple, int]]:
        """Where ``text`` leads, and the tokens, from each state that reading the
        end of ``before`` from the start state gives.  States that have met are
        run on as one."""
        entries = {self.run(0, before[i:])[0] for i in range(max(1, len(before) // 2))}
        met = {s: (0, {s: 0}) for s in entries}  # state: tokens, and what its entries have more
        done = 0
        while done < len(text) and len(met) > 1:
            after: dict[int, tuple[int, dict[int, int]]] = {}
            for s, (total, members) in met.items():
                s, n = self.moves[s].get(text[done]) or self.move(s, text[done])
                if s in after:
                    after[s][1].update({e: x + total + n - after[s][0] for e, x in members.items()})
                else:
                    after[s] = (total + n, members)
            met, done = after, done + 1
        out = {}
        for s, (total, members) in met.items():
            last, n = self.run(s, text[done:])
            out.update({self.states[e]: (self.states[last], total + n + x) for e, x in members.items()})
        return out


@dataclass
class ChunkMap:
    """``head`` runs from the state before the chunk; ``tail`` is None if the
    chunk has no cut, else the state at the end and the tokens after the head.
    ``known`` tells for some states before the chunk the state after the head and
    its tokens."""

    head: str
    tail: tuple | None
    tokens: int
    known: dict[tuple, tuple[tuple, int]] = field(default_factory=dict)


def chunk_map(t: Transducer, chunk: str, first: bool, before: str = "") -> ChunkMap:
    """The map of a chunk of normalised text; the first chunk of a text begins
    at the start state, so its head is empty.  ``before`` is text before it."""
    if len(t.states) > MAX_STATES:
        t.reset()
    words = t.vocab.words_of(chunk)
    head, known = "", {}
    if words and not first:
        word = words.pop(0)
        cut = t.first_cut(word)
        head = word[:cut]
        if cut < len(word):
            words.insert(0, word[cut:])
        if len(head) > SHORT:
            known = t.run_likely(before.replace(" ", BLANK), head)
    if not words:
        return ChunkMap(head, None, 0, known)
    last, tokens = t.run(0, words.pop())
    return ChunkMap(head, t.states[last], tokens + t.words(words), known)


def through(t: Transducer, m: ChunkMap, state: tuple) -> tuple[tuple, int]:
    """The state after the head of ``m``, and its tokens, from ``state``."""
    got = m.known.get(state)
    if got is None:
        last, n = t.run(t.state(state), m.head)
        got = t.states[last], n
    return got


def compose(t: Transducer, a: ChunkMap, b: ChunkMap) -> ChunkMap:
    """First ``a``, then ``b``."""
    if a.tail is None:
        known = {}
        for state, (middle, n) in a.known.items():
            if middle in b.known or len(b.head) <= SHORT:
                end, more = through(t, b, middle)
                known[state] = end, n + more
        return ChunkMap(a.head + b.head, b.tail, b.tokens, known)
    last, n = through(t, b, a.tail)
    return ChunkMap(a.head, last if b.tail is None else b.tail, a.tokens + n + b.tokens, a.known)


def whole_map(t: Transducer, maps: list[ChunkMap]) -> ChunkMap:
    """All maps composed, neighbours first, level by level.  Each level holds the
    heads once, and the first map, which begins the text, is always a state."""
    while len(maps) > 1:
        pairs = [compose(t, a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
        maps = pairs + maps[2 * len(pairs):]
    return maps[0]


def prefix_scan(t: Transducer, maps: list[ChunkMap]) -> list[ChunkMap]:
    """All prefix compositions, in a number of rounds that is the logarithm of
    the number of chunks; the compositions of a round don't need one another."""
    step = 1
    while step < len(maps):
        maps = maps[:step] + [compose(t, maps[i - step], maps[i]) for i in range(step, len(maps))]
        step *= 2
    return maps


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(vocabulary(path))


def _freeze(x):
    return tuple(_freeze(y) for y in x) if isinstance(x, list) else x


def count_tokens(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text",
                 chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row of ``docs``."""
    raw = text_or_empty(text)
    body = F.when(raw == "", raw).otherwise(F.concat(F.lit(" "), raw))  # the library puts a blank in front
    # All chunks of a text in one pass over it; the possessive repeat needs no stack.
    cut = F.regexp_extract_all(F.col("body"), F.lit(f"(?s).{{1,{chunk_chars}}}+"), F.lit(0))
    chunk = F.transform("parts", lambda p, i: F.struct(
        i.alias("chunk"), p.alias("body"), F.coalesce(F.substring(F.get("parts", i - 1), -BEFORE, BEFORE), F.lit("")).alias("before")))
    chunks = (docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("doc_id"), body.alias("body"),
                          F.octet_length(raw).cast("long").alias("n_bytes"))
              .select("rid", "doc_id", "n_bytes", F.when(F.length("body") <= chunk_chars, F.array("body")).otherwise(cut).alias("parts"))
              .select("rid", "doc_id", "n_bytes", F.size("parts").alias("n_chunks"), F.inline(chunk)))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"rid long, doc_id {kind}, n_bytes long, n_chunks int, chunk int, head string, tail string, tokens long, known string"

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_path)
        for batch in batches:
            heads, tails, tokens, known = [], [], [], []
            many = batch.column("n_chunks").to_pylist()
            for n, chunk, body, before in zip(many, batch.column("chunk").to_pylist(), batch.column("body"), batch.column("before"), strict=True):
                m = chunk_map(t, body.as_py(), chunk == 0, before.as_py())
                heads.append(m.head)
                tails.append(json.dumps(m.tail) if n > 1 and m.tail is not None else None)
                tokens.append(m.tokens)
                known.append(json.dumps([[k, *v] for k, v in m.known.items()]))
            names = ["rid", "doc_id", "n_bytes", "n_chunks", "chunk"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(heads, pa.string()), pa.array(tails, pa.string()),
                                              pa.array(tokens, pa.int64()), pa.array(known, pa.string())],
                                             names=[*names, "head", "tail", "tokens", "known"])

    maps = stage(chunks.mapInArrow(evaluate, schema), "token-maps")

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        t = transducer(model_path)
        rows = rows.sort_values("chunk")
        parts = [ChunkMap(h, _freeze(json.loads(x)) if x is not None else None, int(n), {k: (e, m) for k, e, m in _freeze(json.loads(y))})
                 for h, x, n, y in zip(rows["head"], rows["tail"], rows["tokens"], rows["known"], strict=True)]
        return rows.head(1).assign(n_tokens=whole_map(t, parts).tokens)[["doc_id", "n_bytes", "n_tokens"]]

    whole = maps.where("n_chunks = 1").select("doc_id", "n_bytes", F.col("tokens").alias("n_tokens"))
    long = maps.where("n_chunks > 1").groupBy("rid").applyInPandas(total, f"doc_id {kind}, n_bytes long, n_tokens long")
    return whole.unionByName(long)
