"""Operator 10: SentencePiece encoding and decoding for merge-type vocabularies.

Encoding starts from the characters of the normalised text and merges adjacent
symbols.  All adjacent pairs whose joined string is a piece wait in an agenda
ordered by the piece's score (higher first), then by place (left first); a pair
leaves the agenda when one of its symbols has been merged meanwhile.  Characters
that end up in no piece become byte pieces.

No piece holds two neighbouring characters that occur in none, so such a place is
a cut that no merge crosses, and the parts between cuts are encoded alone.  A
blank after another character is such a cut in vocabularies that mark word
starts, and where no piece holds a letter beside another character, so is the
border of a run of letters.  Texts are split into runs there; runs of at most
``SHORT`` characters that return are looked up in a memo, which is emptied when its
estimated size reaches ``MEMO_BYTES``, and when its task ends, as Python workers
outlive a task and a query.  So a word takes one entry, whatever marks
stand around it.

Texts are taken in groups of about ``GROUP`` characters.  A run that returns in a
group is looked up once, and the runs that are new to the memo share one agenda, an
array in which each round finds and merges the first pair of every run.

In each group the words with a run that is new to the memo are encoded by the
sentencepiece library too, and a difference stops the job; as no merge crosses a
cut, a text's ids are its words' ids.  ``check="texts"`` compares all whole texts
instead, ``check=None`` nothing.  Decoding compares every decoded text with the
library's, unless ``check=False``.  ``digests`` does all of this in one pass, so
a task has one Python worker with one memo, and no ids cross to the JVM and back.

Defined results: null counts as the empty text, which has no ids and decodes to
the empty text; repeated rows are encoded each; an empty table gives no rows;
the input's columns are kept, and one that has the name of the result is
replaced.  Texts of any length are taken whole.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property, lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

BLANK = "▁"
SHORT = 64
MEMO_BYTES = 40_000_000
#: Characters of the texts that are encoded together; a longer text is a group alone.
GROUP = 300_000
#: Bytes of a memo entry besides its characters and ids: key, packed ids and slot.
_ENTRY = 210
_NEVER = 1 << 60
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
#: Digits and what else ``\w`` matches that is no letter.
_NUMBERS = r"\d_²³¹¼-¾⁰-₟"
_LETTER = re.compile(rf"[^\W{_NUMBERS}]")
#: Blanks and the letters, or the other characters, that follow; any string is a row of these.
_RUN = re.compile(rf"{BLANK}*(?:[^\W{_NUMBERS}]+|(?:[^\w{BLANK}]|[{_NUMBERS}])+)|{BLANK}+")


class Vocabulary:
    """Pieces of a merge-type model file, and the agenda over them."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if (model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap
                or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces
                or model.trainer_spec.treat_whitespace_as_suffix or kinds - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}):
            raise ValueError("a merge-type model with byte pieces, word starts marked and no character map is needed")
        self.pieces = [p.piece for p in model.pieces]
        scores = sorted({p.score for p in model.pieces if p.type == _NORMAL}, reverse=True)
        place = {x: i for i, x in enumerate(scores)}
        self.rank = {p.piece: place[p.score] for p in model.pieces if p.type == _NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.bytes_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.control = {i for i, p in enumerate(model.pieces) if p.type == _CONTROL}
        #: What an id shows alone: a byte that may be part of a character shows nothing alone.
        self.shown: list[str | None] = [p.replace(BLANK, " ") for p in self.pieces]
        for i in range(len(self.pieces)):
            if i in self.control:
                self.shown[i] = ""
            elif i in self.bytes_of:
                self.shown[i] = chr(self.bytes_of[i][0]) if self.bytes_of[i][0] < 128 else None
        for i, p in enumerate(model.pieces):
            if p.type == _UNKNOWN:
                self.shown[i] = " ⁇ "
        self.joined = {p[i:i + 2] for p in self.rank for i in range(len(p) - 1)}
        #: Whether a blank after another character is a cut; else words are not split.
        self.words_apart = not any(a != BLANK and b == BLANK for a, b in self.joined)
        #: Whether a letter beside another character but a blank is a cut too.
        self.letters_apart = self.words_apart and not any(
            a != BLANK and bool(_LETTER.match(a)) != bool(_LETTER.match(b)) for a, b in self.joined)
        #: Ids are packed as 32-bit numbers: less memory than tuples, and nothing that the garbage collector walks.
        self.memo: dict[str, bytes] = {}
        self.memo_bytes = 0
        self.unchecked: list[tuple[str, list[int]]] = []

    def merge(self, text: str) -> list[str]:
        """The symbols that stay after all merges of the agenda."""
        return self._merge_short(text) if len(text) <= SHORT else self._merge_long(text)

    def _merge_short(self, text: str) -> list[str]:
        """The agenda as a list: the rank of each symbol joined with the next."""
        symbols, rank = list(text), self.rank
        agenda = [rank.get(text[i:i + 2], _NEVER) for i in range(len(text) - 1)]
        while agenda and (best := min(agenda)) != _NEVER:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank.get(symbols[i] + symbols[i + 1], _NEVER)
            if i:
                agenda[i - 1] = rank.get(symbols[i - 1] + symbols[i], _NEVER)
        return symbols

    def _merge_long(self, text: str) -> list[str]:
        """The agenda as a heap.  An entry is one number: the rank of the joined
        piece, the place and the joined length."""
        symbols = list(text)
        n, rank = len(symbols), self.rank
        place = n.bit_length()
        mask, low = (1 << place) - 1, 2 * place
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [r << low | i << place | 2 for i in range(n - 1) if (r := rank.get(text[i:i + 2])) is not None]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            i = entry >> place & mask
            left, j = symbols[i], after[i]
            if not left or j >= n or len(left) + len(symbols[j]) != entry & mask:
                continue  # one of the two was merged meanwhile
            joined = symbols[i] = left + symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                prior[k] = i
                right = joined + symbols[k]
                if (r := rank.get(right)) is not None:
                    heappush(agenda, r << low | i << place | len(right))
            h = prior[i]
            if h >= 0:
                right = symbols[h] + joined
                if (r := rank.get(right)) is not None:
                    heappush(agenda, r << low | h << place | len(right))
        return [s for s in symbols if s]

    @cached_property
    def _symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols as numbers, the piece id plus 1 where they have one: the number of
        each character (0 if it is in no piece), the ordered keys ``left << 32 | right``
        of the pairs that join, and rank and number of what they join to (the last row
        is of no pair)."""
        number = {p: i + 1 for p, i in self.ids.items()}
        for c in sorted({c for p in self.rank for c in p} - number.keys()):
            number[c] = len(self.pieces) + len(number) + 1
        chars = np.zeros(0x110000, np.int64)
        for c, i in number.items():
            if len(c) == 1:
                chars[ord(c)] = i
        pairs = sorted((number[p[:i]] << 32 | number[p[i:]], r, number[p]) for p, r in self.rank.items()
                       for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        rows = np.array([*pairs, (_NEVER, _NEVER, 0)], np.int64)
        return chars, rows[:, 0].copy(), rows[:, 1:].copy()

    def _pieces_of_all(self, runs: list[str]) -> list[bytes]:
        """The ids of each run, packed: the agenda of all runs is one array, which holds rank
        and place of each symbol joined with the next, or ``_NEVER``."""
        if not runs:
            return []
        chars, keys, joins = self._symbols
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        place = n.bit_length()
        # Place n stands for "no symbol" at both ends of a run.
        symbols = np.append(chars[np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)], 0)
        after, prior = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = prior[ends - lengths] = n
        agenda, joined = np.full(n + 1, _NEVER), np.zeros(n + 1, np.int64)

        def enter(left: np.ndarray, right: np.ndarray) -> None:
            key = symbols[left] << 32 | symbols[right]
            at = np.searchsorted(keys, key)
            at[keys[at] != key] = len(keys) - 1
            rank, joined[left] = joins[at].T
            agenda[left] = np.where(rank == _NEVER, _NEVER, rank << place | left)

        enter(np.arange(n), after[:n])
        first = ends - lengths
        while len(first):
            # A run that is done has no entries, so the one before it may reach over it.
            best = np.minimum.reduceat(agenda, first)
            first, best = first[best != _NEVER], best[best != _NEVER]
            i = best & ((1 << place) - 1)
            j, h = after[i], prior[i]
            k = after[j]
            symbols[i], symbols[j], agenda[j] = joined[i], -1, _NEVER
            after[i], prior[k] = k, i
            enter(np.concatenate([i, h]), np.concatenate([k, i]))
        stay = np.flatnonzero(symbols[:n] >= 0)
        cuts = np.searchsorted(stay, ends).tolist()
        ids = symbols[stay]
        # Runs with a character that is no piece are left to the spelling in bytes.
        spelt = set(np.searchsorted(ends, stay[(ids == 0) | (ids > len(self.pieces))], "right").tolist())
        ids = (ids - 1).astype(np.int32).tobytes()
        return [_packed(self._pieces(run)) if x in spelt else ids[4 * a:4 * b]
                for x, (run, a, b) in enumerate(zip(runs, [0, *cuts], cuts, strict=False))]

    def parts(self, text: str) -> list[str]:
        """The text split at all cuts."""
        joined = self.joined.__contains__
        if all(map(joined, map(add, text, text[1:]))):
            return [text]
        cuts = [0, *(i for i, x in enumerate(map(joined, map(add, text, text[1:])), 1) if not x), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _pieces(self, part: str) -> list[int]:
        out: list[int] = []
        for s in self.merge(part):
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            else:
                out.extend(self.byte_ids[b] for b in s.encode())
        return out

    def _encode_runs(self, runs: list[str]) -> tuple[list[bytes], list[int]]:
        """The ids of distinct runs, packed, and the places of those that are new to the memo."""
        memo = self.memo
        out = list(map(memo.get, runs))
        new = [x for x, ids in enumerate(out) if ids is None]
        for x in new:
            if len(runs[x]) > SHORT:
                out[x] = _packed(list(chain.from_iterable(map(self._pieces, self.parts(runs[x])))))
        short = [x for x in new if out[x] is None]
        for x, ids in zip(short, self._pieces_of_all([runs[x] for x in short]), strict=True):
            out[x] = ids
            if self.memo_bytes <= MEMO_BYTES:  # else it is emptied before the next group
                memo[runs[x]] = ids
                self.memo_bytes += _ENTRY + 2 * len(runs[x]) + len(ids)
        return out, new

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text of a group; words with a new run are to be checked."""
        if self.memo_bytes > MEMO_BYTES:
            self.forget()
        split = [self.runs_of(" " + t) if t else [] for t in texts]
        every = list(chain.from_iterable(split))
        coded = pa.array(every, pa.large_string()).dictionary_encode()
        which = coded.indices.to_numpy()
        first = np.empty(len(coded.dictionary), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        runs = [every[x] for x in first.tolist()]
        ids, new = self._encode_runs(runs)
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        # The ids of the runs in the texts' order: each run's stand at its place in ``flat``.
        many = length[which]
        ends = np.append(0, np.cumsum(many))
        flat = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(length) - length)[which] - ends[:-1], many)]
        if new:
            starts = np.append(np.flatnonzero(np.array([r[0] == BLANK for r in runs])[which]), len(which))
            at = np.unique(np.searchsorted(starts, first[new], "right"))
            cuts = np.stack([starts[at - 1], starts[at], ends[starts[at - 1]], ends[starts[at]]], axis=1).tolist()
            self.unchecked += [("".join(every[a:b]), flat[c:d].tolist()) for a, b, c, d in cuts]
        cuts = ends[np.cumsum([0, *map(len, split)])].tolist()
        return [flat[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]

    def forget(self) -> None:
        self.memo.clear()
        self.memo_bytes = 0

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def check_words(self) -> None:
        """Compare the words encoded since the last call with the library, which
        puts a blank in front of each itself (so not a blank alone)."""
        new, self.unchecked = [x for x in self.unchecked if len(x[0]) > 1], []
        for (word, ids), said in zip(new, self.library.encode([w[1:] for w, _ in new], num_threads=1), strict=True):
            if ids != said:
                raise ValueError(f"ids differ from the library's: {word[:200]!r}")

    def words(self, text: str) -> list[str]:
        """The normalised text, split before blanks that follow another character."""
        return self.words_of(" " + text)

    def words_of(self, text: str) -> list[str]:
        """As ``words``, for text that is to get no blank in front."""
        text = text.replace(BLANK, " ")
        if not self.words_apart:
            return [text.replace(" ", BLANK)]
        if "  " not in text and text[:1] == " " and text[-1] != " ":
            return [BLANK + w for w in text[1:].split(" ")]
        out, blanks = [], -1
        for w in text.split(" "):
            blanks += 1
            if w:
                out.append(BLANK * blanks + w)
                blanks = 0
        return [*out, BLANK * blanks] if blanks else out

    def runs_of(self, text: str) -> list[str]:
        """As ``words_of``, split before and after letters too where these are cuts."""
        if not self.letters_apart:
            return self.words_of(text)
        return _RUN.findall(text.replace(" ", BLANK))

    def decode(self, ids: list[int]) -> str:
        shown = self.shown
        out = [shown[i] for i in ids]
        if None in out:
            out = self._with_bytes(ids)
        text = "".join(out)
        first = next((i for i in ids if i not in self.control), 0)
        return text[1:] if self.pieces[first][:1] == BLANK else text

    def _with_bytes(self, ids: list[int]) -> list[str]:
        """What each id shows, where neighbouring byte pieces form characters."""
        out: list[str] = []
        run = b""
        for i in ids:
            if self.shown[i] is None:
                run += self.bytes_of[i]
                continue
            if run:
                out.append(_utf8(run))
                run = b""
            out.append(self.shown[i])
        return [*out, _utf8(run)] if run else out


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def _utf8(run: bytes) -> str:
    """Bytes as text; each byte that belongs to no character becomes U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i:i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@contextmanager
def _for_task(path: str) -> Iterator[Vocabulary]:
    """The vocabulary, without what a task remembers when that ends."""
    vocab = vocabulary(path)
    try:
        yield vocab
    finally:
        vocab.forget()
        pa.default_memory_pool().release_unused()


def _with(df: DataFrame, name: str, kind) -> StructType:
    return StructType([f for f in df.schema.fields if f.name.lower() != name.lower()] + [StructField(name, kind)])


def _texts(column: pa.Array, rows: int = 256) -> Iterator[list[str]]:
    """The texts in groups of at most ``rows``, and of about ``GROUP`` characters."""
    group: list[str] = []
    size = 0
    for value in column:
        text = value.as_py() or ""
        if group and (len(group) == rows or size + len(text) > GROUP):
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


@contextmanager
def _no_collection() -> Iterator[None]:
    """No cycles arise in a group; the search for them would walk the memo and the
    group's lists again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@_no_collection()
def _encoded(vocab: Vocabulary, texts: list[str], check: str | None) -> list[list[int]]:
    """The ids of some texts, checked as ``check`` says."""
    vocab.unchecked.clear()
    got = vocab.encode_all(texts)
    if check == "words":
        vocab.check_words()
    elif check == "texts" and got != (said := vocab.library.encode(texts, num_threads=1)):
        bad = next(t for t, a, b in zip(texts, got, said, strict=True) if a != b)
        raise ValueError(f"ids differ from the library's: {bad[:200]!r}")
    return got


@_no_collection()
def _decoded(vocab: Vocabulary, rows: list[list[int]], check: bool) -> list[str]:
    got = [vocab.decode(x) for x in rows]
    if check and got != (said := vocab.library.decode(rows, num_threads=1)):
        bad = next(x for x, a, b in zip(rows, got, said, strict=True) if a != b)
        raise ValueError(f"the text differs from the library's for the ids {bad[:50]}")
    return got


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", check: str | None = "words") -> DataFrame:
    """``df`` with the column ``ids``: the piece ids of each whole text."""
    schema = _with(df, ids, ArrayType(IntegerType(), False))
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _for_task(model_path) as vocab:
            for batch in batches:
                column, at = batch.column(text), 0
                for texts in _texts(column):
                    got = _encoded(vocab, texts, check)
                    part = batch.slice(at, len(texts))
                    at += len(texts)
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(got, pa.list_(pa.int32()))], names=[*kept, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded", check: bool = True) -> DataFrame:
    """``df`` with the column ``text``: the decoded text of each row's ids."""
    schema = _with(df, text, StringType())
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [x or [] for x in part.column(ids).to_pylist()]
                got = _decoded(vocab, rows, check)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(got, pa.string())], names=[*kept, text])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded, checked,
    decoded and checked in one pass."""
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([rows.schema["doc_id"], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
                         StructField("decoded_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _for_task(model_path) as vocab:
            named = [str(i) for i in range(len(vocab.pieces))]
            for batch in batches:
                n, of_ids, of_text = [], [], []
                for texts in _texts(batch.column("text")):
                    got = _encoded(vocab, texts, "words")
                    n += map(len, got)
                    of_ids += [sha256(",".join([named[i] for i in ids]).encode()).hexdigest() for ids in got]
                    of_text += [sha256(t.encode()).hexdigest() for t in _decoded(vocab, got, True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()),
                                                  pa.array(of_text, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
