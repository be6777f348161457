"""Operators 7 and 10 against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tablewright.llm import piece_bpe, token_transducer as tt
from tests.llm.fixtures import edge_docs, edge_rows, empty_docs

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "  a", "a  ", "a   b\n\n c", "▁x ▁▁", "<s> </s> <unk>", "日本語😀 x", "x\x00y", "\t\t", "é é", "a" * 300, "ab" * 500, "<0x41>", "⁇", "�a"]


def _texts():
    r = random.Random(2)
    return ODD + ["".join(r.choice("ab \n▁é日😀\x01the") for _ in range(r.randint(0, 60))) for _ in range(500)]


def test_encoding_and_decoding_match_the_library():
    v = piece_bpe.Vocabulary(PATH)
    want = LIBRARY.encode(_texts())
    assert [v.encode(t) for t in _texts()] == want
    assert [v._merge_short(t) for t in ODD if t] == [v._merge_long(t) if len(t) > 1 else [t] for t in ODD if t]
    v.check_words()
    r = random.Random(3)
    ids = want + [[r.randrange(0, 32000) if r.random() < .5 else r.randrange(0, 262) for _ in range(r.randint(0, 12))] for _ in range(800)]
    assert [v.decode(x) for x in ids] == LIBRARY.decode(ids)


@pytest.mark.parametrize("size", [3, 7, 1000])
def test_chunk_maps_compose_to_the_count(size):
    t = tt.Transducer(piece_bpe.vocabulary(PATH))
    for text in _texts():
        if text:
            body = " " + text
            chunks = [body[i:i + size] for i in range(0, len(body), size)]
            maps = [tt.chunk_map(t, c, i == 0) for i, c in enumerate(chunks)]
            prefixes = tt.prefix_scan(t, maps)
            assert prefixes[-1].tokens == tt.whole_map(t, maps).tokens == len(LIBRARY.encode(text))


def test_composition_is_associative():
    t = tt.Transducer(piece_bpe.vocabulary(PATH))
    r = random.Random(4)
    for _ in range(200):
        a, b, c = (tt.chunk_map(t, "".join(r.choice("ab thé\n日") for _ in range(r.randint(1, 9))), False) for _ in range(3))
        assert tt.compose(t, tt.compose(t, a, b), c) == tt.compose(t, a, tt.compose(t, b, c))


def _blank_free():
    r = random.Random(5)
    return {"one letter": "a" * 20_000, "periodic": "abcab" * 4_000, "words": "".join(r.choice(["the", "ing", "station", "er"]) for _ in range(5_000)),
            "base64": "".join(r.choice("ABCDEFGHabcdefghiklmnopqrstu0123456789+/") for _ in range(20_000)), "cjk": "".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(20_000)),
            "digits": "".join(r.choice("0123456789") for _ in range(20_000)), "underscores": "_" * 20_000, "emoji": "a😀é" * 5_000}


@pytest.mark.parametrize("kind", _blank_free())
def test_blank_free_chunks_are_maps(kind):
    """Chunks without a blank compose to the library's count, in order or pairwise."""
    body, size = _blank_free()[kind], 1000
    t = tt.Transducer(piece_bpe.vocabulary(PATH))
    text = " " + body
    maps = [tt.chunk_map(t, text[i:i + size], i == 0, text[max(0, i - tt.BEFORE):i]) for i in range(0, len(text), size)]
    want = len(LIBRARY.encode(body))
    assert tt.whole_map(t, maps).tokens == want
    blind = [tt.ChunkMap(m.head, m.tail, m.tokens) for m in maps]  # the text itself serves states that no table knows
    assert tt.whole_map(t, blind).tokens == want
    assert all(m.known for m in maps if len(m.head) > tt.SHORT)


@pytest.mark.parametrize("kind", ["words", "periodic", "one letter"])
def test_tables_serve_the_states_that_occur(kind, monkeypatch):
    """No long head is run again when the maps are composed: the work is linear."""
    body, size = _blank_free()[kind], 1000
    t = tt.Transducer(piece_bpe.vocabulary(PATH))
    text = " " + body
    maps = [tt.chunk_map(t, text[i:i + size], i == 0, text[max(0, i - tt.BEFORE):i]) for i in range(0, len(text), size)]
    ran, run = [], t.run
    monkeypatch.setattr(t, "run", lambda s, x: ran.append(len(x)) or run(s, x))
    tt.whole_map(t, maps)
    assert sum(ran) < len(text)


def test_composition_with_tables_is_associative():
    t = tt.Transducer(piece_bpe.vocabulary(PATH))
    body = _blank_free()["words"]
    a, b, c = (tt.chunk_map(t, body[i:i + 500], False, body[i - 64:i]) for i in (500, 1000, 1500))
    assert tt.compose(t, tt.compose(t, a, b), c) == tt.compose(t, a, tt.compose(t, b, c))


def test_long_blank_free_texts(spark):
    rows = [(i, x) for i, x in enumerate(_blank_free().values())]
    got = tt.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH, chunk_chars=1500).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {i: (len(x.encode()), len(LIBRARY.encode(x))) for i, x in rows}


def test_long_words_are_not_kept():
    t = tt.Transducer(piece_bpe.vocabulary(PATH))
    tt.chunk_map(t, " " + "a" * 500 + " short " + "b" * 500 + " end", True)
    assert all(len(w) <= tt.SHORT for w in t.memo)


def test_resetting_the_transducer_changes_nothing(monkeypatch):
    monkeypatch.setattr(tt, "MEMO_WORDS", 3)
    t = tt.Transducer(piece_bpe.vocabulary(PATH))
    for text in _texts()[:100]:
        assert tt.chunk_map(t, " " + text if text else "", True).tokens == len(LIBRARY.encode(text))


def test_token_counts_edges(spark):
    got = tt.count_tokens(edge_docs(spark), PATH, chunk_chars=1000).collect()
    want = sorted((str(i), len((t or "").encode()), len(LIBRARY.encode(t or ""))) for i, t, *_ in edge_rows())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert tt.count_tokens(empty_docs(spark), PATH).count() == 0


def test_encode_decode_edges(spark):
    docs = edge_docs(spark)
    out = piece_bpe.decode(piece_bpe.encode(docs, PATH, check="texts"), PATH)
    assert set(docs.columns) < set(out.columns)
    for r in out.collect():
        assert r.ids == LIBRARY.encode(r.text or "") and r.decoded == LIBRARY.decode(r.ids)
    got = {(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_bpe.digests(docs, PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t, *_ in edge_rows():
        ids = LIBRARY.encode(t or "")
        want.add((str(i), len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    assert got == want
    assert piece_bpe.digests(empty_docs(spark), PATH).count() == 0


def test_decoded_texts_are_checked(spark, monkeypatch):
    ids = spark.createDataFrame([([300, 400],), ([],), (None,)], "ids array<int>")
    run = {}
    # The function that the tasks run, here in this process.
    monkeypatch.setattr(type(ids), "mapInArrow", lambda df, f, schema: run.setdefault("f", f))
    monkeypatch.setattr(piece_bpe.Vocabulary, "decode", lambda self, x: "wrong")
    batch = pa.RecordBatch.from_arrays([pa.array([[300, 400], [], None], pa.list_(pa.int32()))], names=["ids"])
    piece_bpe.decode(ids, PATH)
    with pytest.raises(ValueError):
        list(run["f"]([batch]))


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(Exception):
        piece_bpe.Vocabulary(str(tmp_path / "none.model"))


def test_words_counted_are_kept_when_states_are_compiled_anew():
    """Counts don't depend on states, so a reset costs no second reading of known words."""
    t = tt.Transducer(piece_bpe.vocabulary(PATH))
    words = [w for text in _texts() for w in t.vocab.words_of(" " + text) if text]
    counts = [t.word(w) for w in words]
    t.reset()
    short = [w for w in words if len(w) <= tt.SHORT]
    assert t.words(short) == sum(n for w, n in zip(words, counts, strict=True) if len(w) <= tt.SHORT)
    assert len(t.states) == 1  # nothing was read again


def test_last_characters_need_no_state(monkeypatch):
    """What a character emits is the same with and without the state after it."""
    t = tt.Transducer(piece_bpe.vocabulary(PATH))
    for text in _texts():
        s = 0
        for c in text:
            n = t.end(s, c)
            s, emitted = t.move(s, c)
            assert n == emitted
    t = tt.Transducer(piece_bpe.vocabulary(PATH))
    t.word("\u2581abcdefg")
    assert len(t.states) <= 8  # the start, and one for each character but the last
    monkeypatch.setattr(tt, "MAX_STATES", 5)
    assert [t.words(t.vocab.words_of(" " + x)) for x in _texts() if x] == [len(LIBRARY.encode(x)) for x in _texts() if x]
    assert len(t.ends) <= 5 + tt.SHORT


def test_memo_holds_runs_once():
    """Words that differ by the marks around them share one entry, which checks them too."""
    v = piece_bpe.Vocabulary(PATH)
    text = "word word, word. word! word; (word) 12word"
    assert v.letters_apart and "".join(v.runs_of(" " + text)) == "\u2581" + text.replace(" ", "\u2581")
    assert v.encode(text) == LIBRARY.encode(text)
    assert {"\u2581word", "word"} <= set(v.memo) and "\u2581word," not in v.memo
    v.check_words()
    assert all(v.encode(x) == LIBRARY.encode(x) and "".join(v.runs_of(x)) == x.replace(" ", "\u2581") for x in _texts())


def test_a_wrong_run_stops_the_job():
    v = piece_bpe.Vocabulary(PATH)
    v.ids = {**v.ids, ",": v.ids["."]}
    v.encode("word,")
    with pytest.raises(ValueError, match="differ"):
        v.check_words()


def _runs():
    r = random.Random(6)
    return sorted({"".join(r.choice("▁abethe, 日😀é\n0_.") for _ in range(r.randint(1, 64))).replace(" ", "") or "a" for _ in range(800)})


def test_the_shared_agenda_is_each_runs_agenda():
    """Runs new to the memo are merged together, with the result of the agenda of each alone."""
    v = piece_bpe.Vocabulary(PATH)
    runs = _runs()
    assert [list(memoryview(x).cast("i")) for x in v._pieces_of_all(runs)] == [v._pieces(x) for x in runs]


def test_new_runs_are_not_merged_one_by_one(monkeypatch):
    v = piece_bpe.Vocabulary(PATH)
    alone, merge = [], v.merge
    monkeypatch.setattr(v, "merge", lambda x: alone.append(x) or merge(x))
    text = " ".join(x + y for x in ("station", "winter", "gardenly", "Ofther") for y in ("", ",", "s", "ness!", "\n"))
    assert v.encode(text) == LIBRARY.encode(text)
    assert set(alone) <= {"\n"}  # only what holds a character that is no piece


@pytest.mark.parametrize("limit", [0, 2000])
def test_a_full_memo_changes_nothing(limit, monkeypatch):
    """The memo takes no entry past its size, also inside a group, and a group's ids don't need it."""
    monkeypatch.setattr(piece_bpe, "MEMO_BYTES", limit)
    v = piece_bpe.Vocabulary(PATH)
    texts = [*_texts(), "", *_texts()[::-1]]
    for at in range(0, len(texts), 300):
        assert v.encode_all(texts[at:at + 300]) == LIBRARY.encode(texts[at:at + 300])
        assert v.memo_bytes <= limit + 1000
        v.check_words()
    assert v.encode_all([]) == [] and v.encode_all(["", ""]) == [[], []]


def test_groups_are_bounded_by_characters(monkeypatch):
    """Long texts are not encoded together with many others."""
    monkeypatch.setattr(piece_bpe, "GROUP", 10)
    texts = ["abc", None, "defghi", "j" * 30, "", "klm", "n" * 9]
    assert list(piece_bpe._texts(pa.array(texts))) == [["abc", "", "defghi"], ["j" * 30], ["", "klm"], ["n" * 9]]
    assert list(piece_bpe._texts(pa.array(["a"] * 5), rows=2)) == [["a", "a"], ["a", "a"], ["a"]]
    assert list(piece_bpe._texts(pa.array([], pa.string()))) == []


def test_each_new_run_is_checked_in_its_word():
    v = piece_bpe.Vocabulary(PATH)
    v.encode_all(["one two, one", "", "two! three_4 two!  "])
    assert sorted(w for w, _ in v.unchecked) == sorted(["▁one", "▁two,", "▁two!", "▁three_4", "▁▁"])
    v.check_words()


def test_workers_forget_a_tasks_memo(spark):
    """Python workers outlive a query; they don't keep its memo meanwhile."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(_texts())], "doc_id long, text string").repartition(8)
    assert piece_bpe.digests(rows, PATH).count() == piece_bpe.encode(rows, PATH).count() == rows.count()
    piece_bpe.digests(rows, PATH).collect()

    def left(batches):
        for _ in batches:
            vocab = piece_bpe.vocabulary(PATH)
            yield pa.RecordBatch.from_arrays([pa.array([len(vocab.memo)]), pa.array([vocab.memo_bytes])], names=["n", "size"])

    assert {tuple(r) for r in spark.range(8).repartition(8, "id").mapInArrow(left, "n long, size long").collect()} == {(0, 0)}
