"""Pieces against whole texts, files against what went in, and packings against their rules and a plain best fit."""

import random
import zlib

import numpy as np
import pytest

from marlstone.llm.common import new_path
from marlstone.llm.packing import CapacityTree, best_fit_pack, best_fit_runs, pack_documents
from marlstone.llm.token_files import open_sequences, read_documents, sequence, write_sequences
from marlstone.llm.tokens import Encoder

TEXTS = [None, "", " ", "a  b", "  a", "a \n b\n\nc ", "x\n", "\ta b  c", "it's  'll\n 's", " lead", "日本 語　x  y", "a, b,. c!? d.\nE, f", "<|endoftext|> a", "word " * 3000 + "end", "é\xa0 x", "a  b", "one two"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(most_kept=50)


def ids_of(encoder, text):
    return [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_equal_whole_texts(encoder):
    rng = random.Random(1)
    parts = ["a", "Word", ",", ".", " ", " ", "\n", "'s", "12", "é", "\t", "日", "!", "  ", "-x", "\xa0"]
    for text in [t for t in TEXTS if t] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(2000)]:
        assert encoder.encode(text) == np.array(ids_of(encoder, text)[:-1], "<u2").tobytes(), text


def test_files(spark, encoder):
    df = spark.createDataFrame([(k * 3 % 17, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, start string")
    folder = new_path(spark, "sequences")
    files = write_sequences(df, folder, length=64)
    start = 0
    got = {r.doc_id: r for r in read_documents(files, folder).collect()}
    assert len(got) == len(TEXTS)
    for doc, text in sorted((k * 3 % 17, t) for k, t in enumerate(TEXTS)):
        ids = ids_of(encoder, text)
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for r in files.collect():
        reader = open_sequences(folder, r.file)
        n = sum(reader.get_batch(k).num_rows for k in range(reader.num_record_batches))
        assert n == -(-r.n_tokens // 64) and sum(int(sequence(reader, k)[1].sum()) for k in range(n)) == r.n_tokens
    assert read_documents(write_sequences(df.limit(0), new_path(spark, "none")), "file:///none").collect() == []


def test_tree_finds_the_tightest():
    rng = random.Random(2)
    tree, marked = CapacityTree(100), set()
    for _ in range(3000):
        k = rng.randrange(101)
        on = rng.random() < 0.4
        tree.mark(k, on)
        (marked.add if on else marked.discard)(k)
        least = rng.randrange(101)
        assert tree.tightest(least) == min((m for m in marked if m >= least), default=None)


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, room in enumerate(bins) if room >= n]
        if fit:
            k = min(fit, key=lambda k: (bins[k], k))
            bins[k] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_runs_are_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.choice([7, 20, 100])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        room, placed = {}, {n: set() for n in counts}
        for length, lo, hi, first, each, offset in best_fit_runs(counts, capacity):
            for r in range(lo, hi):
                assert r not in placed[length]
                placed[length].add(r)
                room.setdefault(first + (r - lo) // each, []).append((offset + (r - lo) % each * length, length))
        assert all(placed[n] == set(range(c)) for n, c in counts.items())
        for parts in room.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert sorted(capacity - sum(n for _, n in p) for p in room.values()) == plain_best_fit(lengths, capacity)


def test_documents(spark, encoder):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(3, "again"), (None, "none")], "doc_id long, text string")
    rows = pack_documents(df, 64).collect()
    long = sorted((r for r in rows if r.doc_id == 13), key=lambda r: r.piece)
    ids = ids_of(encoder, TEXTS[13])
    assert [r.start for r in long] == list(np.cumsum([0, *[r.length for r in long]])[:-1]) and all(r.length == 64 for r in long[1:]) and long[0].length == (len(ids) - 1) % 64 + 1
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in long)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) == len(plain_best_fit([r.length for r in rows], 64)) and {r.doc_id for r in rows} == {*range(len(TEXTS)), None}


def test_one_length_holds_most_rows(spark):
    cut = spark.createDataFrame([(k, 0, 0, 9 if k % 3 == 0 else 1 + k % 8, 0) for k in range(3000)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = best_fit_pack(cut, 20).collect()
    assert len(rows) == 3000 and len({(r.sequence_id, r.offset) for r in rows}) == 3000
    assert best_fit_pack(cut.limit(0), 20).collect() == []


def test_added_tokens_are_those_of_a_plain_tokenizer():
    from tokenizers import Tokenizer

    from marlstone.llm.tokens import vocabulary_path

    fresh, own = Tokenizer.from_file(vocabulary_path()), Encoder()
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\ny z", "plain words. And, more!", "a <|endoftext |> b", "tab\there", "a  b\n\nc "]
    for text in texts:
        want = fresh.encode(text, add_special_tokens=False).ids
        assert list(np.frombuffer(own.encode(text), "<u2")) == want, text
    assert 0 in fresh.encode(texts[0], add_special_tokens=False).ids or len(fresh.encode(texts[0], add_special_tokens=False).ids) < len(fresh.encode(texts[4], add_special_tokens=False).ids)


def test_masks_are_views_of_the_file(tmp_path):
    import pyarrow as pa

    from marlstone.llm.token_files import SequenceWriter, open_sequences, sequence

    with open(tmp_path / "a.arrow", "wb") as sink:
        writer = SequenceWriter(sink, length=8, rows=2)
        for n in (5, 3, 9, 4):
            writer.add(np.arange(n, dtype=np.uint16))
        writer.close()
    reader = open_sequences(f"file://{tmp_path}", "a.arrow")
    before = pa.total_allocated_bytes()
    ids, mask = sequence(reader, 2, rows=2)
    assert list(ids) == [8, 0, 1, 2, 3, 0, 0, 0] and mask.to_pylist() == [True] * 5 + [False] * 3 and not ids.flags.owndata
    assert mask.buffers()[1].address == reader.get_batch(1).column("mask").flatten().buffers()[1].address
    assert pa.total_allocated_bytes() - before < 4096


def test_a_word_is_tokenized_once_whatever_stands_around_it():
    from types import SimpleNamespace

    own = Encoder()
    plain, model, calls = own.whole, own.model, []
    own.whole = lambda text: (calls.append(text), plain(text))[1]
    own.model = SimpleNamespace(tokenize=lambda word: (calls.append(word), model.tokenize(word))[1])
    words, marks = [a + b + "né"[k] for k, a in enumerate("zk") for b in "aeiou"], ",.;%*/-'\"("
    for text in [f"Und {w}{m} und\n{w}{m} und" for w in words for m in marks]:
        assert own.encode(text) == np.array(ids_of(own, text)[:-1], "<u2").tobytes(), text
    assert len(calls) <= 2 * len(words) + len(marks) + 5


def test_batches_equal_whole_texts(encoder, monkeypatch):
    import pyarrow as pa

    from marlstone.llm import tokens

    assert tokens.shared_encoder() is tokens.shared_encoder()
    rng = random.Random(4)
    parts = ["a", "Word", "été", "÷", "'", "s", "'re", "12", ",", "-", " ", " ", "\n", "日", "\x00", "\x7f", "<|endoftext|>", "　", "y" * 70]
    texts = TEXTS + ["".join(rng.choice(parts[: rng.choice([13, 16, 19])]) for _ in range(rng.randrange(1, 40))) for _ in range(3000)] + ["", None]
    for at_once in (1, 7, 1 << 20):
        monkeypatch.setattr(tokens, "AT_ONCE", at_once)
        for kind in (pa.string(), pa.large_string()):
            column = pa.array(texts if at_once > 1 else texts[:300], kind)[3:]
            ids, offsets = encoder.documents(column)
            assert [list(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [ids_of(encoder, t) for t in column.to_pylist()]
    assert len(encoder.kept) <= 50
    for column in (pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        assert [x.tolist() for x in encoder.documents(column)] == [[0] * len(column), list(range(len(column) + 1))]


def test_long_pieces_are_not_kept():
    own = Encoder(most_kept=1000)
    own.encode("some words")
    for k in range(3):
        text = f"some {'ab' * 50}{k} words {'cd' * 50}"
        assert own.encode(text) == np.array(ids_of(own, text)[:-1], "<u2").tobytes()
        assert own.encode(f"\t{text}") == np.array(ids_of(own, f"\t{text}")[:-1], "<u2").tobytes()
    assert set(own.kept) == {b"some", b" words", b"0", b"1", b"2"} and len(own.stops) == 6 and len(own.flat) == own.stops[-1] < 10
