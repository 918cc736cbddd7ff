"""WARC archives and packing: round trips and invariants."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyarrow import fs

from remitlens.llm import packing, warc
from remitlens.llm.queries import tokenizer_file

PAGES = [(1, "http://a", "<p>one</p>" * 40), (2, "http://b", "<p>one</p>" * 40), (5, None, None), (6, "u", ""), (7, "a b\nc", "é" * 3000), (None, "n", "<p>one</p>" * 40), (9, "x", "<i>unique</i>"), (2, "http://b", "<p>one</p>" * 40)]


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(1)
    pages = PAGES + [(100 + i, f"http://h/{i}", f"<html><body>{' '.join(rng.choice(['lorem', 'ipsum', 'dolor']) for _ in range(400))}</body></html>") for i in range(60)]
    folder = f"file://{tmp_path}/out"
    frame = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string")
    written = spark.createDataFrame(warc.write_archives(frame, folder, date="2024-01-01T00:00:00Z").collect())
    got = warc.read_archives(written, folder).collect()
    assert len(got) == len(pages)
    best = {}
    for d, _, h in pages:
        best[h or ""] = max(best.get(h or "", -1), -1 if d is None else d)
    want = []
    for d, _, h in pages:
        first = best[h or ""] if d not in (None, best[h or ""]) else None
        want.append((d, len((h or "").encode()), warc.payload_digest((h or "").encode()), "response" if first is None else "revisit", first))
    rows = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    texts = {d: (h or "").encode() for d, _, h in pages}
    assert all(bytes(r.block) == (texts[r.page_id] if r.record_type == "response" else b"") for r in got if r.page_id is not None)


def test_archive_starts_with_its_dictionary_and_refuses_damage(tmp_path):
    local = fs.LocalFileSystem()
    writer = warc.ArchiveWriter(local, f"{tmp_path}/a.warc.zst", 3)
    raws = [warc.record(i, "u", b"payload %d " % i * 500, None, "D", "2024-01-01T00:00:00Z") for i in range(300)]
    for raw in raws:
        writer.add(raw)
    writer.close()
    data = (tmp_path / "a.warc.zst").read_bytes()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    with local.open_input_stream(f"{tmp_path}/a.warc.zst", compression=None) as stream:
        assert list(warc.read_archive(stream)) == raws
    (tmp_path / "b").write_bytes(data[:-5])
    with local.open_input_stream(f"{tmp_path}/b", compression=None) as stream, pytest.raises(ValueError):
        list(warc.read_archive(stream))
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith(".open")] == []


def test_archives_of_no_pages(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archives(none, f"file://{tmp_path}/o").collect() == []


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    t.encode_special_tokens = True
    return t


def test_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(3)
    parts = ["a", "word", " ", "  ", "\n", "\t", " ", "é", "don't", "123", "!?", "\r\n", "<|endoftext|>", "日本", "　", "x\n y"]
    texts = ["", " ", "a  b", " a", "a ", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(3000))]
    got = packing.Encoder(tokenizer_file()).encode(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_with_special_tokens_equals_the_untouched_tokenizer(spark):
    from tokenizers import Tokenizer

    untouched = Tokenizer.from_file(tokenizer_file())
    rng = random.Random(9)
    parts = ["a", "word", " ", "  ", "\n", "é", "don't", "<|endoftext|>", "<|endoftext", "|>", ".", "x\n y"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(2000))]
    got = packing.Encoder(tokenizer_file(), special_tokens=True).encode(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == untouched.encode(text, add_special_tokens=False).ids, repr(text)
    rows = packing.pack(spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string"), tokenizer_file()).collect()
    expected = np.array([*untouched.encode("a <|endoftext|> b", add_special_tokens=False).ids, 1], "<u4")
    assert [(r.length, r.ids_crc32) for r in rows] == [(len(expected), zlib.crc32(expected.tobytes()))]


def test_encoder_learns_a_word_when_it_meets_it():
    """New words cost no walk over the remembered ones, and very long words are not remembered."""

    class Untold(packing._Remembered):
        def keys(self):
            raise AssertionError("walked over")

        __iter__ = keys

    encoder = packing.Encoder(tokenizer_file(), special_tokens=True)
    encoder._known = tuple(Untold(known._learn) for known in encoder._known)
    long = "x" * 5000
    texts = [f"word and\n{long} {long}. don't", "word again"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == encoder._tokenizer.encode(text, add_special_tokens=False).ids
    assert "and" in encoder._known[1] and not any(long in known for known in encoder._known)


def test_best_fit_decreasing_equals_a_scan():
    rng = random.Random(2)
    for _ in range(60):
        lengths = sorted((rng.randint(1, 64) for _ in range(rng.randint(0, 120))), reverse=True)
        windows, offsets = packing.best_fit_decreasing(lengths, 64)
        room = []
        for length, window, offset in zip(lengths, windows, offsets):
            fits = [r for r in room if r >= length]
            if window == len(room):
                assert not fits
                room.append(64)
            assert 64 - room[window] == offset and (not fits or room[window] == min(fits))
            room[window] -= length


def test_packing_keeps_every_id_once(spark, docs, corpus, tokenizer):
    got = packing.pack(docs, tokenizer_file(), size=256, group_pieces=20).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    texts = defaultdict(list)
    for r in corpus:
        texts[r[0]].append(r[1])
    assert set(pieces) == set(texts)
    for name, own in pieces.items():
        copies = len(texts[name])
        ids = np.array(tokenizer.encode(texts[name][0] or "", add_special_tokens=False).ids + [1], "<u4")
        assert sum(p.length for p in own) == copies * len(ids) and {p.doc_tokens for p in own} == {len(ids)}
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)


def test_padding_and_empty(spark, docs, empty):
    packed = packing.pack(docs, tokenizer_file(), size=256)
    row = packing.padding(packed, 256).first()
    assert row.tokens + row.padded <= row.sequences * 256
    assert packing.pack(empty, tokenizer_file()).collect() == []
