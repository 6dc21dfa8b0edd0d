import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopgrain.llm import binary_output, packing, token_counts, tokens

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

ALPHABET = st.text(st.one_of(st.sampled_from("aB'stTreéİßΣ\n\t \x0b\x1c\x85\xa0  <|endoftext>12_-.!́中ª²×'"), st.characters()), max_size=40)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_encoders_give_the_library_s_ids(text):
    for coder in (tokens.word_encoder(WORD), tokens.byte_encoder(BYTES)):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == coder.ids(text)


def test_a_lone_surrogate_counts_as_the_replacement_character():
    for coder in (tokens.word_encoder(WORD), tokens.byte_encoder(BYTES)):
        for text in ("\ud800", "a\udfffb c", "x \ud83d\ude00 y"):
            whole = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            assert np.frombuffer(coder.encode(text), "<u4").tolist() == coder.ids(text) == coder.ids(whole)


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED", 3)
    coder = tokens.WordEncoder(WORD)
    text = "one two three four five one two"
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == coder.ids(text)


def library_ids(rows):
    """doc_id -> ids of each of its rows, with the end id."""
    coder = tokens.word_encoder(WORD)
    out = defaultdict(list)
    for doc, text in rows:
        out[doc].append([*coder.ids(text or ""), 1])
    return out


@pytest.mark.parametrize("length", [16, 2048])
def test_pieces_give_back_every_id(clashing, awkward_rows, length):
    pieces = packing.pack(clashing, WORD, length).collect()
    assert {type(p.doc_id) for p in pieces} <= {int, type(None)}
    want = library_ids([(r[0], r[1]) for r in awkward_rows])
    # Pieces in the order of the whole row of ids: documents follow each other.
    row, docs = [], []
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and p.sequence_id * length + p.offset == len(row)
        if p.start == 0:
            docs.append((p.doc_id, p.doc_tokens, []))
        assert docs[-1][0] == p.doc_id and len(docs[-1][2]) == p.start
        docs[-1][2].extend(ids)
        row += ids
    got = defaultdict(list)
    for doc, n, ids in docs:
        assert len(ids) == n
        got[doc].append(ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_windows_are_full_but_the_last(awkward):
    pieces = packing.pack(awkward, WORD, 64)
    rows = {r.sequence_id: r for r in packing.sequences(pieces, 64).collect()}
    assert sorted(rows) == list(range(len(rows)))
    assert all(len(r.ids) == 256 for r in rows.values())
    assert all(rows[i].used == 64 for i in range(len(rows) - 1))


def test_query_crc(spark, awkward):
    r = packing.pack(awkward.filter("doc_id = 1"), WORD).selectExpr("ids", "crc32(ids) AS c").first()
    assert r.c == zlib.crc32(bytes(r.ids))


def test_counts_match_the_library(spark, tmp_path, clashing, awkward_rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    cache = token_counts.TokenCache.open(spark, str(tmp_path), PIECES, buckets=3)
    got = token_counts.count_tokens(clashing, cache).collect()
    want = [(r[0], len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in awkward_rows]
    assert sorted([(r.doc_id, r.n_bytes, r.n_tokens) for r in got], key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_only_distinct_misses_are_encoded(spark, tmp_path, awkward, awkward_rows):
    cache = token_counts.TokenCache.open(spark, str(tmp_path), PIECES, buckets=3)
    first = token_counts.count_tokens(awkward, cache).collect()
    assert cache.counts().count() == len({r[1] or "" for r in awkward_rows})
    again = token_counts.TokenCache.open(spark, str(tmp_path), PIECES)
    assert again.buckets == 3
    more = awkward.union(spark.createDataFrame([(99, "new text", None, None, 1)], awkward.schema))
    assert token_counts.count_tokens(more, again).count() == len(first) + 1
    assert again.counts().count() == len({r[1] or "" for r in awkward_rows}) + 1


def test_another_tokenizer_has_counts_of_its_own(spark, tmp_path, awkward):
    token_counts.count_tokens(awkward, token_counts.TokenCache.open(spark, str(tmp_path), PIECES, buckets=3)).collect()
    other = token_counts.TokenCache.open(spark, str(tmp_path), PIECES)
    other = token_counts.TokenCache(spark, other.table, other.buckets, PIECES, "other")
    assert other.counts().count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_against_a_plain_search(lengths):
    got = binary_output.best_fit(lengths, 32)
    rooms, want = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= lengths[i]]
        if fits:
            best = min(room for room, _ in fits)
            k = max(k for room, k in fits if room == best)
        else:
            k = len(rooms)
            rooms.append(32)
            want.append([])
        rooms[k] -= lengths[i]
        want[k].append(i)
    assert sorted(i for row in got for i in row) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in row) <= 32 for row in got)
    assert len(got) == len(want)


@pytest.mark.parametrize("block", [500, 2_000_000])
def test_rows_give_back_every_text(clashing, awkward_rows, block):
    coder = tokens.byte_encoder(BYTES)
    parts = defaultdict(list)
    rows = binary_output.write_rows(clashing, BYTES, 256, block).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for r in rows:
        ids, places = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(places) == 256 and r.cu_seqlens[0] == 0
        bounds = [*r.cu_seqlens, *([256] if r.cu_seqlens[-1] < 256 else [])]
        assert places.tolist() == [i for a, b in zip(bounds, bounds[1:], strict=False) for i in range(b - a)]
        assert (ids[r.cu_seqlens[-1] :] == coder.end_id).all()
        for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            parts[doc].append((start, ids[a:b].tolist()))
    want = defaultdict(list)
    for r in awkward_rows:
        want[r[0]] += [*coder.ids(r[1] or ""), coder.end_id]
    for doc, ids in want.items():
        assert sorted(x for _, p in parts[doc] for x in p) == sorted(ids)
    alone = {7, 8, 11, 9}  # ids of a single row: exact order
    for doc in alone:
        ids = [x for _, p in sorted(parts[doc]) for x in p]
        assert ids == want[doc] and coder.decode(ids[:-1]) == next(r[1] for r in awkward_rows if r[0] == doc)


def test_empty_table(spark, tmp_path, no_docs):
    assert packing.pack(no_docs, WORD).count() == 0
    assert binary_output.write_rows(no_docs, BYTES).count() == 0
    cache = token_counts.TokenCache.open(spark, str(tmp_path), PIECES)
    assert token_counts.count_tokens(no_docs, cache).count() == 0
