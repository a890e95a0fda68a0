"""Counts, files and packed sequences of tokens, against the tokenizer libraries themselves."""

import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gaugelake.llm.direct_codes import DirectCodes, pack
from gaugelake.llm.packing import Costs, best_cuts, cut_points, pack_documents, powers
from gaugelake.llm.pretokens import ChunkCache, IdEncoder, PieceCounter, tokenizer_path
from gaugelake.llm.token_counts import count_tokens
from gaugelake.llm.token_files import Shard, read_token_files, shard_bytes, write_token_files

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "\n", "\n a \n", "it's the Dog's, isn't  it?", "tab\tand\rreturn\x0b\x0c end", "nbsp\xa0here x ▁y▁▁z",
    "x <|endoftext|> y", "<|endoftext|>", "<s> </s> <unk> <0x0A>", "naïve café — schön ñandú ΑΣ ΟΔΟΣ", "é ä", "日本語 テキスト 混合 text", "👩‍👩‍👧 ok", "nul\x00byte \x00", "\x1cfs \x1d x\x85y",
    "the " * 3000, "word. " * 5000 + "!", "z" * 20000, "1234 5678,90", "the the the",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", 7), (None, "null id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, id int").repartition(3)


def test_counts_equal_the_library(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in count_tokens(docs, tokenizer_path("piece_bpe_32k.model"), limit=100).collect()}
    for i, t in enumerate(TEXTS):
        n = len(model.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 100), t[:40] if t else t
    assert count_tokens(docs, tokenizer_path("piece_bpe_32k.model")).count() == len(TEXTS) + 2
    assert count_tokens(docs.limit(0), tokenizer_path("piece_bpe_32k.model")).count() == 0


SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace()) + "\u200b\ufeff\u180e"
PIECES = ["it's", "I'LL", "d'", "naïve", "\u0301", "你好", "İ", "ẞ", "Σ", "ǅ", "मी", "\U0001f600", "12", "#", "<|endoftext|>", "<|startoftext|>", "</w>"]


@settings(max_examples=250, deadline=None)
@given(st.one_of(st.text(alphabet="ab .\n\t▁é's1\x00\xa0\x1c\x1f\x85\u2028\u3000", max_size=30), st.lists(st.one_of(st.sampled_from(PIECES), st.sampled_from(list(SPACES)), st.sampled_from(" \n")), max_size=14).map("".join)))
def test_chunks_encode_alone_as_in_the_text(text):
    counter = PieceCounter(tokenizer_path("piece_bpe_32k.model")) if "counter" not in _kept else _kept["counter"]
    _kept["counter"] = counter
    assert counter.counts([text]) == [len(counter.model.encode(text))]
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        encoder = _kept.setdefault(name, IdEncoder(tokenizer_path(name), spaced))
        assert np.frombuffer(next(encoder.encode([text])), encoder.dtype).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


_kept: dict = {}


def test_whole_tokens_are_single():
    counter = PieceCounter(tokenizer_path("piece_bpe_32k.model"))
    assert len(counter.cache.fixed) > 10_000
    some = list(counter.cache.fixed)[::500]
    assert all(len(counter.model.encode(c[1:])) == 1 for c in some)


def test_cache_starts_anew_when_full():
    cache = ChunkCache(lambda ks: [k * 2 for k in ks], {"x": "fixed"}, cap=4)
    for i in range(50):
        known = cache.of([f"k{i}", f"k{i + 1}", "x"])
        assert known[f"k{i}"] == f"k{i}" * 2 and known["x"] == "fixed" and len(known) <= 5 + 2


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 1 << 40)), max_size=1500), st.sampled_from([8, 16]))
def test_direct_codes_round_trip(values, bits):
    code = DirectCodes(pack(np.array(values, np.uint64), bits))
    assert code.between(0, len(values)).tolist() == values
    for i in range(0, len(values), 97):
        assert code[i] == values[i]
        assert code.between(i, min(i + 50, len(values))).tolist() == values[i : i + 50]


def test_shards_round_trip():
    ids = [np.array([1, 2, 50000], "<u2"), np.array([2], "<u2"), np.array([], "<u2")]
    shard = Shard(shard_bytes([5, None, -3], ids))
    assert [shard.ids(i).tolist() for i in range(3)] == [x.tolist() for x in ids]
    assert shard.codes[2] == 50000 and shard.known.tolist() == [True, False, True]


def test_token_files_round_trip(spark, docs, tmp_path):
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    manifest = write_token_files(docs, str(tmp_path), tokenizer_path("byte_bpe_50k.json"), shard_ids=1000)
    got = sorted(read_token_files(spark, manifest, str(tmp_path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
    start = 0
    for r in got:
        want = tokenizer.encode("null id" if r.doc_id is None else TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want) and r.start == start
        start += len(want)
    assert write_token_files(docs.limit(0), str(tmp_path / "none"), tokenizer_path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("max_len", [64, 4096])
def test_packing_keeps_every_id_once(docs, max_len):
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces = pack_documents(docs, tokenizer_path("word_bpe_49k.json"), costs=Costs(max_len=max_len)).collect()
    sequences, documents = {}, {}
    for p in pieces:
        assert p.length * 4 == len(p.ids) and p.length > 0
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        documents.setdefault(p.doc_id, []).append(p)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_len
    for i, t in enumerate(TEXTS):
        want = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(documents[i], key=lambda p: p.start)
        assert {p.doc_tokens for p in own} == {len(want)}
        if i != 3:
            assert b"".join(p.ids for p in own) == want.tobytes()
            assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
    if max_len == 4096:
        total = {k: sum(n for _, n in parts) for k, parts in sequences.items()}
        assert sum(0 if n & (n - 1) == 0 else max_len - n for n in total.values()) < 0.01 * sum(total.values())
    assert sum(p.length for p in documents[3]) == 2 * documents[3][0].doc_tokens
    assert zlib.crc32(b"") == 0 and pack_documents(docs.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12), st.randoms())
def test_cuts_cost_least(lengths, random):
    points = np.concatenate([[0], np.cumsum(lengths)])
    penalty = np.array([0] + [random.choice([0, 3, 9]) for _ in lengths])
    cost = lambda cuts: sum(50 - (points[b] - points[a]) + penalty[b] for a, b in zip(cuts, cuts[1:]))
    best = [0] + [10**9] * len(lengths)
    for j in range(1, len(points)):
        best[j] = min(best[i] + 50 - (points[j] - points[i]) + penalty[j] for i in range(j) if points[j] - points[i] <= 50)
    cuts = best_cuts(points, penalty, 50)
    assert cost(np.searchsorted(points, cuts)) == best[-1]
    assert powers(13) == [8, 4, 1]
    assert cut_points(10_000, np.array([10_000]), np.zeros(0, int), Costs())[0].tolist()[:3] == [0, 16, 32]
