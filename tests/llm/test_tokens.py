import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandex.llm import byte_bpe, packing

MULTI, PLAIN = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab é\n'strveaalx. 0123日", max_size=80)))
def test_ids_equal_the_rank_encoder(text):
    with open(MULTI, "rb") as f:
        ranks = test_ids_equal_the_rank_encoder.__dict__.setdefault("ranks", {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    other = test_ids_equal_the_rank_encoder.__dict__.setdefault("other", tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    own = byte_bpe.codec(MULTI, P.PATTERN)
    ids = own.encode(text).tolist()
    assert ids == other.encode_ordinary(text)
    assert own.decode(ids) == text
    with_offsets, starts, ends = own.encode_with_offsets(text)
    assert with_offsets == ids and [0, *ends] == [*starts, len(text.encode())]


def test_every_letter_that_tables_disagree_on(reference):
    own = byte_bpe.codec(MULTI, P.PATTERN)
    for first in range(0, 0x40000, 997):
        text = "a".join(chr(c) for c in range(first, min(first + 997, 0x40000)) if not 0xD800 <= c <= 0xDFFF)
        assert own.encode(text).tolist() == reference.encode_ordinary(text)


def test_split_characters_decode_to_replacements():
    own = byte_bpe.codec(MULTI, P.PATTERN)
    half = next(i for i, b in own.bytes_of.items() if b == b"\xe6")
    assert own.decode([half]) == "\ufffd"


def test_digests(docs, rows, reference):
    found = {r["doc_id"]: r for r in byte_bpe.digest_documents(docs, MULTI, P.PATTERN).collect()}
    assert len(found) == len(rows)
    for doc, text, *_ in rows:
        ids = reference.encode_ordinary(text or "")
        assert found[doc]["n_tokens"] == len(ids)
        assert found[doc]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[doc]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_then_decode_frames(docs, rows, odd, nothing):
    encoded = byte_bpe.encode_documents(docs, MULTI, P.PATTERN, offsets=True)
    back = {r["doc_id"]: r["text"] for r in byte_bpe.decode_documents(encoded, MULTI, P.PATTERN).collect()}
    assert back == {doc: text or "" for doc, text, *_ in rows}
    assert byte_bpe.encode_documents(odd, MULTI, P.PATTERN).count() == 6
    assert byte_bpe.digest_documents(nothing, MULTI, P.PATTERN).count() == 0


def check_packing(pieces, ids_of, size):
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_window[p["sequence_id"]].append(p)
    assert by_doc.keys() == ids_of.keys()
    for doc, own in by_doc.items():
        at, ids = 0, np.array(ids_of[doc], dtype="<u4")
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in by_window.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == size or at < size and at & (at - 1) == 0


def test_packing(docs, rows, odd, nothing):
    tokenizer = Tokenizer.from_file(PLAIN)
    assert 50256 in tokenizer.encode("<|endoftext|> is text", add_special_tokens=False).ids
    for size in (1024, 16):
        found = packing.pack(docs, PLAIN, P.PATTERN, size=size).collect()
        check_packing(found, {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t, *_ in rows}, size)
    assert packing.pack(nothing, PLAIN, P.PATTERN).count() == 0
    assert {r["doc_tokens"] for r in packing.pack(odd.where("text is null"), PLAIN, P.PATTERN).collect()} == {1}


def test_placement_makes_the_sum_of_squares_least():
    r = np.random.default_rng(3)
    packer = packing.Packer(32)
    for _ in range(400):
        n = int(r.integers(1, 32))
        level = packer.level.copy()
        best = []
        for h in range(0, 32 - n + 1):
            if h and not level[h]:
                continue
            after = level.copy()
            if h:
                after[h] -= 1
            if h + n < 32:
                after[h + n] += 1
            best.append((int((after**2).sum()), -h))
        assert packer.choose(n) == -min(best)[1]
        packer.add(0, np.zeros(n, dtype="<u4"))
        assert packer.open == packer.level.sum()


def packed(lengths, size=64, open_windows=8192):
    r = np.random.default_rng(5)
    packer, docs = packing.Packer(size, open_windows=open_windows), {}
    for d, n in enumerate(lengths):
        docs[d] = r.integers(0, 99, int(n)).tolist()
        packer.add(d, np.array(docs[d], dtype="<u4"))
    packer.finish()
    names = ["doc_id", *packing.NAMES]
    rows = [dict(zip(names, x, strict=True)) for x in packer.rows]
    check_packing(rows, docs, size)
    return rows


@pytest.mark.parametrize("open_windows", (5, 8192))
def test_closing_keeps_every_id(open_windows):
    packed(np.random.default_rng(5).integers(1, 200, 300), open_windows=open_windows)


def test_documents_that_only_leave_gaps_are_cut_at_powers_of_two():
    rows = packed([37] * 50, open_windows=10)  # no two fit in a window, and a window of one is 0.58 full
    sizes = Counter()
    for r in rows:
        sizes[r["sequence_id"]] += r["length"]
    assert set(sizes.values()) == {32, 4, 1}


def test_a_window_is_closed_with_its_own_pieces():
    r = np.random.default_rng(4)
    packer = packing.Packer(64)
    for d in range(400):
        packer.add(d, r.integers(0, 9, int(r.integers(1, 64))).astype("<u4"))
    before = {doc: {d for d, *_ in pieces} for of in packer.at for _, pieces in of for doc, *_ in pieces}
    at, full = len(packer.rows), {}
    packer.finish()
    for doc, _, _, _, _, window, _ in packer.rows[at:]:
        full.setdefault(window, set()).add(doc)
    assert all(docs <= before[next(iter(docs))] for docs in full.values())


def test_padding_is_bounded_where_it_is_asked_for(docs):
    found = packing.pack(docs, PLAIN, P.PATTERN, pad_from=0.75).groupBy("sequence_id").sum("length").collect()
    sizes = [r[1] for r in found]
    assert all(n >= 768 or n & (n - 1) == 0 for n in sizes) and any(n & (n - 1) for n in sizes)
