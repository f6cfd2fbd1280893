import zlib
from collections import defaultdict

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pointloom.llm import packing


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_places_never_overlap_and_leave_no_gap(lengths):
    bins, offsets = packing.place(np.array(lengths, dtype=np.int64), 64)
    parts = defaultdict(list)
    for n, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        parts[b].append((o, n))
    for p in parts.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 64
    assert len(parts) <= max(-(-2 * sum(lengths) // 64), 1) + 1


def test_the_rule_chooses_the_least_sum_of_squares():
    """Each step against an enumeration of all open gaps."""
    rng, choices = np.random.default_rng(31), 0
    for _ in range(60):
        capacity = int(rng.integers(8, 40))
        lengths = rng.integers(1, capacity, int(rng.integers(1, 60)))
        bins, offsets = packing.place(lengths, capacity)
        gaps: dict[int, int] = {}
        for i in np.argsort(-lengths, kind="stable").tolist():
            s, chosen = int(lengths[i]), int(bins[i])
            fits = [b for b, g in gaps.items() if g >= s]

            def squares(b, s=s):
                after = Counter(g - s * (k == b) for k, g in gaps.items())
                return sum(n * n for g, n in after.items() if g)

            if fits:
                assert chosen in fits and squares(chosen) == min(map(squares, fits))
                assert offsets[i] == capacity - gaps[chosen]
                choices += len({squares(b) for b in fits}) > 1
            else:
                assert chosen == len(gaps) and offsets[i] == 0
            gaps[chosen] = gaps.get(chosen, capacity) - s
    assert choices > 100


def test_ids_of_runs_equal_those_of_whole_texts():
    tok = Tokenizer.from_file(packing.public_vocabulary())
    texts = ["", "Hello, World! It's 12.5% and don't'LL", "été İstanbul ŉ  nbsp wide", "a<|endoftext|>b <|startoftext|>", "\x1c\x00 \x85 é ñ", "ΑΣ Σ straße ﬁ 漢字 кот"]
    for t, ids in zip(texts, packing._ids([t.encode() for t in texts], packing.public_vocabulary()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_documents_come_back_whole(spark, docs_of, odd_rows):
    tok = Tokenizer.from_file(packing.public_vocabulary())
    got = packing.pack_documents(docs_of(odd_rows), capacity=256).collect()
    docs = defaultdict(list)
    for r in got:
        docs[r.doc_id].append((r.piece, r.start, r.length, bytes(r.ids)))
        assert r.length == len(r.ids) // 4 <= 256
    for i, t in odd_rows:
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        if i != 4:
            pieces = sorted(docs[i])
            assert [s for _, s, _, _ in pieces] == list(range(0, len(want), 256))
            assert np.frombuffer(b"".join(b for *_, b in pieces), "<u4").tolist() == want
    assert len(docs[4]) == 3
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for p in filled.values():
        p.sort()
        assert [o for o, _ in p] == np.concatenate([[0], np.cumsum([n for _, n in p])[:-1]]).tolist() and sum(n for _, n in p) <= 256
    digest = {(r.doc_id, r.piece, r.ids_crc32) for r in packing.packed_digest(docs_of(odd_rows), capacity=256).collect()}
    assert digest == {(r.doc_id, r.piece, zlib.crc32(bytes(r.ids))) for r in got}


def test_empty_table_and_too_long_piece(docs_of):
    assert packing.pack_documents(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        packing.place(np.array([11]), 10)
