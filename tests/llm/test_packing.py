import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kelpline.llm import packing
from kelpline.llm.queries import tokenizer_path


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_encoder_gives_the_tokenizers_ids():
    texts = ["It's  a\n\ntest", "", "ünïcode ’quotes’ 123 €", "a <|endoftext|> b", "　 x y \U0001f600" * 3, "zzzz" * 5000]
    encode = packing.encoder(tokenizer_path())
    assert [[*encode(x), 0] for x in texts] == reference_ids(texts)


def test_encoder_gives_the_tokenizers_ids_for_every_code_point():
    from tokenizers import Tokenizer

    slow, encode = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(points), 4000):
        own = points[at : at + 4000]
        texts = ["".join(form.format(c) for c in own) for form in ("a{0}b ", "1{0}2{0}{0}", " {0}\n{0}'s")]
        assert [encode(x) for x in texts] == [e.ids for e in slow.encode_batch_fast(texts, add_special_tokens=False)], hex(at)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aZé9 \t\n\r\x0b\x1c\x85\u3000'sltdmrev.,#\u0301ß文\U0001f600"), max_size=60))
def test_encoder_gives_the_tokenizers_ids_for_any_mixture(text):
    assert [*packing.encoder(tokenizer_path())(text), 0] == reference_ids([text])[0]


@pytest.mark.parametrize("long", [" ", "\n", " \n", "\u3000", "-", "a", "ab1"])
def test_very_long_runs(documents, long):
    text = "x" + long * (1_000_000 // len(long)) + "y"
    out = packing.pack(documents([(1, text, "s")]), tokenizer_path()).toPandas().sort_values("piece")
    own = reference_ids([text])[0]
    assert out.length.sum() == len(own)
    assert [zlib.crc32(np.array(own[a : a + n], dtype="<u4").tobytes()) for a, n in zip(out.start, out.length, strict=True)] == out.ids_crc32.tolist()


def test_cut_makes_full_pieces_but_the_first():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(3, 4) == [(0, 3)]


def fewest(sizes, capacity):
    """Fewest bins by exhaustive search."""
    best = len(sizes)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for r in {*rooms}:
            if r >= sizes[k]:
                i = rooms.index(r)
                put(k + 1, [*rooms[:i], r - sizes[k], *rooms[i + 1 :]])
        put(k + 1, [*rooms, capacity - sizes[k]])

    put(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bin_completion_against_brute_force(sizes):
    sizes.sort(reverse=True)
    counts = np.bincount(sizes, minlength=21)
    plan = packing.bin_completion(counts, 20)
    assert Counter(s for items, times in plan for s in items * times) == Counter(sizes)
    assert all(sum(items) <= 20 for items, _ in plan)
    bins, least = sum(t for _, t in plan), fewest(sizes, 20)
    assert packing.waste_bound(counts, 20) <= least == bins


def test_branching_improves_on_best_fit():
    # best-fit decreasing needs three bins of 10 here
    counts = np.bincount([5, 4, 4, 3, 2, 2], minlength=11)
    assert sum(t for _, t in packing.best_fit(counts, 10)) == 3
    assert sum(t for _, t in packing.bin_completion(counts, 10)) == 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=30, max_size=200))
def test_many_small_items_reach_the_bound(sizes):
    counts = np.bincount(sizes, minlength=401)
    plan = packing.bin_completion(counts, 400)
    assert Counter(s for items, times in plan for s in items * times) == Counter(sizes)
    assert sum(t for _, t in plan) == packing.waste_bound(counts, 400)


def test_fillings_of_many_items_are_completed():
    counts = np.bincount([7] * 40 + [3] * 40, minlength=101)
    best = packing.fillings([3, 7], counts, 100)[0]
    assert sum(best) == 100 and len(best) > 8


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pack(documents, odd_rows, capacity):
    out = packing.pack(documents(odd_rows), tokenizer_path(), capacity).toPandas()
    ids = reference_ids([t for _, t, _ in odd_rows])
    whole = Counter((i, len(x)) for (i, _, _), x in zip(odd_rows, ids, strict=True))
    assert out.length.sum() == sum(map(len, ids))
    assert out[out.piece == 0].shape[0] == len(odd_rows)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= capacity
    assert (out[out.piece > 0].length == capacity).all()
    assert {(None if np.isnan(i) else int(i), n) for i, n in out.groupby("doc_id", dropna=False).length.sum().items()} <= {(i, n * k) for (i, n), k in whole.items()} | {(None, sum(n for (i, n) in whole if i is None))}
    one = out[out.doc_id == 6].sort_values("piece")
    own = ids[6]
    assert [zlib.crc32(np.array(own[s : s + n], dtype="<u4").tobytes()) for s, n in zip(one.start, one.length, strict=True)] == one.ids_crc32.tolist()


def test_pack_with_ids_and_of_nothing(documents):
    out = packing.pack(documents([(1, "a b c", "s")]), tokenizer_path(), 2, with_ids=True).toPandas().sort_values("piece")
    assert [i for x in out.token_ids for i in x] == reference_ids(["a b c"])[0]
    assert packing.pack(documents([]), tokenizer_path()).count() == 0


def test_a_hot_length_is_ranked_in_salted_groups(documents, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 5)
    rows = [(i, "same text" if i % 3 else f"text {i} " * (i % 7 + 1), "s") for i in range(200)] + [(1, "same text", "s")] * 40
    out = packing.pack(documents(rows), tokenizer_path(), 16).toPandas()
    assert out[out.piece == 0].shape[0] == len(rows)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 16


def test_rows_alike_in_all_are_salted_too(documents, monkeypatch):
    """Each task's pieces of a length are dealt out in turn, whatever the rows hold."""
    monkeypatch.setattr(packing, "RANK_GROUP", 10)
    same = packing.pieces(documents([(None, "same text", "s")] * 100).coalesce(1), tokenizer_path())
    assert sorted(r.turn for r in same.collect()) == list(range(100))
    out = packing.pack(documents([(None, "same text", "s")] * 100), tokenizer_path(), 16).toPandas()
    assert len(out) == len(set(zip(out.sequence_id, out.offset, strict=True))) == 100
