import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import AWKWARD, documents, prose
from tokenizers import Tokenizer

from twinweave.llm import packing
from twinweave.llm.packing import Plan, combinations, encoder, nnls, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, got, window=2048):
    library = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for r in rows:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        want[r[0], ids] += 1
    sequences = defaultdict(list)
    seen = defaultdict(int)
    for p in got:
        sequences[p.sequence_id].append((p.offset, p.length))
        assert any(k[0] == p.doc_id and len(k[1]) == 4 * p.doc_tokens and zlib.crc32(k[1][4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for k in want)
        seen[p.doc_id] += p.length
    total = defaultdict(int)
    for (doc_id, ids), n in want.items():
        total[doc_id] += n * len(ids) // 4
    assert seen == total
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_round_trip(spark):
    rng = random.Random(6)
    rows = [(100 + i, prose(rng, rng.choice([0, 3, 50, 400, 2500]))) for i in range(60)] + [(200, prose(rng, 200) * 3)] * 3 + AWKWARD
    assert check(rows, pack(documents(spark, rows).repartition(5), PATH).collect()) == 0


def test_small_and_empty(spark):
    assert pack(documents(spark, []), PATH).collect() == []
    assert check([(1, None)], pack(documents(spark, [(1, None)]), PATH).collect()) == 0


def test_encoder_equals_the_library():
    library, rng = Tokenizer.from_file(PATH), random.Random(8)
    texts = ["".join(rng.choice(" \n'sreEllVİΣßé́日🙂12! \x1d<|endoftext|>") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["a<|endoftext|>b c", "İstanbul ΣΑΣ ẞ ﬁ Ǆ", "Éa"]
    for t in texts:
        assert np.frombuffer(encoder(PATH).encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_plain_characters_split_as_in_the_library():
    library, rng = Tokenizer.from_file(PATH), random.Random(5)
    plain = [chr(i) for low, high in packing.PLAIN for i in rng.sample(range(low, high), min(high - low, 120))]
    common = list(" \n\t\xa0'''stmdrevlSTMDREVL1a-.\"")
    texts = ["".join(rng.choice(plain if rng.random() < 0.3 else common) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(plain), "'s", "''s", "a's't've 're'll'd'", "--'s", "1's", "'LL'", "x" * 300]
    got = packing.Encoder(PATH).encode_all(texts)
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    library, rng = Tokenizer.from_file(PATH), random.Random(7)
    texts = [" ".join(rng.choice(["alpha", "b's", "é", "日本", "🙂", "1234", "y" * 70]) for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["z" * 400, " " * 300, ""]
    got = packing.Encoder(PATH).encode_all(texts)
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError, match="folding"):
        packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["vocab"]["zzzz</w>"] = 70_000
    (tmp_path / "x.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="65535"):
        packing.Encoder(str(tmp_path / "x.json"))


def test_combinations_are_bounded_but_lose_nothing():
    """THIRDS and steps bound the plan: any histogram is placed whole, each sequence gapless."""
    rng = np.random.default_rng(3)
    histogram = np.concatenate([[0], rng.integers(0, 40, 127)])
    for thirds in (1, 8, 128):
        assert all(sum(c) == 128 for c in combinations(np.arange(1, 128), 128, thirds).tolist())
    plan, sequences = Plan(histogram, 128), defaultdict(list)
    for length in range(1, 128):
        for rank in range(int(histogram[length])):
            for n, sequence, offset in plan.place(length, rank):
                sequences[sequence].append((offset, n))
    assert sum(n for own in sequences.values() for _, n in own) == int((histogram * np.arange(128)).sum())
    for own in sequences.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist()


def test_least_squares_uses_complements():
    histogram = np.zeros(64, np.int64)
    histogram[[10, 54, 20, 24]] = [5, 5, 8, 4]
    parts = combinations(np.array([10, 20, 24, 54]), 64)
    x = nnls(parts, histogram)
    assert (x >= 0).all()
    used = sum(np.bincount(parts[:, k], x * (parts[:, k] > 0), 64) for k in range(3))
    assert np.allclose(used[[10, 54, 20, 24]], [5, 5, 8, 4], atol=0.05)
    plan = Plan(histogram, 64)
    assert plan.line_length == 0
    assert plan.sequences == 9
