import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from cases import AWKWARD, documents, prose
from tokenizers import Tokenizer

from twinweave.llm import token_counts as token_counts_module
from twinweave.llm.token_counts import CHUNK, compiled, count_group, piece_starts, scan_maps, split_transducer, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def counts(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_librarys(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\t'relvsmtdLL12aZ!é日🙂 ") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert count_group(texts, PATH) == counts(library, texts)


def test_chunks_compose_across_their_ends(library):
    texts = ["a" * (CHUNK - 2) + "'re  \n x" + "b" * CHUNK + "   'll", " " * (3 * CHUNK) + "x", "'" * (2 * CHUNK + 1)]
    assert count_group(texts, PATH) == counts(library, texts)


def test_long_texts_in_stretches(library, monkeypatch):
    """Every place of a stretch's end, with pieces inside, across and over several stretches."""
    rng = random.Random(9)
    texts = ["".join(rng.choice(["a", "the", " ", "  ", "'re", "'", "'v", "12", "!", "\n", "日本", "z" * 40]) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    texts += ["x" * 500, "a" * 997, " " * 300, "ab" * 301 + " " + "é" * 333, "'" * 200 + "s"]
    for size in (1, 7, 64):
        monkeypatch.setattr(token_counts_module, "GROUP", size)
        assert count_group(texts, PATH) == counts(library, texts), size


def test_chunk_maps_equal_a_run_from_the_start():
    model = compiled(PATH)[0].model
    rng = random.Random(4)
    for data in (b"a" * 3000, bytes(rng.choice(b"abcdefgh the") for _ in range(5000)), bytes(rng.randrange(256) for _ in range(2000)), b"ab" * 1500):
        state, total = 0, 0
        for b in data:
            at = model.columns_of(np.array([b]))[0]
            if model.next[state, at] < 0:
                model.move(state, b)
            state, total = int(model.next[state, at]), total + int(model.change[state, at])
        to, n = model.through(data)
        assert n == total
        assert model.states[to] == model.states[state]
        middle = model.through(data[:700])
        assert middle[1] + model.through(data[700:], middle[0])[1] == total


def test_states_start_afresh(library, monkeypatch):
    monkeypatch.setattr(token_counts_module, "STATES", 50)
    monkeypatch.setattr(token_counts_module, "LANES", 16)
    rng = random.Random(6)
    texts = [prose(rng, 40), "q" * 9000, "".join(rng.choice("abcxyz") for _ in range(9000))]
    assert count_group(texts, PATH) == counts(library, texts)


def test_one_long_text_is_read_in_bounded_memory(library):
    """20 million letters without white space."""
    code = f"""
import resource, sys
sys.path.insert(0, {str(Path(__file__).parents[2])!r})
from twinweave.llm.token_counts import count_group
count_group(["warm up"], {PATH!r})
text = "abcdefghij" * 2_000_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = count_group([text], {PATH!r})
print(n[0], (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    n, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=600).stdout.split())
    few, more = counts(library, ["abcdefghij" * 2_000, "abcdefghij" * 4_000])
    assert n == more + (more - few) * 998  # what 2,000 more of them add
    assert mb < 400, mb


def test_scan_is_composition():
    maps = np.random.default_rng(0).integers(0, 13, (37, 13)).astype(np.uint8)
    seen = np.arange(13)
    for m, got in zip(maps, scan_maps(maps), strict=True):
        seen = m[seen]
        assert (got == seen).all()


def test_transducer_is_total():
    nxt, out = split_transducer()
    assert nxt.shape == out.shape == (12, 13)
    assert nxt.max() < 13
    assert not piece_starts(np.zeros(0, np.uint8)).size


def test_operator(spark, library):
    rows = [*AWKWARD, (20, prose(random.Random(1), 3000))]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(documents(spark, rows), PATH).collect()), key=repr)
    n = counts(library, [r[1] or "" for r in rows])
    assert got == sorted(((r[0], len((r[1] or "").encode()), k, k > 1024) for r, k in zip(rows, n, strict=True)), key=repr)


def test_empty(spark):
    assert token_counts(documents(spark, []), PATH).collect() == []
