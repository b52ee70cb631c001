"""Very long texts in language ID and MinHash, a part at a time."""

import resource
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from fragmatch.llm import langid, minhash
from fragmatch.llm.arrow import utf8


def prose(seed, n, spread=400):
    r = np.random.RandomState(seed)
    words = ["".join(r.choice(list("abcdeéß漢 zK"), r.randint(1, 9))) for _ in range(spread)]
    return " ".join(r.choice(words, n))


def test_likelihoods_in_parts(monkeypatch):
    r = np.random.RandomState(0)
    model = langid.Model(["a", "b"], r.randn(1 << langid.BUCKET_BITS, 2).astype(np.float32), np.log([0.5, 0.5]), np.zeros((2, 2)))
    for n in (0, 1, 5, 900):
        text = pa.array([prose(n, n)])
        want = langid._plain_likelihoods(text, model)
        for limit in (7, 100, 1 << 19):
            monkeypatch.setattr(langid, "PART_BYTES", limit)
            got = langid._likelihoods(text, model)
            assert np.allclose(got[0], want[0], atol=1e-6) and (got[1] == want[1]).all()


def test_training_counts_in_parts(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array([prose(1, 700), "kurz", None]), pa.array(["x", "x", "y"])], names=["text", "lang"])
    table = lambda: {(r["lang"], r["bucket"]): r["n"] for b in langid._count([batch]) for r in b.to_pylist()}
    want = table()
    monkeypatch.setattr(langid, "PART_BYTES", 64)
    assert {k: n for k, n in table().items() if n} == want


@pytest.mark.parametrize("size", [1, 2, 5])
def test_shingle_sets_in_parts(monkeypatch, size):
    texts = [prose(2, 3000), "one", " ", "x" * 5000, "a b " + "y" * 700 + " c d e f", prose(3, 40) + " " * 900 + prose(4, 40)]
    whole = [minhash._shingles(*minhash.word_hashes(*utf8(pa.array([t]))), size)[0] for t in texts]
    monkeypatch.setattr(minhash, "PART_BYTES", 128)
    for t, want in zip(texts, whole):
        got, at = minhash.shingle_sets(*utf8(pa.array([t])), size)
        assert (got == want).all() and at.tolist() == [0, len(want)]


def test_fifty_megabytes_in_a_worker_of_one_gigabyte():
    code = """
import numpy as np, pyarrow as pa
from fragmatch.llm import langid, minhash
from fragmatch.llm.arrow import utf8
r = np.random.RandomState(0)
words = np.array(["".join(r.choice(list("abcdefgh"), 7)) for _ in range(5000)])
text = pa.array([" ".join(r.choice(words, 6_250_000))])
model = langid.Model(["a"], np.zeros((1 << langid.BUCKET_BITS, 1), np.float32), np.zeros(1), np.zeros((1, 1)))
assert langid._likelihoods(text, model)[1][0] > 140_000_000
values, at = minhash.shingle_sets(*utf8(text), 5)
assert at[1] > 6_000_000
minhash.minhashes(values, at)
import resource
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=minhash.__file__.rsplit("/", 3)[0])
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 1024 and resource.RUSAGE_SELF == 0
