import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import kernels as k
from tessera.llm import neardup, perplexity, rules
from tessera.llm import ngram_lm as lm

texts = st.lists(st.text("aB é\t\n.#", max_size=30) | st.none(), min_size=1, max_size=6)


def one_slice(values):
    got = list(k.slices(pa.array(values, pa.string()), 1 << 20))
    assert len(got) == 1
    return got[0][2:]


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words_are_those_of_the_pattern(values):
    data, offsets = one_slice(values)
    for table, pattern, lower in ((k.BLANK_WORDS, r"[^\x20\x09-\x0D]+", False), (k.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        w = k.Words(data, offsets, table, lower=lower)
        raw = data.tobytes()
        fold = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)}) if lower else {}
        want = [re.findall(pattern, (v or "").translate(fold)) for v in values]
        assert w.n.tolist() == [len(x) for x in want]
        flat = [x for ws in want for x in ws]
        assert [raw[a:b].decode().translate(fold) for a, b in zip(w.starts, w.ends)] == flat
        assert len(set(w.h.tolist())) == len(set(flat))
        h, fits = w.windows(3)
        whole = [tuple(ws[i : i + 3]) for ws in want for i in range(len(ws) - 2)]
        assert fits.sum() == len(whole) and len(set(h[fits].tolist())) == len(set(whole))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=40), st.integers(1, 12))
def test_sliding_minimum(x, width):
    got = k.sliding_min(np.array(x, np.uint64), width).tolist()
    assert got == [min(x[i : i + width]) for i in range(len(x) - width + 1)]


def test_slices_cover_all_rows():
    values = ["x" * 50, None, "", "y" * 300, "z"]
    rows = [(lo, hi) for lo, hi, _, _ in k.slices(pa.array(values), 100)]
    assert rows[0][0] == 0 and rows[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(rows, rows[1:]))
    assert list(k.slices(pa.array([], pa.string()))) == []


@settings(max_examples=60, deadline=None)
@given(texts)
def test_base_counts(values):
    data, offsets = one_slice(values)
    _, (n, chars, symbols, dup, repeat) = perplexity.base_counts(data, offsets)
    for i, v in enumerate(values):
        w = re.findall(r"[^\x20\x09-\x0D]+", v or "")
        lines = [x for x in (v or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        wins = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        hit = set()
        for j, x in enumerate(wins):
            if wins.count(x) > 1:
                hit |= set(range(j, j + 8))
        assert (n[i], chars[i], symbols[i], dup[i], repeat[i]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", v or "")), len(lines) - len(set(lines)), len(hit))
    assert rules.statistics(data, offsets).shape == (len(values), len(rules.STATISTICS))


def test_grams_are_the_last_bytes():
    data, offsets = one_slice(["abcdef", "", "z"])
    g = lm.grams(data, offsets, np.array([0, 0, 3]))
    assert [int(x & ((1 << 40) - 1)).to_bytes(5, "big") for x in g] == [b"\n\n\n\na", b"\n\n\nab", b"\n\nabc", b"\nabcd", b"abcde", b"bcdef", b"\n\n\n\nz"]
    assert int(g[-1] >> np.uint64(40)) == 3 and int(g[0] >> np.uint64(40)) == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    words = [str(x) for x in rng.integers(0, 10**6, 3000)]
    other = words[:2700] + [str(x) for x in rng.integers(0, 10**6, 300)]
    data, offsets = one_slice([" ".join(words), " ".join(other)])
    w = k.Words(data, offsets, k.BLANK_WORDS)
    h, first = neardup._shingles(w, 3)
    a, b = set(h[: first[1]].tolist()), set(h[first[1] :].tolist())
    same = [min((x ^ int(p)) * int(o) % 2**64 for x in a) == min((x ^ int(p)) * int(o) % 2**64 for x in b) for p, o in zip(neardup.XOR, neardup.ODD)]
    assert abs(sum(same) / 32 - len(a & b) / len(a | b)) < 0.25


def test_sha_of_joined_words():
    text = " a\tb\n\n c d "
    assert hashlib.sha256(b" ".join(text.encode().split())).hexdigest() == hashlib.sha256("a b c d".encode()).hexdigest()
