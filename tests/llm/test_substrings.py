import hashlib
import random

import numpy as np

from glyphlake.llm import recompress
from glyphlake.llm.substrings import remove_repeats, words_of


def brute(rows, width):
    least: dict = {}
    for i, t in rows:
        w = words_of(t)
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, t in rows:
        w, gone = words_of(t), set()
        if i is not None:
            for k in range(len(w) - width + 1):
                if least[tuple(w[k : k + width])] < i:
                    gone |= set(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs, width):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs, width=width).collect()), key=str)


def test_against_brute_force(make_docs, odd_docs):
    assert run(make_docs(odd_docs, clash=True), 50) == brute(odd_docs, 50)


def test_periodic_and_small_alphabets(make_docs):
    rnd = random.Random(8)
    rows = []
    for k in range(60):
        voc = ["a", "b"] if k % 3 == 0 else ["x"] if k % 3 == 1 else [f"w{j}" for j in range(6)]
        rows.append((rnd.randint(0, 50), " ".join(rnd.choice(voc) for _ in range(rnd.randint(0, 90)))))
    base = " ".join(f"u{rnd.randint(0, 30)}" for _ in range(120)).split()
    for k in range(30):
        a, b = sorted(rnd.sample(range(120), 2))
        rows.append((100 + k, " ".join([*(f"v{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 9))), *base[a:b], *(f"v{rnd.randint(0, 99)}" for _ in range(5))])))
    for width in (5, 12):
        assert run(make_docs(rows), width) == brute(rows, width)


def test_equal_windows_choose_equal_anchors():
    rnd = random.Random(1)
    hashes = recompress.WordHashes()
    for _ in range(60):
        voc = [b"w%d" % k for k in range(rnd.choice([1, 2, 3, 10, 1000]))]
        base = [rnd.choice(voc) for _ in range(rnd.randint(50, 150))]
        docs = [[rnd.choice(voc) for _ in range(rnd.randint(0, 30))] + base[rnd.randint(0, 10) :] + [rnd.choice(voc) for _ in range(rnd.randint(0, 30))] for _ in range(3)]
        n = sum(map(len, docs)) + len(docs) + 1
        word, is_word, starts, at = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool), [], 1
        for d in docs:
            word[at : at + len(d)], is_word[at : at + len(d)] = hashes.of(d), True
            starts += range(at, at + len(d) - 49)
            at += len(d) + 1
        for v in recompress.levels(word, is_word, 8):
            assert (np.diff(v.low) >= 0).all() and (np.diff(v.high) >= 0).all()
        if not starts:
            continue
        starts = np.array(starts)
        name, place = recompress.anchors(word, is_word, starts, 50, 8)
        h = recompress.window_hashes(word, 50, 0x5851F42D4C957F2D)
        seen: dict = {}
        for s, a, p in zip(starts, name, place, strict=True):
            value = (a, p - s, h[s])
            assert seen.setdefault(word[s : s + 50].tobytes(), value) == value


def test_long_texts_in_parts():
    from glyphlake.llm.substrings import _pieces

    words = [b"%d" % k for k in range(1000)]
    parts = list(_pieces(words, 50, 200))
    windows = [at + k for at, p in parts for k in range(len(p) - 49)]
    assert windows == list(range(951)) and all(words[at : at + len(p)] == p for at, p in parts)


def test_empty_table(make_docs):
    assert remove_repeats(make_docs([])).collect() == []
