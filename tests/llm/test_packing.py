import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from glyphlake.llm.packing import cut, pack_best_fit, plan_best_fit, token_ids


def test_ids_equal_the_json_tokenizer():
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ["Hello world", "é à  ç\n\n x", "<|endoftext|>", "a<|endoftext|> b", "漢字 🙂 \t\t tabs", "x" * 3000, " " * 500, "don't WE'LL 123456"]:
        assert token_ids(text, "byte_bpe_50k") == exact.encode(text, add_special_tokens=False).ids


def test_plan_is_a_partition_and_near_the_bound():
    rnd = random.Random(3)
    for _ in range(50):
        counts = {n: rnd.randint(1, 400) for n in rnd.sample(range(1, 101), rnd.randint(1, 40))}
        plan, total = plan_best_fit(counts, 100)
        filled: dict = {}
        for n, c in counts.items():
            ranks = []
            for rank, k, first, off in plan[n]:
                ranks += range(rank, rank + k)
                for s in range(first, first + k):
                    filled.setdefault(s, []).append((off, n))
            assert sorted(ranks) == list(range(c))
        assert sorted(filled) == list(range(total))
        for parts in filled.values():
            at = 0
            for off, n in sorted(parts):
                assert off == at
                at += n
            assert at <= 100
        bins: list = []  # document by document
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fits = [b for b in range(len(bins)) if bins[b] >= n]
            if fits:
                bins[min(fits, key=lambda b: bins[b])] -= n
            else:
                bins.append(100 - n)
        assert total == len(bins)


def test_pieces_and_places(make_docs, odd_docs):
    out = pack_best_fit(make_docs(odd_docs, clash=True), window=256, spread=4).collect()
    expected = []
    for doc, text in odd_docs:
        ids = np.array([*token_ids(text, "byte_bpe_50k"), 2], dtype="<u4")
        expected += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), 256))]
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(expected, key=str)
    places: dict = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 256
    assert len(places) <= -(-sum(r.length for r in out) // 256) * 1.1 + 1


def test_empty_table(make_docs):
    assert pack_best_fit(make_docs([])).collect() == []
