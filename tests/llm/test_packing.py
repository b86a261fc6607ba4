import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from lemmata.llm.packing import CAPACITY, END, WordTokenizer, cost, pack_documents, packed

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = ["áb.,", "»..", "X*** ", "don't", "12ab", "é,", "<|endoftext|>", "q<|startoftext|>z", "ﬁ", "a ́b", " k", "İx", "Σας", "\x1cfoo\x1dbar", "٣,", " ", "\n", "\t", "word", "ends."]


def test_remembered_words_equal_the_tokenizer():
    rng, t = random.Random(3), WordTokenizer(PATH)
    texts = ["".join(rng.choice(WORDS) for _ in range(12)) for _ in range(500)] + [""]
    got = t.encode(texts)
    assert [g.tolist() for g in got] == [[*t.tokenizer.encode(x, add_special_tokens=False).ids, END] for x in texts]


@pytest.mark.parametrize("seed", range(4))
def test_packed_fills_sequences(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 7, 100, 900, CAPACITY, CAPACITY + 1, 3 * CAPACITY + 5]) for _ in range(rng.randint(1, 300))]
    out = packed(sizes)
    seen, used, spent = {}, {}, {}
    for d, start, n, s, offset in sorted(out, key=lambda x: (x[3], x[4])):
        assert offset == used.get(s, 0) and n > 0
        used[s] = offset + n
        spent[s] = spent.get(s, 0) + cost(n)
        seen.setdefault(d, []).append((start, n))
    assert max(used.values()) <= CAPACITY
    assert sum(CAPACITY - u for u in used.values()) < CAPACITY
    for d, size in enumerate(sizes):
        at = 0
        for start, n in sorted(seen[d]):
            assert start == at
            at += n
        assert at == size
    assert packed([]) == []


def test_costs_are_balanced():
    rng = random.Random(9)
    sizes = [rng.randint(20, 1500) for _ in range(2000)]
    spent = {}
    for _, _, n, s, _ in packed(sizes):
        spent[s] = spent.get(s, 0) + cost(n)
    in_order, total = {}, 0
    for n in sizes:
        s = total // CAPACITY
        in_order[s] = in_order.get(s, 0) + cost(n)
        total += n
    assert np.std(list(spent.values())) < np.std(list(in_order.values()))


def test_pieces(spark):
    rows = [(1, "one two " * 9000, "x"), (2, None, "x"), (3, "", "x"), (4, "Hello, World", "x"), (4, "Hello, World", "x")]
    out = pack_documents(spark.createDataFrame(rows, "doc_id long, text string, extra string").coalesce(1), PATH).collect()
    t = WordTokenizer(PATH)
    for i, text, _ in {r[0]: r for r in rows}.values():
        ids = t.encode([text or ""])[0]
        mine = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["start"])
        if i == 4:
            assert len(mine) == 2
            mine = mine[:1]
        assert np.concatenate([r["ids"] for r in mine]).tolist() == ids.tolist()
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["doc_tokens"] == len(ids) and r["length"] == len(r["ids"])
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokenizers_of_either_kind(file):
    t = WordTokenizer(public_tokenizers.path(file))
    assert t.by_words == file.startswith("word")
    texts = ["Some  Words here,\nand There.", "", "  x", *WORDS]
    assert [g.tolist() for g in t.encode(texts)] == [[*t.tokenizer.encode(x, add_special_tokens=False).ids, END] for x in texts]
