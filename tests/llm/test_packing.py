import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from loam.llm import packing
from pyspark.sql import functions as F


class Plain:
    """Best-fit over a list of bins, with the same rule for closing."""

    def __init__(self, capacity, limit):
        self.capacity, self.limit, self.open, self.next = capacity, limit, [], 0

    def add(self, n):
        fit = [b for b in self.open if b[0] >= n]
        best = min((b[0] for b in fit), default=None)
        found = [b for b in fit if b[0] == best][-1] if fit else None
        if found:
            self.open.remove(found)
        else:
            found = [self.capacity, self.next]
            self.next += 1
        offset = self.capacity - found[0]
        found = [found[0] - n, found[1]]
        if found[0]:
            if len(self.open) >= self.limit:
                least = min(b[0] for b in self.open)
                self.open.remove([b for b in self.open if b[0] == least][-1])
            self.open.append(found)
        return found[1], offset


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80), st.integers(1, 6))
def test_bitset_against_a_list(lengths, limit):
    fast, plain = packing.BestFit(32, limit), Plain(32, limit)
    for n in lengths:
        assert fast.add(n) == plain.add(n)
        assert fast.open == len(plain.open) <= limit


def test_cut():
    assert packing.cut([0], 4) == [(0, 1)] and packing.cut([0] * 4, 4) == [(0, 4)]
    assert packing.cut([0] * 9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cut([0] * 8, 4) == [(0, 4), (4, 4)]


def test_ids_are_those_of_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    texts = ["", " ", "Hello  world\n\n\tx'll 123", "\U0001f600é<|endoftext|>\x00\x1c  a" * 3, "a" * 5000, "\n" * 300, "ß" * 100]
    import pyarrow.parquet as pq
    import os

    if os.path.exists(p := "/root/testdata/sf0.01/documents.parquet"):
        texts += pq.read_table(p, columns=["text"]).column(0).to_pylist()
    fast = packing.Encoder()
    assert [fast.encode(t) for t in texts] == [e.ids for e in slow.encode_batch(texts, add_special_tokens=False)]


def test_table(docs):
    from tokenizers import Tokenizer

    texts = [None, "", "short", "long text " * 3000] + [f"text {i} " * (i % 50) for i in range(300)] + ["same"] * 40 + ["a<|endoftext|>b", "<|endoftext|>" * 90]
    df = docs(texts).withColumns({"piece": F.lit(1), "salt": F.lit(2), "length": F.lit(3)})
    got = packing.pack(df, capacity=64, open_bins=8, per_packer=100).toPandas()
    contract = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    for i, text in enumerate(texts):
        ids = np.array([*contract.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and list(zip(own.start, own.length, strict=True)) == packing.cut(list(ids), 64)
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)]
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.concatenate([[0], s.length.cumsum().to_numpy()[:-1]])).all() and s.length.sum() <= 64
    assert got.sequence_id.nunique() <= 1.25 * got.length.sum() / 64
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.pack(docs([(None, "x"), (1, "y"), (1, "y")])).count() == 3


def test_added_tokens_and_long_runs_are_encoded_by_the_contract(docs):
    from tokenizers import Tokenizer

    contract = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world", "<|endoftext|>" * 3, "a<|endoftext|", "\n" * 1_000_000 + "a", "b" + " \t" * 600_000, "é" * 200_000, "plain", ""]
    want = [contract.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [31373, 220, 50256, 995]
    encoder = packing.Encoder()
    assert [encoder.encode(t) for t in texts] == want
    got = packing.pack(docs(texts[:3]), capacity=64).toPandas().sort_values("doc_id")
    assert got.length.tolist() == [len(ids) + 1 for ids in want[:3]]
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array([*ids, 0], "<u4").tobytes()) for ids in want[:3]]
