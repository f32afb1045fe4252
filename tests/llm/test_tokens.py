"""Token counts and packing against the libraries run over whole texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from lumenfold.llm import packing
from lumenfold.llm.tokencount import PieceCounter, count_tokens

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "  a  b ", "x" * 900, "é́ ÀÉ ßΣς İ ǅ", "tab\tnew\nline\r\n end", "a\x1cb c d", "<|endoftext|> <|startoftext|>x", "don't we'll '' 12 3½ ²", "日本語 テキスト 😀😀", "</s>[INST] <unk> ▁▁ ▁a", "!!%%% A!! ENES!!", "the the the"]


def noisy(rng: random.Random, n: int) -> str:
    alphabet = ["the ", "of ", "en", "tion", "é", "ñ", " ", "  ", "\n", "😀", "ü", "a", "b", "!!", "0", "▁", "x" * 9]
    return "".join(rng.choice(alphabet) for _ in range(n))


def rows(spark):
    rng = random.Random(1)
    texts = ODD + [noisy(rng, n) for n in (10, 400, 4000, 30000)] + [noisy(rng, 50).replace(" ", "") * 900]
    data = [(i, t, "clash", 7) for i, t in enumerate(texts)] + [(None, "no id", "x", 1), (3, ODD[3], "repeat", 2)]
    return spark.createDataFrame(data, "doc_id long, text string, id string, n_tokens int"), data


def test_resynchronised_counts_equal_whole_text():
    own, sp, rng = PieceCounter(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(2)
    for n in (50, 300, 2000):
        for text in (noisy(rng, n), noisy(rng, n).replace(" ", ""), "ab" * n, "x" * n, " " * n, "é😀" * n):
            assert own.count_huge(text, chunk=60, overlap=4) == len(sp.encode(text)), text[:80]


def test_count_tokens(spark):
    df, data = rows(spark)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(map(tuple, count_tokens(df, MODEL, huge=2000, overlap=16).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t, *_ in data]
    assert got == sorted(want, key=str)
    assert count_tokens(df.limit(0), MODEL).collect() == []


def test_pack_texts_covers_each_id_once(spark):
    df, data = rows(spark)
    tokenizer = Tokenizer.from_file(WORDS)
    limits = packing.Limits(tokens=64, segments=5, loss_tokens=64, window=16)
    got = [r.asDict() for r in packing.pack_texts(df, WORDS, limits=limits, with_ids=True).collect()]
    want = defaultdict(list)
    for i, t, *_ in data:
        want[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["input_ids"], "<u4").tobytes()) and len(r["input_ids"]) == r["length"]
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append(r)
    assert set(pieces) == set(want)
    for i, wanted in want.items():
        assert sum(r["length"] for r in pieces[i]) == sum(map(len, wanted))
        joined = [x for r in sorted(pieces[i], key=lambda r: (r["start"], r["sequence_id"])) for x in r["input_ids"]]
        assert joined == (wanted[0] if len(wanted) == 1 else joined)
    for rs in bins.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == list(np.cumsum([0, *(r["length"] for r in rs)])[:-1])
        assert sum(r["length"] for r in rs) <= 64 and len(rs) <= 5
    assert packing.pack_texts(df.limit(0), WORDS).collect() == []


def test_pack_tokens_obeys_all_limits(spark):
    rng = random.Random(3)
    data = [(i, [rng.randrange(9) for _ in range(n)], [rng.random() < 0.5 for _ in range(n)]) for i, n in enumerate([0, 1, 31, 32, 33, 200, *[rng.randrange(1, 30) for _ in range(200)]])]
    df = spark.createDataFrame([*data, (900, None, None), (901, [1, 2, 3], None)], "doc_id long, input_ids array<int>, mask array<boolean>")
    out = packing.pack_tokens(df, loss_col="mask", limits=packing.Limits(tokens=32, segments=4, loss_tokens=10, window=64))
    bins = defaultdict(lambda: np.zeros(3, int))
    back = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: (r.doc_id, r.start)):
        bins[r.sequence_id] += (r.length, 1, sum(r.loss_mask))
        back[r.doc_id] += list(zip(r.input_ids, r.loss_mask, strict=True))
    assert all((b <= (32, 4, 10)).all() for b in bins.values())
    assert back == {i: list(zip(ids, mask, strict=True)) for i, ids, mask in data if ids} | {901: [(1, False), (2, False), (3, False)]}
    whole = packing.sequences(out, tokens=32).collect()
    assert all(len(r.input_ids) == 32 or len(r.input_ids).bit_count() == 1 for r in whole)


def test_dot_product_bins_fill():
    rng = np.random.default_rng(4)
    demand = np.column_stack([rng.integers(1, 4097, 3000), np.ones(3000), rng.integers(0, 400, 3000)]).astype(float)
    bins = packing.dot_product_bins(demand, np.array([4096.0, 64, 4096]))
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert demand[:, 0].sum() / (4096 * len(bins)) > 0.97


def test_long_runs_without_boundaries_are_encoded_once(monkeypatch):
    """Text that can't be spliced costs about what the library takes, and counts the same."""
    own = PieceCounter(MODEL)
    read = []
    starts = own._starts
    monkeypatch.setattr(own, "_starts", lambda text: read.append(len(text)) or starts(text))
    for text in ("a" * 400_000, " " * 300_000, "x y " * 3000 + "b" * 200_000 + " z w" * 3000, "ab" * 100_000):
        read.clear()
        assert own.count_huge(text) == len(own.sp.encode(text))
        assert sum(read) < 6 * len(text)


def test_letters_are_held_once(monkeypatch):
    """A word's letters are merged once, alone or beside punctuation, and ids are the library's."""
    own, tokenizer = packing.WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    merged = []
    real = own._merged
    monkeypatch.setattr(own, "_merged", lambda text: merged.append(text) or real(text))
    text = "plinth plinth, (plinth) plinth's Plinth plinth. naïve naïve! x" + "y" * 999 + " " + "z" * 1001
    assert own.text(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert merged.count("plinth") == 2 and "plinth" not in own.pieces  # once more for the capital
