import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sigloom.llm import packing
from sigloom.llm.entries import op4_best_fit_packing
from sigloom.llm.packing import Encoder, _better, _meets, pack, plan

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["It's  they'll\n\n\tgo!!", "  lead and trail  ", "émile 😀😀 ß ٣٤ 12a", "!'s ...'re  ''d", "<|endoftext|> text", "a b c\r\n", "\x00\x01", "日本語、です。", "", "a\x1cb \x1d c", "x\x85y", "²³ Ⅷ½ a1", "\u2028 a\u00a0b  \u3000", "\0whole a"]


def brute(rows, tokenizer):
    out = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        out += [(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return sorted(out, key=repr)


def test_encoder_agrees_with_the_tokenizer():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    ids, ends = Encoder(VOCABULARY).encode(ODD)
    got = [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in ODD]


random.seed(3)
CASES = {
    "mixed": [(i, " ".join(random.choices(["word", "other", "é", "x,"], k=random.choice([1, 5, 80, 400, 900, 3000])))) for i in range(150)],
    "odd": list(enumerate(ODD)) + [(None, None), (None, "a"), (3, "a"), (3, "a")],
    "exact sizes": [(1, "a" + " a" * 1022), (2, "a" + " a" * 1023), (3, "a" + " a" * 2046), (4, "a" + " a" * 5000)],
    "empty": [],
}


@pytest.mark.parametrize("case", CASES)
def test_packs(spark, case):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    docs = spark.createDataFrame(CASES[case], "doc_id long, text string").repartition(3).withColumns({"length": F.lit("x"), "part": F.lit(1), "piece": F.lit(2)})
    rows = pack(docs, VOCABULARY).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == brute(CASES[case], tokenizer)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for o, n in sorted(placed):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 1024) * 1.1 + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plans_hold_every_piece_once(counts):
    bins = plan(counts, 64)
    held = Counter()
    for kind, many in bins:
        assert sum(kind) <= 64
        held.update({n: c * many for n, c in Counter(kind).items()})
    assert held == Counter(counts)
    size = sum(n * c for n, c in counts.items())
    assert sum(m for _, m in bins) <= 1 + 1.25 * size / 64 + sum(c for n, c in counts.items() if n > 32)


def test_swaps_empty_bins():
    bins = dict(plan({6: 2, 5: 2, 4: 2, 3: 2, 2: 2}, 10))
    assert sum(bins.values()) == 4


def steps_left(bins, capacity):
    open_ = [(k, n) for k, n in bins if sum(k) < capacity]
    return [(a, b) for a, n in open_ for b, _ in open_ if sum(a) >= sum(b) and (a != b or n > 1) and _better(a, b, capacity - sum(a))]


@pytest.mark.parametrize("seed", range(4))
def test_plans_end_where_no_bins_have_a_step(seed):
    pick = random.Random(seed)
    counts = {n: pick.randint(1, 60) for n in pick.sample(range(60, 500), 150)}
    bins = plan(counts, 1024)
    assert sum(m for _, m in bins) == -(-sum(n * c for n, c in counts.items()) // 1024) or not steps_left(bins, 1024)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=6), st.lists(st.integers(1, 20), min_size=1, max_size=6))
def test_bits_tell_whether_there_is_a_step(a, b):
    a, b = tuple(sorted(a, reverse=True)), tuple(sorted(b, reverse=True))
    assert _meets(a, b, 128) == (_better(a, b, 128 - sum(a)) is not None)


MARKED = ["a <|endoftext|> b", "a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|>\n y", "<|endoftext |> é", "It's <|endoftext|> é\x1c", "plain"]


def test_the_query_takes_added_tokens_as_the_library_does(spark, tmp_path):
    rows = list(enumerate(MARKED))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r)[:5] for r in op4_best_fit_packing(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows, Tokenizer.from_file(VOCABULARY))
    ids, ends = Encoder(VOCABULARY, added=True).encode(MARKED[:1])
    assert ids.tolist() == [64, 220, 50256, 275]


def test_common_parts_are_merged_once_however_many_rare_ones_come(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 200)
    encoder, merged, tokenizer = Encoder(VOCABULARY), Counter(), Tokenizer.from_file(VOCABULARY)
    merge = encoder.merge
    encoder.merge = lambda signs: merged.update([signs]) or merge(signs)
    for k in range(40):
        texts = [" the of and in" * 3 + "".join(f" {n}" for n in range(100 * k, 100 * k + 100)), "the\x1cof", ""]
        ids, ends = encoder.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.number) <= 310
    assert [merged[f"Ġ{w}"] for w in ("the", "of", "and", "in")] == [1, 1, 1, 1]


SIGNS = "'  \n\tsdmtrevlSD .,!12²½\xa0é’…—–€ªßÿĀɏ\u2010\0"
OURS, THEIRS = Encoder(VOCABULARY, added=True), Tokenizer.from_file(VOCABULARY)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.text(SIGNS, max_size=12), st.text(st.characters(max_codepoint=0x24F), max_size=8), st.text(max_size=6)), max_size=4))
def test_every_kind_of_text_gets_the_ids_of_the_library(texts):
    ids, ends = OURS.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == [THEIRS.encode(t, add_special_tokens=False).ids for t in texts]


def test_classes_of_plain_characters_are_those_of_unicode():
    import regex

    plain = regex.findall(f"[{packing.PLAIN}]", "".join(map(chr, range(0x3000))))
    for own, theirs in ((packing.LETTERS, r"\p{L}"), (packing.NUMBERS, r"\p{N}"), (packing.SPACES, r"\s")):
        assert regex.findall(f"[{own}]", "".join(plain)) == regex.findall(theirs, "".join(plain))
