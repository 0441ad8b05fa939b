"""BPE encoding/decoding and packing against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chorus.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
DDL = "doc_id long, text string, ids string, decoded string, sequence_id int"  # clashing extra columns


def odd_texts():
    rng = random.Random(3)
    pools = [list("aaabcdeé!!'s "), [chr(i) for i in range(0x250)], ["<|endoftext|>", "<|startoftext|>", " the ", "’ll", "12½²"],
             list("ΑΣςİıßſKÅé́日本語😀\x1c\x1f\x85\xa0　")]
    out = ["", " ", "!!!!", "aaaaaaaaaaaaaaaaaaaa", "don't can'tx 's''s", "the " * 3000, "x" * 5000, None]
    return out + ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 40))) for _ in range(400)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(odd_texts())]
    rows += [rows[20], (None, "no id", None, None, None)]  # a repeated row and a null id
    return spark.createDataFrame(rows, DDL)


def test_bpe_equals_library(spark, docs):
    library = Tokenizer.from_file(PATH)
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_lower_rank_becoming_active_goes_first():
    b = bpe.PairIndexBpe(PATH)
    library = Tokenizer.from_file(PATH)
    words = ["abab" * 5, "nnnnn", "mississippi", "thththth", "inininin", "!?!?!?!"]
    assert [len(c) // 4 for c in b.encode_words(words)] == [len(library.encode(w).ids) for w in words]
    assert b.encode_words([]) == []


def test_bpe_empty_table(spark, docs):
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).collect() == []


@pytest.mark.parametrize("size,windows", [(2048, 16), (64, 3)])
def test_packing_is_whole_and_tight(spark, docs, size, windows):
    library = Tokenizer.from_file(PATH)
    rows = packing.pack(docs.repartition(5), PATH, size=size, open_windows=windows).collect()
    want = defaultdict(list)
    for r in docs.collect():
        want[r["doc_id"]].append(library.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    ids = lambda r: [int.from_bytes(r["ids"][i:i + 4], "little") for i in range(0, len(r["ids"]), 4)]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["start"], ids(r), r["doc_tokens"]))
        by_seq[r["sequence_id"]].append((r["offset"], len(r["ids"]) // 4))
    assert by_doc.keys() == want.keys()
    for doc, copies in want.items():
        pieces = sorted(by_doc[doc], key=lambda p: p[0])
        assert sum(len(p[1]) for p in pieces) == sum(map(len, copies))
        assert {p[2] for p in pieces} == {len(c) for c in copies}
        if len(copies) == 1:
            assert [x for p in pieces for x in p[1]] == copies[0]
            assert all(s == sum(len(q[1]) for q in pieces[:i]) for i, (s, _, _) in enumerate(pieces))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == size or (at < size and at & (at - 1) == 0)


def test_packing_empty_table(spark, docs):
    assert packing.pack(docs.limit(0), PATH).collect() == []


def test_crc_of_pieces(spark):
    df = packing.pack(spark.createDataFrame([(1, "the cat")], "doc_id long, text string"), PATH)
    r = df.withColumn("crc", F.crc32("ids")).first()
    assert r["crc"] == zlib.crc32(r["ids"])
