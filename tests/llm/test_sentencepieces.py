"""Encoding, spans and decoding against the library, for the public model and for models with a character map."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from palimpsest.llm import sentencepieces
from palimpsest.llm.sentencepieces import PieceModel, compiled_keys

SMALL = "/root/testdata/sf0.01"
TEXTS = [
    "", " ", "  ", "a", " a ", "\n", "a\n\nb", "  two  spaces\tand a tab  ", "café café Ångström Ångstrom", "ＡＢＣ ｱﾞ 　 x", "▁ block ▁▁",
    "你好世界 \U0001f600\U0001f468‍\U0001f469", "zero​width ­ soft", "\u0001 \u0001 x \u0001", "\x00nul\x00", "ﬁligature ① ½ Ⅲ ¨", "\u0000", "aaaa" * 50, " " * 100 + "x" + " " * 100,
    "<s> </s> <unk> <0x41>", "� bad", "각 각", "a　 b  c  d", "x\r\ny z",
]


def changed(**spec) -> bytes:
    """The public model with another normaliser, or without byte pieces."""
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(sentencepieces.public_model(), "rb").read())
    if spec.pop("mapped", True):
        named = sentencepiece.SentencePieceNormalizer(rule_name=spec.pop("rule", "nmt_nfkc"))
        model.normalizer_spec.ParseFromString(named.serialized_normalizer_spec() if hasattr(named, "serialized_normalizer_spec") else named.serialized_model_proto())
    if spec.pop("no_bytes", False):
        model.trainer_spec.byte_fallback = False
        for p in model.pieces:
            p.type = 1 if p.type == 6 else p.type
    for piece in spec.pop("defined", []):
        model.pieces.add(piece=piece, score=0.0, type=4)
    for name, value in spec.items():
        setattr(model.normalizer_spec, name, value)
    return model.SerializeToString()


def library(proto: bytes):
    return sentencepiece.SentencePieceProcessor(model_proto=proto)


def spans(lib, text: str) -> list[tuple[int, int, int]]:
    return [(p.id, p.begin, p.end) for p in lib.encode(text, return_type="proto").pieces]


def random_texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    some = "aAbe ́̊　  \néＡｱﾞ▁​\u0001你\U0001f600½.,1[X]"
    return ["".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(n)]


MODELS = {
    "public": lambda: changed(mapped=False),
    "nfkc": lambda: changed(add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True),
    "kept_spaces": lambda: changed(add_dummy_prefix=True, remove_extra_whitespaces=False, escape_whitespaces=True),
    "no_prefix": lambda: changed(add_dummy_prefix=False, remove_extra_whitespaces=True, escape_whitespaces=True),
    "no_bytes": lambda: changed(no_bytes=True, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True),
    "defined": lambda: changed(mapped=False, defined=["[X]", "beA[", "1[", "1[X"]),
    "folded": lambda: changed(rule="nmt_nfkc_cf", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True),
}


@pytest.mark.parametrize("name", MODELS)
def test_ids_spans_and_text_are_the_librarys(name):
    proto = MODELS[name]()
    lib, own = library(proto), PieceModel("", proto)
    for text in TEXTS + random_texts(5, 300):
        ids, begins, ends = own.encode(text)
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True)) == spans(lib, text), text
        assert own.decode(ids.tolist()) == lib.decode(ids.tolist()), text


def test_decoding_of_any_ids():
    rng = random.Random(8)
    for name in ("public", "nfkc"):
        proto = MODELS[name]()
        lib, own = library(proto), PieceModel("", proto)
        for _ in range(400):
            ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000), lib.piece_to_id("▁"), lib.piece_to_id("▁▁")]) for _ in range(rng.randrange(12))]
            assert own.decode(ids) == lib.decode(ids), ids


def test_the_compiled_map_has_every_key_and_takes_the_longest():
    own = PieceModel("", MODELS["nfkc"]()).normaliser
    assert len(own.keys) > 100_000 and compiled_keys(b"") == {}
    assert own.keys["Ａ"] == "A" and own.keys["ｶﾞ"] == "ガ" and own.keys["ｶ"] == "カ"
    assert own.normalise("ｶﾞｶ")[1].tolist() == [0, 0, 2, 3]


def test_whole_table_against_the_library(spark):
    docs = pd.read_parquet(f"{SMALL}/documents.parquet")
    lib = library(MODELS["public"]())
    got = {r["doc_id"]: r for r in sentencepieces.digests(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    assert len(got) == len(docs)
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = lib.encode(text or "")
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_hard_rows(spark, docs, clashing, empty):
    lib = library(MODELS["public"]())
    rows = sentencepieces.encode(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for doc_id, row in by_id.items():
        text = texts[doc_id] or ""
        assert row["ids"] == lib.encode(text)
        assert all(0 <= s["begin"] <= s["end"] <= len(text.encode()) for s in row["spans"])
    assert by_id[4]["ids"] == [] and by_id[5]["ids"] == []
    back = {r["doc_id"]: r["text"] for r in sentencepieces.decode(sentencepieces.encode(docs)).collect()}
    assert back[10] == lib.decode(lib.encode(texts[10])) and back[4] == ""
    assert sorted(map(str, sentencepieces.digests(clashing).collect())) == sorted(map(str, sentencepieces.digests(docs).collect()))
    assert sentencepieces.digests(empty).count() == 0
    one = next(r for r in sentencepieces.digests(docs).collect() if r["doc_id"] == 1)
    begins, ends = (np.array([s[c] for s in by_id[1]["spans"]], "<i8").tobytes() for c in ("begin", "end"))
    assert one["spans_crc32"] == zlib.crc32(begins + ends)


def test_a_text_of_four_million_characters(spark):
    text = "word café \n" * 400_000 + "x" * 20_000
    row = sentencepieces.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    ids = library(MODELS["public"]()).encode(text)
    assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
