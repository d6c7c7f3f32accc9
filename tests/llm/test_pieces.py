"""Encoding to pieces against the sentencepiece library, with several normalisers."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from tabforge.llm import piece_bpe
from tabforge.llm.chunks import Texts
from tabforge.llm.piece_bpe import Pieces, decode_documents, encode_documents
from tests.llm.data import documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = [*"aeinst thr  ", " ", "  ", "▁", "▁▁", "\n", "\t", "\x00", "\x85", "é", "日", "本", "\U0001f600", "　", "<s>", "</s>", "<unk>"]
SIGNS += ["<0x41>", "1", "23", "́", "ﬁ", "½", "​", "﻿", "�", "\r\n", "ж", "ह", "ि", "the", "and", "ing", " of", "ｶﾞ", "①", "㍿"]


def model(rule=None, trim=False, prefix=True) -> bytes:
    with open(PATH, "rb") as f:
        data = f.read()
    if rule is None:
        return data
    proto, spec = pb.ModelProto(), pb.NormalizerSpec()
    proto.ParseFromString(data)
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    proto.normalizer_spec.precompiled_charsmap = spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix = trim, prefix
    return proto.SerializeToString()


def odd_texts(seed: int, n: int) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(SIGNS) for _ in range(rnd.choice([0, 1, 2, 3, 5, 10, 40, 200]))) for _ in range(n)]


@pytest.mark.parametrize("rule", [None, "identity", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("trim", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_ids_spans_and_texts_equal_the_library(rule, trim, prefix):
    data = model(rule, trim, prefix)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), Pieces(data)
    assert own.by_chunk == (rule is None or rule == "identity" and not trim)
    texts = odd_texts(1, 150)
    ids, spans, counts = own.documents(Texts(pa.array(texts)))
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends, strict=True):
        want = library.encode(t, return_type="proto").pieces
        assert ids[a:b].tolist() == [p.id for p in want]
        assert spans[a:b].tolist() == [[p.begin, p.end] for p in want]
        alone, begins, after = own.encode(t)
        assert (alone, [list(x) for x in zip(begins, after, strict=True)]) == (ids[a:b].tolist(), spans[a:b].tolist())
        assert own.surface(alone).decode() == library.decode(alone)


def test_any_ids_decode_as_in_the_library():
    rnd, own = random.Random(2), Pieces(model())
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for _ in range(2000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(262)]) for _ in range(rnd.randint(0, 12))]
        assert own.surface(ids).decode() == library.decode(ids)


def test_texts_with_bytes_decode_together(monkeypatch):
    """Ids that are bytes don't make a document's decoding go id by id; bytes that are no characters do."""
    own, library = Pieces(model()), sentencepiece.SentencePieceProcessor(model_file=PATH)
    whole = [library.encode(t) for t in ["a\nb", "\n", " \x00", "\U0001f600 the\u3000", "\r\n\r\n \u33cd", *odd_texts(6, 200)]]
    broken = [[own.byte_id[b] for b in "\u3000".encode()[:2]] + whole[0], whole[0] + [own.byte_id[0xE3]], [own.byte_id[0xE3], *whole[0], own.byte_id[0x80]]]
    called, real = [], own.surface
    monkeypatch.setattr(own, "surface", lambda ids, start=True: called.append(ids) or real(ids, start))
    for some, slow in ((whole, []), (broken, broken)):
        called.clear()
        for ids in (np.array(x, np.int32) for x in some):
            surface = piece_bpe.joined(own.surfaces, ids)
            assert bytes(own.decoded(ids, surface(0, len(ids)))).decode() == library.decode(ids.tolist())
        assert called == slow


def test_long_pieces_of_text_without_white_space():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PATH), Pieces(model())
    rnd = random.Random(3)
    for n in (31, 32, 33, 500, 20_000):
        t = "".join(rnd.choice("aaabénst") for _ in range(n))
        assert own.document(t)[0] == library.encode(t)
    assert own.document(" " * 5000)[0] == library.encode(" " * 5000)


def expected(library, doc_id, text) -> tuple:
    ids = library.encode(text or "")
    spans = np.array([[p.begin, p.end] for p in library.encode(text or "", return_type="proto").pieces], "<i8").tobytes()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), zlib.crc32(spans)


def test_documents(spark, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [None, "", " ", "\n", "▁", *odd_texts(4, 80), "the house " * 3000]
    docs = documents(spark, texts).unionByName(documents(spark, ["of no id", None], [None, None]))
    docs = docs.unionByName(docs.where("doc_id = 7")).repartition(3)
    want = sorted((expected(library, r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    for known in (piece_bpe.CACHED, 3):  # a cache that is emptied all the time changes nothing
        monkeypatch.setattr(piece_bpe, "CACHED", known)
        out = encode_documents(docs, PATH)
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"]
        assert sorted(map(tuple, out.collect()), key=repr) == want
    whole = encode_documents(docs, PATH, with_pieces=True)
    back = {r["doc_id"]: r["text"] for r in decode_documents(whole, PATH).collect()}
    texts_of = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in whole.collect():
        assert r["n_tokens"] == len(r["ids"]) == len(r["spans"])
        if r["doc_id"] is not None:
            assert back[r["doc_id"]] == library.decode(library.encode(texts_of[r["doc_id"]] or ""))
    assert encode_documents(docs.limit(0), PATH).collect() == []


def test_query_on_whole_documents(spark):
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(map(tuple, __spark_entry__.queries()["op13_piece_bpe"](spark, sf).collect()))
    assert got == sorted(expected(library, *d) for d in docs)
