import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from papergrid.llm import bpe

from .helpers import corpus, docs_df, empty_df


@pytest.fixture(scope="module")
def reference():
    tokens = bpe.read_ranks(bpe.default_vocabulary())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_codec_like_tiktoken(reference):
    rng = random.Random(2)
    codec = bpe.Codec(bpe.default_vocabulary(), public_tokenizers.PATTERN)
    texts = ["", " ", "\x00\x1c a", "日本語🙂", "x" * 9000, " " * 500, "'S't", "<|endoftext|>", "１２ 34\r\n"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(80)) for _ in range(300)]
    for text, packed in zip(texts, codec.encode(texts)):
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == reference.encode_ordinary(text)
        assert codec.decode(packed) == text.encode()


def test_cache_overflow(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PARTS", 10)
    codec = bpe.Codec(bpe.default_vocabulary(), public_tokenizers.PATTERN)
    for text in [r[1] or "" for r in corpus()] * 2:
        assert struct.unpack(f"<{len(codec.encode([text])[0]) // 4}I", codec.encode([text])[0]) == tuple(reference.encode_ordinary(text))


def test_query_shape(spark, reference):
    rows = bpe.encode(docs_df(spark), ids_col="packed", decoded_col="decoded")
    again = bpe.decode(rows, "packed", "again")
    got = again.withColumn("array", bpe.unpack(again["packed"])).collect()
    assert len(got) == len(corpus())
    for r in got:
        ids = reference.encode_ordinary(r.text or "")
        assert bytes(r.packed) == struct.pack(f"<{len(ids)}I", *ids) and r.array == ids
        assert bytes(r.decoded) == bytes(r.again) == (r.text or "").encode()
        assert (r.kept, r.ids) == ("k", "i")
    assert bpe.encode(empty_df(spark), ids_col="packed").count() == 0


def test_gaps_are_refused(tmp_path):
    (tmp_path / "v").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError, match="gaps"):
        bpe.read_ranks(str(tmp_path / "v"))


def test_serialised_model_has_identity_normalisation():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=bpe.serialise([bytes([b]) for b in range(256)] + [b"ab"]))
    assert model.get_piece_size() == 258 and model.encode("ab") == [256] and model.unk_id() == 257
    assert hashlib.sha256(model.decode([256]).encode()).hexdigest() == hashlib.sha256(b"ab").hexdigest()
