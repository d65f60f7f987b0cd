"""Token files as an exact round trip, with degenerate rows, short-document access and damaged parts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest_helpers import rows
from tokenizers import Tokenizer

from tessera.llm import encoding, queries, token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def brute(tokenizer, docs, end=1):
    """Rows of (doc_id, start, n_tokens, ids_crc32), by encoding each text as a whole."""
    every = [(d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for d, t in docs]
    at, out = 0, []
    for d, ids in sorted(every, key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), zlib.crc32(x[1].tobytes()))):
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


TEXTS = ["", "Don't  STOP'S it's... a.,b é… É. x<|endoftext|>y <|ENDOFTEXT|> A1.2 café!!! 'tis ''' l’été. é. Σας ΟΔΟΣ. a b \x1cq. İx. ~~ a~ 's. 3rd. ....",
         "'S, THEY'LL. we'RE! 'd.", ".", "a'.", "''s.", "<|endoftext|>.", "x<|startoftext|>, y", "word " * 3000, "x" * 3000, " \n ", "A, b! ## ** \n\nA, b!"]


@pytest.mark.parametrize("group, memory", [(1 << 20, 48 << 20), (7, 2000)])
def test_encoder_equals_the_tokenizer(tokenizer, made, monkeypatch, group, memory):
    """Also in pieces of a few bytes and with a memory that is full all the time."""
    monkeypatch.setattr(encoding, "GROUP_BYTES", group)
    monkeypatch.setattr(encoding, "MEMORY_BYTES", memory)
    encode, texts = encoding.Encoder(PATH), [*TEXTS, *(t or "" for _, t in made)]
    for _ in range(2):
        got = [x.tolist() for x in encode([t.encode() for t in texts])]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_looked_up_since_stay_when_the_memory_is_full(tokenizer, monkeypatch):
    monkeypatch.setattr(encoding, "MEMORY_BYTES", 40_000)
    encode, asked = encoding.Encoder(PATH), []
    plain = encode._encode
    monkeypatch.setattr(encode, "_encode", lambda texts: asked.extend(texts) or plain(texts))
    for i in range(30):
        text = "common words " + " ".join(f"{chr(97 + i % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}q{'z' * (i // 26)}" for j in range(60))
        assert next(encode([text.encode()])).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert sum("common" in t.decode().split() for t in asked) == 1
    assert encode.held + 4 * len(encode.ids) <= 2 * 40_000


@pytest.mark.parametrize("file_bytes", [1, 3000, 1 << 24])
def test_files_give_the_documents_back(spark, docs, made, tokenizer, tmp_path, file_bytes):
    folder = str(tmp_path / "tokens")
    tf.write(docs, PATH, folder, file_bytes=file_bytes)
    want = brute(tokenizer, made)
    assert rows(tf.read(spark, folder), "doc_id", "start", "n_tokens", "ids_crc32") == want
    index = rows(spark.read.parquet(f"{folder}/index"), "doc_id", "start", "n_tokens", "length")
    assert [r[:3] for r in index] == [r[:3] for r in want] and all(r[3] > 0 for r in index)
    asked = [made[3][0], made[40][0], -5]
    got = {r.doc_id: r.ids for r in tf.fetch(spark, folder, asked).collect()}
    assert got == {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in made if d in asked}
    assert tf.fetch(spark, folder, [-5]).collect() == []


def test_degenerate_rows(spark, none, tokenizer, tmp_path):
    table = [(1, "a b"), (1, "a b"), (None, None), (None, "x y z"), (-4, ""), (1 << 40, None), (1, "c")]
    df = spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "1 AS ids", "'clash' AS bucket", "2 AS n_tokens")
    tf.write(df, PATH, str(tmp_path / "a"))
    assert rows(tf.read(spark, str(tmp_path / "a")), "doc_id", "start", "n_tokens", "ids_crc32") == brute(tokenizer, table)
    tf.write(none, PATH, str(tmp_path / "b"))
    assert tf.read(spark, str(tmp_path / "b")).collect() == [] and tf.fetch(spark, str(tmp_path / "b"), [1]).collect() == []


def test_file_of_another_dictionary_is_refused(made):
    import hashlib

    import zstandard

    one = tf.train([(str(i) * 40).encode() for i in range(500)])
    frame = zstandard.ZstdCompressor(dict_data=tf._dictionary(one), write_checksum=True).compress(np.array([5, 1], "<u2").tobytes())
    content = tf.pack_file(2, hashlib.sha256(one).digest(), 7, [(3, 2, frame)])
    f = tf.TokenFile(content + b"\n", one)
    assert f.ids(0).tolist() == [5, 1] and f.starts.tolist() == [7]
    with pytest.raises(ValueError, match="another dictionary"):
        tf.TokenFile(content, one + b"x")
    with pytest.raises(ValueError, match="not a token file"):
        tf.TokenFile(b"x" * 200, one)
    with pytest.raises(zstandard.ZstdError):
        tf.TokenFile(content[:-3] + bytes([content[-3] ^ 255]) + content[-2:], one).ids(0)


def test_registered_query_over_the_whole_table(spark, sf, tokenizer):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(queries.QUERIES["op11_token_files"](spark, sf), "doc_id", "start", "n_tokens", "ids_crc32") == brute(tokenizer, docs)


def test_a_repeated_chunk_is_looked_up_once_a_group():
    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            self.asked += 1
            return dict.__getitem__(self, key)

    encoder = encoding.Encoder(PATH)
    encoder.known = Counted()
    texts = [b" the cat\tand the\x0bdog, " * 50, b"", b" \n ", "thé\u0085cat\x1fthe ".encode() * 3]
    found = list(encoder(texts))
    assert [x.tolist() for x in found] == [encoder.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]
    assert encoder.known.asked <= 12
