"""Binary records against the tokenizer itself, and their frames against the format."""

import json
import os
import random
import struct
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowmend.core import ensure_checkpoint_dir
from rowmend.llm import records

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n  \t", "one", " lead", "trail ", "it's  we'll\n\n x y   z", "tab\tthen  blank \n", "　a  b  c",
    "\x1c a\x1c b! \x1cc", "naïve Übung 日本語 テスト 😀 🏳️‍🌈", "<|endoftext|> in text<|endoftext|>", "x" * 5000, "a b " * 4000, "1234 5 6.7\r\n8",
]


def brute(rows):
    t = Tokenizer.from_file(PATH)
    made = [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in rows]
    return made


def bitwise(data):
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums():
    rng = random.Random(1)
    parts = [bytes(rng.randrange(256) for _ in range(n)) for n in (4, 5, 8, 1023, 1024, 1025, 5000)] + [b"123456789"]
    assert records.crc32c(parts).tolist() == [bitwise(p) for p in parts]
    assert bitwise(b"123456789") == 0xE3069283  # the check value of CRC-32C
    assert records.END[-1] == 0


@pytest.mark.parametrize("spread", [1_000_000, 2_000])
def test_round_trip(spark, monkeypatch, spread):
    monkeypatch.setattr(records, "SPREAD_BYTES", spread)
    rng = random.Random(3)
    pieces = ["le", " ", "\n", "  ", "é", "don't", "42", "\t", " ", "!?", "Wort", " "]
    data = list(enumerate(ODD, 5)) + [(100 - k, "".join(rng.choice(pieces) for _ in range(rng.randrange(200)))) for k in range(60)]
    data += [(None, "no id"), (None, "nor this"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in data], "doc_id long, text string, file string, start int").repartition(4)
    path = f"{ensure_checkpoint_dir(spark)}/records-{uuid.uuid4().hex}".removeprefix("file:")
    got = records.round_trip(docs, PATH, path).collect()
    coded = brute(data)
    as_bytes = lambda ids: np.array(ids, "<u4").tobytes()
    want = sorted((-1 if i is None else i, len(ids), zlib.crc32(as_bytes(ids))) for i, ids in coded)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    # documents follow each other in ascending order without a gap
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    order = [(r.doc_id is None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    # the files, read by the format alone
    ids = {}
    for name in sorted(f for f in os.listdir(path) if f.startswith("part-")):
        raw, at = open(f"{path}/{name}", "rb").read(), 0
        while at < len(raw):
            (n,) = struct.unpack_from("<Q", raw, at)
            body = raw[at + 12 : at + 12 + n]
            crc = bitwise(body) if n < 300 else None
            mask = lambda c: (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF
            assert struct.unpack_from("<I", raw, at + 8)[0] == mask(bitwise(raw[at : at + 8]))
            assert crc is None or struct.unpack_from("<I", raw, at + 12 + n)[0] == mask(crc)
            ids[name, at] = body
            at += 16 + n
        assert at == len(raw)
    assert {(r.file, r.offset) for r in got} < set(ids)
    # reads in another order by the index
    a, b = (records.shuffled(spark, path, seed).collect() for seed in (1, 2))
    assert sorted(map(repr, a)) == sorted(map(repr, b)) and a != b and a == records.shuffled(spark, path, 1).collect()
    assert sorted(bytes(r.ids) for r in a) == sorted(as_bytes(x) for _, x in coded)
    few = records.index(spark, path).where("doc_id = 7")
    assert sorted(r.n_tokens for r in records.scan(spark, path, only=few).collect()) == sorted(len(x) for i, x in coded if i == 7)


def test_damage_is_an_error(spark):
    path = f"{ensure_checkpoint_dir(spark)}/records-{uuid.uuid4().hex}".removeprefix("file:")
    records.write(spark.createDataFrame([(1, "some text here")], "doc_id long, text string"), path, PATH)
    name = next(f"{path}/{f}" for f in os.listdir(path) if f.startswith("part-"))
    raw = bytearray(open(name, "rb").read())
    raw[30] ^= 1
    crc = name.rsplit("/", 1)
    if os.path.exists(f"{crc[0]}/.{crc[1]}.crc"):
        os.unlink(f"{crc[0]}/.{crc[1]}.crc")
    open(name, "wb").write(raw)
    with pytest.raises(Exception, match="wrong checksum"):
        records.scan(spark, path).collect()


def test_special_tokens_as_text():
    with open(PATH, encoding="utf-8") as f:
        vocabulary = f.read()
    t = Tokenizer.from_file(PATH)
    text = "a <|endoftext|> b"
    assert records.Ids(vocabulary, True).of([text])[0].tolist() == t.encode(text).ids
    t.encode_special_tokens = True
    assert records.Ids(vocabulary, False).of([text])[0].tolist() == t.encode(text).ids


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert records.round_trip(none, PATH).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])}
    got = records.round_trip(docs.withColumn("record", F.lit(1)), PATH)
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got.collect()} == want


def test_words_with_marks_by_the_model(monkeypatch):
    """Words of letters and marks skip the pattern, with the ids that the whole tokenizer gives."""
    with open(PATH, encoding="utf-8") as f:
        vocabulary = f.read()
    rng = random.Random(8)
    words = ["".join(rng.choice("abehinortABÉÀÖØöøÿíß") for _ in range(rng.randrange(1, 12))) + "".join(rng.choice("".join(records.MARKS) + "'9") for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 4]))) for _ in range(3000)]
    texts = ["".join(rng.choice([w + " ", w + "\n", w, w + " "]) for w in rng.sample(words, 40)) for _ in range(200)] + ["a<|endoftext|> b", "<|endoftext|>"]
    t, ids = Tokenizer.from_file(PATH), records.Ids(vocabulary, True)
    through: list[str] = []
    whole = records.Ids._learn_any
    monkeypatch.setattr(records.Ids, "_learn_any", lambda self, entries: through.extend(entries) or whole(self, entries))
    got, n = ids.of(texts)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert n.tolist() == [len(x) for x in want] and got.tolist() == [i for x in want for i in x]
    assert not any(e.strip("\x01\n" + records.MARKS).isascii() and e.strip("\x01\n").rstrip(records.MARKS).isalpha() for e in through if e.isascii())


def test_added_words_go_through_the_whole_tokenizer():
    with open(PATH, encoding="utf-8") as f:
        config = json.load(f)
    assert records.Ids(json.dumps(config), False).by_model
    config["added_tokens"].append({**config["added_tokens"][0], "id": 50257, "content": "there", "special": False})
    t = Tokenizer.from_str(json.dumps(config))
    ids = records.Ids(json.dumps(config), True)
    assert not ids.by_model and ids.of(["over there, there"])[0].tolist() == t.encode("over there, there").ids
