"""Token ids of documents as length-delimited binary records, with an offset index.

A file is a run of frames: the length of the data (64-bit), its masked CRC-32C
(32-bit), the data, and the data's masked CRC-32C, all little-endian: the frames
that TFRecord readers know.  The data of a record is a head of 16 bytes (document
id, whether it has one, bytes per id, number of ids) and the ids.  Each file ends
with a fixed end record.  Documents stand in ascending order of their id over all
files, in the order of the file names, null ids last; rows with equal ids are
ordered by a hash of their text, and rows that repeat each other are all written.
A null text is an empty one, so its record holds the end id alone.  An empty table
gives no records.  Other columns of the input are not looked at.  A file holds
about ``FILE_BYTES`` of text; one very long document is one record, which has to
fit into memory.

Files are written by Spark's own text writer, whose commit keeps what a lost or
repeated task has written out of the folder.  The writer ends each row with a zero
byte, so rows are cut where a frame has one: at the highest byte of each length.
The index (file, record, offset, bytes, id, ids, and the ids before it in all files)
is a table of its own, so that a loader can read records in any order by seeking.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowmend.core import ensure_checkpoint_dir

FILE_BYTES = 24_000_000  # of text
SPREAD_BYTES = 1_000_000  # of text that a task has at least, if there are more cores than files
HELD = 300_000  # entries of texts whose ids a worker remembers
HEAD, HEAD_BYTES = "<qBBHI", 16
LENGTH, CHECK = "<Q", "<I"
BLOCK = 1024

# CRC-32C (Castagnoli, reflected) and the mask that TFRecord adds.
POLYNOMIAL = 0x82F63B78
MASK_ADD = 0xA282EAD8

# Where a text may be cut without changing its ids, as tokens of the byte-level pattern end there: in front of white
# space after something else, between a letter and what is none, and after a single line break or tab.
PIECES = re.compile(
    r"[\t\r\n](?=[^ \t\r\n])|[ \t\r\n]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\x00-@\[-`{-\x7f]|\Z)|[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+"
)
ALONE = "\x01"
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe, which begins tokens like 'll
# Letters as the byte-level alphabet writes their bytes.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {**{b: chr(b) for b in _SEEN}, **{b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in _SEEN)}}
LETTERS = {c: "".join(_BYTES[b] for b in chr(c).encode()) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)}
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
# Texts with other white space (or what some engine counts as such) are not cut.
_RARE = [*range(0x0B, 0x0D), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2070), 0x3000, 0xFEFF]
RARE_SPACE = re.compile("[" + "".join(map(chr, _RARE)) + "]")
UNEVEN = re.compile("[\t\r" + ALONE + "".join(map(chr, _RARE)) + "]")


def _step(crc: np.ndarray) -> np.ndarray:
    return (crc >> np.uint32(1)) ^ np.where(crc & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))


def _table(bits: int) -> np.ndarray:
    crc = np.arange(1 << bits, dtype=np.uint32)
    for _ in range(bits):
        crc = _step(crc)
    return crc


_PAIRS = _table(16)


def _skip(size: int) -> list[np.ndarray]:
    """Tables, one for each byte of a checksum, that carry it over ``size`` zero bytes."""
    tables = []
    for k in range(4):
        crc = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(0, size, 2):
            crc = (crc >> np.uint32(16)) ^ _PAIRS[crc & np.uint32(0xFFFF)]
        tables.append(crc)
    return tables


_OVER_BLOCK = _skip(BLOCK)


def crc32c(parts: list[bytes], block: int = BLOCK) -> np.ndarray:
    """CRC-32C of each of the parts, which have four bytes at least (and one block at most, if that is not the usual one).

    Zeros in front do not change a checksum that begins with zero, so all parts are
    filled up to whole blocks at the front; the usual start value is put in by
    inverting the first four bytes.  All blocks are taken side by side, two bytes at a time."""
    size = np.array([len(p) for p in parts], np.int64)
    blocks = -(-size // block)
    end = np.cumsum(blocks)
    data = np.zeros(int(blocks.sum()) * block, np.uint8)
    begin = end * block - size
    for p, a in zip(parts, begin.tolist()):
        data[a : a + len(p)] = np.frombuffer(p, np.uint8)
    for k in range(4):
        data[begin + k] ^= np.uint8(255)
    columns = np.ascontiguousarray(data.view("<u2").reshape(-1, block // 2).T).astype(np.uint32)
    crc = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        crc = (crc >> np.uint32(16)) ^ _PAIRS[(crc ^ column) & np.uint32(0xFFFF)]
    # the blocks of a part, one after the other
    total = np.zeros(len(parts), np.uint32)
    at, left = end - blocks, blocks.copy()
    live = np.flatnonzero(left > 0)
    while len(live):
        t = total[live]
        over = _OVER_BLOCK[0][t & np.uint32(255)]
        for k in range(1, 4):
            over = over ^ _OVER_BLOCK[k][(t >> np.uint32(8 * k)) & np.uint32(255)]
        total[live] = over ^ crc[at[live]]
        at[live] += 1
        left[live] -= 1
        live = live[left[live] > 0]
    return total ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_ADD)


def frames(parts: list[bytes]) -> list[bytes]:
    lengths = [struct.pack(LENGTH, len(p)) for p in parts]
    head, body = masked(crc32c(lengths, 8)).tolist(), masked(crc32c(parts)).tolist()
    return [b"".join((n, struct.pack(CHECK, h), p, struct.pack(CHECK, b))) for n, h, p, b in zip(lengths, head, parts, body)]


def _end_frame() -> bytes:
    """A record whose frame ends with a zero byte, the one that the writer puts at the end of a file."""
    tries = [b"END" + bytes([k % 256, k // 256]) for k in range(4096)]
    return next(f for f in frames(tries) if f[-1] == 0)


END = _end_frame()


def _gather(flat: np.ndarray, start: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that ``code`` names, one after the other, and where each ends."""
    size = np.diff(start)[code]
    upto = np.r_[0, np.cumsum(size)]
    place = np.repeat(start[code] - upto[:-1], size) + np.arange(upto[-1])
    return (flat[place] if len(place) else np.zeros(0, np.uint32)), upto


class Known:
    """Ids of strings."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.flat, self.start, self.uses = array("I"), array("q", [0]), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.place)

    def add(self, names: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        """Names that are new, their ids one after the other, and where each one's end."""
        self.place.update(zip(names, range(len(self.place), len(self.place) + len(names))))
        self.start.frombytes((ends.astype(np.int64) + len(self.flat)).tobytes())
        self.flat.frombytes(ids.astype(np.uint32).tobytes())

    def of(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.uses = np.r_[self.uses, np.zeros(len(self) - len(self.uses), np.int64)]
        self.uses += np.bincount(code, minlength=len(self))
        return _gather(np.frombuffer(self.flat, np.uint32), np.frombuffer(self.start, np.int64), code)

    def forget(self, keep: int) -> "Known":
        """What has been used most often."""
        kept, often = Known(), np.argsort(-self.uses, kind="stable")[:keep]
        often = np.sort(often[self.uses[often] > 1])
        ids, upto = _gather(np.frombuffer(self.flat, np.uint32), np.frombuffer(self.start, np.int64), often)
        names = list(self.place)
        kept.add([names[i] for i in often.tolist()], ids, upto[1:])
        kept.uses = self.uses[often] // 2
        return kept


class Ids:
    """Ids of texts.  Each distinct piece of text goes through the tokenizer once, as long as it is remembered."""

    @staticmethod
    def of_worker(vocabulary: str, special: bool) -> Ids:
        """The same object for all tasks of a Python worker, as Spark lets them follow each other in one process."""
        kept = vars(sys.modules.setdefault("rowmend_worker", ModuleType("rowmend_worker")))
        key = f"{special} {zlib.crc32(vocabulary.encode())} {len(vocabulary)}"
        if key not in kept:
            kept[key] = Ids(vocabulary, special)
        return kept[key]

    def __init__(self, vocabulary: str, special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = not special
        self.entries = Known()
        self.line_break = self._encode(["\n"])[0].ids
        self.by_model = self._splits_as_usual(json.loads(vocabulary))

    def _encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Entries that a text is cut into: a word, for a blank and the word; a line break and the first word of a
        line; and ``ALONE`` before what stands for itself."""
        if UNEVEN.search(text) or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] in " \n" or text[-1:] in " \n":
            return [ALONE + p for p in ([text] if RARE_SPACE.search(text) else PIECES.findall(text))]
        return (ALONE + text.replace("\n", " \n")).split(" ")

    @staticmethod
    def _splits_as_usual(config: dict) -> bool:
        """Whether letters and the marks behind them are a token of the byte-level pattern each, and nothing else is made of them."""
        split = config.get("pre_tokenizer") or {}
        usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        model = config["model"]
        plain = usual and not config.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")
        added = [a["content"] for a in config.get("added_tokens") or []]
        return bool(plain) and not any(re.fullmatch(f"\\s*[A-Za-z]*[{re.escape(MARKS)}]*\\s*", a) for a in added)

    def _learn(self, entries: list[str]) -> None:
        if self.by_model:
            entries = self._learn_words(entries)
        if entries:
            self._learn_any(entries)

    def _learn_words(self, entries: list[str]) -> list[str]:
        """Learns letters with marks behind them by the tokenizer's model alone, as where the pattern cuts them is known; gives back the rest."""
        left, names, flat, ends = [], [], [], []
        tokenize, tails = self.tokenizer.model.tokenize, {"": []}
        for entry in entries:
            lead = entry[0]
            word = entry[1:] if lead == ALONE or lead == "\n" else entry
            core = word.rstrip(MARKS)
            if not core.isalpha():
                left.append(entry)
                continue
            text = core
            if not core.isascii():
                if not LATIN.fullmatch(core):
                    left.append(entry)
                    continue
                text = core.translate(LETTERS)
            if lead == "\n":
                flat += self.line_break
            elif lead != ALONE:
                text = "Ġ" + text
            for token in tokenize(text):
                flat.append(token.id)
            if len(core) < len(word):
                tail = word[len(core) :]
                if tail not in tails:
                    tails[tail] = [t.id for t in tokenize(tail)]
                flat += tails[tail]
            names.append(entry)
            ends.append(len(flat))
        self.entries.add(names, np.array(flat, np.uint32), np.array(ends, np.int64))
        return left

    def _learn_any(self, entries: list[str]) -> None:
        # words go through side by side, with line breaks between them
        plain = [e for e in entries if e[0] not in (ALONE, "\n")]
        lines = self._encode([" " + "\n ".join(plain[k : k + 500]) for k in range(0, len(plain), 500)])
        ids = np.array(list(chain.from_iterable(line.ids + self.line_break for line in lines)), np.uint32)
        stops = np.flatnonzero(ids == self.line_break[0])
        self.entries.add(plain, np.delete(ids, stops), stops - np.arange(len(stops)))
        others = [e for e in entries if e[0] in (ALONE, "\n")]
        coded = [c.ids for c in self._encode([e[1:] if e[0] == ALONE else e for e in others])]
        self.entries.add(others, np.array(list(chain.from_iterable(coded)), np.uint32), np.cumsum([len(c) for c in coded]))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has."""
        if len(self.entries) > HELD or len(self.entries.flat) > 8 * HELD:
            self.entries = self.entries.forget(HELD // 2)
        entries: list[str] = []
        n = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            mine = self._cut(text) if text else []
            n[i] = len(mine)
            entries += mine
        known = self.entries.place
        found = list(map(known.get, entries))
        if None in found:
            open_ = [i for i, code in enumerate(found) if code is None]
            self._learn(list({entries[i] for i in open_}))
            for i in open_:
                found[i] = known[entries[i]]
        ids, upto = self.entries.of(np.array(found, np.int64))
        return ids, np.diff(upto[np.r_[0, np.cumsum(n)]])


def _portions(column: pa.Array, limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Rows that have about ``limit`` bytes of text together."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(size):
        done = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, done + limit, "right")))
        yield lo, hi
        lo = hi


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, special: bool = True) -> None:
    """Writes the records of docs (doc_id, text) to the new folder ``path``, and their index to ``path``-index.

    ``tokenizer``: file of a byte-level tokenizer of the tokenizers library, read on the driver and handed to
    the tasks.  With ``special`` the names of special tokens in a text become those tokens, as the library has it;
    else they are ordinary text.  ``end_id`` is put after each document."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    files = max(1, -(-total // FILE_BYTES), min(cores, total // SPREAD_BYTES))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, rest = Ids.of_worker(vocabulary.value, special), None
        for batch in batches:
            texts, names = batch.column("text"), batch.column("doc_id")
            for lo, hi in _portions(texts):
                ids, n = ids_of.of(texts.slice(lo, hi - lo).to_pylist())
                end = np.cumsum(n + 1)
                whole = np.full(len(ids) + hi - lo, end_id, np.uint32)
                inner = np.ones(len(whole), bool)
                inner[end - 1] = False
                whole[inner] = ids
                parts = []
                for name, a, b in zip(names.slice(lo, hi - lo).to_pylist(), (end - n - 1).tolist(), end.tolist()):
                    mine = whole[a:b]
                    wide = 2 if mine.max() < 1 << 16 else 4
                    head = struct.pack(HEAD, name or 0, name is not None, wide, 0, b - a)
                    parts.append(head + mine.astype(f"<u{wide}").tobytes())
                out = []
                for f in frames(parts):
                    out.append(f[:7] if rest is None else rest + f[:7])
                    rest = f[8:]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
        if rest is not None:
            last = [rest + END[:7], END[8:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(last, pa.binary())], ["value"])

    ordered = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    made = ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", "\0").option("compression", "none").text(path)
    found = scan(spark, path, with_ids=False)
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # one row for each file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = found.join(base, "file").withColumn("start", F.col("base") + F.col("before"))
    placed.select("file", "record", "offset", "n_bytes", "doc_id", "n_tokens", "start").write.parquet(f"{path}-index")


def _walk(raw: memoryview, wanted: list[int] | None) -> Iterator[list[tuple[int, int]]]:
    """Places of frames, about a megabyte at a time, after a check of their lengths."""
    at, some, size = 0, [], 0
    places = iter(wanted) if wanted is not None else None
    while True:
        if places is not None:
            at = next(places, len(raw))
        if at >= len(raw):
            break
        length = struct.unpack_from(LENGTH, raw, at)[0]
        if at + 16 + length > len(raw):
            raise ValueError(f"a record at {at} goes beyond the end of its file")
        some.append((at, length))
        size += length
        at += 16 + length
        if size > 1_000_000:
            yield some
            some, size = [], 0
    if some:
        yield some


def _checked(raw: memoryview, some: list[tuple[int, int]]) -> list[bytes]:
    lengths = [bytes(raw[a : a + 8]) for a, _ in some]
    parts = [bytes(raw[a + 12 : a + 12 + n]) for a, n in some]
    head = np.array([struct.unpack_from(CHECK, raw, a + 8)[0] for a, _ in some], np.uint32)
    body = np.array([struct.unpack_from(CHECK, raw, a + 12 + n)[0] for a, n in some], np.uint32)
    bad = (masked(crc32c(lengths, 8)) != head) | (masked(crc32c(parts)) != body)
    if bad.any():
        raise ValueError(f"a record at {some[int(bad.argmax())][0]} has a wrong checksum")
    return parts


def scan(spark: SparkSession, path: str, with_ids: bool = True, only: DataFrame | None = None) -> DataFrame:
    """file, record (number in the file; null with ``only``), offset, n_bytes, doc_id, n_tokens, before (ids
    before it in the file; null with ``only``) and ids (little-endian unsigned 32-bit integers) of every record.

    ``only``: rows of the index; then no other records are read, in the order of ``only`` within each file.
    A wrong checksum or length is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    if only is not None:
        offsets = only.groupBy("file").agg(F.collect_list("offset").alias("wanted"))
        files = files.join(offsets, "file")
    else:
        files = files.withColumn("wanted", F.lit(None).cast("array<bigint>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, wanted = batch.column("file")[i].as_py(), batch.column("wanted")[i].as_py()
                raw = memoryview(batch.column("content")[i].as_buffer())
                record = before = 0
                for some in _walk(raw, wanted):
                    rows = []
                    for (at, n), part in zip(some, _checked(raw, some)):
                        if len(part) < HEAD_BYTES:
                            continue  # the end record
                        doc, has, wide, _, count = struct.unpack_from(HEAD, part)
                        ids = None
                        if with_ids:
                            ids = np.frombuffer(part, f"<u{wide}", count, HEAD_BYTES).astype("<u4").tobytes()
                        known = wanted is None
                        rows.append((name, record if known else None, at, n + 16, doc if has else None, count, before if known else None, ids))
                        record += 1
                        before += count
                    kinds = [pa.string(), *[pa.int64()] * 6, pa.binary()]
                    columns = zip(*rows) if rows else [[]] * len(kinds)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], NAMES)

    return files.mapInArrow(run, SCHEMA)


NAMES = ["file", "record", "offset", "n_bytes", "doc_id", "n_tokens", "before", "ids"]
SCHEMA = "file string, record long, offset long, n_bytes long, doc_id long, n_tokens long, before long, ids binary"


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}-index")


def shuffled(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """All records in an order drawn by ``seed``, read by way of the index.  Equal seeds give equal orders."""
    draw = F.xxhash64(F.lit(seed), "file", "offset")
    wanted = index(spark, path).select("file", "offset", draw.alias("draw"))
    read = scan(spark, path, only=wanted).join(wanted, ["file", "offset"])
    return read.orderBy("draw", "file", "offset").select("file", "offset", "doc_id", "n_tokens", "ids")


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, file, offset of every document, from the files that it has written."""
    spark = docs.sparkSession
    if path is None:
        path = f"{ensure_checkpoint_dir(spark)}/records-{os.urandom(16).hex()}"
    write(docs, path, tokenizer, end_id)
    read = scan(spark, path).select("file", "offset", "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return read.join(index(spark, path).select("file", "offset", "start"), ["file", "offset"]).select(
        "doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32", "file", "offset"
    )
