"""Token ids in compressed shards with a shared dictionary and an offset index.

Texts are encoded by the ``tokenizers`` library and an end id is appended. A zstandard dictionary is
trained on the serialized id arrays of a sample of at most ``DICTIONARY_ROWS`` documents (whole arrays,
the longest left out); it only affects sizes. Every document is compressed on its own with it, sorted by
id, and packed into shard images::

    "BXID" | u16 version | u16 bytes per id | 32 bytes sha256 of the dictionary | u32 documents
    | u64 payload offset of each document and the end | u32 ids of each document | payload

Images are rows of a Parquet table, next to the ids of their documents, so Spark commits them whole
or not at all, on any file system; a folder also holds the dictionary and a manifest with the ids before
each shard. One document is read by two index entries and one small decompression.

Null and empty texts have the end id only. Null document ids sort first; rows with one id sort by a hash of their
serialized ids, and equal rows are documents of their own.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from boxline.llm import words as W
from boxline.llm.worker import kept
from boxline.session import pin

END_ID = 1
DICTIONARY_ROWS = 2_000
DICTIONARY_BYTES = 112 << 10
# Id arrays longer than this don't need a dictionary and aren't trained on.
DICTIONARY_ARRAY = 1 << 16
LEVEL = 3
# Compressed bytes after which a shard is closed.
SHARD_BYTES = 4 << 20
# Distinct cores and signs that a worker remembers.
REMEMBERED = 900_000
MAGIC, VERSION = b"BXID", 1
HEADER = "<4sHH32sI"
# Signs that are cut off a word's end.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# What ends a word's last token, and the pieces that a tokenizer must part words into.
WORD_END = "</w>"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Units:
    """What is known of byte strings by hash: the ids of each, in one array, found through a table of two places."""

    SLOTS = 1 << 21

    def __init__(self, kind: str):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.count = self.used = 0
        self.hashes = np.zeros(1 << 16, W.U64)
        # Where the ids of each string start, and one end more.
        self.starts = np.zeros((1 << 16) + 1, np.int64)
        self.ids = np.zeros(1 << 18, self.kind)
        self.table = [np.full(self.SLOTS, -1, np.int32) for _ in range(2)]
        self.rest: dict[int, int] = {}

    def _slots(self, hashes: np.ndarray, turn: int) -> np.ndarray:
        return ((hashes >> W.U64(24 * turn)) & W.U64(self.SLOTS - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each string, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for turn, table in enumerate(self.table):
            at = table[self._slots(hashes[left], turn)]
            hit = (at >= 0) & (self.hashes[at] == hashes[left])
            out[left[hit]] = at[hit]
            left = left[~hit]
        if self.rest and len(left):
            out[left] = [self.rest.get(h, -1) for h in hashes[left].tolist()]
        return out

    def add(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """New strings with their ids in a row."""
        count, used = self.count + len(hashes), self.used + len(ids)
        for name, size in (("hashes", count), ("starts", count + 1), ("ids", used)):
            held = getattr(self, name)
            if size > len(held):
                grown = np.zeros(2 * size, held.dtype)
                grown[:len(held)] = held
                setattr(self, name, grown)
        self.hashes[self.count:count] = hashes
        self.starts[self.count + 1:count + 1] = self.used + np.cumsum(lengths)
        self.ids[self.used:used] = ids
        numbers = np.arange(self.count, count)
        for turn, table in enumerate(self.table):
            slots = self._slots(hashes, turn)
            free = table[slots] < 0
            table[slots[free]] = numbers[free]
            placed = table[slots] == numbers
            hashes, numbers = hashes[~placed], numbers[~placed]
        self.rest.update(zip(hashes.tolist(), numbers.tolist()))
        self.count, self.used = count, used

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all strings in a row, how many each has)."""
        first = self.starts[numbers]
        lengths = self.starts[numbers + 1] - first
        at = np.repeat(first - np.cumsum(lengths) + lengths, lengths)
        return self.ids[at + np.arange(len(at))], lengths


def _bytes_of(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(characters.encode("latin-1"), np.uint8)] = True
    return table


_SIGN, _ALNUM = _bytes_of(_SIGNS), _bytes_of("abcdefghijklmnopqrstuvwxyz0123456789")
_LETTER = _bytes_of("abcdefghijklmnopqrstuvwxyz")
# UTF-8 of the letters U+00C0 to U+00FF: this byte, then another one, but for the signs of two products.
_LEAD, _NO_LETTERS = 0xC3, (0x97, 0xB7)


class Encoder:
    """Ids of texts as little-endian bytes; equal parts of words are encoded once.

    A tokenizer that lowers case, drops white space and parts letters from signs gives a text the ids of its
    words in a row, and a word those of its core and of the signs behind it. All cores and signs of a block of texts
    are hashed and looked up together. New ones of letters only are encoded many at a time: each ends with an id whose
    token ends a word, which tells them apart again. Other new ones are encoded one by one, and with other
    tokenizers (``by_words`` false) whole texts are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.by_words = splits_words(json.loads(self.tokenizer.to_str()))
        self.units = Units(self.kind)

    @staticmethod
    def of(path: str) -> Encoder:
        """The encoder of this process, with the words it has met."""
        name = f"encoder {path}"
        if name not in kept():
            kept()[name] = Encoder(path)
        return kept()[name]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [e.ids for e in got]

    def _learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encodes the strings at ``starts`` to ``ends`` of ``data``; each is new."""
        # Letters only, by the bytes that aren't letters before each place.
        letter = _LETTER[data]
        follows = np.zeros(len(data), bool)
        follows[1:] = data[:-1] == _LEAD
        letter |= (data == _LEAD) | (follows & ~np.isin(data, _NO_LETTERS))
        other = np.concatenate([[0], np.cumsum(~letter)])
        plain = other[ends] == other[starts]
        raw = data.tobytes()

        def texts(which):
            return [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[which].tolist(), ends[which].tolist())]

        which = np.flatnonzero(plain)
        for low in range(0, len(which), 512):
            part = which[low:low + 512]
            words = texts(part)
            ids = np.asarray(self._ids([" ".join(words)])[0], self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                self.units.add(hashes[part], np.diff(cuts, prepend=0), ids)
            else:
                self._one_by_one(hashes[part], words)
        which = np.flatnonzero(~plain)
        for low in range(0, len(which), 4096):
            part = which[low:low + 4096]
            self._one_by_one(hashes[part], texts(part))

    def _one_by_one(self, hashes: np.ndarray, words: list[str]) -> None:
        ids = self._ids(words)
        flat = np.fromiter((i for own in ids for i in own), self.kind)
        self.units.add(hashes, np.array([len(own) for own in ids], np.int64), flat)

    def _cut(self, block: W.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lower-cased bytes, starts, ends of cores and signs, how many of them each text has)."""
        found = W.words(block, lower=False)
        data = W._LOWER[block.data]
        starts, ends = found.starts, found.ends
        # The last byte of each word that is no sign; a word of signs has none.
        last = np.maximum.accumulate(np.where(_SIGN[data], -1, np.arange(len(data))))[ends - 1] if len(ends) else ends
        # Before the signs stands a letter or digit, else the word is left whole.
        ahead = data[np.maximum(last - 1, 0)]
        final = data[np.maximum(last, 0)]
        fits = (last >= starts) & (
            _ALNUM[final] | ((ahead == _LEAD) & (last > starts) & ~np.isin(final, _NO_LETTERS) & (final >= 128))
        )
        cut = np.where(fits, last + 1, ends)
        bar = np.flatnonzero((block.data[:-1] == ord("<")) & (block.data[1:] == ord("|")))
        for word in np.unique(np.searchsorted(starts, bar, "right") - 1).tolist():
            # Special tokens are matched before case is lowered.
            low, high = int(starts[word]), int(ends[word])
            data[low:high], cut[word] = block.data[low:high], high
        pairs = np.stack([starts, cut, cut, ends], axis=1).reshape(-1, 2)
        full = pairs[:, 0] < pairs[:, 1]
        before = np.concatenate([[0], np.cumsum(full)])
        counts = np.diff(before[2 * found.offsets])
        return data, pairs[full, 0], pairs[full, 1], counts

    def encode(self, block: W.Block) -> list[bytes]:
        """Ids of each text of a block, as bytes."""
        if not self.by_words:
            texts = [block.text(i).decode("utf-8", "replace") for i in range(len(block))]
            return [np.asarray(ids, self.kind).tobytes() for ids in self._ids(texts)]
        data, starts, ends, counts = self._cut(block)
        hashes = W.span_hashes(data, starts, ends)
        numbers = self.units.find(hashes)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            _, first = np.unique(hashes[new], return_index=True)
            if self.units.count + len(first) > REMEMBERED:
                self.units.clear()
                _, new = np.unique(hashes, return_index=True)
                first = np.arange(len(new))
            one = new[first]
            self._learn(data, hashes[one], starts[one], ends[one])
            numbers = self.units.find(hashes)
        ids, lengths = self.units.gather(numbers)
        size = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])] * self.width
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(size[:-1].tolist(), size[1:].tolist())]


def splits_words(settings: dict) -> bool:
    """Whether a tokenizer's settings are those that ``Encoder`` can go by words with."""
    def steps(part: dict | None, name: str) -> list[dict]:
        return part[name] if part and part["type"] == "Sequence" else [part] if part else []

    model = settings["model"]
    forms = steps(settings["normalizer"], "normalizers")
    cuts = steps(settings["pre_tokenizer"], "pretokenizers")
    return (
        [f["type"] for f in forms] == ["NFC", "Replace", "Lowercase"]
        and (forms[1]["pattern"], forms[1]["content"]) == ({"Regex": "\\s+"}, " ")
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"] == {"Regex": PIECES} and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed"
        and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
        and model["type"] == "BPE" and model["end_of_word_suffix"] == WORD_END and not model["dropout"]
        and not settings["truncation"] and not settings["padding"]
    )


def _encoded(docs: DataFrame, path: str, end_id: int, key: str, text: str, dictionary: bytes | None):
    """(_doc, _n, _ids): ids of whole texts with the end id; compressed when a dictionary is given."""
    kind = docs.schema[key].dataType.simpleString()
    share = None if dictionary is None else docs.sparkSession.sparkContext.broadcast(dictionary)

    def apply(batches):
        encoder = Encoder.of(path)
        end = np.asarray([end_id], encoder.kind).tobytes()
        pack = compressor(share.value).compress if share else bytes
        for batch in batches:
            counts, out = [], []
            for block in W.blocks(batch.column(1)):
                for ids in encoder.encode(block):
                    ids += end
                    counts.append(len(ids) // encoder.width)
                    out.append(pack(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(out, pa.binary())],
                ["_doc", "_n", "_ids"],
            )

    rows = docs.select(F.col(key).alias("_doc"), W.text_bytes(text).alias("_bytes"))
    return rows.mapInArrow(apply, f"_doc {kind}, _n bigint, _ids binary")


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=known)


def train_dictionary(docs: DataFrame, path: str, end_id: int, key: str, text: str) -> bytes:
    """A dictionary from a sample bounded by rows and bytes; empty when there is too little to learn."""
    ids = docs.select(F.col(key).alias("_key")).orderBy(F.xxhash64("_key"), "_key")
    chosen = ids.limit(DICTIONARY_ROWS).distinct()
    sample = docs.join(F.broadcast(chosen), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    rows = _encoded(sample, path, end_id, key, text, None).where(
        F.octet_length("_ids") <= DICTIONARY_ARRAY
    )
    got = rows.orderBy(F.xxhash64("_doc"), "_doc", "_ids").limit(DICTIONARY_ROWS).collect()
    arrays = [bytes(r["_ids"]) for r in got]
    if sum(map(len, arrays)) < 16 * DICTIONARY_BYTES // 10:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def image(arrays: list[bytes], counts: list[int], dictionary: bytes, width: int) -> bytes:
    """A shard of compressed documents."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype("<u8")
    head = struct.pack(HEADER, MAGIC, VERSION, width, hashlib.sha256(dictionary).digest(), len(arrays))
    index = offsets.tobytes() + np.asarray(counts, "<u4").tobytes()
    return b"".join([head, index, *arrays])


@dataclass
class Shard:
    """A shard image with its index; documents are decompressed one at a time."""

    data: bytes
    dictionary: bytes

    def __post_init__(self):
        magic, version, self.width, digest, self.size = struct.unpack_from(HEADER, self.data)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a shard of token ids")
        if digest != hashlib.sha256(self.dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        at = struct.calcsize(HEADER)
        self.offsets = np.frombuffer(self.data, "<u8", self.size + 1, at)
        self.counts = np.frombuffer(self.data, "<u4", self.size, at + 8 * (self.size + 1))
        self.payload = at + 8 * (self.size + 1) + 4 * self.size
        self._decompressor = decompressor(self.dictionary)

    def __len__(self) -> int:
        return self.size

    def ids(self, i: int) -> np.ndarray:
        low, high = self.payload + int(self.offsets[i]), self.payload + int(self.offsets[i + 1])
        raw = self._decompressor.decompress(
            self.data[low:high], max_output_size=int(self.counts[i]) * self.width
        )
        return np.frombuffer(raw, f"<u{self.width}")


def write_tokens(
    docs: DataFrame, folder: str, path: str, end_id: int = END_ID, key: str = "doc_id",
    text: str = "text", shard_bytes: int = SHARD_BYTES,
) -> None:
    """Writes ``docs`` below ``folder`` (a shared one): ``shards``, ``dictionary`` and ``manifest``."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path, end_id, key, text)
    spark.createDataFrame(
        [(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))],
        "sha256 string, dictionary binary",
    ).write.parquet(f"{folder}/dictionary")
    kind = docs.schema[key].dataType
    # Encoded once; the range exchange then samples and moves compressed rows only.
    rows = pin(_encoded(docs, path, end_id, key, text, dictionary))
    share = spark.sparkContext.broadcast(dictionary)

    def pack(batches):
        own, width, number = share.value, Encoder.of(path).width, 0
        docs_, counts, arrays, held = [], [], [], 0

        def close():
            nonlocal number, docs_, counts, arrays, held
            batch = pa.RecordBatch.from_arrays([
                pa.array([number], pa.int32()),
                pa.array([docs_], pa.list_(to_arrow_type(kind))),
                pa.array([sum(counts)], pa.int64()),
                pa.array([image(arrays, counts, own, width)], pa.binary()),
            ], ["number", "docs", "tokens", "image"])
            number, docs_, counts, arrays, held = number + 1, [], [], [], 0
            return batch

        for batch in batches:
            for doc, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                docs_.append(doc), counts.append(n), arrays.append(ids)
                held += len(ids)
                if held >= shard_bytes:
                    yield close()
        if arrays:
            yield close()

    # Range bounds are sampled, so whole arrays aren't among their keys.
    ordered = rows.withColumn("_hash", F.xxhash64("_ids"))
    ordered = ordered.repartitionByRange(F.col("_doc").asc_nulls_first(), "_hash").sortWithinPartitions(
        F.col("_doc").asc_nulls_first(), "_hash", "_ids"
    ).drop("_hash")
    packed = ordered.mapInArrow(
        pack, f"number int, docs array<{kind.simpleString()}>, tokens bigint, image binary"
    ).withColumn("part", F.spark_partition_id())
    packed.write.parquet(f"{folder}/shards")
    # One narrow row per shard.
    sizes = spark.read.parquet(f"{folder}/shards").select("part", "number", "tokens")
    before = F.sum("tokens").over(
        Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes.withColumn("first_token", F.coalesce(before, F.lit(0))).write.parquet(
        f"{folder}/manifest"
    )


def read_tokens(spark: SparkSession, folder: str, fields: str, describe) -> DataFrame:
    """One row per document from the written shards.

    ``describe(doc, start within the shard, ids)`` gives a row's values; ``fields`` is their schema. A
    column first_token has the ids before the shard.
    """
    row = spark.read.parquet(f"{folder}/dictionary").first()
    share = spark.sparkContext.broadcast(bytes(row["dictionary"]))
    table = spark.read.parquet(f"{folder}/shards").join(
        spark.read.parquet(f"{folder}/manifest").select("part", "number", "first_token"),
        ["part", "number"],
    ).select("first_token", "docs", "image")
    names = spark.createDataFrame([], fields).schema

    def unpack(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch.column(2)[k].as_py(), share.value)
                docs_, start, rows = batch.column(1)[k].as_py(), 0, []
                for i in range(len(shard)):
                    ids = shard.ids(i)
                    rows.append(describe(docs_[i], start, ids))
                    start += len(ids)
                first = pa.array([batch.column(0)[k].as_py()] * len(rows), pa.int64())
                columns = [
                    pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(zip(*rows), names)
                ]
                yield pa.RecordBatch.from_arrays([first, *columns], ["first_token", *names.names])

    return table.mapInArrow(unpack, f"first_token bigint, {fields}")


def document_digests(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32) of every document in the written shards."""
    def describe(doc, start, ids):
        return doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    rows = read_tokens(spark, folder, f"doc {kind}, start bigint, n_tokens bigint, ids_crc32 bigint",
                       describe)
    return rows.withColumn("start", F.col("start") + F.col("first_token")).drop("first_token")
