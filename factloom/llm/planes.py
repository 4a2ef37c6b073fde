"""Token ids in bit- or byte-plane files.

A file is a run of stripes, each closed by MAGIC.  A stripe holds whole documents:

    planes of block 0, planes of block 1, ..., index (zstandard), footer, MAGIC

A block is BLOCK_IDS ids (the last one of a stripe may be shorter).  Its ids are transposed into planes,
either bytes 0..3 or bits 0..31 of every id; each plane is one zstandard frame, and planes of zeros are
left out.  The index lists, as little-endian 64-bit integers: the number of documents and of blocks; per
document its id, whether the id is null, and its number of ids; per block its number of ids, the CRC-32
of its ids and the stored length of each plane.  The footer holds the plane kind, the length of the
index and of the stripe, so stripes are found from the end of a file, and a reader can fetch the index
alone or single blocks.

Executors reach the store through Spark's text writer, whose record separator is MAGIC; it works for any
file system that Spark knows.  Files are written in ascending order of doc_id, and numbered so.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.common import BATCH_BYTES, arrow_batches, new_path, released, stage

MAGIC = b"FLPLANE1"
FOOTER = struct.Struct("<QQQ")  # 1: byte planes, 8: bit planes; bytes of the index; bytes of the stripe without MAGIC
PLANES = {"byte": 4, "bit": 32}
BLOCK_IDS = 1 << 16
STRIPE_IDS = 1 << 20
#: Pieces of text whose ids a task keeps, and their characters, at most.
CACHE_PIECES, CACHE_CHARS = 300_000, 4 << 20
#: Text of a file, on average: at least the first while there are FILES files or fewer, at most the second.
FILE_BYTES, FILES = (24 << 20, 128 << 20), 1024
#: A small table is divided among all cores, but not into files of less text than this.
LEAST_BYTES = 2 << 20


#: Where a text can't simply be cut at every space and line feed: other white space, and white space beside white space or an end.
_HARD = "[\\x00\\x09\\x0b-\\x0d\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z"
#: A letter or digit before punctuation: where the letters or digits end, so does what the pre-tokeniser takes.
_STEM_END = "([A-Za-z0-9\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}])([!-/:-@\\[-`{-~])"
#: Stems that the pre-tokeniser takes whole: letters only or digits only, after a space or not.
_WHOLE = "\\A ?(?:[A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{24f}]+|[0-9]+)\\z"
#: The characters by which byte-level models know octets: those that aren't printable in Latin-1 are moved.
_OCTETS = np.arange(256, dtype="<u2")
_OCTETS[[*range(33), *range(127, 161), 173]] = range(256, 324)
#: Stems that are encoded as one text.
JOINED = 5000


def _runs(flat: np.ndarray, begin: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[begin[k]:begin[k + 1]] for k of at, one after another, and where each begins, and the end.  Arrow copies them as binary values of four octets an id."""
    if not len(at):
        return np.empty(0, np.uint32), np.zeros(1, np.int64)
    runs = pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, [None, pa.py_buffer(begin * 4), pa.py_buffer(flat)]).take(pa.array(at))
    ends = np.frombuffer(runs.buffers()[1], np.int64, len(at) + 1) // 4
    return np.frombuffer(runs.buffers()[2], np.uint32, ends[-1]) if ends[-1] else np.empty(0, np.uint32), ends


class Encoder:
    """The ids of whole texts, with the ids of each distinct stem of a batch computed once, and of frequent ones kept.

    The byte-level pre-tokeniser always breaks before a single space that stands between two characters
    that aren't white space (the space opens the next token), and around such a line feed; so encoding the
    pieces one by one gives the ids of the whole text.  It also breaks where letters or digits are followed by
    punctuation, so a piece is one or more stems, and a word is encoded once whatever stands after it; a piece that
    holds an added token is one stem.  A stem of letters only or digits only is what the pre-tokeniser takes at once, so
    the tokenizer's model gets it without pre-tokenising.  Other white space doesn't divide pieces.  A tokenizer with another pre-tokeniser,
    with a normaliser or with added tokens that hold or take white space, encodes whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker on every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        parts = json.loads(self.tokenizer.to_str())
        how = parts["pre_tokenizer"] or {}
        self.divides = how.get("type") == "ByteLevel" and how.get("use_regex", True) and not how.get("add_prefix_space") and not parts["normalizer"]
        self.octets = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # of each id's text: a byte-level token has a character for each byte
        for token, k in self.tokenizer.get_vocab().items():
            self.octets[k] = len(token)
        added = self.tokenizer.get_added_tokens_decoder()  # found in a text before it is divided otherwise
        for k, token in added.items():
            self.octets[k] = len(token.content.encode())
        self.divides = self.divides and not any(re.search(r"\s", t.content) or t.lstrip or t.rstrip for t in added.values())
        self.added = "|".join(re.escape(t.content) for t in added.values()) or r"\z."
        self.kept = pa.array([], pa.string())
        self.chars = 0
        self.flat, self.begin = np.empty(0, np.uint32), np.zeros(1, np.int64)  # the ids of what is kept

    @staticmethod
    def pieces(text: str) -> list[str]:
        parts = text.split(" ")
        out, held = [], parts[0]
        for part in parts[1:]:
            if part and held and not part[0].isspace() and not held[-1].isspace():
                out.append(held)
                held = " " + part
            else:
                held = f"{held} {part}"
        out.append(held)
        return out

    def learn(self, stems: pa.Array, alone: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the stems one after another, number of each).  What the model doesn't get as it is, unless each is to be encoded alone, and a space opens is encoded as joined texts and cut at their ends."""
        whole = np.asarray(pc.and_not(pc.match_substring_regex(stems, _WHOLE), pc.match_substring_regex(stems, self.added)))
        flat, sizes = self.of_model(stems.filter(pa.array(whole)))
        joins = np.zeros(len(stems), bool) if alone else ~whole & np.asarray(pc.starts_with(stems, " "))
        plain = stems.filter(pa.array(joins))
        edges = np.append(np.arange(0, len(plain), JOINED), len(plain))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), plain), "").to_pylist()
        joined = np.concatenate([np.empty(0, np.uint32), *(np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))])
        owner = np.searchsorted(np.cumsum(pc.binary_length(plain).to_numpy(), dtype=np.int64), np.cumsum(self.octets[joined]))
        others = self.tokenizer.encode_batch_fast(stems.filter(pa.array(~whole & ~joins)).to_pylist(), add_special_tokens=False)
        sizes = np.concatenate([sizes, np.bincount(owner, minlength=len(plain)), np.array([len(x.ids) for x in others], np.int64)])
        flat = np.concatenate([flat, joined, *(np.array(x.ids, np.uint32) for x in others)])
        at = np.empty(len(stems), np.int64)
        at[np.concatenate([np.flatnonzero(whole), np.flatnonzero(joins), np.flatnonzero(~whole & ~joins)])] = np.arange(len(stems))
        ids, begin = _runs(flat, np.concatenate([[0], np.cumsum(sizes)]), at)
        return ids, np.diff(begin)

    def of_model(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of stems that are one token to the pre-tokeniser, number of each)."""
        ids, sizes, tokenize = array("I"), array("q"), self.model.tokenize
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(stems)], pa.int32()), stems), "\n")[0].as_buffer()
        for stem in _OCTETS[np.frombuffer(lines, np.uint8)].tobytes().decode("utf-16-le").split(chr(_OCTETS[10])) if len(stems) else ():
            found = tokenize(stem)
            ids.extend([x.id for x in found])
            sizes.append(len(found))
        return np.array(ids, np.uint32), np.array(sizes, np.int64)

    def ids_of(self, stems: pa.Array, times: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct stems one after another, where each begins, and the end).  Of new ones the most frequent are kept while there is room."""
        known = pc.index_in(stems, value_set=self.kept)
        fresh = np.asarray(known.is_null())
        at = pc.fill_null(known, 0).to_numpy().astype(np.int64)
        flat, begin = self.flat, self.begin
        if fresh.any():
            new = stems.filter(pa.array(fresh))
            ids, sizes = self.learn(new, alone)
            at[fresh] = len(self.kept) + np.arange(len(new))
            flat, begin = np.concatenate([flat, ids]), np.concatenate([begin, begin[-1] + np.cumsum(sizes)])
            if not alone and len(self.kept) < CACHE_PIECES and self.chars < CACHE_CHARS:
                wanted = np.argsort(-times[fresh], kind="stable")[: CACHE_PIECES - len(self.kept)]
                size = pc.utf8_length(new).to_numpy()[wanted]
                wanted = wanted[self.chars + np.cumsum(size) - size < CACHE_CHARS]
                more, ends = _runs(flat, begin, len(self.kept) + wanted)
                self.flat, self.begin = np.concatenate([self.flat, more]), np.concatenate([self.begin, self.begin[-1] + ends[1:]])
                self.kept = pa.concat_arrays([self.kept, new.take(pa.array(wanted))])
                self.chars += int(size[: len(wanted)].sum())
        return _runs(flat, begin, at)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.divides:
            return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        hard = np.asarray(pc.or_(pc.match_substring_regex(texts, _HARD), pc.equal(texts, "")))
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        if not hard.all():
            easy = texts.filter(pa.array(~hard))
            marked = pc.replace_substring(pc.replace_substring(easy, "\n", "\0\n\0"), " ", "\0 ")
            split = pc.split_pattern(marked, "\0")
            pieces = split.flatten().dictionary_encode()
            which = pieces.indices.to_numpy()
            whole = pc.match_substring_regex(pieces.dictionary, self.added)
            parts = pc.split_pattern(pc.if_else(whole, pieces.dictionary, pc.replace_substring_regex(pieces.dictionary, _STEM_END, "\\1\0\\2")), "\0")
            stems = parts.flatten().dictionary_encode()
            of_piece, cuts = stems.indices.to_numpy(), parts.offsets.to_numpy()
            times = np.bincount(of_piece, np.repeat(np.bincount(which, minlength=len(parts)), np.diff(cuts)), len(stems.dictionary))
            ids, ends = _runs(*self.ids_of(stems.dictionary, times, False), of_piece)
            ids, ends = _runs(ids, ends[cuts], which)
            self.deal(out, np.flatnonzero(~hard), ids, ends[split.offsets.to_numpy()])
        if hard.any():
            split = [self.pieces(text) if text else [] for text in texts.filter(pa.array(hard)).to_pylist()]
            stems = pa.array([piece for pieces in split for piece in pieces], pa.string()).dictionary_encode()
            ids, ends = _runs(*self.ids_of(stems.dictionary, np.empty(0), True), stems.indices.to_numpy())
            self.deal(out, np.flatnonzero(hard), ids, ends[np.cumsum([0, *map(len, split)])])
        return out

    @staticmethod
    def deal(out: list[np.ndarray], which: np.ndarray, ids: np.ndarray, edges: np.ndarray) -> None:
        """Put the ids between edges to the places of their texts."""
        for k, a, b in zip(which.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            out[k] = ids[a:b]


@functools.lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder; what it keeps is bounded, and stays for the tasks that the worker gets later."""
    return Encoder(path)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block, empty where all bits are zero."""
    octets = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if kind == "byte":
        planes = list(octets)
    else:
        planes = [np.packbits((octets[k // 8] >> (k % 8)) & 1, bitorder="little") for k in range(32)]
    squeeze = zstandard.ZstdCompressor(level=3).compress
    return [squeeze(p.tobytes()) if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    octets = np.zeros((4, n), np.uint8)
    expand = zstandard.ZstdDecompressor().decompress
    for k, plane in enumerate(planes):
        if plane:
            raw = np.frombuffer(expand(plane), np.uint8)
            if kind == "byte":
                octets[k] = raw
            else:
                octets[k // 8] |= np.unpackbits(raw, count=n, bitorder="little") << (k % 8)
    return np.ascontiguousarray(octets.T).view("<u4").reshape(-1)


def pack_stripe(docs: list[int | None], parts: list[np.ndarray], kind: str) -> bytes:
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    body, blocks = [], []
    for i in range(0, len(ids), BLOCK_IDS):
        block = ids[i : i + BLOCK_IDS]
        planes = to_planes(block, kind)
        body += planes
        blocks += [len(block), zlib.crc32(block.astype("<u4").tobytes()), *map(len, planes)]
    index = np.array([len(docs), -(-len(ids) // BLOCK_IDS), *(d or 0 for d in docs), *(d is None for d in docs), *map(len, parts), *blocks], "<i8")
    index = zstandard.ZstdCompressor(level=3).compress(index.tobytes())
    body.append(index)
    size = sum(map(len, body)) + FOOTER.size
    return b"".join([*body, FOOTER.pack(1 if kind == "byte" else 8, len(index), size)])


def unpack_stripe(stripe: memoryview) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, number of ids of each, all ids); a damaged block raises ValueError."""
    code, index_size, size = FOOTER.unpack(stripe[-FOOTER.size :])
    kind = "byte" if code == 1 else "bit"
    at = size - FOOTER.size - index_size
    index = np.frombuffer(zstandard.ZstdDecompressor().decompress(stripe[at : at + index_size]), "<i8")
    n_docs, n_blocks = int(index[0]), int(index[1])
    docs, null, lengths = index[2 : 2 + 3 * n_docs].reshape(3, n_docs)
    out, at = [], 0
    for n, crc, *sizes in index[2 + 3 * n_docs :].reshape(n_blocks, 2 + PLANES[kind]).tolist():
        planes = []
        for s in sizes:
            planes.append(bytes(stripe[at : at + s]))
            at += s
        ids = from_planes(planes, n, kind)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a block does not match its checksum")
        out.append(ids)
    return [None if x else d for d, x in zip(docs.tolist(), null.tolist(), strict=True)], lengths, np.concatenate(out) if out else np.empty(0, "<u4")


def stripes_of(content: memoryview) -> list[memoryview]:
    """The stripes of a file in order, found from its end."""
    found, end = [], len(content)
    while end:
        if content[end - len(MAGIC) : end] != MAGIC:
            raise ValueError("not a plane file")
        size = FOOTER.unpack(content[end - len(MAGIC) - FOOTER.size : end - len(MAGIC)])[2]
        end -= len(MAGIC)
        found.append(content[end - size : end])
        end -= size
    return found[::-1]


def write_planes(docs: DataFrame, path: str, tokenizer: str, end_id: int, kind: str = "byte") -> None:
    """Encode docs (doc_id, text; null texts are empty), append end_id to each, and write plane files in order of doc_id.

    Null doc_ids come first; rows that share a doc_id keep their order, and may go to several files.  Other columns are
    ignored.  An empty table gives files without stripes.
    """
    total = docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    files = max(1, min(total // FILE_BYTES[0], FILES), total // FILE_BYTES[1], min(cores, total // LEAST_BYTES))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        held: list[int | None] = []
        parts: list[np.ndarray] = []
        size = 0
        end = np.array([end_id], np.uint32)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            i = 0
            while i < len(doc_ids):
                j, weight = i, 0
                while j < len(doc_ids) and weight < BATCH_BYTES:
                    weight += len(texts[j].as_buffer()) if texts[j].is_valid else 0
                    j += 1
                for doc, ids in zip(doc_ids[i:j], encoder.encode(texts[i:j]), strict=True):
                    held.append(doc)
                    parts.append(np.concatenate([ids, end]))
                    size += len(ids) + 1
                    if size >= STRIPE_IDS:
                        yield pa.RecordBatch.from_arrays([pa.array([pack_stripe(held, parts, kind)], pa.binary())], ["stripe"])
                        held, parts, size = [], [], 0
                i = j
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pack_stripe(held, parts, kind)], pa.binary())], ["stripe"])

    order = ["doc_id", "tie"]
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("tie")).repartitionByRange(files, *order).sortWithinPartitions(*order)
    stripes = rows.select("doc_id", "text").mapInArrow(released(encode), "stripe binary").select(F.col("stripe").cast("string").alias("value"))
    with arrow_batches(docs.sparkSession):
        stripes.write.option("lineSep", MAGIC.decode()).text(path)


def read_planes(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(file, row, doc_id, local_start, n_tokens, ids_crc32[, ids]) per document; local_start counts ids within the file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = row = 0
                for stripe in stripes_of(memoryview(content.as_buffer())):
                    docs, lengths, ids = unpack_stripe(stripe)
                    cuts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                    parts = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    columns = [
                        pa.array([name] * len(docs), pa.int64()),
                        pa.array(np.arange(row, row + len(docs))),
                        pa.array(docs, pa.int64()),
                        pa.array(cuts[:-1] + start),
                        pa.array(lengths.astype(np.int64)),
                        pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64()),
                    ]
                    names = ["file", "row", "doc_id", "local_start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)
                    start, row = start + int(cuts[-1]), row + len(docs)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")
    schema = "file bigint, row bigint, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("bigint").alias("file"), "content").mapInArrow(released(read), schema)


def token_table(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "byte") -> DataFrame:
    """Write docs as plane files, read them back and digest them: (doc_id, start, n_tokens, ids_crc32).

    start is the number of ids of all documents before it.  The table of file totals has one row for each
    file of many megabytes.
    """
    spark = docs.sparkSession
    path = new_path(spark, "planes")
    write_planes(docs, path, tokenizer, end_id, kind)
    with arrow_batches(spark):
        rows = stage(read_planes(spark, path), "digests")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return rows.join(before, "file").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
