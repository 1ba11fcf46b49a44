"""Media columns: content-defined chunking with a gear hash, chunk digests deduplicated by joins."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import Workspace

#: Bytes of a chunk: at least, on average about LEAST + 2**BITS, at most.
LEAST, BITS, MOST = 256, 10, 8192
#: Payloads are padded by bytes 0 to a positive multiple of this.
UNIT = 64
#: The hash depends on this many bytes; texts are hashed in blocks of BLOCK.
WINDOW, BLOCK = 32, 1 << 22
MAGIC = b"CDC1"
#: Bits of the filter of shared digests.
FILTER_BITS = 1 << 24

_GEAR = np.random.default_rng(0x6EA2).integers(0, 2**32, 256, dtype=np.uint32)


def pad(data: bytes) -> bytes:
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def marks(raw: np.ndarray) -> np.ndarray:
    """Ends of possible chunks: after each byte at which the rolling gear hash of the last WINDOW bytes has BITS leading zeros."""
    out = []
    for at in range(0, len(raw), BLOCK):
        lead = min(at, WINDOW - 1)
        h = _GEAR[raw[at - lead : at + BLOCK]]
        width = 1
        while width < WINDOW:  # h becomes the sum over twice as many bytes, older ones shifted left
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
            width *= 2
        out.append(np.flatnonzero(h[lead:] >> np.uint32(32 - BITS) == 0) + at + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def chunks(payload: bytes) -> Iterator[bytes]:
    ends, at = marks(np.frombuffer(payload, np.uint8)), 0
    while at < len(payload):
        i = np.searchsorted(ends, at + LEAST)
        end = min(int(ends[i]) if i < len(ends) else len(payload), at + MOST, len(payload))
        yield payload[at:end]
        at = end


def recipe(n_bytes: int, parts: list[tuple[bytes, int]]) -> bytes:
    """The ordered chunk list of a payload: digests and lengths."""
    return MAGIC + struct.pack("<QI", n_bytes, len(parts)) + b"".join(d + struct.pack("<I", n) for d, n in parts)


def read_recipe(data: bytes) -> tuple[int, list[tuple[bytes, int]]]:
    n_bytes, n = struct.unpack_from("<QI", data, 4)
    if data[:4] != MAGIC or len(data) != 16 + 36 * n:
        raise ValueError("broken chunk list")
    return n_bytes, [(data[i : i + 32], struct.unpack_from("<I", data, i + 32)[0]) for i in range(16, len(data), 36)]


def rebuild(listed: bytes, have: dict[bytes, bytes]) -> tuple[int, bytes, list[int]]:
    """Unpadded length, payload and chunk lengths; every chunk is checked against its digest."""
    n_bytes, parts = read_recipe(listed)
    out = []
    for digest, n in parts:
        data = have[digest]
        if len(data) != n or hashlib.sha256(data).digest() != digest:
            raise ValueError("a chunk does not match its digest")
        out.append(data)
    return n_bytes, b"".join(out), [n for _, n in parts]


def _facts(key: bytes, listed: bytes, have: dict[bytes, bytes]) -> tuple:
    n_bytes, payload, sizes = rebuild(listed, have)
    used = int(np.count_nonzero(np.bincount(np.frombuffer(payload, np.uint8), minlength=256)))
    feature = f"chunks={len(sizes)} distinct={len(have)} shortest={min(sizes)} longest={max(sizes)} byte_values={used}"
    parts = dict.fromkeys(digest for digest, _ in read_recipe(listed)[1])
    stored = listed + b"".join(have[d] for d in parts)  # what the store holds for it: the list, and each of its chunks once
    return key, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


_FACTS = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
_NAMES = [x.split()[0] for x in _FACTS.split(", ")]
_KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_PART = pa.struct([("digest", pa.binary()), ("data", pa.binary())])


def _rows(columns: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*columns, strict=True) if columns else [[]] * len(kinds), kinds, strict=True)], names)


def _cells(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:4], "little") % FILTER_BITS, int.from_bytes(digest[4:8], "little") % FILTER_BITS


def _digests(text: str) -> dict[bytes, bytes]:
    return {hashlib.sha256(c).digest(): c for c in chunks(pad(text.encode()))}


def shared_filter(docs: DataFrame) -> np.ndarray:
    """A Bloom filter, of fixed size, of the chunk digests that more than one document has.

    A chunk outside it belongs to one document for certain. Only digests are shuffled.
    """

    def digests(batches):
        for batch in batches:
            yield _rows([(d,) for t in batch.column(0) for d in _digests(t.as_py())], [pa.binary()], ["digest"])

    def cells(batches):
        for batch in batches:
            yield _rows([(c,) for d in batch.column(0) for c in _cells(d.as_py())], [pa.int64()], ["cell"])

    again = docs.select("text").mapInArrow(digests, "digest binary").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    at = again.select("digest").mapInArrow(cells, "cell bigint").distinct().toArrow()["cell"].to_numpy()  # FILTER_BITS at most
    out = np.zeros(FILTER_BITS, bool)
    out[at] = True
    return np.packbits(out)


def store(docs: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Packs (doc_id, key, chunk list, own chunks and digests of borrowed ones) and the shared chunks (digest, data).

    A document's pack holds the chunks that it alone has; every other chunk is stored once, by its
    digest. Texts are not shuffled: chunks are cut where the text is read, and only those that pass the
    filter of shared digests move to be deduplicated.
    """
    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(shared_filter(texts))

    def split(text: str) -> tuple[dict[bytes, bytes], dict[bytes, bytes], list[tuple[bytes, int]]]:
        bits, own, other, listed = known.value, {}, {}, []
        for c in chunks(pad(text.encode())):
            d = hashlib.sha256(c).digest()
            listed.append((d, len(c)))
            (other if all(bits[i >> 3] >> (7 - (i & 7)) & 1 for i in _cells(d)) else own)[d] = c
        return own, other, listed

    def pack(batches):
        for batch in batches:
            out = []
            for doc, t in zip(*batch.columns, strict=True):
                text = t.as_py()
                own, other, listed = split(text)
                out.append((doc.as_py(), hashlib.sha256(text.encode()).digest(), recipe(len(text.encode()), listed), [{"digest": d, "data": c} for d, c in own.items()], list(other)))
            yield _rows(out, [pa.int64(), pa.binary(), pa.binary(), pa.list_(_PART), pa.list_(pa.binary())], ["doc_id", "key", "recipe", "own", "borrowed"])

    def lend(batches):
        for batch in batches:
            yield _rows([x for t in batch.column(0) for x in split(t.as_py())[1].items()], [pa.binary(), pa.binary()], ["digest", "data"])

    shared = texts.select("text").mapInArrow(lend, "digest binary, data binary").groupBy("digest").agg(F.min("data").alias("data"))
    shared = work.keep(shared, "shared")
    packs = work.keep(texts.mapInArrow(pack, "doc_id bigint, key binary, recipe binary, own array<struct<digest:binary,data:binary>>, borrowed array<binary>"), "packs")
    return packs, shared


def read(packs: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id and the facts of every stored payload, from its chunk list and chunks; borrowed chunks come by a join on their digest.

    Copies of a text have equal packs, of which one is put together."""

    def facts(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                have = {p["digest"]: p["data"] for column in ("own", "fetched") for p in row.get(column) or ()}
                out.append(_facts(row["id"], row["recipe"], have))
            yield _rows(out, [batch.schema.field("id").type, *_KINDS[1:]], ["id", *_NAMES])

    alone = packs.where("size(borrowed) = 0").select(F.col("doc_id").alias("id"), "recipe", "own").mapInArrow(facts, f"id bigint, {_FACTS}")
    some = packs.where("size(borrowed) > 0")
    wanted = some.select("key", F.explode("borrowed").alias("digest")).distinct()
    fetched = wanted.join(shared, "digest").groupBy("key").agg(F.collect_list(F.struct("digest", "data")).alias("fetched"))
    lists = some.groupBy("key").agg(F.min("recipe").alias("recipe"))
    own = some.where("size(own) > 0").select(F.col("key").alias("k"), "own")
    mixed = fetched.join(lists, "key").join(own, F.expr("key = k"), "left")
    mixed = mixed.select(F.col("key").alias("id"), "recipe", "own", "fetched").mapInArrow(facts, f"id binary, {_FACTS}")
    copies = some.select("doc_id", "key").join(mixed, F.expr("key = id")).select("doc_id", *_NAMES)
    return alone.withColumnRenamed("id", "doc_id").unionByName(copies)


def columns(docs: DataFrame) -> DataFrame:
    """doc_id and the facts of its stored payload, read back; equal texts have equal values.

    The stored form is the chunk list followed by every chunk in it once, in the list's order, as the tables hold them.

    A null text counts as empty, and an empty payload is one unit of zeros; null ids and repeated rows
    each keep their row; an empty table gives none; further columns are ignored.
    """
    return read(*store(docs, Workspace(docs.sparkSession, "media")))
