"""Media columns: texts as 8-bit samples in content-defined, deduplicated chunks.

The payload of a text is its UTF-8, filled with bytes 255 to a positive multiple
of ``FRAME``.  It is stored losslessly as 8-bit mono PCM (a WAV container: a
44-byte header and the samples).  The samples are cut where a rolling gear hash
has ``MASK_BITS`` zero bits (between ``MIN_CHUNK`` and ``MAX_CHUNK`` bytes).

Storage: an item is a distinct media file, by its digest.  Each chunk digest is
owned by the item of the smallest digest that has it, found by Spark
aggregation and joins over digests alone (no payload moves for it).  The store
is a Parquet table with a row for each item: the file header, the ordered chunk
list and the data of the chunks that it owns, compressed.  An item's bytes are put together from
its own chunks and those fetched, by joins, from their owners; every chunk and
the whole file are verified by digest before features are computed.

Defined results: null and empty texts are one frame of 255; equal texts are one
item and have equal values; repeated rows keep a row each; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

FRAME = 576
FILL = 255
RATE = 8000
TAIL = 32
MIN_CHUNK, MAX_CHUNK, MASK_BITS = 512, 8192, 11
#: Borrowers of a chunk that one task serves, about.
SHARE = 1000
_WINDOW = 32
_HEADER = 44


def gear_table(seed: int = 576) -> np.ndarray:
    """A random 32-bit number for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


GEAR = gear_table()


def payload(text: bytes) -> bytes:
    """UTF-8 filled with bytes 255 to a positive multiple of ``FRAME``."""
    return text + bytes([FILL]) * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def wav(samples: bytes) -> bytes:
    """A WAV file of 8-bit mono samples (an even number of them, so without a pad byte)."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def samples_of(media: bytes) -> bytes:
    """The samples of a file that ``wav`` made; raises on anything else."""
    tag, _, kind, _, _, code, channels, _, _, _, bits, data, n = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:_HEADER])
    if (tag, kind, data, code, channels, bits) != (b"RIFF", b"WAVE", b"data", 1, 1, 8) or len(media) != _HEADER + n:
        raise ValueError("not an 8-bit mono PCM file")
    return media[_HEADER:]


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of ``data``.

    The gear hash of a place is the sum of the last 32 bytes' gear numbers, each
    shifted by its distance; five doublings give it for all places at once.
    """
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    k = 1
    while k < _WINDOW:
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
        k *= 2
    places = np.flatnonzero(h >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, start, i = [], 0, 0
    places = places.tolist()
    while start < n:
        while i < len(places) and places[i] < start + MIN_CHUNK:
            i += 1
        end = min(places[i] if i < len(places) else n, start + MAX_CHUNK, n)
        out.append(end)
        start = end
    return out


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def features(samples: bytes) -> str:
    """Level, spread, zero crossings and a coarse spectrum-free envelope, as text of whole numbers."""
    x = np.frombuffer(samples, np.uint8)
    frames = x.reshape(-1, FRAME)
    sums = frames.sum(axis=1, dtype=np.int64)
    above = x >= 128
    envelope = [int(part.sum()) // (len(part) * FRAME) for part in np.array_split(sums, min(8, len(sums)))]
    return f"pcm8 rate={RATE} n={len(x)} mean={int(sums.sum()) // len(x)} min={int(x.min())} max={int(x.max())} crossings={int((above[1:] != above[:-1]).sum())} envelope={'-'.join(map(str, envelope))}"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, item, chunks): each row's item digest and ordered chunk digests; no payload."""

    def kernel(col: pa.Array) -> list:
        n, item, chunks = [], [], []
        for t in col:
            text = t.as_py().encode()
            data = payload(text)
            n.append(len(text))
            item.append(hashlib.sha256(wav(data)).digest())
            ends = cuts(data)
            chunks.append([_digest(data[a:b]) for a, b in zip([0, *ends], ends)])
        return [n, item, chunks]

    return runtime.map_text(docs, kernel, [("n_bytes", "bigint"), ("item", "binary"), ("chunks", "array<binary>")], text_col, (id_col,))


def foreign_chunks(listed: DataFrame, share: int = SHARE, salts: int = 16) -> DataFrame:
    """(item, chunk, owner, shares): chunks that an item has and another item owns.

    ``listed`` has (item, chunks) for distinct items.  Owners come from an
    aggregation over digests; only chunks in several items are joined back, a
    crowded one in ``salts`` tasks.  ``shares`` is in how many parts a chunk's
    borrowers are dealt, about ``share`` items each.
    """
    has = listed.select("item", F.explode(F.array_distinct("chunks")).alias("chunk")).withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)))
    shared = has.groupBy("chunk").agg(F.min("item").alias("owner"), F.count("*").alias("n")).where("n > 1")
    shared = shared.select("chunk", "owner", F.ceil(F.col("n") / share).cast("int").alias("shares"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt"))
    return has.join(shared, ["chunk", "salt"]).where("item <> owner").select("item", "chunk", "owner", "shares")


def _pack(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=6).compress(data, asbytes=True) if data else b""


def _unpack(packed: bytes, size: int) -> bytes:
    return pa.decompress(packed, size, codec="zstd", asbytes=True) if size else b""


def store(docs: DataFrame, foreign: DataFrame, text_col: str = "text") -> DataFrame:
    """Write and reread the store: (item, foreign, lent, header, chunks, sizes, own), a row for each distinct item.

    ``header`` is what stands before the samples in the file.  ``foreign`` are the chunks that it borrows and ``lent`` those that others
    borrow from it (null: none), so that readers need no join to tell.  ``chunks`` and ``sizes`` are the ordered chunk list; ``own`` is the data of
    the item's own chunks (each once, in order).  What is shuffled is compressed
    media, once; the table's own compression works across items.
    """

    def kernel(col: pa.Array) -> list:
        data = [payload(t.as_py().encode()) for t in col]
        return [[hashlib.sha256(wav(d)).digest() for d in data], [len(d) for d in data], [_pack(d) for d in data]]

    texts = runtime.map_text(docs, kernel, [("item", "binary"), ("size", "bigint"), ("packed", "binary")], text_col, ())
    borrows = foreign.groupBy("item").agg(F.collect_set("chunk").alias("foreign"))
    lends = foreign.groupBy(F.col("owner").alias("item")).agg(F.collect_set(F.struct("chunk", "shares")).alias("lent"))
    rows = texts.dropDuplicates(["item"]).join(borrows.join(lends, "item", "full"), "item", "left").select("item", "size", "packed", "foreign", "lent")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers, chunks, sizes, owns = [], [], [], []
            for size, packed, other in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                data = _unpack(packed, size)
                ends = cuts(data)
                parts = [data[a:b] for a, b in zip([0, *ends], ends)]
                names = [_digest(p) for p in parts]
                headers.append(wav(data)[:_HEADER])
                chunks.append(names)
                sizes.append([len(p) for p in parts])
                skip = set(other or ())
                owns.append(b"".join([p for c, p in dict(zip(names, parts)).items() if c not in skip]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), pa.array(headers, pa.binary()), pa.array(chunks, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32())), pa.array(owns, pa.binary())], names=["item", "foreign", "lent", "header", "chunks", "sizes", "own"])

    return runtime.materialize(rows.mapInArrow(stage, "item binary, foreign array<binary>, lent array<struct<chunk: binary, shares: int>>, header binary, chunks array<binary>, sizes array<int>, own binary"), "media", level=6)


def _own_chunks(chunks: list[bytes], sizes: list[int], foreign: list[bytes] | None, own: bytes) -> dict[bytes, bytes]:
    """The data of an item's own chunks, verified."""
    skip = set(foreign or ())
    wanted = {c: n for c, n in zip(chunks, sizes) if c not in skip}
    out, at = {}, 0
    for c, n in wanted.items():
        out[c] = own[at : at + n]
        at += n
        if _digest(out[c]) != c:
            raise ValueError("a stored chunk doesn't have its digest")
    return out


def fetched(stored: DataFrame, foreign: DataFrame) -> DataFrame:
    """(item, parts): for items with foreign chunks, those chunks' data, from their owners.

    Only owners that lend chunks are unpacked, and only lent chunks move, those
    of many borrowers once for each share of these.
    """
    owners = stored.where("lent IS NOT NULL").select("foreign", "chunks", "sizes", "own", "lent")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, salts, data = [], [], []
            for other, chunks, sizes, own, lent in zip(*(batch.column(i).to_pylist() for i in range(5))):
                have = _own_chunks(chunks, sizes, other, own)
                for chunk, shares in [(x["chunk"], x["shares"]) for x in lent]:
                    names += [chunk] * shares
                    salts += range(shares)
                    data += [_pack(have[chunk])] * shares
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(salts, pa.int64()), pa.array(data, pa.binary())], names=["chunk", "salt", "data"])

    parts = owners.mapInArrow(stage, "chunk binary, salt bigint, data binary")
    borrowed = foreign.select("item", "chunk", F.pmod(F.xxhash64("item"), F.col("shares").cast("bigint")).alias("salt"))
    return borrowed.join(parts, ["chunk", "salt"]).groupBy("item").agg(F.collect_list(F.struct("chunk", "data")).alias("parts"))


def read_back(stored: DataFrame, foreign: DataFrame, with_media: bool = False) -> DataFrame:
    """Each item's bytes put together and verified, and their digests and features."""
    cols = ["item", "foreign", "header", "chunks", "sizes", "own"]
    whole = stored.where("foreign IS NULL").select(*cols)  # stays where it is stored: no shuffle
    mended = stored.where("foreign IS NOT NULL").select(*cols).join(fetched(stored, foreign), "item", "left").select(*cols, "parts")
    names = ["item", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * with_media

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, other, header, chunks, sizes, own, parts in zip(*(c.to_pylist() for c in batch.columns)):
                have = _own_chunks(chunks, sizes, other, own)
                size = dict(zip(chunks, sizes))
                for p in parts or ():
                    have[p["chunk"]] = _unpack(p["data"], size[p["chunk"]])
                media = header + b"".join([have[c] for c in chunks])
                if hashlib.sha256(media).digest() != item:
                    raise ValueError("reconstructed media doesn't have its digest")
                data = samples_of(media)
                row = [item, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-TAIL:]), len(media), item.hex(), features(data)]
                out.append(row + [media] * with_media)
            if out:
                kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    schema = "item binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", media binary" * with_media
    kind = fetched(stored, foreign).schema["parts"].dataType
    return whole.withColumn("parts", F.lit(None).cast(kind)).mapInArrow(stage, schema).unionByName(mended.mapInArrow(stage, schema))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Store all texts as media, read them back, and return each row's digests and features."""
    seen = runtime.materialize(digests(docs, id_col, text_col), "digests")
    foreign = runtime.materialize(foreign_chunks(seen.select("item", "chunks").dropDuplicates(["item"])), "foreign")
    stored = store(docs, foreign, text_col)
    back = read_back(stored, foreign, with_media)
    return seen.select(id_col, "n_bytes", "item").join(back, "item").drop("item")
