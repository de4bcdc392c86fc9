"""Line dedup: documents probe a sharded minimal perfect hash of the repeated lines.

A line's key is the line without blanks at both ends, A-Z lower-cased; it counts from ``least`` code points on.  A
key found in two documents or more stays only in the smallest doc_id that holds it.

1. Every document gives the distinct 128-bit hashes of its keys (written once, 16 bytes a line).
2. One aggregation per hash: documents, smallest and largest doc_id.  Hashes of two documents or more are dealt to
   shards of bounded size; each shard becomes a minimal perfect hash (levels of bit arrays with ranks) that
   indexes three plain arrays: 64-bit fingerprints, document counts, first documents.
3. Documents send their hashes, packed per batch and shard, to the shard's arrays and get back only hits.  A shard that
   would meet more probes than one task should hold is copied, each copy serving a part of the documents.

No line text is shuffled, and no line is joined with a line.  A fingerprint of 64 bits besides the 64 bits that choose shard and
slot makes a false hit as unlikely as a collision of 128-bit hashes.

Defined cases: null and empty text are one empty line; a document that loses all lines gets an empty text; a null
doc_id neither counts nor loses lines; repeated rows of one doc_id count as one document and lose the same lines; result columns
replace columns of their name; other columns pass through; no documents give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrymill.llm.common import column, map_batches, mixed, others, own_name, pieces, raw, ready, stored

LEAST = 10
#: Repeated lines of one shard, and probed lines that meet one copy of a shard.
SHARD_LINES, PROBES = 200_000, 2_000_000
_GAMMA = 2


def key_of(line: bytes, least: int = LEAST) -> bytes | None:
    """The key of a line, or None if it is too short; bytes.strip and bytes.lower work on ASCII alone."""
    key = line.strip().lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def _hashes(text: bytes, least: int) -> set[bytes]:
    keys = {key_of(line, least) for line in text.split(b"\n")}
    return {xxhash.xxh3_128_digest(k) for k in keys if k is not None}


def _level(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
        return (mixed(hi.view(np.uint64) ^ mixed(lo.view(np.uint64) + seed)) % np.uint64(size)).astype(np.int64)


def build(hi: np.ndarray, lo: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Minimal perfect hash of distinct 128-bit keys: level sizes, bits of all levels, and the slot of each key.

    On each level a key that is alone at its place takes it; the others go on to the next level.
    """
    sizes, levels, left = [], [], np.arange(len(hi))
    places = np.zeros(len(hi), np.int64)
    offset = 0
    while len(left):
        size = max(64, _GAMMA * len(left))
        at = _level(hi[left], lo[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        held = alone[at]
        places[left[held]] = offset + at[held]
        sizes.append(size)
        levels.append(alone)
        offset += size
        left = left[~held]
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    return sizes, bits, (np.cumsum(bits) - 1)[places] if len(hi) else places


def probe(sizes: list[int], bits: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 where no level holds its place.  A key that was not built in may get any slot."""
    rank = np.cumsum(bits, dtype=np.int64) - 1
    out, left, offset = np.full(len(hi), -1, np.int64), np.arange(len(hi)), 0
    for level, size in enumerate(sizes):
        if not len(left):
            break
        at = offset + _level(hi[left], lo[left], level, size)
        held = bits[at]
        out[left[held]] = rank[at[held]]
        left = left[~held]
        offset += size
    return out


_ARRAYS = "shard long, sizes binary, bits binary, prints binary, counts binary, firsts binary"


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    hi, lo = rows["hi"].to_numpy(np.int64), rows["lo"].to_numpy(np.int64)
    sizes, bits, slot = build(hi, lo)
    arrays = [np.zeros(len(hi), t) for t in (np.int64, np.int64, np.int64)]
    for out, values in zip(arrays, (lo, rows["n"].to_numpy(np.int64), rows["first"].to_numpy(np.int64)), strict=True):
        out[slot] = values
    return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "sizes": [np.array(sizes, np.int64).tobytes()],
                         "bits": [np.packbits(bits).tobytes()], "prints": [arrays[0].tobytes()],
                         "counts": [arrays[1].tobytes()], "firsts": [arrays[2].tobytes()]})


def _probed(packets: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, print) of the probed lines that an earlier document holds."""
    if not len(shard) or not len(packets):
        return pd.DataFrame({"doc_id": np.zeros(0, np.int64), "print": np.zeros(0, np.int64)})
    row = shard.iloc[0]
    sizes = np.frombuffer(row["sizes"], np.int64).tolist()
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
    prints, firsts = np.frombuffer(row["prints"], np.int64), np.frombuffer(row["firsts"], np.int64)
    hi, lo, doc = (np.frombuffer(b"".join(packets[c]), np.int64) for c in ("hi", "lo", "docs"))
    slot = probe(sizes, bits, hi, lo)
    hit = slot >= 0
    hit[hit] = (prints[slot[hit]] == lo[hit]) & (firsts[slot[hit]] != doc[hit])
    return pd.DataFrame({"doc_id": doc[hit], "print": lo[hit]})


def repeated_lines(keys: DataFrame) -> DataFrame:
    """hi, lo, n (rows that hold it), first (smallest doc_id) of the keys that two documents hold."""
    lines = keys.select("doc_id", F.inline(F.arrays_zip("hi", "lo")))
    return (lines.groupBy("hi", "lo")
            .agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("_last"))
            .where("first <> _last").drop("_last"))


def line_index(repeated: DataFrame, shards: int) -> DataFrame:
    """One row of arrays per shard."""
    return repeated.withColumn("shard", F.pmod("hi", F.lit(shards))).groupBy("shard").applyInPandas(_shard, _ARRAYS)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                shard_lines: int = SHARD_LINES, probes: int = PROBES) -> DataFrame:
    """All rows and columns; text without its dropped lines, n_lines (before) and n_dropped."""
    ready(docs.sparkSession)

    def keyed(batches):
        for batch in batches:
            his, los = [], []
            for text in raw(batch.column(1)):
                both = np.frombuffer(b"".join(sorted(_hashes(text, least))), np.int64).reshape(-1, 2)
                his.append(both[:, 0])
                los.append(both[:, 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(his, pa.list_(pa.int64())), pa.array(los, pa.list_(pa.int64()))],
                                             ["doc_id", "hi", "lo"])

    keys = stored(docs.where(column(id_col).isNotNull())
                  .select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
                  .mapInArrow(keyed, "doc_id long, hi array<long>, lo array<long>"))
    repeated = stored(repeated_lines(keys))
    shards = pieces(repeated.count(), shard_lines)
    # probes that meet a shard: those of its own lines, and its share of all others
    asked = keys.agg(F.sum(F.size("hi"))).first()[0] or 0
    copies = (repeated.groupBy(F.pmod("hi", F.lit(shards)).alias("shard"))
              .agg(F.ceil((F.sum("n") + asked // shards) / probes).alias("copies")))
    at = {r["shard"]: int(r["copies"]) for r in copies.collect()}  # one row per shard, not per line

    def packed(batches):
        for batch in batches:
            doc = np.repeat(np.asarray(batch.column(0)), np.diff(np.asarray(batch.column(1).offsets)))
            hi, lo = np.asarray(batch.column(1).flatten()), np.asarray(batch.column(2).flatten())
            shard = hi % shards
            order = np.argsort(shard, kind="stable")
            found, starts = np.unique(shard[order], return_index=True)
            spread = int(doc[0]) if len(doc) else 0
            out = {"shard": [], "copy": [], "docs": [], "hi": [], "lo": []}
            for s, rows in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
                if s in at:  # a shard without repeated lines drops nothing
                    out["shard"].append(s)
                    out["copy"].append(spread % at[s])
                    for name, values in (("docs", doc), ("hi", hi), ("lo", lo)):
                        out[name].append(values[rows].tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("shard", pa.int64()), ("copy", pa.int64()), ("docs", pa.binary()),
                                                             ("hi", pa.binary()), ("lo", pa.binary())]))

    packets = keys.mapInArrow(packed, "shard long, copy long, docs binary, hi binary, lo binary")
    index = line_index(repeated, shards).withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("long"), _copies_of(F.col("shard"), at) - 1)))
    hits = packets.groupBy("shard", "copy").cogroup(index.groupBy("shard", "copy")).applyInPandas(
        _probed, "doc_id long, print long")
    drops, key = own_name(docs, "_drops"), own_name(docs, "_doc")
    lost = hits.groupBy("doc_id").agg(F.collect_set("print").alias(drops)).withColumnRenamed("doc_id", key)
    joined = docs.join(lost, column(id_col).cast("long") == F.col(key), "left").drop(key)
    names = others(docs, "n_lines", "n_dropped")
    place = names.index(text_col)
    types = {f.name: f.dataType for f in docs.schema}
    types[text_col] = T.StringType()
    schema = T.StructType([T.StructField(c, types[c]) for c in names]
                          + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def without(batches):
        for batch in batches:
            texts, n_lines, n_dropped = batch.column(place).cast(pa.binary()).to_pylist(), [], []
            for i, prints in enumerate(batch.column(len(names)).to_pylist()):
                lines = (texts[i] or b"").split(b"\n")
                n_lines.append(len(lines))
                if prints:
                    prints = set(prints)
                    left = []
                    for line in lines:
                        k = key_of(line, least)
                        if k is None or int.from_bytes(xxhash.xxh3_128_digest(k)[8:], "little", signed=True) not in prints:
                            left.append(line)
                    texts[i] = b"\n".join(left)
                    n_dropped.append(len(lines) - len(left))
                else:
                    n_dropped.append(0)
            columns = [batch.column(i) for i in range(len(names))]
            columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                             [f.name for f in schema])

    return map_batches(joined.select(*[column(c) for c in names], column(drops)), without, schema)


def _copies_of(shard, at: dict[int, int]):
    """Copies of a shard, from a literal map of the shards that need more than one."""
    many = {k: v for k, v in at.items() if v > 1}
    if not many:
        return F.lit(1).cast("long")
    pairs = [F.lit(x).cast("long") for kv in many.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[shard], F.lit(1).cast("long"))
