"""Words, digests and hashes shared by the operators: as Spark columns and over Arrow batches."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\x20\x09-\x0D]+"

# Odd multipliers of the 64-bit mixing function.
_M1, _M2, _GOLD = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


# -- Spark columns -----------------------------------------------------------------------------

def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def bucket_of_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that a caller's further columns can't clash with an operator's own."""
    require(df, *columns)
    types = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "url": "string"}
    return df.select(*(F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in columns))


# -- numpy and Arrow ---------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def odd(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit multipliers, the same for the same seed."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * _GOLD) | np.uint64(1)


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(11)) * _GOLD)


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hash of every string, by its UTF-8 bytes; none may be null."""
    values = values.cast(pa.large_binary())
    n = len(values)
    if not n:
        return np.empty(0, np.uint64)
    offsets = np.frombuffer(values.buffers()[1], np.int64, n + 1, values.offset * 8)
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    starts = offsets[:-1] - offsets[0]
    lengths = np.diff(offsets)
    full = lengths > 0
    out = lengths.astype(np.uint64) * _M1
    if full.any():
        place = np.arange(len(raw), dtype=np.int64) - np.repeat(starts, lengths)
        power = np.ones(int(lengths.max()), np.uint64)
        power[1:] = _GOLD
        power = np.multiply.accumulate(power)
        out[full] += np.add.reduceat(_BYTE[raw] * power[place], starts[full])
    return mix(out)


def words_of(texts: pa.Array | pa.ChunkedArray, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and each text's offsets into them. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(lists) else lists.values
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    full = pc.not_equal(values, "")
    if not pc.all(full).as_py() and len(values):
        keep = full.to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        values = values.filter(full)
    return values, offsets


def coded_words(texts: pa.Array | pa.ChunkedArray, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words as codes, the words by code, and each text's offsets into the codes."""
    values, offsets = words_of(texts, lower)
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, offsets


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words; run i starts at word i."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, m in enumerate(odd(size, size)):
        out += hashes[k:k + n] * m
    return mix(out)


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text shorter than `size` is one shingle, an empty text has none."""
    runs = shingle_hashes(hashes, size)
    sets = []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if end - start >= size:
            sets.append(np.unique(runs[start:end - size + 1]))
        elif end > start:
            sets.append(shingle_hashes(hashes[start:end], end - start))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def batch(schema: T.StructType, **columns: object) -> pa.RecordBatch:
    """A record batch of the schema's columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    arrays = []
    for f in arrow:
        v = columns[f.name]
        arrays.append(v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=arrow)


def merged(batches, limit_bytes: int):
    """Joins small batches and cuts large ones: tables of about `limit_bytes` each; a single row is never cut."""
    held, size = [], 0
    for b in batches:
        step = max(1, int(b.num_rows * limit_bytes / max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            held.append(part)
            size += part.nbytes
            if size >= limit_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
