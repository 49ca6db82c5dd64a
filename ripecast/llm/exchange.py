"""Questions that documents ask about keys of the whole corpus, answered with few bytes per key.

"How often does this word occur?", "does any other document have this shingle?": a plain join would
ship one row per word and document, there and back. Here a task packs the keys of a block of
documents into one binary row per bucket; buckets are dealt by Spark; whoever holds a bucket sees every
block's keys for it, and sends each block one row of answers in the order of its keys; a last
grouping by block puts the answers beside the block's own notes. Rows hold numpy arrays, a few bytes per key
instead of a row. A frequent key costs no more than a rare one: one entry per block.

A bucket's keys are about 1/buckets of the corpus' distinct keys per block; `buckets` follows
spark.sql.shuffle.partitions, which is set to the size of the shuffle.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROW = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("payload", T.BinaryType()),
])
ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("payload", pa.binary())])

#: Text of one block, before any array of it: what a task holds at once.
BLOCK_BYTES = 4 << 20


def release() -> None:
    """Gives freed memory back to the system: workers share an executor's memory, and idle ones would keep theirs."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _trim_function():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not glibc
        return None


_TRIM = _trim_function()


def bucket_count(df: DataFrame) -> int:
    return max(32, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays to bytes, compressed; `unpack` gives them back in order."""
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        kind, raw = (b"raw", a) if isinstance(a, bytes) else (a.dtype.str.encode(), np.ascontiguousarray(a).tobytes())
        parts += [struct.pack("<BQ", len(kind), len(raw)), kind, raw]
    return zstandard.compress(b"".join(parts), 1)


def unpack(payload: bytes) -> list[np.ndarray | bytes]:
    raw = zstandard.decompress(payload)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        k, size = struct.unpack_from("<BQ", raw, at)
        at += 9
        kind = raw[at:at + k].decode()
        at += k
        out.append(raw[at:at + size] if kind == "raw" else np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def pack_strings(values: pa.Array) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, pa.schema([("v", pa.large_string())])) as w:
        w.write_batch(pa.record_batch([values.cast(pa.large_string())], ["v"]))
    return out.getvalue().to_pybytes()


def unpack_strings(raw: bytes) -> pa.Array:
    return pa.ipc.open_stream(raw).read_all()["v"].combine_chunks()


def by_bucket(buckets: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by bucket, and each bucket's range in it."""
    order = np.argsort(buckets, kind="stable")
    return order, np.searchsorted(buckets[order], np.arange(count + 1))


Row = tuple[int, int, bytes]


def rows_out(rows: Iterable[Row], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held: list[Row] = []
    n = 0
    for r in rows:
        held.append(r)
        n += len(r[2])
        if n >= size:
            yield _batch(held)
            held, n = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[Row]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ARROW, strict=True)], schema=ARROW)


OWN = -1  # in what `ask` yields: the block's notes


def exchange(
    docs: DataFrame,
    ask: Callable[[pa.Table], Iterator[tuple[int, bytes]]],
    answer: Callable[[list[bytes]], Iterable[bytes]],
    settle: Callable[[bytes, dict[int, bytes]], Iterator[pa.RecordBatch]],
    schema: T.StructType,
    block_bytes: int = BLOCK_BYTES,
    beside: DataFrame | None = None,
) -> DataFrame:
    """
    ask(table of documents)        -> (bucket, keys) rows and one (OWN, notes) row
    answer(keys of a bucket, one per block) -> answers, in the same order
    settle(notes, answers by bucket) -> record batches of `schema`

    With `beside`, a table of (bucket, payload) with a row per bucket, `answer` gets that payload as a second argument.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from ripecast.llm.text import merged

    arrow = to_arrow_schema(schema)
    has_beside = beside is not None

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[Row]:
            part = TaskContext.get().partitionId()
            for k, t in enumerate(merged(batches, block_bytes)):
                block = (part << 32) + k
                for bucket, payload in ask(t):
                    # A block's own notes get a bucket of their own, so that they are dealt like the others.
                    yield block, bucket if bucket >= 0 else -1 - block, payload
                release()
        return rows_out(rows())

    def answering(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return table
        asking_blocks = pc.greater_equal(table["block"], 0)
        asked_rows = table.filter(asking_blocks)
        payloads = asked_rows["payload"].to_pylist()
        if not payloads:
            return asked_rows
        if not has_beside:
            given = list(answer(payloads))
        else:
            known = table.filter(pc.invert(asking_blocks))["payload"].to_pylist()
            given = list(answer(payloads, known[0] if known else None))
        release()
        return pa.Table.from_arrays([asked_rows["block"], asked_rows["bucket"], pa.array(given, pa.binary())], schema=ARROW)

    def settling(table: pa.Table) -> pa.Table:
        notes, answers = b"", {}
        for bucket, payload in zip(table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True):
            if bucket < 0:
                notes = payload
            else:
                answers[bucket] = payload
        out = pa.Table.from_batches(list(settle(notes, answers)), schema=arrow)
        release()
        return out

    asked = docs.mapInArrow(asking, ROW)
    if beside is not None:
        asked = asked.unionAll(beside.selectExpr("-1L AS block", "bucket", "payload"))
    answered = asked.groupBy("bucket").applyInArrow(answering, ROW)
    return answered.groupBy("block").applyInArrow(settling, schema)
