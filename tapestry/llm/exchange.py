"""Ask about 64-bit keys across the whole corpus without a row for each key.

Texts are dealt to blocks.  A block sends its sorted distinct keys in packets,
one for each range of the key space (a bucket), packed as binary: a shuffle of
a few thousand rows instead of one row for each word or n-gram.  A bucket sees
each key once for every block that holds it, whatever the key's frequency, so
no key is hot.  It answers each packet with one value a key, in the packet's
order, and the answers go back to the block by a second shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PACKETS = "kind int, bucket int, block int, keys binary, vals binary"
ANSWERS = "kind int, bucket int, block int, vals binary"


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as the first one and differences of as few bytes as the
    largest of them needs (its width comes first)."""
    gaps = np.diff(keys)
    width = max(1, -(-int(gaps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    width = raw[0]
    gaps = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(gaps) + 1, 8), np.uint8)
    out[1:, :width] = gaps
    out[0] = np.frombuffer(raw, np.uint8, 8, 1)
    return np.cumsum(out.view("<u8").reshape(-1), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as one byte each; those of 255 and more follow in full."""
    return np.minimum(counts, 255).astype("u1").tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, "u1", n).astype(np.uint64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n)
    return out


def packet_rows(block: int, kind: int, buckets: int, keys: np.ndarray, *columns: np.ndarray, counts: bool = False) -> list[tuple]:
    """Packets of sorted ``keys``; the columns' slices follow one another in
    ``vals`` (or the one column is of ``counts``, mostly small)."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))
    return [
        (kind, b, block, pack_keys(keys[i:j]), pack_counts(columns[0][i:j]) if counts else b"".join(c[i:j].tobytes() for c in columns))
        for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
        if j > i
    ]


def packet_table(rows: list[tuple]) -> pa.Table:
    kind, bucket, block, keys, vals = zip(*rows, strict=True) if rows else ((), (), (), (), ())
    return pa.table(
        [pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(block, pa.int32()), pa.array(keys, pa.binary()), pa.array(vals, pa.binary())],
        names=["kind", "bucket", "block", "keys", "vals"],
    )


def key_arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a bucket's packets, and where each packet ends."""
    keys = [unpack_keys(r) for r in table.column("keys").to_pylist()]
    return np.concatenate(keys), np.cumsum([len(k) for k in keys])


def counts_in(table: pa.Table, ends: np.ndarray) -> np.ndarray:
    """The counts of a bucket's packets, in packet order."""
    sizes = np.diff(ends, prepend=0).tolist()
    return np.concatenate([unpack_counts(v, n) for v, n in zip(table.column("vals").to_pylist(), sizes, strict=True)])


def answer_table(table: pa.Table, ends: np.ndarray, values: np.ndarray, counts: bool = False) -> pa.Table:
    """Each packet's share of ``values`` (one for each key, in packet order);
    shares of ``counts`` start with their length."""
    starts = np.concatenate([[0], ends[:-1]]).astype(int)
    cut = lambda i, j: int(j - i).to_bytes(8, "little") + pack_counts(values[i:j]) if counts else values[i:j].tobytes()
    vals = [cut(i, j) for i, j in zip(starts, ends, strict=True)]
    return table.select(["kind", "bucket", "block"]).append_column("vals", pa.array(vals, pa.binary()))


def answers_in(table: pa.Table, kind: int, dtype: str | None = None) -> np.ndarray:
    """A block's answers of one kind, in the order of its sorted keys (counts
    if no type is given)."""
    rows = [(b, v) for k, b, v in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "vals")), strict=True) if k == kind]
    parts = [v for _, v in sorted(rows, key=lambda r: r[0])]
    if dtype:
        return np.frombuffer(b"".join(parts), dtype)
    return np.concatenate([np.empty(0, np.uint64), *(unpack_counts(v[8:], int.from_bytes(v[:8], "little")) for v in parts)])
