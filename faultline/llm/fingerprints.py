"""Document fingerprints: content-defined chunks at normalised gear-hash boundaries, their digests weighted by length."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm.common import mix64, small_batches, steps, table

#: a random number for each byte value; a hash of the last 16 bytes fits into as many bits
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)
#: bytes of a chunk: at least, the size up to which a boundary must match all of STRICT bits, at most
LEAST, NORMAL, MOST = 16, 32, 128
#: bits that must be set at a boundary before and after the normal size
STRICT, LOOSE = 5, 3
#: one chunk of a fingerprint: its digest and how many bytes of the text it covers in all
ENTRY = np.dtype([("digest", "<u8"), ("weight", "<u4")])
#: rows that make up a slot of the order by id, and the most slots there are
SLOT_ROWS, MOST_SLOTS = 2_000, 20_000


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of the last 16 bytes' numbers, each shifted by its distance. It knows no chunk starts.

    Windows of 1, 2, 4 and 8 bytes are put together to twice their size.
    """
    h = GEAR[data]
    for size in (1, 2, 4, 8):
        if len(h) > size:
            h[size:] += h[:-size] << np.uint16(size)
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks. Chunks end where the hash has STRICT high bits set up to the normal size, LOOSE ones beyond it, else at MOST."""
    h = gear_hashes(data)
    loose = (np.flatnonzero((h >> np.uint16(16 - LOOSE)) == (1 << LOOSE) - 1) + 1).tolist()
    strict = (np.flatnonzero((h >> np.uint16(16 - STRICT)) == (1 << STRICT) - 1) + 1).tolist()
    n, start, out, s, w = len(data), 0, [], 0, 0
    strict.append(n + MOST + 1), loose.append(n + MOST + 1)
    while n - start > LEAST:
        while strict[s] < start + LEAST:
            s += 1
        if strict[s] < start + NORMAL:
            end = strict[s]
        else:
            while loose[w] < start + NORMAL:
                w += 1
            end = min(loose[w], start + MOST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def prints(raw: bytes) -> np.ndarray:
    """The fingerprint of a text in UTF-8 as ENTRY rows in order of digest: every distinct chunk, with the bytes it covers."""
    ends = cuts(np.frombuffer(raw, np.uint8))
    starts = [0, *ends[:-1]]
    digest = np.fromiter(map(xxhash.xxh3_64_intdigest, [raw[a:b] for a, b in zip(starts, ends)]), np.uint64, len(ends))
    size = np.array(ends, np.int64) - np.array(starts[: len(ends)], np.int64)
    values, at = np.unique(digest, return_inverse=True)
    out = np.empty(len(values), ENTRY)
    out["digest"], out["weight"] = values, np.bincount(at, weights=size, minlength=len(values))
    return out


def pack_print(entries: np.ndarray) -> str:
    return base64.b64encode(entries.tobytes()).decode()


def unpack_print(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ENTRY)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's bytes that lie in chunks of b too, each chunk as often as both have it. Empty: 1 in an empty one, else 0."""
    if not len(a):
        return float(not len(b))
    if not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b["digest"], a["digest"]), len(b) - 1)
    both = b["digest"][at] == a["digest"]
    return float(np.minimum(a["weight"], b["weight"][at])[both].sum(dtype=np.int64) / a["weight"].sum(dtype=np.int64))


def likeness(a: str, b: str) -> float:
    """How far the first fingerprint's document is contained in the second one's, 0 to 1; equal fingerprints give 1."""
    return containment(unpack_print(a), unpack_print(b))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint), one row per row.

    The fingerprint holds every distinct chunk of the whole text with its weight, so equal texts have equal fingerprints and an edit
    changes only the chunks around it. A null text counts as empty; an empty text has the empty fingerprint.
    Other columns are not read. An empty table gives an empty table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            done = [pack_print(prints(t.encode())) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(done, pa.string())], [id_col, "n_chars", "fingerprint"])

    own = docs.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, f"`{id_col}` bigint, n_chars bigint, fingerprint string")


def _in_slots(docs: DataFrame) -> tuple[int, DataFrame]:
    """The number of slots, and (slot, guest, id, rank, packed): texts compressed, in slots of ids of about SLOT_ROWS rows; each slot also gets, as a guest,
    the row before its first one in ascending order of ids (the first slot gets the last row of all).

    Only the slots' bounds and largest ids reach the driver, at most MOST_SLOTS numbers each.
    """
    import zstandard

    ids = docs.select("id")
    n = ids.count()
    slots = int(min(max(n // SLOT_ROWS, 1), MOST_SLOTS))
    fractions = ", ".join(str(k / slots) for k in range(1, slots))
    bounds = np.unique(np.array(ids.selectExpr(f"percentile_approx(id, array({fractions}), {max(10_000, 20 * slots)}) AS b").first()["b"] or [] if slots > 1 else [], np.int64))

    def slot_of(col: pa.Array) -> np.ndarray:
        """Rows of null id come last in descending order, so they are in the first slot."""
        found = np.searchsorted(bounds, col.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return np.where(col.is_null().to_numpy(zero_copy_only=False), 0, found)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(slot_of(b.column(0)), pa.int64()), b.column(0)], ["slot", "id"])

    ends = sorted((r["slot"], r["last"]) for r in ids.mapInArrow(last, "slot bigint, id bigint").groupBy("slot").agg(F.max("id").alias("last")).collect())
    asking: dict[int | None, list[int]] = {}  # the id a slot has as its guest: the largest one of the slot before it
    for (slot, _), (_, guest) in zip(ends, [ends[-1], *ends[:-1]] if ends else []):
        asking.setdefault(guest, []).append(slot)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in steps(batches):
            own = slot_of(b.column(0)).tolist()
            rows = []
            for slot, i, text in zip(own, b.column(0).to_pylist(), b.column(1).to_pylist()):
                packed = z.compress(text.encode())
                rank = xxhash.xxh3_64_intdigest(packed) >> 1
                rows.append((slot, False, i, rank, packed))
                rows.extend((s, True, i, rank, packed) for s in asking.get(i, ()))
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["slot", "guest", "id", "rank", "packed"])

    return slots, docs.mapInArrow(place, "slot bigint, guest boolean, id bigint, rank bigint, packed binary")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per row.

    Half of each text, the last floor(n_chars / 2) code points, gives way to the first as many (or all) of the next document in
    descending order of ids; after the last comes the first. Rows that repeat an id are one place in the order: each of them has
    the same next document, and where they are next themselves, one of their texts stands for all. Rows of null id come last
    and are one place too. A null text counts as empty; a table of one document is its own next. An empty table gives an empty table.

    Texts travel once, compressed, into slots of the order by id. A slot is read as a stream in ascending order, in which the next
    document is the one just passed: only the texts of two rows are held at a time, however long a slot is.
    """
    import zstandard

    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    slots, placed = _in_slots(own)
    placed = placed.repartition(slots, "slot").sortWithinPartitions("slot", F.desc("guest"), F.asc_nulls_first("id"), "rank")
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        slot = place = after = current = None  # `after` is what comes next for rows of `place`, `current` what stands for `place` itself
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for s, guest, i, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist()):
                new = s != slot or (guest, i) != place
                if not new and guest:
                    continue
                text = z.decompress(packed).decode()
                entries = prints(text.encode())
                if new:
                    after = None if s != slot else current
                    slot, place, current = s, (guest, i), (text, entries)
                if guest:
                    continue
                half = len(text) // 2
                edited = (text[: len(text) - half] + after[0][:half]).encode()
                other = prints(edited)
                rows.append((i, len(text), hashlib.sha256(edited).hexdigest(), pack_print(entries), pack_print(other), containment(entries, other), containment(entries, after[1])))
                held += len(edited)
                if held > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return placed.mapInArrow(run, f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(table(spark, sf_dir, "documents"))


QUERIES = {"op12_fingerprints": op12}
ORACLES: dict[str, str] = {}
