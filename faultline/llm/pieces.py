"""SentencePiece encoding and decoding by a table of distinct chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from faultline.llm.common import steps, table

MARK = "▁"
#: distinct chunks that one task remembers; beyond it the table starts anew, which costs time and changes no result
TABLE_ROWS = 200_000


class ChunkTable:
    """Ids of each distinct marked chunk, segmented once.

    The model writes every space as a mark and puts one mark in front of the text. A chunk is a run of marks with the
    characters up to the next mark. No piece has a mark behind another character, so no merge crosses the start of a
    chunk, and the ids of a text are those of its chunks in order. Models where that does not hold are refused.
    """

    def __init__(self, model_file: str, rows: int = TABLE_ROWS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model crosses a white space mark")
        probe = "a\tb  c\n d ﬁＡ "
        if self.sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("this model rewrites text beyond marking spaces")
        self.rows = rows
        self.lone_mark = np.array([self.sp.piece_to_id(MARK)], "<u4").tobytes()
        self.ids: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """Chunks without their first mark, other marks as spaces; a chunk may be empty (a mark alone)."""
        text = text.replace(MARK, " ")
        if not text:
            return []
        parts = text.split(" ")
        if "" not in parts:
            return parts
        out, run = [], 0
        for i, p in enumerate(parts):
            if p:
                out.append(" " * run + p)
                run = 0
            elif i < len(parts) - 1:
                run += 1
            else:
                out.append(" " * run)
        return out

    def learn(self, distinct: set[str]) -> None:
        missing = list(distinct - self.ids.keys())
        if len(self.ids) + len(missing) > self.rows:
            self.ids = {}
            missing = list(distinct)
        for chunk, ids in zip(missing, self.sp.encode(missing, num_threads=1)):
            self.ids[chunk] = np.array(ids, "<u4").tobytes() if chunk else self.lone_mark

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids without begin and end, as little-endian unsigned 32-bit integers."""
        split = [self.chunks(t) for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.ids.__getitem__, parts)) for parts in split]


@lru_cache(maxsize=2)
def _table(model_file: str, rows: int) -> ChunkTable:
    return ChunkTable(model_file, rows)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", table_rows: int = TABLE_ROWS) -> DataFrame:
    """(id, ids): the model's ids of each whole text, begin and end included, as array<int>.

    Null text counts as empty: begin and end only. Rows are handled one by one: repeated rows and null ids stay as they
    are; other columns are not read. An empty table gives an empty table. ``model_file`` must exist on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(model_file, table_rows)
        bos, eos = (np.array([x], "<u4").tobytes() for x in (t.sp.bos_id(), t.sp.eos_id()))
        for b in steps(batches):
            got = t.encode([x or "" for x in b.column(1).to_pylist()])
            lengths = np.array([0, *(len(g) // 4 + 2 for g in got)])
            flat = np.frombuffer(b"".join(bos + g + eos for g in got), "<i4")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(flat))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, ids array<int>")


def decode(encoded: DataFrame, model_file: str, table_rows: int = TABLE_ROWS) -> DataFrame:
    """(id, ids, text): the library's text for each list of ids; a null list gives null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _table(model_file, table_rows).sp
        for b in batches:
            texts = [None if x is None else sp.decode(x.tolist()) for x in b.column(1).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "ids", "text"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, ids array<int>, text string")


def encode_and_check(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", table_rows: int = TABLE_ROWS) -> DataFrame:
    """(id, ids, decoded_sha256): `encode`, and the digest of what `decode` makes of the ids, in one pass and one Python worker a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(model_file, table_rows)
        bos, eos = (np.array([x], "<u4").tobytes() for x in (t.sp.bos_id(), t.sp.eos_id()))
        for b in steps(batches):
            ids = [np.frombuffer(bos + g + eos, "<i4") for g in t.encode([x or "" for x in b.column(1).to_pylist()])]
            text_sha = [hashlib.sha256(t.sp.decode(x.tolist()).encode()).hexdigest() for x in ids]
            bounds = np.cumsum([0, *map(len, ids)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(ids))), pa.array(text_sha, pa.string())], ["id", "ids", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, ids array<int>, decoded_sha256 string")


def digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", table_rows: int = TABLE_ROWS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): `encode` and `decode` in one pass, so that no id list leaves its task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(model_file, table_rows)
        bos, eos = (np.array([x], "<u4").tobytes() for x in (t.sp.bos_id(), t.sp.eos_id()))
        for b in steps(batches):
            n, ids_sha, text_sha = [], [], []
            for g in t.encode([x or "" for x in b.column(1).to_pylist()]):
                ids = bos + g + eos
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(t.sp.decode(np.frombuffer(ids, "<i4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_path()).withColumnRenamed("id", "doc_id")


QUERIES = {"op10_sentencepiece": op10}
ORACLES: dict[str, str] = {}
