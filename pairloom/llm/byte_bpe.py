"""Byte-level BPE: DuckDB contracts token-position rows by a recursive query in every partition; ordered aggregation decodes.

Texts are cut into chunks at places that no piece of the tokenizer's pattern spans. Each different chunk of a group of texts is cut
into pieces by the pattern, unless a former group had it. A piece that is a token stands as it is; of the others, each different one
is encoded once: its bytes are token-position rows, neighbours are joined with the merge table, and each round of the recursion
contracts the leftmost pair of least rank of every piece, until no pair of a piece can be merged. Chunks and texts are put together
from these results as Arrow columns.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks that a task keeps with their ids, those used last first.
KEPT = 250_000
#: Bytes of new pieces that one recursive query takes.
QUERY_BYTES = 250_000
#: A row is token t of piece w at byte position p, with the position and the token that follow it (-1: none), so that a round needs
#: no sorting. 24 bits hold a position; a text of 16 MB without any boundary is beyond them.
CONTRACT = """
WITH RECURSIVE s AS (
  SELECT 0 AS step, w, p, np, t, nt FROM start_rows
  UNION ALL
  (WITH ranked AS (
     SELECT s.*, m * 16777216 + p AS place FROM s LEFT JOIN merges ON pair = t::BIGINT * 1048576 + nt AND nt >= 0),
   best AS (
     SELECT w, min(place) AS least, arg_min(np, place) AS gone FROM ranked WHERE place IS NOT NULL GROUP BY w),
   pair AS (
     SELECT b.w, (least & 16777215)::INT AS hit, (least >> 24)::INT AS merged, gone, r.np AS np2, r.nt AS nt2
     FROM best b JOIN ranked r ON r.w = b.w AND r.p = b.gone)
   SELECT step + 1, r.w, p, CASE WHEN p = hit THEN np2 ELSE np END, CASE WHEN p = hit THEN merged ELSE t END,
          CASE WHEN p = hit THEN nt2 WHEN np = hit THEN merged ELSE nt END
   FROM ranked r JOIN pair ON r.w = pair.w WHERE p <> gone)
)
SELECT s.w, p, t FROM s JOIN (SELECT w, max(step) AS last FROM s GROUP BY w) e ON s.w = e.w AND step = last
"""
DECODE = """
SELECT w, list(t ORDER BY p) AS ids, from_hex(string_agg(hex, '' ORDER BY p)) AS bytes FROM id_rows JOIN vocabulary USING (t) GROUP BY w ORDER BY w
"""
#: Two tokens whose bytes are together a token.
MERGES = """
CREATE TABLE merges AS SELECT a.t::BIGINT * 1048576 + b.t AS pair, v.t::BIGINT AS m
FROM (SELECT t, hex, unnest(range(2, length(hex), 2)) AS i FROM vocabulary) v JOIN vocabulary a ON a.hex = left(v.hex, i) JOIN vocabulary b ON b.hex = substr(v.hex, i + 1)
"""
#: Chunks that are one piece without doubt.
_ONE_PIECE = "^( ?[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,\\n])$"
#: First bytes (UTF-8) of characters that are no white space: ASCII signs, and from U+00C0 but for the ranges U+1000 and U+2000 to U+3FFF.
_SOLID = [*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]
#: First bytes of letters and numbers: ASCII, U+00C0 to U+027F but for two signs (C3 97, C3 B7), Cyrillic.
_LETTER = [*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(0xC3, 0xCA), 0xD0, 0xD1]


def _cuts(data: np.ndarray) -> np.ndarray:
    """Whether no piece spans the place before a byte of UTF-8 text: white space after a character that is none; a stop or comma
    after a letter or number; the character after a lone line break, tab or the like between characters that are no white space."""
    solid, letter = np.zeros(256, bool), np.zeros(256, bool)
    solid[_SOLID] = letter[_LETTER] = True
    place = np.arange(len(data), dtype=np.int32 if len(data) < 2**31 else np.int64)
    lead = data[np.maximum.accumulate(np.where(data & 0xC0 == 0x80, 0, place))]  # the first byte of each byte's character
    solid, letter = solid[lead], letter[lead] & ~((lead == 0xC3) & ((data == 0x97) | (data == 0xB7)))
    line = (data >= 0x09) & (data <= 0x0D)
    cut = np.zeros(len(data), bool)
    cut[1:] = solid[:-1] & ((data == 0x20) | line)[1:] | letter[:-1] & ((data == 0x2E) | (data == 0x2C))[1:]
    cut[2:] |= solid[:-2] & line[1:-1] & solid[2:]
    return cut


def _strings(ends: np.ndarray, data: pa.Buffer | None) -> pa.Array:
    """Byte strings that lie one after the other in a buffer."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), data if data is not None else pa.py_buffer(b"")])


def _laid(strings: pa.Array) -> tuple[np.ndarray, pa.Buffer | None]:
    """Ends of byte strings, beginning with that of none, and the buffer they lie in."""
    return np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64), strings.buffers()[2]


def _joined(table: pa.Table, rows: np.ndarray, bounds: np.ndarray) -> dict[str, pa.Array]:
    """The ids and bytes of the given rows of a table, one after the other, cut where the bounds, which count these rows, say."""
    taken = table.select(["ids", "bytes"]).take(pa.array(rows)).combine_chunks()
    ids, (ends, data) = _one(taken["ids"]), _laid(_one(taken["bytes"]))
    sizes = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())]).astype(np.int32)
    return {"ids": pa.ListArray.from_arrays(pa.array(sizes[bounds]), ids.flatten()), "bytes": _strings(ends[bounds], data)}


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


class Encoder:
    """Encoder and decoder over one in-process database; made once in every task."""

    _made: dict[tuple[str, str], "Encoder"] = {}

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.ranks, self.pieces = ranks, regex.compile(pattern)
        self.tokens, self.token_ids = pa.array(list(ranks), pa.large_binary()), np.array(list(ranks.values()), np.int32)
        self.names = pa.array([b"%d," % i for i in range(max(ranks.values()) + 1)], pa.large_binary())
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute("SET memory_limit = '200MB'")
        self.db.register("token_rows", pa.table({"t": self.token_ids, "token": self.tokens}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT t, hex(token) AS hex FROM token_rows")
        self.db.execute(MERGES)
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.kept = pa.table({"chunk": pa.array([], pa.large_binary()), "ids": pa.array([], pa.list_(pa.int32())), "bytes": pa.array([], pa.large_binary())})

    @classmethod
    def of(cls, path: str, pattern: str) -> "Encoder":
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    @classmethod
    def release(cls) -> None:
        """Give up all encoders with their databases and chunks. A worker outlives its task, and what it holds counts beside the
        memory of any later stage."""
        for encoder in cls._made.values():
            encoder.db.close()
        cls._made.clear()
        pa.default_memory_pool().release_unused()

    def encode_pieces(self, pieces: pa.Array) -> pa.Table:
        """ids, and the bytes decoded from them, of pieces that are all different."""
        token = pc.index_in(pieces, value_set=self.tokens)
        whole, cut = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (token.is_valid(), token.is_null()))
        rows = [pa.table({"w": whole.astype(np.int32), "p": np.zeros(len(whole), np.int32), "t": self.token_ids[token.drop_null().to_numpy()]})]
        ends, data = _laid(pieces.take(pa.array(cut)))
        first = 0
        while first < len(cut):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + QUERY_BYTES, "right")) - 1)
            n = np.diff(ends[first : last + 1])
            w = np.repeat(cut[first:last].astype(np.int32), n)
            p = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            t = self.byte_id[np.frombuffer(data, np.uint8)[ends[first] : ends[last]]]
            end = np.append(w[1:] != w[:-1], True)
            self.db.register("start_rows", pa.table({"w": w, "p": p, "np": np.where(end, -1, p + 1).astype(np.int32), "t": t, "nt": np.where(end, -1, np.append(t[1:], -1)).astype(np.int32)}))
            rows.append(self.db.sql(CONTRACT).to_arrow_table())
            first = last
        self.db.register("id_rows", pa.concat_tables(rows))
        out = self.db.sql(DECODE).to_arrow_table()
        return pa.table({"ids": _one(out["ids"]), "bytes": _one(out["bytes"]).cast(pa.large_binary())})

    def _learn(self, chunks: pa.Array) -> pa.Table:
        """chunk, ids, bytes of chunks that are all different."""
        one = pc.match_substring_regex(chunks.view(pa.large_string()), _ONE_PIECE)
        found = [self.pieces.findall(c.decode("utf-8", "surrogatepass")) for c in chunks.filter(pc.invert(one)).to_pylist()]
        one = one.to_numpy(zero_copy_only=False)
        n = np.ones(len(chunks), np.int64)
        n[~one] = [len(x) for x in found]
        bounds = np.concatenate([[0], np.cumsum(n)])
        alone = np.zeros(bounds[-1], bool)
        alone[bounds[:-1][one]] = True
        rest = pa.array([x.encode("utf-8", "surrogatepass") for x in chain.from_iterable(found)], pa.large_binary())
        pieces = pa.concat_arrays([chunks.filter(pa.array(one)), rest]).dictionary_encode()
        number = np.empty(len(alone), np.int32)
        number[np.concatenate([np.flatnonzero(alone), np.flatnonzero(~alone)])] = pieces.indices.to_numpy()
        return pa.table({"chunk": chunks} | _joined(self.encode_pieces(pieces.dictionary), number, bounds))

    def columns(self, texts: pa.Array) -> dict[str, pa.Array]:
        """ids, and the bytes decoded from them, of every text (UTF-8 bytes without nulls). Texts fall into chunks that repeat often."""
        ends, data = _laid(texts)
        starts = np.append(ends[0] + np.flatnonzero(self._starts(ends, data)), ends[-1])
        chunks = _strings(starts, data).dictionary_encode()
        place = pc.index_in(chunks.dictionary, value_set=_one(self.kept["chunk"]))
        new = place.is_null()
        used, unused = place.drop_null(), np.ones(len(self.kept), bool)
        unused[used.to_numpy()] = False
        now = [self.kept.take(used)] + ([self._learn(chunks.dictionary.filter(new))] if place.null_count else [])
        number = np.empty(len(place), np.int32)
        new = new.to_numpy(zero_copy_only=False)
        number[np.concatenate([np.flatnonzero(~new), np.flatnonzero(new)])] = np.arange(len(place))
        now = pa.concat_tables(now).combine_chunks()
        out = _joined(now, number[chunks.indices.to_numpy()], np.searchsorted(starts, ends))
        self.kept = pa.concat_tables([now, self.kept.filter(pa.array(unused))]).slice(0, KEPT).combine_chunks()
        return out

    @staticmethod
    def _starts(ends: np.ndarray, data: pa.Buffer | None) -> np.ndarray:
        if ends[0] == ends[-1]:
            return np.zeros(0, bool)
        cut = _cuts(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]])
        cut[ends[:-1][np.diff(ends) > 0] - ends[0]] = True
        return cut

    def named(self, ids: pa.ListArray) -> tuple[np.ndarray, memoryview]:
        """Ends of lists of ids, and the buffer they lie in, written as numbers, each followed by a comma."""
        ends, data = _laid(self.names.take(ids.flatten()))
        return ends[np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())])], memoryview(data if data is not None else b"")

    def texts(self, texts: list[str | None]) -> Iterator[tuple[str, int, bytes]]:
        """(ids joined by commas, their number, decoded bytes) of every text."""
        got = self.columns(pa.array([(t or "").encode("utf-8", "surrogatepass") for t in texts], pa.large_binary()))
        ends, names = self.named(got["ids"])
        for a, b, ids, back in zip(ends[:-1], ends[1:], got["ids"], got["bytes"]):
            yield bytes(names[a : max(a, b - 1)]).decode(), len(ids), back.as_py()


#: Bytes of text that are encoded together.
GROUP_BYTES = 1_000_000
#: Rows taken out of an Arrow batch at once.
SLICE = 100


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = True, decoded: bool = True) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_tokens, ids_sha256, decoded_sha256, and where asked for ids (array of int) and decoded (text).

    Null texts count as empty: no ids, hashes of nothing. Texts are encoded whole, without special tokens. An empty table gives
    an empty one.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded

    def hashes(ends: np.ndarray, data: memoryview, less: int = 0) -> pa.Array:
        return pa.array([hashlib.sha256(data[a : max(a, b - less)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string())

    def rows(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        docs = pa.Table.from_batches(parts).combine_chunks()
        encoder = Encoder.of(path, pattern)
        got = encoder.columns(pc.fill_null(_one(docs.column(1)).cast(pa.large_binary()), b""))
        ends, data = _laid(got["bytes"])
        columns = {"doc_id": _one(docs.column(0)), "n_tokens": pc.list_value_length(got["ids"]).cast(pa.int64()), "ids_sha256": hashes(*encoder.named(got["ids"]), 1), "decoded_sha256": hashes(ends, memoryview(data))}
        if ids:
            columns["ids"] = got["ids"]
        if decoded:
            columns["decoded"] = pa.array([b.decode("utf-8", "replace") for b in got["bytes"].to_pylist()], pa.string())
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    parts.append(batch.slice(at, SLICE))
                    size += parts[-1].column(1).nbytes
                    if size >= GROUP_BYTES:
                        yield rows(parts)
                        parts, size = [], 0
            if parts:
                yield rows(parts)
        finally:
            Encoder.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
