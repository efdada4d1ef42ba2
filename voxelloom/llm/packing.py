"""Packing documents into as few sequences of fixed length as possible, each partition's count certified by a lower bound.

1. One pass makes each document's token ids, with an end id behind them, cuts longer ones into pieces of full length (the first may be
   shorter) and keeps a slim row per piece: place, length, CRC-32. Texts and ids go no further. Full pieces are sequences of their own.
2. The other pieces are dealt out by hash to partitions of about ``GROUP`` rows, and each is packed by best-fit decreasing. Dual feasible
   functions give a lower bound of its bins: no packing of these pieces has fewer. A partition that meets its bound is certified.
3. Partitions with a gap hand on the pieces of every bin that is not full; certified ones hand on their loosest bin alone, as rounding up
   leaves up to one bin of air in each. These pieces are dealt out anew, to as many partitions as they need, and packed again, as long
   as that makes fewer bins; otherwise the last packing stays. The rounds end when one partition holds what is left.

A function u on [0, 1] is dual feasible if numbers that sum to at most 1 have values that sum to at most 1; the sum of values over all
pieces then bounds the bins from below. Used are the family of thresholds (sizes above 1 - t count 1, those below t nothing) with the
identity and with the rounding functions floor((k + 1) x) / k between.

The ids are those that the ``tokenizers`` library gives for its file. The same merges run here in tiktoken's encoder, built from the
same file, which is four times as fast; what that encoder cannot do goes to the library itself (strings of added tokens, runs of over
``SEGMENT`` characters without a blank to part them). Tests hold the two together.

Edge cases: null text is empty, and is its end id alone; a null key stays null; rows that repeat a key are pieces of their own; ties are
placed in row order; very long texts are encoded by segments and cut into any number of pieces; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.memory import tidy
from voxelloom.llm.pieces import _runs
from voxelloom.session import discard, ship, written

#: Pieces that one partition packs.
GROUP = 20_000
#: Exchanges at most; each packs what the one before left open.
ROUNDS = 12
#: Rounding functions floor((k + 1) x) / k of the bound.
STEPS = 40
#: Characters encoded at once. A blank before one of these characters always starts a token of its own.
SEGMENT = 1 << 18
_CUT = re.compile(r" (?=[!-~\w])")


class Tokens:
    """Byte-level BPE of a ``tokenizers`` file as little-endian 32-bit ids."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        split, bpe = model["pre_tokenizer"], model["model"]
        self.whole = Tokenizer.from_file(path)
        self.added = [t["content"] for t in model["added_tokens"]]
        same = split["type"] == "ByteLevel" and not split["add_prefix_space"] and split["use_regex"] and bpe["type"] == "BPE" and not model["normalizer"]
        self.fast = None
        if same:
            # Printable Latin-1 bytes stand for themselves in such a file, the others for characters from 256 on.
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in plain]
            byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
            ranks = {bytes(byte[c] for c in k): v for k, v in bpe["vocab"].items() if k not in self.added}
            self.fast = tiktoken.Encoding(path, pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})

    def _segments(self, text: str):
        a = 0
        while len(text) - a > SEGMENT and (m := _CUT.search(text, a + SEGMENT // 2)):
            yield text[a : m.start()]
            a = m.start()
        yield text[a:]

    def encode(self, text: str) -> np.ndarray:
        out = []
        for part in self._segments(text):
            if self.fast is None or len(part) > SEGMENT or any(t in part for t in self.added):
                out.append(np.array(self.whole.encode_batch_fast([part], add_special_tokens=False)[0].ids, "<u4"))
            else:
                out.append(np.array(self.fast.encode_ordinary(part), "<u4"))
        return out[0] if len(out) == 1 else np.concatenate(out)


_TOKENS: dict[str, Tokens] = {}
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, path: str, capacity: int, key: str, text: str, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32. No shuffle."""

    def run(batches):
        if path not in _TOKENS:  # read once per worker process
            _TOKENS[path] = Tokens(path)
        tokens = _TOKENS[path]
        for whole in batches:
            for batch in _runs(whole):
                out = []
                for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = np.append(tokens.encode(t.as_py() or ""), np.array([end_id], "<u4"))
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    out += [(doc, i, a, b - a, zlib.crc32(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                cols = list(zip(*out)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), PIECE)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that no packing can go below. ``counts``: pieces of each length, 0 to ``capacity``."""
    x = np.arange(capacity + 1)
    counts = np.asarray(counts, np.int64)
    above = np.cumsum(counts[::-1])[::-1]  # pieces of length x and more
    t = np.arange(1, capacity // 2 + 1)
    large = np.append(above, 0)[capacity - t + 1]  # longer than capacity - t
    best = -(-int((counts * x).sum()) // capacity)
    for k in range(STEPS + 1):  # 0 stands for the identity
        # Values are v / unit of a bin. Where (k + 1) x is whole, the function leaves x alone.
        unit = k * capacity if k else capacity
        v = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity) if k else x
        upto = np.append(0, np.cumsum(v * counts))
        middle = upto[capacity - t + 1] - upto[t]
        best = max(best, -(-int((large * unit + middle).max(initial=0)) // unit))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece, and each bin's content. Longest first, into the fullest bin with room."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled: list[int] = []
    rooms = 0  # bit r: some bin has room r
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += n
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, filled


PACKED = f"{PIECE}, at long, sequence_id long, offset long, open boolean, certified boolean"


def pack_group(table: pa.Table, capacity: int) -> pa.Table:
    """One partition's pieces with sequence (named by its first piece), offset, and whether their bin stays open for the next exchange."""
    table = table.drop_columns(["deal"]).sort_by("at")
    at, lengths = table.column("at").to_numpy(), table.column("length").to_numpy()
    bins, offsets, filled = best_fit_decreasing(lengths, capacity)
    filled = np.array(filled, np.int64)
    certified = len(filled) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    open_ = filled < capacity
    if certified and len(filled):
        open_ &= np.arange(len(filled)) == filled.argmin()
    name = np.zeros(len(filled), np.int64)
    name[bins[offsets == 0]] = at[offsets == 0]
    more = {"sequence_id": name[bins], "offset": offsets, "open": open_[bins], "certified": np.full(len(at), certified)}
    for k, v in more.items():
        table = table.append_column(k, pa.array(v))
    return table


def _packed(pool: DataFrame, rows: int, turn: int, capacity: int) -> DataFrame:
    deal = F.pmod(F.xxhash64("at", F.lit(turn)), F.lit(max(1, -(-rows // GROUP))))
    return written(pool.withColumn("deal", deal).groupBy("deal").applyInArrow(lambda t: pack_group(t, capacity), PACKED), "pack-round")


def pack(docs: DataFrame, path: str, capacity: int = 2048, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, bins, bound: one row per piece.

    ``bins`` is the number of sequences, ``bound`` the number that no packing of the same pieces can go below.
    """
    ship(docs.sparkSession)
    pieces = written(cut_pieces(docs, path, capacity, key, text, end_id).withColumn("at", F.monotonically_increasing_id()), "pack-pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for n, m in pieces.groupBy("length").agg(F.count("*")).collect():  # at most ``capacity`` rows
        counts[n] = m
    full = F.col("length") == capacity
    done = [pieces.where(full).withColumns({"sequence_id": F.col("at"), "offset": F.lit(0).cast("long")})]
    bins, pool, rows, before, last = int(counts[capacity]), pieces.where(~full), int(counts[:capacity].sum()), None, None
    for turn in range(ROUNDS):
        now = _packed(pool, rows, turn, capacity)
        made, open_bins, open_rows = now.agg(F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & F.col("open")), F.count_if("open")).first()
        if last is not None:
            if made >= before:  # the exchange freed no sequence
                discard(now)
                break
            done[-1] = last.where(~F.col("open"))
            bins -= before
        done.append(now)
        bins += made
        if not open_rows or rows <= GROUP:
            break
        pool, rows, before, last = now.where("open").select(*pieces.columns), open_rows, open_bins, now
    out = [d.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset") for d in done]
    whole = out[0]
    for d in out[1:]:
        whole = whole.unionByName(d)
    return whole.withColumns({"bins": F.lit(bins).cast("long"), "bound": F.lit(lower_bound(counts, capacity)).cast("long")})
