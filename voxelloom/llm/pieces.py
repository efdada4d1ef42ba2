"""Sampled SentencePiece segmentation by forward filtering and backward sampling, and its inverse.

A vocabulary file gives the pieces; their log-probabilities follow Zipf's law in the rank that the file
gives them (its scores are merge ranks, not probabilities), divided by ``temperature``. The lattice of
a text has an edge per piece that matches; characters without a piece, and a literal U+2581, become
their UTF-8 byte pieces, so decoding gives the text back to the byte.

The forward pass sums over all segmentations of each prefix; the backward pass draws the last piece,
then the piece before it, and so on, each with its exact posterior probability. No piece crosses from a
character to a following blank, nor contains a line break (the vocabulary is asked, not assumed), so
the lattice of a text is a chain of word lattices: forward weights are computed once per distinct word
and the backward draws of all words of a batch run as vector operations. The random number of a draw
depends on seed, row key, word position and step alone, never on partitions or batches.

Edge cases: null text gives null ids; empty text gives no ids; a null key draws like key 0 and rows
that repeat a key and text get equal ids; very long texts are encoded in runs of words, words of any
length whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm.memory import tidy
from voxelloom.session import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a literal U+2581 inside this module: half a surrogate pair, which no valid text holds.
LITERAL = "\ud800"
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
#: Words whose forward weights a task keeps.
CACHE = 40_000
#: Words that one vector pass draws for.
CHUNK = 20_000
#: New words that are filtered at once: their edges take most of the memory.
SOME = 8_000


class Pieces:
    """Vocabulary, piece probabilities and the decoder's byte strings."""

    def __init__(self, path: str, temperature: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.byte = [0] * 256
        self.out: list[bytes] = [b""] * n
        rank = {}
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.out[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[p] = i
                rank[i] = -sp.get_score(i)
                self.out[i] = p.replace(SPACE, " ").encode()
        # Zipf: p is about 1 / (rank + 3). A byte piece ranks after all others.
        logp = {i: -math.log(r + 3.0) / temperature for i, r in rank.items()}
        self.fallback = -math.log(n + 3.0) / temperature
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.ids):
            raise ValueError("a piece crosses a word or line end: the lattice does not split there")
        # For each length, hashes of the pieces' prefixes (sorted), the id of the piece that a prefix
        # is, or -1, and its log-probability; and which of many slots of hashes they fill.
        self.levels = []
        for length in range(1, max(map(len, self.ids), default=1) + 1):
            prefixes = {p[:length] for p in self.ids if len(p) >= length}
            table = sorted((poly_hash(x), self.ids.get(x, -1)) for x in prefixes)
            if len({h for h, _ in table}) < len(table):
                raise ValueError("prefix hashes collide")
            i = np.array([i for _, i in table], np.int32)
            hashes, bits = np.array([h for h, _ in table], np.uint64), len(table).bit_length() + 4
            filled = np.zeros(1 << bits, bool)
            filled[(hashes * SLOT) >> np.uint64(64 - bits)] = True
            self.levels.append((hashes, i, np.array([logp.get(x, 0.0) for x in i.tolist()]), filled, np.uint64(64 - bits)))

        # Where each character stands in the first level; characters beyond the table share its last entry.
        first = self.levels[0][0]
        chars = np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)
        self.single = np.minimum(np.searchsorted(first, chars), len(first) - 1)
        if max((ord(c) for x in self.ids for c in x), default=0) >= len(self.single):
            self.single = np.minimum(np.searchsorted(first, np.arange(0x110001, dtype=np.uint64) + np.uint64(1)), len(first) - 1)

    def decode(self, ids) -> str:
        out = self.out
        raw = b"".join([out[i] for i in ids])
        return raw[1:].decode() if raw else ""


def _words(text: str) -> list[str]:
    """Chunks between which no piece lies: blanks with the word after them, and line breaks alone."""
    return _CHUNK.findall(SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE))


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GAMMA = 0x9E3779B97F4A7C15
ONE = 1 << 40
POLY = np.uint64(0x100000001B3F)
SLOT = np.uint64(0x9E3779B97F4A7C15)


def poly_hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(POLY) + ord(c) + 1) % 2**64
    return h


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


class Sampler:
    """Draws segmentations; keeps the lattices of words seen, as flat arrays.

    A node is a character: the end behind it. Edges lie in order of node and start. ``at`` of an edge is
    its node's number times 2**40 plus its cumulative posterior times 2**40: sorted throughout, and in
    integers, so a draw does not depend on what else is in the arrays.
    """

    def __init__(self, pieces: Pieces, seed: int):
        self.p, self.seed = pieces, seed
        self.clear()

    def clear(self) -> None:
        self.word: dict[str, int] = {}
        self.many: list[tuple[int, ...]] = []  # the ids of edges that give several
        self.nodes = 0
        # First node and length of each word; at, start and id (or -1 - index into many) of each edge.
        self.flat = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32)]

    def add(self, words: list[str]) -> None:
        """Forward filtering of new words, all at once."""
        p = self.p
        cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        head = np.repeat(np.cumsum(size) - size, size)  # first node of each node's word
        room = np.repeat(np.cumsum(size), size) - np.arange(len(cp))  # characters from here to the word's end
        live, h = np.arange(len(cp)), np.zeros(len(cp), np.uint64)
        begin, end, token, weight = [], [], [], []
        for length, (hashes, ids, logs, filled, shift) in enumerate(p.levels, 1):
            if length > 1:
                go = room[live] >= length
                live, h = live[go], h[go]
            h = h * POLY + cp[live + (length - 1)] + np.uint64(1)
            if length > 1:  # most prefixes that are none are told without a search
                go = np.flatnonzero(filled[(h * SLOT) >> shift])
                live, h = live[go], h[go]
            spot = p.single[np.minimum(cp, len(p.single) - 1)] if length == 1 else np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            go = hashes[spot] == h
            hit = go & (ids[spot] >= 0)
            if length == 1:
                none = live[~hit]
                if len(none):
                    begin.append(none)
                    end.append(none)
                    raw = [tuple(p.byte[b] for b in (SPACE if c == 0xD800 else chr(c)).encode()) for c in cp[none].tolist()]
                    token.append(np.array([r[0] for r in raw], np.int32))
                    lens = np.array([len(r) for r in raw])
                    for i in np.flatnonzero(lens > 1).tolist():
                        token[-1][i] = -1 - len(self.many)
                        self.many.append(raw[i])
                    weight.append(p.fallback * lens)
            begin.append(live[hit])
            end.append(live[hit] + (length - 1))
            token.append(ids[spot[hit]])
            weight.append(logs[spot[hit]])
            live, h = live[go], h[go]
            if not len(live):
                break
        begin, end, token, weight = (np.concatenate(x) for x in (begin, end, token, weight))
        order = np.argsort(end * (len(p.levels) + 1) + (len(p.levels) - (end - begin)))  # by end, then start
        begin, end, token, weight = begin[order], end[order], token[order], weight[order]
        alpha, prob = np.zeros(len(cp)), np.zeros(len(begin))
        offset = end - head[end]
        by = np.argsort(offset.astype(np.int16) if offset.max(initial=0) < 1 << 15 else offset, kind="stable")
        cuts = np.searchsorted(offset[by], np.arange(int(offset.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            e = by[a:b]
            to, start = end[e], begin[e]
            first = _firsts(to)
            w = weight[e] + np.where(start > head[to], alpha[start - 1], 0.0)
            n = np.diff(first, append=len(e))
            top = np.maximum.reduceat(w, first)
            x = np.exp(w - np.repeat(top, n))
            total = np.add.reduceat(x, first)
            alpha[to[first]] = top + np.log(total)
            prob[e] = x / np.repeat(total, n)
        # Cumulative posteriors per node, added up edge by edge so that a word's values are its own.
        first = _firsts(end)
        n = np.diff(first, append=len(end))
        cum = prob.copy()
        for k in range(1, int(n.max(initial=1))):
            e = first[n > k] + k
            cum[e] += cum[e - 1]
        fine = np.minimum(np.floor(cum * ONE).astype(np.int64), ONE)
        fine[first + n - 1] = ONE
        fresh = (np.cumsum(size) - size + self.nodes, size, ((end + self.nodes) << 40) + fine, (begin - head[begin]).astype(np.int32), token)
        self.flat = [np.concatenate([a, b]) for a, b in zip(self.flat, fresh)]
        for w in words:
            self.word[w] = len(self.word)
        self.nodes += len(cp)

    def draw(self, words: list[int], salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, in order, and the number of each word's tokens."""
        node0, size, cum, start, token = self.flat
        w = np.array(words, np.int64)
        at, base = size[w], node0[w]
        live = np.arange(len(w))
        who, what, step = [], [], 0
        while len(live):
            u = (_mix(salt[live] + np.uint64((step + 1) * GAMMA % 2**64)) >> np.uint64(24)).astype(np.int64)
            edge = np.searchsorted(cum, ((base[live] + at[live] - 1) << 40) + u, side="right")
            who.append(live)
            what.append(token[edge])
            at[live] = start[edge]
            live = live[at[live] > 0]
            step += 1
        if not who:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        steps = np.repeat(np.arange(len(who)), [len(x) for x in who])
        who, what = np.concatenate(who), np.concatenate(what)
        order = np.lexsort((-steps, who))
        who, what = who[order], what[order]
        if (what < 0).any():
            lens = np.ones(len(what), np.int64)
            many = np.flatnonzero(what < 0)
            lens[many] = [len(self.many[-1 - t]) for t in what[many]]
            spot = np.cumsum(lens) - lens
            full = np.repeat(what, lens)
            for i in many:
                full[spot[i] : spot[i] + lens[i]] = self.many[-1 - what[i]]
            who, what = np.repeat(who, lens), full
        return what, np.bincount(who, minlength=len(w))

    def encode(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Token ids of each text. Runs of words of several texts share a vector pass."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        words: list[str] = []
        spans: list[tuple[int, int]] = []
        salts: list[np.ndarray] = []

        def go():
            if not words:
                return
            known = self.word
            new = [x for x in dict.fromkeys(words) if x not in known]
            if len(known) + len(new) > CACHE and known:
                self.clear()
                known, new = self.word, list(dict.fromkeys(words))
            for a in range(0, len(new), SOME):
                self.add(new[a : a + SOME])
            tokens, lens = self.draw([known[x] for x in words], np.concatenate(salts))
            ends = np.r_[0, np.cumsum(lens)]
            at = 0
            for t, n in spans:
                out[t].append(tokens[ends[at] : ends[at + n]].astype(np.int32))
                at += n
            words.clear()
            spans.clear()
            salts.clear()

        for t, (text, key) in enumerate(zip(texts, keys)):
            if not text:
                continue
            chunks = _words(text)
            row = _mix(np.array([(key * GAMMA + self.seed) % 2**64], np.uint64))
            for a in range(0, len(chunks), CHUNK):
                some = chunks[a : a + CHUNK]
                words.extend(some)
                spans.append((t, len(some)))
                salts.append(_mix(row + np.arange(a, a + len(some), dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)))
                if len(words) >= CHUNK:
                    go()
        go()
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]


_SAMPLERS: dict[tuple, Sampler] = {}


def _sampler(path: str, temperature: float, seed: int) -> Sampler:
    """One sampler per worker process and setting, so that the vocabulary is read once."""
    name = (path, temperature, seed)
    if name not in _SAMPLERS:
        _SAMPLERS[name] = Sampler(Pieces(path, temperature), seed)
    return _SAMPLERS[name]


def _runs(batch: pa.RecordBatch, most: int = 1 << 22):
    """Slices of a batch of about ``most`` bytes of text."""
    size, a = 0, 0
    for i, t in enumerate(batch.column(1)):
        size += len(t.as_buffer()) if t.is_valid else 0
        if size >= most:
            yield batch.slice(a, i + 1 - a)
            a, size = i + 1, 0
    if a < batch.num_rows or not batch.num_rows:
        yield batch.slice(a)


def _encoder(path: str, temperature: float, seed: int, check: bool):
    def run(batches):
        s = _sampler(path, temperature, seed)
        for whole in batches:
            for batch in _runs(whole):
                keys, texts = batch.column(0), batch.column(1).to_pylist()
                found = s.encode([t or "" for t in texts], [k or 0 for k in keys.to_pylist()])
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                flat = np.concatenate(found) if found else np.zeros(0, np.int32)
                none = pa.array([t is None for t in texts], pa.bool_())
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()), mask=none)
                cols = [keys, ids, pa.array([None if t is None else len(f) for t, f in zip(texts, found)], pa.int64())]
                names = ["doc_id", "ids", "n_tokens"]
                if check:
                    cols.append(pa.array([None if t is None else s.p.decode(f.tolist()) == t for t, f in zip(texts, found)], pa.bool_()))
                    names.append("lossless")
                yield pa.RecordBatch.from_arrays(cols, names)
        s.clear()  # a worker that goes on with other stages keeps the vocabulary alone

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, temperature: float = 1.0, seed: int = 29, check: bool = False) -> DataFrame:
    """doc_id, ids, n_tokens and, with ``check``, lossless: whether decoding gave the text back. No shuffle."""
    ship(docs.sparkSession)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(tidy(_encoder(model, temperature, seed, check)), "doc_id long, ids array<int>, n_tokens long" + ", lossless boolean" * check)


def _decoder(path: str):
    def run(batches):
        p = _sampler(path, 1.0, 0).p
        for batch in batches:
            texts = [None if ids is None else p.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    ship(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(model), "doc_id long, text string")
