"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces come from a public SentencePiece model file (its path is a parameter). That file's scores are
merge ranks, so the log score of the piece of rank r is log(1 / ((r + 1) * H)), Zipf's law over the
ranks; a file with real log probabilities can be used as it is (`zipf=False`).

If no piece has a space after another character and none a newline beside one, the best segmentation falls apart at every space
after a word and at every newline; otherwise a text is one chunk. Distinct chunks are encoded once for each
task, all of them in lockstep: trie walks from every position at once, then dynamic programming
by position with one vector operation for each. A chunk of any length is handled, never cut.

A character without a piece becomes its UTF-8 bytes (byte fallback). A space is the whitespace marker
U+2581 in a piece; a text gets one marker in front, which decoding takes off. A literal U+2581 in
a text goes through byte fallback, so decoding returns every text exactly.

Defined results: a null or empty text has no tokens and decodes to the empty text; repeated rows and
an empty table need nothing special; columns other than the two named ones are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_of, ship

MARKER = "▁"
_CHUNK = re.compile(rb" *[^ \n]+| +|\n")
#: What a piece must not hold if texts are to be cut into chunks.
_ACROSS = re.compile(rb"[^ ] |\n.|.\n", re.S)


class DoubleArray:
    """Trie over byte strings: from state s byte c leads to t = base[s] + c + 1 if check[t] == s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in keys.items():
            at = 0
            for c in key:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = len(children)
                    children[at][c] = nxt
                    children.append({})
                    values.append(-1)
                at = nxt
            values[at] = value
        size = 4 * len(children) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        free, queue = 1, [(0, 0)]
        for node, slot in queue:
            kids = children[node]
            if not kids:
                continue
            codes = sorted(kids)
            while taken[free]:
                free += 1
            b = free - codes[0] - 1
            tries = 0
            while b < 0 or any(taken[b + c + 1] for c in codes):
                b += 1
                tries += 1
            if tries > 64 and len(codes) < 3:
                free += 1
            base[slot] = b
            for c in codes:
                t = b + c + 1
                taken[t] = 1
                check[t], value[t] = slot, values[kids[c]]
                queue.append((kids[c], t))
            if b + 600 > size:
                raise AssertionError("double array is full")
        self.base, self.check, self.value = base, check, value

    def matches(self, data: np.ndarray, start: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, value) of every key that begins at one of the starts and ends by its limit."""
        out, state, d = [], np.zeros(len(start), np.int32), 0
        while len(start):
            inside = start + d < limit
            start, limit, state = start[inside], limit[inside], state[inside]
            if not len(start):
                break
            t = self.base[state] + data[start + d] + 1
            ok = self.check[t] == state
            start, limit, state = start[ok], limit[ok], t[ok]
            d += 1
            v = self.value[state]
            hit = v >= 0
            if hit.any():
                out.append((start[hit], np.full(int(hit.sum()), d, np.int64), v[hit]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))


class Pieces:
    """Pieces, log scores and trie of one model; encodes and decodes byte strings."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: set[int]):
        self.byte_ids = np.array(byte_ids, np.int32)
        self.text: list[bytes] = [b"" if i in special else p.replace(MARKER, " ").encode() for i, p in enumerate(pieces)]
        for b, i in enumerate(byte_ids):
            self.text[i] = bytes([b])
        plain = {t: i for i, t in enumerate(self.text) if t and i not in special and i not in set(byte_ids)}
        self.scores = np.array(scores, np.float64)
        self.unknown = min((self.scores[i] for i in plain.values()), default=0.0) - 10.0
        self.trie = DoubleArray(plain)
        self.lengths = np.array([len(t) for t in self.text], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.falls_apart = not any(_ACROSS.search(t) for t in plain)

    def chunks(self, text: str | None) -> list[bytes]:
        if not text:
            return []
        raw = b" " + text.encode("utf-8", "surrogatepass")
        return _CHUNK.findall(raw) if self.falls_apart else [raw]

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the tokens of each chunk, one chunk after the other."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        ends = np.cumsum(sizes)
        begins = ends - sizes
        data = np.frombuffer(b"".join(chunks), np.uint8)
        n = len(data)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        chunk_of = np.repeat(np.arange(len(chunks)), sizes)
        start, length, ident = self.trie.matches(data.astype(np.int32), lead, ends[chunk_of[lead]])
        char = np.diff(np.append(lead, n))
        single = np.zeros(n, np.int64)
        single[lead] = char
        has_one = np.zeros(n, bool)
        has_one[start[length == single[start]]] = True
        odd = lead[~has_one[lead]]
        start = np.concatenate([start, odd])
        length = np.concatenate([length, single[odd]])
        ident = np.concatenate([ident, np.full(len(odd), -1)]).astype(np.int64)
        score = np.where(ident >= 0, self.scores[ident], self.unknown)
        # a slot for every position of every chunk and one for its end
        rel = start - begins[chunk_of[start]]
        slot = start + chunk_of[start]
        order = np.lexsort((length, rel))
        slot, length, ident, score, rel = slot[order], length[order], ident[order], score[order], rel[order]
        best = np.full(n + len(chunks), -np.inf)
        best[begins + np.arange(len(chunks))] = 0.0
        back, piece = np.zeros(n + len(chunks), np.int64), np.zeros(n + len(chunks), np.int64)
        cuts = np.flatnonzero(np.diff(rel)) + 1
        for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(rel)]])):
            if a == b:
                continue
            s = slot[a:b]
            total, t = best[s] + score[a:b], s + length[a:b]
            up = total > best[t]
            t = t[up]
            best[t], back[t], piece[t] = total[up], length[a:b][up], ident[a:b][up]
        at, who = ends + np.arange(len(chunks)), np.arange(len(chunks))
        first = begins + np.arange(len(chunks))
        steps = []
        while len(at):
            open_ = at > first[who]
            at, who = at[open_], who[open_]
            if not len(at):
                break
            steps.append((who, at, piece[at], back[at]))
            at = at - back[at]
        if not steps:
            return np.zeros(0, np.int32), np.zeros(len(chunks) + 1, np.int64)
        who, at, ident, length = (np.concatenate(x) for x in zip(*steps))
        order = np.argsort(at)
        who, at, ident, length = who[order], at[order], ident[order], length[order]
        repeat = np.where(ident < 0, length, 1)
        ids = np.repeat(ident, repeat).astype(np.int32)
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            first_byte = np.repeat(at - length - who, repeat)
            within = np.arange(len(ids)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
            ids[lost] = self.byte_ids[data[first_byte[lost] + within[lost]]]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(who, weights=repeat, minlength=len(chunks)).astype(np.int64))])

    def encode(self, text: str | None) -> list[int]:
        ids, offsets = Encoder(self).batch([text])
        return ids[offsets[0] : offsets[1]].tolist()

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        lengths = self.lengths[ids]
        data = self.flat[np.repeat(self.offsets[ids] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        return [data[a + (data[a : a + 1] == b" ") : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode("utf-8", "replace")


class Encoder:
    """Keeps the chunks it has encoded, up to a bound on memory."""

    def __init__(self, pieces: Pieces, most: int = 200_000, most_bytes: int = 16 << 20):
        self.pieces, self.most, self.most_bytes = pieces, most, most_bytes
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.begin, self.size, self.held = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.most or self.held > self.most_bytes:
            self._clear()
        found = [self.pieces.chunks(t) for t in texts]
        known, fresh = self.known, []
        count = len(known)
        at = []
        for chunks in found:
            for c in chunks:
                k = known.get(c)
                if k is None:
                    k = known[c] = count
                    count += 1
                    fresh.append(c)
                at.append(k)
        if fresh:
            ids, offsets = self.pieces.encode_chunks(fresh)
            self.begin = np.concatenate([self.begin, offsets[:-1] + len(self.ids)])
            self.size = np.concatenate([self.size, np.diff(offsets)])
            self.ids = np.concatenate([self.ids, ids])
            self.held += sum(map(len, fresh))
        at = np.array(at, np.int64)
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.begin[at] - (ends - sizes), sizes) + np.arange(total)]
        per_text = np.cumsum([len(c) for c in found])
        return ids, np.concatenate([[0], np.concatenate([[0], ends])[per_text]]).astype(np.int64)


@lru_cache(maxsize=4)
def load(model: str, zipf: bool = True) -> Pieces:
    """Pieces of a SentencePiece model file with byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    scores = [sp.get_score(i) for i in range(n)]
    if zipf:
        plain = sorted((i for i in range(n) if i not in special and i not in set(byte_ids)), key=lambda i: (-scores[i], i))
        total = float(np.log(np.sum(1.0 / np.arange(1, len(plain) + 1))))
        scores = [0.0] * n
        for r, i in enumerate(plain):
            scores[i] = -float(np.log(r + 1)) - total
    return Pieces(pieces, scores, byte_ids, special)


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", zipf: bool = True) -> DataFrame:
    """(id, n_tokens, n_byte_tokens, token_ids, exact): exact says whether decoding the tokens returns the text."""
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(load(model, zipf))
    picked = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sent.value
        encoder = Encoder(pieces)
        is_byte = np.zeros(len(pieces.text), bool)
        is_byte[pieces.byte_ids] = True
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                texts = part.column(1).to_pylist()
                ids, offsets = encoder.batch(texts)
                back = pieces.decode_batch(ids, offsets)
                exact = [(t or "").encode("utf-8", "surrogatepass") == x for t, x in zip(texts, back)]
                bytes_ = np.concatenate([[0], np.cumsum(is_byte[ids])])[offsets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(bytes_)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)), pa.array(exact)], names=["id", "n_tokens", "n_byte_tokens", "token_ids", "exact"])

    schema = type(picked.schema)([picked.schema["id"], *schema_of("n_tokens long, n_byte_tokens long, token_ids array<int>, exact boolean").fields])
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, model: str, ids_col: str = "token_ids") -> DataFrame:
    """df with a column `decoded` that holds the text of its tokens."""
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(load(model))

    @F.pandas_udf("string")
    def back(col):
        import pandas as pd

        rows = [np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in col]
        ids = np.concatenate([np.zeros(0, np.int64), *rows])
        made = sent.value.decode_batch(ids, np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64))
        return pd.Series([x.decode("utf-8", "replace") for x in made], dtype="object")

    return df.withColumn("decoded", back(F.col(f"`{ids_col}`").cast("array<int>")))
