"""Alignment of two tokenizers by a dangling-suffix transducer.

Tokens of both sides spell the same bytes. The transducer's state is which side leads and the bytes
by which it leads: its residual. The other side's next token either eats into the residual, or
overtakes and becomes the leader; any other bytes are a mismatch. Transitions are memoised by state
and next token. Where the residual is empty both sides end together and a group closes; within a
group all pairs of tokens whose bytes overlap are links.

How many documents hold a pair of ids linked is counted over the whole corpus. Texts are handled in
chunks of some megabytes: a chunk writes its texts' links as small numbers and its distinct pairs
once. Pairs are summed over chunks, and each chunk gets the counts of its own pairs back. So what is
shuffled by pair is a chunk's distinct pairs, not each text's links, and nothing grows in one task.

Texts that are null or empty, and texts whose joined token bytes on either side differ from the text
after a space, have no tokens: zeros and an empty string. A very long text closes its chunk and is
aligned whole; memory follows its length, some 100 bytes a byte. Repeated rows are documents like others; null ids stay null. Extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, forget, keep, span_hashes, stored, utf8
from .tokens import cuts_of, open_tokenizer

#: Bytes of text in a chunk, about.
CHUNK = 16 << 20
#: Entries of a worker's memos; a fuller one is emptied.
MEMO = 500_000
_SHIFT = 20
_SLOTS = 1 << 21
#: Segments that go through the tokenizers at once.
_AT_ONCE = 4096


class PieceCuts:
    """Where a BPE of pieces surely begins a token: between two characters that no piece holds side by side."""

    def __init__(self, pieces: list[str]) -> None:
        beside = {x + y for p in pieces for x, y in zip(p, p[1:])}
        known = {c: k + 1 for k, c in enumerate(sorted(set("".join(beside))))}
        self.index = np.zeros(0x110000, np.uint16)
        for c, k in known.items():
            self.index[ord(c)] = k
        self.index[0x20] = self.index[0x2581]  # to the model both are a space
        self.beside = np.zeros((len(known) + 1, len(known) + 1), bool)
        for x, y in beside:
            self.beside[known[x], known[y]] = True

    def __call__(self, data: np.ndarray) -> np.ndarray:
        """For each byte of UTF-8, whether it begins such a token; not for the first."""
        of = self.index[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
        out = np.zeros(len(data), bool)
        out[np.flatnonzero((data & 0xC0) != 0x80)[1:]] = ~self.beside[of[:-1], of[1:]]
        return out


def byte_table(path: str) -> list[bytes]:
    """The bytes of each entry of a byte-level BPE."""
    from tokenizers import Tokenizer

    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
    rest = [b for b in range(256) if b not in set(shown)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
    entries = sorted(Tokenizer.from_file(path).get_vocab().items(), key=lambda x: x[1])
    out = [b""] * (entries[-1][1] + 1)
    for entry, i in entries:
        out[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
    return out


class Transducer:
    """Cuts two token sequences over the same bytes into groups."""

    def __init__(self, a: list[bytes], b: list[bytes], most: int = MEMO) -> None:
        self.sides, self.most = (a, b), most
        self._clear()

    def _clear(self) -> None:
        self.states: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.residuals: list[tuple[int, bytes]] = [(0, b"")]
        self.turn = [0]  # whose token is next: that of the side which doesn't lead
        self.memo: dict[int, int] = {}

    def _step(self, state: int, token: int) -> int:
        """The state after a token of the side whose turn it is; -1 for a mismatch."""
        turn, residual = self.turn[state], self.residuals[state][1]
        new = self.sides[turn][token]
        if len(new) >= len(residual):
            lead, left, fits = turn, new[len(residual) :], new.startswith(residual)
        else:
            lead, left, fits = 1 - turn, residual[len(new) :], residual.startswith(new)
        if not fits:
            to = -1
        elif not left:
            to = 0
        else:
            to = self.states.setdefault((lead, left), len(self.residuals))
            if to == len(self.residuals):
                self.residuals.append((lead, left))
                self.turn.append(1 - lead)
        self.memo[state << _SHIFT | token] = to
        return to

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """Where groups end on both sides; None if the bytes differ."""
        if len(self.memo) > self.most:
            self._clear()
        memo, turn, out = self.memo, self.turn, []
        state = i = j = 0
        try:
            while True:
                if turn[state]:
                    token = b[j]
                    j += 1
                else:
                    if not state and i == len(a):
                        return out if j == len(b) else None
                    token = a[i]
                    i += 1
                key = state << _SHIFT | token
                state = memo[key] if key in memo else self._step(state, token)
                if state <= 0:
                    if state:
                        return None
                    out.append((i, j))
        except IndexError:  # one side ends before the other
            return None


def overlaps(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Places of tokens whose bytes overlap, in one group."""
    out, i, j, x, y = [], 0, 0, len(a[0]), len(b[0])
    while True:
        out.append((i, j))
        if x == y:
            return out
        if x < y:
            i += 1
            x += len(a[i])
        else:
            j += 1
            y += len(b[j])


class Aligner:
    """Aligns texts through a cache of the segments between places where both tokenizers surely begin a token.

    What a segment's tokens, groups and links are follows from its bytes, so both tokenizers and the transducer see
    each segment once. Pairs of linked ids get small numbers, which hold until the cache is emptied.
    """

    def __init__(self, byte_path: str, piece_path: str, most: int = MEMO) -> None:
        import sentencepiece

        self.a, self.most = open_tokenizer(byte_path), most
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bare = [i for i in range(len(pieces)) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.a_cuts, self.b_cuts = cuts_of(byte_path), PieceCuts([pieces[i] for i in bare])
        self.a_bytes = byte_table(byte_path)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.transducer = Transducer(self.a_bytes, self.b_bytes)
        self.mark = self.b.encode("\x01")  # a space and a byte, which no merge joins to what follows
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32)
        self.sizes = np.zeros((1 << 12, 5), np.int32)  # tokens of both sides, groups, links; 1 if the bytes differ
        self.at, self.pool = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32)
        self.texts: list[str] = []
        self.filled = 0
        self.pairs: dict[int, int] = {}
        self.known: dict[tuple, tuple[str, list[int]]] = {}

    def settle(self) -> None:
        """Empty the cache if it is full; numbers change."""
        if len(self.texts) > self.most or self.filled > 4 * self.most:
            self.clear()

    def piece_ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of parts of texts, without a space before them."""
        return [ids[len(self.mark) :] for ids in self.b.encode(["\x01" + t for t in texts], num_threads=1)]

    def _group(self, key: tuple, x: list[int], y: list[int]) -> tuple[str, list[int]]:
        pairs = [x[k] << 32 | y[m] for k, m in overlaps([self.a_bytes[k] for k in x], [self.b_bytes[k] for k in y])]
        found = f"{','.join(map(str, x))}|{','.join(map(str, y))}", [self.pairs.setdefault(p, len(self.pairs)) for p in pairs]
        if len(self.known) > self.most:
            self.known.clear()
        self.known[key] = found
        return found

    def _add(self, texts: list[str]) -> None:
        rows, links, at = [], [], []
        for t, a, b in zip(texts, self.a.encode_batch_fast(texts, add_special_tokens=False), self.piece_ids(texts)):
            a, shown = a.ids, []
            at.append(self.filled + len(links))
            ends = self.transducer.groups(a, b)
            if ends is None or b"".join([self.a_bytes[k] for k in a]) != t.encode():
                rows.append((0, 0, 0, 0, 1))
                self.texts.append("")
                continue
            i = j = 0
            for i_end, j_end in ends:
                key = (*a[i:i_end], -1, *b[j:j_end])
                text, numbers = self.known.get(key) or self._group(key, a[i:i_end], b[j:j_end])
                shown.append(text)
                links += numbers
                i, j = i_end, j_end
            rows.append((len(a), len(b), len(ends), self.filled + len(links) - at[-1], 0))
            self.texts.append(";".join(shown))
        n, done = len(self.texts) - len(rows), self.filled + len(links)
        for name, needed in (("sizes", len(self.texts)), ("at", len(self.texts)), ("pool", done)):
            old = getattr(self, name)
            if needed > len(old):
                grown = np.zeros((max(needed, 2 * len(old)), *old.shape[1:]), old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)
        self.sizes[n : len(self.texts)], self.at[n : len(self.texts)], self.pool[self.filled : done] = rows, at, links
        self.filled = done

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cache's entry of each segment of texts that begin with a space, and the segments before each text."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        begin = self.a_cuts(data) & self.b_cuts(data)
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begin)
        ends = np.r_[starts[1:], len(data)]
        keys = span_hashes(data, starts, ends)
        slot = (keys & np.uint64(_SLOTS - 1)).astype(np.int64)
        entry = self.entry[slot].astype(np.int64)
        missed = np.flatnonzero(self.keys[slot] != keys)
        if len(missed):
            new, first, inverse = np.unique(keys[missed], return_index=True, return_inverse=True)
            where, raw, base = missed[first], data.tobytes(), len(self.texts)
            for k in range(0, len(where), _AT_ONCE):
                some = where[k : k + _AT_ONCE]
                self._add([raw[s:e].decode() for s, e in zip(starts[some].tolist(), ends[some].tolist())])
            entry[missed] = base + inverse
            self.keys[slot[where]] = new
            self.entry[slot[where]] = base + np.arange(len(new), dtype=np.int32)
        return entry, np.searchsorted(starts, offsets)

    def align(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the tokens of both sides, groups and links (columns), and the groups as text; then the numbers of
        each text's distinct pairs in a row with the times that it links them, and the bounds of the texts in that row."""
        filled = pc.fill_null(texts.cast(pa.large_string()), "")
        spaced = pc.if_else(pc.equal(pc.binary_length(filled), 0), filled, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), filled, pa.scalar("", pa.large_string())))
        entry, bounds = self.segments(*utf8(spaced))
        n = len(bounds) - 1
        doc = np.repeat(np.arange(n), np.diff(bounds))
        sizes = self.sizes[entry]
        good = np.bincount(doc, weights=sizes[:, 4], minlength=n) == 0
        sizes = sizes[:, :4] * good[doc][:, None]
        upto = np.zeros((len(entry) + 1, 4), np.int64)
        np.cumsum(sizes, axis=0, out=upto[1:])
        counts = upto[bounds[1:]] - upto[bounds[:-1]]
        ids = entry.tolist()
        shown = [";".join([self.texts[k] for k in ids[s:e]]) if ok else "" for s, e, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), good.tolist())]
        each, done = sizes[:, 3], upto[:, 3]
        links = self.pool[np.repeat(self.at[entry] - done[:-1], each) + np.arange(done[-1])]
        keys, times = np.unique(np.repeat(doc, each) << 32 | links, return_counts=True)
        return counts, shown, keys & 0xFFFFFFFF, times, np.searchsorted(keys >> 32, np.arange(n + 1))


def aligned(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per row: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (as ``a1,a2|b1;a3|b2``), ``chunk``, ``numbers`` of its linked pairs and their ``times``.

    Rows with ``summary`` close a chunk: ``numbers`` that it uses, their ``pairs`` (the A id shifted by 32, or
    the B id), and as ``times`` the documents that hold them.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = ("align", byte_path, piece_path)
        aligner = keep(mark, lambda: Aligner(byte_path, piece_path))
        aligner.settle()
        number, size, id_kind = TaskContext.get().partitionId() << 32, 0, None
        held = np.zeros(1 << 12, np.int64)
        names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "chunk", "numbers", "times", "pairs", "summary"]
        lists = lambda bounds, values, kind: pa.ListArray.from_arrays(pa.array(np.asarray(bounds, np.int32)), pa.array(values, kind))

        def close() -> pa.RecordBatch:
            used = np.flatnonzero(held)
            pairs = np.fromiter(aligner.pairs, np.int64, len(aligner.pairs))[used]
            ends, zero = [0, len(used)], pa.array([0], pa.int64())
            columns = [lists(ends, used, pa.int32()), lists(ends, held[used], pa.int32()), lists(ends, pairs, pa.int64())]
            return pa.RecordBatch.from_arrays([pa.nulls(1, id_kind), *[zero] * 4, pa.array([""]), pa.array([number], pa.int64()), *columns, pa.array([True])], names)

        for batch in blocks(batches, "text", keeps=mark):
            id_kind, n = batch.column(0).type, batch.num_rows
            counts, groups, numbers, times, bounds = aligner.align(batch.column(1))
            if len(aligner.pairs) > len(held):
                held = np.concatenate([held, np.zeros(2 * len(aligner.pairs) - len(held), np.int64)])
            held += np.bincount(numbers, minlength=len(held))
            columns = [lists(bounds, numbers, pa.int32()), lists(bounds, times, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[:, k]) for k in range(4)], pa.array(groups, pa.string()), pa.array([number] * n, pa.int64()), *columns, pa.array([False] * n)], names)
            size += batch.column(1).nbytes
            if size > chunk:
                yield close()
                aligner.settle()
                number, size = number + 1, 0
                held = np.zeros(1 << 12, np.int64)
        if size:
            yield close()

    return rows.mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, chunk long, numbers array<int>, times array<int>, pairs array<long>, summary boolean")


def pair_counts(summaries: DataFrame) -> DataFrame:
    """``(pair, docs, best)``: documents that hold a pair, and whether no other pair of its A id is held by more."""
    each = summaries.select(F.explode(F.arrays_zip("pairs", "times")).alias("e")).select(F.col("e.pairs").alias("pair"), F.col("e.times").cast("long").alias("docs"))
    counts = each.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a", F.shiftright("pair", 32))
    top = counts.groupBy("a").agg(F.max("docs").alias("top"))
    return counts.join(top, "a").select("pair", "docs", (F.col("docs") == F.col("top")).alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per row: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` and ``count_sum`` (over links, by the corpus-wide counts of their pairs) and ``groups_sha256``."""
    found = aligned(docs, byte_path, piece_path, id_col, text, chunk)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    found = stored(found.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    rows, summaries = found.where("not summary").drop("summary", "pairs"), found.where("summary").select("chunk", "numbers", "times", "pairs")
    counts = stored(pair_counts(summaries), "pair-counts")
    own = summaries.select(F.col("chunk").alias("of_chunk"), F.explode(F.arrays_zip("numbers", "pairs")).alias("e")).select("of_chunk", F.col("e.numbers").alias("number"), F.col("e.pairs").alias("pair"))
    own = own.join(counts, "pair").select("of_chunk", "number", "docs", "best")
    kind = dict(rows.dtypes)["id"]
    plain = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        forget()
        at = pairs.column("number").to_numpy()
        docs_of = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
        best = np.zeros_like(docs_of)
        docs_of[at], best[at] = pairs.column("docs").to_numpy(), pairs.column("best").to_numpy()
        numbers, times = (texts.column(c).combine_chunks() for c in ("numbers", "times"))
        edges = np.r_[0, np.cumsum(np.asarray(numbers.value_lengths()))]
        n, t = (x.flatten().to_numpy(zero_copy_only=False) for x in (numbers, times))
        total = lambda v: np.diff(np.r_[0, np.cumsum(v * t)][edges])
        out = texts.select(plain)
        return out.append_column("n_best", pa.array(total(best[n]))).append_column("count_sum", pa.array(total(docs_of[n])))

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    out = rows.groupBy("chunk").cogroup(own.groupBy("of_chunk")).applyInArrow(run, schema)
    return out.withColumnRenamed("id", id_col) if id_col != "id" else out
