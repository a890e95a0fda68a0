"""Order-preserving packing of token streams into windows, cut by dynamic programming.

Documents follow one another in the order of their partition. A window covers at most ``max_len`` ids; windows may be cut
behind a document at no cost, behind a sentence at a small one and elsewhere at a large one. The cheapest cuts minimise
padding plus these penalties: cost(j) = min over i of cost(i) + (max_len - (p_j - p_i)) + penalty(j), where only points i
within ``max_len`` of j count. As cost(i) + p_i does not depend on j, a monotone queue gives each minimum in constant time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm._shared import ship
from gaugelake.llm.pretokens import IdEncoder, kept

#: Ids that are cut at a time; what the last window of such a block holds is carried into the next.
BLOCK_IDS = 1 << 20


@dataclass
class Costs:
    max_len: int = 4096
    sentence: int = 4
    inside: int = 16
    #: Of the sentence ends in each stretch of so many ids the first may be cut at.
    spacing: int = 8
    #: Where cut points lie farther apart, a sentence may be cut after each so many ids.
    grid: int = 16


def cut_points(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places where a window may end (0 and ``n`` among them) and the penalty of each."""
    grid = sentence_ends // costs.spacing
    thin = sentence_ends[np.flatnonzero(np.diff(grid, prepend=-1))] if len(sentence_ends) else sentence_ends
    free = np.unique(np.concatenate([[0, n], doc_ends]))
    points = np.unique(np.concatenate([free, thin]))
    step = costs.grid
    gaps = np.flatnonzero(np.diff(points) > step)
    forced = [np.arange(points[g] + step, points[g + 1], step) for g in gaps]
    penalty = np.where(np.isin(points, free), 0, costs.sentence)
    if forced:
        extra = np.concatenate(forced)
        points, penalty = np.concatenate([points, extra]), np.concatenate([penalty, np.full(len(extra), costs.inside)])
        order = np.argsort(points, kind="stable")
        points, penalty = points[order], penalty[order]
    return points, penalty


def best_cuts(points: np.ndarray, penalty: np.ndarray, max_len: int) -> list[int]:
    """The places of the cheapest cuts, from the first point to the last, both included."""
    p, pen = points.tolist(), penalty.tolist()
    m = len(p)
    key = [0] * m  # cost of the best cuts up to a point, plus its place
    back = [0] * m
    queue: deque[int] = deque([0])
    key[0] = p[0]
    for j in range(1, m):
        least = p[j] - max_len
        while p[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        back[j] = i
        k = key[j] = key[i] + max_len + pen[j]  # (key[i] + max_len - p[j] + pen[j]) + p[j]
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [p[-1]], m - 1
    while j > 0:
        j = back[j]
        cuts.append(p[j])
    return cuts[::-1]


def powers(length: int) -> list[int]:
    """Descending powers of two with this sum."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


@dataclass
class Packer:
    """Windows of a stream of documents, given one after another."""

    costs: Costs
    stops: np.ndarray  # token ids that end a sentence
    next_sequence: int = 0
    docs: list = field(default_factory=list)  # (doc_id, ids, place of these ids in the document, tokens of the document)
    size: int = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.size += len(ids)
        if self.size >= BLOCK_IDS:
            yield from self._cut(last=False)

    def finish(self) -> Iterator[tuple]:
        if self.size:
            yield from self._cut(last=True)

    def _cut(self, last: bool) -> Iterator[tuple]:
        """Pieces (doc_id, start, ids, doc_tokens, sequence, offset) of this block's windows; without ``last`` the final window waits."""
        docs, stream = self.docs, np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in docs])
        cuts = best_cuts(*cut_points(len(stream), ends, np.flatnonzero(np.isin(stream, self.stops)) + 1, self.costs), self.costs.max_len)
        if last:
            tail = cuts[-1] - cuts[-2]
            parts = powers(tail) if tail < self.costs.max_len else [tail]  # a power of two needs no padding
            cuts = [*cuts[:-1], *(cuts[-2] + np.cumsum(parts)).tolist()]
        else:
            cuts = cuts[:-1]
        done, k, starts = cuts[-1], 0, ends - np.array([len(d[1]) for d in docs])
        for a, b in zip(cuts, cuts[1:]):
            at = a
            while at < b:
                while ends[k] <= at:
                    k += 1
                stop = min(b, int(ends[k]))
                doc_id, _, place, total = docs[k]
                yield doc_id, place + at - int(starts[k]), stream[at:stop], total, self.next_sequence, at - a
                at = stop
            self.next_sequence += 1
        rest = [(d, ids[max(0, done - s) :], place + max(0, done - s), total) for (d, ids, place, total), s, e in zip(docs, starts.tolist(), ends.tolist(), strict=True) if e > done]
        self.docs, self.size = rest, len(stream) - done


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, sentence_ends: tuple[str, ...] = (".", "!", "?"), costs: Costs | None = None
) -> DataFrame:
    """``docs`` as pieces of sequences: (id_col, start, length, ids, doc_tokens, sequence_id, offset).

    Each document's ids by a white-space-dropping ``tokenizers`` file, then ``end_id``; a null text is empty and has that id alone.
    Each id lies in exactly one piece; a sequence's pieces are gapless from offset 0, in order. ids: little-endian unsigned 32-bit integers.
    Sequences are meant to be padded to ``costs.max_len``; only the last few of a partition are shorter by more than a cut costs, and
    these have lengths that are powers of two. sequence_id: the partition's number times 2^40, and a count. Documents keep the order of
    their partition and no row moves between machines. Repeated rows and null ids are packed like any other; a text of any length is cut over as many sequences as it takes; an empty table gives no piece;
    other columns are not read.
    """
    costs = costs or Costs()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = kept(IdEncoder, tokenizer_path, False)
        stops = np.array([i for s in sentence_ends for i in encoder.tokenizer.encode(s, add_special_tokens=False).ids], encoder.dtype)
        packer = Packer(costs, stops, TaskContext.get().partitionId() << 40)
        schema = pa.schema([("id", kind), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            rows.clear()
            return made

        def keep(pieces: Iterator[tuple]) -> Iterator:
            for doc_id, start, ids, total, sequence, offset in pieces:
                rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset))
                if len(rows) >= 1000:
                    yield out()

        end = np.array([end_id], encoder.dtype)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, code in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                yield from keep(packer.add(doc_id, np.concatenate([np.frombuffer(code, encoder.dtype), end])))
        yield from keep(packer.finish())
        if rows:
            yield out()

    from pyspark.sql.pandas.types import to_arrow_type

    ship(docs.sparkSession)
    kind = to_arrow_type(docs.schema[id_col].dataType)
    rows_in = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    packed = rows_in.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
