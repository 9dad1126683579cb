"""Vector bin packing of examples into training sequences.

Every example asks for several resources at once: tokens, one segment, and
loss-bearing tokens. A sequence has a limit on each. The dot-product heuristic
fills one sequence at a time: among the examples that still fit under all limits
it takes the one whose demand has the largest dot product with what the sequence
has left. Where examples may be cut, whole sequences' worth of a long example are
cut off first, and what the heuristic leaves open is filled by cutting the pieces
of the emptiest sequences, under the same limits. A sequence that holds as many
segments as it may but isn't full, and what remains at the end of a task, is laid
out in sequences whose sizes are powers of two, so that nothing is padded.

Tasks pack what they read, in windows of bounded size, so there is no shuffle
and a repeated task gives the same sequences.

Defined results: a null or empty text is the end id alone; a text of any length
is cut as needed; equal rows are packed each; an empty table gives an empty
result; rows without an id are packed like any other; columns of other names are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm._store import bounded, frugal, table
from mensura.llm._text import slices
from mensura.llm.tokens import encoder

TOKENS = 2048
END_ID = 1
SEGMENTS = 64
WINDOW = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def dot_product_pack(demand: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Examples (rows of ``demand``) grouped so that no group's sums exceed ``limits``.

    An example that alone exceeds a limit gets a group of its own.
    """
    demand = np.asarray(demand, float).reshape(len(demand), len(limits))
    share = demand / limits
    open_ = np.ones(len(demand), bool)
    bins = []
    for seed in np.argsort(-share.max(axis=1), kind="stable"):
        if not open_[seed]:
            continue
        open_[seed] = False
        members, left = [int(seed)], limits - demand[seed]
        while True:
            fits = np.flatnonzero(open_ & (demand <= left).all(axis=1))
            if not len(fits):
                break
            best = int(fits[np.argmax(share[fits] @ (left / limits))])
            open_[best] = False
            members.append(best)
            left = left - demand[best]
        bins.append(members)
    return bins


class _Packer:
    """Places the pieces of a task; a piece is (doc_id, start, ids, doc_tokens).

    A sequence holds at most ``tokens`` ids, ``segments`` pieces and ``loss`` ids
    that bear loss, which are all of a piece but its first: nothing precedes it.
    """

    def __init__(self, partition: int, tokens: int, segments: int, loss: int):
        self.next, self.held, self.rows = partition << 33, [], []
        self.tokens, self.segments, self.loss = tokens, segments, loss

    def emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        most = min(self.tokens, self.loss + 1)  # what one piece may hold
        whole = len(ids) - len(ids) % most if most == self.tokens else 0
        for at in range(0, whole, most):
            self.emit([(doc, at, ids[at : at + most], len(ids))])
        for at in range(whole, len(ids), most):
            self.held.append((doc, at, ids[at : at + most].copy(), len(ids)))
        if len(self.held) >= WINDOW:
            self.pack()

    def room(self, pieces: list) -> int:
        """Ids that one more piece of a sequence may have."""
        if len(pieces) >= self.segments:
            return 0
        size = sum(len(p[2]) for p in pieces)
        return max(0, min(self.tokens - size, self.loss - (size - len(pieces)) + 1))

    def cut(self, pieces: list, most: int) -> tuple[list, list]:
        """As many of the pieces as have ``most`` ids, the last of them cut, and the rest."""
        taken, rest = [], list(pieces)
        while most and rest:
            doc, start, ids, total = rest.pop(0)
            taken.append((doc, start, ids[:most], total))
            if len(ids) > most:
                rest.insert(0, (doc, start + most, ids[most:], total))
            most -= len(taken[-1][2])
        return taken, rest

    def short(self, pieces: list) -> list:
        """Lays out pieces that fit into one sequence but don't fill it: the largest power of two of their ids; returns the rest."""
        size = sum(len(p[2]) for p in pieces)
        taken, rest = self.cut(pieces, 1 << (size.bit_length() - 1))
        self.emit(taken)
        return rest

    def pack(self) -> list:
        """Packs what is held, and keeps the pieces of the one sequence that isn't full and what short sequences left over."""
        size = np.array([len(p[2]) for p in self.held])
        demand = np.stack([size, np.ones_like(size), size - 1], axis=1)
        groups = [[self.held[i] for i in g] for g in dot_product_pack(demand, np.array([self.tokens, self.segments, self.loss]))]
        load = lambda g: sum(len(p[2]) for p in g)
        for g in [g for g in groups if load(g) == self.tokens]:
            self.emit(g)
        rest, over = sorted((g for g in groups if load(g) < self.tokens), key=load), []
        while len(rest) > 1:
            into = rest.pop()
            while rest and (room := self.room(into)):
                taken, left = self.cut(rest[0][-1:], room)
                into += taken
                rest[0] = rest[0][:-1] + left
                if not rest[0]:
                    rest.pop(0)
            if load(into) == self.tokens:
                self.emit(into)
            elif self.room(into):
                rest.append(into)  # nothing is left to fill it with
                break
            else:
                over += self.short(into)
        self.held = [*(rest[0] if rest else []), *over]
        return self.held

    def finish(self) -> None:
        while self.held:
            pieces, self.held = self.held, []
            fit: list = []
            while pieces and (room := self.room(fit)):
                taken, pieces = self.cut(pieces, min(room, len(pieces[0][2])))
                fit += taken
            self.held = [*self.short(fit), *pieces]

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.record_batch({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})


def _packed(path: str, limits: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, words = _Packer(TaskContext.get().partitionId(), *limits), encoder(path)
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for s in slices(batch.column("text")):
                ids, first = words.encode(s)
                for i in range(len(s)):
                    packer.add(docs[s.rows.start + i], np.append(ids[first[i] : first[i + 1]], np.uint32(END_ID)))
                if packer.rows:
                    yield packer.batch()
        packer.finish()
        yield packer.batch()

    return run


def _tokenizer(path: str | None) -> str:
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None) -> DataFrame:
    """One row for each piece of documents(doc_id, text) in sequences of at most ``tokens`` ids, ``segments`` pieces and
    ``loss`` loss-bearing ids (all of a piece but its first; without a limit of its own, ``tokens``)."""
    limits = (tokens, segments, tokens if loss is None else loss)
    return bounded(docs).select("doc_id", "text").mapInArrow(frugal(_packed(_tokenizer(tokenizer), limits)), PIECES)


def _examples(limits: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, WINDOW):
                part = batch.slice(at, WINDOW)
                demand = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("tokens", "segments", "loss_tokens")], axis=1)
                sequence = np.zeros(part.num_rows, np.int64)
                for members in dot_product_pack(demand, np.array(limits, float)):
                    sequence[members] = following
                    following += 1
                yield pa.record_batch({"id": part.column("id"), "tokens": part.column("tokens"), "loss_tokens": part.column("loss_tokens"), "sequence_id": pa.array(sequence)})

    return run


def pack_examples(examples: DataFrame, tokens: int = TOKENS, segments: int = 32, loss_tokens: int = TOKENS) -> DataFrame:
    """(id, sequence_id, tokens, loss_tokens) for whole examples(id: long, tokens, loss_tokens), e.g. turns of instruction data, that mustn't be cut.

    ``segments`` limits the examples of a sequence, ``loss_tokens`` those of its
    tokens that bear loss; nulls ask for nothing.
    """
    asked = examples.select(
        F.col("id").cast("long"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("tokens", "loss_tokens")), F.lit(1.0).alias("segments")
    )
    packed = asked.mapInArrow(frugal(_examples((tokens, segments, loss_tokens))), "id long, tokens double, loss_tokens double, sequence_id long")
    return packed.select("id", "sequence_id", F.col("tokens").cast("long"), F.col("loss_tokens").cast("long"))


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for batch in batches:
            for s in slices(batch.column("text")):
                _, first = words.encode(s)
                yield pa.record_batch({"conv_id": batch.column("conv_id").slice(s.rows.start, len(s)), "role": batch.column("role").slice(s.rows.start, len(s)), "n": pa.array(np.diff(first) + 1)})

    return run


def pack_conversations(turns: DataFrame, tokenizer: str | None = None, tokens: int = TOKENS, segments: int = 8, loss: int = 1536) -> DataFrame:
    """conv_id, tokens, loss_tokens and sequence_id of conversations(conv_id, role, text) as whole examples.

    A turn has the ids of its text and an end id; those of the assistant's turns
    bear loss. A sequence holds at most ``tokens`` ids, ``segments`` conversations
    and ``loss`` loss-bearing ids; a conversation that alone exceeds a limit has a
    sequence of its own. Turns without an id are one conversation.
    """
    counted = bounded(turns).select(F.col("conv_id").cast("long"), "role", "text").mapInArrow(frugal(_counted(_tokenizer(tokenizer))), "conv_id long, role string, n long")
    sizes = counted.groupBy("conv_id").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)).alias("loss_tokens"))
    sizes = table(sizes.withColumnRenamed("conv_id", "id"), "packing-sizes")
    return pack_examples(sizes, tokens, segments, loss).select(F.col("id").alias("conv_id"), "tokens", "loss_tokens", "sequence_id")


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def instruction_query(spark, sf_dir: str) -> DataFrame:
    return pack_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
