"""Vector bin packing of examples into training sequences.

An example demands tokens, a segment and loss-bearing tokens; a sequence has limits on all
three.  A sequence is filled by taking, among the examples that still fit, the one whose
demands have the largest dot product with what remains.  Examples are dealt to blocks of a few
thousand by a hash; each block is packed by one task.

Conversations are examples too: all turns are tokens, the answers bear loss.  One that is over a limit
is cut between turns, and a turn that is over a limit inside.

Defined results: a null text counts as empty and still has its end id; documents and conversations over a
limit are cut; repeated rows are packed as so many examples; rows without doc_id are dealt to blocks by their
place in the table, those without conv_id are one conversation; a null turn comes first; an empty table gives an
empty result; further columns are left out of the digest and kept by ``pack``.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitweave.llm.common import blocks_for, durable, hash_share, small_batches, table
from visitweave.llm.registry import query
from visitweave.llm.token_ids import encoder, public_path
from visitweave.operators import grouped
from visitweave.operators.grouped import Running

TOKENIZER = "byte_bpe_50k.json"
END_ID = 1
SEQUENCE_TOKENS = 2048
SEQUENCE_SEGMENTS = 64
BLOCK_ROWS = 4096
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def fill(demands: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence of every example and its turn there; ``demands`` has a column per limit.

    Examples must fit an empty sequence.
    """
    kinds, kind = np.unique(demands, axis=0, return_inverse=True)   # equal demands are interchangeable
    share = kinds / limits
    order = np.lexsort((*share.T[::-1], share.sum(1)))[::-1]        # large first, so that ties take the first
    share, kind = share[order], np.argsort(order)[kind.ravel()]
    waiting = np.split(np.argsort(kind, kind="stable"), np.cumsum(np.bincount(kind, minlength=len(share)))[:-1])
    waiting = [list(x[::-1]) for x in waiting]
    sequence, turn = np.empty(len(demands), np.int64), np.empty(len(demands), np.int64)
    left = np.arange(len(share))
    number = 0
    while len(left):
        room, place, fits = np.ones(share.shape[1]), 0, left
        while len(fits):
            best = fits[np.argmax(share[fits] @ room)]
            item = waiting[best].pop()
            sequence[item], turn[item] = number, place
            room, place = room - share[best], place + 1
            if not waiting[best]:
                left = left[left != best]
                fits = fits[fits != best]
            fits = fits[(share[fits] <= room + 1e-9).all(1)]
        number += 1
    return sequence, turn


def pack(items: DataFrame, limits: dict[str, int], tokens: str, by: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to examples.

    ``limits`` names the demand columns; ``tokens`` is the one that offsets count; ``by`` are the
    columns whose hash deals examples to blocks.  ``items`` should be stored: it is counted first.
    Columns that already have the new names are replaced.
    """
    items = items.drop("sequence_id", "offset", "_block", "_turn")
    blocks = blocks_for(items.count(), block_rows)
    names = list(limits)

    def pack_block(pdf):
        demands = pdf[names].to_numpy(float)
        if (demands > np.array([limits[x] for x in names])).any():
            raise ValueError("an example is larger than a sequence")
        sequence, turn = fill(demands, np.array([limits[x] for x in names], float))
        out = pdf.assign(sequence_id=sequence + int(pdf["_block"].iloc[0]) * (1 << 32), _turn=turn)
        out = out.sort_values(["sequence_id", "_turn"], ignore_index=True)
        out["offset"] = out.groupby("sequence_id")[tokens].cumsum() - out[tokens]
        return out.drop(columns=["_block", "_turn"])
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in items.schema)}, sequence_id long, offset long"
    return items.withColumn("_block", hash_share(blocks, *by)).groupBy("_block").applyInPandas(pack_block, schema)


def pieces(docs: DataFrame, path: str, length: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Documents as pieces of at most ``length`` ids, the end id included."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encode = encoder(path)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids += end
                total = len(ids) // 4
                rows += [(doc_id, at, min(length, total - at), crc32(ids[4 * at:4 * (at + length)]), total)
                         for at in range(0, total, length)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)] if rows else
                                             [pa.array([], pa.int64())] * 5,
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE)


def pack_documents(docs: DataFrame, path: str | None = None, length: int = SEQUENCE_TOKENS,
                   segments: int = SEQUENCE_SEGMENTS) -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    The first id of a piece has nothing before it, so it bears no loss.
    """
    cut = durable(pieces(docs, path or public_path(TOKENIZER), length))
    items = cut.select("*", F.lit(1).cast("long").alias("segments"), (F.col("length") - 1).alias("loss_tokens"))
    limits = {"length": length, "segments": segments, "loss_tokens": length}
    named = items.withColumn("_row", F.coalesce("doc_id", F.monotonically_increasing_id()))   # stored, so it stays
    return pack(named, limits, "length", ["_row", "start"]).drop("segments", "_row")


def counted_turns(turns: DataFrame, path: str | None = None, answers: str = "assistant") -> DataFrame:
    """``conv_id, turn, row, tokens, loss_tokens``: ids of each turn with its end id; answers bear loss."""
    path = path or public_path(TOKENIZER)
    small_batches(turns.sparkSession)

    def count(batches):
        encode = encoder(path)
        for batch in batches:
            sizes = np.array([len(x) // 4 + 1 for x in encode(batch.column(3).to_pylist())], np.int64)
            loss = np.array([r == answers for r in batch.column(2).to_pylist()], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(sizes * loss)],
                                             ["conv_id", "turn", "tokens", "loss_tokens"])
    counted = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(
        count, "conv_id long, turn long, tokens long, loss_tokens long")
    return durable(counted.withColumn("row", F.monotonically_increasing_id()))


def conversation_items(turns: DataFrame, path: str | None = None, answers: str = "assistant",
                       limits: dict[str, int] | None = None) -> DataFrame:
    """Conversations as examples: all tokens, a segment per turn, and the tokens of the answers bear loss.

    With ``limits`` (``tokens, segments, loss_tokens``) those that are over one are cut: a turn into pieces of half a
    limit at most, and the conversation wherever a running sum passes a multiple of half a limit, so that no
    part is over any.  ``part`` tells the parts of a conversation apart.
    """
    counted = counted_turns(turns, path, answers)
    sums = [F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("segments"), F.sum("loss_tokens").alias("loss_tokens")]
    whole = counted.groupBy("conv_id").agg(*sums)
    if limits is None:
        return whole
    over = F.lit(False)
    for name, most in limits.items():
        over = over | (F.col(name) > most)
    keyed = whole.withColumn("over", over)
    fits = keyed.filter("not over").drop("over").withColumn("part", F.lit("0"))
    long_ = keyed.filter("over").select(F.col("conv_id").alias("_conv"))
    rows = counted.join(long_, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")
    half = {name: max(1, most // 2) for name, most in limits.items()}
    step = min(half["tokens"], half["loss_tokens"])
    cut = rows.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(step).cast("long"))))
    n = F.least(F.lit(step), F.col("tokens") - F.col("at"))
    pieces_ = cut.select("conv_id", F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "row", "at", n.alias("n"),
                         F.when(F.col("loss_tokens") > 0, n).otherwise(F.lit(0)).alias("l"))
    order = ["turn", "row", "at"]
    run = grouped.running(durable(pieces_), ["conv_id"], order, {
        "tokens_before": Running("sum", F.col("n"), inclusive=False), "place": Running("count"),
        "loss_before": Running("sum", F.col("l"), inclusive=False)})
    zero = F.lit(0)
    steps = [F.floor(F.coalesce("tokens_before", zero) / half["tokens"]), F.floor((F.col("place") - 1) / limits["segments"]),
             F.floor(F.coalesce("loss_before", zero) / half["loss_tokens"])]
    parts = run.withColumn("part", F.concat_ws("-", *[x.cast("string") for x in steps])).groupBy("conv_id", "part").agg(
        F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("segments"), F.sum("l").alias("loss_tokens"))
    return fits.unionByName(parts)


#: What a training sequence of conversations holds at most: with these all three limits bind.
DIALOGUE_LIMITS = {"tokens": 6144, "segments": 26, "loss_tokens": 4608}


def pack_conversations(turns: DataFrame, path: str | None = None, limits: dict[str, int] | None = None) -> DataFrame:
    """``conv_id, part, tokens, segments, loss_tokens, sequence_id, offset`` of all conversations."""
    limits = limits or DIALOGUE_LIMITS
    items = durable(conversation_items(turns, path, limits=limits))
    return pack(items, limits, "tokens", ["conv_id", "part"])


@query("op2_vector_packing")
def op2_vector_packing(spark, sf_dir):
    """Every document's pieces and where they lie in the packed sequences."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("pack_conversations")
def packed_conversations(spark, sf_dir):
    """Every conversation's place in sequences with limits on tokens, turns and answers."""
    return pack_conversations(table(spark, sf_dir, "conversations"))
