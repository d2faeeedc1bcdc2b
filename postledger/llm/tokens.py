"""Token counts of texts of any length: chunks with overlaps, spliced where no token can cross."""
from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, map_rows, type_of, utf8

LIMIT = 4096
CHUNK_BYTES = 1 << 16
OVERLAP_BYTES = 1 << 10
_AT_ONCE = 64  # texts per call of the library


class Model:
    """A SentencePiece BPE model and the pairs of neighbouring characters inside its pieces.

    A BPE token is joined from neighbouring parts. Where two neighbouring
    characters occur side by side in no piece, no join ever spans them, so the
    tokens on either side do not depend on each other: such a position is a
    token boundary in every chunk that holds both characters.
    """

    def __init__(self, proto: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(proto)
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a model that rewrites characters has no proven boundaries")
        if spec.trainer_spec.model_type != pb.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback have proven boundaries")
        self.inside = {pair for p in spec.pieces if p.type != pb.ModelProto.SentencePiece.BYTE for pair in zip(p.piece, p.piece[1:])}
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)

    def counts(self, texts: list[bytes]) -> list[int]:
        out: list[int] = []
        for at in range(0, len(texts), _AT_ONCE):
            out.extend(map(len, self.library.encode([t.decode("utf-8") for t in texts[at:at + _AT_ONCE]], num_threads=1)))
        return out

    def boundary(self, body: bytes, low: int, high: int, edges: set[int]) -> int | None:
        """First byte position strictly between ``low`` and ``high`` that no token can cross."""
        at = low
        last = None
        for c in body[low:high].decode("utf-8"):
            shown = "▁" if c == " " else c
            if last is not None and (last, shown) not in self.inside and at in edges:
                return at
            last = shown
            at += len(c.encode("utf-8"))
        return None

    def encode_span(self, body: bytes, head: tuple[int, int] | None, tail: tuple[int, int] | None):
        """Boundaries found in the head and tail regions, and the tokens between them (None if one is missing)."""
        begins = [p.begin for p in self.library.encode(body.decode("utf-8"), return_type="proto").pieces]
        edges = set(begins)
        low = self.boundary(body, *head, edges) if head else None
        high = self.boundary(body, *tail, edges) if tail else None
        if (head and low is None) or (tail and high is None):
            return low, high, None
        first, last = low or 0, high if tail else len(body) + 1
        return low, high, sum(first <= b < last for b in begins)


def _start(text: bytes, at: int) -> int:
    """The first code point that starts at byte ``at`` or later."""
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(text))


def count_tokens(docs: DataFrame, proto: bytes, limit: int = LIMIT, chunk_bytes: int = CHUNK_BYTES,
                 overlap_bytes: int = OVERLAP_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    ``proto`` is the content of the model's file, below a few MB, so executors
    need no file. Texts of at most ``chunk_bytes`` are encoded as they are.
    Longer ones become overlapping chunks with byte offsets, dealt anew over
    all tasks. Each chunk is encoded with the offsets of its tokens; two
    neighbours are spliced at the first position of their overlap that is a
    token boundary in both and that no piece of the vocabulary can span. Where
    an overlap has none, it is widened to the whole neighbour: the chunks are
    joined and encoded as one. Null texts are empty and have no tokens,
    repeated rows are counted each, other columns are ignored, an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(proto)  # one file of fixed size

    def cut(batches):
        model = Model(shipped.value)
        for rids, ids, texts in batches:
            small = [i for i, t in enumerate(texts) if len(t) <= chunk_bytes]
            yield {"rid": [rids[i] for i in small], "doc_id": [ids[i] for i in small], "n_bytes": [len(texts[i]) for i in small],
                   "n_tokens": model.counts([texts[i] for i in small]), **{k: [None] * len(small) for k in ("chunk", "offset", "tail", "body")}}
            for i, text in enumerate(texts):
                if len(text) <= chunk_bytes:
                    continue
                starts = sorted({_start(text, at) for at in range(0, len(text), chunk_bytes)} - {len(text)})
                for k, start in enumerate(starts):
                    following = starts[k + 1] if k + 1 < len(starts) else None
                    end = len(text) if following is None else _start(text, following + overlap_bytes)
                    yield {"rid": [rids[i]], "doc_id": [ids[i]], "n_bytes": [len(text)], "n_tokens": [None], "chunk": [k],
                           "offset": [start], "tail": [None if following is None else following - start], "body": [text[start:end]]}

    kind = type_of(docs, "doc_id")
    pieces = cut_lineage(map_rows(
        docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", utf8().alias("text")),
        [("rid", "long"), ("doc_id", kind), ("n_bytes", "long"), ("n_tokens", "long"), ("chunk", "int"),
         ("offset", "long"), ("tail", "long"), ("body", "binary")], cut))
    chunks = pieces.filter("chunk is not null")

    def spans(batches):
        model = Model(shipped.value)
        for rids, numbers, tails, widths, bodies in batches:
            found = []
            for k, tail, width, body in zip(numbers, tails, widths, bodies):
                head = None if k == 0 else (0, min(width, len(body)))
                found.append(model.encode_span(body, head, None if tail is None else (tail, len(body))))
            yield {"rid": rids, "chunk": numbers, "joined": [k > 0 and f[0] is None for k, f in zip(numbers, found)], "n": [f[2] for f in found]}

    order = Window.partitionBy("rid").orderBy("chunk")
    # the width of a chunk's head is that of the overlap the chunk before ends with
    wide = chunks.withColumn("width", F.lag(F.col("offset") + F.octet_length("body")).over(order) - F.col("offset")).select(
        "rid", "chunk", "width")
    encoded = cut_lineage(map_rows(
        chunks.join(wide, ["rid", "chunk"]).repartition("rid", "chunk").select("rid", "chunk", "tail", "width", "body"),
        [("rid", "long"), ("chunk", "int"), ("joined", "boolean"), ("n", "long")], spans))
    # a chunk that found no boundary in its head belongs to the run of the one before
    runs = encoded.withColumn("run", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(order))
    length = F.count("*").over(Window.partitionBy("rid", "run"))
    runs = runs.withColumn("length", length)
    whole = runs.filter("length = 1").select("rid", "n")

    def merged(key, part):
        model = Model(shipped.value)
        rows = sorted(part.to_pylist(), key=lambda r: r["chunk"])
        body, base = b"", rows[0]["offset"]
        for r in rows:
            body = body[:r["offset"] - base] + r["body"]
        first, last = rows[0], rows[-1]
        head = None if first["chunk"] == 0 else (0, first["width"])
        tail = None if last["tail"] is None else (last["offset"] - base + last["tail"], len(body))
        return pa.table({"rid": [first["rid"]], "n": [model.encode_span(body, head, tail)[2]]}, schema=pa.schema([("rid", pa.int64()), ("n", pa.int64())]))

    again = runs.filter("length > 1").select("rid", "chunk", "run").join(chunks, ["rid", "chunk"]).join(wide, ["rid", "chunk"])
    again = again.select("rid", "run", "chunk", "offset", "tail", "width", "body").groupBy("rid", "run").applyInArrow(merged, "rid long, n long")
    totals = whole.unionByName(again).groupBy("rid").agg(F.sum("n").alias("n_tokens"))
    long = chunks.filter("chunk = 0").select("rid", "doc_id", "n_bytes").join(totals, "rid")
    parts = [pieces.filter("chunk is null").select("doc_id", "n_bytes", "n_tokens"), long.select("doc_id", "n_bytes", "n_tokens")]
    return reduce(DataFrame.unionByName, parts).withColumn("over_limit", F.col("n_tokens") > limit)
