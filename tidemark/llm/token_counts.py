"""Token counts from distinct pre-tokens: each is counted once, then joined to the frequencies of each text.

One pass collects the distinct pre-tokens of all texts, each task summing its own first, and the library counts every one
of them once; that table is written. A second pass makes the frequencies of each text and joins them to it: the most
frequent pre-tokens, at most FREQUENT of KEEP_BYTES each, are broadcast, and the others, of which none has more than
about one in FREQUENT of all pre-tokens, are joined by a shuffle on the pre-token. Token ids of a text are never made.

Where a tokenizer drops white space, a run between ASCII white space is a pre-token: nothing the library does
(normalising, splitting, merging, special strings) reaches across it. Other tokenizers are split by the library's own
normaliser and pre-tokenizer, but for texts with special strings, which are counted whole where they stand, as are
pre-tokens over KEEP_BYTES.

A null text counts as empty, with no tokens. Repeated rows each get a row; there is nothing to tie. Very long texts are
counted whole. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

import os
from collections import Counter
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.session import materialise
from tidemark.llm.text import slices

#: Longer pre-tokens are counted where they stand.
KEEP_BYTES = 256
#: Most pre-tokens that are broadcast.
FREQUENT = 1 << 17
#: Distinct pre-tokens that a task holds before it sends them off.
FLUSH = 1 << 18

_loaded: dict = {}


class Pieces:
    """Pre-tokens and their token counts under one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        probe = self.tokenizer.encode("a b", add_special_tokens=False).tokens
        self.drops_space = probe == [t for x in "ab" for t in self.tokenizer.encode(x, add_special_tokens=False).tokens] and (
            self.tokenizer.encode(" \t\n\r\f\v ", add_special_tokens=False).ids == [])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def split(self, text: bytes) -> list[bytes] | None:
        """Pre-tokens of a text, or None where it must be counted whole."""
        if self.drops_space:
            return text.split()
        s = text.decode()
        if self.tokenizer.pre_tokenizer is None or any(t in s for t in self.special):
            return None
        s = self.tokenizer.normalizer.normalize_str(s) if self.tokenizer.normalizer else s
        return [p.encode() for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(s)]

    def whole(self, text: bytes) -> int:
        return len(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)

    def count(self, pieces: list[bytes]) -> list[int]:
        """Token counts of pre-tokens."""
        if self.drops_space:
            return [len(e) for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        return [len(self.tokenizer.model.tokenize(p.decode())) for p in pieces]


def pieces_for(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def distinct_pieces(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """(piece, freq, n): every distinct pre-token of at most KEEP_BYTES, its occurrences and its tokens."""

    def collect(batches):
        library, held = pieces_for(tokenizer_path), Counter()

        def flush():
            keys = list(held)
            for at in range(0, len(keys), 1 << 15):
                part = keys[at : at + (1 << 15)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(list(map(held.__getitem__, part)), pa.int64())], names=["piece", "freq"])

        for batch in slices(batches):
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = library.split(text) if text else None
                if words and len(max(words, key=len)) > KEEP_BYTES:
                    words = [w for w in words if len(w) <= KEEP_BYTES]
                held.update(words or ())
                if len(held) > FLUSH:
                    yield from flush()
                    held.clear()
        yield from flush()

    def count(batches):
        library = pieces_for(tokenizer_path)
        for batch in batches:
            n = library.count(batch.column("piece").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["piece", "freq", "n"])

    found = texts.select("text").mapInArrow(collect, "piece binary, freq bigint").groupBy("piece").agg(F.sum("freq").alias("freq"))
    return found.mapInArrow(count, "piece binary, freq bigint, n bigint")


def least_frequent(pieces: DataFrame) -> int:
    """The least frequency at which at most FREQUENT pre-tokens are left, from counts by eighths of a power of two."""
    step = F.floor(F.log2("freq") * 8)
    many, least = 0, 1 << 62
    for row in pieces.groupBy(step.alias("step")).agg(F.count("*").alias("many"), F.min("freq").alias("least")).orderBy(F.desc("step")).collect():
        many += row["many"]
        if many > FREQUENT:
            break
        least = row["least"]
    return least


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text; the tokenizer file is on every machine."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    pieces = materialise(distinct_pieces(docs, tokenizer_path), "pieces")
    least = least_frequent(pieces)
    frequent = pieces.where(F.col("freq") >= least).select("piece", "n").toArrow()
    frequent = docs.sparkSession.sparkContext.broadcast((frequent.column("piece").to_pylist(), frequent.column("n").to_pylist()))

    def join(batches):
        library, known = pieces_for(tokenizer_path), dict(zip(*frequent.value, strict=True))
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            tokens, rest, times = [], [], []
            for text in texts:
                words = library.split(text)
                if words is None:
                    words, n = (), library.whole(text)
                else:
                    n = 0
                freq = Counter(words)
                far = [p for p in freq if p not in known]
                far_times = list(map(freq.pop, far))
                n += sum(map(mul, map(known.__getitem__, freq), freq.values()))
                long = [k for k, p in enumerate(far) if len(p) > KEEP_BYTES]
                if long:
                    n += sum(map(mul, library.count([far[k] for k in long]), [far_times[k] for k in long]))
                    short = [k for k, p in enumerate(far) if len(p) <= KEEP_BYTES]
                    far, far_times = [far[k] for k in short], [far_times[k] for k in short]
                tokens.append(n)
                rest.append(far)
                times.append(far_times)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array(rest, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))], names=["doc_id", "row", "n_bytes", "n", "pieces", "times"])

    # The row numbers are read back from the written table, so they are the same however often they are read.
    rows = materialise(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        join, f"doc_id {id_type}, row bigint, n_bytes bigint, n bigint, pieces array<binary>, times array<int>"), "frequencies")
    far = rows.where(F.size("pieces") > 0).select("row", F.explode(F.arrays_zip("pieces", "times")).alias("x")).select("row", "x.pieces", "x.times")
    rare = pieces.where(F.col("freq") < least).select(F.col("piece").alias("pieces"), F.col("n").alias("each"))
    sums = far.join(rare, "pieces").groupBy("row").agg(F.sum(F.col("times") * F.col("each")).alias("far"))
    total = F.col("n") + F.coalesce("far", F.lit(0))
    return rows.join(sums, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
