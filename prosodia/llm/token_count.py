"""Token counts of whole texts: pieces of each distinct pre-token, joined to each document's pre-token frequencies."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prosodia.llm.pretokens import splitter
from prosodia.llm.shared import lean, materialise, process_store, utf8

#: What the frequent pre-tokens are chosen from, how many there are at most and how long one may be in characters. They
#: decide which side of the join is sent where, and nothing else.
HEAD_DOCS, HEAD_TERMS, HEAD_CHARS = 20_000, 50_000, 64


class Counting:
    """A tokenizer file's rules: how a text falls into pre-tokens and how many pieces each has."""

    def __init__(self, path: str, pattern: str):
        import os

        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = True
        self.apart = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split = splitter(pattern)

    def pretokens(self, text: str) -> tuple[int, Counter]:
        """How many special strings a text has, which are one token each, and the frequencies of its pre-tokens."""
        if self.apart is None or not any(s in text for s in self.special):
            return 0, Counter(self.split(text))
        found, parts = Counter(), self.apart.split(text)
        for part in parts:
            found.update(self.split(part))
        return len(parts) - 1, found

    def pieces(self, pretokens: list[str]) -> list[int]:
        """Lengths of the encodings; their ids are never made into lists."""
        return [len(e) for e in self.tokenizer.encode_batch_fast(pretokens, add_special_tokens=False)]


def counting(path: str, pattern: str) -> Counting:
    return process_store(("counting", path, pattern), lambda: Counting(path, pattern))


def _counted(pretokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(pretoken, pieces) for distinct pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = counting(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(here.pieces(batch.column(0).to_pylist()), pa.int64())], ["pretoken", "pieces"])

    return pretokens.select("pretoken").mapInArrow(lean(run), "pretoken string, pieces long")


def frequent(slim: DataFrame, path: str, pattern: str, head_docs: int = HEAD_DOCS, head_terms: int = HEAD_TERMS) -> dict[str, int]:
    """Pieces of the ``head_terms`` most frequent pre-tokens of about ``head_docs`` rows, chosen by a hash of the id.

    At most HEAD_CHARS characters each, so the driver holds some ten megabytes at any size of the table.
    """
    n = slim.count()
    share = min(1_000_000, max(1, round(1_000_000 * head_docs / max(n, 1))))
    some = slim.where(F.pmod(F.xxhash64("doc_id", F.lit("pre-tokens")), F.lit(1_000_000)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = counting(path, pattern)
        for batch in batches:
            found: Counter = Counter()
            for text in utf8(batch.column(0)):
                found.update(here.pretokens((text or b"").decode())[1])
            found = {p: k for p, k in found.items() if len(p) <= HEAD_CHARS}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pretoken", "times"])

    seen = some.select("text").mapInArrow(lean(run), "pretoken string, times long").groupBy("pretoken").agg(F.sum("times").alias("times"))
    top = seen.orderBy(F.desc("times"), "pretoken").limit(head_terms)
    return {r["pretoken"]: r["pieces"] for r in _counted(top, path, pattern).collect()}


def _spread(slim: DataFrame, path: str, pattern: str, head: Callable[[], dict[str, int]]) -> DataFrame:
    """(doc_id, n_bytes, known, rest): tokens of special strings and frequent pre-tokens, and the other pre-tokens."""
    fields = [("doc_id", slim.schema["doc_id"].dataType), ("n_bytes", T.LongType()), ("known", T.LongType()), ("rest", T.MapType(T.StringType(), T.LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sent = counting(path, pattern), head()
        for batch in batches:
            sizes, known, rest = [], [], []
            for text in utf8(batch.column(1)):
                text = text or b""
                total, found = here.pretokens(text.decode())
                others = []
                for pretoken, times in found.items():
                    pieces = sent.get(pretoken)
                    if pieces is None:
                        others.append((pretoken, times))
                    else:
                        total += pieces * times
                sizes.append(len(text))
                known.append(total)
                rest.append(others)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(rest, pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])

    return slim.mapInArrow(lean(run), T.StructType([T.StructField(n, k) for n, k in fields]))


def token_counts(
    docs: DataFrame,
    path: str,
    pattern: str,
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    head_docs: int = HEAD_DOCS,
    head_terms: int = HEAD_TERMS,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per input row, as the tokenizer file at ``path`` counts.

    Each text becomes a table of pre-token frequencies. Pieces are counted once for each distinct pre-token, joined to the
    frequencies and summed; no ids are made. The join has two halves: pre-tokens that some documents show to be frequent
    are sent to every task (``head_terms`` at most, a bound that holds at any size) and meet the frequencies where these
    are made; all others, rows of their own, are grouped to distinct ones, counted, joined by pre-token and summed by row.
    A frequent pre-token longer than HEAD_CHARS is left to the second half, where adaptive execution splits its rows.

    Special strings inside texts count as one token, the file's default. Null counts as empty: 0 bytes and 0 tokens. Rows
    are told apart by a number of their own, so repeated rows come out as often as they came in, null ids too; equal
    texts get equal counts. Very long texts are read whole, as one table of frequencies. An empty table gives no rows.
    ``path`` is opened on the executors, each of which needs the file there. Further columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    head = docs.sparkSession.sparkContext.broadcast(frequent(slim, path, pattern, head_docs, head_terms))
    spread = _spread(slim, path, pattern, lambda: head.value)
    rows = materialise(spread.withColumn("row", F.monotonically_increasing_id()))
    rest = rows.select("row", F.explode("rest").alias("pretoken", "times"))
    pieces = materialise(_counted(rest.select("pretoken").distinct(), path, pattern))
    sums = rest.join(pieces, "pretoken").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("others"))
    n = F.col("known") + F.coalesce("others", F.lit(0))
    return rows.drop("rest").join(sums, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
