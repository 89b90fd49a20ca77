"""Token counts by a compiled finite-state transducer.

The tokenizer's pieces hold a space mark only at their start, so no merge crosses the
place where a space follows another character. There the tokenizer is back in its
start state: its run over a text is a run over *segments* (spaces and the word after
them), and each segment emits a number of tokens that depends on it alone.

``CountTransducer`` is that machine. From the start state each segment leads back to the
start state, over a transition annotated with the number of tokens the library gives for
it; the library compiles a transition when its segment is met first. The other states
are segments begun but not ended, in which the end of a chunk leaves the machine.

A chunk of text thus acts on the machine as a map from states to states with a count: a
``ChunkMap``. A chunk without a boundary extends any state; another one ends the segment
it is given, emits the count of what lies between its first and last boundary, and ends
in a state of its own. Maps compose associatively, so the chunks of a long text are read
independently and composed by a parallel prefix scan.

Memory per task is bounded by a batch of rows and by the transitions kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Transitions that a machine keeps; others are compiled again when needed.
MAX_TRANSITIONS = 500_000
#: Characters in a segment whose transition is kept.
MAX_KEPT_CHARS = 64
#: Characters in a chunk.
CHUNK_CHARS = 65_536
#: The tokenizer's mark for a space; in a text it means the same as a space.
MARK = "▁"
SEGMENT = re.compile(" +[^ ]*")
NO_SPACE = re.compile("[^ ]")


class ChunkMap(NamedTuple):
    """From a state q, the machine emits ``emits(q + head) + count`` and ends in ``tail``.

    Without a boundary in the chunk, ``tail`` is None and q becomes ``q + head``.
    """

    head: str
    count: int
    tail: str | None


class _Emits(dict):
    """Tokens emitted over the transition of a segment (its first space left out)."""

    def __init__(self, encode, most: int):
        self._encode, self._most = encode, most
        #: A space that ends a text is a segment of its own.
        self._lone_space = len(encode("a ")) - len(encode("a"))

    def __missing__(self, segment: str) -> int:
        n = len(self._encode(segment)) if segment else self._lone_space
        if len(segment) <= MAX_KEPT_CHARS:
            if len(self) >= self._most:
                self.clear()
            self[segment] = n
        return n


class CountTransducer:
    """Token counts of texts, equal to the library's ``len(encode(text))``."""

    def __init__(self, processor, max_transitions: int = MAX_TRANSITIONS, chunk_chars: int = CHUNK_CHARS):
        self.emits, self.chunk_chars = _Emits(processor.encode, max_transitions), chunk_chars

    def read(self, chunk: str) -> ChunkMap:
        """The map of a chunk that starts at a text's start or at another character than a space."""
        i = chunk.find(" ")
        if i < 0:
            return ChunkMap(chunk, 0, None)
        head, rest = chunk[:i], chunk[i:]
        segments = rest[1:].split(" ") if "  " not in rest else [s[1:] for s in SEGMENT.findall(rest)]
        tail = segments.pop()
        return ChunkMap(head, sum(map(self.emits.__getitem__, segments)), tail)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First a, then b."""
        if a.tail is None:
            return ChunkMap(a.head + b.head, b.count, b.tail)
        if b.tail is None:
            return ChunkMap(a.head, a.count, a.tail + b.head)
        return ChunkMap(a.head, a.count + self.emits[a.tail + b.head] + b.count, b.tail)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """The composition of each prefix of ``maps``, in logarithmic depth."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)])
        return [maps[0], *(pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], maps[i]) for i in range(1, len(maps)))]

    def chunks(self, text: str) -> list[str]:
        """The text with its leading space mark, cut before characters other than spaces."""
        text = " " + text
        if len(text) <= self.chunk_chars:
            return [text]
        cuts = [0]
        while cuts[-1] + self.chunk_chars < len(text) and (m := NO_SPACE.search(text, cuts[-1] + self.chunk_chars)):
            cuts.append(m.start())
        return [text[i:j] for i, j in zip(cuts, [*cuts[1:], None], strict=True)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        whole = self.scan([self.read(c) for c in self.chunks(text.replace(MARK, " "))])[-1]
        return whole.count + self.emits[whole.tail]


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    ``model_path`` is a sentencepiece model on every executor; left out, each executor
    asks the installed ``public_tokenizers`` for ``piece_bpe_32k.model``.

    Null texts count as empty and have no tokens. Rows are counted one by one, so null
    or repeated doc_ids pass through; of an empty table the result is empty. Other
    columns of ``docs`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        path = model_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        machine = CountTransducer(sentencepiece.SentencePieceProcessor(model_file=path))
        for batch in batches:
            counts = pa.array([machine.count(t.as_py()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
