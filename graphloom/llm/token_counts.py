"""Token counts: forward scores in a trie of distinct pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import arrow_rows
from graphloom.llm.piece_fst import PieceTransducer
from graphloom.llm.pieces import MODEL_PATH, PieceModel, model_of, read_model

#: Nodes of a worker's trie, and pre-tokens with a count; a fuller one is begun anew, which changes no count.
MOST_NODES = 500_000
MOST_TERMINALS = 1_000_000


class CountingTrie:
    """Node k ends a prefix of some pre-token: its score is that of the prefix's best segmentation,
    tokens[k] that one's length.

    A prefix's forward score depends on the prefix alone, so it is computed once, when its node is
    made, from the nodes before it on the path; pre-tokens that share it find it there. The counts
    of whole pre-tokens are kept in terminal. Segmentations are scored by the sum of their pieces'
    scores, the better of two ways to a node kept, and of the same score the one whose last piece is
    longest. For merge-rank (BPE) models, where the largest sum is not what merging gives, only pieces
    that may follow the prefix's last one are tried (see PieceTransducer); so for either kind the
    counts are those of the model's own encoding.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.machine = PieceTransducer(model)
        self._clear()

    def _clear(self) -> None:
        self.machine._clear()
        self.tokens = [0]
        self.terminal: dict[str, int] = {}

    def insert(self, pretoken: str) -> int:
        machine, tokens = self.machine, self.tokens
        if machine.shared_ranks(pretoken):
            count = len(machine._path(pretoken))
        else:
            node = machine.states(pretoken)[-1]
            for made in range(len(tokens), len(machine.last)):
                piece = machine.last[made]
                tokens.append(tokens[machine.left[made]] + (1 if piece in self.model.ids else len(self.model.fallback(piece))))
            count = tokens[node]
        self.terminal[pretoken] = count
        return count

    def score(self, pretoken: str) -> float:
        """The forward score of a pre-token."""
        return -self.machine.weight[self.machine.states(pretoken)[-1]]

    def count(self, text: str) -> tuple[int, int]:
        """(tokens, pre-tokens) of a text."""
        found = self.machine.pretokens(text)
        terminal = self.terminal
        for pretoken in sorted({p for p in found if p not in terminal}):
            self.insert(pretoken)
        total = sum(map(terminal.__getitem__, found))
        if len(self.tokens) > MOST_NODES or len(terminal) > MOST_TERMINALS:
            self._clear()
        return total, len(found)


@lru_cache(maxsize=1)
def _trie(data: bytes) -> CountingTrie:
    """A worker process's trie; it lasts over tasks."""
    return CountingTrie(model_of(data))


class _Counts:
    def __init__(self, data: bytes):
        self.data = data

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(self.data)
        for batch in batches:
            found = [trie.count(t or "") for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_pretokens"])


def count_tokens(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens) for every row of docs (doc_id, text).

    n_tokens is the length of the encoding by the SentencePiece model file, of unigram or merge-rank
    (BPE) kind, without control pieces. A character in no piece counts as its UTF-8 bytes if the model
    falls back to bytes, else as one token. Null and empty texts have no tokens; so have blank ones if
    the model drops outer spaces, else they are their spaces. Repeated rows and null ids stay; doc_id
    keeps its type. Other columns are not read. An empty table gives an empty one.
    """
    arrow_rows(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_Counts(read_model(model_path)), f"doc_id {kind}, n_tokens bigint, n_pretokens bigint")
