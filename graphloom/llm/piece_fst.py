"""SentencePiece encoding as a shortest path through weighted finite-state transducers."""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import arrow_rows
from graphloom.llm.pieces import BPE, END, MODEL_PATH, SPACE, PieceModel, model_of, read_model

#: Pre-tokens, pairs of pieces and states, of each of which a worker keeps so many at most.
MOST_KEPT = 400_000


class Normaliser:
    """The normaliser, compiled: step[state][space] is (next state, what is written before a copied run).

    State 0 has read nothing yet, 1 is within a word, 2 has read spaces that are not yet written. A
    run of characters other than spaces is read by one arc, which copies it; so is each space.
    """

    def __init__(self, model: PieceModel):
        first = SPACE if model.dummy_prefix else ""
        if model.trim:
            self.step = (((1, first), (0, None)), ((1, ""), (2, None)), ((1, SPACE), (2, None)))
        else:
            self.step = (((1, first), (1, first + SPACE)), ((1, ""), (1, SPACE)))
        self.runs = re.compile("[^ ]+| ")

    def __call__(self, text: str) -> str:
        if len(self.step) == 2 and text:  # after the first arc one state is left, which maps characters
            return self.step[0][0][1] + text.replace(" ", SPACE)
        state, out, step = 0, [], self.step
        for run in self.runs.findall(text):
            space = run == " "
            state, written = step[state][space]
            if written is not None:
                out.append(written if space else written + run)
        return "".join(out)


class Pieces:
    """Closure of the pieces and of byte fallback, compiled: the pieces' trie, read from their last
    characters, with an arc from each end back to the start that writes the piece at the weight
    -score; a character that is no piece has such an arc of its own, which writes bytes."""

    def __init__(self, model: PieceModel):
        self.start: dict = {}
        for piece, score in model.scores.items():
            node = self.start
            for character in reversed(piece):
                node = node.setdefault(character, {})
            node[END] = (piece, -score)
        self.unknown = -model.unknown_score

    def arcs_into(self, text: str, end: int) -> list[tuple[int, str, float]]:
        """(from position, piece, weight) of the composition's arcs into a position, the shorter first."""
        found = []
        node, at = self.start, end
        while at:
            at -= 1
            node = node.get(text[at])
            if node is None:
                break
            if END in node:
                found.append((at, *node[END]))
        if not found or found[0][0] != end - 1:
            found.insert(0, (end - 1, text[end - 1], self.unknown))
        return found


class PieceTransducer:
    """Normaliser, pieces and byte fallback as transducers, composed with one input at a time.

    Composed with an input, the states at the start of pieces are the input's positions, and an
    encoding is a path of least weight (tropical semiring: min, +). No piece reaches over a
    pre-token's end, so each pre-token is a path. The best way to a position depends on the
    characters before it alone; so inputs that begin alike share their states, each with its weight,
    its last piece and the state that this piece left.

    For merge-rank (BPE) models, least weight is not the right path: right is what merging pair by
    pair in the order of ranks gives. A sequence of pieces is that exactly if each two neighbours, as
    a text of their own, would be merged back to themselves. So there the pieces are composed with
    one more machine, an acceptor of such pairs whose state is the last piece (an arc it refuses has
    infinite weight); one path is left, and its weight is the sum of its pieces' as ever.
    """

    def __init__(self, model: PieceModel, most_kept: int = MOST_KEPT):
        self.model, self.most_kept = model, most_kept
        self.normaliser, self.pieces = Normaliser(model), Pieces(model)
        self.merges = model.kind == BPE
        self.kept: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.traces: dict[tuple[str, int], tuple | None] = {}  # two for each piece at most
        self._clear()

    def _clear(self) -> None:
        self.following: dict[int, int] = {}  # state and character -> state
        self.weight, self.last, self.left = [0.0], [""], [0]

    def pretokens(self, text: str) -> list[str]:
        return self.model.parts(self.normaliser(text))

    def encode(self, text: str) -> list[int]:
        """The numbers of a text."""
        out: list[int] = []
        kept = self.kept
        for pretoken in self.pretokens(text):
            ids = kept.get(pretoken)
            if ids is None:
                if len(kept) >= self.most_kept:
                    kept.clear()
                ids = kept[pretoken] = tuple(self._path(pretoken))
            out.extend(ids)
        return out

    def shared_ranks(self, text: str) -> bool:
        """Whether a pre-token begins with several spaces, whose pieces share one rank, so that
        neighbours do not decide alone; it is then merged directly."""
        return self.merges and text.startswith(SPACE * 2)

    def _path(self, text: str) -> list[int]:
        if self.shared_ranks(text):
            return self._numbers(self._merged_by_heap(text))
        if len(self.weight) > self.most_kept:
            self._clear()
        state = self.states(text)[-1]
        pieces = []
        while state:
            pieces.append(self.last[state])
            state = self.left[state]
        return self._numbers(reversed(pieces))

    def states(self, text: str) -> list[int]:
        """The state of every position; those that no input before has shared are made."""
        following, state, states = self.following, 0, [0]
        for end, character in enumerate(text, 1):
            key = state << 21 | ord(character)
            state = following.get(key, 0)
            if not state:
                state = following[key] = self._arrive(text, end, states)
            states.append(state)
        return states

    def _arrive(self, text: str, end: int, states: list[int]) -> int:
        """A new state for the first `end` characters, with the arc of the least path that leads there."""
        weight, last = self.weight, self.last
        best, start, piece = float("inf"), end - 1, text[end - 1]
        arcs = self.pieces.arcs_into(text, end)
        for at, one, cost in reversed(arcs) if self.merges else arcs:
            if self.merges and at and not self._stay_apart(last[states[at]], one):
                continue
            total = weight[states[at]] + cost
            if total <= best:
                best, start, piece = total, at, one
            if self.merges:
                break  # one path is left
        weight.append(best if best < float("inf") else weight[states[start]] + self.pieces.unknown)
        last.append(piece)
        self.left.append(states[start])
        return len(weight) - 1

    def _numbers(self, pieces) -> list[int]:
        out: list[int] = []
        ids = self.model.ids
        for piece in pieces:
            number = ids.get(piece)
            out.extend(self.model.fallback(piece) if number is None else (number,))
        return out

    def _stay_apart(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= self.most_kept:
                self.pairs.clear()
            known = self.pairs[left, right] = self._no_merge_between(left, right)
        return known

    def _no_merge_between(self, left: str, right: str) -> bool:
        """Whether merging left + right never joins the two.

        Until it does, each is merged as it would be alone, the better-scored step of the two
        first. A merge over the boundary comes first if it scores more than left's next step (which
        would win a tie, being further left) and no less than right's.
        """
        before, after = self._trace(left, -1), self._trace(right, 0)
        if before is None or after is None:
            return False
        (steps, ends), (steps_after, starts) = before, after
        score, none, i, j = self.model.scores.get, -float("inf"), 0, 0
        while True:
            own, next_ = steps[i], steps_after[j]
            over = score(ends[i] + starts[j], none)
            if over > own and over >= next_:
                return False
            if own == next_ == none:
                return True
            if own >= next_:
                i += 1
            else:
                j += 1

    def _trace(self, piece: str, side: int) -> tuple[list[float], list[str]] | None:
        """The scores of a piece's own merges in order (then minus infinity) and what stands at one
        side before each and in the end; None if merging does not lead to the piece."""
        found = self.traces.get((piece, side), 0)
        if found == 0:
            steps: list[float] = []
            sides: list[str] = []
            whole = self._merged(piece, steps, sides, side) == [piece]
            found = self.traces[piece, side] = ([*steps, -float("inf")], sides) if whole else None
        return found

    def _merged(self, text: str, steps: list[float] | None = None, sides: list[str] | None = None, side: int = 0) -> list[str]:
        """Characters merged pair by pair, of the best-scored piece first, leftmost of equals."""
        score, none = self.model.scores.get, -float("inf")
        parts = list(text)
        gains = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        if sides is not None:
            sides.append(parts[side])
        while gains and (best := max(gains)) > none:
            at = gains.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gains[at]
            if at:
                gains[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(gains):
                gains[at] = score(parts[at] + parts[at + 1], none)
            if sides is not None:
                steps.append(best)
                sides.append(parts[side])
        return parts


    def _merged_by_heap(self, text: str) -> list[str]:
        """_merged() in n log n steps, for long texts. Parts are known by where they start."""
        score, n = self.model.scores.get, len(text)
        part: dict[int, str] = dict(enumerate(text))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(at: int) -> None:
            if 0 <= at and after[at] < n:
                whole = part[at] + part[after[at]]
                gain = score(whole)
                if gain is not None:
                    heapq.heappush(heap, (-gain, at, whole))

        for at in range(n - 1):
            offer(at)
        while heap:
            _, at, whole = heapq.heappop(heap)
            right = after[at]
            if at not in part or right >= n or part[at] + part[right] != whole:
                continue  # one of the two has been merged meanwhile
            part[at] = whole
            del part[right]
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
            offer(at)
            offer(before[at])
        return [part[at] for at in sorted(part)]


@lru_cache(maxsize=1)
def transducer_of(data: bytes, most_kept: int = MOST_KEPT) -> PieceTransducer:
    """A worker process's transducer; what it keeps lasts over tasks."""
    return PieceTransducer(model_of(data), most_kept)


class _Encode:
    def __init__(self, data: bytes, most_kept: int):
        self.data, self.most_kept = data, most_kept

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = transducer_of(self.data, self.most_kept)
        model = transducer.model
        for batch in batches:
            ids, offsets, same = array("i"), [0], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                found = transducer.encode(text)
                ids.extend(found)
                offsets.append(len(ids))
                wanted = transducer.normaliser(text).replace(SPACE, " ")
                same.append(model.decode(found) == (wanted[1:] if model.dummy_prefix else wanted))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(memoryview(ids), pa.int32()) if ids else pa.array([], pa.int32()))
            columns = [batch.column("doc_id"), lists, pa.array([b - a for a, b in zip(offsets, offsets[1:], strict=False)], pa.int64()), pa.array(same)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece_ids", "n_pieces", "restored"])


def encode_documents(docs: DataFrame, model_path: str = MODEL_PATH, most_kept: int = MOST_KEPT) -> DataFrame:
    """(doc_id, piece_ids, n_pieces, restored) for every row of docs (doc_id, text).

    piece_ids is the encoding of the whole text by the model file, without control pieces; restored
    tells whether decoding them gives the normalised text again. Null and empty texts have no
    pieces and are restored. Visible-space characters of a text decode as spaces. Repeated rows and
    null ids stay. Other columns are not read. An empty table gives an empty one. most_kept bounds what
    a worker remembers of earlier texts, which changes its time and memory, never a result.
    """
    arrow_rows(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_Encode(read_model(model_path), most_kept), f"doc_id {kind}, piece_ids array<int>, n_pieces bigint, restored boolean")


def decode_pieces(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, text) for every row of encoded (doc_id, piece_ids); a null list has a null text.

    Repeated rows and null ids stay; an empty table gives an empty one. Other columns are not read.
    """
    arrow_rows(encoded.sparkSession)
    data = read_model(model_path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(data)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch.column("piece_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "piece_ids").mapInArrow(decoded, f"doc_id {kind}, text string")
