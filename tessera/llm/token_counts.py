"""Token counts under a unigram model, by dynamic programming over a shared trie.

A text is split at white space into pre-tokens, each led by the word mark. A worker
inserts the distinct pre-tokens in one trie. The forward score of a node, the best
segmentation of its prefix, is the best over its last piece of what the node before that
piece has; it is computed once, when the node is made, so each shared prefix is scored
once for all pre-tokens. The count at the node where a pre-token ends is stored, and
documents add these.

Pieces come from a public piece vocabulary. Where its file holds merge ranks and not log
probabilities (a BPE file: all scores are whole numbers), Zipf's law makes the scores:
the piece of rank r has the log probability -log(r + 1), but for a constant. No scores
are learned. A character that no piece covers counts as its UTF-8 bytes, at a score below
all pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import ship

MARK = "▁"
#: Pre-tokens whose counts a worker keeps, and nodes of its trie; when full, each starts anew.
CACHE, NODES = 500_000, 500_000
#: Characters beyond which a pre-token is scored alone, with only the last scores kept.
LONG = 1_000
_MODELS: dict[str, "Pieces"] = {}


def by_rank(scores: dict[str, float]) -> dict[str, float]:
    """Log probabilities (but for a constant) of pieces, by Zipf's law if all scores are
    merge ranks, whole numbers of at most 0; else the scores as they are."""
    if all(s <= 0 and s == int(s) for s in scores.values()):
        return {p: -math.log1p(-s) for p, s in scores.items()}
    return scores


class Pieces:
    """Pieces and scores. Equal scores go to the segmentation with fewer tokens."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.below = min(scores.values(), default=0.0) - 10
        self.counts: dict[str, int] = {}
        self._plant()

    @classmethod
    def from_file(cls, path: str) -> "Pieces":
        if path not in _MODELS:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
            _MODELS[path] = cls(by_rank({sp.id_to_piece(i): sp.get_score(i) for i in ids}))
        return _MODELS[path]

    def _plant(self) -> None:
        """An empty trie: child by (node, character), best score and count by node."""
        self.child: dict[int, int] = {}
        self.best, self.used = [0.0], [0]

    def _forward(self, text: str, end: int, path: list[int], best: list[float], used: list[int]) -> tuple[float, int]:
        """Best score and its count for text[:end]; path[i] is where best and used have
        those of the prefix that is i characters longer than path[0]'s."""
        scores, first = self.scores, end - len(path)
        top, n = best[path[-1]] + self.below, used[path[-1]] + len(text[end - 1].encode("utf-8", "surrogatepass"))
        for start in range(max(0, end - self.longest), end):
            s = scores.get(text[start:end])
            if s is not None:
                at = path[start - first]
                s += best[at]
                if s > top or (s == top and used[at] + 1 < n):
                    top, n = s, used[at] + 1
        return top, n

    def add(self, words: set[str]) -> None:
        """Store the counts of pre-tokens (without their mark)."""
        for word in words:
            text = MARK + word
            if len(text) > LONG:
                self.counts[word] = self._alone(text)
                continue
            if len(self.best) > NODES:
                self._plant()
            child, best, used, node = self.child, self.best, self.used, 0
            path = [0]
            for end, c in enumerate(text, 1):
                edge = node << 21 | ord(c)
                node = child.get(edge)
                if node is None:
                    top, n = self._forward(text, end, path, best, used)
                    node = child[edge] = len(best)
                    best.append(top)
                    used.append(n)
                path.append(node)
            self.counts[word] = used[node]

    def _alone(self, text: str) -> int:
        """The count of a long pre-token, in memory that does not grow with it."""
        kept = self.longest + 1
        best, used = [0.0], [0]
        for end in range(1, len(text) + 1):
            top, n = self._forward(text, end, range(len(best)), best, used)
            best.append(top)
            used.append(n)
            if len(best) > 2 * kept:
                del best[:-kept], used[:-kept]
        return used[-1]

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text."""
        split = [(t or "").split() for t in texts]
        new = set().union(*split) - self.counts.keys()
        if len(self.counts) + len(new) > CACHE:
            self.counts.clear()
            new = set().union(*split)
        self.add(new)
        get = self.counts.__getitem__
        return [(len(w), sum(map(get, w))) for w in split]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words (pre-tokens), n_tokens. Null and empty texts
    have none. Repeated rows keep their rows; other columns are ignored, whatever their
    names; an empty table gives no rows. Pre-tokens of any length are taken whole."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.from_file(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                n = pieces.count(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in n], pa.int64()), pa.array([x for _, x in n], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
