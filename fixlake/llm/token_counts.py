"""Token counts under a unigram model, by dynamic programming on a trie of pre-tokens.

The model gives each token of a public vocabulary the probability that Zipf's law gives its rank, 1 / ((rank + 1) H): merge
ranks are in order of frequency. The count of a pre-token is the number of tokens in its likeliest segmentation, and in the
shortest one if several are as likely. Log-probabilities are whole micronats, so sums are exact and ties are well defined.

Distinct pre-tokens go into a trie; a node's forward score - the best score and count of the prefix that it stands for - is
computed once, when the node is made, from the scores of the nodes above it, so pre-tokens that share a prefix share its work.
A text's count is the sum of its pre-tokens' terminal counts. Only the first `DEPTH` bytes of a pre-token make nodes, as longer prefixes are hardly shared; its further
scores are computed in the same way, from those of the last bytes, as many as the longest token has, which are all that is kept.

Defined cases: a null or empty text has count 0; rows are independent; an empty table gives an empty result; other columns
are ignored. Every single byte is in the vocabulary, so each text has a segmentation.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import public_tokenizers
import regex
from pyspark.sql import DataFrame

from fixlake.llm.bpe import ASCII_PATTERN, CHUNK, VOCABULARY, read_ranks
from fixlake.llm.common import per_row

#: Nodes in a task's trie; a full trie is begun anew, which costs time only.
NODES = 1_000_000
DEPTH = 128
#: A score holds micronats above and the number of tokens in the bits below.
_COUNT = 32


def costs_of(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Micronats of each token."""
    total = math.log(sum(1 / (rank + 1) for rank in ranks.values()))
    return {token: round(1e6 * (math.log(rank + 1) + total)) for token, rank in ranks.items()}


class UnigramTrie:
    def __init__(self, costs: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, nodes: int = NODES):
        self.costs, self.nodes = costs, nodes
        self.steps = {token: cost << _COUNT | 1 for token, cost in costs.items()}
        self.source, self.pattern = pattern, regex.compile(pattern)
        self.longest = max(map(len, costs))
        #: Which lengths the tokens that end in a byte have.
        by_end: dict[int, set[int]] = {}
        for token in costs:
            by_end.setdefault(token[-1], set()).add(len(token))
        self.lengths = {end: sorted(found) for end, found in by_end.items()}
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}  # by a node's number and the next byte
        self.best: list[int] = [0]
        self.counts: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return {"costs": self.costs, "pattern": self.source, "nodes": self.nodes}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def insert(self, piece: bytes) -> int:
        """Walk down the trie, make the nodes that are missing, and return the count at the end."""
        children, best, steps = self.children, self.best, self.steps
        node, path = 0, [0]
        for depth, byte in enumerate(piece, 1):
            on = children.get(node << 8 | byte)
            if on is None:
                score = min(
                    path[-length] + step for length in self.lengths[byte] if length <= depth and (step := steps.get(piece[depth - length : depth])) is not None
                )
                if depth <= DEPTH:
                    on = children[node << 8 | byte] = len(best)
                    best.append(score)
                else:
                    on = -1  # below all nodes
            else:
                score = best[on]
            node = on
            path.append(score)
            if len(path) > 1 << 12:
                del path[: -self.longest]
        return path[-1] & (1 << _COUNT) - 1

    def count(self, text: str | None) -> tuple[int, int]:
        """Numbers of pre-tokens and of tokens."""
        pieces, tokens = 0, 0
        pattern = ASCII_PATTERN if self.source == public_tokenizers.PATTERN and (text or "").isascii() else self.pattern
        for part in parts(pattern, text or ""):
            counts, long = self.counts, {}
            for piece in sorted({p for p in part if p not in counts}):
                if len(self.best) > self.nodes:
                    self.clear()  # this part's counts stay in `counts`
                (counts if len(piece) <= DEPTH else long)[piece] = self.insert(piece.encode())
            pieces += len(part)
            tokens += sum(counts[p] if p in counts else long[p] for p in part) if long else sum(map(counts.__getitem__, part))
        return pieces, tokens


def parts(pattern, text: str) -> Iterable[list[str]]:
    """The pre-tokens of a text, a bounded number at a time."""
    if len(text) <= 8 * CHUNK:
        yield pattern.findall(text)
        return
    part = []
    for match in pattern.finditer(text):
        part.append(match[0])
        if len(part) == CHUNK:
            yield part
            part = []
    yield part


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, n_pretokens, n_bytes, n_tokens) of each row."""
    trie = df.sparkSession.sparkContext.broadcast(UnigramTrie(costs_of(read_ranks(vocabulary or public_tokenizers.path(VOCABULARY)))))

    def row(k, t, trie):
        pieces, tokens = trie.count(t)
        return k, pieces, len((t or "").encode()), tokens

    return per_row(
        df, [key, text], row, f"{key} long, n_pretokens long, n_bytes long, n_tokens long", lambda: {"trie": trie.value}
    )
