"""Token counts: a longest-match automaton gives greedy word-piece lengths without building pieces.

The vocabulary's word starts and continuations form two tries. Every node has a
failure link and the number of pieces that are finished when it is followed, so
a word is counted in one pass over its characters (the linear longest-match
construction of the published "fast WordPiece" paper). A word that has no
greedy segmentation is one unknown token.

Defined cases: a null or blank text has no words and no tokens; words are
separated by white space as Python's ``str.split`` sees it; a word of any length
is read once, without a cap; the counts do not depend on other columns.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

START = "▁"  # marks a word start in the vocabulary
MEMO_WORDS, MEMO_CHARS = 200_000, 64


class Automaton:
    """Flat lists: edges by node, failure link (-1: none) and finished pieces by node."""

    def __init__(self, starts: list[str], continuations: list[str]):
        self.edges: list[dict[str, int]] = [{}, {}]  # 0: word start, 1: continuation
        ends: set[int] = set()
        for root, words in ((0, starts), (1, continuations)):
            for w in words:
                node = root
                for c in w:
                    node = self._child(node, c)
                ends.add(node)
        ends -= {0, 1}
        self.fail, self.pops = [-1] * len(self.edges), [0] * len(self.edges)
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for c, v in self.edges[u].items():
                    below.append(v)
                    if v in ends:
                        self.fail[v], self.pops[v] = 1, 1
                        continue
                    z, n = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.edges[z]:
                        n += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.edges[z][c], n
            level = below

    def _child(self, node: int, c: str) -> int:
        if c not in self.edges[node]:
            self.edges[node][c] = len(self.edges)
            self.edges.append({})
        return self.edges[node][c]

    def count(self, word: str) -> int:
        """The number of greedy pieces of a word, -1 if there is no segmentation."""
        edges, fail, pops = self.edges, self.fail, self.pops
        u = n = 0
        for c in word:
            while (v := edges[u].get(c)) is None:
                if fail[u] < 0:
                    return -1
                n += pops[u]
                u = fail[u]
            u = v
        while u != 1:
            if fail[u] < 0:
                return -1 if u else 0
            n += pops[u]
            u = fail[u]
        return n


@lru_cache(4)
def automaton(model_path: str) -> Automaton:
    """From a public piece vocabulary: pieces with the word-start mark begin words, the others continue them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    starts = [p[1:] for p in pieces if p[:1] == START and START not in p[1:] and len(p) > 1]
    return Automaton(starts, [p for p in pieces if START not in p])


class Memo(dict):
    """Counts of short words, at most MEMO_WORDS of them."""

    def __init__(self, machine: Automaton):
        self.machine = machine

    def __missing__(self, word: str) -> int:
        n = self.machine.count(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = n
        return n


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_unknown, n_tokens) for each row of ``docs(doc_id, text)``: one narrow pass, no shuffle."""

    def counted(batches):
        memo = Memo(automaton(model_path or default_model()))
        for batch in batches:
            words, unknown, tokens = [], [], []
            for text in batch["text"]:
                counts = list(map(memo.__getitem__, (text.as_py() or "").split()))
                bad = counts.count(-1)
                words.append(len(counts))
                unknown.append(bad)
                tokens.append(sum(counts) + 2 * bad)  # an unknown word is one token
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(words, pa.int64()), pa.array(unknown, pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "n_words", "n_unknown", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, n_words long, n_unknown long, n_tokens long")
