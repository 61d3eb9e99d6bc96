"""Token counts by a linear longest-match automaton over a public vocabulary."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import map_batches, words_of

START = "▁"  # marks a piece that begins a word
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Pieces that are broadcast at most: the bound on what goes to every worker.
MOST_PIECES = 1_000_000
#: Words whose counts a worker keeps at most.
MEMO = 400_000


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The text pieces of a sentencepiece vocabulary, read on the driver; control and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    if len(pieces) > MOST_PIECES:
        raise ValueError(f"more than {MOST_PIECES} pieces")
    return pieces


class Automaton:
    """Counts the pieces of greedy longest-match segmentation in time linear in the word.

    Nodes are those of a trie over the pieces. fail[v] is where matching goes on when no child fits: the node for what is left of v's
    string once its greedy pieces are popped; popped[v] counts those. So each step moves on by a character or pops pieces
    that are counted already, and no piece is ever built. A character that is no piece by itself counts as its UTF-8 bytes.
    """

    def __init__(self, pieces: list[str]):
        go: dict[tuple[int, str], int] = {}
        ends: list[bool] = [False]
        cost: list[int] = [0]  # of a node of depth 1 that is no piece
        order: list[tuple[int, int, str]] = []  # node, parent, character

        def child(v: int, c: str) -> int:
            if (w := go.get((v, c))) is None:
                go[v, c] = w = len(ends)
                ends.append(False)
                cost.append(len(c.encode("utf-8", "surrogatepass")) if v == 0 else 0)
                order.append((w, v, c))
            return w

        for p in pieces:
            for c in p:
                child(0, c)
        for p in pieces:
            v = 0
            for c in p:
                v = child(v, c)
            if p:
                ends[v] = True
        depth = {0: 0}
        for w, v, _ in order:
            depth[w] = depth[v] + 1
        fail, popped = [0] * len(ends), [0] * len(ends)
        for w, v, c in sorted(order, key=lambda x: depth[x[0]]):
            if ends[w]:
                popped[w] = 1
            elif v == 0:
                popped[w] = cost[w]
            else:
                n, z = popped[v], fail[v]
                while (z, c) not in go:  # the root has every character of the pieces, so this ends
                    n, z = n + popped[z], fail[z]
                fail[w], popped[w] = go[z, c], n
        kids: list[dict[str, int]] = [{} for _ in ends]
        for (v, c), w in go.items():
            kids[v][c] = w
        self.kids, self.fail, self.popped = kids, fail, popped

    def count(self, s: str) -> int:
        kids, fail, popped = self.kids, self.fail, self.popped
        n = v = 0
        for c in s:
            while (w := kids[v].get(c)) is None:
                if v == 0:
                    n += len(c.encode("utf-8", "surrogatepass"))
                    break
                n += popped[v]
                v = fail[v]
            else:
                v = w
        while v:
            n += popped[v]
            v = fail[v]
        return n


class _Memo(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(START + word.decode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n


_BUILT: dict[str, _Memo] = {}


def count_tokens(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, pieces: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """keep's columns (all, if None) with n_words and n_tokens of every whole text.

    A text's tokens are those of its words, each with the word-start mark before it, cut greedily into the longest pieces
    that fit; what is no piece counts as bytes. A null, empty or blank text has 0 words and 0 tokens; an empty table gives no rows;
    repeated rows stay. Columns named n_words or n_tokens that docs has already are replaced. One pass over the rows, no shuffle.
    """
    pieces = load_pieces(vocabulary) if pieces is None else pieces
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, pieces))

    def make():
        if (key := shared.value[0]) not in _BUILT:  # a worker's words stay known from task to task
            _BUILT.clear()
            _BUILT[key] = _Memo(Automaton(shared.value[1]))
        memo = _BUILT[key]

        def run(texts):
            parts = [words_of(t) for t in texts]
            return [len(p) for p in parts], [sum(map(memo.__getitem__, p)) for p in parts]

        return run

    names = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_tokens")]
    return map_batches(docs, make, [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())], [text_col], names)
