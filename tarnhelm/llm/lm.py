"""Language-model scoring by a weighted backoff automaton.

Counting. Texts are cut into blocks (whole documents, about ``BLOCK_BYTES``), each stored once in shared storage as word
numbers and the block's own vocabulary, in a table bucketed by block. Words, pairs and triples are 64-bit hashes. A block sends its
distinct hashes with their counts to the ranges of hashes; a range adds up the counts of all blocks and sends each block the
sums of its own. So exact counts of all n-grams reach every document without any table of them in one place, and no n-gram
is hot, as a block sends it once. Words go first, then pairs of words seen ``LEAST`` times, then triples of pairs seen so.

Model. States are the empty context, all words, and pairs of words that begin a kept triple. A pair or triple is an arc if
it is seen ``LEAST`` times or more in training texts, whatever the size of the corpus. An arc has the discounted probability
(c - discount) / c(context); a state's failure arc goes to the context without its first word, with the weight that makes the
state's probabilities sum to one. At the empty context, any word w has (c(w) + 1) / (N + V + 1), an unknown word included.
The automaton is in no place as a whole: the sums behind failure weights are exchanged in the same way, each arc counted in the first
block that has it, and a block builds the part of the automaton that its own texts walk.

Scoring. One left-to-right traversal carries the state: while it has no arc for the word, take the failure arc and add
its weight; then take the arc. A block knows the pair and the triple that end at each token, so an arc is found by place, not
searched. Long texts are traversed in pieces side by side; a piece begins two tokens early
without adding, which brings it to the state of the whole traversal, since a state holds two words at most.

Defined cases: a null text is an empty one, which is the end token alone. A null doc_id is hashed as an empty string,
so it is a training document. Repeated rows each count and each return a row. An empty table gives an empty result.
Extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import bucketed, pieces, written

#: The hashes that stand for the end of a text and for what is before its first word.
END, BEGIN = 0x1234567890ABCDEF, 0x0FEDCBA987654321
LEAST, DISCOUNT = 2, 0.5
PIECE = 256
#: Text of a block. Larger blocks repeat fewer words.
BLOCK_BYTES = 8 << 20
#: Blocks whose hashes four ranges hold: a range is the work of one task.
RANGE_BLOCKS = 32

BLOCK = "block long, doc_ids array<long>, held array<boolean>, bounds array<int>, tokens binary, vocabulary array<long>, train array<int>, starts long, trained long"


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def numbered(x: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and which of them each is. x: from 0, less than ``below``. A number and its place are sorted as one where both fit in 63 bits."""
    place = len(x).bit_length()
    if (below - 1).bit_length() + place > 63 or not len(x):
        return np.unique(x, return_inverse=True)
    both = np.sort(x << place | np.arange(len(x)))
    value = both >> place
    new = np.concatenate([[True], value[1:] != value[:-1]])
    which = np.empty(len(x), np.int64)
    which[both & ((1 << place) - 1)] = np.cumsum(new) - 1
    return value[new], which


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get().partitionId(), 0
    for batch in pieces(batches, "text", BLOCK_BYTES):
        data, offsets = W.flat(batch["text"])
        data = np.concatenate([data])
        low = W.LOWER[data]
        start, end, bounds = W.words(low, offsets, W.NOT_WHITE)
        # An end token after each text's words.
        docs = batch.num_rows
        at = bounds + np.arange(docs + 1)
        h = np.full(int(at[-1]), END, W.U)
        place = np.arange(len(start)) + np.repeat(np.arange(docs), np.diff(bounds))
        h[place] = W.hashes(low, start, end)
        vocabulary, tokens, counts = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which compress well
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        vocabulary, tokens = vocabulary[order], rank[tokens]
        held = batch["held"].to_numpy(zero_copy_only=False)
        train = np.bincount(tokens[~np.repeat(held, np.diff(at))], minlength=len(vocabulary))
        row = [(task << 33) + n, batch["doc_id"].to_pylist(), held.tolist(), at, pa.compress(tokens.tobytes(), "zstd", asbytes=True), signed(vocabulary), train, int((~held).sum()), int(train.sum())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], k) for x, k in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64()), strict=True)],
            [x.split()[0] for x in BLOCK.split(", ")],
        )
        n += 1


def _tokens_of(block: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, tokens) of a block, without Python objects for their values."""
    at = block["bounds"][i].values.to_numpy().astype(np.int64)
    raw = pa.decompress(block["tokens"][i].as_buffer(), int(at[-1]) * 4, "zstd")
    return at, np.frombuffer(raw, np.uint32)


def blocks_of(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, held. A table in buckets by block: what comes back to a block goes to its bucket, and the blocks are never shuffled."""
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held").mapInArrow(_blocks, BLOCK)
    return bucketed(made, "blocks", 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block")


class Model:
    """The automaton: words and arcs as arrays, failure targets and weights by state. As a whole it has its arcs sorted by state and word; a part has them in the order given."""

    def __init__(self, tokens: int, distinct: int, words: dict[int, int], starts: int, pairs: dict[tuple[int, int], int], triples: dict[tuple[int, int, int], int], discount: float):
        """words: of the states, without BEGIN. pairs and triples: by the words' numbers, BEGIN is 1."""
        self.total = float(tokens + distinct + 1)
        self.hashes = np.sort(np.array(list(words), np.int64).view(W.U))
        self.size = len(self.hashes) + 2  # numbers: 0 is any other word, 1 is BEGIN, then the words by hash
        count = {1: starts} | {i + 2: words[x] for i, x in enumerate(self.hashes.view(np.int64).tolist())}
        contexts = sorted({t[:2] for t in triples})
        state = {(): 0} | {(w,): w for w in count} | {c: self.size + i for i, c in enumerate(contexts)}
        self.fail = np.zeros(self.size + len(contexts), np.int64)
        self.weight = np.zeros(len(self.fail))
        for c in contexts:
            self.fail[state[c]] = c[1]
        one = lambda w: (count[w] + 1) / self.total  # noqa: E731  at the empty context
        arcs: dict[tuple[tuple[int, ...], int], float] = {}
        for level, mother in ((pairs, lambda c: count[c[0]]), (triples, lambda c: pairs[c])):
            by: dict[tuple[int, ...], list[tuple[int, int]]] = {}
            for gram, n in level.items():
                by.setdefault(gram[:-1], []).append((gram[-1], n))
            for context, after in by.items():
                mass = lower = 0.0
                for w, n in after:
                    p = (n - discount) / mother(context)
                    arcs[context, w] = p
                    mass += p
                    lower += self._below(arcs, context[1:], w, one, state)
                self.weight[state[context]] = np.log10(max(1 - mass, 1e-12) / max(1 - lower, 1e-12))
        keys = np.array([state[c] * self.size + w for c, w in arcs], np.int64)
        order = np.argsort(keys)
        to = [state.get((*c, w)[-2:], w) for c, w in arcs]
        self.keys, self.to, self.log = keys[order], np.array(to, np.int64)[order], np.log10(np.array(list(arcs.values())))[order]

    def _below(self, arcs, context, w, one, state) -> float:
        if (context, w) in arcs:
            return arcs[context, w]
        return 10 ** self.weight[state[context]] * self._below(arcs, context[1:], w, one, state) if context else one(w)

    @classmethod
    def part(cls, words: np.ndarray, pairs: np.ndarray, pair_logs: np.ndarray, contexts: np.ndarray, weights: np.ndarray, triples: np.ndarray, triple_logs: np.ndarray) -> Model:
        """What a text needs of the automaton. words: failure weights by number; pairs (a, b) of words and triples (pair, pair) by place; contexts: places of pairs, with their ``weights``. The arcs are those of pairs that have a log, then those of triples."""
        model = cls.__new__(cls)
        model.size = len(words)
        state = np.full(len(pairs), -1, np.int64)
        state[contexts] = model.size + np.arange(len(contexts))
        after = np.where(state >= 0, state, pairs[:, 1])
        model.fail = np.concatenate([np.zeros(model.size, np.int64), pairs[contexts, 1]])
        model.weight = np.concatenate([words, weights])
        has = np.flatnonzero(~np.isnan(pair_logs))
        model.to = np.concatenate([after[has], after[triples[:, 1]]])
        model.log = np.concatenate([pair_logs[has], triple_logs])
        return model

    def _arcs(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The state's arc for the word, or -1, by search."""
        if not len(self.keys):
            return np.full(len(state), -1)
        key = state * self.size + word
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[k] == key) & (word > 0), k, -1)

    def traverse(self, w: np.ndarray, base: np.ndarray, bounds: np.ndarray, near: np.ndarray | None = None, far: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each token. w: the words' numbers; base: their log10 probability at the empty context. near, far: for each token the arc that leads to it
        from the word before it and from the two before, -1 if there is none; without them arcs are searched."""
        length = np.diff(bounds)
        n_pieces = -(-length // PIECE)
        text = np.repeat(np.arange(len(length)), n_pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        begin, out = bounds[:-1][text] + nth * PIECE, np.zeros(len(w))
        stop = np.minimum(begin + PIECE, bounds[1:][text])
        at = np.where(nth > 0, begin - 2, begin)  # PIECE is over 2
        state = np.where(nth > 0, 0, min(1, self.size - 1))
        longest = np.argsort(at - stop, kind="stable")
        begin, stop, at, state = begin[longest], stop[longest], at[longest], state[longest]
        while len(at):
            word, gain = w[at], np.zeros(len(at))
            going = np.arange(len(at))
            while len(going):
                s = state[going]
                arc = self._arcs(s, word[going]) if near is None else np.where(s < self.size, np.where(s > 0, near[at[going]], -1), far[at[going]])
                found = arc >= 0
                hit, arc = going[found], arc[found]
                gain[hit] += self.log[arc]
                state[hit] = self.to[arc]
                root = ~found & (s == 0)
                hit = going[root]
                gain[hit] += base[at[hit]]
                state[hit] = word[hit]
                going = going[~found & ~root]
                gain[going] += self.weight[state[going]]
                state[going] = self.fail[state[going]]
            counted = at >= begin
            out[at[counted]] = gain[counted]
            at += 1
            live = int(np.searchsorted(at - stop >= 0, True)) if (at - stop >= 0).any() else len(at)
            begin, stop, at, state = begin[:live], stop[:live], at[:live], state[:live]
        return out


#: What a block sends to each range of hashes: its hashes there in order, as differences, and ``columns`` numbers for each.
SENT = "range int, block long, n int, hashes binary, numbers binary"
#: What it gets back: the sums over all blocks. new: how many hashes with a sum have this block as their first.
BACK = "block long, kind int, range int, n int, numbers binary, new long"
#: Kinds of exchange: counts of words, of pairs, of triples; what is kept after a context (how many, their counts, what they have at the shorter context).
WORD, PAIR, TRIPLE, CONTEXT = range(4)
COLUMNS = {WORD: 1, PAIR: 1, TRIPLE: 1, CONTEXT: 3}


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers, byte planes compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<u8").reshape(-1).view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpacked(raw: pa.BinaryScalar, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw.as_buffer(), 8 * n, "zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def _table(schema: str, *columns) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    n = max((len(c) for c in columns if hasattr(c, "__len__")), default=0)
    return pa.table([pa.array(c if hasattr(c, "__len__") else np.full(n, c), kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _sent(block: int, hashes: np.ndarray, numbers: np.ndarray, ranges: int) -> pa.Table:
    """hashes: distinct, any order; numbers: columns x hashes."""
    order = np.argsort(hashes)
    hashes, numbers = hashes[order], numbers[:, order]
    which = (hashes >> W.U(32)) * W.U(ranges) >> W.U(32)
    cut = np.append(np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]])) if len(which) else [], len(which)).astype(np.int64)
    each = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    return _table(SENT, which[cut[:-1]].astype(np.int32), block, np.diff(cut).astype(np.int32), [packed(np.diff(hashes[a:b], prepend=W.U(0))) for a, b in each], [packed(numbers[:, a:b]) for a, b in each])


def _summed(kind: int, least: int):
    """All rows of a range: each block's hashes with their sums over the blocks, 0 if under ``least``; the first number also says, in its lowest bit, whether the block is the hash's first."""
    columns = COLUMNS[kind]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by("block")
        n = rows["n"].to_numpy().astype(np.int64)
        hashes = np.concatenate([np.cumsum(unpacked(x, k), dtype=W.U) for x, k in zip(rows["hashes"], n.tolist(), strict=True)])
        numbers = np.concatenate([unpacked(x, columns * k).reshape(columns, k) for x, k in zip(rows["numbers"], n.tolist(), strict=True)], axis=1)
        order = np.argsort(hashes, kind="stable")
        new = np.concatenate([[True], np.diff(hashes[order]) != 0])
        total = np.add.reduceat(numbers[:, order], np.flatnonzero(new), axis=1)
        total[:, total[0] < least] = 0
        out = np.empty_like(numbers)
        out[:, order] = total[:, np.cumsum(new) - 1] * np.array([[2], *[[1]] * (columns - 1)], W.U)
        first = np.zeros(len(hashes), bool)
        first[order] = new
        first &= out[0] > 0
        out[0] += first
        at = np.concatenate([[0], np.cumsum(n)])
        each = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        return _table(BACK, rows["block"].to_numpy(), kind, rows["range"].to_numpy(), n.astype(np.int32), [packed(out[:, a:b]) for a, b in each], [int(first[a:b].sum()) for a, b in each])

    return run


def exchanged(sent: DataFrame, kind: int, least: int) -> DataFrame:
    return written(sent.groupBy("range").applyInArrow(_summed(kind, least), BACK), "back")


class Facts:
    """Numbers of the corpus that all tasks need."""

    def __init__(self, starts: int, tokens: int, distinct: int, least: int, discount: float, ranges: int):
        self.starts, self.tokens, self.least, self.discount, self.ranges = starts, tokens, least, discount, ranges
        self.total = float(tokens + distinct + 1)


class _Block:
    """A block's texts with what has come back: its words by number (0 is any other, 1 is BEGIN), its distinct pairs and triples."""

    def __init__(self, block: pa.Table, back: pa.Table, facts: Facts):
        row = block.combine_chunks().to_batches()[0]
        self.id, self.row, self.facts = row["block"][0].as_py(), row, facts
        self.kind, self.range, self.n = (back[c].to_numpy() for c in ("kind", "range", "n"))
        self.numbers = back["numbers"]
        self.at, tokens = _tokens_of(row, 0)
        words = row["vocabulary"][0].values.to_numpy().view(W.U)
        self.hashes = np.concatenate([np.array([0, BEGIN], W.U), words])
        self.tokens = tokens.astype(np.int64) + 2
        self.count = np.concatenate([[0, facts.starts], self.returned(WORD, words)[0] >> W.U(1)]).astype(np.int64)
        docs = len(self.at) - 1
        text = np.repeat(np.arange(docs), np.diff(self.at) + 1)
        both = np.full(len(text), 1, np.int64)  # BEGIN before each text
        both[np.arange(len(tokens)) + np.repeat(np.arange(docs), np.diff(self.at)) + 1] = self.tokens
        self.train, self.text = ~row["held"][0].values.to_numpy(zero_copy_only=False)[text], text
        size = len(self.hashes)
        often = self.count >= facts.least
        inside = np.flatnonzero((text[:-1] == text[1:]) & often[both[:-1]] & often[both[1:]])
        found, which = numbered(both[inside] * size + both[inside + 1], size * size)
        self.pairs = np.stack([found // size, found % size], axis=1)
        self.pair_train = np.bincount(which[self.train[inside]], minlength=len(found))
        self.pair_keys = W.mix(W.mix(self.hashes[self.pairs[:, 0]] ^ W.U(0xA0761D6478BD642F)) + self.hashes[self.pairs[:, 1]])
        self.pair_at = np.full(len(text), -1, np.int64)
        self.pair_at[inside] = which

    def returned(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        """What has come back for the hashes that the block has sent."""
        mine = np.flatnonzero(self.kind == kind)
        parts = [unpacked(self.numbers[i], COLUMNS[kind] * int(self.n[i])).reshape(COLUMNS[kind], -1) for i in mine[np.argsort(self.range[mine])].tolist()]
        out = np.zeros((COLUMNS[kind], len(hashes)), W.U)
        if parts:
            out[:, np.argsort(hashes)] = np.concatenate(parts, axis=1)
        return out

    def read_pairs(self) -> None:
        """After the counts of pairs are back: the triples whose pairs are both kept."""
        got = self.returned(PAIR, self.pair_keys)[0]
        self.pair_count, self.pair_first = (got >> W.U(1)).astype(np.int64), (got & W.U(1)) > 0
        kept = np.append(self.pair_count > 0, False)
        first, second = self.pair_at[:-1], self.pair_at[1:]
        inside = np.flatnonzero(kept[first] & kept[second] & (self.text[:-1] == self.text[1:]))
        n = max(len(self.pairs), 1)
        found, which = numbered(first[inside] * n + second[inside], n * n)
        self.triples = np.stack([found // n, found % n], axis=1)
        self.triple_at = np.full(len(self.text), -1, np.int64)
        self.triple_at[inside] = which
        self.triple_train = np.bincount(which[self.train[inside]], minlength=len(found))
        self.triple_keys = W.mix(W.mix(self.pair_keys[self.triples[:, 0]] ^ W.U(0xE7037ED1A0B428DB)) + self.hashes[self.pairs[self.triples[:, 1], 1]])

    def read_triples(self) -> None:
        """After the counts of triples are back: the words and pairs that may be contexts, by arcs of this block or of others."""
        got = self.returned(TRIPLE, self.triple_keys)[0]
        self.triple_count, self.triple_first = (got >> W.U(1)).astype(np.int64), (got & W.U(1)) > 0
        self.arcs, self.long_arcs = np.flatnonzero(self.pair_count > 0), np.flatnonzero(self.triple_count > 0)
        self.word_contexts, self.pair_contexts = np.flatnonzero(self.count >= self.facts.least), self.arcs
        self.context_keys = np.concatenate([self.hashes[self.word_contexts], self.pair_keys[self.pair_contexts]])

    def own_contexts(self) -> np.ndarray:
        """Of each context: how many arcs has it whose first block is this one, the sum of their counts, and of the counts of their shorter arcs."""

        def sums(context: np.ndarray, contexts: np.ndarray, count: np.ndarray, lower: np.ndarray) -> np.ndarray:
            at = np.searchsorted(contexts, context)
            return np.stack([np.bincount(at, x, minlength=len(contexts)) for x in (np.ones(len(at)), count, lower)])

        a, b = self.arcs[self.pair_first[self.arcs]], self.long_arcs[self.triple_first[self.long_arcs]]
        words = sums(self.pairs[a, 0], self.word_contexts, self.pair_count[a], self.count[self.pairs[a, 1]] + 1)
        pairs = sums(self.triples[b, 0], self.pair_contexts, self.triple_count[b], self.pair_count[self.triples[b, 1]])
        return np.concatenate([words, pairs], axis=1).astype(W.U)

    def token_arcs(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each token, the model's arcs to it from the word before it and from the two before, -1 if there is none: the block knows the pair and the triple at each place."""

        def at(place: np.ndarray, kept: np.ndarray, grams: np.ndarray, begin: int) -> np.ndarray:
            arc = np.full(len(grams) + 1, -1, np.int32)
            arc[kept] = begin + np.arange(len(kept), dtype=np.int32)
            return arc[place]

        # With BEGIN before each text, a token's pair begins one place before it and its triple two.
        place = np.arange(len(self.tokens)) + np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        return at(self.pair_at[place], self.arcs, self.pairs, 0), at(self.triple_at[place - 1], self.long_arcs, self.triples, len(self.arcs))

    def model(self) -> Model:
        """The part of the automaton that the block's texts walk. A failure weight is what is left of the context's mass, over what its arcs leave at the shorter context."""
        facts = self.facts
        got = self.returned(CONTEXT, self.context_keys)
        arcs, counts, lower = (x.astype(np.float64) for x in (got[0] >> W.U(1), got[1], got[2]))
        n = len(self.word_contexts)
        of = np.concatenate([self.count[self.word_contexts], self.pair_count[self.pair_contexts]])
        middle = np.concatenate([np.full(n, facts.total), self.count[self.pairs[self.pair_contexts, 1]]])
        cut = np.where(np.arange(len(of)) < n, 0.0, facts.discount)  # a word's probability at the empty context is not discounted
        rest = lambda x: np.maximum(1 - x, 1e-12)
        weight = np.log10(rest((counts - facts.discount * arcs) / of) / rest((lower - cut * arcs) / middle))
        words = np.zeros(len(self.hashes))
        words[self.word_contexts] = weight[:n]
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.where(self.pair_count > 0, np.log10((self.pair_count - facts.discount) / self.count[self.pairs[:, 0]]), np.nan)
        triples, some = self.triples[self.long_arcs], arcs[n:] > 0
        return Model.part(words, self.pairs, logs, self.pair_contexts[some], weight[n:][some], triples, np.log10((self.triple_count[self.long_arcs] - facts.discount) / self.pair_count[triples[:, 0]]))


def _words(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, n = batch["vocabulary"][i].values.to_numpy().view(W.U), batch["train"][i].values.to_numpy()
                yield from _sent(batch["block"][i].as_py(), words, n[None].astype(W.U), ranges).to_batches()

    return run


def _pairs(facts: Facts):
    def run(block: pa.Table, back: pa.Table) -> pa.Table:
        b = _Block(block, back, facts)
        return _sent(b.id, b.pair_keys, b.pair_train[None].astype(W.U), facts.ranges)

    return run


def _triples(facts: Facts):
    def run(block: pa.Table, back: pa.Table) -> pa.Table:
        b = _Block(block, back, facts)
        b.read_pairs()
        return _sent(b.id, b.triple_keys, b.triple_train[None].astype(W.U), facts.ranges)

    return run


def _contexts(facts: Facts):
    def run(block: pa.Table, back: pa.Table) -> pa.Table:
        b = _Block(block, back, facts)
        b.read_pairs()
        b.read_triples()
        return _sent(b.id, b.context_keys, b.own_contexts(), facts.ranges)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(facts: Facts):
    def run(block: pa.Table, back: pa.Table) -> pa.Table:
        b = _Block(block, back, facts)
        b.read_pairs()
        b.read_triples()
        at, model = b.at, b.model()
        base = np.log10((b.count + 1) / facts.total)[b.tokens]
        logs = model.traverse(b.tokens, base, at, *b.token_arcs())
        add = lambda x: np.add.reduceat(x, at[:-1]) if len(at) > 1 else np.zeros(0, x.dtype)  # noqa: E731  every text has its end token
        return _table(SCORES, b.row["doc_ids"][0].values, b.row["held"][0].values, np.diff(at), add((b.count > 0)[b.tokens].astype(np.int64)), facts.tokens, add(base), add(logs))

    return run


def score(docs: DataFrame, held, least: int = LEAST, discount: float = DISCOUNT) -> DataFrame:
    """Scores of all ``docs`` under the model of those for which the column ``held`` is false."""
    spark = docs.sparkSession
    blocks = blocks_of(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held")))
    n, starts, tokens = blocks.agg(F.count("*"), F.coalesce(F.sum("starts"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0))).first()
    ranges = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / RANGE_BLOCKS))
    back = exchanged(blocks.select("block", "vocabulary", "train").mapInArrow(_words(ranges), SENT), WORD, 0)
    distinct = back.agg(F.coalesce(F.sum("new"), F.lit(0))).first()[0]
    facts = Facts(starts, tokens, distinct, least, discount, ranges)
    texts = blocks.drop("train", "starts", "trained")

    def met(run, schema: str) -> DataFrame:
        return texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, schema)

    for kind, run, lowest in ((PAIR, _pairs, least), (TRIPLE, _triples, least), (CONTEXT, _contexts, 0)):
        back = back.union(exchanged(met(run(facts), SENT), kind, lowest))
    return met(_scorer(facts), SCORES)


def held_out(doc_id):
    """crc32 of the id as text, modulo 7, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2

