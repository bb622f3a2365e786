"""SentencePiece encoding and decoding by shared-prefix dynamic programming."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words kept from batch to batch in one task; beyond it those not met since the last time it was reached are dropped.
KEPT_WORDS = 150_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores, as plain values that travel to the tasks; halves are the two pieces whose merge makes a piece."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    special: frozenset[int]
    bytes_at: tuple[int, ...]

    @cached_property
    def ids(self) -> dict[str, int]:
        skip = self.special | set(self.bytes_at)
        return {p: i for i, p in enumerate(self.pieces) if i not in skip}

    @cached_property
    def heads(self) -> set[str]:
        """Whatever a piece may begin with."""
        return {p[:i] for p in self.ids if p.strip(SPACE) for i in range(1, len(p) + 1)}

    @cached_property
    def rank(self) -> dict[str, int]:
        """Order in which merges are made; single characters come before all."""
        order = sorted((-self.scores[i], i, p) for p, i in self.ids.items() if len(p) > 1)
        return {p: n + 1 for n, (_, _, p) in enumerate(order)}

    @cached_property
    def halves(self) -> dict[str, tuple[str, str]]:
        """The last merge of each piece; pieces that merging never leaves whole have none."""
        out: dict[str, tuple[str, str]] = {}
        for p in self.rank:
            if p.strip(SPACE) and (steps := merges(self, p)) and steps[-1][0] + steps[-1][1] == p:
                out[p] = steps[-1]
        return out

    @cached_property
    def encoder(self) -> Encoder:
        """One per process, so that tasks of one worker share the words already met."""
        return Encoder(self)


def load(path: str = MODEL) -> Vocabulary:
    """Read a model file on the driver; tasks get the values, not the path."""
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(m.vocab_size())
    at = {m.id_to_piece(i): i for i in n if m.is_byte(i)}
    return Vocabulary(tuple(m.id_to_piece(i) for i in n), tuple(m.get_score(i) for i in n), frozenset(i for i in n if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)), tuple(at[f"<0x{b:02X}>"] for b in range(256)))


def merges(vocab: Vocabulary, text: str, left_over: list[str] | None = None) -> list[tuple[str, str]]:
    """The merges made in ``text``, in order: always the best-scored neighbours first, the leftmost of equals."""
    parts: list[str | None] = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    queue: list[tuple[float, int, str]] = []
    made = []

    def offer(i: int) -> None:
        j = after[i] if 0 <= i < len(parts) else len(parts)
        if i >= 0 and j < len(parts) and (k := vocab.ids.get(parts[i] + parts[j])) is not None:
            heapq.heappush(queue, (-vocab.scores[k], i, parts[i] + parts[j]))

    for i in range(len(parts)):
        offer(i)
    while queue:
        _, i, both = heapq.heappop(queue)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != both:
            continue
        made.append((parts[i], parts[j]))
        parts[i], parts[j], after[i] = both, None, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    if left_over is not None:
        left_over += [p for p in parts if p is not None]
    return made


class Encoder:
    """Encodes distinct marked words in sorted order, going depth-first through their common trie.

    The forward state of a prefix is the last piece of its own encoding (a prefix has exactly one) and where that piece begins. It depends on the prefix alone,
    so a word takes over the states of the prefix it shares with the word before and only works on the rest: a piece may end a prefix if greedy merging leaves it whole beside the
    last piece of the prefix before it. This reproduces the model's merges exactly.
    """

    def __init__(self, vocab: Vocabulary, keep: int = KEPT_WORDS) -> None:
        self.vocab, self.keep = vocab, keep
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.beside: dict[tuple[str, str], bool] = {}
        self.goto: dict[str, tuple[str, tuple[tuple[int, str], ...]]] = {}
        self.coded: dict[str, bytes] = {}
        self.runs: dict[int, bytes] = {}
        self.torn: set[str] = set()
        self.wrong: set[str] = set()
        at = {i: bytes([b]) for b, i in enumerate(vocab.bytes_at)}
        self.spelled = [at[i] if i in at else b"" if i in vocab.special else p.replace(SPACE, " ").encode() for i, p in enumerate(vocab.pieces)]
        self.is_byte = np.zeros(len(vocab.pieces), dtype=bool)
        self.is_byte[list(vocab.bytes_at)] = True

    def _next(self, key: str) -> tuple[str, tuple[tuple[int, str], ...]]:
        """After reading ``key`` (a state and one more character): the longest end of it that some piece begins with, and the pieces it ends with, longest first."""
        ends = [key[i:] for i in range(len(key))]
        fits = tuple((len(e), e) for e in ends if e in self.vocab.ids or len(e) == 1)
        found = self.goto[key] = next((e for e in ends if e in self.vocab.heads), ""), fits
        return found

    def _stay(self, left: str, right: str) -> bool:
        """Whether merging leaves two neighbouring pieces as they are. Undo their merges, latest first: at each moment the pieces that touch
        must not have had a merge of their own that came before the one undone."""
        rank, halves = self.vocab.rank, self.vocab.halves
        if len(right) > 1 and right not in halves:
            return False
        if not left:
            return True
        if len(left) > 1 and left not in halves:
            return False
        limit = 1 << 60
        while True:
            both = rank.get(left + right)
            if both is not None and both < limit:
                return False
            a, b = rank.get(left, 0) if len(left) > 1 else 0, rank.get(right, 0) if len(right) > 1 else 0
            if not a and not b:
                return True
            if a > b:
                limit, left = a, halves[left][1]
            else:
                limit, right = b + 1, halves[right][0]

    def _code(self, piece: str) -> bytes:
        """A piece's ids; whether decoding them gives it back is tried here, once a piece."""
        i = self.vocab.ids.get(piece)
        ids = [i] if i is not None else [self.vocab.bytes_at[b] for b in piece.encode()]
        if b"".join(map(self.spelled.__getitem__, ids)) != piece.replace(SPACE, " ").encode():
            self.torn.add(piece)
        found = self.coded[piece] = np.array(ids, dtype=np.int32).tobytes()
        return found

    def _ids(self, pieces: list[str]) -> bytes:
        coded = self.coded
        return b"".join([coded.get(p) or self._code(p) for p in pieces])

    def _run(self, n: int) -> bytes:
        if n not in self.runs:
            left: list[str] = []
            merges(self.vocab, SPACE * n, left)
            self.runs[n] = self._ids(left)
        return self.runs[n]

    def learn(self, words: list[str]) -> None:
        """Encode ``words`` (sorted, distinct, one leading mark each)."""
        beside, goto, stay = self.beside, self.goto, self._stay
        if len(beside) > 2 * self.keep:
            beside.clear()
        if len(goto) > 2 * self.keep:
            goto.clear()
        last: list[str] = [""]
        states = [""]
        word = ""
        for new in words:
            shared = 0
            for x, y in zip(word, new):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            word, state = new, states[shared]
            for end in range(shared + 1, len(word) + 1):
                key = state + word[end - 1]
                state, fits = goto.get(key) or self._next(key)
                states.append(state)
                for size, piece in fits:
                    pair = (last[end - size], piece)
                    ok = beside.get(pair)
                    if ok is None:
                        ok = beside[pair] = stay(*pair)
                    if ok:
                        last.append(piece)
                        break
            pieces, end = [], len(word)
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            pieces.reverse()
            self.words[word[1:]] = self._ids(pieces)
            if self.torn and not self.torn.isdisjoint(pieces):
                self.wrong.add(word[1:])

    def _spaced(self, words: list[str]) -> bytes:
        """Ids of words that runs of marks part: ``words`` has an empty string for every mark beyond the first."""
        alone = np.int32(self.vocab.ids[SPACE]).tobytes()
        out, marks = [], 0
        for w in words:
            marks += 1
            if w:
                own = self.words[w]
                if marks > 1 and own[:4] == alone:  # the word keeps off its mark, which then joins the run before it
                    out += [self._run(marks), own[4:]]
                else:
                    out += [self._run(marks - 1), own] if marks > 1 else [own]
                marks = 0
        return b"".join([*out, self._run(marks)] if marks else out)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Piece ids of whole texts; a null or empty text has none."""
        return [ids for ids, _ in self.encode_and_check(texts)]

    def encode_and_check(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool]]:
        """Piece ids of whole texts, and whether decoding gives each text back. A text is given back exactly if each of its words is, and a word if each of its pieces is, which is
        tried once a piece; texts with runs of spaces, or with the mark itself, are decoded whole."""
        split = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts]
        if len(self.words) > self.keep:
            self.older, self.words = self.words, {}
        fresh = set().union(*split).difference(self.words)
        fresh.discard("")
        if self.older:
            again = fresh.intersection(self.older)
            self.words.update((w, self.older[w]) for w in again)
            fresh -= again
        self.learn(sorted([SPACE + w for w in fresh]))
        known, out = self.words.__getitem__, []
        for text, x in zip(texts, split):
            ids = np.frombuffer(self._spaced(x) if "" in x else b"".join(map(known, x)), dtype=np.int32)
            plain = text and "" not in x and SPACE not in text
            out.append((ids, self.wrong.isdisjoint(x) if plain else self.decode(ids) == (text or "")))
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of piece ids: byte pieces are joined as UTF-8 (wrong ones become U+FFFD), marks become spaces, the first one is dropped."""
        text = b"".join(map(self.spelled.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, n_bytes, round_trip) for every row of ``docs``: the piece ids of the whole text, how many of them are byte pieces, and whether decoding
    gives the text back. That fails only for texts that hold the mark U+2581 itself, which the model cannot tell from a space. Null and empty texts have no
    ids and count as returned; repeated rows each get a row; an empty table gives none."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = sent.value.encoder
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                texts = part.column(1).to_pylist()
                ids, back = map(list, zip(*encoder.encode_and_check(texts)))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                low = np.concatenate(([0], np.cumsum(encoder.is_byte[np.concatenate(ids)]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(np.diff(ends)), pa.array(np.diff(low[ends])), pa.array(back)],
                    names=["doc_id", "ids", "n_tokens", "n_bytes", "round_trip"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, n_bytes int, round_trip boolean")


def decode(encoded: DataFrame, vocab: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column text, decoded from its ids; null ids give the empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocab)

    @F.pandas_udf("string")
    def text(ids):
        encoder = sent.value.encoder
        return ids.map(lambda x: "" if x is None else encoder.decode(np.asarray(x)))

    return encoded.withColumn("text", text(F.col(ids_col)))
