"""SentencePiece encoding and decoding by streaming Viterbi.

Method: a text is a stream of code points, spaces written as U+2581, one of them before the text. Viterbi keeps, for the
positions of a window as long as the longest piece, the best score and the backpointer. At each position it is known how far the
pieces reach that started before: where none reaches over the position, all surviving backpointer paths meet there.
Where that hasn't happened for long (CHAINS windows), the chains of the surviving positions are followed to the last boundary that all of them
share. Ids up to such a boundary are committed and leave the window, so that memory is bounded by the window and what isn't decided yet,
at any length. A code point in no piece becomes its UTF-8 bytes' pieces.

Many streams run side by side, one step of all of them at a time, as columns of numpy arrays; the pieces that start at a place
are found by steps in a hashed trie. Where no piece of the vocabulary goes over the start of a word, each word is a stream of its own, and its ids
are remembered (bounded), as the same stretch between two such boundaries always gets the same ids.

The scores are those of the vocabulary file, read as log probabilities of a unigram model: ids are those of the path with
the greatest sum. The file at hand was made for merges in order of rank; its merges may cut a word otherwise, while
both decode to the same text. Tests compare whole texts with a Viterbi over the full table, and words with the library's n-best unigram search over the same pieces.

Defined cases: null text counts as empty; an empty text has no ids and decodes to itself; U+2581 in a text is a space;
ties go to the longest last piece; ids outside the vocabulary raise ValueError; repeated rows give a row each; an empty table gives no rows;
encode() and decode() keep all other columns and replace one of the output's name.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.llm.common import load, ship

SPACE = "▁"
#: Stretches in one of the memo's two generations; code points of text whose words are looked up together.
MEMO_WORDS, PART = 150_000, 1 << 20
#: Positions times streams that run side by side at once, and positions of one block of them.
CELLS, BLOCK = 1 << 15, 64
#: Windows without a common boundary after which chains are followed.
CHAINS = 4
#: Added to the least score for a code point that no piece holds.
UNKNOWN = -10.0
STRETCH = re.compile(r"▁*[^▁]+|▁+")
#: Between a letter and a character of no word; used only where no piece holds both kinds.
EDGE = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[^\w▁])|(?<=[^\w▁])(?=[A-Za-zÀ-ÖØ-öø-ÿ])")


class Vocabulary:
    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        self.texts = [b""] * self.size  # what an id decodes to
        self.bytes = [0] * 256
        self.pieces: dict[str, tuple[int, float]] = {}
        for i in range(self.size):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(p[1:-1], 16)
                self.bytes[b] = i
                self.texts[i] = bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.pieces[p] = (i, sp.get_score(i))
                self.texts[i] = p.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for _, s in self.pieces.values()) + UNKNOWN
        # no piece goes on to a space after another character
        self.inner_space = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.mixed = any(EDGE.search(p) for p in self.pieces)
        self._trie()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _trie(self) -> None:
        """States are the beginnings of pieces; steps (state, code point) -> state stand in a table with linear probing."""
        states: dict[str, int] = {"": 0}
        steps = []
        for p in self.pieces:
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    states[p[:k]] = len(states)
                    steps.append((states[p[: k - 1]] << 21 | ord(p[k - 1]), states[p[:k]]))
        self.id_of = np.full(len(states), -1, np.int32)
        self.score_of = np.full(len(states), -np.inf)
        for p, (i, score) in self.pieces.items():
            self.id_of[states[p]], self.score_of[states[p]] = i, score
        self.bits = max(4, (4 * len(steps)).bit_length())
        self.keys, self.next = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        key, to = (np.array(x, np.int64) for x in zip(*steps, strict=True))
        slot, self.probes = self._slot(key), 0
        while len(key):
            self.probes += 1
            _, first = np.unique(slot, return_index=True)
            fits = np.zeros(len(key), bool)
            fits[first] = self.keys[slot[first]] < 0
            self.keys[slot[fits]], self.next[slot[fits]] = key[fits], to[fits]
            key, to, slot = key[~fits], to[~fits], (slot[~fits] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next states, -1 for none."""
        key = state.astype(np.int64) << 21 | code
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.next[slot], -1)
        left = np.flatnonzero((out < 0) & (self.keys[slot] >= 0))
        for _ in range(self.probes):
            if not len(left):
                break
            at = (slot[left] + 1) & ((1 << self.bits) - 1)
            slot[left] = at
            same = self.keys[at] == key[left]
            out[left[same]] = self.next[at[same]]
            left = left[~same & (self.keys[at] >= 0)]
        return out

    def _starting(self, codes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores and ids of the pieces of each length from each place of the first rows of codes (positions x streams, -1 behind the end), and how far they reach."""
        streams = codes.shape[1]
        scores = np.full((self.longest + 1, rows * streams), -np.inf)
        ids = np.full((self.longest + 1, rows * streams), -1, np.int32)
        reach = np.ones(rows * streams, np.int32)
        flat = codes.ravel()
        at = np.flatnonzero(flat[: rows * streams] >= 0)
        scores[1, at] = self.unknown
        state = np.zeros(len(at), np.int32)
        for size in range(1, self.longest + 1):
            place = at + (size - 1) * streams
            inside = place < len(flat)
            at, state, place = at[inside], state[inside], place[inside]
            inside = flat[place] >= 0
            at, state, place = at[inside], state[inside], place[inside]
            if not len(at):
                break
            state = self._step(state, flat[place])
            found = state >= 0
            at, state = at[found], state[found]
            whole = self.id_of[state] >= 0
            scores[size, at[whole]], ids[size, at[whole]], reach[at[whole]] = self.score_of[state[whole]], self.id_of[state[whole]], size
        shape = (self.longest + 1, rows, streams)
        return scores.reshape(shape), ids.reshape(shape), reach.reshape(shape[1:])

    def search(self, stretches: list[str]) -> list[bytes]:
        """The ids of each stretch, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(stretches)
        order = sorted(range(len(stretches)), key=lambda k: len(stretches[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * min(BLOCK, len(stretches[order[end]])) <= CELLS:
                end += 1
            for k, ids in zip(order[at:end], self._streams([stretches[k] for k in order[at:end]]), strict=True):
                out[k] = ids
            at = end
        return out

    def _streams(self, texts: list[str]) -> list[bytes]:
        """Streams side by side, in ascending order of length."""
        n = np.array([len(t) for t in texts])
        count, window, last = len(texts), self.longest + 1, int(n[-1])
        codes, offset = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.cumsum(n) - n
        best = np.full((window, count), -np.inf)  # of paths to a position, in the row of its number modulo the window
        best[0] = 0.0
        base, shared, reach = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)  # committed up to; boundary that all paths share
        low = 0  # position of the first row of the backpointers
        sizes, ids = np.zeros((1, count), np.int16), np.zeros((1, count), np.int32)
        done: list[tuple[np.ndarray, ...]] = []
        for begin in range(0, last, BLOCK):
            rows = min(BLOCK, last - begin)
            places = np.arange(begin, min(last, begin + rows + self.longest))[:, None]
            inside = places < n
            scores, found, far = self._starting(np.where(inside, codes[np.minimum(offset + places, len(codes) - 1)], -1), rows)
            more = begin + rows + self.longest + 1 - low - len(sizes)
            sizes, ids = (np.concatenate([x, np.zeros((more, count), x.dtype)]) for x in (sizes, ids))
            longest = np.where(inside[:rows], far, 0).max(1).tolist()
            for row in range(rows):
                at = begin + row
                live = int(np.searchsorted(n, at, "right"))  # streams that go on from here
                here = best[at % window, live:].copy()
                best[at % window] = -np.inf
                for size in range(1, longest[row] + 1):
                    new = here + scores[size, row, live:]
                    to = best[(at + size) % window, live:]
                    better = new > to
                    np.copyto(to, new, where=better)
                    np.copyto(sizes[at + size - low, live:], size, where=better)
                    np.copyto(ids[at + size - low, live:], found[size, row, live:], where=better)
                ahead = reach[live:]
                np.maximum(ahead, at + far[row, live:], out=ahead)
                shared[live:][ahead == at + 1] = at + 1
            at = begin + rows
            for k in np.flatnonzero((n > at) & (at - np.maximum(base, shared) > CHAINS * self.longest)):
                shared[k] = self._chains(int(base[k]), [p for p in range(at, min(at + self.longest, int(n[k])) + 1) if best[p % window, k] > -np.inf], sizes[:, k], low)
            done += self._committed(base, shared, sizes, ids, low, offset, codes)
            base = np.maximum(base, shared)
            keep = int(min(at, base[n > at].min(initial=at)))
            sizes, ids, low = sizes[keep - low :].copy(), ids[keep - low :].copy(), keep
        stream, place, number, code = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((place, stream))
        stream, number, code = stream[order], number[order].astype(np.uint32), code[order]
        ends = np.searchsorted(stream, np.arange(count + 1))
        raw = number.tobytes()
        out = [raw[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for k in np.unique(stream[code >= 0]):  # code points that no piece holds
            span = range(ends[k], ends[k + 1])
            out[k] = array("I", [i for j in span for i in ([self.bytes[b] for b in chr(code[j]).encode()] if code[j] >= 0 else [int(number[j])])]).tobytes()
        return out

    @staticmethod
    def _chains(base: int, alive: list[int], sizes: np.ndarray, low: int) -> int:
        """The last boundary on the paths to all alive positions."""
        common: set[int] | None = None
        for p in alive:
            chain = {p}
            while p > base:
                p -= int(sizes[p - low])
                chain.add(p)
            common = chain if common is None else common & chain
        return max(common or {base})

    @staticmethod
    def _committed(base: np.ndarray, shared: np.ndarray, sizes: np.ndarray, ids: np.ndarray, low: int, offset: np.ndarray, codes: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """(stream, position, id, code point if no piece holds it, else -1) of what lies between the last commit and the shared boundaries."""
        out = []
        stream = np.flatnonzero(shared > base)
        place = shared[stream]
        while len(stream):
            number, size = ids[place - low, stream], sizes[place - low, stream]
            out.append((stream, place, number, np.where(number < 0, codes[offset[stream] + place - 1], -1)))
            place = place - size
            left = place > base[stream]
            stream, place = stream[left], place[left]
        return out

    def words(self, text: str) -> list[str]:
        """The stretches of a text: words with the spaces before them, or all of it."""
        text = SPACE + text.replace(" ", SPACE)
        if self.inner_space:
            return [text]
        if SPACE + SPACE in text or text[-1] == SPACE:
            return STRETCH.findall(text)
        return [SPACE + w for w in text[1:].split(SPACE)]

    def _learn(self, words: Iterable[str]) -> None:
        """Gives the memo the ids of words."""
        memo, older, split = self.memo, self.older, EDGE.split if not self.mixed else lambda w: [w]
        new: dict[str, list[str]] = {}
        for w in words:
            if w not in memo:
                if (ids := older.get(w)) is not None:
                    memo[w] = ids
                else:
                    new[w] = split(w)
        parts = list({p for of in new.values() for p in of if p not in memo and p not in older})
        found = dict(zip(parts, self.search(parts), strict=True))
        get = lambda p: found.get(p) or memo.get(p) or older[p]
        for w, of in new.items():
            memo[w] = get(of[0]) if len(of) == 1 else b"".join(map(get, of))

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """ids of texts as little-endian unsigned 32-bit integers."""
        held: list[list[str]] = []
        size = 0

        def given() -> Iterator[bytes]:
            if len(self.memo) > MEMO_WORDS:
                self.memo, self.older = {}, self.memo
            self._learn(set().union(*held))
            return [b"".join(map(self.memo.__getitem__, w)) for w in held]

        for text in texts:
            held.append(self.words(text) if text else [])
            size += len(text or "")
            if size > PART:
                yield from given()
                held, size = [], 0
        yield from given()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; byte pieces that form no UTF-8 become U+FFFD."""
        ids = list(ids)
        if ids and not 0 <= min(ids) <= max(ids) < self.size:
            raise ValueError(f"{min(ids)} to {max(ids)} aren't all ids of the vocabulary")
        out = b"".join(map(self.texts.__getitem__, ids))
        text = out.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_held: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _held:
        _held[path] = Vocabulary(path)
    return _held[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with the ids of text_col as an array in out_col."""
    ship(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        v = vocabulary(path)
        return pa.array([np.frombuffer(ids, np.uint32).astype(np.int32) for ids in v.encode(column.to_pylist())], pa.list_(pa.int32()))

    return docs.withColumn(out_col, run(F.col(text_col).cast("string")))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """docs with the text of ids_col in out_col; null ids give an empty text."""
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        v = vocabulary(path)
        return pa.array([v.decode(x or ()) for x in column.to_pylist()], pa.string())

    return docs.withColumn(out_col, run(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids) and decoded_sha256 of every text."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            counts, crcs, digests = [], [], []
            for ids in v.encode(batch.column(1).to_pylist()):
                counts.append(len(ids) // 4)
                crcs.append(zlib.crc32(ids))
                digests.append(hashlib.sha256(v.decode(np.frombuffer(ids, np.uint32).tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
