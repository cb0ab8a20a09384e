"""Byte pair encoding by numpy merge rounds over many words at once, and decoding.

Method: the distinct words of a window of texts lie in one flat array of symbols, with the number of each symbol's
word beside it. A round looks up the rank of every pair that changed, by binary search over the sorted keys of all
pairs that merge; each word merges its own pair of lowest rank, at all its places, all words at once. Words
without such a pair leave, so that rounds get shorter. Words of more than LONG symbols go by rank instead: the lowest
pair of all of them merges at all places, ranks in ascending blocks, so that a run of millions of letters takes some
seconds, not a round a token over its whole length. A bounded memo keeps the ids of words between windows.

What stands before the merges is the file's own: NFC, lower case letter by letter, white space dropped, words by its
split pattern, added tokens' literals found in the raw text. decode() joins the tokens' strings by one space, as the
library does for a file without a decoder. The letters' and numbers' classes come from Python's Unicode tables; a
window with characters that these don't know yet is normalised and split by the library.

A text goes in windows of WINDOW code points, cut before white space, where no word crosses; memory is bounded by the
window, the longest run without white space, and a document's ids.

Defined cases: null text counts as empty, has no ids and decodes to ''; null ids are passed through, repeated rows
stay, an empty table gives no rows, ids that the file doesn't know decode to nothing. Other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.llm.common import load, ship
from cairnwork.llm.tokens import BYTE_LETTERS

#: Code points of text whose words are merged together.
WINDOW = 1 << 20
#: Symbols from which a word goes by rank.
LONG = 256
#: Words in one of the memo's two generations, and the longest that it keeps.
MEMO_WORDS, MEMO_LETTERS = 200_000, 64
#: Ids written as text at once.
PART_IDS = 1 << 20
NONE = np.iinfo(np.int64).max
#: White space as the tokenizer's patterns know it, for a character class.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
BEFORE_WHITE = re.compile(f"[{WHITE}]")
# Fixed value: endings that the vocabulary's split pattern takes apart.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The last characters that patterns of growing size know: ASCII, Latin, the basic plane, all. Small classes are faster.
REACH = "\x7f", "\u024f", "\uffff", chr(sys.maxunicode)


def runs(numbers: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of runs of consecutive numbers."""
    if not len(numbers):
        return []
    cut = np.flatnonzero(np.diff(numbers) != 1)
    return list(zip(numbers[np.r_[0, cut + 1]].tolist(), numbers[np.r_[cut, len(numbers) - 1]].tolist(), strict=True))


def character_class(categories: np.ndarray, start: str) -> str:
    """The inside of a character class: all code points whose general category begins with start."""
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs(np.flatnonzero(np.char.startswith(categories, start))))


class MergeTable:
    """Pairs that merge, by sorted key; symbols are ids."""

    def __init__(self, left: np.ndarray, right: np.ndarray, product: np.ndarray, size: int) -> None:
        """left, right, product: ids in order of rank; size: more than any id."""
        keys = left.astype(np.int64) * size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.product, self.size = product.astype(np.int64), size
        made = np.full(size, -1, np.int64)  # the rank that first makes each symbol
        made[self.product[::-1]] = np.arange(len(product))[::-1]
        #: No pair comes before the pairs that make its parts, so that merging never brings up a lower rank.
        self.ordered = bool((np.maximum(made[left], made[right]) < np.arange(len(left))).all())

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE if it doesn't merge: a binary search."""
        keys = left * self.size + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], NONE) if len(self.keys) else np.full(len(keys), NONE)

    def merge(self, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and their words, in order of word. words: the number of each symbol's word, never falling."""
        long = (np.bincount(words) > LONG)[words] if self.ordered and len(words) else np.zeros(len(words), bool)
        parts = [self._rounds(symbols[~long], words[~long])] + [self._by_rank(symbols[long], words[long])] * bool(long.any())
        symbols, words = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(words, kind="stable")
        return symbols[order], words[order]

    def _pairs(self, symbols: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The rank of the pair that begins at each symbol."""
        rank = np.full(len(symbols), NONE)
        at = np.flatnonzero(words[1:] == words[:-1])
        rank[at] = self.rank(symbols[at], symbols[at + 1])
        return rank

    def _rounds(self, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done: list[tuple[np.ndarray, np.ndarray]] = [(symbols[:0], words[:0])]
        rank = self._pairs(symbols, words)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(words)]))
            ready = least == NONE
            if ready.any():
                done.append((symbols[ready], words[ready]))
                symbols, words, rank, least = (x[~ready] for x in (symbols, words, rank, least))
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == least)
            hits = every_other(hits, hits[:-1] + 1 == hits[1:]) if self.ordered else hits[np.r_[True, words[hits[1:]] != words[hits[:-1]]]]
            symbols[hits] = self.product[rank[hits]]
            kept = np.ones(len(symbols), bool)
            kept[hits + 1] = False
            place = np.cumsum(kept) - 1
            symbols, words, rank = symbols[kept], words[kept], rank[kept]
            hits = place[hits]
            changed = np.concatenate([hits, hits[hits > 0] - 1])
            rank[changed] = NONE
            changed = changed[changed + 1 < len(symbols)]
            changed = changed[words[changed] == words[changed + 1]]
            rank[changed] = self.rank(symbols[changed], symbols[changed + 1])
        symbols, words = (np.concatenate(x) for x in zip(*done, strict=True))
        return symbols, words

    def _by_rank(self, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words' lowest pair at all places, then the next: symbols stay where they are and point to the next and the last one."""
        n = len(symbols)
        symbols = symbols.copy()
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        alive = np.ones(n, bool)
        rank = self._pairs(symbols, words)
        step = max(1, math.isqrt(len(self.keys)))  # a scan of all symbols for each block of ranks, a scan of the block's places for each rank
        for end in range(step, len(self.keys) + step, step):
            live = np.flatnonzero(rank < end)
            while len(live):
                of = rank[live]
                least = of.min()
                hits = live[of == least]
                hits = every_other(hits, after[hits[:-1]] == hits[1:])
                gone = after[hits]
                symbols[hits], alive[gone] = self.product[least], False
                after[hits] = after[gone]
                before[after[hits]] = hits
                rank[gone] = NONE
                changed = np.concatenate([hits, before[hits][before[hits] >= 0]])
                rank[changed] = NONE
                pairs = changed[after[changed] < n]
                pairs = pairs[words[pairs] == words[after[pairs]]]
                rank[pairs] = self.rank(symbols[pairs], symbols[after[pairs]])
                live = live[rank[live] < end]
                fresh = pairs[rank[pairs] < end]
                if len(fresh):
                    live = np.union1d(live, fresh)
        return symbols[alive], words[alive]


def every_other(hits: np.ndarray, touching: np.ndarray) -> np.ndarray:
    """hits without those that overlap the pair kept before them, from the left. touching: whether each but the last meets the next."""
    if not touching.any():
        return hits
    start = np.r_[True, ~touching]  # a run's first
    at = np.arange(len(hits))
    return hits[(at - np.maximum.accumulate(np.where(start, at, 0))) % 2 == 0]


def word_pattern(categories: np.ndarray) -> re.Pattern:
    """Words among the code points whose categories are given."""
    l, n = character_class(categories, "L"), character_class(categories, "N")
    return re.compile(f"{ENDINGS}|[{l}]+|[{n}]|[^{WHITE}{l}{n}]+")


class Codec:
    """A vocabulary file of byte pair merges with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, added = data["model"], data["added_tokens"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        ids = {a["content"]: a["id"] for a in added}
        self.strings: list[str | None] = [None] * (max([*vocab.values(), *ids.values()], default=-1) + 1)
        for s, i in {**vocab, **ids}.items():
            self.strings[i] = s
        self.literals = re.compile("|".join(map(re.escape, sorted(ids, key=len, reverse=True)))) if ids else None
        self.added = {s: np.uint32(i).tobytes() for s, i in ids.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.table = MergeTable(left, right, np.array([vocab[a + b] for a, b in pairs], np.int64), len(self.strings))
        letters = [BYTE_LETTERS[b] for b in range(256)]
        self.inner = np.array([vocab.get(x, -1) for x in letters], np.int64)
        self.last = np.array([vocab.get(x + suffix, -1) for x in letters], np.int64)
        categories = np.array([unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1)])
        self.patterns = [(end, word_pattern(categories[: ord(end) + 1])) for end in REACH]
        self.path, self.library = path, None
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """Words of a text without literals."""
        if text.isascii():
            return self.patterns[0][1].findall(text.lower())
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            text = self.library.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        # each letter by itself, so that no final sigma comes up
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        last = max(text, default="")
        return next(pattern for end, pattern in self.patterns if last <= end).findall(text)

    def windows(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > WINDOW:
            cut = BEFORE_WHITE.search(text, at + WINDOW)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def parts(self, text: str) -> Iterator[list[str]]:
        """Words of each window of a text, in order; a literal is a word of its own, with the mark \\0 before it."""
        for window in self.windows(text):
            at, found = 0, []
            if self.literals and "<" in window:
                for m in self.literals.finditer(window):
                    found += self.split(window[at : m.start()])
                    found.append("\0" + m[0])
                    at = m.end()
            yield found + self.split(window[at:] if at else window)

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word, merged together."""
        known: dict[str, bytes] = {}
        plain = []
        for w in words:
            if w[0] == "\0" and w[1:] in self.added:
                known[w] = self.added[w[1:]]
            else:
                plain.append(w)
        raw = [w.encode("utf-8", "surrogatepass") for w in plain]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        if len(data):
            ends = np.cumsum(sizes) - 1
            symbols[ends] = self.last[data[ends]]
        ids, of = self.table.merge(symbols, np.repeat(np.arange(len(plain)), sizes))
        flat = ids.astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(of, minlength=len(plain)))).tolist()
        known.update(zip(plain, (flat[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True))
        return known

    def lookup(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each of these words, from the memo where it has them."""
        if len(self.memo) > MEMO_WORDS:
            self.older, self.memo = self.memo, {}
        new, found = [], {}
        for w in words:
            ids = self.memo.get(w)
            if ids is None:
                ids = self.older.get(w)
                if ids is None:
                    new.append(w)
                    continue
                self.memo[w] = ids
            found[w] = ids
        if new:
            made = self.learn(new)
            self.memo.update((w, i) for w, i in made.items() if len(w) <= MEMO_LETTERS)
            found |= made
        return found

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """uint32 ids of each text. Windows of short texts are merged together."""
        held: list[tuple[list[str], bool]] = []  # words, whether they end a text
        size = 0
        whole: list[bytes] = []

        def flush() -> Iterator[np.ndarray]:
            ids = self.lookup({w for words, _ in held for w in words})
            for words, ends in held:
                whole.append(b"".join(map(ids.__getitem__, words)))
                if ends:
                    yield np.frombuffer(b"".join(whole), "<u4")
                    whole.clear()
            held.clear()

        for text in texts:
            last: list[str] = []
            for k, words in enumerate(self.parts(text or "")):
                if k:
                    held.append((last, False))
                    yield from flush()
                last = words
            held.append((last, True))
            size += len(text or "")
            if size >= WINDOW:
                yield from flush()
                size = 0
        yield from flush()

    def strings_of(self, ids: np.ndarray) -> Iterator[str]:
        """What decode() joins, part by part."""
        names = self.strings
        for at in range(0, len(ids), PART_IDS):
            part = [names[i] for i in ids[at : at + PART_IDS].tolist() if 0 <= i < len(names)]
            yield " ".join(x for x in part if x is not None) if None in part else " ".join(part)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(filter(None, self.strings_of(ids)))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One a worker process, kept from task to task."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every text."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [x.astype(np.int32) for x in own.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every array of ids; null ids give null, null entries are left out."""
    ship(encoded.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [None if ids is None else own.decode(np.array([i for i in ids if i is not None], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids, one space between), decoded_sha256: encoded and decoded in one pass."""
    ship(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def sha(parts: Iterable[str]) -> str:
        h = hashlib.sha256()
        for k, part in enumerate(parts):
            h.update((" " * bool(k) + part).encode())
        return h.hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        numbers = list(map(str, range(len(own.strings))))
        for batch in batches:
            rows = []
            for ids in own.encode(batch.column(1).to_pylist()):
                decimal = (" ".join(map(numbers.__getitem__, ids[at : at + PART_IDS].tolist())) for at in range(0, len(ids), PART_IDS))
                rows.append((len(ids), sha(decimal), sha(own.strings_of(ids))))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:]]], names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_bpe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
