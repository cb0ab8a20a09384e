"""Tokenizers inside tasks: the library encodes each distinct piece of text once, later places reuse its ids.

Both tokenizers first cut a text at places that no token crosses, then encode each piece by itself. A cut before a
space that stands before a character of a word is such a place, as is one at a line's end; and a run of letters and
the punctuation after it never share a token. So the ids of a text are the ids of its pieces, one after another, and
a bounded memo of pieces saves most of the work. A comma or full stop between a letter and a space is a piece of its
own, so that words are remembered once. A piece that is one run of letters goes straight to the library's
BPE model, any other through the whole tokenizer. Tests compare with encoding whole texts.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

from cairnwork.llm.common import give_back

#: Pieces in one of the memo's two generations (some 250 bytes each): when the newer is full it becomes the older, which goes.
MEMO_PIECES = 150_000

#: A comma or full stop behind a letter and before a space: the literal first, which is found fast.
COMMA = re.compile(r",(?= )(?<=[A-Za-zÀ-ÖØ-öø-ÿ],)")
STOP = re.compile(r"\.(?= )(?<=[A-Za-zÀ-ÖØ-öø-ÿ]\.)")
BEFORE_WORD = re.compile(r"(?= \S)")
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
PUNCTUATED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:#$%&*|()]+)")
WIDE = re.compile(r"[^\x00-\xff]")
#: White space besides the space and the line end.
OTHER_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
WIDE_SPACES = re.compile("[\x85\xa0  -     　]")
RAW = "\x00"
#: How COMMA and STOP are written for splitting at spaces.
AS_COMMA, AS_STOP = " " + RAW + ",", " " + RAW + "."


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself where it prints, else one from 256 on."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


BYTE_LETTERS = _byte_letters()


def byte_letters(text: str) -> str:
    return text.encode().decode("latin-1").translate(BYTE_LETTERS)


class Memo(dict):
    """ids of pieces by key; what it lacks comes from the older generation or the encoder."""

    def __init__(self, encoder: Encoder, older: dict) -> None:
        self.encoder, self.older = encoder, older

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            e = self.encoder
            ids = array(e.code, [t.id for t in e.tokenize(e.before + key)]).tobytes() if key.isascii() and key.isalpha() else e.learn(key, self)
        self[key] = ids
        return ids


class Encoder:
    """ids of texts as little-endian unsigned integers of 32 bits, or (code "H") of 16."""

    before = ""  # what the model sees before a word's letters

    def __init__(self, path: str, code: str = "I", pieces: int = MEMO_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.literals = re.compile("|".join(map(re.escape, sorted(self.ids, key=len, reverse=True)))) if self.ids else None
        self.plain = Tokenizer.from_file(path)  # of pieces between literals; lower case may make a piece look like one
        self.plain.encode_special_tokens = True
        self.model, self.code, self.pieces = self.plain.model, code, pieces
        self.tokenize = self.model.tokenize
        self.memo = Memo(self, {})

    def cut(self, text: str) -> list[str]:
        """The memo's keys of a text's pieces."""
        raise NotImplementedError

    def letters(self, key: str) -> str:
        """What the model sees of a piece that is a run of letters."""
        raise NotImplementedError

    def whole(self, key: str) -> str:
        """The piece that any key stands for."""
        raise NotImplementedError

    def learn(self, key: str, memo: Memo) -> bytes:
        if LETTERS.fullmatch(key):
            return array(self.code, [t.id for t in self.model.tokenize(self.letters(key))]).tobytes()
        if m := PUNCTUATED.fullmatch(key):
            return memo[m[1]] + memo[RAW + m[2]]
        return array(self.code, self.plain.encode(self.whole(key), add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for text in texts:
            if len(self.memo) > self.pieces:
                self.memo = Memo(self, dict(self.memo))
            yield self.ids_of(text) if text else b""

    def ids_of(self, text: str) -> bytes:
        out, at = [], 0
        if self.literals:
            for m in self.literals.finditer(text):  # an added token's literal is one token; the texts around it stand by themselves
                if m.start() > at:
                    out += map(self.memo.__getitem__, self.cut(text[at : m.start()]))
                out.append(array(self.code, [self.ids[m[0]]]).tobytes())
                at = m.end()
        if at < len(text):
            out += map(self.memo.__getitem__, self.cut(text[at:] if at else text))
        return b"".join(out)


def even(text: str) -> bool:
    """Whether white space is single spaces and line ends alone, none of them at an end of the text."""
    if text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in OTHER_SPACES) and (text.isascii() or not WIDE_SPACES.search(text))


class ByteEncoder(Encoder):
    """Byte-level vocabularies: a piece takes the space before it along."""

    before = BYTE_LETTERS[32]

    def cut(self, text: str) -> list[str]:
        if RAW in text or not even(text):
            return [RAW + x for x in BEFORE_WORD.split(text) if x]
        keys = STOP.sub(AS_STOP, COMMA.sub(AS_COMMA, text.replace("\n", " \n"))).split(" ")
        keys[0] = RAW + keys[0]
        return keys

    def letters(self, key: str) -> str:
        return byte_letters(" " + key)

    def whole(self, key: str) -> str:
        return key[1:] if key[0] == RAW else key if key[0] == "\n" else " " + key

    def learn(self, key: str, memo: Memo) -> bytes:
        if key[0] == "\n" and (m := PUNCTUATED.fullmatch(key, 1) or LETTERS.fullmatch(key, 1)):  # a line's first word
            word = m[1] if m.re is PUNCTUATED else m[0]
            first = array(self.code, [t.id for t in self.model.tokenize(byte_letters(word))]).tobytes()
            return memo[RAW + "\n"] + first + (memo[RAW + m[2]] if m.re is PUNCTUATED else b"")
        return super().learn(key, memo)


class WordEncoder(Encoder):
    """Vocabularies that lower-case, drop white space and mark the ends of words."""

    def cut(self, text: str) -> list[str]:
        if RAW not in text and (text.isascii() or not WIDE.search(text)):
            return [k for k in STOP.sub(AS_STOP, COMMA.sub(AS_COMMA, text.lower().replace("\n", " "))).split(" ") if k]
        return [RAW + k for k in text.replace("\n", " ").split(" ") if k]

    def letters(self, key: str) -> str:
        return byte_letters(key)

    def whole(self, key: str) -> str:
        return key[1:] if key[0] == RAW and len(key) > 1 else key


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: type[Encoder], code: str = "I", pieces: int = MEMO_PIECES) -> Encoder:
    """One encoder a worker process, kept from task to task; pieces: those in one of the memo's two generations."""
    if (path, code) not in _encoders:
        _encoders[path, code] = kind(path, code, pieces)
    return _encoders[path, code]


def forget() -> None:
    """Empties the memos of this worker process and gives their room back; they fill again where texts are encoded."""
    if any(e.memo for e in _encoders.values()):
        for e in _encoders.values():
            e.memo = Memo(e, {})
        give_back()


def vocabulary(path: str) -> int:
    """One more than the greatest id of a tokenizer."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1
