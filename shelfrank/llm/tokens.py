"""Token ids of whole texts with a public tokenizer, word by word through a cache.

Both tokenizers here cut a text into pieces before any merge: a word of Latin letters with
the blank before it, a full stop or comma after it, and a single line end are pieces. Runs of
lines that hold nothing else are looked up word by word, and equal words, by far the most,
are encoded once. Other lines are cut at single blanks between two non-blanks, which no piece
crosses, and equal chunks are encoded once. The ids are the tokenizer's own in either case.
"""

from __future__ import annotations

import os
import re
from array import array

# Entries of each generation of a worker's caches, about 200 bytes each. A full cache becomes
# the older one; what is met again moves on, so frequent words are never encoded anew.
CACHE_WORDS, CACHE_CHUNKS = 150_000, 25_000
_SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")
_encoders: dict = {}
# One word of Latin letters: a single piece for either tokenizer, so its model alone decides.
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_LINES = re.compile(
    "[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?(?:[ \n][A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?)*"
).fullmatch
_WORD_AND_STOP = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)").fullmatch


def byte_letters() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: printable ones stay."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = byte_letters()


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Of the two kinds of files, those with word ends lower-case words and drop blanks.
        self.word_ends = bool(self.tokenizer.model.end_of_word_suffix)
        self.model = self.tokenizer.model
        self.line_end = self.direct("\n")
        self.plain: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, dict[str, bytes]] = {"plain": {}, "chunks": {}, "pieces": {}}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, without special tokens."""
        runs = [[(True, t)] if _LINES(t) else runs_of_lines(t) for t in texts]
        split = [
            [(text if plain else None, words_of(text) if plain else text.split(" ")) for plain, text in doc]
            for doc in runs
        ]
        self.learn_plain(set().union(*(parts[1:] for doc in split for t, parts in doc if t is not None)))
        other = set().union(*(parts[1:] for doc in split for t, parts in doc if t is None))
        self.learn([c for c in self.unknown("chunks", other) if is_plain(c)])
        found = []
        for doc, cut in zip(runs, split, strict=True):
            ids = []
            for (plain, text), (_, parts) in zip(doc, cut, strict=True):
                row = list(map((self.plain if plain else self.chunks).get, parts))
                row[0] = self.direct(parts[0])
                ids.append(self.beside_white(text) if None in row else b"".join(row))
            found.append(self.line_end.join(ids))
        for name, size in (("plain", CACHE_WORDS), ("chunks", CACHE_CHUNKS), ("pieces", CACHE_CHUNKS)):
            if len(getattr(self, name)) > size:
                self.older[name] = getattr(self, name)
                setattr(self, name, {})
        return found

    def unknown(self, name: str, parts: set[str]) -> set[str]:
        """Those of ``parts`` that neither generation of a cache has; older ones move on."""
        cache, older = getattr(self, name), self.older[name]
        new = parts.difference(cache)
        met = new.intersection(older)
        cache.update((p, older[p]) for p in met)
        return new.difference(met)

    def learn_plain(self, parts: set[str]) -> None:
        """Puts words (each after a blank, or after a line end) and stops into the cache."""
        new = list(self.unknown("plain", parts))
        lines = [p for p in new if p[0] == "\n"]
        words = [p for p in new if p[0] not in "\n.,"]
        for p, ids in zip(words, self.ids_of_words([" " + w for w in words]), strict=True):
            self.plain[p] = ids
        for p, ids in zip(lines, self.ids_of_words([p[1:] for p in lines]), strict=True):
            self.plain[p] = self.line_end + ids
        for p in new:
            if p in (".", ","):
                self.plain[p] = self.direct(p)

    def beside_white(self, text: str) -> bytes:
        """Ids of a text with blanks beside white space, which stay inside their chunks."""
        head, *rest = _SAFE_BLANK.split(text)
        self.learn([p for p in self.unknown("chunks", set(rest)) if is_plain(p) and " " not in p])
        return self.direct(head) + b"".join(
            self.chunks[p] if p in self.chunks else self.direct(" " + p) for p in rest
        )

    def direct(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, chunks: list[str]) -> None:
        """Puts the ids of ``chunks``, each after a blank, into the cache."""
        cut = {}
        for chunk in chunks:
            simple = _WORD_AND_STOP(chunk)
            cut[chunk] = (" " + simple[1], simple[2]) if simple else pieces_of_chunk(" " + chunk)
        new = self.unknown("pieces", {p for pieces in cut.values() for p in pieces})
        new.discard("")
        words, other = [], []
        for piece in new:
            (words if _WORD(piece) else other).append(piece)
        self.pieces.update(zip(words, self.ids_of_words(words), strict=True))
        codes = self.tokenizer.encode_batch_fast(other, add_special_tokens=False)
        for piece, code in zip(other, codes, strict=True):
            self.pieces[piece] = array("I", code.ids).tobytes()
        self.pieces[""] = b""
        get = self.pieces.__getitem__
        for chunk, pieces in cut.items():
            self.chunks[chunk] = b"".join(map(get, pieces))

    def ids_of_words(self, pieces: list[str]) -> list[bytes]:
        if not pieces:
            return []
        text = "\n".join(pieces)
        if self.word_ends:
            text = text.replace(" ", "").lower()
        letters = text.encode().decode("latin-1").translate(_LETTERS).split(_LETTERS[0x0A])
        merge = self.model.tokenize
        return [array("I", [t.id for t in merge(word)]).tobytes() for word in letters]


def words_of(text: str) -> list[str]:
    """Words and stops of plain lines; a line's first word keeps the line end before it."""
    return text.replace("\n", " \n").replace(".", " .").replace(",", " ,").split(" ")


def runs_of_lines(text: str) -> list[tuple[bool, str]]:
    """Runs of lines, whether plain, between which a single line end is a piece of its own."""
    lines = text.split("\n")
    kinds = [bool(_LINES(x)) for x in lines]
    # A line with white space at an end takes the lines around into its own run.
    open_ends = [not is_plain(x) for x in lines]
    runs: list[tuple[bool, list[str]]] = []
    for i, line in enumerate(lines):
        near = open_ends[max(i - 1, 0) : i + 2]
        plain = kinds[i] and not any(near)
        glued = i > 0 and (open_ends[i - 1] or open_ends[i])
        if runs and (glued or runs[-1][0] == plain):
            runs[-1][1].append(line)
        else:
            runs.append((plain, [line]))
    return [(plain, "\n".join(part)) for plain, part in runs]


def is_plain(part: str) -> bool:
    return bool(part) and not part[0].isspace() and not part[-1].isspace()


def pieces_of_chunk(chunk: str) -> list[str]:
    """Pieces at line ends inside a chunk and before a last full stop or comma."""
    lines = chunk.split("\n")
    if len(lines) > 1 and not all(
        line and not line[-1].isspace() and (i == 0 or not line[0].isspace())
        for i, line in enumerate(lines)
    ):
        return [chunk]
    found = []
    for i, line in enumerate(lines):
        if i:
            found.append("\n")
        if len(line) > 2 and line[-1] in ".," and _WORD(line[:-1]):
            found += [line[:-1], line[-1]]
        else:
            found.append(line)
    return found


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, kept between its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
