"""Token ids of whole texts through the ``tokenizers`` library.

Both public vocabularies used here split a text into pieces that never
cross white space before they merge bytes, so the ids of a text are the ids
of its white-space chunks, one after the other.  A worker therefore encodes
each distinct chunk once, with the library, and remembers its ids in a
bounded table.  A text with a control character that the library and Python
class differently (U+001C to U+001F) is encoded in one piece.

The texts of a batch are cut and their distinct pieces found in Arrow, so
Python looks up each distinct piece of a batch once, and NumPy lays the ids
out.  A new piece of printable ASCII and Latin-1 letters only, where the
library's classes of characters are plain, is cut as the vocabulary's rule
says and goes to the library's BPE model itself; any other goes through the
library's whole chain.

``special`` says what the string of an added token (``<|endoftext|>``) in a
text is: that token, as the library reads it by default, in which case the
text is encoded in one piece too; or else ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_MARKS = ".,;:!?"
CACHE_CHUNKS = 800_000
LONGEST_CHUNK = 64
CUT = "<|endoftext|>"
TOGETHER = 64

_odd = re.compile("[\x1c-\x1f]").search
_blank = re.compile(r"\s").search
# A chunk takes one leading space along, as byte-level vocabularies do; of a
# run of white space the last character stays with (or before) the next word.
_spaced_chunks = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
# Where a space follows white space, cutting at every space is not the same.
_run = re.compile(r"\s ").search

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"            # of Latin-1, those with one form and one lower case
_is_plain = re.compile(f"[!-~{_LETTERS}]+").fullmatch
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"
# The rules of the public vocabularies, (normalizer, pre-tokenizer), and what
# they come to for plain pieces, each ended by a line break: (in lower case, cut).
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_RULES = [
    (({"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
      {"type": "Sequence", "pretokenizers": [
          {"type": "Split", "pattern": {"Regex": _CONTRACTED + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
          {**_BYTES, "use_regex": False}]}),
     (True, re.compile(f"{_CONTRACTED}|[{_LETTERS}]+|[0-9]|[^\n{_LETTERS}0-9]+|\n").findall)),
    ((None, {**_BYTES, "use_regex": True}),
     (False, re.compile(f"{_CONTRACTED}| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \n{_LETTERS}0-9]+|\n").findall)),
]
_WHOLE = b"w"                           # in place of a piece's ids: its text is encoded whole


assert sys.byteorder == "little" and array("I").itemsize == 4


def _ends_in_letter(word: str) -> bool:
    """Whether a word still does once a vocabulary has normalised it (NFC,
    lower case): some letters become a letter and a combining mark, which
    would join the punctuation mark that follows."""
    return word[-1].isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower()[-1].isalpha())


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``spaced``: white space is part of the vocabulary (else it is dropped).
    A text is cut at its spaces; ``words`` has the ids of a piece with its
    leading space (if ``spaced``), ``bare`` those of a piece as it stands."""

    def __init__(self, path: str, spaced: bool, limit: int = CACHE_CHUNKS, special: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        # A second reader in which this token stays special separates pieces
        # that are encoded together, which costs less than one call each.
        self.cutter = Tokenizer.from_file(path)
        self.added = [t.content for t in self.cutter.get_added_tokens_decoder().values()]
        self.cut_id = self.cutter.token_to_id(CUT) if CUT in self.added else None
        self.spaced, self.limit, self.special = spaced, limit, special
        self.words: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {"\n": b""}              # what plain pieces are cut into, with a leading space where it has one
        self.older: list[dict[str, bytes]] = [{}, {}, {}]       # these three before the last change of tables
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        self.plain = next((how for rule, how in _RULES if rule == (whole["normalizer"], whole["pre_tokenizer"])), None)
        self.model = self.tokenizer.model
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.bytewise = {c: as_bytes(chr(c))[0][0] for c in range(0x20, 0x100) if c == 0x20 or _is_plain(chr(c))}

    def _holds_added(self, text: str) -> bool:
        return any(a in text for a in self.added)

    def _direct(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(chunks), 64 * TOGETHER):
            part = chunks[i:i + 64 * TOGETHER]
            # A piece's ids must not depend on its company: one that holds
            # any added token never goes through the cutter.
            alone = [self.cut_id is None or self._holds_added(c) for c in part]
            if any(alone):
                single = [c for c, a in zip(part, alone, strict=True) if a]
                ids_alone = iter([array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(single, add_special_tokens=False)])
                rest = iter(self._direct([c for c, a in zip(part, alone, strict=True) if not a]))
                out += [next(ids_alone if a else rest) for a in alone]
                continue
            joined = [CUT.join(part[j:j + TOGETHER]) for j in range(0, len(part), TOGETHER)]
            for e in self.cutter.encode_batch_fast(joined, add_special_tokens=False):
                ids = np.array(e.ids, dtype="<u4")
                raw, at = ids.tobytes(), 0
                for cut in np.flatnonzero(ids == self.cut_id).tolist():
                    out.append(raw[4 * at:4 * cut])
                    at = cut + 1
                out.append(raw[4 * at:])
        return out

    def _exact(self, chunk: str) -> tuple[bool, str]:
        """(is a word with its leading space, key) of a chunk of ``_spaced_chunks``."""
        word = len(chunk) > 1 and chunk[0] == " " and not chunk.isspace()
        return word, chunk[1:] if word else chunk

    def _parts(self, word: str) -> list[tuple[bool, str]] | None:
        """Smaller pieces whose ids make up the word's, if it has any: a line
        break inside, or one punctuation mark after a letter."""
        if self.spaced and _blank(word):
            return [self._exact(c) for c in _spaced_chunks(" " + word)]
        if len(word) > 2 and word[-1] in END_MARKS and _ends_in_letter(word[:-1]):
            return [(True, word[:-1]), (not self.spaced, word[-1])]
        return None

    def _plain_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of plain pieces, with their leading space if ``spaced``."""
        if not pieces:
            return []
        lower, cut = self.plain
        text = " " + "\n ".join(pieces) + "\n" if self.spaced else "\n".join(pieces) + "\n"
        parts = cut(text.lower() if lower else text)
        stems = self.stems
        got = list(map(stems.get, parts))
        if None in got:
            new = list({x for x, g in zip(parts, got, strict=True) if g is None})
            old = list(map(self.older[2].get, new))
            stems.update([(x, g) for x, g in zip(new, old, strict=True) if g is not None])
            new = [x for x, g in zip(new, old, strict=True) if g is None]
            if new:
                tokenize = self.model.tokenize
                for x, name in zip(new, "\n".join(new).translate(self.bytewise).split("\n"), strict=True):
                    stems[x] = array("I", [t.id for t in tokenize(name)]).tobytes()
            got = list(map(stems.get, parts))
        stop = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))
        ends = stop[[i for i, x in enumerate(parts) if x == "\n"]].tolist()
        raw = b"".join(got)
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _is_plain(self, piece: str) -> bool:
        return self.plain is not None and len(piece) <= LONGEST_CHUNK and _is_plain(piece) is not None

    def _learn(self, words: Iterable[str], bare: Iterable[str]) -> None:
        """Encode what is not known, each distinct piece once."""
        known, plan, direct, bare = self.words, {}, [], set(bare)
        todo = [w for w in set(words) if w not in known]
        old = list(map(self.older[0].get, todo))
        known.update([(w, g) for w, g in zip(todo, old, strict=True) if g is not None])
        todo = [w for w, g in zip(todo, old, strict=True) if g is None]
        plain = [w for w in todo if self._is_plain(w)]
        known.update(zip(plain, self._plain_ids(plain), strict=True))
        todo = [w for w in todo if w not in known]
        seen = set(todo)
        while todo:
            w = todo.pop()
            parts = None if w.isalpha() else self._parts(w)
            if parts is None:
                direct.append(w)
                continue
            plan[w] = parts
            for is_word, x in parts:
                if not is_word:
                    bare.add(x)
                elif x not in known and x not in seen:
                    seen.add(x)
                    todo.append(x)
        known.update(zip(direct, self._direct([" " + w for w in direct] if self.spaced else direct), strict=True))
        new = []
        for b in bare:
            if b not in self.bare:
                old = self.older[1].get(b)
                if old is None:
                    new.append(b)
                else:
                    self.bare[b] = old
        self.bare.update(zip(new, self._direct(new), strict=True))

        def ids(is_word: bool, x: str) -> bytes:
            if not is_word:
                return self.bare[x]
            if x not in known:
                known[x] = b"".join([ids(*p) for p in plan[x]])
            return known[x]

        for w in plan:
            ids(True, w)

    def _forget(self, words: Iterable[str], bare: Iterable[str]) -> None:
        """Long pieces are not kept."""
        for x in [x for x in words if len(x) > LONGEST_CHUNK]:
            self.words.pop(x, None)
        for x in [x for x in bare if len(x) > LONGEST_CHUNK]:
            self.bare.pop(x, None)

    def _new_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces between spaces that are not in the table, which
        then has them; ``_WHOLE`` for one whose text is to be encoded whole."""
        out = list(map(self.older[0].get, pieces))
        added = self.special and self._holds_added(" ".join(pieces))
        plain, rest = [], []
        for i, x in enumerate(pieces):
            if out[i] is None:
                if added and self._holds_added(x):
                    out[i] = _WHOLE
                elif self._is_plain(x):
                    plain.append(i)
                elif _odd(x):
                    out[i] = _WHOLE
                else:
                    rest.append(i)
        for i, raw in zip(plain, self._plain_ids([pieces[i] for i in plain]), strict=True):
            out[i] = raw
        if rest:
            cut = [[pieces[i]] if self.spaced else pieces[i].split() for i in rest]
            words = {w for ws in cut for w in ws}
            self._learn(words, ())
            for i, ws in zip(rest, cut, strict=True):
                out[i] = b"".join([self.words[w] for w in ws])
            self._forget(words, ())
        self.words.update([(x, raw) for x, raw in zip(pieces, out, strict=True) if len(x) <= LONGEST_CHUNK])
        return out

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of every text.  Half of the pieces remembered are of the
        current table; when it is full, it becomes the older one, and what
        is met again moves on from there."""
        if len(self.words) + len(self.bare) + len(self.stems) > self.limit // 2:
            self.older = [self.words, self.bare, self.stems]
            self.words, self.bare, self.stems = {}, {}, {"\n": b""}
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(col):
            return []
        cut = pc.split_pattern(pc.fill_null(col, ""), " ")
        pieces = cut.flatten().dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = pieces.indices.to_numpy()
        ends = np.cumsum(pc.list_value_length(cut).to_numpy())          # of every text's pieces
        first, last = np.concatenate([[0], ends[:-1]]), ends - 1

        got = list(map(self.words.get, distinct))
        new = [i for i, g in enumerate(got) if g is None]
        for i, raw in zip(new, self._new_pieces([distinct[i] for i in new]), strict=True):
            got[i] = raw

        size = np.fromiter(map(len, got), np.int64, len(got))
        # A text with a marked piece is encoded apart, and so is one in which
        # a space follows white space.
        marked = size % 4 != 0
        apart = marked[at]
        if self.spaced:
            blank = np.fromiter((x[-1:].isspace() for x in distinct), bool, len(distinct))
            empty = np.fromiter((not x for x in distinct), bool, len(distinct))
            run = (blank | empty)[at]
            run[first] = blank[at[first]]
            run[last] = False
            apart |= run
        apart = np.logical_or.reduceat(apart, first)
        for i in np.flatnonzero(marked).tolist():
            got[i] = b""
        size[marked] = 0

        # Every piece's ids, in the order of the texts.
        size //= 4
        n = size[at]
        if self.spaced:
            n[first] = 0                                        # the first piece has no leading space
        stop = np.cumsum(n)
        source = np.repeat((np.cumsum(size) - size)[at] - (stop - n), n)
        source += np.arange(len(source))
        ids = np.frombuffer(b"".join(got), "<u4")[source].tobytes()
        stops = (4 * stop[last]).tolist()
        out = [ids[a:b] for a, b in zip([0, *stops], stops)]
        if self.spaced:
            heads = [_spaced_chunks(distinct[i]) if not s else [] for i, s in zip(at[first].tolist(), apart.tolist(), strict=True)]
            used = {x for h in heads for x in h}
            self._learn((), used)
            out = [b"".join([*[self.bare[x] for x in h], raw]) for h, raw in zip(heads, out, strict=True)]
            self._forget((), used)
        rows = np.flatnonzero(apart)
        if len(rows):
            for j, raw in zip(rows.tolist(), self._encode_apart(col.take(pa.array(rows)).to_pylist()), strict=True):
                out[j] = raw
        return out

    def _encode_apart(self, texts: list[str | None]) -> list[bytes]:
        """Texts one at a time: of any white space, and whole where needed."""
        split: list = []            # per text: (bare pieces, words, their ids as far as known), exact pieces, or None
        words: set[str] = set()     # not known yet
        bare: set[str] = set()
        known = self.words.get

        def look_up(w: list[str]) -> list[bytes | None]:
            got = list(map(known, w))
            if None in got:
                words.update([x for x, g in zip(w, got, strict=True) if g is None])
            return got

        for t in texts:
            if not t or _odd(t) or self.special and self._holds_added(t):
                split.append(None)
            elif not self.spaced:
                w = t.split()
                split.append(([], w, look_up(w)))
            elif _run(t):
                exact = [self._exact(c) for c in _spaced_chunks(t)]
                words.update([x for is_word, x in exact if is_word])
                bare.update([x for is_word, x in exact if not is_word])
                split.append(exact)
            else:
                first, *w = t.split(" ")
                b = _spaced_chunks(first)
                bare.update(b)
                if w and not w[-1]:                     # the text ends with a space
                    w.pop()
                    words.update(w)
                    bare.add(" ")
                    split.append([*[(False, x) for x in b], *[(True, x) for x in w], (False, " ")])
                else:
                    split.append((b, w, look_up(w)))
        self._learn(words, bare)
        out = []
        for t, s in zip(texts, split, strict=True):
            if s is None:
                out.append(self._direct([t])[0] if t else b"")
            elif isinstance(s, list):
                out.append(b"".join([(self.words if is_word else self.bare)[x] for is_word, x in s]))
            else:
                b, w, got = s
                if None in got:
                    got = [g if g is not None else self.words[x] for x, g in zip(w, got, strict=True)]
                out.append(b"".join([self.bare[x] for x in b] + got))
        self._forget(words, bare)
        return out


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}          # per worker process


def encoder(path: str, spaced: bool, special: bool = False) -> ChunkEncoder:
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = ChunkEncoder(path, spaced, special=special)
    return _ENCODERS[path, special]


def text_groups(texts: pa.Array, chars: int = 4_000_000) -> list[slice]:
    """Consecutive rows of at most ``chars`` bytes (one row at least), so
    that what is split at once stays bounded."""
    out, first, size = [], 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > first and size + n > chars:
            out.append(slice(first, i))
            first, size = i, 0
        size += n
    if first < len(texts):
        out.append(slice(first, len(texts)))
    return out
