"""Token ids by the tokenizers library, with each distinct piece of text encoded once in a while.

A text is cut only where every tokenizer here cuts too: at a single space between two characters that are
not white space. Words of natural text repeat, so most pieces come from a table of pieces seen before.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SAFE = re.compile(r"(?<=\S) (?=\S)")
_BREAK = ("\n",)
#: Texts with white space that isn't a single character between others, in RE2's terms.
_WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_UNEVEN = rf"\A{_WHITE}|{_WHITE}\z|{_WHITE}{_WHITE}"
#: Letters that no normaliser joins to anything, and ASCII marks but the apostrophe: marks after letters are cut off by every pattern.
_PLAIN = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")


_ASCII = set(map(chr, range(128)))


def _byte_letters() -> dict[str, str]:
    """How a byte-level vocabulary writes each letter beyond ASCII of ``_PLAIN``: a character for each UTF-8 byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    written = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {c: "".join(written[b] for b in c.encode()) for c in map(chr, range(0xC0, 0x100))}


class CachedEncoder:
    """Encodes texts into numpy arrays of ids.

    ``spaced``: pieces after the first carry their space (byte-level vocabularies). ``cache``: when so many pieces are
    remembered, they become the old table, which goes when a new one is full; pieces met again move to the new one.
    The ids are those of ``encode`` without special tokens for any text.
    """

    def __init__(self, path: str, spaced: bool, cache: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(self.tokenizer.get_added_tokens_decoder().items())
        self.mark_id, self.mark = added[0][0], added[0][1].content
        self.marks = [t.content for _, t in added]
        self.spaced, self.limit, self.space = spaced, cache, " " if spaced else ""
        self.known: dict[str | tuple, bytes] = {}
        self.old: dict[str | tuple, bytes] = {}
        self.letters, self.words = _byte_letters(), self._word_tokenizer(path)

    def _word_tokenizer(self, path: str):
        """The same model for words whose pieces are cut already, without the normaliser and the patterns; None if the file isn't of the kind.

        ``edge``: ids with which a word begins (byte-level vocabularies write its space in front) or ends (word ends are marked).
        """
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        with open(path) as f:
            made = json.load(f)
        suffix, first = made["model"].get("end_of_word_suffix"), made["pre_tokenizer"]
        if made["model"]["type"] != "BPE" or not (first.get("use_regex") and not made["normalizer"] if self.spaced else suffix):
            return None
        out = Tokenizer.from_file(path)
        out.normalizer, out.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocabulary = out.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.front = self._spelt(" ") if self.spaced else ""
        self.edge[[i for t, i in vocabulary.items() if (t.startswith(self.front) if self.spaced else t.endswith(suffix))]] = True
        return out

    def _spelt(self, text: str) -> str:
        from tokenizers import pre_tokenizers

        return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text)[0][0]

    def _plain(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, pieces: set[str | tuple]) -> None:
        """The ids of new pieces. Marks after letters are a token's text of their own, so letters and marks are learnt apart."""
        known, old, ends, need, letters = self.known, self.old, [], set(), []
        for p in pieces:
            alone = p.__class__ is tuple
            if not alone and p.isascii() and p.isalpha():
                letters.append(p)
                continue
            text = p[0] if alone else p
            word = text.rstrip(_MARKS)
            if not word.isalpha() or not (word.isascii() or _PLAIN.fullmatch(word)):
                need.add(p)
                continue
            key = (word,) if alone else word
            if len(word) < len(text):
                marks = (text[len(word) :],)
                ends.append((p, key, marks))
                need.add(marks)
                if key in known:
                    continue
                if key in old:
                    known[key] = old[key]
                    continue
            if alone:
                need.add(key)
            else:
                letters.append(word)
        letters = list(dict.fromkeys(letters))
        if self.words is None:
            need.update(letters)
        else:
            need.update(self._learn_words(letters))
        self._learn_any([p for p in need if p not in known])
        known.update((p, known[word] + known[marks]) for p, word, marks in ends)

    def _learn_words(self, words: list[str], size: int = 200) -> list[str]:
        """Learns words of plain letters, many in one text; returns those whose ends could not be told."""
        groups, texts, left = [words[i : i + size] for i in range(0, len(words), size)], [], []
        for part in groups:
            text = " ".join(part) if self.spaced else " ".join(part).lower()
            for c in sorted({*filter(str.isalpha, text)} - _ASCII, key="\u00c3".__ne__):  # that letter is in what others become
                text = text.replace(c, self.letters[c])
            texts.append(self.front + text.replace(" ", " " + self.front) if self.spaced else text)
        for part, found in zip(groups, self.words.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.asarray(found.ids, dtype="<u4")
            cut = 4 * np.flatnonzero(self.edge[ids])
            if len(cut) != len(part):
                left += part
                continue
            ends = [*cut.tolist()[1:], 4 * len(ids)] if self.spaced else (cut + 4).tolist()
            raw = ids.tobytes()
            self.known.update((p, raw[x:y]) for p, x, y in zip(part, [0, *ends[:-1]], ends, strict=True))
        return left

    def _learn_any(self, todo: list[str | tuple]) -> None:
        """Many pieces in one text, between marks that can stand in none of them."""
        known = self.known
        size = 64 if self.spaced else 4000  # what each kind of vocabulary is fastest with
        groups = [todo[i : i + size] for i in range(0, len(todo), size)]
        texts = [self.mark.join([p[0] if isinstance(p, tuple) else self.space + p for p in part]) for part in groups]
        for part, found in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.asarray(found.ids, dtype="<u4")
            cut = np.flatnonzero(ids == self.mark_id)
            raw, starts, stops = ids.tobytes(), [0, *(4 * (cut + 1)).tolist()], [*(4 * cut).tolist(), 4 * len(ids)]
            known.update((p, raw[x:y]) for p, x, y in zip(part, starts, stops, strict=True))

    def pieces(self, text: str, uneven: bool) -> list[str | tuple]:
        """What the text is cut into. With spaces, a piece that has none is a tuple: the first of the text or of a line.

        ``uneven``: some white space isn't a single character between others.
        """
        if uneven:
            words = _SAFE.split(text)
            return [(words[0],), *words[1:]] if self.spaced else words
        if not self.spaced:
            return text.replace("\n", " ").split(" ")
        out: list[str | tuple] = []
        for line in text.split("\n"):  # a line break between other characters is a token of its own
            if out:
                out.append(_BREAK)
            at = len(out)
            out += line.split(" ")
            out[at] = (out[at],)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null is as empty."""
        collecting = gc.isenabled()
        gc.disable()  # tables of millions of strings hold no circles, and going through them takes long
        try:
            return self._encode_batch(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > self.limit:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        found: list[list[bytes | None]] = []
        gaps: list[tuple[int, int, str | tuple]] = []
        for text, uneven in zip(texts, pc.match_substring_regex(pa.array(texts, pa.large_string()), _UNEVEN).to_pylist(), strict=True):
            if not text or any(m in text for m in self.marks):
                found.append([self._plain(text).tobytes() if text else b""])
                continue
            pieces = self.pieces(text, uneven)
            parts = list(map(known.get, pieces))
            if None in parts:
                gaps += [(len(found), i, pieces[i]) for i, x in enumerate(parts) if x is None]
            found.append(parts)
        new = {p for _, _, p in gaps}
        known.update((p, old[p]) for p in new if p in old)
        self._learn(new.difference(known))
        for row, i, p in gaps:
            found[row][i] = known[p]
        return [np.frombuffer(b"".join(x), dtype="<u4") for x in found]


@functools.cache
def encoder(path: str, spaced: bool) -> CachedEncoder:
    """This process's encoder: a Python worker keeps what it has learnt from one task to the next."""
    return CachedEncoder(path, spaced)


def batches_of(texts: list, chars: int = 400_000):
    """(from, to): runs of texts of about so many characters, one text at least."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > chars:
            yield at, i
            at, size = i, 0
        size += len(text or "")
    if at < len(texts):
        yield at, len(texts)


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
