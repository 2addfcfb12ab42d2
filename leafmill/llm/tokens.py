"""Exact tokenisation of whole texts at low cost, and token counts of huge texts by overlap resynchronisation.

A tokenizer whose pre-tokenizer never matches white space, and whose normalizer works character by
character, encodes a text as the concatenation of what it gives for the pieces between blanks. Those
pieces repeat, so a bounded memo of them saves most of the work; every piece that isn't in the memo
goes through the library. Other tokenizers encode each text (or chunk) as a whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bounds of the memo: pieces held, and the longest piece that is worth holding.
MEMO_PIECES, MEMO_CHARS = 400_000, 48
_BLANKS = str.maketrans("\t\n\r", "   ")
_PIECE = re.compile(r"[^ \t\n\r]+")
#: A word of Latin-1 letters with signs behind it or not.
_LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


def _byte_chars() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_chars()
#: The pre-tokenizer of which the module's docstring speaks; fixed values of that tokenizer's file.
_DROPS_BLANKS = {"type": "Split", "behavior": "Removed", "invert": True}
_CHARWISE = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})


def _separable(spec: dict) -> bool:
    """True if pieces between blanks can be encoded alone."""
    norm = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    pre = spec.get("pre_tokenizer") or {}
    norms = norm["normalizers"] if norm.get("type") == "Sequence" else [norm]
    pres = pre["pretokenizers"] if pre.get("type") == "Sequence" else [pre]
    first = {k: v for k, v in pres[0].items() if k != "pattern"} if pres else {}
    added = spec.get("added_tokens", [])
    return (
        all(n in _CHARWISE for n in norms)
        and first == _DROPS_BLANKS
        and "\\s+" not in pres[0]["pattern"].get("Regex", "\\s+")
        and all(p["type"] == "ByteLevel" and not p.get("use_regex") and not p.get("add_prefix_space") for p in pres[1:])
        and not any(re.search(r"\s", a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
    )


class Encoder:
    """Ids of whole texts as the library for `path` gives them, without begin, end or added special tokens."""

    def __init__(self, path: str):
        self.memo: dict[str, bytes] = {}
        self.counts: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            self.sp, self.tok, self.alone = sentencepiece.SentencePieceProcessor(model_file=path), None, False
            self.size = self.sp.vocab_size()
        else:
            from tokenizers import Tokenizer

            self.sp, self.tok = None, Tokenizer.from_file(path)
            self.tok.no_truncation()
            self.tok.no_padding()
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.alone = _separable(spec)
            # lower-case words of Latin-1 letters pass such a normalizer and byte-level pre-tokenizer unchanged
            self.direct = self.alone and {"type": "Lowercase"} in spec["normalizer"].get("normalizers", []) and any(p["type"] == "ByteLevel" for p in spec["pre_tokenizer"].get("pretokenizers", [])) and "\\p{L}]+" in spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.signs: dict[str, bytes] = {}
            self.size = max(self.tok.get_vocab(with_added_tokens=True).values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    def _library(self, texts: list[str]) -> list[list[int]]:
        if self.sp is not None:
            return self.sp.encode(texts, num_threads=1)
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of a lower-case word by the library's model alone: it is one pre-token and stays as it is."""
        raw = self.memo.get(word)
        if raw is None:
            shown = word if word.isascii() else "".join(map(_BYTES.__getitem__, word.encode()))
            raw = np.array([t.id for t in self.tok.model.tokenize(shown)], self.dtype).tobytes()
            if len(self.memo) < MEMO_PIECES and len(word) <= MEMO_CHARS:
                self.memo[word] = raw
        return raw

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Encode unseen pieces; those that don't fit the memo come back in a map of their own."""
        rest, other = {}, []

        def put(piece, raw):
            if len(self.memo) < MEMO_PIECES and len(piece) <= MEMO_CHARS:
                self.memo[piece] = raw
            else:
                rest[piece] = raw

        for piece in pieces:
            m = _LATIN.fullmatch(piece) if self.direct else None
            if m is None:
                other.append(piece)
                continue
            word, signs = m.groups()
            raw = self._word(word.lower())
            if signs:
                if signs not in self.signs:
                    self.signs[signs] = np.array(self._library([signs])[0], self.dtype).tobytes()
                raw += self.signs[signs]
            put(piece, raw)
        for i in range(0, len(other), 2000):
            part = other[i : i + 2000]
            for piece, ids in zip(part, self._library(part)):
                put(piece, np.asarray(ids, self.dtype).tobytes())
        return rest

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of ids for each text."""
        if not self.alone:
            return [np.asarray(x, self.dtype) for x in self._library(texts)]
        split = [t.translate(_BLANKS).split(" ") if "\t" in t or "\r" in t else t.replace("\n", " ").split(" ") for t in texts]
        new = [p for p in set().union(*split) if p not in self.memo]
        rest = self._learn(new) if new else {}
        memo = self.memo
        memo.update(rest)
        out = [np.frombuffer(b"".join(map(memo.__getitem__, s)), self.dtype) for s in split]
        for piece in rest:
            del memo[piece]
        return out

    def spans(self, chunk: str) -> tuple[np.ndarray, np.ndarray, int]:
        """(starts, before, total): stable boundaries of a chunk, the tokens before each, and all its tokens.

        A boundary is stable where a pre-token begins behind a blank: what comes before it can't change
        what comes behind it. The last pre-token of a chunk may be cut, its start is still a boundary.
        """
        if self.alone:
            found = [(m.start(), m[0]) for m in _PIECE.finditer(chunk)]
            new = [p for p in {p for _, p in found} if p not in self.memo]
            rest = self._learn(new) if new else {}
            w = self.dtype.itemsize
            n = np.fromiter((len(self.memo[p] if p in self.memo else rest[p]) // w for _, p in found), np.int64, len(found))
            before = np.concatenate([[0], np.cumsum(n)])
            return np.fromiter((s for s, _ in found), np.int64, len(found)), before[:-1], int(before[-1])
        e = self.tok.encode(chunk, add_special_tokens=False)
        at, word = e.offsets, e.word_ids
        keep = [i for i in range(1, len(at)) if word[i] is not None and word[i - 1] is not None and word[i] != word[i - 1] and 0 < at[i][0] and at[i - 1][1] <= at[i][0] and (chunk[at[i][0]].isspace() and not chunk[at[i][0] - 1].isspace())]
        return np.array([at[i][0] for i in keep], np.int64), np.array(keep, np.int64), len(at)

    def count(self, text: str, chunk: int, overlap: int) -> tuple[int, int, int]:
        """(tokens, chunks, widenings) of a text of any length.

        The text is encoded in chunks of `chunk` characters that overlap by `overlap`. Two neighbours are
        spliced at a boundary that is stable in both; while they share none the overlap doubles, at last
        to the whole rest of the text, which is then encoded in one piece.
        """
        if self.sp is not None or len(text) <= chunk:
            if self.alone:
                return len(self.encode([text])[0]), 1, 0
            return len(self._library([text])[0]), 1, 0
        total = from_tokens = chunks = widened = 0
        begin, end = 0, chunk
        starts, before, n = self.spans(text[begin:end])
        while True:
            chunks += 1
            if end >= len(text):
                return total + n - from_tokens, chunks, widened
            over = overlap
            while True:
                nxt = max(begin + 1, end - over)
                to = min(len(text), nxt + max(chunk, 2 * over))
                s2, b2, n2 = self.spans(text[nxt:to])
                # at nxt itself a piece may have been cut, and the right chunk's own last piece is no witness
                left = {int(s) + begin: int(b) for s, b in zip(starts, before) if b >= from_tokens and s + begin > nxt}
                common = next(((int(s) + nxt, int(b)) for s, b in zip(s2, b2) if s > 0 and int(s) + nxt in left), None)
                if common or nxt == begin + 1:
                    break
                over, widened = over * 2, widened + 1
            if common is None:  # no stable boundary in the whole chunk: encode it again, twice as long
                end, widened = min(len(text), begin + 2 * (end - begin)), widened + 1
                starts, before, n = self.spans(text[begin:end])
                chunks -= 1
                continue
            at, from_right = common
            total += left[at] - from_tokens
            begin, end, starts, before, n, from_tokens = nxt, to, s2, b2, n2, from_right


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
