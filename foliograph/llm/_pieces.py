"""What piece tokenizers share: the vocabulary file, its normalisation, and cutting text where no piece can reach across.

Two neighbouring characters that no piece holds side by side can never end up in one token. Text between such places is
tokenised by itself, with the same result as in the whole, and repeated stretches come from a bounded cache.
"""

from __future__ import annotations

import re
from collections.abc import Callable

SPACE = "▁"
#: Bytes of a cache, about.
CACHE_BYTES = 64 << 20
#: What a dictionary's slot, the head of a key and that of its value take, about.
ENTRY_BYTES = 200


class BoundedCache(dict):
    """Results by text. One that would grow beyond its bytes is emptied, so a worker's memory stays bounded whatever the texts are."""

    def __init__(self, most: int = CACHE_BYTES):
        super().__init__()
        self.most, self.held = most, 0

    def room(self, keys: list[str], sizes: int = 0) -> bool:
        """Count in these keys and values of together ``sizes`` bytes. If they don't fit, the cache is emptied, nothing is counted, and False."""
        more = ENTRY_BYTES * len(keys) + 2 * sum(map(len, keys)) + sizes
        if self and self.held + more > self.most:
            self.clear()
            self.held = 0
            return False
        self.held += more
        return True


class Computed(BoundedCache):
    """A value that is asked for and isn't there is computed."""

    def __init__(self, most: int, compute: Callable[[str], bytes | int]):
        super().__init__(most)
        self.compute = compute

    def __missing__(self, text: str) -> bytes | int:
        value = self.compute(text)
        self.held += ENTRY_BYTES + 2 * len(text) + (len(value) if type(value) is bytes else 0)
        if self.held > self.most:
            self.clear()
            self.held = 0
        self[text] = value
        return value


class Vocabulary:
    """Pieces, ids and scores of a sentencepiece model file."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.ids[piece], self.scores[piece] = i, sp.get_score(i)
        self.unknown_id, self.end_id = sp.unk_id(), sp.eos_id()
        self.pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.longest = max(map(len, self.ids), default=1)
        # Stretches start at a run of spaces or stand alone at a newline, if no piece reaches across these.
        inside = any(p[k] != SPACE and p[k + 1] == SPACE for p in self.ids for k in range(len(p) - 1))
        newline = any("\n" in p and len(p) > 1 for p in self.ids)
        own = "" if newline else "\n"
        self.stretch = None if inside else re.compile(rf"{SPACE}*[^{SPACE}{own}]+|{SPACE}+" + (r"|\n" if own else "")).findall
        probe = "  Ab́ ﬁ\t x  \n　y "
        self.plain = sp.normalize(probe) == SPACE + probe.replace(" ", SPACE)

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return SPACE + text.replace(" ", SPACE) if self.plain else self.sp.normalize(text)

    def stretches(self, text: str) -> list[str]:
        norm = self.normalise(text)
        return self.stretch(norm) if self.stretch else [norm]

    def cut(self, stretch: str) -> list[str]:
        """Parts of a stretch between characters that no piece holds side by side."""
        pairs, parts, begin = self.pairs, [], 0
        for k in range(1, len(stretch)):
            if stretch[k - 1 : k + 1] not in pairs:
                parts.append(stretch[begin:k])
                begin = k
        parts.append(stretch[begin:])
        return parts

    def fallback(self, symbol: str) -> tuple[int, ...]:
        """Ids of a character outside the vocabulary."""
        if self.byte_ids:
            return tuple(self.byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass"))
        return (self.unknown_id,)
