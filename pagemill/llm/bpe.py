"""Byte-level BPE ids of whole texts, equal to those of ``tokenizers`` for a vocabulary file.

Texts of characters whose classes have long been settled go through ``tiktoken`` with the ranks of the same
vocabulary, which is several times as fast; all other texts go through ``tokenizers`` itself, since the two
libraries may follow different Unicode versions. So do texts with a very long run of white space, for which
``tiktoken``'s pattern runs out of its stack, and any other text that ``tiktoken`` gives up on.

``literals``: whether an added token's string in a text is that token, as ``tokenizers`` has it where nothing
is set; else its string is ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

import numpy as np

# Anything besides Latin, Greek and Cyrillic, usual punctuation and currency signs, kana, common Han and Hangul,
# and the older pictographs. Rare control characters count as unsettled white space.
_UNSETTLED = re.compile(
    "[^\\x00-\\x1b\\x20-\\x84\\x86-\\u04ff\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20b5\\u2190-\\u21ff\\u3001-\\u3003\\u3008-\\u3011\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3\\U0001f300-\\U0001f320\\U0001f600-\\U0001f640]"
)

# Runs of white space this long are measured, and those over the limit are left to ``tokenizers``.
_RUN, _LONGEST_RUN = re.compile(r"\s{64,}"), 50_000

# Fixed value: how byte-level BPE vocabularies of this kind cut a text into pieces.
_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes whole texts; one for each Python worker, vocabulary and setting."""

    _one: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, literals: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._whole.encode_special_tokens = not literals
        vocabulary = json.loads(self._whole.to_str())["model"]["vocab"]
        letters, added = _byte_letters(), {t.content for t in self._whole.get_added_tokens_decoder().values()}
        self._literals = sorted(added) if literals else []
        ranks = {bytes(letters[c] for c in word): k for word, k in vocabulary.items() if word not in added}
        self._ranks = tiktoken.Encoding("ranks", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def get(cls, path: str, literals: bool = False) -> Encoder:
        if (path, literals) not in cls._one:
            cls._one[path, literals] = cls(path, literals)
        return cls._one[path, literals]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; none for null and for the empty text."""
        return [self._ids(t) if t else b"" for t in texts]

    def _ids(self, text: str) -> bytes:
        if self._quick(text):
            try:
                return np.asarray(self._ranks.encode_to_numpy(text, disallowed_special=()), "<u4").tobytes()
            except ValueError:  # its pattern gave up; the text is not to blame
                pass
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _quick(self, text: str) -> bool:
        if any(x in text for x in self._literals):
            return False
        if not (text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f")) and _UNSETTLED.search(text):
            return False
        return len(text) <= _LONGEST_RUN or all(m.end() - m.start() <= _LONGEST_RUN for m in _RUN.finditer(text))


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable bytes stand for themselves, the rest from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
