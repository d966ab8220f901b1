"""Whole texts to token ids through the pieces between spaces.

The pattern of byte-level vocabularies never lets a token cross from a non-space to the
space after it. A text can so be cut before every space that follows a non-space; each
distinct piece is encoded once and kept in a bounded table of its worker.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import islice

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Pieces that a worker keeps.
KEPT = 700_000


class Coder:
    """``encode`` takes a list of strings and gives each one's ids as bytes, in order."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], kept: int = KEPT):
        self.encode, self.kept = encode, kept
        # A piece that ends in white space stands for no fixed ids: what follows decides.
        self.pieces: dict[str, bytes | None] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        known = self.pieces
        if len(known) > self.kept:
            known.clear()
        cut = [t.split(" ") for t in texts]
        missing = set().union(*(islice(parts, 1, None) for parts in cut)).difference(known)
        open_ended = [m for m in missing if not m or m[-1].isspace()]
        closed = list(missing.difference(open_ended))
        known.update(dict.fromkeys(open_ended))
        first = [parts[0] for parts in cut]
        ids = self.encode([" " + m for m in closed] + first)
        known.update(zip(closed, ids, strict=False))
        out = []
        for text, parts, start in zip(texts, cut, ids[len(closed) :], strict=True):
            if parts[0] and parts[0][-1].isspace():
                out.append(None)
                continue
            try:
                out.append(start + b"".join(map(known.__getitem__, islice(parts, 1, None))))
            except TypeError:  # one of them is open-ended
                out.append(None)
        whole = [t for t, o in zip(texts, out, strict=True) if o is None]
        rest = iter(self.encode(whole) if whole else [])
        return [next(rest) if o is None else o for o in out]


# Letters, digits and signs that every pattern engine takes alike.
_PLAIN = re.compile("[\n\t\r -~\u00a1-\u024f]*")


def _encoded(tokenizer: Tokenizer, texts: list[str]) -> list[bytes]:
    out = []
    for at in range(0, len(texts), 4096):
        some = tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)
        out += [np.array(e.ids, np.uint16).tobytes() for e in some]
    return out


def file_coder(path: str, pieces: Coder) -> Callable[[list[str]], list[bytes]]:
    """The ids of the ``tokenizers`` file at ``path`` by its own rules, as unsigned 16-bit numbers.

    A text that holds an added token's string goes to tokenizers whole, all others to ``pieces``.
    """
    with open(path) as lines:
        added = [t["content"] for t in json.load(lines).get("added_tokens", [])]
    # Made when a text needs it.
    own: list[Tokenizer] = []

    def encode(texts: list[str]) -> list[bytes]:
        held = [any(a in t for a in added) for t in texts]
        if not any(held):
            return pieces(texts)
        if not own:
            own.append(Tokenizer.from_file(path))
        whole = iter(_encoded(own[0], [t for t, h in zip(texts, held, strict=True) if h]))
        rest = iter(pieces([t for t, h in zip(texts, held, strict=True) if not h]))
        return [next(whole if h else rest) for h in held]

    return encode


def vocabulary_coder(path: str) -> Coder:
    """A coder of ordinary text with the ids of the ``tokenizers`` file at ``path``, as unsigned 16-bit numbers.

    If the file is byte-level BPE whose merges come in the order of ids, strings of Latin
    script are merged by tiktoken over the same vocabulary, several times as fast; all other
    strings, and all of any other file, go to tokenizers.
    """
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # file_coder takes texts that hold their strings
    if tokenizer.get_vocab_size() > 65536:
        raise ValueError("ids must stay under 65536")
    ranks = _ranks(path)
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def encode(texts: list[str]) -> list[bytes]:
        if fast is None:
            return _encoded(tokenizer, texts)
        one = fast.encode_ordinary
        out = [np.array(one(t), np.uint16).tobytes() if _PLAIN.fullmatch(t) else None for t in texts]
        rest = iter(_encoded(tokenizer, [t for t, o in zip(texts, out, strict=True) if o is None]))
        return [next(rest) if o is None else o for o in out]

    return Coder(encode)


def _ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as ranks by bytes, if merges by rank are what the file describes."""
    with open(path) as lines:
        file = json.load(lines)
    model, cut = file["model"], file.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or file.get("normalizer") or cut.get("type") != "ByteLevel":
        return None
    if cut.get("add_prefix_space") or not cut.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges"):
        return None
    # Byte-level files write a byte as a character of its own: printable ones as themselves,
    # the others in turn from U+0100.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in file.get("added_tokens", [])}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if made != sorted(made) or len(set(made)) != len(made) or min(made, default=256) < 256:
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
