"""Token ids of the tokenizers library, for whole columns of texts.

A byte-level vocabulary whose ids follow the order of its merges is the same thing as a table of ranks, which the
tiktoken library encodes with several times faster and without any state between texts. Whether a tokenizer file is
such a vocabulary is checked when it is read, merge by merge. Every other tokenizer, and the few texts
described at :func:`chunk_encoder`, go through the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import tiktoken
from tokenizers import Tokenizer

LONG = 10_000
_SPACE_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_LONG_SPACE = re.compile(rf"\s{{{LONG}}}")
#: Fixed value: how byte-level models of this family cut a text before merging.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def chunks_of(text: str) -> list[str]:
    """Pieces that together are the text; every cut lies before a space that follows a non-space.

    A byte-level model never merges across such a place.
    """
    if "\0" in text or text.startswith(" ") or _SPACE_AFTER_SPACE.search(text):
        return _CUT.split(text)
    return text.replace(" ", "\0 ").split("\0")


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranks, or None if the file is no byte-level model whose ids follow its merges."""
    model, cutter = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
    cut = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
    if not (plain and cut and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")):
        return None
    letters, vocab = _byte_letters(), model["vocab"]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocab.get(left + right) for left, right in merges]
    if None in made or made != sorted(set(made)) or len(vocab) - len(special & vocab.keys()) != len(made) + 256:
        return None
    single = [vocab.get(x) for x in letters]
    if None in single or made and max(single) > made[0]:
        return None
    return {bytes(letters[x] for x in piece): n for piece, n in vocab.items() if piece not in special}


def chunk_encoder(tokenizer_path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """A function that turns texts into arrays of unsigned 32-bit ids, without special tokens added.

    Texts that hold the string of a special token, and texts with ten thousand white-space characters in a row,
    are left to the tokenizers library also when the vocabulary is a table of ranks.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    loaded: list[Tokenizer] = []

    def tokenizer() -> Tokenizer:
        if not loaded:
            loaded.append(Tokenizer.from_file(tokenizer_path))
            loaded[0].no_truncation()
            loaded[0].no_padding()
        return loaded[0]

    ranks = ranks_of(spec)
    if ranks is None:
        return lambda texts: [np.asarray(e.ids, "<u4") for e in tokenizer().encode_batch_fast(texts, add_special_tokens=False)]
    special = [t["content"] for t in spec.get("added_tokens", [])]
    fast = tiktoken.Encoding("ranks", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(text: str) -> list[int]:
        return tokenizer().encode(text, add_special_tokens=False).ids

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            ids = whole(text)
        elif len(text) >= LONG and _LONG_SPACE.search(text):
            ids = [i for chunk in chunks_of(text) for i in whole(chunk)]
        else:
            ids = fast(text)
        return np.frombuffer(array("I", ids), "<u4")

    return lambda texts: [encode(t) for t in texts]
