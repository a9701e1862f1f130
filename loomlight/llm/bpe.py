"""Byte-level BPE from a public tokenizer file, by the fastest engine that gives its ids."""

from __future__ import annotations

import json
import re

_DOUBLE = re.compile(r"\s\s")
#: Fixed value: the split pattern of byte-level BPE, and the alternative that looks ahead.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOOKS_AHEAD = r"\s+(?!\S)|"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read(path: str | None) -> bytes:
    with open(path or default_path(), "rb") as f:
        return f.read()


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(raw: bytes):
    """A function text -> list of ids, those of `tokenizers` with add_special_tokens=False.

    Texts that hold the string of a special token go to that library. Texts without two adjoining white-space characters are split by the pattern
    without its look-ahead, which then can't match anything else."""
    spec = json.loads(raw)
    letters = _byte_letters()
    pre = spec.get("pre_tokenizer") or {}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    if spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True):
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if merged == sorted(merged) and all(c in letters for t in vocab for c in t):
            import tiktoken

            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
            whole = tiktoken.Encoding("whole", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            plain = tiktoken.Encoding("plain", pat_str=SPLIT.replace(LOOKS_AHEAD, ""), mergeable_ranks=ranks, special_tokens={})
            slow = []

            def encode(text: str) -> list[int]:
                if any(t in text for t in special):
                    if not slow:
                        slow.append(with_offsets(raw))
                    return slow[0].encode(text, add_special_tokens=False).ids
                return (whole if _DOUBLE.search(text) else plain).encode_ordinary(text)

            return encode
    tokenizer = with_offsets(raw)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def splits_turns(raw: bytes) -> bool:
    """Whether no piece goes on from a line break to a sign, so that texts can be encoded apart there."""
    spec = json.loads(raw)
    pre = spec.get("pre_tokenizer") or {}
    return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")


def with_offsets(raw: bytes):
    """The tokenizer itself, which also gives character offsets."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(raw.decode())
