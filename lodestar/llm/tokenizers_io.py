"""Public tokenizer files. Paths are parameters; nothing is copied into the repository."""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@functools.lru_cache(maxsize=4)
def library(path: str):
    """The library's tokenizer for a .json or .model file as a function str -> list of ids."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: model.encode(text, num_threads=1)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@functools.lru_cache(maxsize=4)
def splits_at_space(path: str) -> bool:
    """Whether the tokenizer is plain byte-level BPE, for which texts may be encoded by white-space units."""
    if not path.endswith(".json"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    added = all(not any(c.isspace() for c in t["content"]) and not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") for t in spec.get("added_tokens", []))
    return bool(plain and added and not spec.get("normalizer"))


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible ones stand for themselves, the rest count up from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=4)
def same_by_ranks(path: str):
    """The .json's byte-level BPE as ranks, which give the same ids several times faster.

    None where they might not: if the ids aren't in order of the merges, or if a vocabulary entry isn't what its own
    bytes merge to (a rank encoder takes such an entry whole, the library never does). Then the library encodes.
    """
    import json

    import public_tokenizers
    import tiktoken

    from lodestar.llm.bpe import greedy

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], _byte_letters()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ids = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("ignore_merges") or ids != sorted(ids):
        return None
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    if any(len(greedy(token, ranks)) > 1 for token in ranks):
        return None
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return encoding.encode(text, allowed_special="all")
        return encoding.encode_ordinary(text)

    return encode


@functools.lru_cache(maxsize=4)
def unit_encoder(path: str, count_only: bool):
    """text -> number of tokens, or ids as little-endian unsigned 32-bit bytes; the ids are those of the library.

    By ranks a text is encoded whole, which takes less time than looking its units up. The library is slower than that,
    so there a text goes by units with a cache, where the tokenizer allows it.
    """
    from lodestar.llm.units import UnitEncoder

    by_units = splits_at_space(path)
    by_ranks = by_units and same_by_ranks(path)
    encode = by_ranks or library(path)

    def one(s: str):
        ids = encode(s)
        return len(ids) if count_only else array("I", ids).tobytes()

    if by_ranks or not by_units:
        return lambda text: one(text or "")
    parts = UnitEncoder(one).parts
    return (lambda text: sum(parts(text))) if count_only else (lambda text: b"".join(parts(text)))


@functools.lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
