"""Token ids of whole texts through a cache of space-led pieces.

A byte-level BPE tokenizer first cuts a text by a pattern in which a single space always starts a new
pre-token, unless white space stands on both of its sides; so does a punctuation mark after a letter or
digit, and a line end that stands alone is one. So a text can be cut there and each piece encoded alone, with the same ids as the
whole text; frequent pieces are encoded once.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable, Iterable

import numpy as np

from holdspan.llm.common import held

RUN = re.compile(r"\s\s")
SINGLE = re.compile(r"(?<=\S) (?=\S)")
# Letters that are letters in every version of Unicode; other scripts are cut at spaces alone.
MARK = re.compile(r"(?<=[0-9A-Za-zÀ-ÖØ-öø-ſ])(?=[.,;:!?])")
BARE = "\x01"  # begins a piece that was not cut at a space
LINE = f" {BARE}\n {BARE}"
LONGEST = 200  # characters of a piece worth keeping
TOGETHER = 200  # pieces encoded by one call
MOST = 800_000  # pieces in a cache, about 150 MB


def pieces(text: str) -> list[str]:
    """The pieces; each but the first is to be led by the space that it was cut at, or begins with ``BARE``."""
    if BARE in text:  # very rare: one piece
        return [text]
    marked = MARK.sub(" " + BARE, text)
    if RUN.search(text):
        return SINGLE.split(marked)
    # A line end without other white space beside it is a pre-token.
    return marked.replace("\n", LINE).split(" ")


def _whole(key: str) -> str:
    """What to encode for a piece: a leading space or ``BARE`` stands for having no space before it."""
    return key[1:] if key[:1] in (" ", BARE) else " " + key


def load(path: str):
    """The tokenizer, single threaded: a Spark task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class PieceCache:
    """Encodes texts by pieces: a given table first, then what this worker has met.

    ``value`` makes of a piece's ids (little-endian unsigned 32-bit numbers) what is kept. What the
    worker adds is dropped when ``most`` pieces are held, so memory is bounded whatever the corpus.
    """

    def __init__(self, path: str, value: Callable[[bytes], object], given: dict | None = None, most: int = MOST):
        self.tokenizer = load(path)
        self.value = value
        self.most = most
        self.given = given or {}
        self.held = dict(self.given)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        # Every character of a byte-level token stands for one byte.
        self.widths = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for token, number in vocab.items():
            self.widths[number] = len(token)
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _together(self, texts: list[str], between: str) -> list[bytes]:
        """Ids of each text, from one call for all of them joined.

        Tokens say how many bytes they stand for, which tells where each text ends; should a token reach
        over an end, the texts are encoded one by one.
        """
        found = self.tokenizer.encode_batch_fast([between.join(texts)], add_special_tokens=False)[0]
        ids = np.array(found.ids, "<u4")
        if len(ids) and ids.max() < len(self.widths):
            after = np.cumsum(self.widths[ids])
            gap = len(between)
            ends = np.cumsum([len(t.encode()) + gap for t in texts]) - gap
            starts = np.concatenate([[0], ends[:-1] + gap])
            last = np.searchsorted(after, ends)
            first = np.searchsorted(after, starts, "right")
            exact = after[np.minimum(last, len(after) - 1)] == ends
            exact &= (first == 0) | (after[first - 1] == starts)
            if exact.all():
                raw = ids.tobytes()
                return [raw[4 * i : 4 * j + 4] for i, j in zip(first.tolist(), last.tolist(), strict=True)]
        return list(map(self._one, texts))

    def encode(self, keys: list[str]) -> dict:
        """Values of the pieces, keyed as in ``texts``."""
        out, spaced, bare = {}, [], []
        for key in keys:
            if any(word in key for word in self.special):
                out[key] = self.value(self._one(_whole(key)))
            elif key[:1] not in (" ", BARE) and key:
                spaced.append(key)
            elif key[1:].isalnum():
                bare.append(key)
            else:
                out[key] = self.value(self._one(_whole(key)))
        # A space starts a pre-token; between letters or digits a line end is one.
        for some, between in ((spaced, ""), (bare, "\n")):
            for at in range(0, len(some), TOGETHER):
                part = some[at : at + TOGETHER]
                out.update(zip(part, map(self.value, self._together(list(map(_whole, part)), between)), strict=True))
        return out

    def texts(self, texts: Iterable[str]) -> list[list]:
        """For each text the values of its pieces, in order."""
        rows, late, missing = [], [], set()
        get = self.held.get
        for text in texts:
            parts = pieces(text)
            parts[0] = " " + parts[0]  # marks a piece without a space before it; no other starts with one
            values = list(map(get, parts))
            if None in values:
                late.append((len(rows), parts))
                missing.update(p for p, v in zip(parts, values, strict=True) if v is None)
            rows.append(values)
        if missing:
            new = self.encode(list(missing))
            for at, parts in late:
                rows[at] = [new[p] if v is None else v for p, v in zip(parts, rows[at], strict=True)]
            if len(self.held) + len(new) > self.most + len(self.given):
                self.held = dict(self.given)
            self.held.update((k, v) for k, v in new.items() if len(k) <= LONGEST)
        return rows


def cuts_at_spaces(path: str) -> bool:
    """Whether the file is a byte-level BPE that cuts texts as ``pieces`` relies on.

    Any other file may join what stands on both sides of a space, drop white space or change the text first.
    """
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    cutter, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    by_pattern = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True)
    plain = spec.get("normalizer") is None and not cutter.get("add_prefix_space", True)
    return bool(by_pattern and plain and model.get("type") == "BPE" and not model.get("dropout"))


class WholeCounter:
    """Token counts of whole texts, for files whose texts cannot be cut into pieces beforehand.

    ``.json`` files go through tokenizers, ``.model`` files through sentencepiece, ``.tiktoken`` files (ranks)
    through tiktoken with the pattern of the given vocabularies.
    """

    def __init__(self, path: str):
        self.count = self._counter(path)

    @staticmethod
    def _counter(path: str) -> Callable[[list[str]], list[int]]:
        if path.endswith(".json"):
            tokenizer = load(path)
            return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        if path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            encoding = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )
            return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
        raise ValueError(f"no library is known for the tokenizer file {os.path.basename(path)}")

    def texts(self, texts: Iterable[str]) -> list[list]:
        """For each text its count, alone in a list as ``PieceCache`` has those of its pieces."""
        return [[n] for n in self.count(list(texts))]


def worker_cache(path: str, given: dict | None = None) -> PieceCache | WholeCounter:
    """What this worker counts tokens with; it outlives a task. Whole texts are counted without a table of pieces."""
    if given is None:
        return held(("whole", path), lambda: WholeCounter(path))
    cache = held(("pieces", path), lambda: PieceCache(path, length))
    if cache.given is not given:
        cache.given = given
        cache.held.update(given)
    return cache


def length(ids: bytes) -> int:
    """Number of ids."""
    return len(ids) // 4




# Characters whose classes are the same in every version of Unicode, so that both libraries below cut
# a text at the same places.
PLAIN = re.compile(r"[^\t\n\r -~¡-¬®-ſ‐-‧€]")


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable characters of Latin-1 stand for themselves, the other bytes for characters from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class TextEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit numbers, without a cache.

    The vocabulary and merges come from the tokenizer's file. Texts of plain characters without special
    tokens go through a second library's encoder over the same vocabulary, which is several times
    faster and gives the same ids; all others, and any file of another build, through the tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._same_vocabulary()

    def _same_vocabulary(self):
        """An encoder by ranks, if the file is a byte-level BPE whose merges are in the order of its ids."""
        import public_tokenizers
        import tiktoken

        spec = json.loads(self.tokenizer.to_str())
        model, cutter = spec["model"], spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex")
        if model["type"] != "BPE" or not plain or cutter.get("add_prefix_space") or model.get("ignore_merges"):
            return None
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if sorted(vocab.values()) != list(range(len(vocab))) or [vocab["".join(p)] for p in pairs] != list(
            range(256, len(vocab))
        ):
            return None
        byte = byte_alphabet()
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items()}
        return tiktoken.Encoding(
            "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def ids(self, text: str) -> bytes:
        """The ids of a text."""
        if self.fast is None or PLAIN.search(text) or any(word in text for word in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def text_encoder(path: str) -> TextEncoder:
    """This worker's encoder."""
    return held(("texts", path), lambda: TextEncoder(path))
