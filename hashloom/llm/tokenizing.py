"""Byte-level BPE by the tokenizers library, with a bounded cache of space-led chunks.

A pre-token of the byte-level pattern never spans the place between a
character that is not white space and a space that leads another such
character, so a text can be cut there and each chunk encoded by itself. Most
chunks repeat; each worker keeps their ids, up to ``CACHE`` chunks.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
import re

import numpy as np

CACHE = 450_000
GROUP = 50
BARE = "\x01"
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: White space other than spaces and newlines.
_RARE = re.compile(r"[\t\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

_SPACES = frozenset(chr(i) for i in range(0x3001) if chr(i).isspace())


def _plain(text: str) -> bool:
    """Only single spaces and newlines, each between other characters; no ``BARE`` and no special token."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or BARE in text or "<|" in text or text[0] in " \n" or text[-1] in " \n" or _RARE.search(text))



def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_chars() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    own = set(printable)
    return [chr(b if b in own else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def from_ranks(ranks: dict[bytes, int], pattern: str):
    """A tokenizers.Tokenizer with the ids of a rank table.

    The rank table joins any two neighbours whose bytes together are a token,
    lowest rank first. Here each way to halve a token is a merge, in order of the
    token's rank and then of the place of the cut; a piece that is a token is
    taken whole.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    chars = byte_chars()
    name = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        for cut in range(1, len(token)):
            left, right = name.get(token[:cut]), name.get(token[cut:])
            if left is not None and right is not None:
                merges.append((left, right))
    made = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    made.decoder = decoders.ByteLevel()
    return made


class Memo:
    """What has been worked out for words, in two generations: what isn't asked for again is forgotten."""

    def __init__(self, limit: int):
        self.limit, self.now, self.old = limit, {}, {}

    def missing(self, wanted: set[str]) -> list[str]:
        """The words to be added to ``now``; all other wanted words are there afterwards."""
        gone = wanted - self.now.keys()
        if len(self.now) + len(gone) > self.limit:
            self.old, self.now, gone = self.now, {}, wanted
        for word in gone & self.old.keys():
            self.now[word] = self.old[word]
        return list(gone - self.old.keys())


def tidy() -> None:
    """Give back memory that a task no longer uses: workers live on."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    ``lengths`` has the number of bytes that each id stands for. Chunks are known
    by the text after their space; one without a space is marked by ``BARE``.
    """

    def __init__(self, tokenizer, lengths: np.ndarray, cache: int = CACHE):
        self.tokenizer, self.lengths, self.memo = tokenizer, lengths, Memo(cache)

    @staticmethod
    def chunks(text: str) -> list[str]:
        if not text:
            return []
        if _plain(text):
            return (BARE + text.replace("\n", f" {BARE}\n {BARE}")).split(" ")
        return [x[1:] if x[0] == " " and len(x) > 1 and x[1] != BARE else BARE + x for x in _CUT.split(text)]

    def _learn(self, new: list[str]) -> None:
        known = self.memo.now
        words = [c for c in new if c[0] != BARE and c[-1] not in _SPACES]
        for at in range(0, len(words), GROUP * 200):  # a group's words are encoded as one text, then parted by their bytes
            some = words[at : at + GROUP * 200]
            groups = [" " + " ".join(some[i : i + GROUP]) for i in range(0, len(some), GROUP)]
            ids = np.fromiter(itertools.chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)), dtype="<u4")
            upto = np.cumsum(np.fromiter(map(len, some), dtype=np.int64, count=len(some)) + 1)
            whole = "".join(groups)
            if not whole.isascii():
                points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
                upto = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))[upto - 1]
            ends = (4 * np.searchsorted(np.cumsum(self.lengths[ids]), upto, side="left") + 4).tolist()
            body = ids.tobytes()
            known.update(zip(some, [body[i:j] for i, j in zip([0, *ends], ends)]))
        bare = [c for c in new if c[0] == BARE or c[-1] in _SPACES]
        texts = [c[1:] if c[0] == BARE else " " + c for c in bare]
        for c, e in zip(bare, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            known[c] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.chunks(t) for t in texts]
        self._learn(self.memo.missing(set().union(*cut)))
        get = self.memo.now.__getitem__
        return [b"".join(map(get, chunks)) for chunks in cut]


def _single_thread() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


@functools.lru_cache(maxsize=2)
def json_encoder(path: str) -> Encoder:
    _single_thread()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    lengths = np.zeros(tokenizer.get_vocab_size(), dtype=np.int64)
    for token, i in tokenizer.get_vocab().items():
        lengths[i] = len(token)
    return Encoder(tokenizer, lengths)


@functools.lru_cache(maxsize=2)
def rank_encoder(path: str, pattern: str) -> tuple[Encoder, list[bytes]]:
    """The encoder of a rank file, and the bytes of each id."""
    _single_thread()
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return Encoder(from_ranks(ranks, pattern), np.array([len(t) for t in table])), table


def forget_encoders() -> None:
    """For tasks that don't encode: what their worker kept of earlier ones' encoders goes."""
    if json_encoder.cache_info().currsize or rank_encoder.cache_info().currsize:
        json_encoder.cache_clear()
        rank_encoder.cache_clear()
        tidy()


def text_slices(texts, most: int = 4_000_000):
    """Index ranges of ``texts`` (None: empty) of about ``most`` characters each."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
