"""Token ids of many texts through the tokenizers library, each distinct space-separated piece encoded once per worker."""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from functools import lru_cache
from itertools import count, islice

import numpy as np

#: Pieces a worker remembers before it starts afresh (and of their parts; about 210 MB), and where it keeps no parts beside them, when a larger cache saves nothing.
CACHE_PIECES, CACHE_PLAIN = 750_000, 500_000
#: Fixed value: a control character that marks a piece with no space before it.
_BARE = "\x02"
#: Texts with these are encoded whole: white space beside white space or at an end, and the mark.
_ODD_SPACED = re.compile(r"[ \n][\s\x1c-\x1f]|[ \n]\Z|\x02")
#: White space but space and line end, and the mark: texts without these have odd spacing only if a piece between spaces is empty.
_OTHER_SPACE = [_BARE, *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]
#: Where white space is dropped: the mark, and what Python but not the library takes for white space.
_ODD_LOOSE = re.compile(r"[\x02\x1c-\x1f]")


#: Pieces of these characters only (ASCII but the apostrophe, and letters of Latin-1) are cut further: runs of letters, digits, and runs of others are pre-tokens.
_PLAIN = re.compile(r"[ !-&(-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*\Z")
_RUNS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9 ]|[^a-z0-9 \xdf-\xf6\xf8-\xff]+")


def _numbers() -> defaultdict:
    """A dictionary that gives each new key the next number."""
    return defaultdict(count().__next__)


def _newest(numbers: defaultdict, known: int) -> list[str]:
    """The keys numbered known and higher, in order."""
    return list(islice(reversed(numbers), len(numbers) - known))[::-1]


class Encoder:
    """Same ids as Tokenizer.encode(text, add_special_tokens=False), so an added token's string in a text is that token.

    For a byte-level pattern whose pieces take at most one leading space, a space or line end between two non-spaces starts a new
    pre-token, and the line end is one by itself. Where the pattern drops white space, any is a cut. Other texts, and those that may hold an added token's string, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads of the library would spin
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        marks = [max(re.split(r"[\w\s]+", t), key=len) for t in added]  # what no normalizer changes, and is soon looked for
        self.marks = sorted({m for m in marks if m})
        unmarked = [re.escape(t) for t, m in zip(added, marks, strict=True) if not m]
        self.unmarked = re.compile("|".join(unmarked), re.I).search if unmarked else None
        kind = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["type"]
        if kind not in ("ByteLevel", "Sequence"):
            raise ValueError(f"no rule for cutting texts for pre-tokenizer {kind}")
        self.lead = " " if kind == "ByteLevel" else ""
        if self.lead:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
            for token, i in vocabulary.items():
                self.width[i] = len(token)  # a character for each byte
        else:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a pre-token
            for token, i in vocabulary.items():
                self.last[i] = token.endswith("</w>")
        self.parts = _numbers()
        self.reset()

    def reset(self, whole: bool = False) -> None:
        """Forget the pieces; their parts too where those are many, or if all is to go."""
        if whole or self.lead or len(self.parts) > CACHE_PIECES or not self.parts:
            self.parts = _numbers()
            self.part_pool = np.zeros(1 << 18, dtype=np.uint32)
            self.part_at, self.part_size = (np.zeros(1 << 16, dtype=np.int32) for _ in range(2))
            self.part_used = self.part_learnt = 0
            if not self.lead:
                self._keep([" "], np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64))  # number 0: what parts pieces
        self.known = self.parts if self.lead else _numbers()
        self.pool = np.zeros(1 << 18, dtype=np.uint32)
        self.at, self.size = (np.zeros(1 << 16, dtype=np.int32) for _ in range(2))
        self.used = self.learnt = 0

    def _ids(self, texts: list[str]) -> np.ndarray:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.array(x, dtype=np.uint32) for x in ids]) if ids else np.zeros(0, dtype=np.uint32)

    def _keep(self, parts: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """Note the ids of the next parts; size: how many each has."""
        for part in parts:
            self.parts[part]
        self.part_pool, self.part_at, self.part_size, self.part_used = _stored(self.part_pool, self.part_at, self.part_size, self.part_used, self.part_learnt, ids, np.cumsum(size) - size, size)
        self.part_learnt += len(size)

    def _learn(self) -> None:
        """Encode what is new: parts by the library, pieces from their parts, in the order of their numbers. Where spaces count, pieces are the parts."""
        if self.lead:
            self._learn_spaced()
            self.pool, self.at, self.size = self.part_pool, self.part_at, self.part_size
            return
        new = _newest(self.known, self.learnt)
        if not new:
            return
        text = " ".join(new).lower()  # as the tokenizer does, for these characters
        odd: list[int] = []
        plain = new
        if not _PLAIN.match(text):
            odd = [i for i, p in enumerate(new) if not _PLAIN.match(p.lower())]
            plain = [p for i, p in enumerate(new) if i not in set(odd)] if len(odd) < 50 else [p for p in new if _PLAIN.match(p.lower())]
            text = " ".join(plain).lower()
        runs = _RUNS.findall(text)
        k = np.fromiter(map(self.parts.__getitem__, runs), dtype=np.int64, count=len(runs))
        fresh = _newest(self.parts, self.part_learnt)
        for i in range(0, len(fresh), 2000):
            part = fresh[i : i + 2000]
            ids = self._ids([" ".join(part)])
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part) or int(ends[-1]) != len(ids):
                raise RuntimeError("parts were joined by the tokenizer")
            self._keep([], ids, np.diff(ends, prepend=0))
        counts = np.diff(np.concatenate(([-1], np.flatnonzero(k == 0), [len(k)]))) - 1 if plain else np.zeros(0, dtype=np.int64)
        k = k[k != 0]
        if odd:  # whole, each a part of its own
            own = [e.ids for e in self.tokenizer.encode_batch_fast([new[i] for i in odd], add_special_tokens=False)]
            first = self.part_learnt
            self._keep([f"{_BARE}{self.learnt + i}" for i in odd], np.array([x for y in own for x in y], dtype=np.uint32), np.array([len(x) for x in own], dtype=np.int64))
            full = np.ones(len(new), dtype=np.int64)
            mask = np.ones(len(new), dtype=bool)
            mask[odd] = False
            full[mask] = counts
            where = np.repeat(mask, full)
            merged = np.empty(int(full.sum()), dtype=np.int64)
            merged[where], merged[~where] = k, first + np.arange(len(odd))
            k, counts = merged, full
        size = self.part_size[k].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.part_pool[np.repeat(self.part_at[k] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        edge = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        self.pool, self.at, self.size, self.used = _stored(self.pool, self.at, self.size, self.used, self.learnt, ids, edge[:-1], np.diff(edge))
        self.learnt += len(new)

    def _learn_spaced(self) -> None:
        """New pieces that a space comes before are encoded in one text and its ids cut by their bytes; bare ones one by one."""
        new = _newest(self.parts, self.part_learnt)
        for i in range(0, len(new), 2000):
            part = new[i : i + 2000]
            joins = np.fromiter((not p.startswith(_BARE) for p in part), dtype=bool, count=len(part))
            one = [p for p, j in zip(part, joins.tolist(), strict=True) if j]
            own = [e.ids for e in self.tokenizer.encode_batch_fast([p[1:] for p, j in zip(part, joins.tolist(), strict=True) if not j], add_special_tokens=False)]
            ids = self._ids([self.lead + self.lead.join(one)]) if one else np.zeros(0, dtype=np.uint32)
            n = np.fromiter((len(p.encode()) for p in one), dtype=np.int64, count=len(one)) + 1
            ends = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(n), side="left") + 1
            if len(ends) != len(one) or (one and int(ends[-1]) != len(ids)):
                raise RuntimeError("pieces were joined by the tokenizer")
            size = np.zeros(len(part), dtype=np.int64)
            size[joins], size[~joins] = np.diff(ends, prepend=0), [len(x) for x in own]
            out = np.zeros(int(size.sum()), dtype=np.uint32)
            out[np.repeat(joins, size)] = ids
            out[np.repeat(~joins, size)] = np.array([x for y in own for x in y], dtype=np.uint32)
            self._keep([], out, size)

    def _pieces(self, text: str, lines: str) -> list[str] | None:
        """The pieces of a text, or None if it is to be encoded whole."""
        if not self.lead:
            return None if _ODD_LOOSE.search(text) else text.split()
        other = any(c in text for c in _OTHER_SPACE)
        if other and _ODD_SPACED.search(text):
            return None
        pieces = (_BARE + text.replace("\n", lines)).split(" ")
        return None if not other and ("" in pieces or _BARE in pieces) else pieces

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > (CACHE_PLAIN if self.lead else CACHE_PIECES):
            self.reset()
        number, lines = self.known.__getitem__, f" {_BARE}\n {_BARE}"
        found, whole, counts = [], {}, np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            pieces = None
            if not (any(m in text for m in self.marks) or (self.unmarked and self.unmarked(text))):
                pieces = self._pieces(text, lines)
            if pieces is None:
                whole[i] = self._ids([text])
            else:
                counts[i] = len(pieces)
                found.append(np.fromiter(map(number, pieces), dtype=np.int64, count=len(pieces)))
        self._learn()
        if not found:
            return [whole[i] for i in range(len(texts))]
        k = np.concatenate(found)
        size = self.size[k].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[k] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        edge = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [whole[i] if i in whole else ids[edge[i] : edge[i + 1]] for i in range(len(texts))]


def _stored(pool: np.ndarray, at: np.ndarray, size: np.ndarray, used: int, n: int, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The arrays with entries n and on added, grown by doubling."""
    while used + len(ids) > len(pool):
        pool = np.concatenate((pool, np.zeros_like(pool)))
    while n + len(starts) > len(at):
        at, size = (np.concatenate((x, np.zeros_like(x))) for x in (at, size))
    pool[used : used + len(ids)] = ids
    at[n : n + len(starts)], size[n : n + len(starts)] = starts + used, sizes
    return pool, at, size, used + len(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
