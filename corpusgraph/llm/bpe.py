"""BPE encoding by speculation and verification, and decoding.

For each distinct word of a batch, greedy longest-match (one automaton of all tokens) proposes tokens. The proposal is what merging would
give exactly when every adjacent pair of its tokens is compatible, that is when merging the two tokens'
symbols alone gives those two tokens again. All new pairs of a batch are tested together: numpy walks both
split trees of every pair towards the common border and looks for a merge that would have come first. Only
words with an incompatible pair, or with a token that its own symbols don't merge to, undergo exact merging,
which runs in rounds over all of them.

The tokenizer file gives normaliser, split pattern, vocabulary and merges; no tokenizer is trained. Null text
is empty text and gives no ids. Repeated rows give repeated results; columns other than id and text are not read.
Letters and numbers are those of the Unicode version of the `regex` module; a library built for another version may
split words differently around characters that only one of the two knows.
"""

from __future__ import annotations

import hashlib
import json
import string
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import held, map_texts

#: A Python worker remembers the pieces between spaces of up to twice as many bytes, overheads included.
CACHE_BYTES = 32 << 20
#: The rank of a pair that is never merged.
NONE = np.iinfo(np.int64).max
#: Words of more bytes are merged with a heap, the others together.
LONG = 200


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    out.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)})
    return out


class Recent:
    """What pieces of text encode to, as (packed ids, decoded text), in two generations: when the young one is full it becomes the old one, so that what is in use stays."""

    def __init__(self) -> None:
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}
        self.old: tuple[dict[str, bytes], dict[str, str]] = {}, {}
        self.used = 0

    def missing(self, keys: set[str]) -> set[str]:
        """The keys not known; known ones are all in the young generation afterwards."""
        if self.used > CACHE_BYTES:
            self.old, self.ids, self.texts, self.used = (self.ids, self.texts), {}, {}, 0
        out = keys - self.ids.keys()
        for k in out & self.old[0].keys():
            self.put(k, self.old[0][k], self.old[1][k])
        return out - self.ids.keys()

    def put(self, key: str, ids: bytes, text: str) -> None:
        self.ids[key], self.texts[key] = ids, text
        self.used += 300 + 3 * len(ids) + 4 * len(key)


class Bpe:
    """One tokenizer file with word ends, read once per Python worker.

    A word is a row of symbols: its UTF-8 bytes, the last one plus 256. Tokens are strings of such symbols.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model["dropout"] or model["byte_fallback"] or model["ignore_merges"] or model["continuing_subword_prefix"]:
            raise ValueError("this kind of tokenizer file is not supported")
        steps = spec["normalizer"]["normalizers"]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"] or level["use_regex"] or level["add_prefix_space"]:
            raise ValueError("this kind of tokenizer file is not supported")
        vocab: dict[str, int] = model["vocab"]
        end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        # Split trees: the two parts of each token that merging makes; a token's rank is that of its merge, -1 for a symbol.
        size = max(self.text) + 1
        self.left, self.right, self.made = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        rank = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(merges)}
        for (a, b), (i, t) in rank.items():
            if self.made[t] < 0:
                self.left[t], self.right[t], self.made[t] = a, b, i
        keys = np.array([(a << 20) | b for a, b in rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged_to = keys[order], np.array([i for i, _ in rank.values()], np.int64)[order], np.array([t for _, t in rank.values()], np.int64)[order]
        self.rank = rank
        letters = byte_letters()
        self.symbol = np.array([vocab.get(letters[b % 256] + end * (b >= 256), -1) for b in range(512)])
        byte_of = {c: b for b, c in letters.items()}
        self.length = np.zeros(size, np.int64)
        self.greedy = ahocorasick.Automaton()
        for token, i in vocab.items():
            bare, last = (token[: -len(end)], 256) if token.endswith(end) else (token, 0)
            if bare and all(c in byte_of for c in bare):
                codes = [byte_of[c] for c in bare]
                codes[-1] += last
                self.length[i] = len(codes)
                self.greedy.add_word("".join(map(chr, codes)), i)
        self.greedy.make_automaton()
        # Tokens that merging their own symbols does not give are never right.
        mine = [i for i in range(size) if self.length[i]]
        ids, ends = self.merge_all([self._symbols_of(i) for i in mine])
        first = ids[np.concatenate([[0], ends[:-1]])]
        self.stable = np.zeros(size, bool)
        self.stable[mine] = (np.diff(ends, prepend=0) == 1) & (first == mine)
        self.pieces = Recent()
        self.proposed = self.merged = 0

    def _symbols_of(self, token: int) -> np.ndarray:
        """The symbols that a token is made of."""
        out, todo = [], [token]
        while todo:
            t = todo.pop()
            if self.made[t] < 0:
                out.append(t)
            else:
                todo += [self.right[t], self.left[t]]
        return np.array(out)

    def words_of(self, piece: str) -> list[str]:
        """The words of a piece of text; the pattern drops white space, so its form needs no normalising."""
        if piece.isascii():
            low = piece.lower()
            if low.isalpha():
                return [low]
            if low[:-1].isalpha() and low[-1] in string.punctuation:
                return [low[:-1], low[-1]]
            return self.pattern.findall(low)
        return self.pattern.findall(_lower(unicodedata.normalize("NFC", piece)))

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair's merge (NONE for no merge) and its place among the keys."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), at

    def propose(self, symbols: np.ndarray) -> np.ndarray:
        """Greedy longest match over the symbols of many words in a row; no token goes beyond a word's last symbol."""
        line = symbols.astype("<u4").tobytes().decode("utf-32-le")
        return np.fromiter((t for _, t in self.greedy.iter_long(line)), np.int64)

    def merge_all(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words (rows of symbol ids): in each round every word merges its pair of least rank, the leftmost of equals.

        Returns the ids of all words in a row, and where each word ends.
        """
        done: list[np.ndarray | None] = [None] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) > LONG:
                done[i] = np.array(self._merge_long(w.tolist()))
            else:
                short.append(i)
        sizes = np.array([len(words[i]) for i in short], np.int64)
        ids = np.concatenate([words[i] for i in short]) if short else np.empty(0, np.int64)
        of = np.repeat(np.array(short, np.int64), sizes)
        ready_ids, ready_of = [], []
        while len(ids):
            last = np.append(of[1:] != of[:-1], True)
            rank = np.full(len(ids), NONE)
            rank[:-1] = self.pair_ranks(ids[:-1], ids[1:])[0]
            rank[last] = NONE
            starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            # Rank and place in one number: the least is the leftmost pair of least rank.
            best = np.minimum.reduceat(np.where(rank == NONE, NONE, rank * len(ids) + np.arange(len(ids))), starts)
            over = best == NONE
            ended = np.repeat(over, np.diff(np.append(starts, len(ids))))
            ready_ids.append(ids[ended])
            ready_of.append(of[ended])
            place = best[~over] % len(ids)
            ids[place] = self.merged_to[self.pair_ranks(ids[place], ids[place + 1])[1]]
            ended[place + 1] = True
            ids, of = ids[~ended], of[~ended]
        for i, w in enumerate(done):
            if w is not None:
                ready_ids.append(w)
                ready_of.append(np.full(len(w), i))
        all_of = np.concatenate(ready_of) if ready_of else np.empty(0, np.int64)
        order = np.argsort(all_of, kind="stable")
        return (np.concatenate(ready_ids)[order] if ready_ids else np.empty(0, np.int64)), np.cumsum(np.bincount(all_of, minlength=len(words)))

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked neighbours, for a very long word."""
        import heapq

        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*self.rank[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
        heap = [(r, i, a, b, t) for r, t, i, a, b in heap]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, a, b, t = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = t, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (p := (ids[x], ids[y])) in self.rank:
                    r, made = self.rank[p]
                    heapq.heappush(heap, (r, x, *p, made))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether merging would keep each of the adjacent token pairs (n, 2).

        Undoing the later of the two tokens' merges steps back in time; a border merge of lower rank than
        what was undone on its side would have come first, so the pair could not have arisen.
        """
        a, b = pairs[:, 0].copy(), pairs[:, 1].copy()
        limit = np.full(len(a), NONE)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y, cap = a[live], b[live], limit[live]
            rank = self.pair_ranks(x, y)[0]
            rank = np.where(rank == NONE, NONE, 2 * rank + 1)
            ends = rank < cap
            good[live[ends]] = False
            mx, my = self.made[x], self.made[y]
            undo_left = mx > my
            # An equal rank on the left was merged before the border pair (leftmost first), on the right after it.
            cap = np.where(undo_left, 2 * mx, 2 * my + 2)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            limit[live] = cap
            live = live[~ends & ((mx >= 0) | (my >= 0))]
        return good

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word's ids end."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        raw = [w.encode() for w in words]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        starts = np.concatenate([[0], ends[:-1]])
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        symbols[ends - 1] += 256
        ids = self.propose(symbols)
        borders = np.cumsum(self.length[ids])
        if len(borders) == 0 or borders[-1] != ends[-1] or (self.symbol < 0).any():
            bad, tokens, of = np.ones(len(words), bool), np.empty(0, np.int64), np.empty(0, np.int64)
        else:
            of = np.searchsorted(ends, borders)  # the word that each token ends in
            bad = np.zeros(len(words), bool)
            bad[of[~self.stable[ids]]] = True
            inner = np.flatnonzero(of[1:] == of[:-1])
            pairs, which = np.unique((ids[inner] << 20) | ids[inner + 1], return_inverse=True)
            good = self.compatible(np.stack([pairs >> 20, pairs & 0xFFFFF], axis=1))
            bad[of[inner[~good[which]]]] = True
            tokens = ids
        redo = np.flatnonzero(bad)
        self.proposed += len(words)
        self.merged += len(redo)
        rows = [self.symbol[symbols[starts[i] : ends[i]]] for i in redo]
        exact, exact_ends = self.merge_all([r[r >= 0] for r in rows])  # unknown symbols are left out
        exact_of = np.repeat(redo, np.diff(exact_ends, prepend=0))
        keep = ~bad[of]
        all_ids, all_of = np.concatenate([tokens[keep], exact]), np.concatenate([of[keep], exact_of])
        order = np.argsort(all_of, kind="stable")
        return all_ids[order], np.cumsum(np.bincount(all_of, minlength=len(words)))

    def learn(self, fresh: set[str]) -> None:
        """Encode pieces that are not known yet."""
        of = {c: self.words_of(c) for c in fresh if c not in self.special}
        place = {w: i for i, w in enumerate(set().union(*of.values()))}
        ids, ends = self.encode_words(list(place))
        packed, name = ids.astype("<u4").tobytes(), self.text
        names = [name[t] for t in ids.tolist()]
        stops = [0, *ends.tolist()]
        for c, words in of.items():
            at = [place[w] for w in words]
            self.pieces.put(c, b"".join([packed[4 * stops[i] : 4 * stops[i + 1]] for i in at]), " ".join([t for i in at for t in names[stops[i] : stops[i + 1]]]))
        for c in fresh & self.special.keys():
            self.pieces.put(c, np.array([self.special[c]], "<u4").tobytes(), name[self.special[c]])

    def encode_all(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """The packed ids and the decoded form of each text: the tokens' texts with a space between them, as the library
        decodes without a decoder. What stands between spaces is looked up whole before it is cut into words."""
        cut: list[list[str]] = []
        for text in texts:
            if self.cut_special and any(s in text for s in self.special):
                parts = []
                for piece in self.cut_special.split(text):
                    parts += [piece] if piece in self.special else piece.replace("\n", " ").split(" ")
            else:
                parts = text.replace("\n", " ").split(" ")
            cut.append(parts)
        self.learn(self.pieces.missing(set().union(*cut)))
        ids, decoded = self.pieces.ids.__getitem__, self.pieces.texts.__getitem__
        for parts in cut:
            yield b"".join(map(ids, parts)), " ".join(filter(None, map(decoded, parts)))


def _lower(text: str) -> str:
    """Character-wise lower case (str.lower() would treat a final sigma by its context)."""
    if text.isascii() or "Σ" not in text:
        return text.lower()
    return "".join([c.lower() for c in text])


def tokenizer(path: str) -> Bpe:
    return held(__name__, path, lambda: Bpe(path))


#: Texts of a batch are encoded in slices of about so many bytes.
SLICE_BYTES = 2 << 20


def _slices(texts: list[bytes]) -> Iterable[list[bytes]]:
    part, used = [], 0
    for text in texts:
        if part and used + len(text) > SLICE_BYTES:
            yield part
            part, used = [], 0
        part.append(text)
        used += len(text)
    yield part


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids. path: a tokenizer file that every executor has."""
    return _encoded(docs, path, id_col, text_col, True, False)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256."""
    return _encoded(docs, path, id_col, text_col, False, True)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""
    return _encoded(docs, path, id_col, text_col, True, True)


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, with_ids: bool, with_digests: bool) -> DataFrame:
    def run(doc_ids: list, texts: list[bytes]) -> dict[str, list]:
        bpe = tokenizer(path)
        out: dict[str, list] = {"doc_id": doc_ids, "n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
        for part in _slices(texts):
            for packed, decoded in bpe.encode_all([t.decode(errors="replace") for t in part]):
                out["n_tokens"].append(len(packed) // 4)
                if with_ids:
                    out["ids"].append(np.frombuffer(packed, "<i4"))
                if with_digests:
                    out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
        return out

    schema = "doc_id long, n_tokens long" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string" * with_digests
    return map_texts(docs, id_col, text_col, run, schema)
