"""SentencePiece BPE with byte fallback, as vectorised merge rounds.

Words are laid out as flat symbol arrays. Each round finds every word's pair of
least rank with one segmented minimum, merges its leftmost occurrences in all
words at once, and compacts the arrays, until no pair can merge. Words that
came before are looked up, so that each distinct word is merged once.
"""

from __future__ import annotations

import codecs
import re

import numpy as np
import sentencepiece

from .common import PairTable, WordStore, model_path, ranges

SPACE = "▁"
_FAR = np.int64(1 << 40)


def _bytewise(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("nearfield-bytewise", _bytewise)


class PieceTokenizer:
    """Encodes and decodes as the sentencepiece library does with a BPE model: no begin or end ids, no sampling.

    Models need byte fallback, identity normalisation with a dummy prefix, and
    no user-defined pieces; others are refused.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = np.array([model.is_control(i) or model.is_unknown(i) for i in range(n)])
        byte = np.array([model.is_byte(i) for i in range(n)])
        if not byte.any() or any(model.is_unused(i) for i in range(n)):
            raise ValueError("the model needs byte fallback and no unused pieces")
        if model.normalize("  aÅﬁ  b ") != (SPACE * 3 + "aÅﬁ" + SPACE * 2 + "b" + SPACE):
            raise ValueError("the model needs identity normalisation with a dummy prefix")
        self.byte_id = {int(pieces[i][3:5], 16): i for i in np.flatnonzero(byte).tolist()}
        self.is_byte = byte
        unknown = {i: model.decode([i]).encode() for i in range(n) if model.is_unknown(i)}
        self.control = np.array([model.is_control(i) for i in range(n)])
        self.surface = [unknown[i] if i in unknown else b"" if special[i] else bytes([int(p[3:5], 16)]) if byte[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.leading = [p.startswith(SPACE) and not (special[i] or byte[i]) for i, p in enumerate(pieces)]
        self.decimal = [str(i) for i in range(n)]
        self._pairs([(i, pieces[i]) for i in range(n) if not (special[i] or byte[i])], [model.get_score(i) for i in range(n)])
        self.store = WordStore()

    def _pairs(self, normal: list[tuple[int, str]], scores: list[float]) -> None:
        """Symbols (single characters, then pieces), and for each pair that merges its product and rank."""
        chars = sorted({c for _, p in normal for c in p})
        number = {c: i for i, c in enumerate(chars)}
        for _, p in normal:
            number.setdefault(p, len(number))
        self.symbols = list(number)
        self.char_symbol = np.full(0x110000, len(number), np.int64)  # the last number: a character that no piece has
        self.char_symbol[[ord(c) for c in chars]] = np.arange(len(chars))
        self.piece_id = np.full(len(number), -1, np.int32)
        for i, p in normal:
            self.piece_id[number[p]] = i
        place = {s: r for r, s in enumerate(sorted({scores[i] for i, _ in normal}, reverse=True))}
        rows = []
        for i, p in normal:
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    rows.append((number[p[:k]], number[p[k:]], place[scores[i]], number[p]))
        rows = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.base = len(number) + 1
        self.pairs = PairTable(rows[:, 0] * self.base + rows[:, 1])
        self.pair_rank, self.pair_product = np.append(rows[:, 2], _FAR), np.append(rows[:, 3], 0)  # the last row: no such pair
        # a rank is safe if it has one piece and what that piece merges into all ranks later: its occurrences then merge at once
        least = np.full(len(number), _FAR)
        np.minimum.at(least, rows[:, 0], rows[:, 2])
        np.minimum.at(least, rows[:, 1], rows[:, 2])
        self.safe = np.ones(len(place) + 1, bool)
        uses = np.bincount([place[scores[i]] for i, _ in normal], minlength=len(place) + 1)
        self.safe[uses > 1] = False
        unsafe = rows[least[rows[:, 3]] <= rows[:, 2], 2]
        self.safe[unsafe] = False
        # no piece holds such a pair of neighbours: no merge ever crosses between them
        self.inside = PairTable(np.unique(np.array([number[a] * self.base + number[b] for _, p in normal for a, b in zip(p, p[1:])], np.int64)))
        self.apart = apart = not any(SPACE in p.lstrip(SPACE) for _, p in normal)
        self.word = re.compile(f"{SPACE}+[^{SPACE}]*" if apart else "(?s).+")
        self.run = self._run(normal, {i: place[scores[i]] for i, _ in normal}) if apart else 0

    def _run(self, normal: list[tuple[int, str]], rank: dict[int, int]) -> int:
        """Longest piece of spaces alone, if a longer run always yields that piece first; else 0.

        Two single spaces merge last of all runs (or tie and the leftmost goes
        first), so a run is eaten from the left; no other piece takes more than
        one space; and what the longest piece leaves behind starts afresh.
        """
        runs = {len(p): rank[i] for i, p in normal if not p.strip(SPACE)}
        most = max(runs, default=0)
        if most < 2 or 2 not in runs or runs[2] < max(runs[n] for n in runs if n > 1) or any(len(p) - len(p.lstrip(SPACE)) > 1 for _, p in normal if p.strip(SPACE)):
            return 0
        three, four = (self.merge([SPACE * (k * most)])[0].tolist() for k in (3, 4))
        return most if four[1:] == three and self.symbols[np.flatnonzero(self.piece_id == four[0])[0]] == SPACE * most else 0

    def split(self, text: str) -> list[str]:
        """Words that no merge crosses; their concatenation is the normalised text."""
        if not text:
            return []
        words = self.word.findall(SPACE + text.replace(" ", SPACE))
        if self.run and (long := 3 * self.run * SPACE) in words[0] + text.replace(" ", SPACE):
            cut: list[str] = []
            for w in words:
                if w.startswith(long):
                    spaces = len(w) - len(w.lstrip(SPACE))
                    whole = spaces // self.run - 1
                    cut += [SPACE * self.run] * whole
                    w = w[whole * self.run :]
                cut.append(w)
            words = cut
        return words

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct words, and where each word's begin (one more than words)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbol = self.char_symbol[codes]
        word = np.repeat(np.arange(len(words)), lengths)
        place = np.arange(len(codes))
        n = len(codes)
        # units within words: cut where no piece has the two neighbours
        joined = np.zeros(n, bool)
        row = np.full(n, -1)
        if n > 1:
            joined[1:] = word[1:] == word[:-1]
            if lengths.max() > 64:
                joined[1:] &= self.inside.find(symbol[:-1] * self.base + symbol[1:]) >= 0
            near = np.flatnonzero(joined[1:])
            row[near] = self.pairs.find(symbol[near] * self.base + symbol[near + 1])
        unit = np.cumsum(~joined) - 1
        rank = self.pair_rank[row]
        done_symbol: list[np.ndarray] = []
        done_place: list[np.ndarray] = []
        while len(symbol):
            first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            size = np.diff(np.append(first, len(symbol)))
            best = np.minimum.reduceat(rank, first)
            active = np.repeat(best < _FAR, size)
            best = np.repeat(best, size)
            if not active.all():
                done_symbol.append(symbol[~active]), done_place.append(place[~active])
                symbol, place, unit, rank, row, best = (x[active] for x in (symbol, place, unit, rank, row, best))
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == best)
            owner = unit[hit]
            lead = np.ones(len(hit), bool)
            lead[1:] = owner[1:] != owner[:-1]
            # runs of overlapping occurrences: every second one, from the left
            broken = lead.copy()
            broken[1:] |= hit[1:] != hit[:-1] + 1
            index = np.arange(len(hit))
            offset = index - np.maximum.accumulate(np.where(broken, index, 0))
            hit = hit[np.where(self.safe[rank[hit]], offset % 2 == 0, lead)]
            symbol[hit] = self.pair_product[row[hit]]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            # the pairs that a merge touches: of the product with its right and with its left neighbour
            hit = hit - np.arange(len(hit))
            symbol, place, unit, rank, row = (x[stay] for x in (symbol, place, unit, rank, row))
            touched = np.concatenate((hit, hit[hit > 0] - 1))
            inner = touched < len(symbol) - 1
            inner[inner] = unit[touched[inner] + 1] == unit[touched[inner]]
            row[touched] = -1
            touched_inner = touched[inner]
            row[touched_inner] = self.pairs.find(symbol[touched_inner] * self.base + symbol[touched_inner + 1])
            rank[touched] = self.pair_rank[row[touched]]
        symbol = np.concatenate(done_symbol) if done_symbol else symbol
        place = np.concatenate(done_place) if done_place else place
        order = np.argsort(place)
        symbol, place = symbol[order], place[order]
        ids = np.append(self.piece_id, np.int32(-1))[symbol]
        counts = np.ones(len(ids), np.int64)
        bare = np.flatnonzero(ids < 0)
        if len(bare):  # characters without a piece of their own: one id for each byte
            raw = [chr(codes[p]).encode("utf-8", "surrogatepass") for p in place[bare].tolist()]
            counts[bare] = list(map(len, raw))
            spread = np.repeat(ids, counts)
            starts = np.cumsum(counts) - counts
            spread[ranges(starts[bare], counts[bare])] = [self.byte_id[b] for x in raw for b in x]
            word_of = np.repeat(word[place], counts)
            ids = spread
        else:
            word_of = word[place]
        return ids.astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(word_of, minlength=len(words)))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and where each text's begin (one more than texts)."""
        return self.store.gather(map(self._keys, texts), self._merged)

    def _keys(self, text: str) -> list[str]:
        """The text's words as the store's keys."""
        if self.apart and text and "  " not in text and text[0] != " " and SPACE not in text:
            return text.split(" ")
        return [" " + w for w in self.split(text)]

    def _merged(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.merge([k[1:] if k[:1] == " " else SPACE + k for k in keys])

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: surfaces joined; the first piece loses its dummy prefix; bytes that are no UTF-8 become U+FFFD one by one."""
        listed = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        if self.control[listed].any():  # begin and end ids part runs of bytes, and show nothing
            keep = self.control[listed]
            runs = np.split(np.asarray(listed), np.flatnonzero(keep))
            bare = [r[1:] if len(r) and self.control[r[0]] else r for r in runs]
            bare = [r for r in bare if len(r)]
            return "".join(self._joined(r.tolist(), i == 0) for i, r in enumerate(bare))
        return self._joined(listed, True)

    def _joined(self, ids: list[int], begins: bool) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        if begins and ids and self.leading[ids[0]]:
            raw = raw[1:]
        return raw.decode("utf-8", "nearfield-bytewise")


_tokenizers: dict[str, PieceTokenizer] = {}


def tokenizer(model: str) -> PieceTokenizer:
    """One tokenizer for each model and worker process."""
    if model not in _tokenizers:
        _tokenizers[model] = PieceTokenizer(model_path(model))
    return _tokenizers[model]
