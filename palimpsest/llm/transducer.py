"""A deterministic transducer for byte-pair-encoding pieces, compiled on demand.

A text's pieces are unique in this sense: the last piece of a prefix is the one piece ``t`` that ends there,
that the encoder leaves whole, and that the encoder would not join or re-cut with the last piece of the prefix
before ``t``. So the last piece at a position follows from the last pieces at the positions before it, no
further back than the longest start of a piece that ends there. That is a state: (node of the trie of piece
starts, last pieces and relative counts along it), of which there are finitely many. Each transition carries
the number of pieces it adds (which may be negative, when a longer piece takes the place of several).

States and transitions are compiled when first met and kept in dense tables, so that many chunks of text step
through the table together. If the tables outgrow their bound, they are dropped and compiled anew.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np

SPACE = "▁"
#: Up to so many longer pieces, what a piece may be followed by is told one by one.
FEW = 24
CLOSED = False


class PieceTransducer:
    """Counts the pieces of a sentencepiece BPE model with byte fallback and identity normalisation."""

    START = 0

    def __init__(self, model_file: str, max_cells: int = 24_000_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in ids}
        self.max_len = max(map(len, self.rank))
        #: Texts that some longer piece starts with: only at borders before them can that piece begin.
        self.starts = {p[:k] for p in self.rank for k in range(len(p))}
        chars = sorted({c for p in self.rank for c in p})
        #: Class of each code point: 0-3 are characters outside the pieces, by UTF-8 length; the rest in pairs.
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[0x80:] = 1
        self.classes[0x800:] = 2
        self.classes[0x10000:] = 3
        for k, c in enumerate(chars):
            self.classes[ord(c)] = 4 + k
        self.classes[ord(" ")] = self.classes[ord(SPACE)]
        self.letters = [None] * 4 + chars
        self.max_cells = max_cells
        #: The pieces that a text starts, where they are few.
        self.longer: dict[str, list[str] | None] = {}
        for p in self.rank:
            for k in range(1, len(p)):
                self.longer.setdefault(p[:k], []).append(p)
        self.longer = {t: ps for t, ps in self.longer.items() if len(ps) <= FEW}
        self._whole: dict[str, tuple | None] = {}
        self._views: dict[tuple, object] = {}
        self._reset()

    # -- the encoder on short strings, which the compiler asks ------------------------------------------------

    def _merged(self, text: str) -> list[tuple]:
        """Merge the best-ranked neighbouring pair, leftmost first, until none is a piece.

        Each part is (text, time, left part, right part); its time is the worst rank merged in it, that is how
        far the queue had got when it came to be.
        """
        parts: list[tuple | None] = [(c, -1.0, None, None) for c in text]
        nxt, prev = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(self.rank[m], i, m) for i in range(len(parts) - 1) if (m := text[i : i + 2]) in self.rank]
        heapq.heapify(heap)
        while heap:
            r, i, m = heapq.heappop(heap)
            j = nxt[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i][0] + parts[j][0] != m:
                continue
            parts[i], parts[j] = (m, max(r, parts[i][1], parts[j][1]), parts[i], parts[j]), None
            nxt[i] = nxt[j]
            if nxt[i] < len(parts):
                prev[nxt[i]] = i
                if (w := m + parts[nxt[i]][0]) in self.rank:
                    heapq.heappush(heap, (self.rank[w], i, w))
            if prev[i] >= 0 and (w := parts[prev[i]][0] + m) in self.rank:
                heapq.heappush(heap, (self.rank[w], prev[i], w))
        return [p for p in parts if p is not None]

    def encode(self, text: str) -> list[str]:
        return [p[0] for p in self._merged(text)]

    def _edges(self, piece: str) -> tuple[list, list] | None:
        """The parts that stood at either end of a piece while it was merged: (text, from, until); None if the encoder cuts it."""
        if piece not in self._whole:
            parts = self._merged(piece)
            if len(parts) > 1:
                self._whole[piece] = None
            else:
                found = []
                for side in (2, 3):
                    node, until, spine = parts[0], float("inf"), []
                    while node is not None:
                        spine.append((node[0], node[1], until))
                        node, until = node[side], node[1]
                    found.append(spine)
                self._whole[piece] = tuple(found)
        return self._whole[piece]

    def _may_follow(self, last: str | None, piece: str) -> bool:
        """Whether the encoder leaves ``last`` and ``piece`` as they are side by side: no merge across comes first."""
        if last is None:
            return True
        unsure = False
        for x, x_from, x_until in self._edges(last)[1]:
            for y, y_from, y_until in self._edges(piece)[0]:
                if (r := self.rank.get(x + y)) is not None:
                    at, until = max(r, x_from, y_from), min(x_until, y_until)
                    if at < until:
                        return False
                    unsure |= at == until
        return not unsure or self.encode(last + piece) == [last, piece]

    def _seen_by(self, last: str | None, tail: str):
        """What a piece that begins with ``tail`` can tell of the piece before it; None if no such piece fits."""
        if last is None:
            return ()
        key = (last, tail)
        if key not in self._views:
            more = self.longer.get(tail)
            if more is None:
                view = last if not tail else tuple(e for e in self._edges(last)[1] if e[0] + tail in self.starts or any(e[0] + tail[:j] in self.rank for j in range(1, len(tail) + 1)))
            else:
                view = tuple(k for k, p in enumerate(more) if self._edges(p) and not self._may_follow(last, p))
                view = None if len(view) == sum(self._edges(p) is not None for p in more) else view
            self._views[key] = view
        return self._views[key]

    # -- states -----------------------------------------------------------------------------------------------

    def _reset(self) -> None:
        self.width = 64
        self.local = np.zeros(len(self.letters), np.int32)  # class -> column of the tables, 0: none yet
        self.columns = [-1]
        self.next = np.full((1024, self.width), -1, np.int32)
        self.added = np.zeros((1024, self.width), np.int16)
        #: Per state: the text since its oldest border, the last piece at each border or that no piece can begin
        #: there, and the pieces up to it less those up to the end.
        self.states: list[tuple[str, tuple, tuple]] = []
        self.index: dict[tuple, int] = {}
        self._state("", (None,), (0,))

    def tables(self) -> bytes:
        """What has been compiled so far, for ``restore``."""
        n = len(self.states)
        return pickle.dumps((self.width, self.local, self.columns, self.next[:n], self.added[:n], self.states, self.index), protocol=5)

    def restore(self, tables: bytes) -> None:
        """Begin with the tables that a transducer of the same model compiled."""
        self.width, self.local, self.columns, following, added, self.states, self.index = pickle.loads(tables)
        rows = max(1024, 1 << len(self.states).bit_length())
        self.next = np.full((rows, self.width), -1, np.int32)
        self.added = np.zeros((rows, self.width), np.int16)
        self.next[: len(following)], self.added[: len(added)] = following, added

    def _state(self, text: str, lasts: tuple, counts: tuple) -> int:
        """The state after ``text``, with the last piece and the count at each border; borders no piece can begin at are dropped."""
        views = [self._seen_by(last, text[k:]) if last is not CLOSED and text[k:] in self.starts else None for k, last in enumerate(lasts)]
        keep = next(k for k, v in enumerate(views) if v is not None)
        text, lasts, views = text[keep:], lasts[keep:], views[keep:]
        counts = tuple(c - counts[-1] if v is not None else 0 for c, v in zip(counts[keep:], views, strict=True))
        key = (text, tuple(views), counts)
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append((text, tuple(x if v is not None else CLOSED for x, v in zip(lasts, views, strict=True)), counts))
            if len(self.states) > len(self.next):
                grow = len(self.next)
                self.next = np.vstack([self.next, np.full((grow, self.width), -1, np.int32)])
                self.added = np.vstack([self.added, np.zeros((grow, self.width), np.int16)])
        return self.index[key]

    def _column(self, cls: int) -> int:
        if not self.local[cls]:
            self.local[cls] = len(self.columns)
            self.columns.append(cls)
            if len(self.columns) > self.width:
                self.next = np.hstack([self.next, np.full_like(self.next, -1)])
                self.added = np.hstack([self.added, np.zeros_like(self.added)])
                self.width *= 2
        return int(self.local[cls])

    def _compile(self, state: int, column: int) -> None:
        text, lasts, counts = self.states[state]
        cls = self.columns[column]
        if cls < 4:  # bytes: no piece crosses them
            to, n = self.START, cls + 1
        else:
            c = self.letters[cls]
            if c == SPACE and not text.endswith(SPACE):  # no piece has one inside, but in a run of them
                text, lasts, counts = "", (None,), (0,)
            text += c
            for k in range(len(text)):
                piece = text[k:]
                if lasts[k] is not CLOSED and piece in self.rank and self._edges(piece) and self._may_follow(lasts[k], piece):
                    break
            else:
                raise AssertionError(f"no piece ends {text!r}")
            n = counts[k] + 1
            to = self._state(text, (*lasts, piece), (*counts, n))
        self.next[state, column] = to
        self.added[state, column] = n

    # -- runs -------------------------------------------------------------------------------------------------

    def columns_of(self, text: np.ndarray) -> np.ndarray:
        """Columns of the tables for an array of code points."""
        if self.next.size > self.max_cells:
            self._reset()
        cls = self.classes[text]
        cols = self.local[cls]
        if len(cols) and not cols.all():
            for k in np.unique(cls[cols == 0]).tolist():
                self._column(k)
            cols = self.local[cls]
        return cols

    def step(self, state: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and added counts of many chunks."""
        to = self.next[state, column]
        if (to < 0).any():
            at = np.flatnonzero(to < 0)
            for s, c in set(zip(state[at].tolist(), column[at].tolist(), strict=True)):
                self._compile(s, c)
            to = self.next[state, column]
        return to, self.added[state, column]
