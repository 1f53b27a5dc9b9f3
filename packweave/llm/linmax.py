"""Longest-match subword tokenizer: a trie with failure links and emissions worked out beforehand.

Each trie node knows which ids its string gives when no longer piece can follow (its emission) and the node
that stands for the rest of the string (its failure link). A text is then read once, with no step back.
"""

from __future__ import annotations

SPACE = "▁"


class LinMaxTrie:
    """``pieces``: piece -> id. A character that starts no known piece gives its UTF-8 bytes, id ``byte_base`` + byte."""

    def __init__(self, pieces: dict[str, int], byte_base: int = 3, newline_id: int | None = None):
        self.byte_base = byte_base
        self.newline_id = byte_base + 10 if newline_id is None else newline_id
        self.next: list[dict[str, int]] = [{}]
        self.fail: list[int] = [0]
        self.emit: list[tuple[int, ...]] = [()]
        self._grow(pieces)

    def _bytes(self, ch: str) -> tuple[int, ...]:
        return tuple(self.byte_base + b for b in ch.encode("utf-8", "surrogatepass"))

    def _grow(self, pieces: dict[str, int]) -> None:
        ends: dict[int, int] = {}
        for piece in sorted(pieces):
            at = 0
            for ch in piece:
                step = self.next[at].get(ch)
                if step is None:
                    step = self.next[at][ch] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.emit.append(())
                at = step
            if at:
                ends[at] = pieces[piece]
        level = [(0, ch, node) for ch, node in self.next[0].items()]
        while level:  # breadth first: a node's links need those of all shorter strings
            deeper = []
            for parent, ch, node in level:
                if node in ends:
                    self.emit[node] = (ends[node],)
                elif parent == 0:
                    self.emit[node] = self._bytes(ch)
                else:
                    out, at = self.emit[parent], self.fail[parent]
                    while ch not in self.next[at]:
                        if at == 0:
                            out += self._bytes(ch)
                            break
                        out += self.emit[at]
                        at = self.fail[at]
                    else:
                        at = self.next[at][ch]
                    self.emit[node], self.fail[node] = out, at
                deeper += [(node, c, n) for c, n in self.next[node].items()]
            level = deeper
        self.emitted = [len(e) for e in self.emit]

    def encode_stretch(self, stretch: str) -> list[int]:
        """Ids of one stretch (no spaces or newlines), in time linear in its length."""
        nxt, fail, emit = self.next, self.fail, self.emit
        out: list[int] = []
        at = 0
        for ch in stretch:
            while (step := nxt[at].get(ch)) is None:
                if at == 0:
                    out += self._bytes(ch)
                    step = 0
                    break
                out += emit[at]
                at = fail[at]
            at = step
        while at:
            out += emit[at]
            at = fail[at]
        return out

    def count_stretch(self, stretch: str) -> int:
        nxt, fail, emitted = self.next, self.fail, self.emitted
        n = at = 0
        for ch in stretch:
            while (step := nxt[at].get(ch)) is None:
                if at == 0:
                    n += len(ch.encode("utf-8", "surrogatepass"))
                    step = 0
                    break
                n += emitted[at]
                at = fail[at]
            at = step
        while at:
            n += emitted[at]
            at = fail[at]
        return n

    def encode(self, text: str) -> list[int]:
        """Ids of a text: one leading space mark, spaces as marks, newlines as single bytes."""
        out: list[int] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.newline_id)
            for j, word in enumerate(line.split(" ")):
                out += self.encode_stretch(SPACE + word if j or not k else word)
        return out


class StretchCounts(dict):
    """Counts by stretch. It forgets everything at ``limit`` entries, so memory is bounded; counts never change."""

    def __init__(self, trie: LinMaxTrie, mark: str, limit: int = 200_000):
        super().__init__()
        self.trie, self.mark, self.limit = trie, mark, limit

    def __missing__(self, stretch: str) -> int:
        n = self.trie.count_stretch(self.mark + stretch)
        if len(stretch) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[stretch] = n
        return n


class TokenCounter:
    """Exact id counts of texts; each different word is walked through the trie once per process."""

    def __init__(self, trie: LinMaxTrie):
        self.inner, self.first = StretchCounts(trie, SPACE), StretchCounts(trie, "")

    def __call__(self, text: str) -> int:
        lines = text.split("\n")
        n, inner, first = len(lines) - 1, self.inner, self.first
        for k, line in enumerate(lines):
            words = line.split(" ")
            if k:
                n += first[words[0]]
                del words[0]
            for w in words:
                n += inner[w]
        return n


def pieces_of(rows) -> dict[str, int]:
    """Text pieces of vocabulary rows (token_id, piece): control ids and single bytes are left out."""
    return {p: int(i) for i, p in rows if p and int(i) > 258}
