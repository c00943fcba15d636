"""Byte-pair encoding by longest matches with backtracking, and token counts of every prefix.

A sequence of tokens is the encoding of a word exactly if each token is reachable and each
neighbouring pair is compatible: encoding the pair's text gives the pair. So the encoder walks
the word with the longest tokens an Aho-Corasick automaton finds, checks each new pair against
the compatibility table and steps back to a shorter token where one fails; a place found dead
is never entered twice, which makes it linear. Decoding copies slices of one string by an
offset table.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import ahocorasick
import numpy as np
import regex

from .common import hold

INF = sys.maxsize


class Merges:
    """Tokens as strings, how each is built from two, and which pairs may stand side by side.

    ranks: of each token that is built by a merge, low first. parts: its two halves. merged:
    gives the token that two halves make, or None.
    """

    def __init__(self, ranks: dict[str, int], parts: dict[str, tuple[str, str]], tokens, bound: int = 1 << 18):
        self.ranks, self.parts = ranks, parts
        self.made = {v: k for k, v in parts.items()}
        self.table: dict[tuple[str, str], bool] = {}
        self.bound = bound
        # What it finds are the tokens themselves, whose hashes Python knows.
        self.automaton = ahocorasick.Automaton()
        for t in tokens:
            self.automaton.add_word(t, t)
        self.automaton.make_automaton()

    def merged(self, a: str, b: str) -> str | None:
        return self.made.get((a, b))

    def spine(self, token: str, side: int) -> list[str]:
        """The tokens at one edge of a token as it is built, the smallest first."""
        out = [token]
        while (p := self.parts.get(out[-1])) is not None:
            out.append(p[side])
        return out[::-1]

    def compatible(self, a: str, b: str) -> bool:
        """Whether no merge crosses the border while a and b are built, in the order of the ranks."""
        known = self.table.get((a, b))
        if known is not None:
            return known
        left, right, i, j, good = self.spine(a, 1), self.spine(b, 0), 0, 0, True
        while good:
            grows_left = self.ranks[left[i + 1]] if i + 1 < len(left) else INF
            grows_right = self.ranks[right[j + 1]] if j + 1 < len(right) else INF
            w = self.merged(left[i], right[j])
            if w is not None and self.ranks[w] < grows_left and self.ranks[w] <= grows_right:
                good = False
            elif grows_left == grows_right == INF:
                break
            elif grows_left <= grows_right:
                i += 1
            else:
                j += 1
        if len(self.table) >= self.bound:
            self.table.clear()
        self.table[a, b] = good
        return good

    def matches(self, word: str) -> list[list[str]]:
        """For each place the tokens that begin there, the shortest first."""
        found: list[list[str]] = [[] for _ in word]
        for end, token in self.automaton.iter(word):
            found[end + 1 - len(token)].append(token)
        return found

    def encode(self, word: str) -> list[str]:
        """The tokens of a word whose every symbol is a token."""
        found, known, n = self.matches(word), self.table.get, len(word)
        out: list[str] = []
        tries = []  # of each token of out, what is untried in its place
        dead: set[tuple[int, str]] = set()
        at, last, untried = 0, "", reversed(found[0])
        while True:
            for token in untried:
                if last:
                    good = known((last, token))
                    if not (self.compatible(last, token) if good is None else good):
                        continue
                if not dead or (at + len(token), token) not in dead:
                    break
            else:
                dead.add((at, out.pop()))
                at, last, untried = at - len(last), out[-1] if out else "", tries.pop()
                continue
            out.append(token)
            at += len(token)
            if at == n:
                return out
            tries.append(untried)
            last, untried = token, reversed(found[at])

    def prefix_counts(self, word: str) -> list[int]:
        """How many tokens word[:1], word[:2], ... have: of each prefix only the last token is kept,
        the one that is compatible with the last token of what stands before it."""
        last, counts, known, done = [""] * (len(word) + 1), [0] * (len(word) + 1), self.table.get, -1
        for end, token in self.automaton.iter(word):  # by end, of each the longest first
            if end == done:
                continue
            start = end + 1 - len(token)
            if start:
                before = last[start]
                good = known((before, token))
                if not (self.compatible(before, token) if good is None else good):
                    continue
            last[end + 1], counts[end + 1], done = token, counts[start] + 1, end
        return counts[1:]


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself where
    it is printable, else the next character from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


#: Lower case of letters that Unicode 16 and 17 added, which Python 3.13 doesn't know.
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
NEW_UPPER = regex.compile("[" + "".join(map(chr, NEW_LOWER)) + "]")

#: Letters and numbers of the regex module's Unicode version that the tokenizers library's older one lacks.
NEWER = """
    558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
    10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8
    16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128
    1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED
    1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
NEWER_SET = "".join(f"\\U{a:0>8}" + (f"-\\U{b:0>8}" if b else "") for a, _, b in (x.partition("-") for x in NEWER.split()))
NEWER_ANY = regex.compile(f"[{NEWER_SET}]")

#: Offset of the symbols that end a word, in the strings the automaton sees.
FINAL = 0x10000


class WordBPE:
    """The tokenizer of a .json file of the tokenizers library with word ends: NFC, white space to one
    blank, lower case; words by a pattern; bytes; merges. Special strings in a text become their ids."""

    def __init__(self, path: str, words_kept: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern)
        # The same where newer letters and numbers are none, for texts that hold some.
        for kind in ("L", "N"):
            pattern = pattern.replace(f"[\\p{{{kind}}}]", f"[\\p{{{kind}}}--[{NEWER_SET}]]")
        pattern = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{NEWER_SET}]]")
        self.strict = regex.compile(f"(?V1){pattern}")
        self.space = regex.compile(spec["normalizer"]["normalizers"][1]["pattern"]["Regex"])
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        inner = self.inner
        pairs = [tuple(map(inner, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        parts = {a + b: (a, b) for a, b in pairs}
        self.ids = {inner(t): i for t, i in model["vocab"].items()}
        self.merges = Merges({a + b: i for i, (a, b) in enumerate(pairs)}, parts, self.ids)
        self.symbols = byte_symbols()
        self.id_bytes = {t: i.to_bytes(4, "little") for t, i in self.ids.items()}
        # Words met lately and, when these are too many, those before them.
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words_kept = words_kept
        # The offset table: token i and the blank after it are blob[offset[i] : offset[i + 1]].
        names = {i: t for t, i in (model["vocab"] | self.special).items()}
        own = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.blob = np.frombuffer(b"".join(own), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in own])])

    def inner(self, token: str) -> str:
        return token[: -len(self.suffix) - 1] + chr(ord(token[-len(self.suffix) - 1]) + FINAL) if len(token) > len(self.suffix) and token.endswith(self.suffix) else token

    def lower(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = text.replace("Σ", "σ").lower()  # no special final sigma
        return text.translate(NEW_LOWER) if NEW_UPPER.search(text) else text

    def word(self, w: str) -> bytes:
        """The ids of one word, each in four bytes."""
        if (out := self.older.get(w)) is None:
            s = w if w.isascii() and w.isprintable() and " " not in w else "".join(map(self.symbols.__getitem__, w.encode()))
            out = b"".join(map(self.id_bytes.__getitem__, self.merges.encode(s[:-1] + chr(ord(s[-1]) + FINAL))))
        if len(self.kept) >= self.words_kept:
            self.kept, self.older = {}, self.kept
        if len(w) <= 64:
            self.kept[w] = out
        return out

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        out, word = [], self.word
        for piece in self.split.split(text or "") if any(map((text or "").__contains__, self.special)) else (text or "",):
            if piece in self.special:
                out.append(self.special[piece].to_bytes(4, "little"))
            elif piece:
                pattern = self.pattern
                if not piece.isascii():
                    piece = unicodedata.normalize("NFC", piece)
                    pattern = self.strict if NEWER_ANY.search(piece) else pattern
                for w in pattern.findall(self.lower(self.space.sub(" ", piece))):
                    out.append(self.kept.get(w) or word(w))
        return b"".join(out)

    def decode_bytes(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8: the library joins the tokens with blanks, word ends and byte symbols as they are."""
        which = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        start = self.offset[which]
        size = self.offset[which + 1] - start
        end = np.cumsum(size)
        return self.blob[np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)].tobytes()[:-1]


class PieceBPE:
    """The BPE of a sentencepiece model with byte fallback, whose pieces and scores are given.

    As pieces hold the blank mark at their front only, a text's words, each with the marks before
    it, are counted on their own, and what a prefix counts is a sum over its words.
    """

    MARK = "▁"

    def __init__(self, path: str, words_kept: int = 200_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        kind = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        score = {sp.id_to_piece(i): sp.get_score(i) for i in range(n) if not kind[i]}
        order = sorted((t for t in score if len(t) > 1), key=lambda t: -score[t])
        self.ranks = {t: i for i, t in enumerate(order)}
        parts = {}
        for t in order:  # as it is built alone; what is built otherwise never occurs
            left = self.by_merging(t)
            if left is not None:
                parts[t] = left
        self.known = {t for t in score if len(t) == 1}
        self.merges = PieceMerges(self.ranks, parts, [*self.known, *parts])
        self.kept: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.words_kept = words_kept
        self.cut = regex.compile(f"{self.MARK}*[^{self.MARK}]*")

    def by_merging(self, token: str) -> tuple[str, str] | None:
        """The last merge when a token is built alone from its characters; None if it isn't built."""
        parts = list(token)
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], INF))
            if parts[best] + parts[best + 1] not in self.ranks:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return (parts[0], parts[1])

    def normal(self, text: str | None) -> str:
        return self.MARK + text.replace(" ", self.MARK) if text else ""

    def word_prefixes(self, word: str) -> list[int]:
        """Token counts of the prefixes of one word; a character outside the vocabulary is its bytes."""
        if all(map(self.known.__contains__, word)):
            return self.merges.prefix_counts(word)
        out: list[int] = []
        run: list[str] = []
        base = 0
        for ch in [*word, None]:
            if ch in self.known:
                run.append(ch)
                continue
            if run:
                out += [base + x for x in self.merges.prefix_counts("".join(run))]
                base, run = out[-1], []
            if ch is not None:
                base += len(ch.encode())
                out.append(base)
        return out

    def count_word(self, word: str) -> int:
        if (n := self.older.get(word)) is None:
            n = self.word_prefixes(word)[-1]
        if len(self.kept) >= self.words_kept:
            self.kept, self.older = {}, self.kept
        if len(word) <= 64:
            self.kept[word] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        count = self.count_word
        total = 0
        if "  " not in text and self.MARK not in text:
            words = text.split(" ")
            if words[-1] and words[0]:
                for w in words:
                    n = self.kept.get(w := "▁" + w)
                    total += count(w) if n is None else n
                return total
        for w in self.cut.findall(self.normal(text)):
            if w:
                n = self.kept.get(w)
                total += count(w) if n is None else n
        return total

    def prefixes(self, text: str | None) -> list[int]:
        """The count of every prefix text[:1], text[:2], ... as the library gives it for that prefix."""
        if not text:
            return []
        out, base, skip = [], 0, 1
        for w in self.cut.findall(self.normal(text)):
            if w:
                counts = self.word_prefixes(w)
                out += [base + x for x in counts[skip:]]
                base, skip = base + counts[-1], 0
        return out


class PieceMerges(Merges):
    """Any two neighbours merge whose joint text is a piece."""

    def merged(self, a: str, b: str) -> str | None:
        return a + b if a + b in self.ranks else None


def word_bpe(path: str) -> WordBPE:
    return hold(f"word {path}", lambda: WordBPE(path))


def piece_bpe(path: str) -> PieceBPE:
    return hold(f"piece {path}", lambda: PieceBPE(path))
