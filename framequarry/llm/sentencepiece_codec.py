"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are joined to one text, whose suffixes are sorted; every piece of the vocabulary is
found by binary search as a range of suffixes. The occurrences are edges; sorted by position, they are relaxed from
left to right over all words at once; words are cut beforehand where no piece has the two characters side by side. The
vocabulary holds merges (BPE), so the best path is not the one of least cost:
an edge extends a prefix if and only if its piece and the last piece of that prefix would not have merged otherwise.
Exactly one edge survives at each position, and the surviving path is the library's own encoding.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_kernels import chunks, string_bytes

SPACE = "▁"
#: Words whose ids a worker remembers; then it starts anew.
MOST_WORDS = 200_000
#: Words matched at once, and bytes of text taken at once.
BATCH_WORDS, BATCH_BYTES = 20_000, 2 << 20
NEVER = np.int64(1) << 40
#: A line break is no part of any piece; words begin with at most one blank, and further blanks are a run.
_WORDS = re.compile(r" {2,}[^ \n]+| ?[^ \n]+|\n| +")


@dataclass
class Vocabulary:
    """Merge vocabulary by rank: pieces of one character have rank -1, others count from the first merged on."""

    pieces: list  # text of each id
    byte_ids: list  # id of each byte, for characters without a piece
    rank: np.ndarray  # of each id; NEVER if it is no piece of text
    left: np.ndarray  # id of each piece's parts in its last merge, -1 for single characters
    right: np.ndarray
    runs: list  # ids of runs of 0, 1, 2.. blanks, up to the longest piece of blanks

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(SPACE in pieces[i][1:] and set(pieces[i]) != {SPACE} for i in plain) or any("\n" in pieces[i] for i in plain):
            raise ValueError("pieces that span words are not supported")
        bytes_ = {pieces[i]: i for i in range(n) if model.is_byte(i)}
        byte_ids = [bytes_.get(f"<0x{b:02X}>", model.unk_id()) for b in range(256)]
        order = sorted((i for i in plain if len(pieces[i]) > 1), key=lambda i: (-model.get_score(i), i))
        rank = np.full(n, NEVER, np.int64)
        rank[[i for i in plain if len(pieces[i]) == 1]] = -1
        rank[order] = np.arange(len(order))
        score = {pieces[i]: model.get_score(i) for i in plain}
        ids = {pieces[i]: i for i in plain}
        left, right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        for i in order:
            if set(pieces[i]) == {SPACE}:
                rank[i] = NEVER  # runs of blanks are encoded on their own
                continue
            out, last = merge(pieces[i], score)
            if out == [pieces[i]]:
                left[i], right[i] = ids[last[0]], ids[last[1]]
            else:
                rank[i] = NEVER  # no text comes to this piece
        longest = max([1, *(len(pieces[i]) for i in plain if set(pieces[i]) == {SPACE})])
        runs = [[ids[p] if p in ids else model.unk_id() for p in merge(SPACE * k, score)[0]] for k in range(longest + 1)]
        return Vocabulary(pieces, byte_ids, rank, left, right, runs)


def merge(word: str, score: dict) -> tuple[list, tuple | None]:
    """The plain merging loop: the best-scored neighbouring pair first, the leftmost of equals; and the last merge."""
    parts, last = list(word), None
    while len(parts) > 1:
        best, at = None, -1
        for k in range(len(parts) - 1):
            s = score.get(parts[k] + parts[k + 1])
            if s is not None and (best is None or s > best):
                best, at = s, k
        if at < 0:
            break
        last = (parts[at], parts[at + 1])
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts, last


class Matcher:
    """What a worker keeps: tables of the vocabulary, and the ids of words it has seen."""

    def __init__(self, v: Vocabulary):
        self.v, n = v, len(v.pieces)
        self.unknown = n
        self.rank = np.append(v.rank, -1)
        self.left, self.right = np.append(v.left, -1), np.append(v.right, -1)
        usable = np.flatnonzero((v.rank >= 0) & (v.rank < NEVER))
        self.ids = {v.pieces[i]: int(i) for i in np.flatnonzero(v.rank < NEVER)}
        self.score = {v.pieces[i]: -float(v.rank[i]) for i in usable}
        singles = [(ord(p), i) for p, i in self.ids.items() if len(p) == 1]
        self.single_code = np.array(sorted(c for c, _ in singles), np.int64)
        self.single_id = np.array([i for _, i in sorted(singles)], np.int64)
        self.long = usable
        self.length = np.array([len(v.pieces[i]) for i in usable], np.int64)
        self.width = int(self.length.max(initial=1))
        self.chars = np.zeros((len(usable), self.width), np.int64)
        for k, i in enumerate(usable):
            self.chars[k, : self.length[k]] = [ord(c) for c in v.pieces[i]]
        pairs = {(self.ids[p[:k]], self.ids[p[k:]]): int(v.rank[i]) for i in usable for p in [v.pieces[i]] for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        keys = sorted((a * (n + 1) + b, r) for (a, b), r in pairs.items())
        self.pair_key = np.array([k for k, _ in keys], np.int64)
        self.pair_rank = np.array([r for _, r in keys], np.int64)
        self.side_by_side = np.unique(np.array([ord(a) << 21 | ord(b) for p in v.pieces for a, b in zip(p, p[1:], strict=False)], np.int64))
        self.memo_key = np.full(1 << 20, -1, np.int64)
        self.memo = np.zeros(1 << 20, bool)
        self.words: dict[str, bytes] = {}
        self.as_bytes = [p.replace(SPACE, " ").encode() for p in v.pieces]
        for b, i in enumerate(v.byte_ids):
            self.as_bytes[i] = bytes([b])

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay apart when their texts are merged as one."""
        key = a * (len(self.rank)) + b
        slot = (key * 0x9E3779B1 >> 7) & (len(self.memo) - 1)
        known = self.memo_key[slot] == key
        if not known.all():
            fresh, at = np.unique(key[~known], return_inverse=True)
            out = self._fit(fresh // len(self.rank), fresh % len(self.rank))
            s = (fresh * 0x9E3779B1 >> 7) & (len(self.memo) - 1)
            result = self.memo[slot]
            result[~known] = out[at]
            self.memo_key[s], self.memo[s] = fresh, out
            same = self.memo_key[s] == fresh  # of keys that share a slot, the last one written stays
            self.memo[s[same]] = out[same]
            return result
        return self.memo[slot]

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the two pieces' merges, the latest first: a merge across the border must never have come before."""
        a, b = a.copy(), b.copy()
        good, limit, open_ = np.ones(len(a), bool), np.full(len(a), NEVER), np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            key = x * len(self.rank) + y
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            across = np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)
            bad = across < limit[open_]
            good[open_[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            more = ~bad & ((rx >= 0) | (ry >= 0))
            first = more & (rx > ry)
            second = more & ~first
            limit[open_[first]], a[open_[first]] = rx[first], self.right[x[first]]
            limit[open_[second]], b[open_[second]] = ry[second] + 1, self.left[y[second]]
            open_ = open_[more]
        return good

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index in ``long``) of all pieces of several characters in the text, by its suffix array."""
        alphabet, dense = np.unique(codes, return_inverse=True)
        dense = dense + 1
        bits = max(1, int(len(alphabet) + 1).bit_length())
        per = 63 // bits  # characters in a column of the sort key
        columns = -(-self.width // per)
        padded = np.concatenate([dense, np.zeros(per * columns, np.int64)])
        n = len(codes)
        keys = []
        for c in range(columns):
            col = np.zeros(n, np.int64)
            for k in range(per):
                col = (col << bits) | padded[c * per + k : c * per + k + n]
            keys.append(col)
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        at = np.searchsorted(alphabet, self.chars)
        inside = (alphabet[np.minimum(at, len(alphabet) - 1)] == self.chars) | (self.chars == 0)
        chosen = np.flatnonzero(inside.all(1))
        chars = np.where(self.chars[chosen] == 0, 0, at[chosen] + 1)
        chars = np.pad(chars, ((0, 0), (0, per * columns - self.width)))
        length = self.length[chosen]
        lo, hi = np.zeros(len(chosen), np.int64), np.full(len(chosen), n)
        for c in range(columns):
            col = np.zeros(len(chosen), np.int64)
            for k in range(per):
                col = (col << bits) | chars[:, c * per + k]
            rest = np.clip(length - c * per, 0, per)
            top = col | ((np.int64(1) << (bits * (per - rest))) - 1)
            if not c:
                lo, hi = np.searchsorted(keys[0], col), np.searchsorted(keys[0], top, "right")
            else:
                for i in np.flatnonzero((rest > 0) & (hi > lo)):
                    part = keys[c][lo[i] : hi[i]]
                    lo[i], hi[i] = lo[i] + np.searchsorted(part, col[i]), lo[i] + np.searchsorted(part, top[i], "right")
        count = hi - lo
        chosen, lo, count = chosen[count > 0], lo[count > 0], count[count > 0]
        index = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        return suffixes[index], np.repeat(chosen, count)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian 32-bit) of words with at most one blank, which leads."""
        text = "\n".join(words).replace(" ", SPACE)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        breaks = np.flatnonzero(codes == 10)
        first = np.append(0, breaks + 1)  # of each word
        key = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.side_by_side, key), len(self.side_by_side) - 1)
        apart = (self.side_by_side[at] != key) & (codes[:-1] != 10) & (codes[1:] != 10)
        starts = np.union1d(first, np.flatnonzero(apart) + 1)  # of each part of a word
        ends = np.append(starts[1:], len(codes) + 1)
        ends[np.isin(ends, np.append(first, len(codes) + 1))] -= 1  # a word's last part ends before the break
        begin = np.repeat(starts, np.diff(np.append(starts, len(codes))))  # each character's part's start
        pos, piece = self.occurrences(codes)
        size, piece = self.length[piece], self.long[piece]
        every = np.flatnonzero(codes != 10)
        slot = np.minimum(np.searchsorted(self.single_code, codes[every]), len(self.single_code) - 1)
        one = np.where(self.single_code[slot] == codes[every], self.single_id[slot], self.unknown)
        pos, piece, size = np.concatenate([every, pos]), np.concatenate([one, piece]), np.concatenate([np.ones(len(every), np.int64), size])
        reach = pos + size - begin[pos]
        by = np.argsort(reach, kind="stable")
        pos, piece, size, reach = pos[by], piece[by], size[by], reach[by]
        cuts = np.flatnonzero(np.diff(reach)) + 1
        last, back = np.full(len(codes) + 1, -1, np.int64), np.zeros(len(codes) + 1, np.int64)
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pos)], strict=True):
            p, t = pos[a:b], piece[a:b]
            head = p == begin[p]
            before = last[p]
            ok = head.copy()
            inner = np.flatnonzero(~head & (before >= 0))
            ok[inner] = self.fit(before[inner], t[inner])
            e = p[ok] + size[a:b][ok]
            last[e], back[e] = t[ok], p[ok]
        tokens, owner, step = [], [], 0
        at, who = ends.copy(), np.arange(len(starts))
        steps = []
        while len(at):
            got = last[at]
            tokens.append(got)
            owner.append(who)
            steps.append(np.full(len(at), -step))
            at = np.where(got >= 0, back[at], starts[who])
            more = at > starts[who]
            at, who, step = at[more], who[more], step + 1
        tokens, owner, steps = np.concatenate(tokens), np.concatenate(owner), np.concatenate(steps)
        by = np.lexsort((steps, owner))
        tokens, owner = tokens[by], np.searchsorted(first, starts[owner[by]], "right") - 1
        bound = np.searchsorted(owner, np.arange(len(words) + 1))
        flat = tokens.astype("<i4").tobytes()
        out = [flat[4 * a : 4 * b] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
        for w in np.unique(owner[(tokens == self.unknown) | (tokens < 0)]).tolist():
            ids = tokens[bound[w] : bound[w + 1]]
            out[w] = self._spelled(words[w].replace(" ", SPACE), None if (ids < 0).any() else ids)
        return out

    def _spelled(self, word: str, ids: np.ndarray | None) -> bytes:
        """Characters without a piece as bytes; without a path, the plain loop."""
        parts, out = [], []
        if ids is None:
            parts = merge(word, self.score)[0]
        else:
            for i in ids.tolist():
                k = sum(map(len, parts))
                parts.append(word[k] if i == self.unknown else self.v.pieces[i])
        for p in parts:
            out += [self.ids[p]] if p in self.ids else [self.v.byte_ids[b] for b in p.encode()]
        return np.array(out, "<i4").tobytes()

    def _blanks(self, k: int) -> bytes:
        longest = len(self.v.runs) - 1
        return np.array(self.v.runs[longest] * (k // longest) + self.v.runs[k % longest], "<i4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode words that are not known yet; runs of blanks and line breaks are put together from known ids."""
        known = self.words
        new = {w for w in words if w not in known}
        blank = [w for w in new if w.startswith("  ") or w == " "]
        plain = [w for w in new if w[0] != "\n" and not w.startswith("  ") and w != " "]
        plain += {" " + w.lstrip(" ") for w in blank if w.strip(" ")} - set(plain) - known.keys()
        for a in range(0, len(plain), BATCH_WORDS):
            part = plain[a : a + BATCH_WORDS]
            known.update(zip(part, self.encode_words(part), strict=True))
        lone = np.array([self.ids.get(SPACE, self.unknown)], "<i4").tobytes()
        for w in blank:
            k = len(w) - len(w.lstrip(" "))
            if k == len(w):
                known[w] = self._blanks(k)
            else:
                rest = known[" " + w.lstrip(" ")]
                known[w] = self._blanks(k) + rest[4:] if rest[:4] == lone else self._blanks(k - 1) + rest
        known["\n"] = np.array([self.v.byte_ids[10]], "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_WORDS.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        self.learn(set().union(*split) if split else set())
        known = self.words
        return [b"".join([known[w] for w in words]) for words in split]

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the ids' text, without the blank that encoding puts first; unknown ids give nothing."""
        table, n = self.as_bytes, len(self.as_bytes)
        out = b"".join([table[i] for i in ids if 0 <= i < n])
        return out[1:] if out[:1] == b" " else out


def _matcher(v: Vocabulary, key: str) -> Matcher:
    """One matcher for all tasks of a worker process."""
    kept = sys.modules.setdefault("_framequarry_matchers", types.ModuleType("_framequarry_matchers"))
    if not hasattr(kept, key):
        setattr(kept, key, Matcher(v))
    return getattr(kept, key)


def _key(v: Vocabulary) -> str:
    return "m" + hashlib.md5(repr((v.pieces, v.rank.tolist())).encode()).hexdigest()


def encode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_pieces, ids, round_trip (whether decoding gives the text back byte by byte).

    Ids are those of the library for the same model. Null and empty texts have no ids and go round. A text with the
    character U+2581 is encoded as if it were a blank, as the library does, and does not go round. Texts are encoded
    whole; a word takes time in proportion to its longest stretch of characters that pieces have side by side. Null
    identifiers stay null; rows that repeat have equal results. Other columns, whatever their names, are not read. Empty
    input gives no rows.
    """
    key = _key(vocabulary)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # of the vocabulary's size, not the data's

    def run(batches):
        m = _matcher(shared.value, key)
        for batch in batches:
            column = batch.column(1)
            offsets, data = string_bytes(column)
            for a, b in chunks(offsets, BATCH_BYTES):
                raw = [data[x:y].tobytes() for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist(), strict=True)]
                got = m.encode([r.decode() for r in raw])
                flat = np.frombuffer(b"".join(got), "<i4")
                sizes = np.array([len(g) // 4 for g in got], np.int64)
                back = [m.decode(np.frombuffer(g, "<i4").tolist()) == r for g, r in zip(got, raw, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), lists, pa.array(back)], names=["id", "n_pieces", "ids", "round_trip"])

    rows = df.select(df[id_col].cast("long").alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "id long, n_pieces long, ids array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, text. Null ids give an empty text; bytes that are no UTF-8 become U+FFFD."""
    key = _key(vocabulary)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        m = _matcher(shared.value, key)
        for batch in batches:
            texts = [m.decode([i for i in ids or [] if i is not None]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = df.select(df[id_col].cast("long").alias("id"), df[ids_col].cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
