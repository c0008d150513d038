"""Operator 2, SentencePiece encoding and decoding by a batched numpy Viterbi.

A model of the BPE kind does not maximise a sum of scores, so that a plain Viterbi would not give its
ids. The recursion is the same, but a step is admissible only if merging would leave the two tokens
at its joint apart; then exactly one token ends each prefix, and the maximum over lengths finds it. Words
of equal length advance together; hashes of their substrings probe the sorted keys of the pieces.
Words begin at spaces, which no piece holds but at its start. Long words are cut into windows that advance together.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words of more characters are scanned in windows of WINDOW characters that start WARM before; RUN windows at a time.
LONG, WINDOW, WARM, RUN = 4096, 2048, 256, 1024
CACHE_WORDS, CACHE_PAIRS, GROUP_CHARS, BATCH_WORDS = 400_000, 1 << 20, 4_000_000, 20_000
_STATE: dict = {}


def merged(symbols: list[str], score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """Symbols after all merges (best score first, then leftmost), and the last pair merged."""
    parts: list[str | None] = list(symbols)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b < len(parts) and (s := score.get(parts[a] + parts[b])) is not None:
            heapq.heappush(heap, (-s, a, b, parts[a] + parts[b]))

    for i in range(len(parts) - 1):
        offer(i, i + 1)
    last = None
    while heap:
        _, a, b, both = heapq.heappop(heap)
        if parts[a] is None or parts[b] is None or parts[a] + parts[b] != both or after[a] != b:
            continue
        last = (parts[a], parts[b])
        parts[a], parts[b], after[a] = both, None, after[b]
        if after[a] < len(parts):
            before[after[a]] = a
        offer(before[a], a)
        offer(a, after[a])
    return [p for p in parts if p is not None], last


class Codec:
    """Encodes and decodes with a SentencePiece model of the BPE kind with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        piece = {i: sp.id_to_piece(i) for i in normal}
        self.bytes = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.score = {piece[i]: sp.get_score(i) for i in normal}
        self.space_id = sp.piece_to_id(SPACE)
        self.id_of = {t: i for i, t in piece.items()}
        self.tail: dict[int, np.ndarray] = {}
        # Token numbers: 0 a character of no piece, then characters, then pieces by falling score.
        letters = sorted({c for t in piece.values() for c in t})
        longer = [t for t in sorted(piece.values(), key=lambda t: (-self.score[t], t)) if len(t) > 1 and set(t) != {SPACE}]
        score = {t: self.score[t] for t in longer}
        split, kept = {}, []
        for t in longer:
            left, pair = merged(list(t), score)
            if left == [t]:
                split[t] = pair
                kept.append(t)
        self.names = ["", *letters, *kept]
        number = {t: k for k, t in enumerate(self.names)}
        self.ids = np.array([self.id_of.get(t, -1) for t in self.names], dtype=np.int64)
        self.left, self.right = (np.arange(len(self.names)) for _ in range(2))
        for t in kept:
            self.left[number[t]], self.right[number[t]] = number[split[t][0]], number[split[t][1]]
        joint = {}
        for t in kept:
            for k in range(1, len(t)):
                if t[:k] in number and t[k:] in number:
                    joint[number[t[:k]] * len(self.names) + number[t[k:]]] = number[t]
        self.joint_keys = np.array(sorted(joint), dtype=np.int64)
        self.joint_token = np.array([joint[k] for k in self.joint_keys.tolist()], dtype=np.int64)
        self.longest = max(map(len, kept), default=1)
        codes = np.array([ord(c) for c in letters], dtype=np.int64)
        self.letter_codes, self.letter_token = codes, np.arange(1, len(letters) + 1)
        keys = np.array([self._hash(t) for t in kept], dtype=np.uint64)
        order = np.argsort(keys)
        self.piece_keys = keys[order]
        self.piece_token = (np.arange(len(kept)) + 1 + len(letters))[order]
        self.piece_length = np.array([len(t) for t in kept], dtype=np.int64)[order]
        self.pair_key = np.full(CACHE_PAIRS, -1, dtype=np.int64)
        self.pair_apart = np.zeros(CACHE_PAIRS, dtype=bool)
        self.known: dict[str, bytes] = {}
        texts = [b""] * size
        for i in range(size):
            if sp.is_byte(i):
                texts[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
            elif i in piece:
                texts[i] = piece[i].replace(SPACE, " ").encode("utf-8")
            elif sp.is_unknown(i):
                texts[i] = " ⁇ ".encode()
        self.flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    def _apart(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """True where merging the two tokens' characters gives back the two tokens."""
        key = one * len(self.names) + two
        slot = ((key.astype(np.uint64) * BASE) >> np.uint64(44)).astype(np.int64) & (CACHE_PAIRS - 1)
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            fresh = np.unique(key[new])
            result = self._compute_apart(fresh // len(self.names), fresh % len(self.names))
            out = self.pair_apart[slot]
            out[new] = result[np.searchsorted(fresh, key[new])]
            at = ((fresh.astype(np.uint64) * BASE) >> np.uint64(44)).astype(np.int64) & (CACHE_PAIRS - 1)
            # Pairs that share a slot: the last written stays, key and value alike.
            _, last = np.unique(at[::-1], return_index=True)
            last = len(at) - 1 - last
            self.pair_key[at[last]], self.pair_apart[at[last]] = fresh[last], result[last]
            return out
        return self.pair_apart[slot]

    def _compute_apart(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Undo the later merge of the two sides again and again; a better merge across the joint decides."""
        apart = np.ones(len(one), dtype=bool)
        rows, limit = np.arange(len(one)), np.full(len(one), np.iinfo(np.int64).max)
        one, two = one.copy(), two.copy()
        while len(rows):
            key = one * len(self.names) + two
            at = np.minimum(np.searchsorted(self.joint_keys, key), len(self.joint_keys) - 1)
            across = (self.joint_keys[at] == key) & (self.joint_token[at] < limit)
            apart[rows[across]] = False
            whole1, whole2 = self.left[one] == one, self.left[two] == two
            # Undo the side merged last; of equals, the right one. A single character cannot be undone.
            first = np.where(whole1, False, np.where(whole2, True, one > two))
            limit = np.where(first, one, two + 1)
            go = ~across & ~(whole1 & whole2)
            one, two = np.where(first, self.right[one], one), np.where(first, two, self.left[two])
            rows, one, two, limit = rows[go], one[go], two[go], limit[go]
        return apart

    def _scan(self, codes: np.ndarray, token: np.ndarray, back: np.ndarray, begin: int = 1) -> None:
        """Fill the last token of each prefix from `begin` characters on, and its length, for rows of equally many characters.

        What stands before is taken as it is: a prefix depends on the `longest` before it only.
        """
        n, length = codes.shape
        at = np.minimum(np.searchsorted(self.letter_codes, codes), len(self.letter_codes) - 1)
        letters = np.where(self.letter_codes[at] == codes, self.letter_token[at], 0)
        prefix = np.zeros((n, length + 1), dtype=np.uint64)
        power = np.ones(self.longest + 1, dtype=np.uint64)
        for k in range(self.longest):
            power[k + 1 :] *= BASE
        for k in range(length):
            prefix[:, k + 1] = prefix[:, k] * BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
        for end in range(begin, length + 1):
            rows = np.arange(n)
            for size in range(min(end, self.longest), 0, -1):
                if size > 1:
                    key = prefix[rows, end] - prefix[rows, end - size] * power[size]
                    place = np.minimum(np.searchsorted(self.piece_keys, key), len(self.piece_keys) - 1)
                    ok = (self.piece_keys[place] == key) & (self.piece_length[place] == size)
                    found, some = rows[ok], self.piece_token[place[ok]]
                else:
                    found, some = rows, letters[rows, end - 1]
                if not len(found):
                    continue
                if end > size:
                    fits = self._apart(token[found, end - size], some)
                    found, some = found[fits], some[fits]
                token[found, end], back[found, end] = some, size
                rows = rows[back[rows, end] == 0]
                if not len(rows):
                    break

    def _long_word(self, word: str) -> bytes:
        """Ids of one long word.

        Windows are scanned as if each began a word. Where a window's tokens equal the true ones at as many places side by side as
        a prefix depends on, all its later ones are true too; a window that never meets them is scanned again from them.
        """
        codes = np.frombuffer((SPACE + word).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        n = len(codes)
        token, back = np.zeros(n + 1, dtype=np.int32), np.zeros(n + 1, dtype=np.int16)
        starts = np.arange(0, n, WINDOW)
        for a in range(0, len(starts), RUN):
            some = starts[a : a + RUN]
            columns = np.arange(WINDOW + WARM)
            places = np.maximum(some - WARM, 0)[:, None] + columns
            own = codes[np.minimum(places, n - 1)]
            made, size = (np.zeros((len(some), WINDOW + WARM + 1), dtype=np.int64) for _ in range(2))
            self._scan(own, made, size)
            for row, start in enumerate(some.tolist()):
                low, high = max(start - WARM, 0), min(start + WINDOW, n)
                if start:
                    # Prefixes low + 1 to start are known; the window must agree with them where it ends its warm-up.
                    seen = slice(start - low + 1 - self.longest, start - low + 1)
                    if (made[row, seen] != token[start + 1 - self.longest : start + 1]).any():
                        made[row, : start - low + 1], size[row, : start - low + 1] = token[low : start + 1], back[low : start + 1]
                        made[row, start - low + 1 :], size[row, start - low + 1 :] = 0, 0
                        self._scan(own[row : row + 1], made[row : row + 1], size[row : row + 1], start - low + 1)
                token[start + 1 : high + 1] = made[row, start - low + 1 : high - low + 1]
                back[start + 1 : high + 1] = size[row, start - low + 1 : high - low + 1]
        path, place = [], n
        steps, tokens = back.tolist(), token.tolist()
        while place:
            path.append(tokens[place])
            place -= steps[place]
        path = np.array(path[::-1], dtype=np.int64)
        ids = self.ids[path]
        if (ids >= 0).all():
            return ids.astype("<u4").tobytes()
        return self._with_bytes(word, path.tolist(), ids.tolist())

    def _with_bytes(self, word: str, path: list[int], ids: list[int]) -> bytes:
        """Ids of a word's tokens; characters of no piece become bytes."""
        row, at = [], 0
        for t, i in zip(path, ids, strict=True):
            if t < 0:
                continue
            size = max(1, len(self.names[t]))
            row += [i] if i >= 0 else [self.bytes[b] for b in (SPACE + word)[at : at + size].encode("utf-8")]
            at += size
        return np.array(row, dtype="<u4").tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length, each with the space before it."""
        n, length = len(words), len(words[0]) + 1
        if length > LONG:
            return [self._long_word(w) for w in words]
        codes = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le"), dtype=np.uint32).reshape(n, length).astype(np.int64)
        token, back = (np.zeros((n, length + 1), dtype=np.int64) for _ in range(2))
        self._scan(codes, token, back)
        steps, place = [], np.full(n, length)
        while place.any():
            steps.append(np.where(place > 0, token[np.arange(n), place], -1))
            place = place - back[np.arange(n), place]
        path = np.stack(steps[::-1], axis=1)
        ids = np.where(path >= 0, self.ids[np.maximum(path, 0)], -2)
        plain = (ids != -1).all(axis=1)
        return [
            ids[k][ids[k] >= 0].astype("<u4").tobytes() if plain[k] else self._with_bytes(w, path[k].tolist(), ids[k].tolist())
            for k, w in enumerate(words)
        ]

    def _learn(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for length, group in by_length.items():
            step = max(1, BATCH_WORDS * 8 // (length + 8))
            for a in range(0, len(group), step):
                some = group[a : a + step]
                self.known.update(zip(some, self._words(some), strict=True))

    def _spaces(self, n: int) -> np.ndarray:
        """Ids of n spaces that stand alone side by side."""
        if n not in self.tail:
            parts, _ = merged([SPACE] * n, self.score)
            self.tail[n] = np.array([self.id_of[p] for p in parts], dtype="<u4")
        return self.tail[n]

    def _joined_spaces(self, ids: np.ndarray) -> np.ndarray:
        alone = np.append(np.append(False, ids == self.space_id), False)
        if not (alone[1:-1] & alone[:-2]).any():
            return ids
        edge = np.flatnonzero(alone[1:] != alone[:-1])
        out, last = [], 0
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            out += [ids[last:a], self._spaces(int(b - a))]
            last = b
        return np.concatenate([*out, ids[last:]])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of some texts."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        lists = pc.split_pattern(pa.array([t.replace(SPACE, " ") for t in texts], pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn([w for w in words if w not in self.known])
        each = list(map(self.known.__getitem__, words))
        flat = np.frombuffer(b"".join(each), dtype="<u4")
        sizes = np.array([len(x) for x in each], dtype=np.int64) // 4
        starts = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        own = sizes[codes]
        ends = np.cumsum(own)
        out = flat[np.repeat(starts[codes] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.append(0, ends)[lists.offsets.to_numpy()].tolist()
        parts = (out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))
        return [self._joined_spaces(p) if t else p[:0] for t, p in zip(texts, parts, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; invalid bytes become U+FFFD, the space before the first word goes."""
        own = self.size[ids]
        ends = np.cumsum(own)
        at = np.repeat(self.start[ids] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)
        text = self.flat[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") and len(ids) and self.size[ids[0]] and self.flat[self.start[ids[0]]] == 32 else text


def codec(path: str) -> Codec:
    """This process's codec of a model file."""
    if path not in _STATE:
        _STATE[path] = Codec(path)
    return _STATE[path]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about GROUP_CHARS in all."""
    a = total = 0
    for b, t in enumerate(texts):
        total += len(t)
        if total >= GROUP_CHARS:
            yield texts[a : b + 1]
            a, total = b + 1, 0
    if a < len(texts):
        yield texts[a:]


def encode(docs: DataFrame, model_path: str, packed: bool = False) -> DataFrame:
    """doc_id and ids (array of int; packed: little-endian unsigned 32-bit in a binary) for each row of docs.

    docs has doc_id and text; other columns are ignored. A null or empty text has no ids. Repeated rows and null
    doc_ids have their own result rows. An empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model_path)
        for part in batches:
            texts = [t or "" for t in part["text"]]
            made = [i for group in _groups(texts) for i in own.encode(group)]
            ids = [i.astype("<u4").tobytes() if packed else i.astype(np.int32) for i in made]
            yield pd.DataFrame({"doc_id": part["doc_id"], "ids": pd.Series(ids, index=part.index, dtype=object)})

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids {'binary' if packed else 'array<int>'}"
    return docs.select("doc_id", "text").mapInPandas(run, kind)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text for each row of encoded (doc_id, ids as encode gives them, packed or not); null ids give ''."""
    packed = encoded.schema["ids"].dataType.typeName() == "binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model_path)
        for part in batches:
            texts = [
                "" if i is None else own.decode(np.frombuffer(i, "<u4") if packed else np.asarray(i, dtype=np.int64)) for i in part["ids"]
            ]
            yield pd.DataFrame({"doc_id": part["doc_id"], "text": pd.Series(texts, index=part.index, dtype=object)})

    kind = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string"
    return encoded.select("doc_id", "ids").mapInPandas(run, kind)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, and the length and sha256 of the decoded text, for each row of docs.

    Encoding and decoding run in one pass, so that a task needs one Python worker.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model_path)
        for part in batches:
            texts, rows = [t or "" for t in part["text"]], []
            for group in _groups(texts):
                for ids in own.encode(group):
                    back = own.decode(ids)
                    digest = hashlib.sha256(back.encode("utf-8")).hexdigest()
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(back), digest))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_crc32", "decoded_chars", "decoded_sha256"])
            out.insert(0, "doc_id", part["doc_id"].reset_index(drop=True))
            yield out

    own_id = docs.schema["doc_id"].dataType.simpleString()
    kind = f"doc_id {own_id}, n_tokens long, ids_crc32 long, decoded_chars long, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInPandas(run, kind)
