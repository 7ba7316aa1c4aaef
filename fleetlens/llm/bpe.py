"""Byte-pair encoding through a minimal acyclic transducer, and back.

Frequent words are counted over the whole corpus, encoded once, and compiled
into an automaton with shared suffixes. Each arc carries how many words sort
before those behind it, so the sum along a path is the word's number, and that
number finds its token ids. The automaton is one array in the shared folder;
tasks map it into memory. Words it does not hold are merged exactly, many at a
time, by the ranks of the vocabulary file. The vocabulary file's path is a
parameter; nothing of it is stored here.
"""

from __future__ import annotations

import heapq
import io
import json
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from ..workspace import shared_dir
from .common import pieces, texts
from .files import put

# Fixed value: how the byte-level vocabulary family cuts a text into words. White space is spelled out as Unicode has it.
_S = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{_S}\\p{{L}}\\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

CHUNK_BYTES = 2 << 20
# White space of one byte, and bytes that one of several bytes may begin with.
_SPACE, _WIDE = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = _WIDE[[0xE1, 0xE2, 0xE3]] = True
NO_RANK = np.int64(1) << 40
_SCATTER = np.uint64(0x9E3779B97F4A7C15)
# Longer words are merged one by one: a matrix of them would be mostly padding.
MATRIX_LENGTH = 48


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Ids, merge ranks and token bytes of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        ids = spec["model"]["vocab"]
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, number in ids.items():
            self.token_bytes[number] = bytes(letters[c] for c in token)
        for token, number in self.special.items():
            self.token_bytes[number] = token.encode()
        self.first = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.first[byte] = ids[letter]
        keys, ranks, made = [], [], []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            keys.append(ids[left] << 20 | ids[right])
            ranks.append(rank)
            made.append(ids[left + right])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        # Rank and new id in one number, so that the smallest number is the best merge.
        self.merges = (np.array(ranks, np.int64) << 20 | np.array(made, np.int64))[order]
        self._hash()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self.lengths, self.starts = lengths, np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = np.frombuffer(b"".join(self.token_bytes), np.uint8)

    def _hash(self) -> None:
        """Put the pairs into slots by a hash, each into the first free one from its own on; about one in eight is taken."""
        bits = max(4, int(len(self.keys)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        # Room behind the last slot, so that none begins anew at the first.
        self.slots, self.slot_merges = np.full((1 << bits) + len(self.keys) + 1, -1), np.full((1 << bits) + len(self.keys) + 1, NO_RANK)
        slot, waiting = self.keys.astype(np.uint64) * _SCATTER >> self.shift, np.arange(len(self.keys))
        while len(waiting):
            free = self.slots[slot] < 0
            self.slots[slot[free]], self.slot_merges[slot[free]] = self.keys[waiting[free]], self.merges[waiting[free]]
            placed = self.slots[slot] == self.keys[waiting]
            waiting, slot = waiting[~placed], slot[~placed] + np.uint64(1)

    def words(self, text: str) -> list[str]:
        """Cut a text; strings of special tokens stay whole."""
        if self.split is None or not any(token in text for token in self.special):
            return WORDS.findall(text)
        found: list[str] = []
        for part in self.split.split(text):
            found += [part] if part in self.special else WORDS.findall(part)
        return found

    def best(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Packed rank and id of merging each pair, NO_RANK where there is no merge."""
        # Below zero, and so no key, where one of them is.
        wanted = (left << 20 | right).ravel()
        found, open_ = np.full(len(wanted), NO_RANK), np.arange(len(wanted))
        slot = wanted.astype(np.uint64) * _SCATTER >> self.shift
        while len(open_):
            here = self.slots[slot]
            same = here == wanted
            found[open_[same]] = self.slot_merges[slot[same]]
            more = ~same & (here >= 0)
            if not more.any():
                break
            wanted, open_, slot = wanted[more], open_[more], slot[more] + np.uint64(1)
        return found.reshape(left.shape)

    def merge_long(self, word: bytes) -> list[int]:
        """Exact merges of one word with a heap: lowest rank first, leftmost among equals."""
        ids = self.first[np.frombuffer(word, np.uint8)]
        after = list(range(1, len(ids) + 1))
        before = list(range(-1, len(ids) - 1))
        packed = self.best(ids[:-1], ids[1:])
        heap = [(int(p) >> 20, i, int(p) & 0xFFFFF, int(ids[i]), int(ids[i + 1])) for i, p in enumerate(packed) if p < NO_RANK]
        heapq.heapify(heap)
        now = ids.tolist()

        def offer(i: int, j: int) -> None:
            p = int(self.best(np.array([now[i]]), np.array([now[j]]))[0])
            if p < NO_RANK:
                heapq.heappush(heap, (p >> 20, i, p & 0xFFFFF, now[i], now[j]))
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i]
            if now[i] != left or j >= len(now) or now[j] != right:
                continue
            now[i], now[j] = made, -1
            after[i] = after[j]
            if after[i] < len(now):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [i for i in now if i >= 0]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """Exact merges of many words of one length class: every step merges the best pair of every row, which ends one place shorter."""
        length = max(map(len, words))
        sizes = np.array([len(word) for word in words])
        rows = np.full((len(words), length), -1, np.int64)
        rows[np.arange(length) < sizes[:, None]] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        pairs = self.best(rows[:, :-1], rows[:, 1:])
        alive = np.arange(len(words))
        done: list[list[int]] = [[]] * len(words)
        while len(alive):
            width = pairs.shape[1]
            at = pairs.argmin(1) if width else np.zeros(len(alive), int)
            value = pairs[np.arange(len(alive)), at] if width else np.full(len(alive), NO_RANK)
            over = value >= NO_RANK
            if over.any():
                for row, ids in zip(alive[over].tolist(), rows[over].tolist(), strict=True):
                    done[row] = [i for i in ids if i >= 0]
                keep = ~over
                alive, rows, pairs, at, value = alive[keep], rows[keep], pairs[keep], at[keep], value[keep]
                if not len(alive):
                    break
            own, places = np.arange(len(alive)), np.arange(width + 1)
            rows = rows[places != at[:, None] + 1].reshape(len(alive), width)
            rows[own, at] = value & 0xFFFFF
            pairs = pairs[places[:-1] != at[:, None]].reshape(len(alive), width - 1)
            right, left = np.flatnonzero(at < width - 1), np.flatnonzero(at > 0)
            pairs[right, at[right]] = self.best(rows[right, at[right]], rows[right, at[right] + 1])
            pairs[left, at[left] - 1] = self.best(rows[left, at[left] - 1], rows[left, at[left]])
        return done

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word, by merging alone."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        block: list[int] = []
        for i in order:
            if len(words[i]) > MATRIX_LENGTH:
                out[i] = self.merge_long(words[i])
                continue
            if block and (len(block) >= 8192 or len(words[i]) > max(4, 1.5 * len(words[block[0]]))):
                for k, ids in zip(block, self.merge_many([words[k] for k in block]), strict=True):
                    out[k] = ids
                block = []
            if words[i]:
                block.append(i)
        if block:
            for k, ids in zip(block, self.merge_many([words[k] for k in block]), strict=True):
                out[k] = ids
        return out


def compile_lexicon(entries: dict[bytes, list[int]]) -> np.ndarray:
    """The transducer as one array: sizes, arcs (key, target, words skipped), final states, ids.

    Words come in byte order. States that accept the same endings are one
    state, found by looking up their arcs among the finished states.
    """
    known: dict[tuple, int] = {}
    states: list[tuple] = []
    behind: list[int] = []

    def finish(final: bool, arcs: list[tuple[int, int]]) -> int:
        form = (final, tuple(arcs))
        if form not in known:
            known[form] = len(states)
            states.append(form)
            behind.append(final + sum(behind[target] for _, target in arcs))
        return known[form]
    path: list[list] = [[False, [], -1]]  # final, finished arcs, byte of the open arc

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs, _ = path.pop()
            path[-1][1].append((path[-1][2], finish(final, arcs)))
    previous = b""
    words = sorted(entries)
    for word in words:
        shared = 0
        while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
            shared += 1
        close(shared)
        for byte in word[shared:]:
            path[-1][2] = byte
            path.append([False, [], -1])
        path[-1][0] = True
        previous = word
    close(0)
    root = finish(path[0][0], path[0][1])
    keys, targets, skips = [], [], []
    for number, (final, arcs) in enumerate(states):
        skipped = int(final)
        for byte, target in arcs:
            keys.append(number << 8 | byte)
            targets.append(target)
            skips.append(skipped)
            skipped += behind[target]
    lists = [entries[word] for word in words]
    offsets = np.concatenate([[0], np.cumsum([len(ids) for ids in lists])])
    flat = [i for ids in lists for i in ids]
    return np.concatenate([np.array(part, np.int64) for part in (
        [root, len(keys), len(states), len(words), len(flat)], keys, targets, skips, [s[0] for s in states], offsets, flat)])


class Lexicon:
    """Looks up many words at once in a compiled transducer."""

    def __init__(self, data: np.ndarray):
        self.root, arcs, states, words, ids = (int(n) for n in data[:5])
        cut = np.cumsum([5, arcs, arcs, arcs, states, words + 1, ids])
        self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = (
            data[a:b] for a, b in zip(cut, cut[1:]))
        self.words = words

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 where the lexicon does not hold it."""
        numbers = np.full(len(words), -1, np.int64)
        if not self.words or not words:
            return numbers
        lengths = np.array([len(word) for word in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        letters = np.frombuffer(b"".join(words), np.uint8)
        alive = np.arange(len(words))
        state, skipped = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        depth = 0
        while len(alive):
            ended = lengths[alive] == depth
            if ended.any():
                accepted = alive[ended][self.final[state[ended]] == 1]
                numbers[accepted] = skipped[ended][self.final[state[ended]] == 1]
                alive, state, skipped = alive[~ended], state[~ended], skipped[~ended]
            if not len(alive):
                break
            wanted = state << 8 | letters[starts[alive] + depth]
            arc = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            found = self.keys[arc] == wanted
            alive, arc = alive[found], arc[found]
            state, skipped = self.targets[arc], skipped[found] + self.skips[arc]
            depth += 1
        return numbers


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def _mapped(name: str) -> Lexicon:
    return Lexicon(np.load(SparkFiles.get(name), mmap_mode="r"))


def build_lexicon(docs: DataFrame, vocab_path: str, words: int = 60_000, per_chunk: int = 20_000) -> str:
    """Count words over all texts, compile the most frequent ones, and hand the file to every executor.

    A task reports the ``per_chunk`` most frequent words of each chunk of text.
    The lexicon changes how fast a word is found, never its ids. Returns the
    file's name for ``encode``.
    """
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in pieces(batches, CHUNK_BYTES):
            counts: Counter[str] = Counter()
            for text in batch.column("text").to_pylist():
                counts.update(vocab.words(text))
            top = counts.most_common(per_chunk)
            yield pa.RecordBatch.from_pydict({"word": [w for w, _ in top], "n": pa.array([n for _, n in top], pa.int64())})
    counted = texts(docs).select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequent = [row.word for row in counted.orderBy(F.desc("n"), "word").limit(words).collect()]
    vocab = vocabulary(vocab_path)
    keys = sorted({word.encode() for word in frequent if word and word not in vocab.special})
    buffer = io.BytesIO()
    np.save(buffer, compile_lexicon(dict(zip(keys, vocab.merge(keys), strict=True))))
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    path = f"{shared_dir(spark)}/{name}"
    put(path, buffer.getvalue())
    spark.sparkContext.addFile(path)
    return name


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Cut:
    """Texts cut into parts, and each different part into words: a word is looked at once for all parts like its own.

    A part begins where white space follows something else, or with the text.
    Words do too, and depend on nothing before them, so the words of the parts
    are those of the texts. Texts that hold a special token are cut into words
    at once.
    """

    def __init__(self, column: pa.Array, vocab: Vocabulary):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        body = column.buffers()[2] if len(column) else None
        data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        offsets = (offsets - offsets[0]).astype(np.int64)
        begins = np.zeros(len(data) + 1, bool)
        begins[_after_words(data)] = True
        begins[offsets] = True
        whole = data.tobytes()
        if any(token.encode() in whole for token in vocab.special):
            for row, text in enumerate(column.to_pylist()):
                if any(token in text for token in vocab.special):
                    begins[offsets[row]:offsets[row + 1]] = False
                    sizes = [len(word.encode()) for word in vocab.words(text)]
                    begins[offsets[row] + np.cumsum([0, *sizes[:-1]])] = True
        cuts = np.flatnonzero(begins)
        # The last place of all is no part.
        self.starts = np.searchsorted(cuts, offsets)
        parts = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(whole)).dictionary_encode()
        self.part = parts.indices.to_numpy()
        in_parts = [[part] if part in vocab.special or _one_word(part) else WORDS.findall(part) for part in parts.dictionary.to_pylist()]
        self.words_in = np.array([len(words) for words in in_parts], np.int64)
        flat = [word for words in in_parts for word in words]
        numbers = {word: i for i, word in enumerate(dict.fromkeys(flat))}
        self.words = list(numbers)
        self.word = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))


def _one_word(part: str) -> bool:
    """Latin letters, a space before them or not: what ``WORDS`` takes whole. It has the last say on all else."""
    letters = part[1:] if part[0] == " " else part
    return letters.isalpha() and (letters.isascii() or max(letters) < "\u0250")


def _after_words(data: np.ndarray) -> np.ndarray:
    """Places of white space that stands after something else; a few after characters of several bytes are left out."""
    at = np.flatnonzero(_SPACE[data])
    at = at[at > 0]
    at = at[~_SPACE[data[at - 1]]]
    one, two, three = (data[np.maximum(at - back, 0)] for back in (1, 2, 3))
    return at[(one < 0x80) | ~((two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | _WIDE[three] & (two >= 0x80))]


def encode_texts(values: list[str] | pa.Array, vocab: Vocabulary, lexicon: Lexicon) -> list[np.ndarray]:
    """Token ids of each text."""
    found = Cut(pa.array(values, pa.string()) if isinstance(values, list) else values, vocab)
    distinct = [word.encode() for word in found.words]
    at = lexicon.find(distinct)
    numbers = {word: i for i, word in enumerate(found.words) if word in vocab.special}
    at[list(numbers.values())] = -1
    missing = np.flatnonzero(at < 0).tolist()
    merged = vocab.merge([distinct[i] for i in missing])
    for k, i in enumerate(missing):
        special = vocab.special.get(found.words[i])
        if special is not None:
            merged[k] = [special]
    sizes = np.zeros(len(distinct), np.int64)
    starts = np.zeros(len(distinct), np.int64)
    held = at >= 0
    starts[held] = lexicon.offsets[at[held]]
    sizes[held] = lexicon.offsets[at[held] + 1] - starts[held]
    if missing:
        own = np.array([len(ids) for ids in merged], np.int64)
        sizes[missing] = own
        starts[missing] = len(lexicon.ids) + np.cumsum(own) - own
    pool = np.concatenate([lexicon.ids, np.array([i for ids in merged for i in ids], np.int64)])
    # The ids of each different part, and with them those of the texts.
    pool = pool[_spread(starts[found.word], sizes[found.word])].astype("<u4")
    ends = np.concatenate([[0], np.cumsum(sizes[found.word])])[np.cumsum([0, *found.words_in])]
    sizes = np.diff(ends)[found.part]
    flat = pool[_spread(ends[found.part], sizes)]
    ends = np.concatenate([[0], np.cumsum(sizes)])[found.starts]
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def encode(docs: DataFrame, vocab_path: str, lexicon: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids); ``ids`` are little-endian unsigned 32-bit integers.

    NULL and empty texts have no tokens. Repeated rows give repeated rows, a
    NULL doc_id stays NULL, other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, words = vocabulary(vocab_path), _mapped(lexicon)
        for batch in pieces(batches, CHUNK_BYTES):
            found = encode_texts(batch.column("text"), vocab, words)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(ids) for ids in found], pa.int64()),
                pa.array([ids.tobytes() for ids in found], pa.binary())], names=["doc_id", "n_tokens", "ids"])
    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_ids(packed: list[bytes], vocab: Vocabulary) -> pa.Array:
    """The texts of packed ids, read as UTF-8 each by itself."""
    ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
    lengths = vocab.lengths[ids]
    data = vocab.bytes[_spread(vocab.starts[ids], lengths)]
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *(len(own) // 4 for own in packed)])]
    whole = data.tobytes()
    begins = data[ends[:-1][ends[:-1] < len(data)]]
    try:
        whole.decode()
    except UnicodeDecodeError:
        cut = True
    else:
        # All together may be right where a text ends within a character.
        cut = bool(((begins & 0xC0) == 0x80).any())
    if cut or len(whole) >= 1 << 31:
        return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])], pa.string())
    return pa.StringArray.from_buffers(len(packed), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(whole))


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """Add ``text``, the bytes of the tokens read as UTF-8; special tokens appear as their strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in pieces(batches, CHUNK_BYTES // 2):
            yield pa.RecordBatch.from_arrays([*batch.columns, decode_ids(batch.column("ids").to_pylist(), vocab)], names=[*batch.schema.names, "text"])
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, text string")
