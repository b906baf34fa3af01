"""Byte-pair encoding and decoding with a minimal acyclic transducer lexicon.

``Rules`` reads a tokenizer file (normalisation to NFC, white space and lower case; words by a
pattern; bytes as printable characters; an end-of-word suffix) and merges any word
exactly. The corpus's most frequent words, counted over all documents, are merged
once and compiled into a minimal acyclic transducer: words share prefixes and
suffixes, the outputs along a word's arcs add up to its number, the number leads to
its ids. The automaton is one read-only file in the shared folder. A worker maps it where the folder is
a file system of its machine, so that all workers there share its pages; from other stores it maps a copy of
its own that has no name. Words outside it are merged exactly when they come up. A bounded memory
of recent words stands before both, so a word that recurs is looked up once.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import unicodedata
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, documents, held, materialize, scratch_path, slices
from .tokens import LOWER_WORD, UNSAFE, resolve

MAGIC = b"SLLEXIC1"
LEXICON_WORDS = 200_000
_BITS = 20
_MASK = (1 << _BITS) - 1
_BYTES = [bytes([b]) for b in range(256)]


def byte_alphabet() -> dict[int, str]:
    """The printable character for each byte: itself if it is visible Latin-1, else the next from U+0100 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {b: chr(b) for b in visible}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(visible))
    return out


class Rules:
    """A tokenizer file's normalisation, words, merges and vocabulary."""

    def __init__(self, path: str):
        with open(resolve(path), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        # a pair of ids leads to the rank of its merge and the new id; both in one number, so the least has the lowest rank
        merges = [tuple(m) for m in model["merges"]]
        self.pair = {self.vocab[a] << _BITS | self.vocab[b]: i << _BITS | self.vocab[a + b] for i, (a, b) in reversed(list(enumerate(merges)))}
        self.none = len(merges) << _BITS
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.inner = [self.vocab[alphabet[b]] for b in range(256)]
        self.final = [self.vocab[alphabet[b] + self.suffix] for b in range(256)]
        self.word = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [names.get(i, "") for i in range(max(names) + 1)]
        self.decimal = [str(i) for i in range(len(self.tokens))]

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if not UNSAFE.search(text):
            return LOWER_WORD.findall(text.lower())
        text = regex.sub(r"[\p{White_Space}]+", " ", unicodedata.normalize("NFC", text))
        return self.word.findall("".join(c.lower() for c in text))

    def merge(self, word: str) -> list[int]:
        """Ids of a word: the lowest-ranked adjacent pair is merged, leftmost first, until none is left.

        links[i] is the rank and result of merging ids i and i + 1; a merge changes two of them.
        """
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.final[raw[-1]]
        if len(ids) > 200:
            return self._merge_long(ids)
        get, none = self.pair.get, self.none
        links = [get(a << _BITS | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while links:
            best = min(links)
            if best == none:
                break
            i = links.index(best)
            new = ids[i] = best & _MASK
            del ids[i + 1], links[i]
            if i:
                links[i - 1] = get(ids[i - 1] << _BITS | new, none)
            if i < len(links):
                links[i] = get(new << _BITS | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same result for long words, with a heap of pairs over a linked list."""
        n, get, none = len(ids), self.pair.get, self.none
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(link, i, ids[i], ids[i + 1]) for i in range(n - 1) if (link := get(ids[i] << _BITS | ids[i + 1], none)) != none]
        heapq.heapify(heap)
        while heap:
            link, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = link & _MASK, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (link := get(ids[k] << _BITS | ids[after[k]], none)) != none:
                    heapq.heappush(heap, (link, k, ids[k], ids[after[k]]))
        return [i for i in ids if i >= 0]

    def decode(self, ids) -> str:
        """Tokens joined by single spaces: these files name no decoder. Special tokens stay."""
        return " ".join(map(self.tokens.__getitem__, ids))


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The transducer's bytes.

    Layout: magic; u32 states, arcs, words, ids; u32 first arc of each state and one more;
    u32 finals (1 if a word ends); arcs: u8 labels in order, u32 targets, u32 outputs;
    u32 first id of each word and one more; u32 ids.
    """
    words = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in entries.items() if w)
    registry: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((label, target), ...))

    def freeze(final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        if key not in registry:
            registry[key] = len(states)
            states.append(key)
        return registry[key]

    # the path of the latest word that may still grow: [final, arcs, label that leads here]
    path: list[list] = [[False, [], 0]]
    last = b""
    for word, _ in words:
        common = len(os.path.commonprefix([last, word]))
        while len(path) > common + 1:
            final, arcs, label = path.pop()
            path[-1][1].append((label, freeze(final, arcs)))
        for b in word[common:]:
            path.append([False, [], b])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        final, arcs, label = path.pop()
        path[-1][1].append((label, freeze(final, arcs)))
    root = freeze(path[0][0], path[0][1])
    # words below each state; an arc's output is the number of words that sort before those through it
    below = np.zeros(len(states), np.int64)
    first, final_flags, labels, targets, outputs = [0], [], bytearray(), [], []
    for i, (final, arcs) in enumerate(states):  # targets come before their sources
        total = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            outputs.append(total)
            total += int(below[target])
        below[i] = total
        final_flags.append(int(final))
        first.append(len(labels))
    starts = np.cumsum([0] + [len(ids) for _, ids in words])
    flat = [i for _, ids in words for i in ids]
    u4 = lambda x: np.array(x, "<u4").tobytes()
    return MAGIC + struct.pack("<5I", len(states), len(labels), len(words), len(flat), root) + u4(first) + u4(final_flags) + u4(targets) + u4(outputs) + u4(starts) + u4(flat) + bytes(labels)


class Lexicon:
    """Looks words up in a compiled lexicon, in a memory-mapped file or any buffer."""

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a lexicon")
        states, arcs, words, ids, self.root = struct.unpack_from("<5I", data, 8)
        at, view, parts = 28, memoryview(data), []
        for n in (states + 1, states, arcs, arcs, words + 1, ids):
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.final, self.targets, self.outputs, self.starts, self.ids = parts
        self.data, self.labels = data, at

    @classmethod
    def mapped(cls, uri: str) -> Lexicon:
        """Map a lexicon file: itself if it is a local file, else an unnamed local copy, never a copy on the heap."""
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        if isinstance(store, fs.LocalFileSystem):
            with open(path, "rb") as f:
                return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        with tempfile.TemporaryFile() as f, store.open_input_stream(path) as source:
            while part := source.read(1 << 20):
                f.write(part)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def lookup(self, word: str) -> list[int] | None:
        """The word's ids, or None."""
        state, number, find, base = self.root, 0, self.data.find, self.labels
        first, outputs, targets = self.first, self.outputs, self.targets
        for b in word.encode("utf-8", "surrogatepass"):
            at = find(_BYTES[b], base + first[state], base + first[state + 1]) - base
            if at < 0:
                return None
            number += outputs[at]
            state = targets[at]
        if not self.final[state]:
            return None
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()


class Codec:
    """Encodes and decodes whole texts by lexicon, then exact merges."""

    def __init__(self, tokenizer: str, lexicon: Lexicon, limit: int = 600_000):
        self.rules, self.lexicon = Rules(tokenizer), lexicon
        self.memo = Memo(self._ids, limit)
        self.digests = Memo(self._digest, limit)

    def _ids(self, word: str) -> list[int]:
        found = self.lexicon.lookup(word)
        return self.rules.merge(word) if found is None else found

    def _digest(self, word: str) -> tuple[str, str]:
        ids = self._ids(word)
        return " ".join(map(self.rules.decimal.__getitem__, ids)), self.rules.decode(ids)

    def parts(self, text: str):
        """The text's words and special tokens in order, as (is special, words)."""
        if "<" in text and self.rules.split_special:
            for k, part in enumerate(self.rules.split_special.split(text)):
                if part:
                    yield (True, [part]) if k % 2 else (False, self.rules.words(part))
        else:
            yield False, self.rules.words(text)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for special, words in self.parts(text or ""):
            if special:
                out.append(self.rules.special[words[0]])
            else:
                for ids in map(self.memo.__getitem__, words):
                    out += ids
        return out

    def decode(self, ids) -> str:
        return self.rules.decode(ids)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids in decimal, SHA-256 of the decoded text), word by word."""
        found: list[tuple[str, str]] = []
        for special, words in self.parts(text or ""):
            if special:
                i = self.rules.special[words[0]]
                found.append((self.rules.decimal[i], self.rules.decode([i])))
            else:
                found += map(self.digests.__getitem__, words)
        ids, tokens = " ".join([x[0] for x in found]), " ".join([x[1] for x in found])
        n = ids.count(" ") + 1 if ids else 0
        return n, sha256(ids.encode()).hexdigest(), sha256(tokens.encode("utf-8", "surrogatepass")).hexdigest()


def count_words(docs: DataFrame, tokenizer: str, text_col: str = "text", flush: int = 500_000) -> DataFrame:
    """(word, n) over all whole texts, summed in each task before the shuffle."""

    def run(batches):
        rules, counts, chunks = Rules(tokenizer), Counter(), Counter()

        def out():
            for chunk, n in chunks.items():  # no word spans white space: each distinct chunk is cut once
                for word in LOWER_WORD.findall(chunk):
                    counts[word] += n
            rows = pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear(), chunks.clear()
            return rows

        for batch in (part for whole in batches for part in slices(whole, 0)):
            for text in batch.column(0).to_pylist():
                for k, part in enumerate(rules.split_special.split(text) if rules.split_special else [text]):
                    if k % 2 == 0:
                        if UNSAFE.search(part):
                            counts.update(rules.words(part))
                        else:
                            chunks.update(part.lower().split())
                if len(counts) + len(chunks) >= flush:
                    yield out()
        yield out()

    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", size: int = LEXICON_WORDS) -> bytes:
    """Compile the most frequent words of all documents, at most ``size``; words that occur once are left to the merges.

    Words of like frequency are all in or all out, so that no global sort is needed.
    """

    def merge(batches):
        rules = Rules(tokenizer)
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"word": batch.column(0), "ids": pa.array([rules.merge(w) for w in words], pa.list_(pa.int32()))})

    counted = materialize(count_words(docs, tokenizer, text_col).where("n > 1"), "words")
    # the counts above which at most ``size`` words are, from a histogram over steps of a sixteenth of a doubling
    step = F.floor(F.log2("n") * 16).cast("int")
    histogram = sorted(((r["s"], r["count"]) for r in counted.groupBy(step.alias("s")).count().collect()), reverse=True)
    total, least = 0, 1 << 20
    for s, n in histogram:
        total += n
        if total > size:
            break
        least = s
    top = counted.where(step >= least).select("word")
    merged = top.repartition(8).mapInArrow(merge, "word string, ids array<int>")
    return compile_lexicon({r["word"]: list(r["ids"]) for r in merged.collect()})


def put_lexicon(spark, lexicon: bytes) -> str:
    """Write a lexicon as a file into the shared folder; its address."""
    from pyarrow import fs

    uri = scratch_path(spark, "lexicon")
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/words.lex") as out:
        out.write(lexicon)
    return f"{uri}/words.lex"


def codec_of(tokenizer: str, uri: str) -> Codec:
    """One codec a worker process and lexicon file."""
    return held((tokenizer, uri), lambda: Codec(tokenizer, Lexicon.mapped(uri)))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")


def encode(docs: DataFrame, tokenizer: str, lexicon: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text; null and empty texts have no ids."""
    uri = put_lexicon(docs.sparkSession, lexicon)

    def run(batches):
        codec = codec_of(tokenizer, uri)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            ids = pa.array([codec.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of id arrays; null arrays decode to the empty text."""

    def run(batches):
        rules = Rules(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rules.decode(ids or ()) for ids in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).where("doc_id is not null").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, tokenizer: str, lexicon: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, keeping only digests."""
    uri = put_lexicon(docs.sparkSession, lexicon)

    def run(batches):
        codec = codec_of(tokenizer, uri)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = [codec.digest(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    docs, tokenizer = documents(spark, sf_dir), "word_bpe_49k.json"
    return digest(docs, tokenizer, build_lexicon(docs, tokenizer))
