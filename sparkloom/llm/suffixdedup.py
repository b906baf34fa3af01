"""Repeated passages by a logarithmic family of suffix arrays.

Every byte covered by a ``WINDOW``-byte string that also starts in a document with a
smaller id is removed. Matches never cross documents; all strings are judged on the input.

* Sampling. A window's anchor is its smallest ``GRAM``-byte gram by a hash (leftmost on
  ties). Equal windows have equal anchors at equal offsets, so a match can only be among
  windows of one anchor gram. The windows of one anchor are consecutive: one short string, an item, holds them.
* Deal 1. Batches of documents send their anchor hashes, without repeats, to hash buckets, which
  answer with those that several documents have. All other windows are unique and done.
* Deal 2. The batches send the items of shared anchors, without repeats, to the buckets. A bucket
  joins its items by ascending document to one text and takes that in batches: each gets a suffix array, its
  positions in the order of the text that starts there, sorted by more and more of it. The array is
  merge-scanned against those of earlier batches, the levels, for matches of a window's length and becomes a level;
  levels of like size are merged in one linear pass, so few are left. A level holds positions, never strings. The answer to a batch has, for each of its items, the first document that has
  it and which of its windows are in documents before that.
* The batches remove what is covered.

An anchor of very many documents (a line in a third of all) would bring too many different
items to one bucket: its windows travel one by one and are dealt by their own hash.
A batch sends an equal item once, so a bucket gets equal items at most once a batch. Texts that
equal the text of a smaller id are removed whole beforehand. Texts are shuffled once, by
batch; the three passes over them share that exchange.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, forget, materialize

WINDOW = 50
GRAM = 20
SPAN = WINDOW - GRAM + 1
BATCH_BYTES = 2 << 20
#: Anchors a bucket: about so many, so that a bucket's windows fit a worker.
BUCKET_ANCHORS = 150_000
#: Anchors a byte of text, about: 2 / (SPAN + 1).
DENSITY = 2 / (SPAN + 1)
#: An anchor of more documents than this (counted up to 255 a batch) is dealt window by window.
HOT_DOCUMENTS = 20_000
#: Windows of one suffix array before merging, at least, and batches of a bucket, at most.
BATCH_WINDOWS = 1 << 16
BATCHES = 8
#: Positions of each of two arrays that are merged at a time.
MERGE = 1 << 15
_BLOCK = 1 << 19
_B = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_POS = np.uint64((1 << 28) - 1)
REPLY = "batch long, kind int, payload binary"
COPIES, SHARED, FOUND = 0, 1, 2
#: An item's number: its first run times 64, plus its window in the run, or this for the whole run.
WHOLE = 63
ALL = np.uint32(0xFFFFFFFF)


def anchors(buf: np.ndarray) -> np.ndarray:
    """For each window start, the position of the window's anchor."""
    n = len(buf) - WINDOW + 1
    out = np.empty(max(0, n), np.int64)
    for c in range(0, n, _BLOCK):
        part = buf[c : min(c + _BLOCK, n) + WINDOW - 1].astype(np.uint64)
        h2 = part[:-1] * _B[0] + part[1:]
        h4 = h2[:-2] * _B[1] + h2[2:]
        h8 = h4[:-4] * _B[2] + h4[4:]
        h16 = h8[:-8] * _B[3] + h8[8:]
        h = h16[: len(h4) - 16] * _B[4] + h4[16:]
        h ^= h >> np.uint64(32)
        h *= _B[0]
        key = h & ~_POS | np.arange(len(h), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            key = np.minimum(key[:-step], key[step:])
        key = np.minimum(key[: len(key) - (SPAN - 16)], key[SPAN - 16 :])
        out[c : c + len(key)] = (key & _POS).astype(np.int64) + c
    return out


class Batch:
    """The documents of a batch in ascending order, concatenated; the items of its anchors.

    ``copies`` has a row's id, eight bytes with the highest first, and its text's MD5; an id alone stands for all its rows.
    """

    def __init__(self, table: pa.Table, copies: set[bytes]):
        ids = np.asarray(table.column("__id"))
        self.order = np.argsort(ids, kind="stable")
        texts = table.column("__text").to_pylist()
        raw = [(texts[i] or "").encode("utf-8", "surrogatepass") for i in self.order]
        self.ids = ids[self.order]
        self.ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
        self.starts = self.ends - [len(x) for x in raw]
        self.data = b"".join(raw)
        self.buf = np.frombuffer(self.data, np.uint8)
        known = {x[:8] for x in copies}
        keys = (int(i).to_bytes(8, "big", signed=True) for i in self.ids)
        self.copy = np.fromiter((key in known and (key in copies or key + md5(x, usedforsecurity=False).digest() in copies) for key, x in zip(keys, raw, strict=True)), bool, len(self.ids))
        self._runs()

    def _runs(self) -> None:
        """first and last window start of each run of windows with one anchor, its hash, its document."""
        n = len(self.buf)
        mark = np.zeros(n + 1, np.int64)
        use = (self.ends - self.starts >= WINDOW) & ~self.copy
        np.add.at(mark, self.starts[use], 1)
        np.add.at(mark, self.ends[use] - WINDOW + 1, -1)
        at = np.flatnonzero(np.cumsum(mark[:n]))
        anchor = anchors(self.buf)[at] if len(at) else at
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])
        head = np.flatnonzero(new)
        self.first, self.last = at[head], at[np.append(head[1:], len(at)) - 1] if len(at) else at
        anchor = anchor[head]
        h = np.zeros(len(anchor), np.uint64)
        for k in range(GRAM):
            h = (h ^ self.buf[anchor + k]) * _B[k % 5]
            h ^= h >> np.uint64(29)
        self.hash = h * _B[1]
        self.doc = np.searchsorted(self.ends, self.first, "right")

    def anchor_rows(self, batch: int, buckets: int):
        """(bucket, batch, hashes, counts): distinct anchor hashes and the number of documents with each, up to 255."""
        order = np.argsort(self.hash, kind="stable")
        h, doc = self.hash[order], self.doc[order]
        head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
        ids = self.ids[doc]
        new = np.append(True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])) if len(h) else np.empty(0, bool)
        counts = np.minimum(np.add.reduceat(new, head, dtype=np.int64), 255).astype(np.uint8) if len(h) else np.empty(0, np.uint8)
        h = h[head]
        for bucket, lo, hi in by_bucket(h, buckets):
            yield bucket, batch, h[lo:hi].tobytes(), counts[lo:hi].tobytes()

    def items(self, shared: np.ndarray, hot: np.ndarray):
        """Distinct items of the shared anchors in order of appearance.

        Returns their strings, anchor hashes, numbers and first documents, and for each
        occurrence its item, first window and document. Windows of hot anchors are items of their own.
        """
        runs = np.flatnonzero(member(self.hash, shared))
        is_hot = member(self.hash[runs], hot)
        index: dict[bytes, int] = {}
        numbers, firsts, item, start, doc = [], [], [], [], []
        data = self.data
        for r, a, b, d, single in zip(runs.tolist(), self.first[runs].tolist(), self.last[runs].tolist(), self.doc[runs].tolist(), is_hot.tolist(), strict=True):
            for x, y in ((s, s + WINDOW) for s in range(a, b + 1)) if single else ((a, b + WINDOW),):
                text = data[x:y]
                k = index.setdefault(text, len(index))
                if k == len(numbers):
                    numbers.append(r << 6 | (x - a if single else WHOLE))
                    firsts.append(d)
                item.append(k)
                start.append(x)
                doc.append(d)
        numbers = np.array(numbers, np.uint32)
        return list(index), self.hash[numbers >> np.uint32(6)], numbers, self.ids[np.array(firsts, np.int64)], np.array(item, np.int64), np.array(start, np.int64), np.array(doc, np.int64)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """True for each byte that is removed: copies whole, else what a window from ``starts`` covers."""
        hit = np.zeros(len(self.buf) + 1, np.int64)
        hit[1:][starts] = 1
        seen = np.cumsum(hit)
        out = seen[1:] > seen[np.maximum(np.arange(1, len(seen)) - WINDOW, 0)]
        for d in np.flatnonzero(self.copy):
            out[self.starts[d] : self.ends[d]] = True
        return out


def by_bucket(hashes: np.ndarray, buckets: int):
    """(bucket, from, to) of the parts of sorted hashes."""
    own = (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cut = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
    yield from zip(own[cut].tolist(), cut.tolist(), np.append(cut[1:], len(own)).tolist(), strict=False)


def member(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x


def shared_anchors(table: pa.Table):
    """(batch, payload) answers of a bucket: its shared hashes and which are hot, for each batch that has some."""
    parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()])
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    head = np.flatnonzero(np.append(True, every[order][1:] != every[order][:-1]))
    n = np.add.reduceat(counts[order], head, dtype=np.int64)
    keep = n > 1
    shared, hot = every[order][head][keep], n[keep] > HOT_DOCUMENTS
    for batch, own in zip(table.column("batch").to_pylist(), parts, strict=True):
        own = own[member(own, shared)]
        if len(own):
            yield batch, own.tobytes() + hot[np.searchsorted(shared, own)].tobytes()


def windows_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The windows that start at these positions, as strings."""
    return np.lib.stride_tricks.sliding_window_view(text, WINDOW)[at].view(f"S{WINDOW}").ravel()


def suffix_array(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the positions ``at`` by the window that starts there (ties: as given), and for each in that order whether its window is a new one.

    Sorted by eight bytes; then, again and again, what ties by the next eight.
    """
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(len(text), np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + len(text)]
    own = key[at]
    order = np.argsort(own)
    own = own[order]
    new = np.ones(len(at), bool)
    new[1:] = own[1:] != own[:-1]
    for offset in (*range(8, WINDOW - 7, 8), WINDOW - 8, None):
        ties = ~new
        ties[:-1] |= ~new[1:]
        ties = np.flatnonzero(ties)
        if not len(ties):
            break
        mine = order[ties]
        own = mine if offset is None else key[at[mine] + offset]
        again = np.lexsort((own, np.cumsum(new)[ties]))
        order[ties] = mine[again]
        if offset is not None:
            own = own[again]
            new[ties[1:]] |= own[1:] != own[:-1]
    return order, new


def merged(text: np.ndarray, a: np.ndarray, b: np.ndarray):
    """A merge scan of two suffix arrays: (positions in order, whether a window equals the one before), in parts; of equal windows a's comes first.

    Each part is cut at the same window in both, and a stable sort of two ascending runs merges them.
    """
    i = j = 0
    window = lambda p: text[p : p + WINDOW].tobytes()
    while i < len(a) or j < len(b):
        ends = [window(x[min(k + MERGE, len(x)) - 1]) for x, k in ((a, i), (b, j)) if k < len(x)]
        cut = min(ends)
        m = bisect_right(a, cut, i, min(i + MERGE, len(a)), key=window)
        n = bisect_right(b, cut, j, min(j + MERGE, len(b)), key=window)
        part = np.concatenate([a[i:m], b[j:n]])
        strings = windows_at(text, part)
        order = np.argsort(strings, kind="stable")
        strings = strings[order]
        same = np.zeros(len(part), bool)
        same[1:] = strings[1:] == strings[:-1]
        yield part[order], same
        i, j = m, n


class SuffixFamily:
    """Levels of suffix arrays over one text: distinct windows in order, each by the first position that has it.

    ``docs`` has the document of each item and ``ends`` where its text ends; documents ascend along the text.
    """

    def __init__(self, text: np.ndarray, ends: np.ndarray, docs: np.ndarray):
        self.text, self.ends, self.docs = text, ends, docs
        self.levels: list[np.ndarray] = []

    def doc(self, at: np.ndarray) -> np.ndarray:
        return self.docs[np.searchsorted(self.ends, at, "right")]

    def add(self, lo: int, hi: int, at: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which of the windows at positions ``at`` of ``docs``, all within lo to hi, start in a document before their own; adds them.

        Batches come in order along the text.
        """
        order, new = suffix_array(self.text[lo:hi], at - lo)
        first = order[new]
        heads, before = at[first].astype(self.ends.dtype), docs[first]
        known = np.zeros(len(heads), bool)
        for level in self.levels:
            done = 0
            for part, same in merged(self.text, level, heads):
                k = np.flatnonzero(same)
                mine = part >= lo
                number = done + np.cumsum(mine) - 1
                known[number[k]] = True
                before[number[k]] = np.minimum(before[number[k]], self.doc(part[k - 1]))
                done += int(mine.sum())
        found = np.empty(len(at), bool)
        found[order] = before[np.cumsum(new) - 1] < docs[order]
        self.levels.append(heads[~known])
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) >= len(self.levels[-2]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(np.concatenate([a[:0], *(part for part, _ in merged(self.text, a, b))]))
        self.levels = [x for x in self.levels if len(x)]
        return found


def earlier_windows(texts: list[bytes], docs: np.ndarray) -> np.ndarray:
    """A bit mask for each item, in ascending order of docs: bit k tells that its k-th window is in a document before."""
    lengths = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(lengths)
    if len(ends) and ends[-1] < 1 << 31:
        ends = ends.astype(np.int32)
    family, masks = SuffixFamily(np.frombuffer(b"".join(texts), np.uint8), ends, docs), np.zeros(len(texts), np.uint32)
    windows = lengths - WINDOW + 1
    step = np.cumsum(windows)
    lo, most = 0, max(BATCH_WINDOWS, -(-int(windows.sum()) // BATCHES))
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(step, (step[lo - 1] if lo else 0) + most, "right")))
        n = windows[lo:hi]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(ends[lo:hi] - lengths[lo:hi], n) + offset
        found = family.add(int(ends[lo] - lengths[lo]), int(ends[hi - 1]), at, np.repeat(docs[lo:hi], n))
        bits = found.astype(np.uint32) << offset.astype(np.uint32)
        masks[lo:hi] = np.bitwise_or.reduceat(bits, np.cumsum(n) - n)
        lo = hi
    return masks


def answer_items(table: pa.Table):
    """(batch, payload) answers of a bucket: the number and mask of each of the batch's items.

    A mask holds the windows that a document before the batch's first with the item has.
    """
    index: dict[bytes, int] = {}
    first: list[int] = []
    rows = []
    for batch, n, head, data in zip(*(table.column(c).to_pylist() for c in ("batch", "n", "head", "data")), strict=True):
        head, data, at, own = zlib.decompress(head), zlib.decompress(data), 0, []
        docs, numbers, lengths = np.frombuffer(head, np.int64, n), np.frombuffer(head, np.uint32, n, 8 * n), np.frombuffer(head, np.uint16, n, 12 * n)
        for doc, size in zip(docs.tolist(), lengths.tolist(), strict=True):
            k = index.setdefault(data[at : at + size], len(index))
            at += size
            if k == len(first):
                first.append(doc)
            elif doc < first[k]:
                first[k] = doc
            own.append(k)
        rows.append((batch, np.array(own, np.int64), docs, numbers))
    firsts = np.array(first, np.int64)
    order = np.argsort(firsts, kind="stable")
    texts = list(index)
    masks = np.zeros(len(texts), np.uint32)
    masks[order] = earlier_windows([texts[i] for i in order.tolist()], firsts[order])
    for batch, own, docs, numbers in rows:
        yield batch, zlib.compress(numbers.tobytes() + np.where(firsts[own] < docs, ALL, masks[own]).tobytes(), 1)


def _answers(rows, kind: int) -> pa.Table:
    rows = list(rows)
    return pa.table({"batch": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([kind] * len(rows), pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})


def _payloads(replies: pa.Table, kind: int) -> list[bytes]:
    return [x for k, x in zip(replies.column("kind").to_pylist(), replies.column("payload").to_pylist(), strict=True) if k == kind]


def _batch(left: pa.Table, right: pa.Table) -> Batch:
    forget()
    return Batch(left, set(_payloads(right, COPIES)))


def _send_anchors(left: pa.Table, right: pa.Table, buckets: int) -> pa.Table:
    rows = list(_batch(left, right).anchor_rows(left.column("__batch")[0].as_py(), buckets)) if left.num_rows else []
    return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("bucket", pa.int64()), ("batch", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())))})


def _send_items(left: pa.Table, right: pa.Table, buckets: int) -> pa.Table:
    out = {c: [] for c in ("bucket", "batch", "n", "head", "data")}
    got = _payloads(right, SHARED)
    if left.num_rows and got:
        shared = np.concatenate([np.frombuffer(x, np.uint64, len(x) // 9) for x in got])
        hot = np.concatenate([np.frombuffer(x, bool, len(x) // 9, len(x) // 9 * 8) for x in got])
        texts, hashes, numbers, docs, *_ = _batch(left, right).items(np.sort(shared), np.sort(shared[hot]))
        dealt = hashes.copy()
        for i in np.flatnonzero((numbers & np.uint32(63)) != WHOLE).tolist():
            dealt[i] = xxhash.xxh3_64_intdigest(texts[i])
        order = np.argsort(dealt, kind="stable")
        for bucket, lo, hi in by_bucket(dealt[order], buckets):
            own = order[lo:hi]
            some = [texts[i] for i in own.tolist()]
            head = docs[own].tobytes() + numbers[own].tobytes() + np.array([len(x) for x in some], np.uint16).tobytes()
            for c, v in zip(out, (bucket, left.column("__batch")[0].as_py(), len(own), zlib.compress(head, 1), zlib.compress(b"".join(some), 1)), strict=True):
                out[c].append(v)
    return pa.table({c: pa.array(v, pa.binary() if c in ("head", "data") else pa.int64()) for c, v in out.items()})


def _removed(left: pa.Table, right: pa.Table) -> tuple[Batch, np.ndarray]:
    """The batch and which of its bytes go."""
    batch, got = _batch(left, right), [zlib.decompress(x) for x in _payloads(right, FOUND)]
    if not got:
        return batch, batch.covered(np.empty(0, np.int64))
    numbers = np.concatenate([np.frombuffer(x, np.uint32, len(x) // 8) for x in got])
    masks = np.concatenate([np.frombuffer(x, np.uint32, len(x) // 8, len(x) // 2) for x in got])
    # the answers tell which anchors were shared, and the numbers which were hot
    anchor, single = batch.hash[numbers >> np.uint32(6)], (numbers & np.uint32(63)) != WHOLE
    texts, _, own, firsts, item, start, doc = batch.items(np.unique(anchor), np.unique(anchor[single]))
    order = np.argsort(numbers)
    mask_of = masks[order][np.searchsorted(numbers[order], own)]
    n = np.array([len(x) for x in texts], np.int64)[item] - WINDOW + 1
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    later = np.repeat(batch.ids[doc] > firsts[item], n)
    bit = np.repeat(mask_of[item], n) >> offset.astype(np.uint32) & np.uint32(1)
    return batch, batch.covered((np.repeat(start, n) + offset)[later | (bit == 1)])


def _digest(left: pa.Table, right: pa.Table) -> pa.Table:
    batch, gone = _removed(left, right)
    total = np.concatenate([[0], np.cumsum(gone)])
    rise = gone.copy()
    rise[1:] &= ~gone[:-1]
    inner = batch.starts[(batch.starts < batch.ends)]
    rise[inner] = gone[inner]
    rises = np.concatenate([[0], np.cumsum(rise)])
    hashes = [sha256(batch.buf[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(batch.starts.tolist(), batch.ends.tolist(), strict=True)]
    columns = (batch.ids, batch.ends - batch.starts, total[batch.ends] - total[batch.starts], rises[batch.ends] - rises[batch.starts])
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("doc_id", "n_bytes", "n_removed", "n_spans"), columns, strict=True)} | {"kept_sha256": pa.array(hashes, pa.string())})


def _cut(left: pa.Table, right: pa.Table, names: list[str], text_at: int) -> pa.Table:
    """The rows with their own columns; the text loses every character all of whose bytes go."""
    batch, gone = _removed(left, right)
    buf = batch.buf
    first = (buf & 0xC0) != 0x80
    of = np.cumsum(first) - 1
    whole = np.ones(int(first.sum()), bool)
    np.logical_and.at(whole, of[~gone], False)
    keep = ~whole[of] if len(of) else gone
    texts = [buf[a:b][keep[a:b]].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(batch.starts.tolist(), batch.ends.tolist(), strict=True)]
    table = left.take(pa.array(batch.order)).select(names)
    was_null = table.column(text_at).is_null().to_pylist()
    column = pa.array([None if null else t for t, null in zip(texts, was_null, strict=True)], table.schema.field(text_at).type)
    return table.set_column(text_at, names[text_at], column)


def _plan(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(documents by batch, the answers to each batch)."""
    internal = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)], F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text")).where("__id is not null")
    size = internal.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    batches, buckets = max(1, -(-size // BATCH_BYTES)), max(1, -int(-size * DENSITY // BUCKET_ANCHORS))
    # by id and text: an id that a third of all rows have is spread over all batches
    base = internal.withColumn("__batch", F.pmod(F.xxhash64("__id", "__text"), F.lit(batches)))
    prints = base.where(F.octet_length("__text") >= WINDOW).select("__id", F.md5("__text").alias("p"), "__batch")
    firsts = prints.groupBy("p").agg(F.min("__id").alias("m"), F.max("__id").alias("x")).where("m < x").select("p", "m")
    # the payload of a copy is its id, eight bytes with the highest first, and its print: an id may have other texts
    copies = prints.join(firsts, "p").where("__id > m").select(F.col("__batch").alias("batch"), F.lit(COPIES).alias("kind"), F.unhex(F.concat(F.lpad(F.hex("__id"), 16, "0"), "p")).alias("payload"))
    copies = materialize(copies, "copies")

    def asked(fn, schema, replies):
        return base.groupBy("__batch").cogroup(replies.groupBy("batch")).applyInArrow(fn, schema)

    sent = asked(lambda left, right: _send_anchors(left, right, buckets), "bucket long, batch long, hashes binary, counts binary", copies)
    shared = sent.groupBy("bucket").applyInArrow(lambda t: _answers(shared_anchors(t), SHARED), REPLY)
    items = asked(lambda left, right: _send_items(left, right, buckets), "bucket long, batch long, n long, head binary, data binary", copies.union(shared))
    found = items.groupBy("bucket").applyInArrow(lambda t: _answers(answer_items(t), FOUND), REPLY)
    return base, copies.union(found)


def removal_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row with a non-null id.

    Rows that repeat an id don't match each other; each is judged against smaller ids.
    """
    base, replies = _plan(docs.select(id_col, text_col), id_col, text_col)
    return base.groupBy("__batch").cogroup(replies.groupBy("batch")).applyInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, where the text has lost its repeated passages.

    A character goes if all its bytes do, so texts stay valid. Null texts stay null;
    rows with a null id are not returned.
    """
    base, replies = _plan(docs, id_col, text_col)
    names, at = [f"__c{i}" for i in range(len(docs.columns))], docs.columns.index(text_col)
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    out = base.groupBy("__batch").cogroup(replies.groupBy("batch")).applyInArrow(lambda left, right: _cut(left, right, names, at), schema)
    return out.toDF(*docs.columns)


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return removal_digest(documents(spark, sf_dir))
