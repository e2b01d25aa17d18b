"""Removal of repeated passages by fixed-block anchors.

Every document is cut into non-overlapping blocks of half a window; a window of
2B-1 words holds at least one whole block of B words, wherever it starts.  The
blocks are the index.  Every rolling run of B words of every document probes it:
a run whose words are a block somewhere, and which stands in two places, is an
anchor.  Only windows around anchors can repeat; they are extended to both sides
as far as a whole window still repeats, which gives the maximal exact repeats.

Three jobs, each with one exchange of hashes and no pair of documents:

1. probes: hashes of the runs go to the partition of their hash; what is an anchor
   there goes back to the documents it came from;
2. extension: the hashes of the windows around anchors take the same way; windows
   that stand in two places come back as word ranges;
3. the ranges are joined to the documents and cut out.

Hashes travel in packed rows, one per batch of documents and partition.  An anchor
or window that a batch can decide for itself (it stands twice in it) goes out once
for the batch, so a passage that a third of all documents share costs one entry
for each batch.  Runs are told apart by 32 bits within their partition (an anchor
too many costs time, no result); windows by 80 bits of a 128-bit pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetry.llm.common import (
    WordHashes,
    arrow_schema,
    batch_of,
    byte_words,
    fresh,
    give_back,
    joined_hash,
    map_batches,
    mixed,
    saved,
    slices,
    tidy,
    trim,
    trimmed,
    window_hashes,
)

WINDOW = 35
BATCH_WORDS = 1 << 19  # words of the documents that send their hashes together
BATCH_DOCS = 60_000  # so that a document's place in its batch fits 16 bits
GROUP_HASHES = 1 << 21  # hashes that one partition of an exchange sorts, about

_SENT = "part int, batch long, kind int, a binary, b binary, c binary"
_ANSWER = "batch long, kind int, a binary, b binary, c binary"
_PROBES, _OWN, _DECIDED = 0, 1, 2
_NOBODY = 0xFFFF
_NO_PLACE = 0xFFFFFFFF


def _blob(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values).astype(kind, copy=False).tobytes()


def _read(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(blob, dtype=kind)


def _batches(batches, columns, window):
    """Documents in groups of about BATCH_WORDS words: lists of the columns, and the
    hashes of each one's words, none for documents without a whole window.  A word is
    hashed as it comes, so the words of one document are held at a time."""
    give_back()
    hashes = WordHashes()
    group, words, size = [], [], 0
    for batch in batches:
        for part in slices(batch):
            for row in zip(*(part.column(c).to_pylist() for c in columns)):
                own = byte_words(row[-1])
                group.append(row[:-1])
                words.append(hashes.of(own if len(own) >= window else []))
                size += len(own)
                if size >= BATCH_WORDS or len(group) >= BATCH_DOCS:
                    yield group, words
                    group, words, size = [], [], 0
    if group:
        yield group, words
    del hashes, group, words
    trim()


def _runs_of_equal(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys, where each run of equal ones begins, and the run of each
    row in that order."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    starts = np.flatnonzero(new)
    return order, starts, np.cumsum(new) - 1


def _split(part: np.ndarray, n_parts: int):
    """(partition, rows of it) for each partition that has rows."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(n_parts + 1))
    for p in np.flatnonzero(ends[1:] > ends[:-1]):
        yield int(p), order[ends[p] : ends[p + 1]]


def _batch_id(group, number: int) -> int:
    """Batches of one content differ by their task and place in it."""
    from pyspark import TaskContext

    task = TaskContext.get()
    told = repr((task.partitionId() if task else None, number, [k[:2] for k in group]))
    digest = hashlib.blake2b(told.encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def _keys_blob(group) -> bytes:
    return np.array([k[:2] for k in group], dtype="<i8").tobytes()


class _Runs:
    """Hashes of all block-long runs of a batch of documents, of documents that
    have a whole window only.  `words` are hashed already where `hashes` is None."""

    def __init__(self, hashes: WordHashes | None, words: list, window: int):
        self.block = (window + 1) // 2
        self.doc = np.array([i for i, w in enumerate(words) if len(w) >= window], dtype=np.int64)
        self.sizes = np.array([len(words[i]) for i in self.doc], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        row = (
            np.concatenate([words[i] if hashes is None else hashes.of(words[i]) for i in self.doc])
            if len(self.doc)
            else np.zeros(0, dtype=np.uint64)
        )
        self.all = window_hashes(row, self.block)  # also those over a border
        own = np.repeat(np.arange(len(self.doc)), self.sizes)
        at = np.arange(len(row)) - self.starts[own]
        inside = at + self.block <= self.sizes[own]
        self.places = np.flatnonzero(inside)
        self.of_doc = own[inside]
        self.at = at[inside]
        self.hash = self.all[self.places]


def _codes(hashes: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition of each hash, and what tells it apart within."""
    part = ((hashes >> np.uint64(32)) % np.uint64(n_parts)).astype(np.int64)
    return part, (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _send_probes(n_parts: int, window: int):
    def turn(number, group, words):
        runs = _Runs(None, words, window)
        batch, rows = _batch_id(group, number), []
        part, low = _codes(runs.hash, n_parts)
        code = part.astype(np.uint64) << np.uint64(32) | low
        block = runs.at % runs.block == 0
        order, starts, run_of = _runs_of_equal(code)
        if len(starts):
            size = np.diff(np.append(starts, len(order)))
            indexed = np.maximum.reduceat(block[order].view(np.uint8), starts) > 0
            decided = (size >= 2) & indexed
        else:
            indexed = decided = np.zeros(0, dtype=bool)
        # decided here: the documents know; one entry tells the others
        of_row = decided[run_of] if len(order) else np.zeros(0, dtype=bool)
        mine = order[of_row]
        rows.append((
            batch % n_parts, batch, _OWN, _keys_blob(group),
            _blob(runs.doc[runs.of_doc[mine]], "<u2"), _blob(code[mine], "<u8"),
        ))
        first = order[starts[decided]] if len(starts) else order[:0]
        other = order[~of_row]
        sent = np.concatenate((first, other))
        who = np.concatenate(
            (np.full(len(first), _NOBODY), runs.doc[runs.of_doc[other]])
        )
        is_block = np.concatenate((np.ones(len(first), bool), block[other]))
        for p, own in _split(part[sent], n_parts):
            flags = np.packbits(is_block[own], bitorder="little").tobytes()
            rows.append((
                p, batch, _PROBES, _blob(low[sent[own]], "<u4"), _blob(who[own], "<u2"), flags,
            ))
        return batch_of(arrow_schema(_SENT), rows)

    def run(batches):
        for number, (group, words) in enumerate(_batches(batches, ("k1", "k2", "text"), window)):
            yield turn(number, group, words)

    return run


def _find_anchors(table: pa.Table) -> pa.Table:
    """One partition of the probes: anchors go back, own rows pass."""
    rows = table.to_pylist()
    out = [(r["batch"], _OWN, r["a"], r["b"], r["c"]) for r in rows if r["kind"] == _OWN]
    rows = [r for r in rows if r["kind"] == _PROBES]
    if rows:
        part = rows[0]["part"]
        keys = [_read(r["a"], "<u4") for r in rows]
        sizes = np.array([len(k) for k in keys])
        key = np.concatenate(keys)
        who = np.concatenate([_read(r["b"], "<u2") for r in rows])
        block = np.concatenate([
            np.unpackbits(_read(r["c"], "u1"), bitorder="little", count=n)
            for r, n in zip(rows, sizes)
        ])
        order, starts, run_of = _runs_of_equal(key)
        anchor = (np.diff(np.append(starts, len(order))) >= 2) & (
            np.maximum.reduceat(block[order], starts) > 0
        )
        hit = np.zeros(len(key), dtype=bool)
        hit[order] = anchor[run_of]
        hit &= who != _NOBODY
        ends = np.cumsum(sizes)
        for r, a, b in zip(rows, ends - sizes, ends):
            own = a + np.flatnonzero(hit[a:b])
            if len(own):
                code = key[own].astype(np.uint64) | np.uint64(part << 32)
                out.append((r["batch"], _PROBES, b"", who[own].tobytes(), _blob(code, "<u8")))
    return pa.Table.from_batches([batch_of(arrow_schema(_ANSWER), out)])


_ANCHORS = "k1 long, k2 long, anchors binary"


def _anchors_of_docs(table: pa.Table) -> pa.Table:
    """All that concerns one batch: its documents with their anchors."""
    rows = table.to_pylist()
    keys = next((_read(r["a"], "<i8").reshape(-1, 2) for r in rows if r["kind"] == _OWN), None)
    out = []
    if keys is not None:
        who = np.concatenate([_read(r["b"], "<u2") for r in rows])
        code = np.concatenate([_read(r["c"], "<u8") for r in rows])
        order = np.argsort(who, kind="stable")
        who, code = who[order], code[order]
        docs, starts = np.unique(who, return_index=True)
        for d, c in zip(docs.tolist(), np.split(code, starts[1:]) if len(docs) else []):
            out.append((int(keys[d, 0]), int(keys[d, 1]), np.unique(c).tobytes()))
    return pa.Table.from_batches([batch_of(arrow_schema(_ANCHORS), out)])


def _windows_at(covered_from: np.ndarray, back: int, n: int) -> np.ndarray:
    """Places 0..n-1 that are at most `back` before one of the given ones."""
    marks = np.zeros(n + 1, dtype=np.int64)
    np.add.at(marks, np.clip(covered_from - back, 0, n), 1)
    np.add.at(marks, np.clip(covered_from + 1, 0, n), -1)
    return np.flatnonzero(np.cumsum(marks[:n]) > 0)


def _send_windows(n_parts: int, window: int):
    block = (window + 1) // 2

    def turn(number, group, words):
        runs = _Runs(None, words, window)
        batch, rows = _batch_id(group, number), []
        part, low = _codes(runs.hash, n_parts)
        code = part.astype(np.uint64) << np.uint64(32) | low
        ends = np.searchsorted(runs.of_doc, np.arange(len(runs.doc) + 1))
        who, at, places = [], [], []
        for i, d in enumerate(runs.doc.tolist()):
            own = code[ends[i] : ends[i + 1]]
            anchors = _read(group[d][2], "<u8")
            found = np.searchsorted(anchors, own)
            hit = np.flatnonzero(anchors[np.minimum(found, len(anchors) - 1)] == own)
            starts = _windows_at(hit, window - block, int(runs.sizes[i]) - window + 1)
            who.append(np.full(len(starts), d, dtype=np.uint16))
            at.append(starts)
            places.append(starts + runs.starts[i])
        who = np.concatenate(who) if who else np.zeros(0, np.uint16)
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        left, right = runs.all[place], runs.all[place + window - block]
        high = joined_hash(left, right)
        tail = (mixed(right * np.uint64(0xD6E8FEB86659FD93) + left) & np.uint64(0xFFFF)).astype(np.uint16)
        # decided here: the places that stand twice pass with the batch's own row;
        # one entry of each window tells the others
        order, starts, run_of = _runs_of_equal(tail, high)
        twice = np.diff(np.append(starts, len(order))) >= 2
        of_row = twice[run_of]
        rows.append((
            batch % n_parts, batch, _OWN, _keys_blob(group),
            who.tobytes(), _blob(at, "<u4"),
        ))
        rows.append((batch % n_parts, batch, _DECIDED, b"", b"", _blob(order[of_row], "<u4")))
        first, other = order[starts[twice]], np.sort(order[~of_row])
        sent = np.concatenate((first, other))
        index = np.concatenate((np.full(len(first), _NO_PLACE), other))
        to = (high[sent] % np.uint64(n_parts)).astype(np.int64)
        for p, own in _split(to, n_parts):
            rows.append((
                p, batch, _PROBES, _blob(high[sent[own]], "<u8"), _blob(tail[sent[own]], "<u2"),
                _blob(index[own], "<u4"),
            ))
        return batch_of(arrow_schema(_SENT), rows)

    def run(batches):
        for number, (group, words) in enumerate(_batches(batches, ("k1", "k2", "anchors", "text"), window)):
            yield turn(number, group, words)

    return run


def _find_repeats(table: pa.Table) -> pa.Table:
    """One partition of the windows: the places of those that stand twice."""
    rows = table.to_pylist()
    out = [(r["batch"], r["kind"], r["a"], r["b"], r["c"]) for r in rows if r["kind"] != _PROBES]
    rows = [r for r in rows if r["kind"] == _PROBES]
    if rows:
        high = [_read(r["a"], "<u8") for r in rows]
        sizes = np.array([len(k) for k in high])
        high = np.concatenate(high)
        tail = np.concatenate([_read(r["b"], "<u2") for r in rows])
        order, starts, run_of = _runs_of_equal(tail, high)
        twice = np.zeros(len(high), dtype=bool)
        twice[order] = (np.diff(np.append(starts, len(order))) >= 2)[run_of]
        ends = np.cumsum(sizes)
        for r, a, b in zip(rows, ends - sizes, ends):
            own = _read(r["c"], "<u4")[twice[a:b]]
            own = own[own != _NO_PLACE]
            if len(own):
                out.append((r["batch"], _PROBES, b"", b"", own.tobytes()))
    return pa.Table.from_batches([batch_of(arrow_schema(_ANSWER), out)])


_RANGES = "k1 long, k2 long, ranges binary"


def ranges_of(starts: np.ndarray, window: int) -> np.ndarray:
    """Word ranges (begin, end) that windows at sorted places cover, joined where
    they touch."""
    if len(starts) == 0:
        return np.zeros((0, 2), dtype=np.uint32)
    new = np.flatnonzero(np.diff(starts) > window) + 1
    begins = starts[np.append(0, new)]
    ends = starts[np.append(new - 1, len(starts) - 1)] + window
    return np.stack((begins, ends), axis=1).astype(np.uint32)


def _ranges_of_docs(window: int):
    def turn(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next((r for r in rows if r["kind"] == _OWN), None)
        out = []
        if own is not None:
            keys = _read(own["a"], "<i8").reshape(-1, 2)
            who, at = _read(own["b"], "<u2"), _read(own["c"], "<u4").astype(np.int64)
            places = [_read(r["c"], "<u4") for r in rows if r["kind"] != _OWN]
            hit = np.sort(np.concatenate(places)) if places else np.zeros(0, np.uint32)
            docs, starts = np.unique(who[hit], return_index=True)
            for d, s in zip(docs.tolist(), np.split(at[hit], starts[1:]) if len(docs) else []):
                out.append((int(keys[d, 0]), int(keys[d, 1]), ranges_of(s, window).tobytes()))
        return pa.Table.from_batches([batch_of(arrow_schema(_RANGES), out)])

    return turn


def _keyed(docs: DataFrame, k1: str = "k1", k2: str = "k2") -> DataFrame:
    return docs.select(
        "*",
        F.xxhash64("doc_id", "text").alias(k1),
        F.hash("text", "doc_id").cast("long").alias(k2),
    )


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Repeated passages of `docs` (doc_id, text), by row content: (k1, k2, ranges),
    the keys of a row and its word ranges (pairs of unsigned 32-bit begin and end)
    covered by windows that also start elsewhere.  Rows without one are left out."""
    spark = docs.sparkSession
    texts = _keyed(docs.select("doc_id", "text")).select("k1", "k2", "text")
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # five characters a word; texts with shorter words have larger groups
    n_parts = max(least, chars // (5 * GROUP_HASHES) + 1)

    probes = texts.mapInArrow(_send_probes(n_parts, window), _SENT)
    answers = probes.groupBy("part").applyInArrow(trimmed(_find_anchors), _ANSWER)
    anchors = saved(
        answers.groupBy("batch").applyInArrow(trimmed(_anchors_of_docs), _ANCHORS).dropDuplicates(["k1", "k2"]),
        "anchors",
    )
    tidy(spark)
    around = texts.join(anchors, ["k1", "k2"]).select("k1", "k2", "anchors", "text")
    windows = around.mapInArrow(_send_windows(n_parts, window), _SENT)
    found = windows.groupBy("part").applyInArrow(trimmed(_find_repeats), _ANSWER)
    ranges = saved(
        found.groupBy("batch")
        .applyInArrow(trimmed(_ranges_of_docs(window)), _RANGES)
        .dropDuplicates(["k1", "k2"]),
        "repeats",
    )
    tidy(spark)
    return ranges


def with_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All columns of `docs` (doc_id, text, ...) and `ranges`, null where nothing
    repeats; a column of that name is replaced."""
    docs = docs.drop("ranges")
    k1, k2 = fresh("k1", docs.columns), fresh("k2", docs.columns)
    found = repeats(docs, window).withColumnsRenamed({"k1": k1, "k2": k2})
    return _keyed(docs, k1, k2).join(found, [k1, k2], "left").select(*docs.columns, "ranges")


def kept_words(words: list[bytes], ranges: bytes | None) -> list[bytes]:
    if not ranges:
        return words
    kept, at = [], 0
    for begin, end in _read(ranges, "<u4").reshape(-1, 2).tolist():
        kept += words[at:begin]
        at = end
    return kept + words[at:]


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Cut repeated passages out of `docs` (doc_id, text): (doc_id, n_words,
    n_removed, text), one row per row, `text` the kept words joined by a space.

    A word goes if a window of `window` consecutive words that covers it also
    starts anywhere else, in the same document or another, judged on the input;
    so all copies of a passage go.  Null and empty texts have no words and an
    empty text left; texts shorter than a window are left as they are.  Rows of
    equal id and text are copies of one another.  Null ids are kept.  Other
    columns are not read.
    """

    def make():
        def turn(batch):
            words = [byte_words(t) for t in batch.column("text").to_pylist()]
            kept = [kept_words(w, r) for w, r in zip(words, batch.column("ranges").to_pylist())]
            return {
                "doc_id": batch.column("doc_id"),
                "n_words": [len(w) for w in words],
                "n_removed": [len(w) - len(k) for w, k in zip(words, kept)],
                "text": [b" ".join(k).decode() for k in kept],
            }

        return turn

    return map_batches(
        with_repeats(docs.select("doc_id", "text"), window), make, "doc_id long, n_words long, n_removed long, text string"
    )
