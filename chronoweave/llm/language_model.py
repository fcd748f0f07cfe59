"""Language-model scores from an Elias-Fano n-gram trie.

The trie has three levels, words, the successors of each word and those of
each pair, and is cut into shards by ranges of word hashes. Words are numbered
in the order of their hashes. A context's successors are a range of one
sequence, told by monotone pointers; their numbers are raised by the last
number of the range before, so that the whole sequence grows, and are searched
relative to their context. All sequences are Elias-Fano coded, probabilities
are codes of one byte, and scoring tasks memory-map the shards.

Probabilities after one word mix its counts with the words' own ones, and those
after two mix the pair's counts with the former. So a pair holds two codes, of
its probability and of the part that it leaves to shorter contexts, and a
triple one, of the part that its count adds.

Everything that the corpus gives is counted on all training documents: tasks
send sorted, packed counts to the shards, which merge them. Nothing but one
row for each shard reaches the driver.
"""

from __future__ import annotations

import math
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .elias_fano import EliasFano, pack, unpack
from .shared import persisted, shared_dir
from .splits import remainder

#: Tokens that are scored or counted at once.
BATCH_TOKENS = 1 << 20
#: Distinct pairs and triples that a task holds before it sends them.
HELD_PAIRS = 1 << 22
#: Documents for each shard of words; the number of shards is a power of two.
DOCS_PER_SHARD = 16_384
#: Columns that the successors of a range of words are dealt over, so that the followers of one frequent word are no task of their own.
COLUMNS = 4
#: Weight of the words' own probabilities against a context's counts.
STRENGTH = 8.0
#: Weight of a word's probability after one word against the counts of a context of two.
PAIR_STRENGTH = 2.0
#: The end of a text, which also stands before its first word: the hash of a byte that no word has.
END = xxhash.xxh64_intdigest(b"\n")
_CODES = 256
#: The number of words that training texts do not hold.
_UNKNOWN = 0xFFFFFFFF


def tokenize(text: str | None) -> list[bytes]:
    """Words in lower-case A-Z; bytes.split parts them at \\x20 and \\x09 to \\x0D."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def hashed_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, texts one after another and each with its end, and the number of tokens of each."""
    flat: list[bytes] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        ws = tokenize(text)
        flat += ws
        flat.append(b"\n")
        sizes[i] = len(ws) + 1
    coded = pa.array(flat, pa.large_binary()).dictionary_encode()
    distinct = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return distinct[coded.indices.to_numpy(zero_copy_only=False)] if flat else np.zeros(0, np.uint64), sizes


def _some_texts(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """A column's texts, some at a time by their bytes, each time with the first one's place."""
    held, size, start = [], 0, 0
    for i, text in enumerate(column):
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= BATCH_TOKENS * 6:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their summed counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _squeeze(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and counts, packed: differences and counts by planes of bytes."""
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes() + np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _expand(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    n = len(raw) // 12
    keys = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").reshape(-1), dtype=np.uint64)
    return keys, np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64)


# --- files --------------------------------------------------------------------------------------------------


def _local(path: str) -> str | None:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path if path.startswith("/") else None


def _save(path: str, data: bytes) -> None:
    local = _local(path)
    if local:
        with open(local, "wb") as f:
            f.write(data)
    else:
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_output_stream(inner) as f:
            f.write(data)


@contextmanager
def _mapped_files():
    """Opens shards as memory maps; those of a remote store are copied for the time being."""
    temporary, opened = None, {}

    def get(path: str):
        nonlocal temporary
        if path not in opened:
            local = _local(path)
            if local is None:
                temporary = temporary or tempfile.mkdtemp()
                local = os.path.join(temporary, uuid.uuid4().hex)
                fs, inner = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_stream(inner) as source, open(local, "wb") as out:
                    shutil.copyfileobj(source, out)
            opened[path] = unpack(np.memmap(local, np.uint8, mode="r"))
        return opened[path]

    try:
        yield get
    finally:
        if temporary:
            shutil.rmtree(temporary, ignore_errors=True)


# --- the model ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TrieModel:
    """Paths of the shards; ``starts`` are the first word numbers of the shards of words."""

    tokens: int
    distinct: int
    starts: tuple[int, ...]
    words: tuple[str, ...]
    successors: dict[int, str]

    @property
    def shards(self) -> int:
        return len(self.words)


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    bits = shards.bit_length() - 1
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _in_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Hashes without the bits that all of a shard share, below 2**62."""
    bits = shards.bit_length() - 1
    return ((hashes << np.uint64(bits)) >> np.uint64(2)).astype(np.int64)


def _successors(pointers: EliasFano, numbers: EliasFano, context: np.ndarray, relative: np.ndarray) -> np.ndarray:
    """Places of numbers among the successors of their contexts (-1: not there); contexts are in order."""
    first = np.r_[True, context[1:] != context[:-1]] if len(context) else np.zeros(0, bool)
    local, back = context[first], np.cumsum(first) - 1
    begin, end = pointers.access(local), pointers.access(local + 1)
    base, last = np.zeros(len(local), np.int64), np.zeros(len(local), np.int64)
    some, full = begin > 0, end > begin
    base[some] = numbers.access(begin[some] - 1)
    last[full] = numbers.access(end[full] - 1)
    target = relative + base[back]
    ask = np.flatnonzero(full[back] & (target <= last[back]))
    at, there = numbers.contains(target[ask])
    there &= (at >= begin[back[ask]]) & (at < end[back[ask]])
    out = np.full(len(context), -1, np.int64)
    out[ask[there]] = at[there]
    return out


class _Reader:
    """Lookups in the levels of the trie, for one task."""

    def __init__(self, model: TrieModel, get):
        self.model, self.get = model, get
        self.starts = np.array(model.starts, dtype=np.int64)

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers (-1: unknown) of sorted distinct hashes."""
        ids = np.full(len(hashes), -1, np.int64)
        shard = _shard_of(hashes, self.model.shards)
        for s in np.unique(shard):
            own = np.flatnonzero(shard == s)
            at, there = self.get(self.model.words[s])[1]["hashes"].contains(_in_shard(hashes[own], self.model.shards))
            ids[own[there]] = self.model.starts[s] + at[there]
        return ids

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of words, 0 for those of number -1."""
        distinct, back = np.unique(ids, return_inverse=True)
        counts = np.zeros(len(distinct), np.int64)
        row = np.searchsorted(self.starts, distinct, side="right") - 1
        for s in np.unique(row[distinct >= 0]):
            own = np.flatnonzero((row == s) & (distinct >= 0))
            counts[own] = self.get(self.model.words[s])[0]["counts"][distinct[own] - self.starts[s]]
        return counts[back]

    def _groups(self, context: np.ndarray, word: np.ndarray):
        """The files that hold pairs, with the places of their pairs in the arguments."""
        group = _group_of(self.starts, context, word)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        for own in np.split(order, cuts) if len(order) else ():
            path = self.model.successors.get(int(group[own[0]]))
            if path is not None:
                yield int(group[own[0]]) // COLUMNS, own, *self.get(path)[:2]

    def pairs(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (-1: not in the trie), probabilities, and the parts that pairs leave to shorter contexts; sorted by context and word."""
        place, p, rest = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.ones(len(context))
        for shard, own, arrays, sequences in self._groups(context, word):
            at = _successors(sequences["pointers"], sequences["successors"], context[own] - self.starts[shard], word[own] // COLUMNS + 1)
            own, at = own[at >= 0], at[at >= 0]
            place[own], p[own], rest[own] = at, arrays["book"][arrays["codes"][at]], arrays["rest_book"][arrays["rests"][at]]
        return place, p, rest

    def triples(self, context: np.ndarray, word: np.ndarray, place: np.ndarray, third: np.ndarray) -> np.ndarray:
        """The parts of probability that pairs, told with their places, give to third words by their own counts."""
        out = np.zeros(len(context))
        for _, own, arrays, sequences in self._groups(context, word):
            at = _successors(sequences["pair_pointers"], sequences["thirds"], place[own], third[own] + 1)
            out[own[at >= 0]] = arrays["third_book"][arrays["third_codes"][at[at >= 0]]]
        return out


def _group_of(starts: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The group of a pair: the shard of its context and the column of its word."""
    return (np.searchsorted(starts, context, side="right") - 1) * COLUMNS + word % COLUMNS


def _count_words(shards: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (shard, packed hashes and counts)."""
    keys, counts, held = [], [], 0

    def send() -> pa.RecordBatch:
        k, c = _merge(keys, counts)
        shard = _shard_of(k, shards)
        own = np.unique(shard)
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array([_squeeze(k[shard == s], c[shard == s]) for s in own], pa.binary())], ["shard", "blob"])

    for batch in batches:
        for _, texts in _some_texts(batch.column(0)):
            k, c = np.unique(hashed_texts(texts)[0], return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > HELD_PAIRS:
                yield send()
                keys, counts, held = [], [], 0
    if held:
        yield send()


def _blobs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The counts of all blobs of a group, merged as they come."""
    keys, counts, held = [], [], 0
    for blob in table.column("blob"):
        k, c = _expand(blob.as_py())
        keys.append(k)
        counts.append(c)
        held += len(k)
        if held > 4 * HELD_PAIRS:
            k, c = _merge(keys, counts)
            keys, counts, held = [k], [c], len(k) // 2
    return _merge(keys, counts)


def _build_words(folder: str, shards: int, table: pa.Table) -> pa.Table:
    """One shard of words: hashes in order and counts."""
    shard = table.column("shard")[0].as_py()
    hashes, counts = _blobs(table)
    path = f"{folder}/words-{uuid.uuid4().hex}"
    _save(path, pack({"counts": counts.astype(np.int64 if len(counts) and counts.max() >= 1 << 31 else np.int32)}, {"hashes": EliasFano.build(_in_shard(hashes, shards), 1 << 62)}, {}))
    return pa.table({"shard": pa.array([shard], pa.int64()), "n": pa.array([len(hashes)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64()), "path": [path]})


def _high(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(32)).astype(np.int64)


def _low(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _key(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)


def _contexts(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number before each token, which is the end's before a text, and the places of the texts' first tokens."""
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    context = np.roll(ids, 1)
    context[first] = ids[-1]  # each text closes with the end
    return context, first


def _some_numbers(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Numbers of tokens (-1: unknown) of some texts at a time, with the first text's place and the tokens of each."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
    data = np.frombuffer(column.buffers()[2], "<u4") if len(column) else np.zeros(0, "<u4")
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BATCH_TOKENS, side="right")) - 1)
        ids = data[offsets[start] : offsets[stop]].astype(np.int64)
        ids[ids == _UNKNOWN] = -1
        yield start, ids, np.diff(offsets[start : stop + 1])
        start = stop


def number_texts(docs: DataFrame, model: TrieModel, text: str = "text") -> DataFrame:
    """doc_id and the word numbers of every row's whole text and its end, four bytes each."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _mapped_files() as get:
            reader = _Reader(model, get)
            for batch in batches:
                for start, texts in _some_texts(batch.column(1)):
                    hashes, sizes = hashed_texts(texts)
                    distinct, back = np.unique(hashes, return_inverse=True)
                    ids = reader.words(distinct)[back]
                    raw = np.where(ids < 0, _UNKNOWN, ids).astype("<u4").tobytes()
                    ends = 4 * np.cumsum(sizes)
                    blobs = pa.array([raw[e - 4 * n : e] for e, n in zip(ends.tolist(), sizes.tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), blobs], ["doc_id", "numbers"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text)).mapInArrow(number, f"doc_id {ids}, numbers binary")


@dataclass
class _Counted:
    """Pairs in order with their counts, and triples, as places of pairs and third words, with theirs."""

    pairs: np.ndarray
    counts: np.ndarray
    triples: np.ndarray
    triple_counts: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, sizes: np.ndarray) -> _Counted:
        context, first = _contexts(ids, sizes)
        pairs, back, counts = np.unique(_key(context, ids), return_inverse=True, return_counts=True)
        later = np.ones(len(ids), bool)
        later[first] = False
        later = np.flatnonzero(later)
        return cls(pairs, counts, *np.unique(_key(back[later - 1], ids[later]), return_counts=True))

    @classmethod
    def merged(cls, parts: list[_Counted]) -> _Counted:
        if len(parts) == 1:
            return parts[0]
        pairs, counts = _merge([p.pairs for p in parts], [p.counts for p in parts])
        moved = [_key(np.searchsorted(pairs, p.pairs)[_high(p.triples)], _low(p.triples)) for p in parts]
        return cls(pairs, counts, *_merge(moved, [p.triple_counts for p in parts]))

    def split(self, group: np.ndarray) -> Iterator[tuple[int, _Counted]]:
        """Parts by the groups of pairs."""
        order = np.argsort(group, kind="stable")
        place = np.empty(len(order), np.int64)
        sizes = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        begin = np.cumsum(sizes) - sizes
        place[order] = np.arange(len(order)) - begin[group[order]]
        of = group[_high(self.triples)]
        triples = np.argsort(of, kind="stable")
        t_end = np.cumsum(np.bincount(of, minlength=len(sizes))) if len(of) else np.zeros(len(sizes), np.int64)
        for g in np.flatnonzero(sizes).tolist():
            own, t = order[begin[g] : begin[g] + sizes[g]], triples[t_end[g - 1] if g else 0 : t_end[g]]
            yield g, _Counted(self.pairs[own], self.counts[own], _key(place[_high(self.triples[t])], _low(self.triples[t])), self.triple_counts[t])


def _count_pairs(model: TrieModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbered texts to (group, packed pairs, packed triples)."""
    starts = np.array(model.starts, dtype=np.int64)
    parts: list[_Counted] = []
    held = 0

    def send() -> pa.RecordBatch:
        counted = _Counted.merged(parts)
        split = list(counted.split(_group_of(starts, _high(counted.pairs), _low(counted.pairs))))
        blobs = [[_squeeze(c.pairs, c.counts) for _, c in split], [_squeeze(c.triples, c.triple_counts) for _, c in split]]
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in split], pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], ["shard", "blob", "triples"])

    for batch in batches:
        for _, ids, sizes in _some_numbers(batch.column(0)):
            parts.append(_Counted.of(ids, sizes))
            held += len(parts[-1].triples) + len(parts[-1].pairs)
            if held > HELD_PAIRS:
                yield send()
                parts, held = [], 0
    if held:
        yield send()


def _own(counts: np.ndarray, model: TrieModel) -> np.ndarray:
    """Probabilities of words by their training counts."""
    return (counts + 0.1) / (model.tokens + 0.1 * (model.distinct + 1))


def _raised(context: np.ndarray, relative: np.ndarray, contexts: int) -> tuple[EliasFano, EliasFano]:
    """Pointers of contexts to their successors, and the successors' numbers raised by the last of the context before."""
    pointers = np.searchsorted(context, np.arange(contexts + 1))
    used = np.flatnonzero(np.diff(pointers))
    ends = np.zeros(contexts, np.int64)
    ends[used] = relative[pointers[used + 1] - 1]
    raised = relative + (np.cumsum(ends) - ends)[context]
    return EliasFano.build(pointers, len(context) + 1), EliasFano.build(raised, int(raised[-1]) + 1 if len(raised) else 1)


def _quantised(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of one byte, even in logarithms, and the mean logarithm of each code's members as a probability, so that errors cancel."""
    logs = np.log10(p)
    low, high = (logs.min(), logs.max()) if len(logs) else (0.0, 0.0)
    step = max((high - low) / (_CODES - 1), 1e-12)
    codes = np.rint((logs - low) / step).astype(np.uint8)
    sums, sizes = np.bincount(codes, logs, _CODES), np.bincount(codes, minlength=_CODES)
    return codes, 10 ** np.where(sizes > 0, sums / np.maximum(sizes, 1), low + step * np.arange(_CODES))


def _build_pairs(folder: str, model: TrieModel, table: pa.Table) -> pa.Table:
    """One group of successors and of their successors: pointers, numbers raised by context, and codes of probabilities."""
    group = table.column("shard")[0].as_py()
    shard = group // COLUMNS
    parts, held = [], 0
    for pairs, triples in zip(table.column("blob"), table.column("triples")):
        parts.append(_Counted(*_expand(pairs.as_py()), *_expand(triples.as_py())))
        held += len(parts[-1].triples)
        if held > 4 * HELD_PAIRS:
            parts = [_Counted.merged(parts)]
            held = len(parts[0].triples) // 2
    found = _Counted.merged(parts)
    context, word = _high(found.pairs) - model.starts[shard], _low(found.pairs)
    with _mapped_files() as get:
        totals = np.asarray(get(model.words[shard])[0]["counts"])
        own = _own(_Reader(model, get).counts(word), model)
    pointers, successors = _raised(context, word // COLUMNS + 1, len(totals))
    codes, book = _quantised((found.counts + STRENGTH * own) / (totals[context] + STRENGTH))
    rests, rest_book = _quantised(PAIR_STRENGTH / (found.counts + PAIR_STRENGTH))
    of = _high(found.triples)
    pair_pointers, thirds = _raised(of, _low(found.triples) + 1, len(found.pairs))
    third_codes, third_book = _quantised(found.triple_counts / (found.counts[of] + PAIR_STRENGTH))
    path = f"{folder}/successors-{uuid.uuid4().hex}"
    arrays = {"codes": codes, "book": book, "rests": rests, "rest_book": rest_book, "third_codes": third_codes, "third_book": third_book}
    _save(path, pack(arrays, {"pointers": pointers, "successors": successors, "pair_pointers": pair_pointers, "thirds": thirds}, {}))
    return pa.table({"shard": pa.array([group], pa.int64()), "path": [path]})


def fit_words(docs: DataFrame, folder: str, text: str = "text") -> TrieModel:
    """The first level: all words of ``docs``, counted and written to ``folder``, which all executors see."""
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    shards = 1 << max(0, math.ceil(math.log2(max(docs.count(), 1) / DOCS_PER_SHARD)))
    counted = docs.select(F.col(text)).mapInArrow(lambda b: _count_words(shards, b), "shard long, blob binary")
    built = persisted(counted.groupBy("shard").applyInArrow(lambda t: _build_words(folder, shards, t), "shard long, n long, tokens long, path string"), "words")
    rows = {r["shard"]: r for r in built.collect()}  # one for each shard
    for s in range(shards):
        if s not in rows:
            empty = f"{folder}/words-none"
            rows[s] = {"n": 0, "tokens": 0, "path": empty}
    if any(r["path"].endswith("words-none") for r in rows.values()):
        _save(f"{folder}/words-none", pack({"counts": np.zeros(0, np.int32)}, {"hashes": EliasFano.build(np.zeros(0, np.int64), 1 << 62)}, {}))
    sizes = [rows[s]["n"] for s in range(shards)]
    if sum(sizes) >= _UNKNOWN:
        raise ValueError("2**32 - 1 distinct words or more: numbers of 32 bits do not tell them apart")
    return TrieModel(sum(rows[s]["tokens"] for s in range(shards)), sum(sizes), tuple(int(x) for x in np.r_[0, np.cumsum(sizes)[:-1]]), tuple(rows[s]["path"] for s in range(shards)), {})


def fit_successors(numbered: DataFrame, model: TrieModel, folder: str) -> TrieModel:
    """The second and third level, of the texts that :func:`number_texts` gave for the words' own documents."""
    counted = numbered.select("numbers").mapInArrow(lambda b: _count_pairs(model, b), "shard long, blob binary, triples binary")
    found = persisted(counted.groupBy("shard").applyInArrow(lambda t: _build_pairs(folder, model, t), "shard long, path string"), "successors").collect()  # one row for each group
    return replace(model, successors={r["shard"]: r["path"] for r in found})


def fit_trie(docs: DataFrame, folder: str, text: str = "text") -> TrieModel:
    """Count all of ``docs`` and write the trie's shards to ``folder``, which all executors see.

    Null and empty texts count as one end each. A table without rows gives a
    model without words. Task attempts write files of their own, and only
    those that successful attempts name are read.
    """
    model = fit_words(docs, folder, text)
    return fit_successors(number_texts(docs, model, text), model, folder)


def _score(reader: _Reader, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base score and score of each text."""
    context, first = _contexts(ids, sizes)
    counts = reader.counts(ids)
    before = np.roll(counts, 1)
    before[first] = counts[-1]
    own = _own(counts, reader.model)
    p = own * np.where(before > 0, STRENGTH / (before + STRENGTH), 1.0)  # the part that a context leaves to the words' own probabilities
    ask = np.flatnonzero((context >= 0) & (ids >= 0))
    keys, back = np.unique(_key(context[ask], ids[ask]), return_inverse=True)
    place, p_pair, rest = reader.pairs(_high(keys), _low(keys))
    pair = np.full(len(ids), -1, np.int64)  # the known pair that each token closes
    pair[ask] = np.where(place[back] >= 0, back, -1)
    p = np.where(pair >= 0, p_pair[pair] if len(keys) else p, p)
    shorter = np.roll(pair, 1)  # the known pair before each token
    shorter[first] = -1
    after = np.flatnonzero(shorter >= 0)
    p[after] *= rest[shorter[after]]
    after = after[pair[after] >= 0]  # a triple is known only with the pair that closes it
    triples, back = np.unique(_key(shorter[after], ids[after]), return_inverse=True)
    at = _high(triples)
    p[after] += reader.triples(_high(keys[at]), _low(keys[at]), place[at], _low(triples))[back]
    return sizes, np.add.reduceat((counts > 0).astype(np.int64), first), np.add.reduceat(np.log10(own), first), np.add.reduceat(np.log10(p), first)


def score_numbers(numbered: DataFrame, model: TrieModel) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row that :func:`number_texts` gave."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _mapped_files() as get:
            reader = _Reader(model, get)
            for batch in batches:
                for start, ids, sizes in _some_numbers(batch.column(1)):
                    found = _score(reader, ids, sizes)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(sizes)), *(pa.array(x) for x in found)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    ids = numbered.schema["doc_id"].dataType.simpleString()
    return numbered.select("doc_id", "numbers").mapInArrow(score, f"doc_id {ids}, n_tokens long, n_known long, base_score double, score double")


def score_texts(docs: DataFrame, model: TrieModel, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row's whole text.

    A null text is an empty one, of one token, the end. ``base_score`` adds up
    the words' own log10 probabilities, ``score`` the model's. Repeated rows
    get equal scores, an empty table gives no rows. Other columns are ignored,
    whatever their names.
    """
    return score_numbers(number_texts(docs, model, text), model)


def score_corpus(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Scores of all documents by a model of those whose crc32 modulo ``folds`` is not 0.

    Texts are read twice, to count their words and to number them; the other
    levels and the scores come from the numbers, which are written to storage.
    """
    rest = remainder(F.col("doc_id"), folds)
    folder = shared_dir(docs.sparkSession, "trie")
    words = fit_words(docs.where(rest != 0), folder)
    numbered = persisted(number_texts(docs, words), "numbers")
    model = fit_successors(numbered.where(rest != 0), words, folder)
    scored = score_numbers(numbered, model).withColumn("held_out", rest == 0)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", (F.col("score") / F.col("n_tokens")).alias("mean_score"))
