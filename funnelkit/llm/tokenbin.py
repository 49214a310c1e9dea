"""Operator 5: token ids in a byte-aligned variable-length binary format.

Documents are range-partitioned by doc_id and tokenised in order. Each task
closes a *shard* every `SHARD_IDS` ids (always after a whole document):

    magic "FKT1", then little-endian u64: documents, ids, ranks, data bytes
    has_id  u8  [documents]   0 where doc_id is null
    doc_id  i64 [documents]
    count   u64 [documents]   ids of the document, end id included
    rank->id u32[ranks]       ids of the shard by falling frequency (ties: smaller id)
    control u8 [(ids+3)//4]   two bits an id: byte length of its rank less one
    data    u8 [data bytes]   the ranks' low bytes, little-endian

Frequent ids have small ranks and so one byte. Control bytes stand apart from
the data, so a table of 256 entries gives four lengths at a time and numpy
gathers all values at once. Shards are rows of a Parquet table in the shared
folder: Spark's writer commits them, and any store it reaches will do.

Tokenising splits a text before every single space and line feed, and before a
full stop or comma that ends such a piece behind a letter. The vocabulary's
pre-tokeniser always starts a token there, so the pieces' ids joined are the
text's ids; each worker remembers the ids of the pieces it met (bounded). Texts
with other white space, or that may hold an added token, go to the library whole.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.llm.common import kept, saved, text_batches

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
SHARD_IDS = 2_000_000
CACHE_PIECES = 600_000   # about 60 bytes each
CACHE_BYTES = 40_000_000   # of the pieces' own letters
GROUP_BYTES = 4_000_000   # of texts cut at a time
WHOLE_BYTES = 1_000_000   # of texts that go to the library whole, at a time
MAGIC = b"FKT1"

#: For each control byte, the byte lengths of its four ids.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)

#: White space but the space and the line feed.
_OTHER_SPACE = "[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]"
#: Texts that are not cut: empty, or with other white space than single spaces and line feeds between other characters.
_ODD = f"^$|^[ \n]|[ \n]$|[ \n][ \n]|{_OTHER_SPACE}"
#: A full stop or comma behind a letter of long-settled scripts (Latin, Greek, Cyrillic), at the end.
_MARKED = "[" + "".join(c for c in map(chr, range(0x530)) if c.isalpha()) + "][.,]$"


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    n = len(ranks)
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The values that `encode_ranks` wrote, by table lookup."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def write_shard(docs: list[tuple[int | None, bytes]]) -> bytes:
    """One shard of (doc_id, ids as little-endian u32 bytes)."""
    ids = np.frombuffer(b"".join(d for _, d in docs), "<u4")
    count = np.bincount(ids)  # as long as the vocabulary
    seen = np.flatnonzero(count)
    order = np.lexsort((seen, -count[seen]))
    rank = np.zeros(len(count), np.uint32)
    rank[seen[order]] = np.arange(len(seen), dtype=np.uint32)
    control, data = encode_ranks(rank[ids])
    return b"".join([
        MAGIC, struct.pack("<4Q", len(docs), len(ids), len(seen), len(data)),
        bytes(d is not None for d, _ in docs), np.array([d or 0 for d, _ in docs], "<i8").tobytes(),
        np.array([len(b) // 4 for _, b in docs], "<u8").tobytes(), seen[order].astype("<u4").tobytes(), control, data])


def read_shard(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, counts, all ids) of a shard."""
    if blob[:4] != MAGIC:
        raise ValueError("not a token shard")
    n_docs, n_ids, n_ranks, n_data = struct.unpack_from("<4Q", blob, 4)
    at = 36

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(blob, kind, n, at)
        at += part.nbytes
        return part

    has, docs, counts, to_id = take("u1", n_docs), take("<i8", n_docs), take("<u8", n_docs), take("<u4", n_ranks)
    control, data = take("u1", (n_ids + 3) // 4), take("u1", n_data)
    ids = to_id[decode_ranks(control.tobytes(), data.tobytes(), n_ids)] if n_ids else np.zeros(0, "<u4")
    return [int(d) if h else None for h, d in zip(has, docs)], counts.astype(np.int64), ids


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs values[start:start + size], end to end."""
    at = np.repeat(start - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return values[at]


def _slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Slices of at most `size` bytes, or of one text."""
    reach = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + size, "right")))
        yield texts.slice(at, to - at)
        at = to


class Encoder:
    """Ids of texts, through the tokenizers library and a memory of pieces.

    The memory is an Arrow array of pieces beside numpy arrays of their ids.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.odd = "|".join([_ODD, *map(re.escape, sorted(added))])
        space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][0]  # how the vocabulary writes a space
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        spaced[[i for t, i in vocabulary.items() if t.startswith(space)]] = True
        line, (self.stop,), (self.comma,) = self._ids(["\n", ".", ","])
        feed = np.zeros(len(spaced), bool)
        feed[line] = True
        self.skip = len(line)  # of the line feed put before each text
        self.opens = {" ": spaced, "\n": feed}
        self.pieces = pa.array([], pa.large_string())
        self.ids = np.zeros(0, "<u4")  # of all pieces, end to end
        self.start, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.turn = 0

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def _apart(self, pieces: list[str], lead: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids, sizes) of lead + piece: many go in one text and part again before the ids that open a piece."""
        ids, sizes = [], []
        for at in range(0, len(pieces), 2000):
            part = pieces[at:at + 2000]
            found = self._ids([lead + lead.join(part)])[0]
            cuts = np.flatnonzero(self.opens[lead][found])
            if len(cuts) == len(part):
                ids.append(found)
                sizes.append(np.diff(cuts, append=len(found)))
            else:
                alone = self._ids([lead + p for p in part])
                ids += alone
                sizes.append(np.array(list(map(len, alone))))
        return ids, sizes

    def _learn(self, wanted: pa.Array) -> np.ndarray:
        """Places in the memory of the pieces, which differ from each other; those not remembered are encoded together."""
        at = pc.index_in(wanted, value_set=self.pieces)
        place = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(place < 0)
        new = wanted.take(pa.array(missing))
        feed = pc.starts_with(new, "\n").to_numpy(zero_copy_only=False)
        lines, plain = new.filter(pa.array(feed)), new.filter(pa.array(~feed))
        ids, sizes = self._apart(plain.to_pylist(), " ")
        more = self._apart(pc.utf8_slice_codeunits(lines, 1).to_pylist(), "\n")
        place[np.concatenate([missing[~feed], missing[feed]])] = len(self.pieces) + np.arange(len(new))
        self.pieces = pa.concat_arrays([self.pieces, plain, lines])
        self.ids = np.concatenate([self.ids, *ids, *more[0]])
        self.size = np.concatenate([self.size, *sizes, *more[1]])
        self.start = np.cumsum(self.size) - self.size
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.turn += 1
        self.used[place] = self.turn
        return place

    def _table(self, different: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of pieces that differ from each other, end to end; a mark after a letter is put behind the ids of the rest."""
        marked = pc.match_substring_regex(different, _MARKED).to_numpy(zero_copy_only=False)
        ended = different.filter(pa.array(marked))
        rest = pa.concat_arrays([different.filter(pa.array(~marked)), pc.utf8_slice_codeunits(ended, 0, -1)]).dictionary_encode()
        place = np.empty(len(different), np.int64)
        place[np.argsort(marked, kind="stable")] = self._learn(rest.dictionary)[rest.indices.to_numpy()]
        size = self.size[place]
        comma = pc.ends_with(ended, ",").to_numpy(zero_copy_only=False)
        ids = np.insert(gather(self.ids, self.start[place], size), np.cumsum(size)[marked], np.where(comma, self.comma, self.stop))
        self._forget()
        return ids, size + marked

    def _forget(self) -> None:
        """Above a bound, only the pieces met last are kept, at most half of what the bounds allow."""
        if len(self.pieces) <= CACHE_PIECES and self.pieces.nbytes <= CACHE_BYTES:
            return
        last = np.argsort(-self.used, kind="stable")
        fit = np.searchsorted(np.cumsum(pc.binary_length(self.pieces).to_numpy()[last] + 8), CACHE_BYTES // 2, "right")
        last = np.sort(last[:min(fit, CACHE_PIECES // 2)])
        self.pieces = self.pieces.take(pa.array(last))
        self.ids = gather(self.ids, self.start[last], self.size[last])
        self.size, self.used = self.size[last], self.used[last]
        self.start = np.cumsum(self.size) - self.size

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [ids.tobytes() for ids in self.encode(pa.array(texts, pa.large_string()))]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a large_string array without nulls."""
        odd = pc.match_substring_regex(texts, self.odd)
        whole = (ids for some in _slices(texts.filter(odd), WHOLE_BYTES) for ids in self._ids(some.to_pylist()))
        plain = (ids for some in _slices(texts.filter(pc.invert(odd)), GROUP_BYTES) for ids in self._group(some))
        return (next(whole if o else plain) for o in odd.to_pylist())

    def _group(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Arrow cuts the texts and numbers their different pieces; numpy lays the pieces' ids end to end."""
        empty, feed = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
        lines = pc.binary_join_element_wise(empty, pc.replace_substring(texts, "\n", " \n"), feed)
        cut = pc.split_pattern(lines, " ")
        pieces = cut.flatten().dictionary_encode()
        ids, size = self._table(pieces.dictionary)
        code = pieces.indices.to_numpy()
        out, size = gather(ids, (np.cumsum(size) - size)[code], size[code]), size[code]
        bounds = np.concatenate([[0], np.cumsum(size)])[cut.offsets.to_numpy()].tolist()
        return (out[a + self.skip:b] for a, b in zip(bounds[:-1], bounds[1:]))


def encoder(path: str) -> Encoder:
    """One encoder a worker process, kept from task to task with what it remembers."""
    return kept(("tokens", path), lambda: Encoder(path))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _writer(path: str | None, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq = encoder(path or vocabulary_path()).encode, TaskContext.get().partitionId(), 0
        end, docs, n = np.array([END_ID], "<u4").tobytes(), [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()),
                 pa.array([write_shard(docs)], pa.binary())], ["part", "seq", "n_ids", "blob"])

        for batch in text_batches(batches, 2048):
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts)):
                docs.append((doc, ids.tobytes() + end))
                n += len(ids) + 1
                if n >= shard_ids:
                    yield shard()
                    docs, n, seq = [], 0, seq + 1
            pa.default_memory_pool().release_unused()  # what Arrow keeps back counts as the executor's memory
        if docs:
            yield shard()
    return run


def write_tokens(docs: DataFrame, path: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The written table of shards (part, seq, n_ids, blob); (part, seq) follows ascending doc_id, nulls first.

    path: vocabulary file, the same on every machine; by default that of the
    installed public vocabularies, looked up in the task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(_writer(path, shard_ids), "part int, seq int, n_ids long, blob binary")
    return saved(shards, "token-shards")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            part, seq, blob = (batch.column(c)[k].as_py() for c in ("part", "seq", "blob"))
            ids, counts, tokens = read_shard(blob)
            ends = np.cumsum(counts)
            raw = memoryview(np.ascontiguousarray(tokens, "<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (e - c):4 * e]) for c, e in zip(counts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), pa.array([seq] * len(ids), pa.int32()), pa.array(ids, pa.int64()),
                 pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_tokens(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards."""
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a task that wrote
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    starts = sizes.withColumn("inner", within).join(before, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("base"))
    docs = shards.select("part", "seq", "blob").mapInArrow(
        _reader, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return (docs.join(starts, ["part", "seq"])
            .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def token_table(docs: DataFrame, path: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shards, read them back: one row for each input row.

    Null and empty texts have the end id alone. Rows that share a doc_id follow
    each other by text. Null doc_ids come first. An empty table gives an empty
    result; extra columns are not read.
    """
    return read_tokens(write_tokens(docs, path, shard_ids))
